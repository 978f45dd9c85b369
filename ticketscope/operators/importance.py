"""What a fitted model relies on, by vector slot, by source column and by permutation."""

from pyspark.ml import Model, PipelineModel
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticketscope.functions.stages import slot_names
from ticketscope.operators.memory import keep

SLOTS = "slot int, source string, feature string, weight double"


def slot_weights(values, data: DataFrame, inputs: list[str]) -> DataFrame:
    """One row per vector slot with its source column, feature name and weight.

    Names come from the vector's own metadata, so each weight meets the slot it belongs to.
    """
    names = slot_names(data, inputs)
    if len(names) != len(values):
        raise ValueError(f"{len(values)} weights for {len(names)} slots")
    rows = [(slot, source, name, float(values[slot])) for slot, source, name in names]
    return data.sparkSession.createDataFrame(rows, SLOTS)


def feature_importance(model: Model, data: DataFrame, inputs: list[str], n: int = 10) -> DataFrame:
    """The n most important slots of a tree ensemble."""
    weights = slot_weights(model.featureImportances.toArray(), data, inputs)
    return weights.withColumnRenamed("weight", "importance").orderBy(F.desc("importance"), "slot").limit(n)


def centred_coefficients(model: Model, data: DataFrame, inputs: list[str]) -> DataFrame:
    """One row per slot of a binary logistic regression, with the coefficient that does not depend on where the fit began.

    One-hot columns beside an intercept leave the coefficients of a column free up to a constant. Of all these the one
    whose weights sum to zero over the values that occur is taken, the shortest; a value that never occurs weighs 0.
    Slots of plain numbers keep their coefficient.
    """
    seen = data.agg(Summarizer.numNonZeros(F.col("features")).alias("n")).first()["n"].toArray() > 0  # one vector
    weights = model.coefficients.toArray() * seen
    groups: dict[str, list[int]] = {}
    for slot, source, name in slot_names(data, inputs):
        if name != source and seen[slot]:
            groups.setdefault(source, []).append(slot)
    for slots in groups.values():
        weights[slots] -= weights[slots].mean()
    return slot_weights(weights, data, inputs)


def grouped_coef_importance(model: Model, data: DataFrame, inputs: list[str], n: int = 10) -> DataFrame:
    """Share of the absolute coefficients of a binary logistic regression per source column, coefficients centred."""
    weights = centred_coefficients(model, data, inputs).withColumn("weight", F.abs("weight"))
    total = weights.agg(F.sum("weight")).scalar()
    return (
        weights.groupBy(F.col("source").alias("Feature"))
        .agg(F.try_divide(F.sum("weight"), total).alias("Importance"))
        .orderBy(F.desc("Importance"), "Feature")
        .limit(n)
    )


def permuted_columns(df: DataFrame, columns: list[str], key: str = "key", seed: int = 42, ranges: int | None = None) -> DataFrame:
    """Adds `_permuted`, holding for every row the columns of another row of the table.

    All rows stand in one order, by a hash of the key; each takes the values of the row before it and the first those
    of the last, so every value is used once. The order is cut into equal ranges of the hash, a few per shuffle
    partition, that are sorted apart; the first row of a range looks up the last one of the range before it in a table
    of one row per range. The number of ranges does not change the result.
    """
    if ranges is None:
        ranges = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits = max(1, (ranges - 1).bit_length())
    place = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(key)), 1)
    rows = df.withColumns({"_place": place, "_range": F.shiftrightunsigned(place, 63 - bits)})
    values, position = F.struct(*columns), F.struct("_place", F.col(key))
    ends = rows.groupBy("_range").agg(F.max_by(values, position).alias("_end"))
    in_order = Window.partitionBy(F.lit(0)).orderBy("_range")  # a row per range
    whole = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = ends.select(F.col("_range").alias("_of"), F.coalesce(F.lag("_end").over(in_order), F.last("_end").over(whole)).alias("_end"))
    inside = Window.partitionBy("_range").orderBy("_place", key)
    shifted = rows.withColumns({"_before": F.lag(values).over(inside), "_number": F.row_number().over(inside)})
    joined = shifted.join(F.broadcast(before), F.col("_range") == F.col("_of"))
    return joined.withColumn("_permuted", F.when(F.col("_number") == 1, F.col("_end")).otherwise(F.col("_before"))).drop("_place", "_range", "_before", "_number", "_of", "_end")


def permutation_importance(
    model: Model, pipeline: PipelineModel, data: DataFrame, columns: list[str], key: str = "key", seed: int = 42
) -> DataFrame:
    """How much AUC the model loses when the values of one column are dealt out to other rows."""
    auc = BinaryClassificationEvaluator(labelCol="label")
    raw = keep(data.select(key, "label", *columns))
    mixed = keep(permuted_columns(raw, columns, key, seed))

    def score(df: DataFrame) -> float:
        return float(auc.evaluate(model.transform(pipeline.transform(df)).select("label", "rawPrediction")))

    try:
        base = score(mixed.drop("_permuted"))
        losses = [
            (name, base - score(mixed.withColumn(name, F.col("_permuted")[name]).drop("_permuted")))
            for name in columns
        ]
    finally:
        mixed.unpersist()
        raw.unpersist()
    return data.sparkSession.createDataFrame(losses, "feature string, importance double").orderBy(
        F.desc("importance"), "feature"
    )
