"""Checks that a fitted model is at its optimum, from the rows it was fitted on.

Each returns one row per part of the model with the number of violations, 0 for a model that is right.
"""

import numpy as np
from pyspark.ml import Model
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketscope.functions.stages import slot_names
from ticketscope.operators.components import Components, entries


def _slots(values: dict[int, np.ndarray], spark, name: str) -> DataFrame:
    """(part, slot, value) of what is not zero: a row per number of the model."""
    rows = [(part, int(i), float(v[i])) for part, v in values.items() for i in np.flatnonzero(v)]
    return spark.createDataFrame(rows, f"part int, slot int, {name} double")


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows with a number, given before their entries are listed; persist what it is given, for the numbers to stay."""
    return rows.withColumn("row", F.monotonically_increasing_id())


def centre_violations(clustered: DataFrame, centres: list[np.ndarray], tol: float = 1e-6) -> DataFrame:
    """Per cluster of a k-means model: its rows, those nearer to another centre, and slots whose centre is not the mean.

    `clustered` holds `features` and `prediction`. Distances come from the dot products of each row with every centre.
    """
    spark, k = clustered.sparkSession, len(centres)
    parts = _slots(dict(enumerate(centres)), spark, "centre")
    lengths = [float(c @ c) for c in centres]
    rows = _numbered(clustered).select("row", "prediction", F.inline(entries("features")))
    sums = rows.groupBy(F.col("prediction").alias("part"), "slot").agg(F.sum("value").alias("total"))
    sizes = clustered.groupBy(F.col("prediction").alias("part")).agg(F.count(F.lit(1)).alias("rows"))
    means = sums.join(F.broadcast(sizes), "part").select("part", "slot", (F.col("total") / F.col("rows")).alias("mean"))
    gap = F.abs(F.coalesce("mean", F.lit(0.0)) - F.coalesce("centre", F.lit(0.0)))
    off = means.join(parts, ["part", "slot"], "full").groupBy("part").agg(F.count_if(gap > tol * F.greatest(F.lit(1.0), F.abs("centre"))).alias("wrong_slots"))
    table = parts.groupBy("slot").agg(F.collect_list(F.struct("part", "centre")).alias("centres"))
    near = rows.join(F.broadcast(table), "slot", "left").select("row", "prediction", F.inline_outer("centres"), "value")
    dots = near.groupBy("row", "prediction").agg(F.array(*(F.sum(F.when(F.col("part") == i, F.col("centre") * F.col("value")).otherwise(0.0)) for i in range(k))).alias("dots"))
    far = dots.select("prediction", F.zip_with("dots", F.array(*map(F.lit, lengths)), lambda dot, length: length - 2 * dot).alias("far"))
    own = F.element_at("far", F.col("prediction") + 1)
    wrong = far.groupBy(F.col("prediction").alias("part")).agg(F.count_if(own - F.array_min("far") > tol * F.greatest(F.lit(1.0), F.abs(own))).alias("wrong_rows"))
    every = spark.range(k).select(F.col("id").cast("int").alias("part"))
    return every.join(sizes, "part", "left").join(off, "part", "left").join(wrong, "part", "left").fillna(0).withColumnRenamed("part", "prediction")


def component_violations(vectors: DataFrame, components: Components, tol: float = 1e-4) -> DataFrame:
    """Per component: slots at which covariance times direction is not variance times direction, and other faults.

    The covariance of every slot with the rows' scores comes from sums over the rows' entries. A direction whose length
    is not 1, or that is not at right angles to the ones before it, counts as one fault more.
    """
    spark, k = vectors.sparkSession, components.directions.shape[1]
    parts = _slots({i: components.directions[:, i] for i in range(k)}, spark, "weight")
    scale = [max(float(v), 1e-12) for v in components.variances]
    rows = _numbered(vectors).select("row", F.inline(entries("features")))
    table = parts.groupBy("slot").agg(F.collect_list(F.struct("part", "weight")).alias("parts"))
    scores = rows.join(F.broadcast(table), "slot").select("row", F.inline("parts"), "value").groupBy("row", "part").agg(F.sum(F.col("weight") * F.col("value")).alias("score"))
    n = vectors.count()
    totals = scores.groupBy("part").agg((F.sum("score") / n).alias("mean_score"))
    means = rows.groupBy("slot").agg((F.sum("value") / n).alias("mean"))
    together = rows.join(scores, "row").groupBy("part", "slot").agg(F.sum(F.col("value") * F.col("score")).alias("product"))
    held = together.join(F.broadcast(totals), "part").join(means, "slot").join(parts, ["part", "slot"], "left")
    variance = F.element_at(F.array(*map(F.lit, scale)), F.col("part") + 1)
    off = F.abs((F.col("product") - n * F.col("mean") * F.col("mean_score")) / (n - 1) - variance * F.coalesce("weight", F.lit(0.0))) > tol * variance
    counted = held.groupBy("part").agg(F.count_if(off).alias("wrong_slots"))
    square = components.directions.T @ components.directions
    faults = [int((np.abs(square[i, : i + 1] - np.eye(k)[i, : i + 1]) > 1e-6).sum()) + int(i > 0 and components.variances[i] > components.variances[i - 1]) for i in range(k)]
    extra = spark.createDataFrame(list(enumerate(faults)), "part int, faults int")
    return extra.join(counted, "part", "left").select((F.col("part") + 1).alias("component"), (F.coalesce("wrong_slots", F.lit(0)) + F.col("faults")).cast("long").alias("violations"))


def score_equations(model: Model, data: DataFrame, columns: list[str], weight: str | None = None) -> DataFrame:
    """Per value of each column: rows, positives expected by an unpenalised logistic regression, and positives seen.

    At the optimum with one-hot columns the two agree for every value: the gradient of the likelihood is their difference.
    """
    amount = F.col(weight) if weight else F.lit(1.0)
    chance = vector_to_array("probability").getItem(1)
    values = F.array(*(F.struct(F.lit(c).alias("source"), F.col(c).cast("string").alias("value")) for c in columns))
    scored = model.transform(data).select(F.inline(values), chance.alias("chance"), F.col("label"), amount.alias("amount"))
    return scored.groupBy("source", "value").agg(
        F.sum("amount").alias("rows"), F.sum(F.col("chance") * F.col("amount")).alias("expected"), F.sum(F.col("label") * F.col("amount")).alias("seen")
    )


def leaf_violations(model: Model, data: DataFrame, weight: str | None = None) -> DataFrame:
    """One row: leaves of a decision tree that rows reach, and those whose stored class counts are not the rows' own."""
    amount = F.col(weight) if weight else F.lit(1.0)
    stored = vector_to_array("rawPrediction")
    told = model.copy().setLeafCol("leaf")
    reached = told.transform(data).select(stored.alias("stored"), F.col("label"), amount.alias("amount"), "leaf")
    seen = reached.groupBy("leaf", "stored").agg(F.sum(F.when(F.col("label") == 0, F.col("amount")).otherwise(0.0)).alias("zeros"), F.sum(F.when(F.col("label") == 1, F.col("amount")).otherwise(0.0)).alias("ones"))
    wrong = (F.abs(F.col("stored")[0] - F.col("zeros")) > 1e-6) | (F.abs(F.col("stored")[1] - F.col("ones")) > 1e-6)
    return seen.agg(F.count(F.lit(1)).alias("leaves"), F.count_if(wrong).alias("wrong_leaves"))


def root_split(model: Model, data: DataFrame, inputs: list[str]) -> DataFrame:
    """One row: source column and value of the first question of a decision tree over one-hot columns, and its gain."""
    root = model._call_java("rootNode")
    slot = root.split().featureIndex()
    name = {s: (source, feature) for s, source, feature in slot_names(data, inputs)}[slot]
    return data.sparkSession.createDataFrame([(name[0], name[1].split("=", 1)[1], float(root.gain()))], "source string, value string, gain double")
