"""Quality of predictions, from one count per (label, prediction)."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _cells(predictions: DataFrame, *by: str) -> DataFrame:
    label, prediction = F.col("label").cast("double"), F.col("prediction").cast("double")
    return predictions.groupBy(*by, label.alias("label"), prediction.alias("prediction")).agg(
        F.count(F.lit(1)).alias("n")
    )


def class_metrics(predictions: DataFrame) -> DataFrame:
    """Precision, recall and F1 of each label that occurs; 0 where a denominator is empty."""
    n, none = F.col("n"), F.lit(0).cast("bigint")
    hit = F.when(F.col("label") == F.col("prediction"), n).otherwise(none)
    sides = F.array(
        F.struct("label", hit.alias("tp"), n.alias("support"), none.alias("predicted")),
        F.struct(F.col("prediction").alias("label"), none.alias("tp"), none.alias("support"), n.alias("predicted")),
    )
    totals = (
        _cells(predictions)
        .select(F.inline(sides))
        .groupBy("label")
        .agg(*[F.sum(name).alias(name) for name in ("tp", "support", "predicted")])
        .filter(F.col("support") > 0)
    )
    precision = F.coalesce(F.try_divide("tp", "predicted"), F.lit(0.0))
    recall = F.coalesce(F.try_divide("tp", "support"), F.lit(0.0))
    p, r = F.col("precision"), F.col("recall")
    f1 = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    return (
        totals.withColumns({"precision": precision, "recall": recall})
        .withColumn("f1", f1)
        .select("label", "support", "tp", "precision", "recall", "f1")
    )


def classification_report(predictions: DataFrame) -> DataFrame:
    """One row: accuracy, and precision, recall and F1 weighted by label frequency."""
    total = F.sum("support")
    return class_metrics(predictions).agg(
        F.try_divide(F.sum("tp"), total).alias("accuracy"),
        *[
            F.try_divide(F.sum(F.col(name) * F.col("support")), total).alias(f"weighted_{name}")
            for name in ("precision", "recall", "f1")
        ],
    )


def confusion_table(predictions: DataFrame, model: str = "Model") -> DataFrame:
    """TP, FP, TN, FN per model, from 0/1 labels and predictions tagged with the model's name."""
    def cell(prediction: int, label: int):
        return F.count_if((F.col("prediction") == prediction) & (F.col("label") == label))

    return predictions.groupBy(model).agg(
        cell(1, 1).alias("TP"), cell(1, 0).alias("FP"), cell(0, 0).alias("TN"), cell(0, 1).alias("FN")
    )
