import random

import pytest
from pyspark.sql import functions as F
from pyspark.ml.evaluation import MulticlassClassificationEvaluator

from ticketscope.operators.metrics import class_metrics, classification_report, confusion_table
from ticketscope.operators.sampling import bernoulli_sample, hash_sample, hash_split, parts_for, sample_exactly, sample_to_size, spread


@pytest.fixture(scope="module")
def predictions(spark):
    draw = random.Random(3)
    rows = [(float(draw.randrange(4)), float(draw.choice([0, 1, 1, 5])), draw.choice("ab")) for _ in range(500)]
    return spark.createDataFrame(rows, "label double, prediction double, Model string").persist()


@pytest.mark.parametrize("ours,theirs", [
    ("accuracy", "accuracy"), ("weighted_precision", "weightedPrecision"), ("weighted_recall", "weightedRecall"), ("weighted_f1", "f1"),
])
def test_report_equals_evaluator(predictions, ours, theirs):
    evaluator = MulticlassClassificationEvaluator(labelCol="label", predictionCol="prediction", metricName=theirs)
    assert classification_report(predictions).first()[ours] == pytest.approx(evaluator.evaluate(predictions))


def test_classes(spark):
    df = spark.createDataFrame([(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (2.0, 0.0), (0.0, 9.0)], "label double, prediction double")
    rows = {row["label"]: tuple(row)[1:] for row in class_metrics(df).collect()}
    assert set(rows) == {0.0, 1.0, 2.0}
    assert rows[0.0] == pytest.approx((3, 1, 1 / 2, 1 / 3, 0.4))
    assert rows[2.0] == (1, 0, 0.0, 0.0, 0.0)


def test_confusion(predictions):
    binary = predictions.selectExpr("cast(label > 1 as int) label", "cast(prediction > 0 as double) prediction", "Model")
    rows = confusion_table(binary).collect()
    assert sum(row["TP"] + row["FP"] + row["TN"] + row["FN"] for row in rows) == 500
    local = [(r["label"], r["prediction"]) for r in binary.collect() if r["Model"] == "a"]
    a = next(row for row in rows if row["Model"] == "a")
    assert (a["TP"], a["FN"]) == (local.count((1, 1.0)), local.count((1, 0.0)))


def test_nothing_to_measure(spark):
    empty = spark.createDataFrame([], "label double, prediction double, Model string")
    assert class_metrics(empty).count() == 0 and confusion_table(empty).count() == 0
    assert classification_report(empty).first()["accuracy"] is None


def test_samples_do_not_depend_on_partitioning(spark):
    df = spark.range(5000).selectExpr("concat('k', id) as key")
    one, many = (
        {row["key"] for row in hash_sample(part, "key", 0.2).collect()} for part in (df.coalesce(1), df.repartition(13))
    )
    assert one == many and 900 < len(one) < 1100
    other = {row["key"] for row in hash_sample(df, "key", 0.2, salt="x").collect()}
    assert other != one
    train, test = hash_split(df, "key")
    assert train.count() + test.count() == 5000 and 3850 < train.count() < 4150
    assert train.join(test, "key").count() == 0


def test_sample_to_size(spark):
    df = spark.range(5000).selectExpr("concat('k', id) as key")
    assert 400 < sample_to_size(df, "key", 500).count() < 600
    assert sample_to_size(df, "key", 50000).count() == 5000
    assert sample_to_size(df.limit(0), "key", 10).count() == 0
    assert 900 < bernoulli_sample(df, 0.2).count() < 1100
    assert bernoulli_sample(df, 7.0).count() == 5000


def test_sample_exactly(spark):
    df = spark.range(5000).selectExpr("concat('k', id) as key", "id")
    for size in (0, 1, 499, 500, 4999, 5000, 6000):
        chosen = sample_exactly(df, "key", size)
        assert chosen.count() == min(size, 5000) and chosen.columns == df.columns
    keys = {r["key"] for r in sample_exactly(df, "key", 500).collect()}
    assert keys == {r["key"] for r in sample_exactly(df.repartition(13), "key", 500).collect()}
    assert keys < {r["key"] for r in sample_exactly(df, "key", 600).collect()}
    same = spark.range(100).selectExpr("'one' as key", "id")
    assert sample_exactly(same, "key", 30).count() == 30 and sample_exactly(same.unionByName(df), "key", 4000).count() == 4000
    assert sample_exactly(df.limit(0), "key", 10).count() == 0


def test_parts_grow_with_the_rows():
    assert [parts_for(n) for n in (0, 75_000, 100_000, 100_001, 1_500_000, 9_000_000, 27_000_000)] == [1, 1, 1, 16, 16, 90, 270]
    assert all(n / parts_for(n) <= 100_000 for n in (10**5, 10**6, 10**7, 10**8))


def test_a_spread_table_keeps_its_rows_and_no_part_holds_many_more_than_others(spark):
    rows = spark.range(200_000).selectExpr("concat('K-', id) as key", "id")
    dealt = spread(rows, "key")
    sizes = [r["n"] for r in dealt.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 16 and sum(sizes) == 200_000 and max(sizes) < 14_000
    assert dealt.agg(F.sum("id")).first()[0] == sum(range(200_000))
    few = spark.createDataFrame([("K-1", 1), ("K-1", 2), (None, 3)], "key string, id int")
    assert sorted(r["id"] for r in spread(few, "key").collect()) == [1, 2, 3]
