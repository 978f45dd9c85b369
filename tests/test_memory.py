"""What held tables take up in memory."""

from pyspark import StorageLevel
from pyspark.sql import functions as F

from ticketscope.operators import models
from ticketscope.operators.memory import keep
from ticketscope.operators.sampling import parts_for, spread


def test_a_held_table_takes_no_memory_of_the_executors(spark):
    rows = spark.range(50_000).select("id", F.array_repeat(F.col("id").cast("string"), 5).alias("words"))
    held = keep(rows.repartition(3, "id"))
    before = {info.id() for info in spark.sparkContext._jsc.sc().getRDDStorageInfo()}
    try:
        assert held.storageLevel == StorageLevel.DISK_ONLY
        assert held.agg(F.sum("id"), F.sum(F.size("words"))).first()[:] == (50_000 * 49_999 // 2, 250_000)
        sizes = [(info.memSize(), info.diskSize()) for info in spark.sparkContext._jsc.sc().getRDDStorageInfo() if info.id() not in before]
        assert sizes and all(memory == 0 and disk > 0 for memory, disk in sizes)
    finally:
        held.unpersist()


def test_a_task_of_the_reopening_models_holds_less_of_a_large_table(spark, monkeypatch):
    """A forest holds some 5 KB a row, so 100,000 rows a task were 500 MB, two tasks at once more than Spark grants."""
    asked = []
    monkeypatch.setattr(models, "spread", lambda df, key, *most: asked.append(most) or spread(df, key, *most))
    rows = [(f"P-{i}", "P", "High", [f"word{j}" for j in range(i % 7)] * 5, i % 3 == 0, i) for i in range(60)]
    features = spark.createDataFrame(rows, "key string, project string, priority_name string, filtered_words array<string>, was_reopened boolean, comment_count long")
    data = models.reopen_datasets(features)
    try:
        assert data.train.count() + data.test.count() == 60
        assert [parts_for(n, *asked[0]) for n in (100_000, 100_001, 600_000, 3_700_000)] == [1, 16, 24, 148]
    finally:
        data.release()
