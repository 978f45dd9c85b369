"""Intermediate tables that outlive a task: written once to the folder all executors share."""

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 1_000_000
_open: list[list[str]] = []  # paths of the tables of each open scratch block, innermost last


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Unset, a local session gets a temporary one; a cluster is refused."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="llm-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables stored inside the block are deleted at its end, but for those stored with `result=True`."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            there = spark._jvm.org.apache.hadoop.fs.Path(path)
            there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def small(table: DataFrame) -> DataFrame:
    """Marks a stored table of keys for broadcast where a count has shown it to be small; others are joined by shuffle."""
    return F.broadcast(table) if table.count() <= MAX_BROADCAST_ROWS else table


def stored(df: DataFrame, name: str, result: bool = False) -> DataFrame:
    """Writes the table to a fresh subfolder and reads it back: lineage ends here, and a lost executor costs a read.

    What is read back never changes, so keys that Spark would compute anew on a retry stay what they were. The `result`
    of a scratch block outlives it and belongs to the block around it, if there is one.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    blocks = _open[:-1] if result else _open
    if blocks:
        blocks[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)
