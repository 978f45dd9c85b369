"""Rows meet Python in Arrow batches of bounded size."""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

BATCH_BYTES = 4 << 20
_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def mapped(rows: DataFrame, run: Callable, shape: str | StructType) -> DataFrame:
    """`mapInArrow` in batches that end with the row by which they pass `BATCH_BYTES`.

    Spark's own bound is 10,000 rows or 64 MB, which each task holds several times over: in the executor, in its worker,
    and there again as Python values. Plans read the bound when they run, so it is set for the session, to stay; a lower
    one is left alone.
    """
    spark = rows.sparkSession
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_LIMIT)) > BATCH_BYTES:
        spark.conf.set(_LIMIT, str(BATCH_BYTES))
    return rows.mapInArrow(run, shape)
