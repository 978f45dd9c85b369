"""Sets of reports that appear together: all are written first, then one manifest entry names them."""

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "version string, name string, path string"


def _manifest(out: str) -> str:
    return f"{out}/manifest"


def publish(spark: SparkSession, out: str, reports: dict[str, Callable[[str], None]]) -> dict[str, str]:
    """Writes every report into a fresh folder below `out`, then names all of them in the manifest; returns their paths.

    A report is a function that writes to the path it is given. The manifest grows by one file, which its commit makes
    visible whole or not at all, so who reads by `published` sees the former set until the last report is there. A run
    that dies before leaves a folder that no manifest names. Earlier sets stay, for readers that still hold their paths.
    """
    version = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    paths = {name: f"{out}/{version}/{name}" for name in reports}
    for name, write in reports.items():
        write(paths[name])
    entry = spark.createDataFrame([(version, name, path) for name, path in paths.items()], MANIFEST)
    entry.coalesce(1).write.mode("append").parquet(_manifest(out))
    return paths


def published(spark: SparkSession, out: str) -> dict[str, str]:
    """Paths by name of the reports that were last published together; one row per report reaches the driver."""
    entries = spark.read.schema(MANIFEST).parquet(_manifest(out))
    newest = entries.agg(F.max("version")).scalar()
    return {row["name"]: row["path"] for row in entries.filter(F.col("version") == newest).collect()}


def read_published(spark: SparkSession, out: str, read: Callable[[SparkSession, str], DataFrame]) -> dict[str, DataFrame]:
    """The reports last published together, each read by `read(spark, path)`."""
    return {name: read(spark, path) for name, path in published(spark, out).items()}
