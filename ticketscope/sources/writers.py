"""Sinks: cleaned parquet tables and small CSV reports."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ticketscope.operators.cleaning import clean_changelog, clean_comments, clean_issues, normalise_columns
from ticketscope.schemas import require_columns
from ticketscope.sources.readers import read_csv

_CLEANERS = {"issues": clean_issues, "changelog": clean_changelog, "comments": clean_comments}


def write_cleaned(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Overwrite a parquet table, optionally partitioned for pruning."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_report(df: DataFrame, path: str, order_by: list | None = None, single_file: bool = True) -> None:
    """Overwrite a CSV report with a header: one ordered file, or with `single_file=False` written by all tasks.

    A single file passes through one task, so leave it for reports that are known to be short.
    """
    if single_file:
        df = df.coalesce(1) if order_by is None else df.repartition(1).sortWithinPartitions(*order_by)
    elif order_by is not None:
        df = df.orderBy(*order_by)
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def ingest_csv(spark: SparkSession, source: str, target: str, tables: tuple[str, ...] = tuple(_CLEANERS),
               multi_line: bool = True, schemas: dict[str, StructType] | None = None) -> dict[str, str]:
    """Read `<source>/<table>.csv`, clean each table and write `<target>/cleaned_<table>.parquet`.

    Tables in `schemas` are read by their schema (`schemas.raw_schema` gives the usual one), others by the header of
    their first file. All are checked before the first is written: a table without the columns that cleaning needs,
    whose names are compared after normalising, is refused with these named.
    """
    schemas = schemas or {}
    raw = {t: read_csv(spark, f"{source}/{t}.csv", schemas.get(t), multi_line=multi_line) for t in tables}
    for table in tables:
        require_columns(normalise_columns(raw[table]), table)
    written = {table: f"{target}/cleaned_{table}.parquet" for table in tables}
    for table in tables:
        write_cleaned(_CLEANERS[table](raw[table]), written[table])
    return written
