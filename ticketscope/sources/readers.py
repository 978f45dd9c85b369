"""Table scans. CSV columns come in as strings: cleaning gives them their types, so no inference pass runs."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def read_csv(
    spark: SparkSession,
    path: str,
    schema: StructType | None = None,
    multi_line: bool = True,
    max_columns: int = 40000,
) -> DataFrame:
    """Quoted CSV with a header; quotes are escaped by doubling and fields may hold line breaks.

    A multi-line file is read by one task, so land large exports as many files, or pass
    `multi_line=False` for exports known to hold one record per line: those are split.
    Every file's header must name the columns of the schema, or else of the first file, in that order: Spark refuses
    a file that does not, rather than taking its columns by position.
    """
    reader = (
        spark.read.option("header", True)
        .option("multiLine", multi_line)
        .option("quote", '"')
        .option("escape", '"')
        .option("maxColumns", max_columns)
        .option("maxCharsPerColumn", -1)
    )
    schema = reader.csv(path).schema if schema is None else schema
    return reader.schema(schema).option("enforceSchema", False).csv(path)


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Parquet scan, narrowed to `columns` when given."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df
