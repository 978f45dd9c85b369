"""Schemas of the cleaned tables and of the report tables."""

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ticketscope.constants import BODY_COLUMNS, REQUIRED_COLUMNS

ISSUES = T.StructType([
    T.StructField("key", T.StringType(), False),
    T.StructField("issuetype_name", T.StringType(), False),
    T.StructField("priority_name", T.StringType(), False),
    T.StructField("status_name", T.StringType(), False),
    T.StructField("project_name", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("created", T.TimestampNTZType(), False),
    T.StructField("updated", T.TimestampNTZType(), False),
    T.StructField("resolutiondate", T.TimestampNTZType()),
])

CHANGELOG = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("key", T.StringType(), False),
    T.StructField("field", T.StringType(), False),
    T.StructField("fromString", T.StringType()),
    T.StructField("toString", T.StringType()),
    T.StructField("created", T.TimestampNTZType()),
])

COMMENTS = T.StructType([
    T.StructField("comment_id", T.StringType(), False),
    T.StructField("key", T.StringType(), False),
    T.StructField("body", T.StringType()),
])

MODEL_METRICS = T.StructType([
    T.StructField("model", T.StringType()),
    T.StructField("auc", T.FloatType()),
    T.StructField("precision", T.FloatType()),
    T.StructField("recall", T.FloatType()),
    T.StructField("f1", T.FloatType()),
])

MODEL_COMPARISON = T.StructType([
    T.StructField("Model", T.StringType()),
    T.StructField("AUC", T.DoubleType()),
    T.StructField("Accuracy", T.DoubleType()),
    T.StructField("Precision", T.DoubleType()),
    T.StructField("Recall", T.DoubleType()),
    T.StructField("TrainTime", T.DoubleType()),
])


CLEANED = {"issues": ISSUES, "changelog": CHANGELOG, "comments": COMMENTS}


def raw_schema(table: str, without: tuple[str, ...] = ()) -> T.StructType:
    """Schema of an export that holds the cleaned table's columns in their order, all as text."""
    return T.StructType([T.StructField(f.name, T.StringType()) for f in CLEANED[table] if f.name not in without])


def require_columns(df: DataFrame, table: str) -> DataFrame:
    """The table itself; refused, with the missing columns named, when cleaning could not work on it."""
    missing = [name for name in REQUIRED_COLUMNS[table] if name not in df.columns]
    if missing:
        raise ValueError(f"{table} lacks the columns {missing}; it has {df.columns}")
    return df


def body_column(comments: DataFrame) -> str:
    """Name of the first known comment-body column the table has."""
    for name in BODY_COLUMNS:
        if name in comments.columns:
            return name
    raise ValueError(f"no comment body column; looked for {BODY_COLUMNS} in {comments.columns}")


def present(df: DataFrame, names: list[str]) -> list[str]:
    """Those of `names` the table has, in the given order."""
    return [name for name in names if name in df.columns]
