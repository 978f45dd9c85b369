"""Table cleaning and enrichment of issues with their activity counts."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketscope.constants import BUG_TYPE, CENTURY_PREFIX, DEDUPE_KEYS, REQUIRED_COLUMNS, STATUS_FIELD
from ticketscope.functions.hashing import ISSUES, key_fraction
from ticketscope.functions.times import as_timestamp
from ticketscope.schemas import present


def normalise_columns(df: DataFrame) -> DataFrame:
    """Dots and spaces in column names become underscores."""
    names = [name.replace(".", "_").replace(" ", "_") for name in df.columns]
    clashes = {name for name in names if names.count(name) > 1}
    if clashes:
        raise ValueError(f"column names collide after normalising: {sorted(clashes)}")
    return df.toDF(*names)


def latest_per_key(df: DataFrame, key: str, newest: Column | None = None, carried: str | None = None) -> DataFrame:
    """One row per key: the newest, ties settled by the whole row, so every run keeps the same one.

    It is a `max` over rows, combined before the shuffle, so a key with a third of all rows costs no
    more than any other. What `newest` found is returned as the column `carried` when that is named.
    """
    rest = [name for name in df.columns if name != key]
    order = [newest.alias("_newest")] if newest is not None else []
    kept = df.groupBy(key).agg(F.max(F.struct(*order, *[F.col(name) for name in rest])).alias("_row"))
    found = [F.col("_row")["_newest"].alias(carried)] if carried is not None and order else []
    return kept.select(*[F.col(key) if name == key else F.col("_row")[name].alias(name) for name in df.columns], *found)


_PARSED = "__newest"


def _unique_and_complete(df: DataFrame, table: str) -> tuple[DataFrame, str | None]:
    """Unique, complete rows, with the parsed time of the column named second in `_PARSED`."""
    df = normalise_columns(df)
    by = next((name for name in ("updated", "created") if name in df.columns), None)
    newest = None if by is None else as_timestamp(df, by)
    return latest_per_key(df, DEDUPE_KEYS[table], newest, _PARSED).dropna(subset=REQUIRED_COLUMNS[table]), by


def _with_times(df: DataFrame, times: list[str], parsed: str | None) -> DataFrame:
    """The columns `times` as time stamps; the one that rows were chosen by is not parsed again."""
    found = {name: F.col(_PARSED) if name == parsed else as_timestamp(df, name) for name in present(df, times)}
    return df.withColumns(found).drop(_PARSED)


def clean_issues(raw: DataFrame) -> DataFrame:
    """Unique, complete issues whose two time stamps carry a four-digit year, with times parsed."""
    df, parsed = _unique_and_complete(raw, "issues")
    df = df.filter(F.col("created").startswith(CENTURY_PREFIX) & F.col("updated").startswith(CENTURY_PREFIX))
    return _with_times(df, ["created", "updated", "resolutiondate"], parsed)


def clean_comments(raw: DataFrame) -> DataFrame:
    """Unique comments that name their issue."""
    return _with_times(_unique_and_complete(raw, "comments")[0], [], None)


def clean_changelog(raw: DataFrame) -> DataFrame:
    """Unique changes that name their issue and field, with times parsed where there are any."""
    df, parsed = _unique_and_complete(raw, "changelog")
    return _with_times(df, ["created"], parsed)


def enrich_issues(issues: DataFrame, comments: DataFrame, changelog: DataFrame) -> DataFrame:
    """Adds comment and status-change counts, 0 where there are none. Both sides of each join are unique by key."""
    comment_counts = comments.groupBy("key").agg(F.count("comment_id").alias("comment_count"))
    status_counts = (
        changelog.filter(F.col("field") == STATUS_FIELD)
        .groupBy("key")
        .agg(F.count("id").alias("status_change_count"))
    )
    return (
        issues.join(comment_counts, "key", "left")
        .join(status_counts, "key", "left")
        .fillna(0, subset=["comment_count", "status_change_count"])
    )


def load_bugs(
    issues: DataFrame, changelog: DataFrame | None = None, fraction: float | None = None
) -> tuple[DataFrame, DataFrame | None]:
    """Bugs, and the changes that belong to them when only a fraction of the issues is wanted."""
    sampling = fraction is not None and fraction < 1.0
    if sampling:
        issues = issues.filter(key_fraction("key", ISSUES) < fraction)
    bugs = issues.filter(F.col("issuetype_name") == BUG_TYPE)
    if sampling and changelog is not None:
        # Bug keys are unique, so Spark may split the changes of a key with very many of them.
        changelog = changelog.filter(key_fraction("key", ISSUES) < fraction).join(bugs.select("key"), "key", "left_semi")
    return bugs, changelog


def table_profile(df: DataFrame) -> DataFrame:
    """One row: the row count and, per column, how many values are present."""
    return df.agg(
        F.count(F.lit(1)).alias("row_count"), *[F.count(F.col(name)).alias(f"{name}_present") for name in df.columns]
    )


def bug_share(issues: DataFrame) -> DataFrame:
    """One row: all issues, bugs, and bugs as a percentage of all issues."""
    return issues.agg(
        F.count(F.lit(1)).alias("issue_count"),
        F.count_if(F.col("issuetype_name") == BUG_TYPE).alias("bug_count"),
    ).withColumn("bug_percent", F.try_divide(F.col("bug_count") * 100.0, F.col("issue_count")))
