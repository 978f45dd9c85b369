"""Resolution-time and field-change reports, and the slow-resolution label."""

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketscope.functions.times import as_timestamp, days_between, hours_between


def recent_resolution(
    issues: DataFrame, as_of: str | datetime.date | Column | None = None, months: int = 24
) -> DataFrame:
    """Issues created within `months` before `as_of` (today by default), with days from creation to last update.

    `as_of` may be a scalar subquery, such as `issues.agg(F.max("created")).scalar()`.
    """
    if as_of is None:
        as_of = F.current_date()
    elif not isinstance(as_of, Column):
        as_of = F.lit(as_of)
    start = F.add_months(as_of.cast("date"), -months)
    return issues.withColumn("resolution_days", days_between("created", "updated")).filter(
        F.col("resolution_days").isNotNull() & (F.col("created") >= start)
    )


def _exact_avg(name: str) -> Column:
    """Mean of a two-decimal column, summed as decimals so that the order of the rows cannot change it."""
    return F.sum(F.col(name).cast("decimal(18,2)")).cast("double") / F.count(name)


def resolution_by_priority_status(resolved: DataFrame) -> DataFrame:
    """Average days by priority and status."""
    return (
        resolved.groupBy("priority_name", "status_name")
        .agg(_exact_avg("resolution_days").alias("avg_resolution_days"))
        .orderBy("priority_name", "status_name")
    )


def top_changed_fields(changelog: DataFrame, n: int = 10) -> DataFrame:
    """The n most changed fields, with the number of distinct issues each change touched."""
    return (
        changelog.groupBy("field")
        .agg(F.count(F.lit(1)).alias("total_changes"), F.count_distinct("key").alias("affected_issues"))
        .orderBy(F.desc("total_changes"), "field")
        .limit(n)
    )


def resolution_hours(issues: DataFrame) -> DataFrame:
    """Resolved issues with the hours from creation to resolution."""
    return (
        issues.withColumns({
            "created_ts": as_timestamp(issues, "created"),
            "resolved_ts": as_timestamp(issues, "resolutiondate"),
        })
        .filter(F.col("resolved_ts").isNotNull())
        .withColumn("resolution_hours", hours_between("created_ts", "resolved_ts"))
    )


def mean_hours(resolved: DataFrame) -> Column:
    """Mean resolution hours as a scalar subquery."""
    seconds = F.round(F.col("resolution_hours") * 3600).cast("bigint")
    return resolved.agg(F.sum(seconds) / 3600.0 / F.count("resolution_hours")).scalar()


def label_slow(resolved: DataFrame, mean: Column) -> DataFrame:
    """Missing hours become the mean; label 1 marks issues that took longer than it."""
    hours = F.coalesce(F.col("resolution_hours"), mean)
    return resolved.withColumn("resolution_hours", hours).withColumn(
        "label", F.when(F.col("resolution_hours") > mean, 1).otherwise(0)
    )


def slow_labels(issues: DataFrame) -> DataFrame:
    """Resolved issues labelled against the mean over all of them."""
    resolved = resolution_hours(issues)
    return label_slow(resolved, mean_hours(resolved))
