"""Reopened bugs: detection in the change history, features and profile."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketscope.constants import (
    ATTACHMENT_FIELD, COMMENT_FIELD, REOPEN_WORDS, REOPENED, RESOLUTION_WORDS, STATUS_FIELD,
)
from ticketscope.functions.text import contains_any
from ticketscope.functions.times import whole_days_between

def _status_moves(changelog: DataFrame, order_by: tuple[str, ...]) -> DataFrame:
    """Per status change only what the pattern needs: its place in the order and three flags."""
    to, source = F.lower("toString"), F.lower("fromString")
    return changelog.filter(
        (F.col("field") == STATUS_FIELD) & F.col("fromString").isNotNull() & F.col("toString").isNotNull()
    ).select(
        "key",
        *order_by,
        contains_any(to, RESOLUTION_WORDS).alias("resolves"),
        (contains_any(source, RESOLUTION_WORDS) & contains_any(to, REOPEN_WORDS)).alias("leaves"),
        (to == REOPENED).alias("direct"),
    )


def _followed(order: list[Column], *group: str) -> Column:
    """The row resolves and the next one in its group leaves the resolved state."""
    return F.col("resolves") & F.lead("leaves", 1, False).over(Window.partitionBy(*group).orderBy(*order))


def reopen_flags(changelog: DataFrame, order_by: tuple[str, ...] = ("created", "id"), unit: str = "day") -> DataFrame:
    """Per issue with usable status changes, whether it was reopened.

    That is: a change into a resolved state directly followed by one out of such a state into an open
    one, or any change to "reopened". Changes without a time come first.

    Every history is cut into segments by the `unit` of its first order column. A segment is reduced to its first and
    last row and whether it holds a pair; the few segments of an issue are then linked up. So the changes are
    shuffled once, by issue and segment, and an issue with very many of them fills many tasks.
    """
    order = [F.col(name) for name in order_by]
    moves = _status_moves(changelog, order_by).withColumn("segment", F.date_trunc(unit, order_by[0]))
    place = F.struct(*order)
    segments = (
        moves.withColumn("hit", _followed(order, "key", "segment") | F.col("direct"))
        .groupBy("key", "segment")
        .agg(
            F.bool_or("hit").alias("hit"),
            F.min_by("leaves", place).alias("leaves"),
            F.max_by("resolves", place).alias("resolves"),
        )
    )
    linked = segments.withColumn("hit", F.col("hit") | _followed([F.col("segment")], "key"))
    return linked.groupBy("key").agg(F.bool_or("hit").alias("was_reopened"))


def flag_bugs(bugs: DataFrame, flags: DataFrame | None = None) -> DataFrame:
    """Bugs with `was_reopened`, False for those without a flag."""
    if flags is None:
        return bugs.withColumn("was_reopened", F.lit(False))
    return bugs.join(flags, "key", "left").withColumn("was_reopened", F.coalesce("was_reopened", F.lit(False)))


def reopen_share(flagged: DataFrame) -> DataFrame:
    """One row: bugs, reopened bugs, percentage."""
    return flagged.agg(
        F.count(F.lit(1)).alias("total_bugs"), F.count_if("was_reopened").alias("reopened_bugs")
    ).withColumn("reopened_percent", F.try_divide(F.col("reopened_bugs") * 100.0, F.col("total_bugs")))


def reopen_examples(flagged: DataFrame, n: int = 5) -> DataFrame:
    """The first n reopened bugs by key."""
    return (
        flagged.filter("was_reopened")
        .select("key", "summary", "priority_name", "status_name")
        .orderBy("key")
        .limit(n)
    )


def activity_counts(changelog: DataFrame, complete_status_only: bool = False) -> DataFrame:
    """Comment, attachment and status changes per issue, in one pass.

    `complete_status_only` counts only status changes with both states known.
    """
    status = F.col("field") == STATUS_FIELD
    if complete_status_only:
        status = status & F.col("fromString").isNotNull() & F.col("toString").isNotNull()
    wanted = changelog.filter(F.col("field").isin(COMMENT_FIELD, ATTACHMENT_FIELD, STATUS_FIELD))
    return wanted.groupBy("key").agg(
        F.count_if(F.col("field") == COMMENT_FIELD).alias("comment_count"),
        F.count_if(F.col("field") == ATTACHMENT_FIELD).alias("attachment_count"),
        F.count_if(status).alias("status_change_count"),
    )


def reopen_features(
    bugs: DataFrame,
    changelog: DataFrame | None = None,
    complete_status_only: bool = False,
    open_days: int | None = 0,
) -> DataFrame:
    """Bugs with project, text lengths, whole days to resolution, activity counts and joined text.

    `open_days` stands in for the days of unresolved bugs; None leaves them null.
    """
    counts = ["comment_count", "attachment_count", "status_change_count"]
    days = whole_days_between("created", "resolutiondate")
    text = [F.coalesce(F.col(name), F.lit("")) for name in ("summary", "description")]
    features = bugs.withColumns({
        "project": F.split("key", "-").getItem(0),
        "summary_length": F.coalesce(F.length("summary"), F.lit(0)),
        "description_length": F.coalesce(F.length("description"), F.lit(0)),
        "created_date": F.to_date("created"),
        "resolution_date": F.to_date("resolutiondate"),
        "resolution_time_days": days if open_days is None else F.coalesce(days, F.lit(open_days)),
        "text_content": F.concat_ws(" ", *text),
    })
    if changelog is None:
        return features.withColumns({name: F.lit(0).cast("bigint") for name in counts})
    return features.join(activity_counts(changelog, complete_status_only), "key", "left").fillna(0, subset=counts)


def reopen_profile(features: DataFrame) -> DataFrame:
    """Bug count and average features of reopened and other bugs."""
    return features.groupBy("was_reopened").agg(
        F.count(F.lit(1)).alias("bug_count"),
        F.avg("comment_count").alias("avg_comments"),
        F.avg("summary_length").alias("avg_summary_length"),
        F.avg("description_length").alias("avg_description_length"),
        F.avg("attachment_count").alias("avg_attachments"),
        F.avg("status_change_count").alias("avg_status_changes"),
        F.avg("resolution_time_days").alias("avg_resolution_days"),
    )
