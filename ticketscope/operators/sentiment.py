"""Lexicon sentiment of comments and its relation to resolution time."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketscope.constants import MIN_TEXT_LENGTH, NEGATIVE_PATTERNS, POSITIVE_PATTERNS
from ticketscope.functions.text import cleaned, count_present, sentiment_bucket, sentiment_rank, shortened
from ticketscope.functions.times import whole_days_between
from ticketscope.schemas import body_column


def clean_text(df: DataFrame, body: str | None = None) -> DataFrame:
    """Adds `cleaned_text` and keeps rows where more than MIN_TEXT_LENGTH characters of it are left.

    The text is generated from a one-element array rather than filtered afterwards: Spark would copy the
    replacements into a filter and run them twice.
    """
    long_enough = F.filter(F.array(cleaned(body or body_column(df))), lambda text: F.length(text) > MIN_TEXT_LENGTH)
    return df.select("*", F.explode(long_enough).alias("cleaned_text"))


def sentiment(df: DataFrame, text: str = "cleaned_text") -> DataFrame:
    """Adds `sentiment_score` in [-1, 1] (single precision) and its five-step `sentiment_category`.

    The score is (positive - negative) / (positive + negative) over the lexicon patterns found, 0 when none is.
    """
    def counts(lowered: Column) -> Column:
        return F.struct(
            count_present(lowered, POSITIVE_PATTERNS).alias("pos"), count_present(lowered, NEGATIVE_PATTERNS).alias("neg")
        )

    # Inside transform the text is worked out once, not once per pattern.
    found = F.transform(F.array(F.coalesce(F.lower(text), F.lit(""))), counts)
    pos, neg = F.col("_found.pos"), F.col("_found.neg")
    return (
        df.withColumn("_found", found.getItem(0))
        .withColumn("sentiment_score", F.coalesce(F.try_divide(pos - neg, pos + neg), F.lit(0.0)).cast("float"))
        .drop("_found")
        .withColumn("sentiment_category", sentiment_bucket("sentiment_score"))
    )


def sentiment_distribution(scored: DataFrame) -> DataFrame:
    """Comments per category, most negative first."""
    return (
        scored.groupBy("sentiment_category")
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(sentiment_rank("sentiment_category"))
    )


def sentiment_examples(scored: DataFrame, n: int = 2, key: str = "comment_id", body: str | None = None) -> DataFrame:
    """The first n comments of each category by key, long bodies cut.

    Each task keeps only its own first n per category before anything is shuffled.
    """
    first = Window.partitionBy("sentiment_category").orderBy(key)
    return (
        scored.select("sentiment_category", key, "sentiment_score", F.col(body or body_column(scored)).alias("text"))
        .withColumn("example", F.row_number().over(first))
        .filter(F.col("example") <= n)
        .withColumn("text", shortened("text"))
        .orderBy(sentiment_rank("sentiment_category"), "example")
    )


def sentiment_by_issue(scored: DataFrame) -> DataFrame:
    """Average score and comment count per issue."""
    return scored.groupBy("key").agg(
        F.avg("sentiment_score").alias("avg_sentiment"), F.count(F.lit(1)).alias("comment_count")
    )


def sentiment_vs_resolution(scored: DataFrame, issues: DataFrame) -> DataFrame:
    """Resolution days (0 or more) of issues by the category of their average sentiment."""
    days = issues.select("key", whole_days_between("created", "resolutiondate").alias("resolution_days")).filter(
        F.col("resolution_days").isNotNull() & (F.col("resolution_days") >= 0)
    )
    return (
        sentiment_by_issue(scored)
        .join(days, "key")
        .groupBy(sentiment_bucket("avg_sentiment").alias("sentiment_bucket"))
        .agg(
            F.count(F.lit(1)).alias("issue_count"),
            F.avg("resolution_days").alias("avg_resolution_days"),
            F.min("resolution_days").alias("min_resolution_days"),
            F.max("resolution_days").alias("max_resolution_days"),
        )
        .orderBy(sentiment_rank("sentiment_bucket"))
    )
