import random

import pytest
from pyspark.sql import functions as F

from ticketscope.constants import NEGATIVE_PATTERNS, POSITIVE_PATTERNS
from ticketscope.functions.text import shortened, tokens
from ticketscope.operators.sentiment import (
    clean_text, sentiment, sentiment_by_issue, sentiment_distribution, sentiment_examples, sentiment_vs_resolution,
)

CLEANED = {
    "<b>Hello</b> WORLD, see http://a.b/c?d=1 now": "hello world  see  now",
    "line one\nline\ttwo 12345": "line one\nline\ttwo      ",
    "Größe überall schön genug": "gr  e  berall sch n genug",
}


def test_cleaning(spark):
    df = spark.createDataFrame([(text,) for text in [*CLEANED, "too short!", "1234567890", None]], "body string")
    assert {row["body"]: row["cleaned_text"] for row in clean_text(df).collect()} == CLEANED


def test_eleven_characters_are_enough(spark):
    df = spark.createDataFrame([("abcdefghij",), ("abcdefghijk",)], "text string")
    assert [row["text"] for row in clean_text(df).collect()] == ["abcdefghijk"]


SCORES = [
    ("thank good great bug error", 0.2, "Positive"),  # 3:2, just above the bound in single precision
    ("good nice bug error wrong", -0.2, "Negative"),
    ("good nice great love bug", 0.6, "Very Positive"),
    ("bug crash stuck wrong good", -0.6, "Very Negative"),
    ("nothing to see", 0.0, "Neutral"),
    ("good bug", 0.0, "Neutral"),
    ("BROKEN", -1.0, "Very Negative"),
    ("appreciated", 1.0, "Very Positive"),
    ("failed", -1.0, "Very Negative"),
    ("good good good bug", 0.0, "Neutral"),
    (None, 0.0, "Neutral"),
]


@pytest.mark.parametrize("text,score,category", SCORES)
def test_scores(spark, text, score, category):
    row = sentiment(spark.createDataFrame([(text,)], "cleaned_text string")).first()
    assert row["sentiment_score"] == pytest.approx(score, abs=1e-7)
    assert row["sentiment_category"] == category


def test_random_texts_against_counting(spark):
    draw = random.Random(7)
    words = POSITIVE_PATTERNS + NEGATIVE_PATTERNS + ["plain", "words"] * 10
    texts = [" ".join(draw.choices(words, k=draw.randrange(1, 9))) for _ in range(300)]
    rows = sentiment(spark.createDataFrame([(text,) for text in texts], "cleaned_text string")).collect()
    for row in rows:
        pos = sum(p in row["cleaned_text"] for p in POSITIVE_PATTERNS)
        neg = sum(p in row["cleaned_text"] for p in NEGATIVE_PATTERNS)
        assert row["sentiment_score"] == pytest.approx((pos - neg) / (pos + neg) if pos + neg else 0.0, abs=1e-7)


@pytest.fixture
def scored(spark):
    rows = [("3", "A-1", "great " + "x" * 120), ("1", "A-1", "good work"), ("2", "A-1", "all fixed now"), ("4", "A-2", "a crash here")]
    return sentiment(clean_text(spark.createDataFrame(rows, "comment_id string, key string, body string"))
                     .unionByName(spark.createDataFrame([("1", "A-1", "good work", "good work")],
                                                        "comment_id string, key string, body string, cleaned_text string")))


def test_reports(spark, scored):
    assert [tuple(row) for row in sentiment_distribution(scored).collect()] == [("Very Negative", 1), ("Very Positive", 3)]
    examples = [(row["sentiment_category"], row["comment_id"]) for row in sentiment_examples(scored).collect()]
    assert examples == [("Very Negative", "4"), ("Very Positive", "1"), ("Very Positive", "2")]
    by_issue = {row["key"]: (row["avg_sentiment"], row["comment_count"]) for row in sentiment_by_issue(scored).collect()}
    assert by_issue == {"A-1": (1.0, 3), "A-2": (-1.0, 1)}


def test_resolution_leaves_out_open_and_negative(spark, scored):
    issues = spark.createDataFrame(
        [("A-1", "2020-01-01", "2020-01-05"), ("A-2", "2020-01-05", "2020-01-01"), ("A-3", "2020-01-01", "2020-01-02")],
        "key string, created string, resolutiondate string",
    )
    rows = sentiment_vs_resolution(scored, issues).collect()
    assert [tuple(row) for row in rows] == [("Very Positive", 1, 4.0, 4, 4)]
    assert sentiment_vs_resolution(scored, issues.withColumn("resolutiondate", F.lit(None).cast("string"))).count() == 0


def test_shortened(spark):
    row = spark.range(1).select(
        shortened(F.lit("a" * 100)).alias("fits"), shortened(F.lit("a" * 101)).alias("cut"), tokens(F.lit(" A  b\nC ")).alias("t")
    ).first()
    assert (row["fits"], row["cut"], row["t"]) == ("a" * 100, "a" * 97 + "...", ["a", "b", "c"])


def test_text_is_cleaned_once(spark):
    """The replacements appear once in the plan, not again in a filter."""
    df = spark.createDataFrame([("some longer text",)], "body string").repartition(2)
    plan = sentiment_distribution(sentiment(clean_text(df)))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("<[^>]+>") == 1
