import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ticketscope.constants import REOPEN_WORDS, RESOLUTION_WORDS
from ticketscope.operators.reopening import flag_bugs, reopen_features, reopen_flags, reopen_share
from ticketscope.operators.sampling import balanced_sample
from ticketscope.schemas import CHANGELOG, ISSUES

START = datetime(2020, 1, 1)
STATES = ["Open", "In Progress", "Resolved", "CLOSED", "To Do", "Done", "Waiting", "Reopened by QA", None]


def change(number, key, source, to, minutes=None, field="status"):
    at = START + timedelta(minutes=number if minutes is None else minutes)
    return (number, key, field, source, to, at)


def expected_flags(changes):
    """The definition, history by history."""
    histories = {}
    for number, key, field, source, to, at in changes:
        if field == "status" and source is not None and to is not None:
            histories.setdefault(key, []).append((at, number, source.lower(), to.lower()))
    flags = {}
    for key, history in histories.items():
        history.sort()
        pair = any(
            any(w in a[3] for w in RESOLUTION_WORDS)
            and any(w in b[2] for w in RESOLUTION_WORDS)
            and any(w in b[3] for w in REOPEN_WORDS)
            for a, b in zip(history, history[1:])
        )
        flags[key] = pair or any(step[3] == "reopened" for step in history)
    return flags


def flags_of(spark, changes, **options):
    df = reopen_flags(spark.createDataFrame(changes, CHANGELOG), **options)
    rows = df.collect()
    assert len(rows) == len({row["key"] for row in rows})
    return {row["key"]: row["was_reopened"] for row in rows}


CASES = {
    "resolved then open": ([("Open", "Resolved"), ("Resolved", "Open")], True),
    "resolved and left later": ([("Open", "Resolved"), ("Open", "In Review"), ("Resolved", "Open")], False),
    "never resolved": ([("Open", "In Progress"), ("In Progress", "Open")], False),
    "direct": ([("Closed", "REOPENED")], True),
    "direct needs the exact word": ([("Closed", "Reopened by QA")], False),
    "words inside names": ([("X", "Closed as done"), ("Closed as done", "Really in progress")], True),
    "unknown source state is left out": ([("Open", "Closed"), (None, "Waiting"), ("Closed", "Open")], True),
}


@pytest.mark.parametrize("unit", ["minute", "day"])
def test_patterns(spark, unit):
    changes, number = [], 0
    for name, (steps, _) in CASES.items():
        for source, to in steps:
            number += 1
            changes.append(change(number, name, source, to))
    assert flags_of(spark, changes, unit=unit) == {name: flag for name, (_, flag) in CASES.items()}


@pytest.mark.parametrize("unit", ["minute", "day"])
def test_order_is_time_then_id(spark, unit):
    steps = [
        change(2, "late arrival", "Resolved", "Open", minutes=5),
        change(1, "late arrival", "Open", "Resolved", minutes=9),
        change(4, "same minute", "Resolved", "Open", minutes=5),
        change(3, "same minute", "Open", "Resolved", minutes=5),
    ]
    assert flags_of(spark, steps, unit=unit) == {"late arrival": False, "same minute": True}


@pytest.mark.parametrize("seed", [1, 2])
def test_one_issue_with_a_third_of_all_changes(spark, seed):
    """Random histories; the long one is cut into segments, so pairs at segment borders count too."""
    draw = random.Random(seed)
    keys = ["hot"] * 2000 + [f"P-{draw.randrange(600)}" for _ in range(4000)]
    draw.shuffle(keys)
    changes = [
        change(n, key, draw.choice(STATES), draw.choice(STATES), minutes=draw.randrange(3000),
               field=draw.choice(["status", "status", "Comment"]))
        for n, key in enumerate(keys)
    ]
    wanted = expected_flags(changes)
    assert flags_of(spark, changes) == wanted
    assert flags_of(spark, changes, unit="hour") == wanted
    assert flags_of(spark, changes, unit="minute") == wanted


def test_single_pair_in_a_long_history_is_found_wherever_it_is(spark):
    """Exactly one pair per issue, at every place of the history, so every segment border is met."""
    changes, number = [], 0
    for place in range(0, 60):
        for step in range(61):
            number += 1
            steps = {place: ("Waiting", "Resolved"), place + 1: ("Resolved", "Open")}
            source, to = steps.get(step, ("Waiting", "Waiting"))
            changes.append(change(number, f"P-{place}", source, to, minutes=step))
    flags = flags_of(spark, changes, unit="minute")
    assert len(flags) == 60 and all(flags.values())


def issue(key, days=None, summary="a title", description=None, kind="Bug"):
    done = None if days is None else START + timedelta(days=days)
    return (key, kind, "High", "Open", "Alpha", summary, description, START, START, done)


def test_features(spark):
    bugs = spark.createDataFrame(
        [issue("AB-1", 3, "four", "five5"), issue("AB-2", None, None), issue("CD-3", -2)], ISSUES
    )
    changes = spark.createDataFrame(
        [change(1, "AB-1", None, "x"), change(2, "AB-1", "x", "y"), change(3, "AB-1", None, None, field="Comment"),
         change(4, "CD-3", None, None, field="Attachment"), change(5, "CD-3", "a", "b", field="assignee")], CHANGELOG,
    )
    flagged = flag_bugs(bugs, reopen_flags(changes))
    rows = {row["key"]: row for row in reopen_features(flagged, changes).collect()}
    first, second, third = rows["AB-1"], rows["AB-2"], rows["CD-3"]
    assert (first["project"], first["summary_length"], first["description_length"]) == ("AB", 4, 5)
    assert (first["status_change_count"], first["comment_count"], first["attachment_count"]) == (2, 1, 0)
    assert (first["resolution_time_days"], first["text_content"]) == (3, "four five5")
    assert (second["summary_length"], second["resolution_time_days"], second["text_content"]) == (0, 0, " ")
    assert (second["comment_count"], second["was_reopened"]) == (0, False)
    assert (third["attachment_count"], third["resolution_time_days"]) == (1, -2)

    strict = reopen_features(flagged, changes, complete_status_only=True, open_days=None)
    rows = {row["key"]: row for row in strict.collect()}
    assert rows["AB-1"]["status_change_count"] == 1
    assert rows["AB-2"]["resolution_time_days"] is None

    bare = reopen_features(flag_bugs(bugs)).first()
    assert (bare["was_reopened"], bare["comment_count"]) == (False, 0)


def test_share_of_no_bugs_is_null(spark):
    empty = spark.createDataFrame([], "key string, was_reopened boolean")
    assert reopen_share(empty).first()["reopened_percent"] is None


def test_balanced_sample_keeps_positives_and_about_three_negatives_each(spark):
    rows = spark.range(20000).select(F.col("id").cast("string").alias("key"), (F.col("id") < 1000).alias("was_reopened"))
    counts = {r["was_reopened"]: r["count"] for r in balanced_sample(rows).groupBy("was_reopened").count().collect()}
    assert counts[True] == 1000
    assert 2800 < counts[False] < 3200


def test_balanced_sample_without_negatives(spark):
    rows = spark.createDataFrame([("a", True), ("b", True)], "key string, was_reopened boolean")
    assert balanced_sample(rows).count() == 2
