from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ticketscope.functions.hashing import CLUSTERS
from ticketscope.functions.times import as_timestamp
from ticketscope.operators.cleaning import (
    clean_changelog, clean_comments, clean_issues, latest_per_key, load_bugs, normalise_columns,
)
from ticketscope.operators.resolution import (
    recent_resolution, resolution_by_priority_status, resolution_hours, slow_labels, top_changed_fields,
)
from ticketscope.operators.sampling import balanced_sample, hash_sample
from ticketscope.schemas import body_column, raw_schema
from ticketscope.sources import (
    ingest_csv, publish, published, read_csv, read_parquet, read_published, shared_path, write_cleaned, write_report,
)

RAW = ["key", "issuetype.name", "priority name", "status.name", "created", "updated", "resolutiondate"]


def raw_issue(key="A-1", created="2020-01-01 00:00:00", updated="2020-01-03 12:00:00", priority="High", resolved=None):
    return (key, "Bug", priority, "Open", created, updated, resolved)


def raw(spark, *rows):
    return spark.createDataFrame(rows, ", ".join(f"`{name}` string" for name in RAW))


def test_names(spark):
    df = spark.createDataFrame([(1, 2)], ["a.b c", "d"])
    assert normalise_columns(df).columns == ["a_b_c", "d"]
    with pytest.raises(ValueError, match="collide"):
        normalise_columns(spark.createDataFrame([(1, 2)], ["a.b", "a b"]))


def test_issue_cleaning(spark):
    df = clean_issues(raw(
        spark,
        raw_issue("A-1", updated="2020-01-02 00:00:00"),
        raw_issue("A-1", updated="2020-01-05 00:00:00", priority="Low"),
        raw_issue("A-1", updated="31-12-99 00:00", priority="Old"),
        raw_issue("A-2", created="12-09-17 10:00"),
        raw_issue("A-3", priority=None),
        raw_issue("A-4", created="2020-01-01T10:11:12.345+0000", resolved="no date"),
        raw_issue(None),
    ))
    rows = {row["key"]: row for row in df.collect()}
    assert set(rows) == {"A-1", "A-4"}
    assert (rows["A-1"]["priority_name"], rows["A-1"]["updated"]) == ("Low", datetime(2020, 1, 5))
    assert rows["A-4"]["created"] == datetime(2020, 1, 1, 10, 11, 12, 345000)
    assert rows["A-4"]["resolutiondate"] is None


def test_survivor_does_not_depend_on_row_order(spark):
    rows = [("k", n % 7, f"v{n}") for n in range(50)] + [("other", 1, "x")]
    columns = "key string, n int, v string"
    forward = latest_per_key(spark.createDataFrame(rows, columns), "key").collect()
    backward = latest_per_key(spark.createDataFrame(rows[::-1], columns), "key").collect()
    assert sorted(forward) == sorted(backward) and len(forward) == 2


def test_comments_and_changelog(spark):
    comments = spark.createDataFrame(
        [("1", "A-1", "x"), ("1", "A-1", "x"), ("2", None, "y"), (None, "A-1", "z")],
        "comment_id string, key string, body string",
    )
    assert [row["comment_id"] for row in clean_comments(comments).collect()] == ["1"]
    changes = spark.createDataFrame(
        [("1", "A-1", "status", "2020-01-01 00:00:00"), ("2", "A-1", None, None), ("3", "A-1", "x", "junk")],
        "id string, key string, field string, created string",
    )
    rows = {row["id"]: row["created"] for row in clean_changelog(changes).collect()}
    assert rows == {"1": datetime(2020, 1, 1), "3": None}


def test_body_column(spark):
    assert body_column(spark.createDataFrame([("a", "b")], ["text", "body"])) == "body"
    with pytest.raises(ValueError, match="body column"):
        body_column(spark.createDataFrame([("a",)], ["note"]))


def test_csv_with_quotes_and_line_breaks(spark, tmp_path):
    (tmp_path / "issues.csv").write_text(
        'key,issuetype.name,priority name,status.name,created,updated,summary\n'
        'A-1,Bug,High,Open,2020-01-01 00:00:00,2020-01-02 00:00:00,"says ""no"",\nthen stops"\n'
        'A-1,Bug,Low,Open,2020-01-01 00:00:00,2020-01-01 00:00:00,older\n'
    )
    (tmp_path / "comments.csv").write_text("comment_id,key,body\n1,A-1,hello\n")
    (tmp_path / "changelog.csv").write_text("id,key,field\n1,A-1,status\n,A-1,status\n")
    paths = ingest_csv(spark, str(tmp_path), str(tmp_path / "out"))
    row = read_parquet(spark, paths["issues"]).first()
    assert (row["key"], row["priority_name"], row["summary"]) == ("A-1", "High", 'says "no",\nthen stops')
    assert row["created"] == datetime(2020, 1, 1)
    assert read_parquet(spark, paths["changelog"], ["id"]).collect()[0].asDict() == {"id": "1"}
    assert read_parquet(spark, paths["comments"]).count() == 1


def test_ingest_by_schema(spark, tmp_path):
    (tmp_path / "comments.csv").write_text("comment_id,key,body\n1,A-1,hello\n")
    (tmp_path / "changelog.csv").write_text("id,key,field,fromString,toString,created\n1,A-1,status,Open,Done,2020-01-02\n")
    schemas = {t: raw_schema(t) for t in ("comments", "changelog")}
    paths = ingest_csv(spark, str(tmp_path), str(tmp_path / "out"), tuple(schemas), schemas=schemas)
    assert read_parquet(spark, paths["changelog"]).first()["created"] == datetime(2020, 1, 2)
    assert raw_schema("changelog", without=("created",)).names == ["id", "key", "field", "fromString", "toString"]
    with pytest.raises(Exception, match="(?i)header"):
        swapped = StructType(raw_schema("comments").fields[::-1])
        ingest_csv(spark, str(tmp_path), str(tmp_path / "again"), ("comments",), schemas={"comments": swapped})


def test_missing_columns_are_named_before_anything_is_written(spark, tmp_path):
    (tmp_path / "comments.csv").write_text("comment_id,key,body\n1,A-1,hello\n")
    (tmp_path / "issues.csv").write_text("key,created,updated,status.name\nA-1,2020-01-01,2020-01-02,Open\n")
    with pytest.raises(ValueError, match=r"issues lacks the columns \['priority_name', 'issuetype_name'\]"):
        ingest_csv(spark, str(tmp_path), str(tmp_path / "out"), ("comments", "issues"))
    assert not (tmp_path / "out").exists()


def test_reports_appear_together(spark, tmp_path):
    """The second of three writes dies; a reader keeps the former set."""
    out = str(tmp_path)
    report = lambda value: lambda path: write_report(spark.sql(f"select '{value}' as v"), path)
    seen = lambda: {n: r.first()["v"] for n, r in read_published(spark, out, read_csv).items()}
    first = publish(spark, out, {n: report(f"old {n}") for n in "abc"})
    assert published(spark, out) == first and seen() == {n: f"old {n}" for n in "abc"}

    def dies(path):
        write_report(spark.sql("select 'half' as v"), path)
        raise OSError("disk full")

    with pytest.raises(OSError, match="disk full"):
        publish(spark, out, {"a": report("new a"), "b": dies, "c": report("new c")})
    assert published(spark, out) == first and seen() == {n: f"old {n}" for n in "abc"}
    publish(spark, out, {"a": report("new a"), "b": report("new b")})
    assert seen() == {"a": "new a", "b": "new b"}
    assert read_csv(spark, first["c"]).first()["v"] == "old c"


def test_chosen_time_is_not_parsed_twice(spark):
    plan = clean_issues(raw(spark, raw_issue()))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("try_cast") <= 3 and "__newest" not in clean_issues(raw(spark, raw_issue())).columns


def test_parquet_is_partitioned_on_request(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "p string, v int")
    write_cleaned(df, str(tmp_path / "t"), ["p"])
    assert {path.name for path in (tmp_path / "t").iterdir() if path.is_dir()} == {"p=a", "p=b"}


def test_report_is_one_ordered_file(spark, tmp_path):
    df = spark.range(50).repartition(8).selectExpr("id", "'x, \"y\"' as t")
    write_report(df, str(tmp_path / "r"), ["id"])
    files = list((tmp_path / "r").glob("*.csv"))
    assert len(files) == 1
    lines = files[0].read_text().splitlines()
    assert lines[0] == "id,t" and [int(line.split(",")[0]) for line in lines[1:]] == list(range(50))
    assert read_csv(spark, str(tmp_path / "r")).first()["t"] == 'x, "y"'


def test_long_report_is_written_whole_in_parts(spark, tmp_path):
    write_report(spark.range(100).repartition(4), str(tmp_path / "r"), single_file=False)
    assert len(list((tmp_path / "r").glob("*.csv"))) == 4
    assert read_csv(spark, str(tmp_path / "r")).count() == 100


def test_resolution_reports(spark):
    issues = clean_issues(raw(
        spark,
        raw_issue("A-1"), raw_issue("A-2", created="2017-12-31 00:00:00"), raw_issue("A-3", created="2018-01-02 00:00:00"),
    ))
    recent = recent_resolution(issues, "2020-01-02").select("key", "resolution_days").collect()
    assert {row["key"]: row["resolution_days"] for row in recent} == {"A-1": 2.5, "A-3": 731.5}
    assert recent_resolution(issues).count() == 0
    averages = resolution_by_priority_status(recent_resolution(issues, "2020-01-02")).collect()
    assert [tuple(row) for row in averages] == [("High", "Open", 367.0)]


def test_top_fields_break_ties_by_name(spark):
    rows = [(n, "A-1" if n < 3 else "A-2", field) for n, field in enumerate(["b", "b", "a", "a", "c"])]
    top = top_changed_fields(spark.createDataFrame(rows, "id int, key string, field string"), 2).collect()
    assert [tuple(row) for row in top] == [("a", 2, 2), ("b", 2, 1)]


def test_slow_labels(spark):
    issues = clean_issues(raw(
        spark,
        raw_issue("A-1", resolved="2020-01-01 10:00:00"), raw_issue("A-2", resolved="2020-01-01 20:00:00"), raw_issue("A-3"),
    ))
    rows = {row["key"]: (row["resolution_hours"], row["label"]) for row in slow_labels(issues).collect()}
    assert rows == {"A-1": (10.0, 0), "A-2": (20.0, 1)}


def test_bug_sample_takes_its_changes_along(spark):
    issues = spark.range(2000).selectExpr(
        "concat('P-', id) as key", "case when id % 2 = 0 then 'Bug' else 'Task' end as issuetype_name"
    )
    changes = spark.range(6000).selectExpr("id", "concat('P-', id % 2000) as key")
    bugs, kept = load_bugs(issues, changes, 0.5)
    keys = {row["key"] for row in bugs.collect()}
    assert 400 < len(keys) < 600
    assert {row["key"] for row in kept.collect()} == keys and kept.count() == 3 * len(keys)
    everything, untouched = load_bugs(issues, changes)
    assert everything.count() == 1000 and untouched is changes


def test_changes_of_a_hot_key_are_all_kept(spark):
    """One bug holds a third of all changes."""
    issues = spark.range(300).selectExpr("concat('P-', id) as key", "'Bug' as issuetype_name")
    changes = spark.range(3000).selectExpr("id", "case when id % 3 = 0 then 'P-7' else concat('P-', id % 600) end as key")
    bugs, kept = load_bugs(issues, changes, 0.99)
    wanted = {row["key"] for row in bugs.collect()}
    assert "P-7" in wanted and kept.count() == changes.filter(F.col("key").isin(wanted)).count()


def test_samples_of_samples_are_fresh_choices(spark):
    """Balancing and clustering a sample choose as they do on all rows."""
    rows = spark.range(100_000).selectExpr("concat('P-', id) as key", "'Bug' as issuetype_name", "id % 50 = 0 as was_reopened")
    for fraction in (0.02, 0.1, 1.0):
        bugs, _ = load_bugs(rows, None, fraction)
        counts = {r["was_reopened"]: r["count"] for r in balanced_sample(bugs).groupBy("was_reopened").count().collect()}
        assert 3 * counts[True] == pytest.approx(counts[False], rel=0.25 if fraction < 0.1 else 0.1)
        share = hash_sample(bugs, "key", 0.3, CLUSTERS).count() / bugs.count()
        assert share == pytest.approx(0.3, rel=0.1)


SHAPES = {
    "2020-01-01T12:00:00.000+0500": datetime(2020, 1, 1, 7), "2020-01-01 12:00:00-03:30": datetime(2020, 1, 1, 15, 30),
    "2020-01-01 10:00": datetime(2020, 1, 1, 10), "2020-01-01": datetime(2020, 1, 1), "2020-01-01T10:00:00Z": datetime(2020, 1, 1, 10),
    "2020-01-01T10:00:01.25": datetime(2020, 1, 1, 10, 0, 1, 250000), "2020-01-01 10:00:00+05": datetime(2020, 1, 1, 5),
    " 2020-01-01 10:00:00 ": datetime(2020, 1, 1, 10), "10:00": None, "no date": None, "01-02-20": None, "2020-13-01": None, "": None, None: None,
}


def test_time_stamps_are_read_whole(spark):
    df = spark.createDataFrame([(t,) for t in SHAPES], "t string")
    assert {r["t"]: r["x"] for r in df.select("t", as_timestamp(df, "t").alias("x")).collect()} == SHAPES


def test_hours_between_offsets(spark):
    row = ("A-1", "2020-01-01T10:00:00.000+0000", "2020-01-01T12:00:00.000+0500")
    assert resolution_hours(spark.createDataFrame([row], "key string, created string, resolutiondate string")).first()["resolution_hours"] == -3.0


def test_files_with_another_column_order_are_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,key\n1,A-1\n")
    (tmp_path / "b.csv").write_text("key,id\nB-1,2\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_csv(spark, str(tmp_path)).collect()
    (tmp_path / "b.csv").write_text("id,key\n2,B-1\n")
    assert sorted(r["key"] for r in read_csv(spark, str(tmp_path)).collect()) == ["A-1", "B-1"]


def test_shared_paths_are_fresh(spark):
    assert shared_path(spark, "x") != shared_path(spark, "x")
