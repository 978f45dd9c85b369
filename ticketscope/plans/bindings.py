"""Issues, changes and comments as views of the given tables.

Each view reads its tables whole, needs no window, and joins on unique keys only. Remainders assign
categories; they never leave rows out.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def issue_key(number: Column) -> Column:
    project = F.floor(number / 10) % 20
    return F.concat(F.lit("P"), project.cast("string"), F.lit("-"), number.cast("string"))


def _one_of(value: Column, mapping: dict, default) -> Column:
    cases = F.when(F.lit(False), F.lit(default))
    for match, result in mapping.items():
        cases = cases.when(value == match, F.lit(result))
    return cases.otherwise(F.lit(default))


def _issue_type(number: Column) -> Column:
    return _one_of(number % 4, {0: "Task", 1: "Improvement"}, "Bug")


def issues(spark: SparkSession, sf_dir: str, text: bool = True) -> DataFrame:
    """One issue per order: its last shipment is the last update, and a document is its description.

    Without `text` the documents are not read.
    """
    number = F.col("o_orderkey")
    status = _one_of(F.col("o_orderstatus"), {"F": "Closed", "O": "Open"}, "In Progress")
    shipped = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("updated"))
    customers = table(spark, sf_dir, "customer").join(
        table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    df = (
        table(spark, sf_dir, "orders")
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(shipped, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    )
    if text:
        documents = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("description"))
        df = df.join(documents, F.col("o_orderkey") == F.col("doc_id"), "left")
    columns = [
        issue_key(number).alias("key"),
        _issue_type(number).alias("issuetype_name"),
        F.col("o_orderpriority").alias("priority_name"),
        status.alias("status_name"),
        F.col("n_name").alias("project_name"),
        F.concat_ws(" ", "c_mktsegment", F.lit("order"), "o_orderpriority", F.lit("from"), "n_name").alias("summary"),
        F.col("o_orderdate").alias("created"),
        F.col("updated"),
        F.when(F.col("o_orderstatus") != "O", F.col("updated")).alias("resolutiondate"),
    ]
    return df.select(*columns, *(["description"] if text else []))


def _event_issue() -> Column:
    return F.col("user_id") * 10 + F.dayofmonth("ts") % 10


def changelog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One change per event; three in five are status changes."""
    number = F.col("event_id")
    signup = F.when(number % 10 == 0, "Reopened").otherwise("To Do")
    to = F.when(F.col("event_type") == "signup", signup).otherwise(
        _one_of(F.col("event_type"), {"view": "In Progress", "click": "Open", "purchase": "Resolved"}, "Closed")
    )
    before = _one_of(
        number % 7, {0: "Resolved", 1: "CLOSED", 2: "Open", 3: "In Progress", 4: "Done", 5: None}, "To Do"
    )
    return table(spark, sf_dir, "events").select(
        number.alias("id"),
        issue_key(_event_issue()).alias("key"),
        F.col("ts").alias("created"),
        _one_of(number % 5, {3: "Comment", 4: "Attachment"}, "status").alias("field"),
        before.alias("fromString"),
        to.alias("toString"),
    )


def field_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as changes of as many fields as they have property values."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), issue_key(_event_issue()).alias("key"), F.col("props").alias("field")
    )


# Endings that bring conversations to each sentiment bucket and to its exact bounds.
COMMENT_ENDINGS = {
    0: " thank good great bug error",
    1: " broken crash",
    2: " works fixed <b>http://x.y</b>",
    3: " good nice great love bug",
    4: " bug crash stuck wrong good",
    5: " good nice bug error wrong",
}


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One comment per conversation turn."""
    ending = _one_of((F.col("conv_id") * 3 + F.col("turn")) % 7, COMMENT_ENDINGS, "")
    return table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("comment_id"),
        issue_key(F.col("conv_id")).alias("key"),
        F.concat("text", ending).alias("body"),
    )


# Shapes of time stamps in exports: format of the text, and the hours its clock is ahead of UTC.
TIME_SHAPES = {
    1: ("yyyy-MM-dd'T'HH:mm:ss.SSS'+0500'", 5),
    2: ("yyyy-MM-dd HH:mm", 0),
    3: ("yyyy-MM-dd", 0),
    4: ("yyyy-MM-dd'T'HH:mm:ss'-03:00'", -3),
    5: ("yyyy-MM-dd HH:mm:ss.SSSSSS'Z'", 0),
}


def shaped(time: Column, shape: Column) -> Column:
    """The time's clock reading as text in the shape of that number, plain for all others."""
    cases = F.when(F.lit(False), "")
    for number, (pattern, _) in TIME_SHAPES.items():
        cases = cases.when(shape == number, F.date_format(time, pattern))
    return cases.otherwise(F.date_format(time, "yyyy-MM-dd HH:mm:ss"))


def dated_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues whose creation and resolution are text, each in one of all the shapes."""
    number = F.regexp_extract("key", r"(\d+)$", 1).cast("long")
    return issues(spark, sf_dir, text=False).select(
        "key", shaped(F.col("created"), number % 6).alias("created"),
        shaped(F.col("resolutiondate"), F.floor(number / 6) % 6).alias("resolutiondate"),
    )


def raw_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An uncleaned export with one line per shipment: repeated keys, dotted names, gaps, two-digit years."""
    number = F.col("l_orderkey")
    started = F.col("l_shipdate") - F.make_dt_interval(days=F.col("l_quantity").cast("int"))
    shape = F.when(F.col("l_discount") == 0.0, F.date_format(started, "dd-MM-yy")).otherwise(
        shaped(started, F.col("l_linenumber"))
    )
    return table(spark, sf_dir, "lineitem").select(
        issue_key(number).alias("key"),
        _issue_type(number).alias("issuetype.name"),
        _one_of(F.col("l_returnflag"), {"A": "High", "N": "Low"}, None).alias("priority name"),
        _one_of(F.col("l_linestatus"), {"O": "Open"}, 'Closed, "done"\nfor good').alias("status.name"),
        shape.alias("created"),
        F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("updated"),
    )


def raw_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An uncleaned export with one line per order line: repeated ids and missing issue keys."""
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("comment_id"),
        F.when(F.col("l_returnflag") != "R", issue_key(F.col("l_orderkey"))).alias("key"),
        F.concat_ws(" ", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("comment_body"),
    )


def raw_changelog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two exports of all events one after the other; the second is a day younger."""
    events = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        issue_key(_event_issue()).alias("key"),
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("field"),
        F.col("props").alias("toString"),
        F.col("ts").alias("created"),
    )
    later = events.withColumns({
        "toString": F.concat(F.lit("later "), F.col("toString")),
        "created": F.col("created") + F.make_dt_interval(days=F.lit(1)),
    })
    return reduce(DataFrame.unionByName, [events, later])
