"""From raw documents to a training mix: quality, lines, near-duplicates, benchmark passages, source weights.

Every stage takes all that its predecessor kept. The first four return the columns of `documents`; the last one returns
one row for each copy that the mix takes, with the copy's number and the document's size, source_size, target, copies
and taken words. Line dedup rewrites texts, so it counts `n_chars` anew. No stage crashes on nulls, empty or very long
texts, repeated rows, an empty table or further columns; each operator's docstring says what it does with them.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketscope.llm import contamination, linededup, mixing, quality, simhash
from ticketscope.llm.storage import scratch, stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents inside the word rules and the compression limits taken from all documents."""
    return quality.keep_good(docs, rules=quality.fitted(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines similar to earlier ones; a document that loses all its words goes."""
    kept = linededup.keep_unique(docs)
    if "n_chars" not in docs.columns:
        return kept
    return kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id."""
    return simhash.keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of the benchmark."""
    return contamination.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as it is taken."""
    mixed = mixing.mix(docs).filter("copies > 0")
    return mixed.select("*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("mix_sources", mix_sources),
]

# Compression, 64-bit shingle hashes and random rounding have no SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole `documents` table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch(spark):
        for name, stage in STAGES[:-1]:
            docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        name, stage = STAGES[-1]
        return stored(stage(spark, docs, sf_dir), f"pipeline-{name}", result=True)
