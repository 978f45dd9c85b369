"""Registered queries of the operators: each applies one to its whole table."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketscope.llm import chat, contamination, extraction, licenses, linededup, lm, mixing, periodic, quality, repair, repeats, simhash, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words the mix takes of it."""
    docs = mixing.counted(_table(spark, sf_dir, "documents"), ["doc_id", "source"])
    mixed = mixing.mix(docs, text=None, size="size")
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", "source")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests read back from every formatted conversation, and from one whose texts hold the template's own marks."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit(r"\### Assistant: </turn> ok")
    marks = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    return chat.digest(chat.formatted(turns.unionByName(marks)))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every license notice in every document, with its coverage and span."""
    return licenses.notices(_table(spark, sf_dir, "documents"))


def op4_extract_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    texts = extraction.extracted(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return texts.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model score of every document."""
    return lm.scores(_table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without lines that are similar to earlier ones."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.deduplicated(docs).select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document, by limits taken from the table."""
    docs = _table(spark, sf_dir, "documents")
    return quality.measure(docs, ["doc_id"], rules=quality.fitted(docs)).select("doc_id", "quality.*")


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the byte strings that occur twice."""
    return repeats.digest(_table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in every document."""
    return contamination.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_repair_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cost, edits and repaired rows of every conversation after planted damage."""
    return repair.digest(repair.damaged(_table(spark, sf_dir, "conversations")), "copies")


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    return toxicity.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in every document, a tenth of them with a planted one."""
    return periodic.digest(_table(spark, sf_dir, "documents"), settings=periodic.Settings(drill=True))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_chat_format": op2_chat_format,
    "op3_license_scan": op3_license_scan,
    "op4_extract_html": op4_extract_html,
    "op5_lm_score": op5_lm_score,
    "op6_line_dedup": op6_line_dedup,
    "op7_quality_rules": op7_quality_rules,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_decontaminate": op10_decontaminate,
    "op11_repair_structure": op11_repair_structure,
    "op12_toxicity": op12_toxicity,
    "op13_periodic_runs": op13_periodic_runs,
}
