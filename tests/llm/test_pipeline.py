"""Every stage of the pipeline on its own input, and the whole of it, against brute force."""

from collections import Counter

import zstandard
from fixtures import SMALL, documents, none_of, odd_documents
from pyspark.sql import functions as F
from test_contamination import plain_report
from test_linededup import plain as plain_lines
from test_simhash import plain_components

import corpus_pipeline
from ticketscope.llm import linededup, quality


def expected_stage(name, rows, docs, spark):
    """Sorted (doc_id, text) that the stage must keep."""
    if name == "quality_rules":
        compressor = zstandard.ZstdCompressor(level=3)
        rules = quality.fitted(docs)
        assert rules.limits
        kept = [(i, t) for i, t in rows if quality.judged(t, rules, compressor)["kept"]]
    elif name == "line_dedup":
        done = plain_lines(docs, linededup.Settings())
        kept = [(i, done[i, t]) for i, t in rows if done[i, t] == t or (done[i, t] or "").encode().split()]
    elif name == "simhash_near_dedup":
        labels = {i: c for i, _, c in plain_components(rows)}
        kept = [(i, t) for i, t in rows if labels[i] == i]
    elif name == "decontamination":
        items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
        clean = {r[0] for r in plain_report(rows, items) if not r[-1]}
        kept = [(i, t) for i, t in rows if i in clean]
    return sorted(kept, key=repr)


def with_a_rewrapped_copy(docs):
    """The table and a copy of one document with the same words on other lines: no line is alike, every shingle is."""
    rows = docs.collect()
    long = [r for r in rows if r.lang == "en" and 300 < len(r.text.split()) < 3000 and "###" not in r.text and "|" not in r.text]
    chosen = max(long, key=lambda r: (len(set(r.text.split())) / len(r.text.split()), r.doc_id))
    words = chosen.text.split()
    text = "\n".join(" ".join(words[i : i + 37]) for i in range(0, len(words), 37))
    copy = chosen.asDict() | {"doc_id": max(r.doc_id for r in rows) + 1, "text": text, "n_chars": len(text)}
    return docs.unionByName(docs.sparkSession.createDataFrame([tuple(copy[c] for c in docs.columns)], docs.schema))


def test_stages_and_whole(spark):
    docs = with_a_rewrapped_copy(documents(spark))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        done = stage(spark, docs, SMALL)
        assert done.columns == docs.columns
        found = done.collect()
        assert sorted(((r.doc_id, r.text) for r in found), key=repr) == expected_stage(name, rows, docs, spark), name
        assert all(r.n_chars == len(r.text) for r in found)
        assert 0 < len(found) < len(rows), name
        docs = spark.createDataFrame(found, docs.schema)
    kept = spark.createDataFrame(documents(spark).collect(), documents(spark).schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SMALL)
    docs = kept.persist()
    whole = corpus_pipeline.run(spark, SMALL).collect()
    times = Counter(r.doc_id for r in whole)
    assert {r.doc_id for r in whole} <= {r.doc_id for r in docs.collect()}
    assert all(times[r.doc_id] == r.copies and r.taken == r.copies * r.size == r.copies * len(r.text.encode().split()) and 1 <= r.copy <= r.copies <= 3 for r in whole)
    assert {(r.doc_id, r.text) for r in whole} <= {(r.doc_id, r.text) for r in docs.collect()}


def test_odd_and_empty_rows(spark):
    for name, stage in corpus_pipeline.STAGES:
        docs = odd_documents(spark)
        assert stage(spark, docs, SMALL).count() <= 3 * docs.count(), name
        assert stage(spark, none_of(docs), SMALL).count() == 0, name
        assert set(docs.columns) <= set(stage(spark, docs.withColumn("extra", F.lit(1)), SMALL).columns), name


def test_registered(spark):
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash_near_dedup", "decontamination", "mix_sources"]
