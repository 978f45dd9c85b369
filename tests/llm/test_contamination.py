"""Benchmark matches against brute force."""

import hashlib
import re

from fixtures import documents, none_of, odd_documents, rows_of, SMALL
from pyspark.sql import functions as F

from ticketscope.llm import contamination


def plain_words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def plain_report(docs, items):
    windows = {}
    for item, text in items:
        w = plain_words(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        w = plain_words(text)
        hit, found = set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if owners := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= owners
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def compared(docs, items):
    plain = plain_report([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert rows_of(contamination.report(docs, items)) == plain
    return plain


def test_odd_rows(spark):
    docs = odd_documents(spark)
    texts = {r.doc_id: r.text for r in docs.collect()}
    longer, copy = texts[6].split(), texts[5].split()
    items = [(1, " ".join(longer[3:25]).upper()), (2, " ".join(longer[10:22])), (10, " ".join(longer[10:22])), (3, "Ünï ærø"), (4, None), (5, "..."),
             (6, texts[9]), (None, " ".join(copy[:12])), (7, "not in any document of these at all, surely not"), (8, "the the the")]
    plain = compared(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert sum(r[-1] for r in plain) >= 4


def test_given_tables(spark):
    plain = compared(documents(spark), spark.read.parquet(f"{SMALL}/benchmark.parquet"))
    assert any(r[-1] for r in plain)


def test_empty_tables(spark):
    docs, items = odd_documents(spark), spark.read.parquet(f"{SMALL}/benchmark.parquet")
    assert contamination.report(none_of(docs), items).count() == 0
    assert not any(r.contaminated for r in contamination.report(docs, none_of(items)).collect())


def test_only_clean_documents_stay(spark):
    docs, items = documents(spark), spark.read.parquet(f"{SMALL}/benchmark.parquet")
    plain = plain_report([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    kept = contamination.keep_clean(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r[0] for r in plain if not r[-1])


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x beta"), (2, "alpha beta"), (3, "beta alpha"), (4, "alpha y y y y beta")], "doc_id long, text string")
    items = spark.createDataFrame([(9, "alpha beta")], "item_id long, text string")
    key = {r.key: r.doc_id for r in docs.select("doc_id", contamination.text_key(docs.text).alias("key")).collect()}
    found = {(key[r.key], r["shift"]) for r in contamination.proximity_matches(docs, items, slop=2).collect()}
    assert {d for d, _ in found} == {1, 2, 3} and (2, 0) in found


def test_only_documents_with_candidates_are_shuffled(spark):
    """Under a join of many keys the text column passes the shuffle behind a semi-join of its keys."""
    docs = spark.createDataFrame([(i, f"one two three {i}") for i in range(20)] + [(99, "a b c d e f g h i j")], "doc_id long, text string")
    phrases = spark.createDataFrame([("a b c d e f g h i j",)], "phrase string")
    found = spark.createDataFrame([(docs.filter("doc_id = 99").select(contamination.text_key(docs.text)).first()[0], 0, 0)], "key binary, start int, shift int")
    found = found.crossJoin(phrases.select(F.xxhash64("phrase").alias("id")))
    matched = contamination.exact_matches(docs, found, phrases)
    assert "LeftSemi" in matched._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.start, r.width, r.phrase) for r in matched.collect()] == [(0, 10, "a b c d e f g h i j")]
