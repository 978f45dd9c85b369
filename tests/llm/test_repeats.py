"""Removed bytes against brute force over all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from fixtures import documents, none_of, odd_documents, rows_of

from ticketscope.llm import repeats


def plain(rows, length):
    raws = [(i, (t or "").encode()) for i, t in rows]
    counts = Counter(r[s : s + length] for _, r in raws for s in range(len(r) - length + 1))
    out = []
    for i, r in raws:
        gone = np.zeros(len(r) + 1, bool)
        for s in range(len(r) - length + 1):
            if counts[r[s : s + length]] > 1:
                gone[s : s + length] = True
        rest = bytes(b for b, g in zip(r, gone) if not g)
        n_spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        out.append((i, len(r), len(r) - len(rest), n_spans, hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=repr)


def compared(docs, **settings):
    expected = plain([(r.doc_id, r.text) for r in docs.collect()], settings.get("length", 400))
    assert rows_of(repeats.digest(docs, **settings)) == expected
    return expected


def test_given_table(spark):
    assert sum(r[2] > 0 for r in compared(documents(spark))) > 10


@pytest.mark.parametrize("length, gram", [(400, 200), (400, 48), (60, 8), (20, 4), (8, 8)])
def test_odd_rows(spark, length, gram):
    assert any(r[2] for r in compared(odd_documents(spark), length=length, gram=gram, block=min(32, length // 2)))


def test_periods_overlaps_and_shared_passages(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("ab") for _ in range(n))
    shared, other = word(150), word(70)
    texts = ["a" * 200, "ab" * 90, word(37) * 6, "x" + "a" * 41, "a" * 40, "a" * 39, shared + word(30) + other, word(20) + shared[:60] + word(20) + shared[40:],
             other + other, word(300), "é" * 50, "x" + "é" * 30, shared, shared, *(word(25) + shared[20 + i : 130] + word(25) for i in range(30))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for length, gram, block, bits in ((40, 12, 8, 27), (40, 40, 32, 10), (12, 5, 4, 27), (40, 20, 7, 12)):
        compared(docs, length=length, gram=gram, block=block, bits=bits)


def test_hot_segments_meet_their_digest_in_place(spark, monkeypatch):
    """A passage in a third of all texts, some digests above the bound and some below it."""
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdef") for _ in range(n))
    hot, rare = word(300), word(200)
    texts = [word(80) + (hot if i % 3 == 0 else rare if i % 20 == 1 else "") + word(80) for i in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for bound in (1, 20, 10_000):
        monkeypatch.setattr(repeats, "HOT_SEGMENTS", bound)
        assert sum(r[2] > 0 for r in compared(docs, length=60, gram=20)) >= 40


def test_segments_agree_across_blocks(monkeypatch):
    data = np.random.default_rng(1).integers(0, 4, 5000).astype(np.uint8)
    whole = repeats.segments(data, 60, 10)
    monkeypatch.setattr(repeats, "_PLACE_BITS", 9)
    assert all((a == b).all() for a, b in zip(whole, repeats.segments(data, 60, 10)))


def test_empty(spark):
    assert repeats.digest(none_of(odd_documents(spark))).count() == 0


def test_other_columns_stay(spark):
    docs = odd_documents(spark)
    done = repeats.removed(docs, length=60, gram=8, block=10)
    assert done.columns == [*docs.columns, "repeats"] and done.count() == docs.count()
