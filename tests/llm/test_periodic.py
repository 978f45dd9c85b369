"""Runs against a search over all periods of every document, tiles at every place, odd rows."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
from fixtures import documents, none_of, odd_documents, rows_of
from hypothesis import given, settings
from hypothesis import strategies as st

from ticketscope.llm import periodic


def planted(doc_id, said):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(said)
    if doc_id is None or h % 10 or not n:
        return said
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [said[i] if i < a else said[a + (i - a) % p] for i in range(n)]


def plain_runs(said):
    """All maximal stretches by smallest period, from every period up to a quarter of the words."""
    ids = {w: i for i, w in enumerate(dict.fromkeys(said))}
    x, found = np.array([ids[w] for w in said]), {}
    for q in range(1, len(x) // 4 + 1):
        same = np.concatenate([[False], x[:-q] == x[q:], [False]]).astype(int)
        for a, b in zip(np.flatnonzero(np.diff(same) == 1), np.flatnonzero(np.diff(same) == -1)):
            if b - a + q >= max(6, 4 * q):
                found.setdefault((int(a), int(b - a + q)), q)
    return sorted((a, n, q) for (a, n), q in found.items())


def plain(doc_id, text, drill=True):
    said = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    said = planted(doc_id, said) if drill else said
    runs = plain_runs(said)
    runs.sort(key=lambda r: (r[0], r[2]))
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *((None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])),
            sha("".join(f"{a},{n},{q}\n" for a, n, q in runs)), sha(" ".join(w for i, w in enumerate(said) if i not in gone)))


DRILL = periodic.Settings(drill=True)


def test_given_table_and_odd_rows(spark):
    for docs in (documents(spark), odd_documents(spark)):
        for how in (DRILL, periodic.Settings()):
            want = sorted((plain(r.doc_id, r.text, how.drill) for r in docs.select("doc_id", "text").collect()), key=repr)
            assert rows_of(periodic.digest(docs, settings=how)) == want
    assert sum(r[1] for r in want) == 0 and any(plain(r.doc_id, r.text)[1] for r in documents(spark).collect())


def found_in(x):
    """Runs of one document by the operator's own steps, without Spark."""
    ids = np.array([hash(w) for w in x], np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    ends, pieces, octave, how = np.full(len(x), len(x)), {}, 0, periodic.Settings()
    while 4 << octave <= len(x):
        step = 2 << octave
        for at in periodic.anchored(ids, ends, octave, how).tolist():
            begin, end = max(0, at - step), min(len(x), at + 2 * step + periodic.window(octave, how))
            tile = np.unique(ids[begin:end], return_inverse=True)[1]
            for q, a, b in periodic.solved(tile, at - begin, octave):
                pieces.setdefault(q, []).append((a + begin, b + begin))
        octave += 1
    found = {}
    for q, parts in sorted(pieces.items()):
        joined = []
        for a, b in sorted(parts):
            if joined and a <= joined[-1][1] - q:
                joined[-1][1] = max(joined[-1][1], b)
            else:
                joined.append([a, b])
        for a, b in joined:
            if b - a >= max(6, 4 * q):
                found.setdefault((a, b - a), q)
    return sorted((a, n, q) for (a, n), q in found.items())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=40), st.integers(1, 12)), min_size=1, max_size=5))
def test_tiles_find_every_run(parts):
    x = [w for block, times in parts for w in block * times]
    assert found_in(x) == plain_runs(x)


def test_runs_at_every_place_and_length():
    rng = random.Random(3)
    for period in (*range(1, 20), 31, 32, 33, 100, 257):
        for length in {max(6, 4 * period), max(6, 4 * period) + 1, 5 * period + 2, 11 * period + 3}:
            before = rng.randrange(0, 3 * period + 5)
            block = list(range(period))
            x = [10_000 + i for i in range(before)] + [block[i % period] for i in range(length)] + [20_000 + i for i in range(7)]
            assert found_in(x) == [(before, length, period)]
            assert found_in(x[: before + max(6, 4 * period) - 1]) == []


def test_very_long_text_and_runs_as_rows(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}é" for i in range(5000)]
    block = [rng.choice(vocabulary) for _ in range(40_000)]
    texts = [" ".join(block * 5), " ".join(rng.choice(vocabulary) for _ in range(300_000)) + " a b\ta\nb a b a b", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert rows_of(periodic.runs(docs)) == [(0, 0, 200_000, 40_000), (1, 300_000, 8, 2)]


def test_empty(spark):
    assert periodic.digest(none_of(odd_documents(spark))).count() == 0
