"""Removed lines against brute force over all pairs of lines."""

import random

import numpy as np
import pytest
from fixtures import documents, none_of, odd_documents, prose
from pyspark.sql import functions as F

from ticketscope.llm import linededup
from ticketscope.llm.linededup import Settings


def words(line):
    return frozenset(line.encode().lower().split())


def plain(docs, settings):
    """Kept text by (id, text); lines in the order of the operator."""
    rows = {(r.doc_id, r.text) for r in docs.collect()}
    lines = [((i is None, i or 0), n, line, (i, t)) for i, t in rows for n, line in enumerate((t or "").split("\n")) if len(words(line)) >= settings.min_words]
    first = {}
    for order, n, line, owner in lines:
        first[words(line)] = min(first.get(words(line), ((True, 1 << 70), 0)), (order, n))
    kinds = sorted(first, key=lambda w: first[w])
    gone = {w for k, w in enumerate(kinds) if any(len(w & x) >= settings.threshold * len(w | x) - 1e-9 for x in kinds[:k])}
    out = {}
    for i, t in rows:
        if t is None:
            out[i, t] = None
            continue
        kept = [line for n, line in enumerate(t.split("\n")) if len(words(line)) < settings.min_words or (words(line) not in gone and first[words(line)] == ((i is None, i or 0), n))]
        out[i, t] = "\n".join(kept)
    return out


def compared(docs, settings=Settings()):
    expected = plain(docs, settings)
    tagged = docs.withColumn("was", F.col("text"))
    done = linededup.deduplicated(tagged, settings=settings).collect()
    assert len(done) == docs.count()
    for r in done:
        assert r.text == expected[r.doc_id, r.was], (r.doc_id, r.n_removed)
        assert r.n_removed == ((r.was or "").count("\n") - (r.text or "").count("\n") if r.text or not r.was else r.n_lines)
    return sum(r.n_removed for r in done)


def variants(spark):
    rng = random.Random(11)
    base = [prose(rng, n).replace("\n", " ").split() for n in (9, 12, 20, 40, 60)]
    rows = []
    for i in range(90):
        lines = []
        for b in base:
            line = list(b)
            for _ in range(rng.choice((0, 0, 1, 2, len(b) // 8))):
                line[rng.randrange(len(line))] = prose(rng, 1)
            lines.append(" ".join(line[: rng.choice((len(line), len(line), int(len(line) * 0.85)))]))
        rows.append((i, "\n".join(lines)))
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("candidates", [1, 8])
def test_groups_of_variants(spark, candidates):
    assert compared(variants(spark), Settings(candidates=candidates, bitmap_bits=16)) > 100


@pytest.mark.parametrize("candidates", [1, 8])
def test_long_lists_are_cut_into_cells(spark, candidates, monkeypatch):
    settings = Settings(candidates=candidates, bitmap_bits=16, list_entries=24)
    cells = []
    real = linededup.cells_of
    monkeypatch.setattr(linededup, "cells_of", lambda parts, settings: cells.append(real(parts, settings)) or linededup.stored(cells[-1], "cells"))
    assert compared(variants(spark), settings) > 100
    assert cells


def test_rarity_in_a_tree_of_merges(spark, monkeypatch):
    texts = spark.createDataFrame([(f"common w{i} w{i % 7}",) for i in range(300)], "text string").repartition(9)
    flat = linededup.rarity_table(texts, 16)
    monkeypatch.setattr(linededup, "_FAN_IN", 2)
    assert (linededup.rarity_table(texts, 16) == flat).all() and flat.max() == np.ceil(np.log2(301) * 6)


def test_packed_entries_come_back():
    rng = np.random.default_rng(3)
    columns = [rng.integers(0, 1 << 30, 50).astype(kind) for kind in linededup._COLUMNS.values()]
    parts = linededup.packed(columns, np.array([0, 20, 20, 50]))
    for first, last, a, b in ((0, 1, 0, 20), (1, 2, 20, 20), (0, 3, 0, 50)):
        assert all((x == y[a:b]).all() for x, y in zip(linededup.unpacked(parts, first, last), columns))


def test_odd_rows(spark):
    assert compared(odd_documents(spark).filter("source is null or source <> 's9'")) > 10


def test_given_table(spark):
    assert compared(documents(spark)) > 20


def test_empty(spark):
    assert linededup.deduplicated(none_of(odd_documents(spark))).count() == 0


def test_documents_without_a_line_left_are_dropped(spark):
    docs = spark.createDataFrame([(1, "one two three four"), (2, "One  two three four"), (3, "one two three four\nfive six seven"), (4, None), (5, ""), (6, "x")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in linededup.keep_unique(docs).collect()) == [(1, "one two three four"), (3, "five six seven"), (4, None), (5, ""), (6, "x")]


def test_digests_of_lines_use_all_bits():
    data = np.frombuffer("\n".join(f"one two three w{i}" for i in range(4000)).encode(), np.uint8)
    words, _, first, *_, digest, twin = linededup.sets_of_lines(data, np.array([0, len(data)]), 1)
    assert len(first) == 4000 and len(set(zip(digest.tolist(), twin.tolist()))) == 4000
    sums = np.add.reduceat(words, first)
    assert len(set((sums & np.uint64((1 << 20) - 1)).tolist())) > 3900 and not (digest == twin).any()


def test_words_alike_in_44_bits_stay_apart():
    hashes = np.array([(5 << 20) + 1, 7 << 20, (5 << 20) + 2, (5 << 20) + 1, 9 << 20], np.uint64)
    words, at = linededup.word_sets(hashes, np.array([3, 3, 3, 3, 4]))
    assert words.tolist() == [(5 << 20) + 1, (5 << 20) + 2, 7 << 20, 9 << 20] and at.tolist() == [3, 3, 3, 4]


def test_short_lines_that_repeat_go(spark):
    docs = spark.createDataFrame([(1, "Share\none two three four\nRead more"), (2, "read  more\nfive six\nshare\n\nfive"), (3, "a b c\na b c d\nfour one two three five")], "doc_id long, text string")
    assert compared(docs) == 3
    assert {r.doc_id: r.text for r in linededup.deduplicated(docs).collect()} == {1: "Share\none two three four\nRead more", 2: "five six\n\nfive", 3: "a b c\na b c d"}


def test_earliest_of_equal_lines():
    rng = np.random.default_rng(4)
    columns = [rng.integers(0, 3, 300).astype(kind) for kind in linededup._LINES.values()]
    first, again = linededup.earliest(columns)
    rows = [tuple(int(c[i]) for c in columns[:6]) for i in range(300)]
    least = {}
    for row in rows:
        least[row[4:]] = min(least.get(row[4:], row), row)
    assert sorted(rows[i] for i in np.flatnonzero(first)) == sorted(least.values())
    assert again.tolist() == [row != least[row[4:]] and row[1:4] != least[row[4:]][1:4] for row in rows]
    assert [x.tolist() for x in linededup.earliest([c[:0] for c in columns])] == [[], []]


def held_lists():
    """One list of 60 lines that are all similar, of ids 1 to 60."""
    n = 60
    columns = [np.full(n, 9 << 20), np.arange(n), np.arange(1, n + 1), np.zeros(n), np.zeros(n), np.full(n, 20), np.zeros(n)]
    return linededup.Lists([c.astype(kind) for c, kind in zip(columns, linededup._COLUMNS.values())], np.zeros(n, np.int8), 0.8)


@pytest.mark.parametrize("limit", [None, 8])
def test_pairs_of_a_list_leave_in_parts(monkeypatch, limit):
    monkeypatch.setattr(linededup, "_FLUSH", 100)
    lists = held_lists()
    parts = list(lists.pairs(limit, None, 16))
    assert len(parts) > 3 and max(len(later) for later, _ in parts) < 100 + 60
    pairs = [(int(a), int(b)) for later, earlier in parts for a, b in zip(later, earlier)]
    assert sorted(pairs) == [(a, b) for a in range(1, 61) for b in range(1, a if limit is None else min(a, limit + 1))]
    assert lists.ids[lists.cut].tolist() == ([] if limit is None else list(range(9, 61)))


def test_counts_of_words_hold_only_slots_that_occur(monkeypatch):
    rng = np.random.default_rng(6)
    words = [rng.integers(0, 1 << 63, 4000).astype(np.uint64) * np.uint64(2) for _ in range(9)]
    expected = np.bincount((np.concatenate(words) >> np.uint64(48)).astype(np.int64), minlength=1 << 16)
    for most in (1 << 20, 6000):
        monkeypatch.setattr(linededup, "_HELD_SLOTS", most)
        counts, found, rows = linededup.WordCounts(16), np.zeros(1 << 16, np.int64), 0
        for part in words:
            rows += (flushed := list(counts.add(part))) != []
            assert counts.size < max(most, 1)
            for page, slots, n in flushed:
                found[(page << 8) + np.frombuffer(slots, np.uint32).astype(np.int64)] += np.frombuffer(n, np.uint64).astype(np.int64)
        for page, slots, n in counts.pages():
            found[(page << 8) + np.frombuffer(slots, np.uint32).astype(np.int64)] += np.frombuffer(n, np.uint64).astype(np.int64)
        assert (found == expected).all() and (rows > 0) == (most == 6000)
    assert list(linededup.WordCounts(16).pages()) == []


def test_hashes_of_words_by_their_bytes_alone():
    rng = random.Random(12)
    kinds = ["".join(rng.choices("abcé", k=k)) for k in (*range(1, 20), 63, 64, 65, 66, 300) for _ in range(3)]
    tokens = [rng.choice(kinds) for _ in range(3000)]
    text = " ".join(x.upper().replace("É", "é") if rng.random() < 0.5 else x for x in tokens).encode()
    hashes, starts = linededup.word_hashes(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert len(hashes) == len(tokens) and starts[0] == 0
    of = {}
    assert all(of.setdefault(x, h) == h for x, h in zip(tokens, hashes.tolist()))
    assert len(set(of.values())) == len(of)


def test_texts_are_read_once_for_all_first_pairs(spark, monkeypatch):
    reads = []
    real = linededup.line_sets
    monkeypatch.setattr(linededup, "line_sets", lambda *given: reads.append(1) or real(*given))
    assert compared(variants(spark), Settings(candidates=200, bitmap_bits=16)) > 100
    assert len(reads) == 1


def test_entries_stand_by_word_and_rank():
    rng = np.random.default_rng(5)
    word, line, ids = (rng.integers(0, n, 400) for n in (90, 4, 50))
    for order in (rng.integers(0, 5, 400), rng.integers(-(1 << 62), 1 << 62, 400), np.zeros(400, np.int64)):
        expected = [i for i in np.lexsort((ids, line, order, word)) if (word == word[i]).sum() > 1]
        by_rank = linededup.ranked(word.astype(np.uint64), order, line.astype(np.int32), ids)
        assert [(word[i], order[i], line[i], ids[i]) for i in by_rank] == [(word[i], order[i], line[i], ids[i]) for i in expected]


def test_a_line_in_most_documents_leaves_a_task_once(spark, monkeypatch):
    """Copies meet before they are sent, in stretches shorter than the table and over several tasks."""
    docs = spark.createDataFrame([(i, f"one two three\nfour five w{i % 40} six seven\nOne Two three") for i in [*range(150), *range(50)]], "doc_id long, text string").repartition(3)
    texts = linededup.texts_of(docs, "doc_id", "text")
    packed = linededup.lines_of(texts, 1, 16).filter(F.col("kind") == linededup.LINES)
    assert packed.agg(F.sum(F.octet_length("id") / 8)).first()[0] <= 3 * 41
    monkeypatch.setattr(linededup, "_FLUSH", 50)
    assert compared(docs) > 400
