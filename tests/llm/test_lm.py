"""Exact base scores, probed counts and smoothed scores against brute force."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from fixtures import documents, none_of, odd_documents, rows_of
from pyspark.sql import functions as F

from ticketscope.llm import lm

END = b"\0end"


def tokens(text):
    return [*(text or "").encode().lower().split(), END]


def level(count, steps):
    return 1 + math.floor(math.log2(count) * steps + 1e-9) if count else 0


def plain(rows, settings, rate=0.0):
    """Scores from exact counts, each replaced by the mean of the counts of its level."""
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    single, double = Counter(), Counter()
    for (_, text), out in zip(rows, held):
        if not out:
            single.update(tokens(text))
            double.update(zip([END, *tokens(text)], tokens(text)))
    n, v = sum(single.values()), len(single)
    false = rate * v
    means = []
    for counts, steps in zip((single, double), settings.steps):
        held_at = {}
        for c in counts.values():
            held_at.setdefault(level(c, steps), []).append(c)
        means.append({q: sum(x) / len(x) for q, x in held_at.items()} | {0: 0.0})
    read = lambda kind, c: means[kind][level(c, settings.steps[kind])]
    found = []
    for (i, text), out in zip(rows, held):
        t = tokens(text)
        base, score = 0.0, 0.0
        for before, w in zip([END, *t], t):
            base += math.log10((single[w] + 1) / (n + v + 1))
            own, context = (read(0, single[w]) + 1) / (n + v + 1), read(0, single[before])
            pair = min(read(1, double[before, w]), context, read(0, single[w]))
            score += math.log10((pair + settings.prior * own) / (context + false + settings.prior) if context else own)
        found.append((i, out, len(t), sum(single[w] > 0 for w in t), n, base, score))
    return sorted(found, key=lambda r: repr(r[:3]))


@pytest.mark.parametrize("head", [1 << 20, 50, 0])
@pytest.mark.parametrize("table", [odd_documents, documents])
def test_scores(spark, table, head):
    settings = lm.Settings(bits_per_entry=64, probes=12, pages=16, head_tokens=head, flush_tokens=5000)
    docs = table(spark)
    expected = plain([(r.doc_id, r.text) for r in docs.collect()], settings)
    actual = sorted((tuple(r) for r in lm.scores(docs, settings).collect()), key=lambda r: repr(r[:3]))
    assert [r[:5] for r in actual] == [r[:5] for r in expected]
    assert sorted(round(r[5], 6) for r in actual) == sorted(round(r[5], 6) for r in expected)
    assert sum(abs(a - b) < 1e-6 * (1 + abs(b)) for a, b in zip(sorted(r[6] for r in actual), sorted(r[6] for r in expected))) > 0.97 * len(expected)


def test_scores_of_the_registered_settings(spark):
    docs = documents(spark)
    settings = lm.Settings()
    rate = (1 - math.exp(-settings.probes / settings.bits_per_entry)) ** settings.probes  # of a full Bloom filter
    expected = plain([(r.doc_id, r.text) for r in docs.collect()], settings, rate)
    actual = sorted((tuple(r) for r in lm.scores(docs).collect()), key=lambda r: repr(r[:3]))
    assert [r[:5] for r in actual] == [r[:5] for r in expected]
    # What is left are false positives and the spread of fill between pages.
    assert all(abs(a[6] - e[6]) < 0.02 * abs(e[6]) + 0.05 for a, e in zip(actual, expected))


@pytest.mark.parametrize("steps", [1, 8])
def test_probed_levels_never_fall_short_and_rarely_exceed(steps):
    keys = lm.mixed(np.arange(1, 20001, dtype=np.uint64))
    counts = np.where(np.arange(20000) % 50 == 0, 10**6, np.arange(20000) % 300 + 1)
    settings = lm.Settings(pages=4)
    want, shift = lm.levels(counts, steps), np.uint64(62)
    pages = [lm.page_filter(keys[keys >> shift == p], want[keys >> shift == p], settings) for p in range(4)]
    held = lm.Filter(np.frombuffer(b"".join(p for p, _ in pages), np.uint8), np.array([len(p) for p, _ in pages]), settings)
    found = held.level(keys)
    assert (found >= want).all() and (found > want).mean() < 0.003
    unseen = lm.mixed(np.arange(50_001, 450_001, dtype=np.uint64))
    rate = np.mean([r for _, r in pages])
    assert rate < 1e-3 and (held.level(unseen) > 0).sum() <= 3 * rate * len(unseen) + 10


@pytest.mark.parametrize("bits, probes", [(16, 11), (24, 17)])
def test_probabilities_sum_to_one(spark, bits, probes):
    """Over the whole vocabulary, behind the commonest words, rare ones and the end mark; with a poor filter too."""
    settings = lm.Settings(pages=16, bits_per_entry=bits, probes=probes)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select("text", lm.held_out(F.col("doc_id")).alias("out")).filter("not out")
    pages = lm.counted(rows, settings)
    counts = lm.token_counts(pages).toPandas().sort_values(["c", "token"], ascending=False)
    smooth = lm.smoothing(pages, int(counts["c"].sum()), len(counts), settings)
    whole = [(k, p, n) for g in lm.page_groups(pages, settings) for k, p, n in g]
    singles, doubles = (lm.Filter(data, sizes, settings) for data, sizes in lm.gathered(pages, whole, settings))
    words = counts["token"].to_numpy().view(np.uint64)
    own = smooth.means[0][singles.level(words)]
    assert own.sum() == pytest.approx(counts["c"].sum(), rel=0.01)
    picked = np.unique(np.concatenate([np.arange(15), np.linspace(15, len(words) - 1, 60).astype(int)]))
    sums = []
    for i in picked:
        pair = smooth.means[1][doubles.level(lm.mixed(words[i] * lm._PAIR + words))]
        p = smooth.probability(np.full(len(words), own[i]), own, pair)
        sums.append(p.sum() + 1 / smooth.floor)
    sums = np.array(sums)
    assert 0.97 < sums.mean() < 1.03
    assert ((sums > 0.9) & (sums < 1.1)).mean() > 0.95, sums


def test_no_rows_and_no_training_rows(spark):
    docs = odd_documents(spark)
    assert lm.scores(none_of(docs)).count() == 0
    alone = docs.filter(lm.held_out(F.col("doc_id")) & F.col("text").isNotNull())
    assert alone.count() > 0 and all(r.train_tokens == 0 and r.base_score == 0 and r.score == 0 for r in lm.scores(alone).collect())


def test_copies_score_alike_and_reruns_agree(spark):
    docs = odd_documents(spark)
    assert rows_of(lm.scores(docs)) == rows_of(lm.scores(docs.repartition(5)))


def test_a_filter_larger_than_its_room_is_sent_in_groups_and_loses_nothing(spark):
    docs = odd_documents(spark)
    whole, tight = lm.Settings(pages=16), lm.Settings(pages=16, filter_bytes=1800)
    pages = lm.counted(docs.filter(~lm.held_out(F.col("doc_id"))), tight)
    groups = lm.page_groups(pages, tight)
    assert len(groups) > 2 and all(len(g) == 1 or sum(n for *_, n in g) <= 1800 for g in groups)
    key = lambda r: repr(r[:3])
    expected, actual = (sorted((tuple(r) for r in lm.scores(docs, s).collect()), key=key) for s in (whole, tight))
    assert [r[:5] for r in actual] == [r[:5] for r in expected] and len(actual) == docs.count()
    for column in (5, 6):
        assert sorted(r[column] for r in actual) == pytest.approx(sorted(r[column] for r in expected))


def test_counts_leave_a_worker_one_kind_at_a_time():
    """Tokens and pairs in one batch would both stand in memory, with all their copies."""
    kinds = []

    class Train:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            texts = pa.RecordBatch.from_arrays([pa.array(["a b c a", None, "", "b a b"] * 5)], names=["text"])
            kinds.extend(batch["kind"].to_pylist() for batch in run(iter([texts, texts])))
            raise InterruptedError

    with pytest.raises(InterruptedError):
        lm.counted(Train(), lm.Settings(pages=16, flush_tokens=30))
    assert len(kinds) == 4 and [set(k) for k in kinds] == [{0}, {1}] * 2


def test_levels_of_many_groups_take_little_room(spark, monkeypatch):
    """Each group of pages shows few of the levels; a pass does not keep a byte for every token that it does not know."""
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * 31 + k * k) % 977}" for k in range(4000))) for i in range(12)], "doc_id long, text string")
    kept, real = [], lm.stored
    monkeypatch.setattr(lm, "stored", lambda df, name: kept.append((name, real(df, name))) or kept[-1][1])
    lm.scores(docs, lm.Settings(pages=16, filter_bytes=2000)).count()
    sizes = [table.agg(F.sum(F.octet_length("levels"))).first()[0] for name, table in kept if name == "lm-levels"]
    assert len(sizes) > 8 and sum(sizes) < 2 * 12 * 4001
