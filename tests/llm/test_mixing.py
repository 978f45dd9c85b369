"""Targets against plain Python; rounding keeps sums, chances and bounds."""

from collections import defaultdict

import numpy as np
import pytest
from fixtures import documents, none_of, odd_documents, rows_of

from ticketscope.llm import mixing


def plain_targets(sizes, weights, most=3.0):
    total, full = sum(sizes.values()), {}
    while True:
        open_ = [s for s in sizes if s not in full]
        rate = (total - sum(full.values())) / (sum(weights[s] for s in open_) or 1)
        over = {s: most * sizes[s] for s in open_ if rate * weights[s] > most * sizes[s]}
        if not over:
            return full | {s: rate * weights[s] for s in open_}
        full |= over


def compared(docs, **settings):
    sizes, found = defaultdict(int), mixing.mix(docs, **settings).collect()
    for r in docs.collect():
        sizes[r.source] += len((r.text or "").encode().split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    expected = plain_targets(sizes, {s: 1.0 + i % 3 for i, s in enumerate(order)})
    taken, largest = defaultdict(int), defaultdict(int)
    for r in found:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(expected[r.source])
        assert r.taken == r.copies * r.size <= 3 * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    assert len(found) == docs.count()
    for s in sizes:
        assert abs(taken[s] - expected[s]) < largest[s] + 1e-6, (s, taken[s], expected[s])
    return found


def test_given_table(spark):
    docs = documents(spark)
    compared(docs)


@pytest.mark.parametrize("leaf_rows", [3, 50])
def test_tree_and_reruns(spark, leaf_rows):
    docs = documents(spark)
    first = compared(docs, leaf_rows=leaf_rows)
    again = mixing.mix(docs.repartition(5), leaf_rows=leaf_rows)
    assert rows_of(again.select("doc_id", "copies")) == sorted(((r.doc_id, r.copies) for r in first), key=repr)


def test_odd_rows(spark):
    docs = odd_documents(spark)
    for table in (docs, documents(spark)):
        narrow = mixing.counted(table, ["doc_id", "source"])
        assert sorted((r.doc_id or 0, r.size) for r in narrow.collect()) == sorted((r.doc_id or 0, len((r.text or "").encode().split())) for r in table.collect())
    found = compared(docs)
    assert [c for c in docs.columns if c not in mixing.ADDED] == [c for c in found[0].asDict() if c not in mixing.ADDED]
    assert mixing.mix(none_of(docs)).count() == 0


def test_given_weights(spark):
    docs = documents(spark).filter("source in ('src1', 'src2')")
    weights = spark.createDataFrame([("src1", 1.0), ("src2", 0.0)], "source string, weight double")
    taken = {r.source: r.target for r in mixing.mix(docs, weights, max_repeats=100.0).collect()}
    assert taken["src2"] == 0 and taken["src1"] > 0


def test_every_source_stops_when_the_rest_is_too_small(spark):
    rows = [(1, "a " * 10, "big"), (2, "b " * 1000, "small weight"), (3, None, "none")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {r.source: r.target for r in mixing.mix(docs).collect()} == {"big": 30.0, "small weight": pytest.approx(980.0), "none": 0.0}


def test_chances_and_targets_end_to_end():
    """A source of many sizes through leaves, levels and the last draw: every document keeps its chance."""
    import pandas as pd

    rng = np.random.default_rng(4)
    sizes = np.concatenate([rng.integers(1, 400, 36).astype(float), [6000.0, 5000.0, 2500.0, 900.0]])
    chance, runs = 0.3, 1200
    hits, words = np.zeros(len(sizes)), []
    for run in range(runs):
        rows = pd.DataFrame({"unit": [f"u{i}" for i in range(len(sizes))], "size": sizes, "chance": chance, "node": np.arange(len(sizes)) % 3})
        taken, level = np.zeros(len(sizes)), 0
        while len(rows):
            last = rows["node"].nunique() == 1
            parts = [mixing._node(last)(g.assign(seed=hash((run, level, n)))) for n, g in rows.groupby("node")]
            done = pd.concat(parts)
            for unit, found in zip(done.loc[~done["open"].astype(bool), "unit"], done.loc[~done["open"].astype(bool), "chance"]):
                taken[int(unit[1:])] = found
            rows, level = done[done["open"].astype(bool)].assign(node=0), level + 1
        hits += taken
        words.append((taken * sizes).sum())
        assert set(np.unique(taken)) <= {0.0, 1.0}
    target = chance * sizes.sum()
    assert np.abs(hits / runs - chance).max() < 0.06
    assert abs(np.mean(words) - target) < 0.02 * target and np.abs(np.array(words) - target).max() < sizes.max()


def test_pairs_keep_sums_and_chances():
    rng = np.random.default_rng(5)
    sizes, chances = np.array([50.0, 20, 20, 7, 3]), np.array([0.2, 0.9, 0.5, 0.35, 0.6])
    hits = np.zeros(5)
    for run in range(20000):
        found, at = mixing.settle_pairs(sizes, chances, rng.random(5))
        assert (found * sizes).sum() == pytest.approx((chances * sizes).sum())
        assert ((found == 0) | (found == 1) | (np.arange(5) == at)).all()
        hits += found
    assert np.abs(hits / 20000 - chances).max() < 0.02
