"""Held-out accuracy on planted toxic words, n-grams and ratios against plain Python, odd rows."""

import math
import random
import zlib
from collections import Counter

import numpy as np
from fixtures import SMALL, documents, none_of, odd_documents, prose

from ticketscope.llm import toxicity

SETTINGS = toxicity.Settings()


def plain_grams(text):
    text = " " + " ".join((text or "").lower().split()) + " "
    return Counter(text[i : i + n] for n in (4, 5, 6) for i in range(len(text) - n + 1))


def test_grams():
    texts = ["", "a", "Ünï  Ærø\n\tx", "aaaa aaaa", "the cat sat " * 50]
    places, owner = toxicity.grams([toxicity.normal(t) for t in texts], SETTINGS)
    for i, text in enumerate(texts):
        found = Counter(places[owner == i].tolist())
        assert sorted(found.values()) == sorted(plain_grams(text).values())
        alone, _ = toxicity.grams([toxicity.normal(text)], SETTINGS)
        assert Counter(alone.tolist()) == found
    assert [t for a, b in toxicity.chunks(texts, 3) for t in texts[a:b]] == texts


def labelled(spark, seed=4, n=1200):
    """Documents of which the toxic ones hold insults, in a few shapes; every tenth one has no label."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        said, toxic = prose(rng, rng.randrange(5, 300)).split(" "), rng.random() < 0.2
        for _ in range(rng.randrange(1, 6) * toxic):
            said.insert(rng.randrange(len(said) + 1), rng.choice(["snarglet", "Snarglets!", "zorpish", "zorpier"]))
        rows.append((i, " ".join(said), int(toxic)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(4)
    marks = spark.createDataFrame([(r[0], 0, r[2]) for r in rows if r[0] % 10], "doc_id long, quality int, toxic int")
    return docs, marks, {r[0]: r[2] for r in rows}


def test_held_out_accuracy(spark):
    docs, marks, truth = labelled(spark)
    found = toxicity.report(docs, marks).collect()
    assert sorted(r.doc_id for r in found) == sorted(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found)
    unseen = [r for r in found if r.held_out or r.doc_id % 10 == 0]
    assert len(unseen) > 400
    caught = sum(r.predicted for r in unseen if truth[r.doc_id]) / sum(truth[r.doc_id] for r in unseen)
    wrong = sum(r.predicted for r in unseen if not truth[r.doc_id])
    assert caught > 0.95 and wrong <= 2


def test_held_out_labels_do_not_matter(spark):
    docs, marks, truth = labelled(spark, n=300)
    turned = marks.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 3 = 1 then 1 - toxic else toxic end as toxic")
    one, two = ({r.doc_id: r.score for r in toxicity.report(docs, m).collect()} for m in (marks, turned))
    assert all(abs(one[i] - two[i]) < 1e-9 for i in one)


def test_ratios(spark):
    docs, marks, truth = labelled(spark, n=120)
    rows = toxicity.marked(docs, marks, "text", SETTINGS)
    learnt = [(r.text, r.label) for r in rows.collect()]
    assert len(learnt) == 108
    counts = {r.place: (r.toxic, r.clean) for r in toxicity.counted(rows, SETTINGS).collect()}
    toxic = sum(label for _, label in learnt)
    assert counts.pop(-1) == (toxic, len(learnt) - toxic)
    held = [(set(toxicity.grams([toxicity.normal(t)], SETTINGS)[0].tolist()), label) for t, label in learnt]
    want = {}
    for places, label in held:
        for place in places:
            a, b = want.get(place, (0, 0))
            want[place] = (a + label, b + 1 - label)
    assert counts == want
    model = toxicity.fitted(docs, marks)
    for place, ratio in list(zip(model.places, model.ratios))[:50]:
        a, b = want[place]
        assert math.isclose(ratio, math.log((a + 1) / (toxic + 2) / ((b + 1) / (len(learnt) - toxic + 2))))
    # The regression is at its optimum: the penalised gradient vanishes.
    table = toxicity._table(model.places, SETTINGS)
    owner, feature, value = toxicity.values([toxicity.normal(t) for t, _ in learnt], table, model.ratios, SETTINGS)
    sums = model.intercept + np.bincount(owner, value * model.weights[feature], len(learnt))
    gap = 1 / (1 + np.exp(-sums)) - np.array([label for _, label in learnt])
    gradient = np.bincount(feature, value * gap[owner], len(model.weights)) / len(learnt) + SETTINGS.penalty * model.weights
    assert np.abs(gradient).max() < 1e-3 and abs(gap.mean()) < 1e-3


def test_bounded_sample_and_one_class(spark):
    docs, marks, truth = labelled(spark, n=600)
    few = toxicity.marked(docs, marks, "text", toxicity.Settings(max_rows=100)).count()
    assert 60 < few < 140
    clean = marks.selectExpr("doc_id", "0 as toxic")
    scores = {r.score for r in toxicity.scored(docs, toxicity.fitted(docs, clean)).collect()}
    assert len(scores) == 1 and scores.pop() < 0.01
    assert {r.score for r in toxicity.report(docs, none_of(marks)).collect()} == {0.5}


def test_odd_rows_and_empty(spark):
    docs = odd_documents(spark).withColumnRenamed("copies", "score")
    marks = spark.createDataFrame([(3, 1), (3, 0), (4, 0), (5, 0), (None, 1), (6, None), (15, 0)], "doc_id long, toxic int")
    found = toxicity.report(docs, marks).collect()
    assert len(found) == docs.count() and all(0 <= r.score <= 1 for r in found)
    kept = toxicity.scored(docs, toxicity.fitted(docs, marks))
    assert kept.columns == [c for c in docs.columns if c not in ("text", "score")] + ["score"]
    assert toxicity.report(none_of(docs), marks).count() == 0


def test_given_table(spark):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    found = toxicity.report(documents(spark), labels).collect()
    assert len(found) == documents(spark).count()
