"""Fingerprints, links and components against brute force."""

import itertools
import random

import xxhash
from fixtures import documents, none_of, odd_documents, rows_of

from ticketscope.llm import simhash
from ticketscope.llm.components import components


def plain_print(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_components(rows):
    prints = [plain_print(t) for _, t in rows]
    distinct = sorted(set(prints))
    parent = {p: p for p in distinct}

    def top(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for a, b in itertools.combinations(distinct, 2):
        if (a ^ b).bit_count() <= 3:
            parent[top(a)] = top(b)
    least = {}
    for (i, _), p in zip(rows, prints):
        if i is not None:
            least[top(p)] = min(least.get(top(p), i), i)
    return sorted(((i, f"{p:016x}", least.get(top(p))) for (i, _), p in zip(rows, prints)), key=repr)


def test_near_duplicates(spark):
    for docs in (odd_documents(spark), documents(spark)):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        assert rows_of(simhash.near_duplicates(docs)) == plain_components(rows)


def test_links_find_every_close_pair(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(6)]
    prints = {b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(5))) for b in base for _ in range(60)} | {0, 2**64 - 1, 2**63, 7}
    signed = lambda x: x - 2**64 if x >> 63 else x
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    expected = {tuple(sorted((signed(a), signed(b)))) for a, b in itertools.combinations(prints, 2) if (a ^ b).bit_count() <= 3}
    assert {tuple(r) for r in simhash.links(df).collect()} == expected and len(expected) > 100


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, 100 + i) for i in range(1, 50)] + [(130, 131), (100, 100)]
    found = dict(tuple(r) for r in components(spark.createDataFrame(chain + star, "u long, v long")).collect())
    assert found == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(50)}


def test_one_of_each_component_stays(spark):
    docs = odd_documents(spark).filter("source is null or source <> 's9'")  # one id for two components has one label
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    label = {(i, p): c for i, p, c in plain_components([(r.doc_id, r.text) for r in docs.collect()])}
    labels = [label[(r.doc_id, f"{plain_print(r.text):016x}")] for r in kept.collect()]
    assert len(labels) == len(set(labels)) == len(set(label.values()))
    assert all(r.doc_id == label[(r.doc_id, f"{plain_print(r.text):016x}")] for r in kept.collect())


def test_empty(spark):
    docs = none_of(odd_documents(spark))
    assert simhash.near_duplicates(docs).count() == 0 and simhash.keep_first(docs).count() == 0
