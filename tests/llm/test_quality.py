"""Measures against plain Python; bands on natural, repetitive and random text."""

import base64
import random
import re
from collections import Counter

import zstandard
from fixtures import documents, none_of, odd_documents, prose

from ticketscope.llm import quality


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    inside = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
    lines, seen = 0, set()
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), lines, len(inside), failed


def test_measures(spark):
    for docs in (odd_documents(spark), documents(spark)):
        found = quality.measure(docs, docs.columns).collect()
        texts = {r.doc_id: r.text for r in docs.collect()} if docs.columns[-1] != "copies" else None
        assert len(found) == docs.count()
        keyed = docs.select("doc_id", "text").collect()
        expected = sorted((r.doc_id, *plain(r.text)) for r in keyed if r.doc_id is not None)
        actual = sorted((r.doc_id, *(r.quality[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))) for r in found if r.doc_id is not None)
        assert actual == expected and (texts is None or len(texts) == len(found))


def verdict(text, **rules):
    return quality.judged(text, quality.Rules(**rules), zstandard.ZstdCompressor(level=3))


def test_bands():
    rng = random.Random(2)
    noise = " ".join(base64.b64encode(rng.randbytes(30)).decode() for _ in range(400))
    tiny_alphabet = " ".join("".join(rng.choices("ab", k=3)) for _ in range(3000))
    for n in (50, 80, 300, 3000, 20000):
        assert verdict(prose(rng, n))["kept"]
    assert not verdict(noise)["kept"] and not verdict(noise)["base_failed"]
    assert not verdict(tiny_alphabet)["kept"]
    mostly_noise = prose(rng, 700) + "\n" + noise
    assert verdict(mostly_noise)["bad_chunks"] > 1 / 3 and not verdict(mostly_noise)["kept"]
    assert verdict(prose(rng, 20000) + "\n" + noise)["kept"]


def test_clean_documents_of_the_table_are_kept(spark):
    rows = [r.quality for r in quality.measure(documents(spark), ["doc_id"]).collect()]
    assert all(r.kept for r in rows if not r.base_failed) and sum(r.kept for r in rows) > 100


def test_keep_good_and_empty(spark):
    docs = odd_documents(spark)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    assert quality.keep_good(none_of(docs)).count() == 0 and quality.measure(none_of(docs), ["doc_id"]).count() == 0


def test_limits_from_the_table_reject_what_passes_the_word_rules(spark):
    rng = random.Random(5)
    # As in the given table, every word of the junk has its sign.
    dirty = lambda text: " ".join(w + ("###", "$$$", "%%%", "&&&")[sum(w.encode()) % 4] for w in text.split())
    clean = [prose(rng, 900) for _ in range(800)]
    junk = [dirty(prose(rng, 800)) for _ in range(40)]
    noise = [" ".join(base64.b64encode(rng.randbytes(6)).decode() for _ in range(500)) for _ in range(20)]
    few_words = [" ".join(rng.choice(("alpha", "beta", "gamma", "delta", "omega", "kappa", "sigma", "theta", "iota")) for _ in range(900)) for _ in range(20)]
    tables = {"clean": clean, "junk": junk, "noise": noise, "few": few_words, "copies": [clean[0]] * 500}
    docs = spark.createDataFrame([(k, t) for k, ts in tables.items() for t in ts], "kind string, text string").repartition(8)
    rules = quality.fitted(docs)
    found = quality.measure(docs, ["kind"], rules=rules).collect()
    kept = Counter(r.kind for r in found if r.quality.kept)
    assert not any(r.quality.base_failed for r in found if r.kind in ("junk", "noise"))
    assert kept["clean"] >= 790 and kept["copies"] == 500 and kept["junk"] == kept["noise"] == kept["few"] == 0
    assert quality.keep_good(docs, rules=rules).count() == sum(kept.values())
    assert quality.fitted(none_of(docs)).limits == {}


def test_limits_do_not_hang_on_the_size_of_the_table(spark):
    rng = random.Random(8)
    noise = lambda n: " ".join(base64.b64encode(rng.randbytes(6)).decode() for _ in range(n))
    texts = [("clean", prose(rng, rng.choice((80, 150, 300, 600, 1200, 2400)))) for _ in range(1500)]
    texts += [("noise", noise(rng.choice((200, 500, 900)))) for _ in range(60)]
    rng.shuffle(texts)
    docs = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(texts)], "id long, kind string, text string")
    verdicts = {}
    for share in (1, 5, 20):
        part = docs.filter(docs.id % share == 0)
        found = quality.measure(part, ["id", "kind"], rules=quality.fitted(part)).filter("not quality.base_failed").collect()
        verdicts[share] = {r.id: r.quality.kept for r in found}
        clean, bad = ([r.quality.kept for r in found if r.kind == k] for k in ("clean", "noise"))
        assert sum(clean) >= 0.95 * len(clean) and sum(bad) <= 0.1 * len(bad), share
    assert sum(verdicts[1][i] != kept for i, kept in verdicts[5].items()) <= 0.02 * len(verdicts[5])


def test_smoothing():
    import numpy as np

    x = np.arange(quality.CLASSES)
    weights = np.where((x > 10) & (x < 30), 100.0, 0.0)
    line = quality.smoothed(0.9 - 0.01 * x, weights, 20.0)
    assert np.allclose(line, 0.9 - 0.01 * x, atol=1e-5)  # a line stays, and goes on where there are no texts
    odd = (0.9 - 0.01 * x) + np.where(x == 20, 0.3, 0)
    assert abs(quality.smoothed(odd, np.where(x == 20, 1.0, weights), 20.0)[20] - 0.7) < 0.03  # one text bends it little
    assert quality.middle(np.array([3, 1, 2]), np.array([1, 1, 5])) == 2
