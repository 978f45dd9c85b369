"""Notices found with edits, spans and coverage; nothing in clean text."""

import random
import re

import numpy as np
from fixtures import documents, none_of, odd_documents, prose

from ticketscope.llm import licenses
from ticketscope.llm.licenses import NOTICES, Index, Settings


def words(text):
    return [w for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]


def test_every_notice_in_noise(spark):
    rng = random.Random(9)
    rows = [(i, f"Ünï {prose(rng, 60)}\n# {NOTICES[name].upper().replace(' ', '  ')}.\n{prose(rng, 40)}") for i, name in enumerate(sorted(NOTICES))]
    docs = spark.createDataFrame([*rows, (None, rows[2][1]), rows[3]], "doc_id long, text string")
    found = licenses.notices(docs).collect()
    assert len(found) == len(rows) + 2
    for r in found:
        if r.doc_id is not None:
            assert r.license == sorted(NOTICES)[r.doc_id] and r.coverage == 1.0
            span = rows[r.doc_id][1][r.first_char : r.end_char]
            assert words(span.lower()) == words(NOTICES[r.license].lower())
            assert words(rows[r.doc_id][1])[r.first_word : r.last_word + 1] == words(span)


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(row[j + 1], new[j], row[j] + (x == y)))
        row = new
    return row[-1]


def test_edited_notices_have_the_coverage_of_a_full_alignment():
    rng = random.Random(3)
    index = Index({"MIT text": NOTICES["MIT text"]}, Settings())
    template = index.words[0].tolist()
    for trial in range(60):
        edited = list(template)
        for _ in range(rng.randrange(12)):
            at = rng.randrange(len(edited))
            kind = rng.randrange(3)
            if kind == 0:
                del edited[at]
            else:
                edited[at : at + (kind == 1)] = [rng.randrange(1 << 60)]
        around = [rng.randrange(1 << 60) for _ in range(50)]
        text = np.array([*around, *edited, *around], np.uint64)
        found = licenses.found_in(text, index, Settings())
        assert len(found) == 1 and found[0][1] == longest_common(template, text.tolist())
        assert 50 <= found[0][2] <= found[0][3] < 50 + len(edited)


def test_given_table_against_plain_search(spark):
    docs = documents(spark).collect()
    found = {(r.doc_id, r.license) for r in licenses.notices(documents(spark)).collect() if r.coverage == 1.0}
    short = {n: f" {' '.join(words(NOTICES[n].lower()))} " for n in ("MIT", "Apache-2.0", "GPL-3.0", "CC-BY-NC-4.0", "All rights reserved")}
    expected = {(r.doc_id, n) for r in docs for n, t in short.items() if t in f" {' '.join(words(r.text.lower()))} "}
    assert found == expected and found


def test_whole_licences_are_told_apart(spark):
    """Whole texts with copyright lines win over the sentences they begin with; a head alone stays a head."""
    rng = random.Random(4)
    whole = {"BSD-2-Clause", "BSD-3-Clause", "ISC licence", "MIT licence", "Unlicense text", "Zlib"}
    heads = {"MIT text", "ISC", "BSD", "Unlicense"}
    rows = [(n, f"{prose(rng, 30)}\nCopyright (c) 2020 Somebody\n\n{NOTICES[n]}\n{prose(rng, 30)}") for n in sorted(whole | heads)]
    found = licenses.notices(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert {(r.doc_id, r.license, r.coverage) for r in found} == {(n, n, 1.0) for n in whole | heads} and len(found) == len(rows)
    body = NOTICES["BSD-3-Clause"].split()
    holes = " ".join(w for i, w in enumerate(body) if i % 12)  # every twelfth word is gone
    (hit,) = licenses.notices(spark.createDataFrame([(1, holes)], "doc_id long, text string")).collect()
    assert hit.license == "BSD-3-Clause" and 0.85 < hit.coverage < 0.95


def test_winnowing_keeps_one_of_every_window():
    hashes = np.random.default_rng(0).integers(0, 9, 200).astype(np.uint64)
    for window in (1, 2, 5, 300):
        places = licenses.winnowed(hashes, window)
        assert all(any(i <= p < i + window for p in places) for i in range(max(1, len(hashes) - window + 1)))


def test_odd_rows_no_templates_and_empty(spark):
    docs = odd_documents(spark)
    assert licenses.notices(docs).count() == 0 and licenses.notices(docs, {}).count() == 0
    assert licenses.notices(none_of(docs)).columns[:2] == ["doc_id", "license"]
    many = spark.createDataFrame([(1, (NOTICES["MIT"] + "\n") * 50)], "doc_id long, text string")
    assert licenses.notices(many).count() == 50
