"""License notices in documents: winnowed fingerprints pick candidates, banded alignment measures them.

Templates are cut into grams of `gram` words; of every `window` neighbouring grams the smallest hash, rightmost on ties,
is a fingerprint, so any `window + gram - 1` words in common with a template hold one. The inverted index from
fingerprints to template places is small (its size is checked) and goes to every worker. All grams of a document are
looked up; hits of a template on neighbouring diagonals are one candidate, which is aligned to the template inside a
band around them. A match is reported when the aligned words reach `min_coverage` of the template; where matches
overlap, the one with most words stays, then the best covered, then the first by name.

Words are ASCII letters, digits and all characters beyond ASCII, lower-cased. Null and empty texts match nothing.
Texts are read whole; a document may hold any number of notices. Repeated rows are reported each. An empty table gives
an empty result; no templates match nothing. Further columns are not read.
"""

from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ticketscope.llm.words import LOWER, chunks, mixed, prefix_hashes, range_hashes, text_bytes, word_bounds

# The wording of common short notices, of headers and of whole short licences.
_BSD_SOURCE = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_BINARY = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_MIT_HEAD = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"
_NO_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE"
_DEALINGS = "BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ISC_HEAD = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."

NOTICES = {
    "AGPL-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "All rights reserved": "All rights reserved",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0 header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "BSD": _BSD_HEAD,
    "BSD-2-Clause": " ".join([_BSD_HEAD, _BSD_SOURCE, _BSD_BINARY, _BSD_DISCLAIMER]),
    "BSD-3-Clause": " ".join([_BSD_HEAD, _BSD_SOURCE, _BSD_BINARY, _BSD_NAMES, _BSD_DISCLAIMER]),
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "CC0-1.0 notice": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
    "EPL-2.0 notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    "GPL-3.0": "licensed under the GNU General Public License, version 3",
    "GPL-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": _ISC_HEAD,
    "ISC licence": _ISC_HEAD + " THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "LGPL-3.0 header": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT": "Released under the MIT License",
    "MIT licence": f"{_MIT_HEAD}: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_NO_WARRANTY} AUTHORS OR COPYRIGHT HOLDERS {_DEALINGS}",
    "MIT text": _MIT_HEAD,
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Unlicense text": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. "
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. "
        "We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. " + _NO_WARRANTY + " AUTHORS " + _DEALINGS
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
    ),
}

MAX_TEMPLATE_WORDS = 1_000_000
_APART = np.array([not (chr(b).isalnum() if b < 128 else True) for b in range(256)])


@dataclass(frozen=True)
class Settings:
    gram: int = 3
    window: int = 2
    min_coverage: float = 0.8
    band: float = 0.2  # of the template's words, and at least 3 words


def text_words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and the bytes they begin at and end before."""
    low = LOWER[data]
    starts, ends = word_bounds(low, bounds, _APART)
    return range_hashes(prefix_hashes(low), starts, ends), starts, ends


def grams(words: np.ndarray, gram: int) -> np.ndarray:
    if len(words) < gram:
        return np.zeros(0, np.uint64)
    out = words[: len(words) - gram + 1].copy()
    for k in range(1, gram):
        out = mixed(out + words[k : len(words) - gram + 1 + k])
    return out


def winnowed(hashes: np.ndarray, window: int) -> list[int]:
    """Places of the fingerprints: the smallest hash of every window, rightmost on ties."""
    last = max(1, len(hashes) - window + 1)
    return sorted({i + len(w) - 1 - int(np.argmin(w[::-1])) for i in range(last) if len(w := hashes[i : i + window])})


class Index:
    """Templates as word hashes, and the places of their fingerprints by hash."""

    def __init__(self, templates: dict[str, str], settings: Settings):
        self.names = sorted(templates)
        texts = [np.frombuffer(templates[n].encode(), np.uint8) for n in self.names]
        self.words = [text_words(t, np.array([0, len(t)]))[0] for t in texts]
        if sum(map(len, self.words)) > MAX_TEMPLATE_WORDS:
            raise ValueError(f"templates hold more than {MAX_TEMPLATE_WORDS} words")
        self.postings: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for t, words in enumerate(self.words):
            hashes = grams(words, settings.gram)
            for place in winnowed(hashes, settings.window):
                self.postings[int(hashes[place])].append((t, place))
        self.keys = np.array(sorted(self.postings), np.uint64)


def aligned(template: list[int], words: list[int], low: int, high: int) -> tuple[int, int, int]:
    """Most template words met in order by a path that keeps word minus template place in [low, high].

    Returns the number, and the first and last word met; among equal paths the shortest span of words is taken.
    """
    best: dict[int, tuple[int, int]] = {}  # by diagonal: words matched, first word; of equal counts the latest start
    top = (0, 0, 0)  # words matched, minus words spanned, first word
    for i, wanted in enumerate(template):
        row: dict[int, tuple[int, int]] = {}
        for d in range(low, high + 1):
            j = i + d
            if not 0 <= j < len(words):
                continue
            # Paths that end at template words before i and at words before j.
            before = best.get(d, (0, -1))
            here = max(best.get(d + 1, (0, -1)), row.get(d - 1, (0, -1)), before)
            if words[j] == wanted:
                met = (before[0] + 1, before[1] if before[0] else j)
                top = max(top, (met[0], met[1] - j, met[1]))
                here = max(here, met)
            row[d] = here
        best = row
    return top[0], top[2], top[2] - top[1]


def found_in(words: np.ndarray, index: Index, settings: Settings) -> list[tuple[int, int, int, int]]:
    """(template, matched words, first word, last word) of the notices of one text."""
    hashes = grams(words, settings.gram)
    if not len(hashes) or not len(index.keys):
        return []
    at = np.minimum(np.searchsorted(index.keys, hashes), len(index.keys) - 1)
    diagonals = defaultdict(list)
    for i in np.flatnonzero(index.keys[at] == hashes).tolist():
        for template, place in index.postings[int(hashes[i])]:
            diagonals[template].append(i - place)
    matches = []
    for template, held in diagonals.items():
        wanted = index.words[template]
        band = max(3, int(settings.band * len(wanted)))
        held.sort()
        groups = [[held[0], held[0]]]
        for d in held[1:]:
            if d - groups[-1][0] <= band:
                groups[-1][1] = d
            else:
                groups.append([d, d])
        for low, high in groups:
            begin, end = max(0, low - band), min(len(words), high + len(wanted) + band)
            if np.isin(wanted, words[begin:end]).sum() < settings.min_coverage * len(wanted):
                continue  # no alignment can meet words that are not there
            n, first, last = aligned(wanted.tolist(), words[begin:end].tolist(), low - band - begin, high + band - begin)
            if n >= settings.min_coverage * len(wanted):
                matches.append((template, n, first + begin, last + begin))
    matches.sort(key=lambda m: (-m[1], -m[1] / len(index.words[m[0]]), index.names[m[0]], m[2]))
    kept: list[tuple[int, int, int, int]] = []
    taken = np.zeros(len(words) + 1, bool)
    for m in matches:
        if not taken[m[2] : m[3] + 1].any():
            taken[m[2] : m[3] + 1] = True
            kept.append(m)
    return sorted(kept, key=lambda m: m[2])


def notices(docs: DataFrame, templates: dict[str, str] | None = None, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, license, matched, coverage, first_word, last_word, first_char, end_char) of every notice found."""
    templates = NOTICES if templates is None else templates
    Index(templates, settings)  # refuses too many templates before any task runs
    names = ["doc_id", "license", "matched", "coverage", "first_word", "last_word", "first_char", "end_char"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates, settings)
        for batch in batches:
            data, bounds = text_bytes(batch.column(1))
            owners, rows = [], []
            for i, j in chunks(bounds):
                own = bounds[i : j + 1] - bounds[i]
                part = data[bounds[i] : bounds[j]]
                words, starts, ends = text_words(part, own)
                edges = np.searchsorted(starts, own)
                for k in range(j - i):
                    a, b = edges[k], edges[k + 1]
                    matches = found_in(words[a:b], index, settings)
                    # Characters before each byte of the text, counted once for all its matches.
                    before = np.append(0, np.cumsum((part[own[k] : own[k + 1]] & 0xC0) != 0x80)) if matches else None
                    for template, n, first, last in matches:
                        chars = [int(before[x - own[k]]) for x in (starts[a + first], ends[a + last])]
                        owners.append(i + k)
                        rows.append((index.names[template], n, n / len(index.words[template]), first, last, *chars))
            kinds = [pa.string(), pa.int64(), pa.float64(), *[pa.int64()] * 4]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owners, pa.int64())), *columns], names=names)

    source = docs.select(docs[doc_id].alias("doc_id"), docs[text].cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, license string, matched long, coverage double, first_word long, last_word long, first_char long, end_char long")
