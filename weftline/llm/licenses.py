"""License scans: winnowed fingerprints pick candidates, banded alignment measures them.

Every template is cut into word ``K_GRAM``-grams; of each window of ``WINDOW``
consecutive ones the least hash is a fingerprint, so any ``K_GRAM + WINDOW - 1`` words
of a template in common with a text give a hit.  The inverted index (fingerprint to
template and place) is as large as the templates, not the corpus, and is broadcast
under a checked bound.  The hits of a template that lie together pick a candidate
passage of the text, which is aligned with the template word by word within a band
around the hits' diagonal.  A match is reported when the matched share of the
template's words reaches the template's threshold and the words that tell the license
apart (``required``) are in the span.  A match inside the span of a better one is
dropped.

One scan, no shuffle.

Defined results: null, empty and word-less texts match nothing; very long texts are
scanned whole; a passage found several times in a text gives a row each; repeated rows
give rows each; rows without an id keep null; of two templates that match equally well
at one place both are reported; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .shared import picked

K_GRAM, WINDOW = 3, 2
BAND, COVERAGE = 8, 0.8
INDEX_BYTES = 64 << 20
SCHEMA = "doc_id bigint, template string, license string, coverage double, matched_words int, template_words int, start_char bigint, end_char bigint"


class Template(NamedTuple):
    name: str
    license: str
    text: str
    required: str = ""
    coverage: float = COVERAGE


_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""
_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_BSD2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD3 = """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""
TEMPLATES = (
    Template("mit-text", "MIT", _MIT),
    Template("mit-disclaimer", "MIT", _AS_IS),
    Template("mit-line", "MIT", "Released under the MIT License.", "mit"),
    Template("mit-line-2", "MIT", "Licensed under the MIT License.", "mit"),
    Template("apache-2.0-notice", "Apache-2.0", _APACHE),
    Template("apache-2.0-line", "Apache-2.0", "Licensed under the Apache License, Version 2.0.", "apache 2"),
    Template("bsd-2-text", "BSD-2-Clause", _BSD2),
    Template("bsd-3-clause", "BSD-3-Clause", _BSD3),
    Template("bsd-line", "BSD-3-Clause", "Licensed under the BSD 3-Clause License.", "bsd"),
    Template("isc-text", "ISC", _ISC),
    Template("gpl-3.0-notice", "GPL-3.0", _GPL),
    Template("gpl-3.0-line", "GPL-3.0", "This work is licensed under the GNU General Public License, version 3.", "gnu 3"),
    Template("gpl-2.0-line", "GPL-2.0", "This work is licensed under the GNU General Public License, version 2.", "gnu 2"),
    Template("lgpl-3.0-line", "LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3.", "lesser 3"),
    Template("mpl-2.0-notice", "MPL-2.0", _MPL, "mozilla"),
    Template("unlicense-text", "Unlicense", _UNLICENSE),
    Template("cc-by-4.0-line", "CC-BY-4.0", "Licensed under CC BY 4.0.", "cc by", 1.0),
    Template("cc-by-sa-4.0-line", "CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0.", "cc sa"),
    Template("cc-by-nc-4.0-line", "CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.", "cc nc"),
    Template("cc-by-nd-4.0-line", "CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0.", "cc nd"),
    Template("cc-by-4.0-text", "CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "commons attribution"),
    Template("all-rights-reserved", "proprietary", "All rights reserved.", "all rights reserved", 1.0),
)


def winnow(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places of the least hash of each window, the rightmost of equal ones."""
    n = len(hashes)
    if n <= window:
        return np.array([n - 1 - int(np.argmin(hashes[::-1]))]) if n else np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(hashes, window)
    return np.array(sorted(set((np.arange(len(view)) + window - 1 - view[:, ::-1].argmin(axis=1)).tolist())))


class Index:
    """Inverted index of the templates' fingerprints."""

    def __init__(self, templates: tuple[Template, ...] = TEMPLATES):
        self.templates = templates
        self.words = K.words_of([t.text for t in templates])
        self.required = [set(x.tolist()) for x in K.words_of([t.required for t in templates])]
        data, offs = K.utf8(pa.array([t.text for t in templates]))
        w = K.Words(data, offs)
        rows = []
        for size in {min(K_GRAM, len(x)) for x in self.words if len(x)}:
            g, at = w.grams(size)
            for k, x in enumerate(self.words):
                if len(x) and min(K_GRAM, len(x)) == size:
                    own = g[w.doc[at] == k]
                    rows += [(size, int(own[p]), k, int(p)) for p in winnow(own)]
        self.by_size = {}
        for size in {r[0] for r in rows}:
            own = sorted(r[1:] for r in rows if r[0] == size)
            keys, n = K.distinct(np.array([r[0] for r in own], np.uint64))
            self.by_size[size] = (keys, np.concatenate(([0], np.cumsum(n))), np.array([r[1] for r in own]), np.array([r[2] for r in own]))
        if sum(x.nbytes for v in self.by_size.values() for x in v) > INDEX_BYTES:
            raise ValueError("the templates' index exceeds INDEX_BYTES: scan with parts of the templates and unite the results")

    def matches(self, words: np.ndarray, hits: dict[int, list[tuple[int, int]]]) -> list[tuple[int, float, int, int, int]]:
        """(template, coverage, matched words, first word, last word) in a text. hits: (word, place in the template) by template."""
        found = []
        for k, own in hits.items():
            query, t = self.words[k], self.templates[k]
            m = len(query)
            band = max(BAND, m // 10)
            groups: list[list[int]] = []
            for at, pos in sorted(own, key=lambda x: (x[0] - x[1], x[0])):
                d = at - pos
                if groups and d - groups[-1][1] <= band:
                    groups[-1][1] = d
                else:
                    groups.append([d, d])
            for low, high in groups:
                middle, width = (low + high) // 2, band + (high - low + 1) // 2
                todo = [(max(0, low - band), min(len(words), high + m + band))]
                while todo:
                    a, b = todo.pop()
                    score, same, x, y = K.align(query, words[a:b], band=width, diagonal=middle - a)
                    if score and same >= t.coverage * m and self.required[k] <= set(words[a + x : a + y].tolist()):
                        found.append((k, same / m, same, a + x, a + y - 1))
                        todo += [(a, a + x), (a + y, b)]  # a passage may be repeated close by
        found.sort(key=lambda f: (-f[2], -f[1], f[3], f[0]))
        kept: list[tuple[int, float, int, int, int]] = []
        for f in found:
            over = [g for g in kept if f[3] <= g[4] and f[4] >= g[3]]
            if not any(g[0] == f[0] or (g[2], g[1]) > (f[2], f[1]) for g in over):
                kept.append(f)
        return sorted(kept, key=lambda f: (f[3], f[0]))


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """One row for each license passage."""
    shared = docs.sparkSession.sparkContext.broadcast(Index(templates))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        look = {s: K.Lookup(v[0]) for s, v in index.by_size.items()}
        for b in batches:
            data, offs = K.utf8(b.column(1))
            rows: list[tuple] = []
            for i, j in K.blocks(offs):
                part, base = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                w = K.Words(part, base)
                by_doc: dict[int, dict[int, list[tuple[int, int]]]] = {}
                edge = np.searchsorted(w.doc, np.arange(j - i + 1))
                for s, lk in look.items():
                    g, at = w.grams(s)
                    hit, key = lk.find(g)
                    _, first, template, pos = index.by_size[s]
                    for word, k in zip(at[hit].tolist(), key.tolist(), strict=True):
                        d = int(w.doc[word])
                        for r in range(first[k], first[k + 1]):
                            by_doc.setdefault(d, {}).setdefault(int(template[r]), []).append((word - int(edge[d]), int(pos[r])))
                for d, hits in by_doc.items():
                    lo, hi = int(edge[d]), int(edge[d + 1])
                    for k, coverage, same, x, y in index.matches(w.hash[lo:hi], hits):
                        letters = (part[base[d] : w.end[lo + y]] & 0xC0) != 0x80
                        t = index.templates[k]
                        rows.append((i + d, t.name, t.license, coverage, same, len(index.words[k]), int(letters[: int(w.start[lo + x] - base[d])].sum()), int(letters.sum())))
            col = list(zip(*rows, strict=True)) if rows else [[] for _ in range(8)]
            kinds = (pa.string(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            own = b.column(0).take(pa.array(col[0], pa.int64()))
            yield pa.RecordBatch.from_arrays([own, *[pa.array(c, kind) for c, kind in zip(col[1:], kinds, strict=True)]], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return picked(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, SCHEMA)
