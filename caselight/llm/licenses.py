"""License scans (7): an exact set-similarity join of text blocks with license templates.

Texts are lower-cased (A-Z) and cut into words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`; a block is a window of up to
SLACK times a template's words, wherever lines break, or a line. A template is found where a block holds at least
PERCENT % of its different words. Template words are ordered by their number of places in all documents, rarest
first (one pass of counts for the template words only). By the prefix filter a block can only reach the bound if it
holds one of the first |T| - need + 1 words of T, so only blocks with such a word are looked at; the length filter
drops blocks of fewer than need different words, and the positional filter those in which T or the block holds fewer than need
words from their first shared word on in that order. Templates are notices and whole bodies of licenses. A window's place runs from its first to its last template word that it needs. A
line adds the templates of its largest containment, so that words that lie further apart in it count, too. A found
template gives its label unless windows with more words of their templates take up half of its place or more.

Base labels come from fixed phrases whose words stand consecutively anywhere in the text.

Scale: templates are a fixed list; documents are read twice and never shuffled, the first pass shuffles a count
for each template word and task.

Defined results: null or empty texts have no words and score 0; ties in frequency are broken by the word; equal
rows give equal rows; empty tables give empty results; other columns aren't read.
"""

from __future__ import annotations

from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselight.llm.textbatch import ALNUM, slices, span_string, words
from caselight.session import ship_package

PERCENT = 80
#: Words of a window for each word of its template: room for words put in between.
SLACK = 2
#: Base phrases and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Labels and bodies of licenses, as published.
BODIES = (
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the
Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or
substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this
permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR
PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("bsd-3-clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source
code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of
conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors
may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND
ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT
HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("gpl-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation,
either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along
with this program. If not, see https://www.gnu.org/licenses/"""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in
source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The
origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product
documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may
not be removed or altered from any source distribution."""),
)
#: Labels and template texts.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2"),
    ("lgpl-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("bsd-3-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("reserved", "All rights reserved"),
    *BODIES,
)


def template_words(text: str) -> list[str]:
    """Different words of a template, in order."""
    raw = text.encode().translate(bytes(int(b) or 32 for b in ALNUM)).decode()
    return list(dict.fromkeys(raw.split()))


def _vocabulary(templates) -> list[str]:
    return sorted({w for _, t in templates for w in template_words(t)})


def _hashes(vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray]:
    h = np.array([span_string(w) for w in vocabulary], np.uint64)
    order = np.argsort(h)
    return h[order], order


def _known(h: np.ndarray, held: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The place in the vocabulary of each word, or -1."""
    if not len(h):
        return np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(held, h), len(held) - 1)
    return np.where(held[at] == h, order[at], -1)


def frequencies(documents: DataFrame, vocabulary: list[str], text_col: str = "text") -> dict[str, int]:
    """Places of each word in all documents."""

    def run(batches):
        held, order = _hashes(vocabulary)
        total = np.zeros(len(vocabulary), np.int64)
        for _, data, offs in slices(batches, "text"):
            k = _known(words(data, offs, ALNUM)[0], held, order)
            total += np.bincount(k[k >= 0], minlength=len(vocabulary))
        yield pa.RecordBatch.from_pydict({"w": np.arange(len(vocabulary)), "n": total})

    counts = documents.select(F.col(text_col).alias("text")).mapInArrow(run, "w long, n long").groupBy("w").agg(F.sum("n").alias("n"))
    found = {r["w"]: r["n"] for r in counts.collect()}  # a row for each template word
    return {w: found.get(i, 0) for i, w in enumerate(vocabulary)}


class Place(NamedTuple):
    """Where a text reaches a template: how many of its words, their share, the place in words, the label."""

    words: int
    share: float
    start: int
    end: int
    label: str


class Matcher:
    """Templates ordered by frequency, with the index of their prefixes."""

    def __init__(self, vocabulary: list[str], frequency: dict[str, int], templates=TEMPLATES, percent: int = PERCENT):
        place = {w: i for i, w in enumerate(vocabulary)}
        rank = {w: (frequency.get(w, 0), w) for w in vocabulary}
        self.templates, self.spread, self.member, self.prefix = [], [], [], []
        self.index: dict[int, list[int]] = {}
        self.rank = {place[w]: r for r, w in enumerate(sorted(vocabulary, key=rank.get))}
        for t, (label, text) in enumerate(templates):
            ordered = [place[w] for w in sorted(template_words(text), key=rank.get)]
            need = -(-len(ordered) * percent // 100)
            self.templates.append((label, ordered, need))
            self.spread.append(SLACK * len(text.encode().translate(bytes(int(b) or 32 for b in ALNUM)).split()))
            member, prefix = np.zeros((2, len(vocabulary) + 1), bool)  # the last place is for other words, -1
            member[ordered] = prefix[ordered[: len(ordered) - need + 1]] = True
            self.member.append(member)
            self.prefix.append(prefix)
            for w in ordered[: len(ordered) - need + 1]:
                self.index.setdefault(w, []).append(t)

    def windows(self, known: np.ndarray, first: set[int]) -> list[Place]:
        """The places in a text that reach a template; first: the text's prefix words."""
        out = []
        for t in {t for w in first for t in self.index[w]}:
            label, ordered, need = self.templates[t]
            at, anchor = np.flatnonzero(self.member[t][known]), np.flatnonzero(self.prefix[t][known])
            after = np.searchsorted(anchor, at)
            near = np.minimum(np.abs(at - anchor[np.minimum(after, len(anchor) - 1)]), np.abs(at - anchor[np.maximum(after - 1, 0)]))
            at = at[near < self.spread[t]]
            places, held, count, low = at.tolist(), known[at].tolist(), {}, 0
            found: list[Place] = []
            for i, w in enumerate(held):
                count[w] = count.get(w, 0) + 1
                # Words that come again later, or lie too far back, aren't needed at the window's start.
                while places[i] - places[low] >= self.spread[t] or count[held[low]] > 1:
                    count[held[low]] -= 1
                    if not count[held[low]]:
                        del count[held[low]]
                    low += 1
                if len(count) >= need:
                    found.append(Place(len(count), len(count) / len(ordered), places[low], places[i] + 1, label))
            # Of places that overlap, the best one and then the shortest.
            taken = bytearray(len(known))
            for f in sorted(found, key=lambda f: (-f.words, f.end - f.start, f.start)):
                if 1 not in taken[f.start : f.end]:
                    taken[f.start : f.end] = b"\1" * (f.end - f.start)
                    out.append(f)
        return out

    def block(self, held: set[int], different: int, first: set[int]) -> list[tuple[str, float, int]]:
        """(label, containment, words) of the templates that a block reaches; first: its prefix words."""
        out = []
        for t in {t for w in first for t in self.index[w]}:
            label, ordered, need = self.templates[t]
            # The length filter, and the positional one: from the first shared word on both sides have to hold enough words.
            if different < need:
                continue
            at = next(i for i, w in enumerate(ordered) if w in held)
            behind = sum(self.rank[w] >= self.rank[ordered[at]] for w in held)
            if min(len(ordered) - at, behind) < need:
                continue
            got = sum(w in held for w in ordered[at:])
            if got >= need:
                out.append((label, got / len(ordered), got))
        return out


def uncovered(found: list[Place]) -> list[Place]:
    """The places of which better ones kept, of more of their template's words or of as many and a larger containment, take up less than half."""
    kept: list[Place] = []
    taken = bytearray(max((f.end for f in found), default=0))
    worth = lambda f: (-f.words, -f.share)
    for _, equals in groupby(sorted(found, key=lambda f: (*worth(f), f.start, f.end, f.label)), worth):
        new = [f for f in equals if 2 * sum(taken[f.start : f.end]) < f.end - f.start]
        for f in new:
            taken[f.start : f.end] = b"\1" * (f.end - f.start)
        kept += new
    return kept


def scan(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, percent: int = PERCENT) -> DataFrame:
    """One row a document: n_words, n_base, first_word, last_word, base_labels, labels, score."""
    ship_package(documents.sparkSession)
    vocabulary = _vocabulary(templates)
    frequency = frequencies(documents, vocabulary, text_col)
    schema = pa.schema([(id_col, pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])

    def run(batches):
        held, order = _hashes(vocabulary)
        matcher = Matcher(vocabulary, frequency, templates, percent)
        is_prefix = np.zeros(len(vocabulary) + 1, bool)
        is_prefix[list(matcher.index)] = True
        phrases = [([span_string(w) for w in p.split()], label) for p, label in PHRASES]
        for rows, data, offs in slices(batches, "text"):
            h, starts, _, first = words(data, offs, ALNUM)
            n = len(offs) - 1
            doc = np.repeat(np.arange(n), np.diff(first))
            base: list[list[int]] = [[] for _ in range(n)]
            base_labels: list[set[str]] = [set() for _ in range(n)]
            labels: list[set[str]] = [set() for _ in range(n)]
            score = np.zeros(n)
            for p, label in phrases:
                if len(h) < len(p):
                    continue
                m = len(h) - len(p) + 1
                hit = np.logical_and.reduce([h[i : i + m] == x for i, x in enumerate(p)]) & (doc[:m] == doc[len(p) - 1 :])
                for i in np.flatnonzero(hit):
                    d = doc[i]
                    base[d].append(int(i - first[d]))
                    base_labels[d].add(label)
                    score[d] = 1.0
            known = _known(h, held, order)
            candidates = np.flatnonzero((known >= 0) & is_prefix[known])
            if len(candidates):
                breaks = np.flatnonzero(data == 10)
                line = np.searchsorted(breaks, starts[candidates]) + doc[candidates]  # grows with every line and text
                ends = np.r_[breaks, len(data)]
                found: dict[int, list[Place]] = {}
                apart: dict[int, list[Place]] = {}  # by lines, where no window reaches as much
                for group in np.split(candidates, np.flatnonzero(np.diff(doc[candidates])) + 1):
                    d = doc[group[0]]
                    found[d] = matcher.windows(known[first[d] : first[d + 1]], set(known[group].tolist()))
                for group in np.split(candidates, np.flatnonzero(np.diff(line) | np.diff(doc[candidates])) + 1):
                    d, s = doc[group[0]], starts[group[0]]
                    k = int(np.searchsorted(breaks, s))
                    low = max(first[d], np.searchsorted(starts, breaks[k - 1]) if k else 0)
                    high = min(first[d + 1], np.searchsorted(starts, ends[k]))
                    inside = known[low:high]
                    here = set(inside[inside >= 0].tolist())
                    reached = matcher.block(here, len(np.unique(h[low:high])), set(known[group].tolist()))
                    best = max((share for _, share, _ in reached), default=0.0)
                    low, high = int(low - first[d]), int(high - first[d])
                    near = {(f.share, f.label) for f in found[d] if low <= f.start and f.end <= high}
                    apart.setdefault(d, []).extend(Place(n, share, low, high, label) for label, share, n in reached if share == best and (share, label) not in near)
                for d, places in found.items():
                    for f in uncovered(places + apart.get(d, [])):
                        labels[d].add(f.label)
                        score[d] = max(score[d], f.share)
            yield pa.RecordBatch.from_arrays([
                rows.column(0).cast(pa.int64()), pa.array(np.diff(first), pa.int64()), pa.array([len(b) for b in base], pa.int64()),
                pa.array([min(b) if b else None for b in base], pa.int64()), pa.array([max(b) if b else None for b in base], pa.int64()),
                pa.array([",".join(sorted(b)) for b in base_labels]), pa.array([",".join(sorted(a | b)) for a, b in zip(labels, base_labels, strict=True)]), pa.array(score),
            ], schema=schema)

    return documents.select(id_col, F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
