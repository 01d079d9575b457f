"""Licence scan by a positional index of rare tokens.

``TEMPLATES`` holds notices and texts of common licences.  The words of a file
are weighed by their inverse document frequency over the whole corpus.  The
index has postings (template, position) of the words that are rare (an IDF of
``least_idf`` or more) and of the ``least`` rarest of each mandatory phrase,
since a phrase may hold frequent words alone.  Of a file the ``rare`` licence
words of the highest IDF are looked up and, so that no phrase is missed where
several licences stand, all that are among the rarest of a phrase.  Each hit
proposes a template at an offset (its position in the file less that in the
template), and offsets that lie within ``slack`` words of each other (a sixteenth
of the template's words, if more) and gather at least ``least`` different words
make a candidate.  A candidate counts if every mandatory phrase of the template
stands, word for word, in the window it covers.

Words are runs of letters and digits, in lower case, so line breaks,
punctuation and comment marks between them don't matter.

Defined results: null and empty texts, and texts without a licence, give no
row; several notices in a file give a row each, also two of the same licence;
of candidates that overlap in a file only the one whose phrases have most words
stays (ties: the first in the order of template names).  So the text of BSD-3-Clause,
which holds all of BSD-2-Clause, is reported as the former alone.  Repeated rows are each
answered; ids may be of any type; other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import id_type
from ._text import find_words, slices, stable_hash

_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_TWO = """1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

#: name, text, mandatory phrases
TEMPLATES = [
    ("MIT", "Released under the MIT License", ["mit license"]),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction", ["permission is hereby granted free of charge", "without restriction"]),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0", ["apache license version 2 0"]),
    ("Apache-2.0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", ["apache org licenses license 2 0"]),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3", ["gnu general public license version 3"]),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2", ["gnu general public license version 2"]),
    ("GPL-3.0-or-later", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", ["gnu general public license", "either version 3", "any later version"]),
    ("LGPL-3.0", "licensed under the GNU Lesser General Public License, version 3", ["gnu lesser general public license version 3"]),
    ("AGPL-3.0", "licensed under the GNU Affero General Public License, version 3", ["gnu affero general public license version 3"]),
    ("BSD", _BSD, ["redistribution and use in source and binary forms", "conditions are met"]),
    ("BSD-2-Clause", f"{_BSD} {_BSD_TWO} {_BSD_END}", ["redistribution and use in source and binary forms", "redistributions of source code must retain", "redistributions in binary form must reproduce", "this software is provided by the copyright holders and contributors as is"]),
    ("BSD-3-Clause", f"{_BSD} {_BSD_TWO} {_BSD_THIRD} {_BSD_END}", ["redistribution and use in source and binary forms", "redistributions of source code must retain", "redistributions in binary form must reproduce", "neither the name of", "may be used to endorse or promote products derived from", "this software is provided by the copyright holders and contributors as is"]),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ["mozilla public license v 2 0"]),
    ("CC-BY-4.0", "Licensed under CC BY 4.0", ["licensed under cc by 4 0"]),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0", ["cc by sa 4 0"]),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0", ["cc by nc 4 0"]),
    ("CC0-1.0", "released under CC0 1.0 Universal", ["cc0 1 0 universal"]),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", ["unencumbered software released into the public domain"]),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", ["permission to use copy modify and or distribute this software for any purpose with or without fee"]),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software.", ["provided as is without any express or implied warranty", "the origin of this software must not be misrepresented"]),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software", ["any person or organization obtaining a copy of the software and accompanying documentation"]),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.", ["software distributed under the license is distributed on an as is basis", "specific language governing permissions and limitations"]),
]
RARE, LEAST, SLACK, LEAST_IDF = 16, 2, 3, 1.6


def words_of(text: str) -> list[str]:
    w = find_words(pa.array([text]), lower=True)
    return [w.word(i) for i in range(len(w.start))]


def document_frequencies(docs: DataFrame, words: list[str], text: str = "text") -> tuple[int, dict[str, int]]:
    """Number of documents, and in how many of them each of ``words`` stands (over all documents)."""
    ids = np.array([stable_hash(w) for w in words], np.uint64)
    order = np.argsort(ids)
    ids = ids[order]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(words) + 1, np.int64)
        for b in slices(batches, text):
            w = find_words(b.column(0), lower=True)
            total[-1] += b.num_rows
            h = w.hashes()
            at = np.minimum(np.searchsorted(ids, h), len(ids) - 1)
            hit = np.flatnonzero(ids[at] == h)
            pairs = np.unique((np.searchsorted(w.off, hit, side="right") - 1) * len(ids) + at[hit])
            total[:-1] += np.bincount(pairs % len(ids), minlength=len(ids))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["word", "df"])

    got = {r["word"]: r["df"] for r in docs.select(text).mapInArrow(count, "word int, df long").groupBy("word").agg(F.sum("df").alias("df")).collect()}
    return got.get(len(words), 0), {words[int(order[i])]: got.get(i, 0) for i in range(len(words))}


class Index:
    """Postings of the templates' rare words, by word hash."""

    def __init__(self, templates: list[tuple], n_docs: int, df: dict[str, int], rare: int = RARE, least: int = LEAST, slack: int = SLACK, least_idf: float = LEAST_IDF):
        self.templates = [(name, words_of(text), [words_of(p) for p in phrases]) for name, text, phrases in templates]
        self.rare = rare
        self.length = np.array([len(t[1]) for t in self.templates])
        self.slack = np.maximum(slack, self.length // 16)
        self.phrases = [[np.array([stable_hash(x) for x in p], np.uint64) for p in t[2]] for t in self.templates]
        self.phrase_at = [[next((i for i in range(len(t[1])) if t[1][i : i + len(p)] == p), 0) for p in t[2]] for t in self.templates]
        idf = {w: math.log((1 + n_docs) / (1 + df.get(w, 0))) for t in self.templates for w in t[1]}
        rows, sure = [], set()
        for i, (_, words, phrases) in enumerate(self.templates):
            chosen = {w for w in words if idf[w] >= least_idf}
            for p in phrases:
                rarest = sorted({w for w in p if w in idf}, key=lambda w: (-idf[w], w))[:least]
                sure |= set(rarest)
                chosen |= set(rarest)
            rows += [(stable_hash(w), i, p) for p, w in enumerate(words) if w in chosen]
        rows.sort()
        self.hash = np.array([r[0] for r in rows], np.uint64)
        self.template = np.array([r[1] for r in rows])
        self.position = np.array([r[2] for r in rows])
        self.need = np.array([min(least, len(set(self.hash[self.template == t].tolist()))) for t in range(len(self.templates))])
        # by word: its place among all words, the rarest first, and whether it is among the rarest of a phrase
        by_idf = {stable_hash(w): k for k, w in enumerate(sorted(idf, key=lambda w: (-idf[w], w)))}
        self.names = np.unique(self.hash)
        self.order = np.array([by_idf[int(x)] for x in self.names])
        self.sure = np.isin(self.names, np.array([stable_hash(w) for w in sure], np.uint64))

    def looked_up(self, h: np.ndarray) -> np.ndarray:
        """Places of the words of a file that are looked up."""
        at = np.minimum(np.searchsorted(self.names, h), len(self.names) - 1)
        hit = np.flatnonzero(self.names[at] == h)
        word = at[hit]
        there = np.unique(word)
        chosen = np.zeros(len(self.names), bool)
        chosen[there[np.argsort(self.order[there])[: self.rare]]] = True
        return hit[(chosen | self.sure)[word]]

    def scan(self, h: np.ndarray) -> list[tuple[int, int, int]]:
        """(template, first word, end word) of each licence in a text of these word hashes."""
        at = self.looked_up(h)
        lo, hi = (np.searchsorted(self.hash, h[at], side=x) for x in ("left", "right"))
        votes = defaultdict(list)
        for p, a, b in zip(at.tolist(), lo.tolist(), hi.tolist(), strict=True):
            for k in range(a, b):
                votes[int(self.template[k])].append((p - int(self.position[k]), int(self.hash[k])))
        found = []
        for t, v in votes.items():
            slack = int(self.slack[t])
            v.sort()
            i = 0
            while i < len(v):
                j, words = i, {v[i][1]}
                while j + 1 < len(v) and v[j + 1][0] - v[i][0] <= slack:
                    j += 1
                    words.add(v[j][1])
                if len(words) >= self.need[t]:
                    a, b = max(0, v[i][0] - slack), min(len(h), v[j][0] + int(self.length[t]) + slack)
                    spans = [self.phrase(h[a:b], p, v[i][0] - a + at) for p, at in zip(self.phrases[t], self.phrase_at[t], strict=True)]
                    if all(spans):
                        first = a + min(s[0] for s in spans)
                        last = a + max(s[1] for s in spans)
                        found.append((t, first, last))
                        while i < len(v) and v[i][0] + slack < last - int(self.length[t]) + 1:
                            i += 1
                        i = max(i, j + 1)
                        continue
                i += 1
        return self.best(found)

    def best(self, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Of those that overlap the one whose phrases have most words."""
        found = sorted(found, key=lambda f: (-sum(len(p) for p in self.phrases[f[0]]), self.templates[f[0]][0], f[1], f[0]))
        taken: list[tuple[int, int, int]] = []
        for f in found:
            if all(f[2] <= g[1] or f[1] >= g[2] for g in taken):
                taken.append(f)
        return sorted(taken, key=lambda f: f[1])

    @staticmethod
    def phrase(h: np.ndarray, p: np.ndarray, near: int) -> tuple[int, int] | None:
        """Where the phrase stands, nearest to the place that the template gives it."""
        if len(h) < len(p):
            return None
        at = np.flatnonzero((np.lib.stride_tricks.sliding_window_view(h, len(p)) == p).all(axis=1))
        if not len(at):
            return None
        best = int(at[np.argmin(np.abs(at - near))])
        return best, best + len(p)


def scan_licenses(docs: DataFrame, templates: list[tuple] = TEMPLATES, text: str = "text", rare: int = RARE, least: int = LEAST, slack: int = SLACK) -> DataFrame:
    """``doc_id, license, first_word, end_word`` of each licence in each row of ``docs``."""
    vocabulary = sorted({w for _, t, _ in templates for w in words_of(t)})
    n_docs, df = document_frequencies(docs, vocabulary, text)
    index = Index(templates, n_docs, df, rare, least, slack)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "t"):
            w = find_words(b.column("t"), lower=True)
            h = w.hashes()
            # a file without a word that is among the rarest of a phrase holds no phrase
            at = np.minimum(np.searchsorted(index.names, h), len(index.names) - 1)
            hits = np.flatnonzero((index.names[at] == h) & index.sure[at])
            rows, names, a, e = [], [], [], []
            for d in np.unique(np.searchsorted(w.off, hits, side="right") - 1).tolist():
                for t, s, z in index.scan(h[w.off[d] : w.off[d + 1]]):
                    rows.append(d)
                    names.append(index.templates[t][0])
                    a.append(s)
                    e.append(z)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(names, pa.string()), pa.array(a, pa.int32()), pa.array(e, pa.int32())], ["doc_id", "license", "first_word", "end_word"])

    return docs.select("doc_id", F.col(text).alias("t")).mapInArrow(run, f"doc_id {id_type(docs)}, license string, first_word int, end_word int")
