"""License scan: phrases, and an exact set-similarity join of text blocks with license templates by containment.

The blocks of a template are all runs of WIDTH times its words, wherever the text's lines end: a notice wrapped over lines is one block, and words scattered over a
long text are none. A block matches a template if it holds at least the share THRESHOLD of the template's distinct words.

Words of templates are ordered by the number of documents they are in, rarest first, over the whole corpus; other words count nowhere. A block that matches holds a word
of the template's prefix, the rarest words that can't all be missing. An index of prefix words gives candidates: stretches of text within a block's reach of such a
word. The length filter drops stretches with too few words of templates. The positional filter goes through the template's and the stretch's words, both in global
order, from their rarest on, and stops as soon as the words in common so far and the fewer of those left on either side aren't enough. What remains is confirmed by
sliding a block over the stretch.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter, deque
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Share of a template's distinct words that a block must hold.
THRESHOLD = 0.9
#: Words of a block for each word of the template: as many others as its own may stand among them (comment marks, names, a changed wording).
WIDTH = 2
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {k: k + 32 for k in range(65, 91)}
#: Phrases and their labels (fixed values).
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Templates: label of the license, wording of a notice in common use or of a paragraph of the license (fixed values).
TEMPLATES = (
    ("notice:gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("notice:cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("notice:mit", "Released under the MIT License."),
    ("notice:apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("notice:reserved", "All rights reserved."),
    ("notice:gpl-redistribute", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("notice:gpl-warranty", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("notice:lgpl-redistribute", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("notice:agpl-redistribute", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("notice:mit-permission", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    (
        "text:mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
        in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to
        permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all
        copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
        WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    ("notice:bsd-redistribution", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    (
        "text:bsd-2-clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code
        must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list
        of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    ),
    (
        "text:bsd-endorsement",
        """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written
        permission.""",
    ),
    (
        "text:isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission
        notice appear in all copies.""",
    ),
    (
        "text:zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
        Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
        restrictions""",
    ),
    (
        "text:unlicense",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source
        code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    ),
    ("notice:apache-compliance", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    (
        "text:apache-2.0-header",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    ),
    ("notice:mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("notice:cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("notice:cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
)


def words_of(text: str) -> list[str]:
    return WORD.findall(text.translate(_LOWER))


def document_counts(docs: DataFrame, templates=TEMPLATES) -> dict[str, int]:
    """For each template word the number of documents that hold it, over all documents and whole texts. As many rows as template words reach the driver."""
    vocabulary = frozenset(w for _, t in templates for w in words_of(t))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = Counter()
            for text in batch.text:
                found.update(vocabulary.intersection(words_of(text)))
            yield pd.DataFrame({"word": list(found.keys()), "n": list(found.values())})

    texts = docs.select(F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull())
    return {r.word: r.n for r in texts.mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}


class Index:
    """Templates as ranks of their words in the global order, and for each prefix word the templates whose prefix it is in."""

    def __init__(self, counts: dict[str, int], templates=TEMPLATES, threshold: float = THRESHOLD):
        own = [(label, words_of(wording)) for label, wording in templates]
        vocabulary = sorted({w for _, words in own for w in words}, key=lambda w: (counts.get(w, 0), w))
        self.rank = {w: k for k, w in enumerate(vocabulary)}
        self.templates, prefix = [], {}
        for k, (label, words) in enumerate(own):
            ranks = sorted({self.rank[w] for w in words})
            need = math.ceil(threshold * len(ranks) - 1e-9)
            self.templates.append((label, ranks, frozenset(ranks), need, WIDTH * len(words)))
            for r in ranks[: len(ranks) - need + 1]:
                prefix.setdefault(r, []).append(k)
        self.prefix = prefix
        self.rare = frozenset(vocabulary[r] for r in prefix)

    def common(self, template: int, block: list[int]) -> int:
        """How many words a template and a block, as ranks in global order, have in common; 0 as soon as they can't be enough."""
        _, ranks, _, need, _ = self.templates[template]
        if len(block) < need:  # length filter
            return 0
        i = j = found = 0
        while i < len(ranks) and j < len(block):
            if found + min(len(ranks) - i, len(block) - j) < need:  # positional filter
                return 0
            if ranks[i] == block[j]:
                found, i, j = found + 1, i + 1, j + 1
            elif ranks[i] < block[j]:
                i += 1
            else:
                j += 1
        return found if found >= need else 0

    def block(self, words: set[str]) -> list[tuple[str, float]]:
        """(label, containment) of each template that a block with these words matches."""
        block = sorted(self.rank[w] for w in words if w in self.rank)
        near = sorted({k for r in block for k in self.prefix.get(r, ())})
        return [(self.templates[k][0], both / len(self.templates[k][1])) for k in near if (both := self.common(k, block))]

    def scan(self, words: list[str], distinct: set[str]) -> list[tuple[int, str, float]]:
        """(place of the first word, label, containment) of the blocks of a text that match: of blocks that meet, the first of those with most common words."""
        if self.rare.isdisjoint(distinct):
            return []
        at = [(i, r) for i, w in enumerate(words) if (r := self.rank.get(w)) is not None]  # the text's words in templates
        places = [i for i, _ in at]
        seeds: dict[int, list[int]] = {}
        for i, r in at:
            for k in self.prefix.get(r, ()):
                seeds.setdefault(k, []).append(i)
        out = []
        for k, own in seeds.items():
            width, reach = self.templates[k][4], None
            for i in own:  # stretches within reach of prefix words; those that meet are one
                if reach is not None and i - width < reach[1]:
                    reach[1] = i + width
                    continue
                if reach is not None:
                    self._confirm(k, at[bisect_left(places, reach[0]) : bisect_left(places, reach[1])], out)
                reach = [i - width + 1, i + width]
            self._confirm(k, at[bisect_left(places, reach[0]) : bisect_left(places, reach[1])], out)
        return sorted(out)

    def _confirm(self, template: int, stretch: list[tuple[int, int]], out: list) -> None:
        """Adds the blocks of a stretch of (place, rank) that match."""
        if not self.common(template, sorted({r for _, r in stretch})):
            return
        label, ranks, own, need, width = self.templates[template]
        inside: deque[tuple[int, int]] = deque()
        held: dict[int, int] = {}
        best = None  # (common words, first place, last place)
        for at, r in stretch:
            if r not in own:
                continue
            inside.append((at, r))
            held[r] = held.get(r, 0) + 1
            while inside[0][0] <= at - width or held[inside[0][1]] > 1:
                old = inside.popleft()[1]
                held[old] -= 1
                if not held[old]:
                    del held[old]
            if len(held) < need:
                continue
            if best is not None and inside[0][0] > best[2]:
                out.append((best[1], label, best[0] / len(ranks)))
                best = None
            if best is None or len(held) > best[0]:
                best = (len(held), inside[0][0], at)
        if best is not None:
            out.append((best[1], label, best[0] / len(ranks)))


def _places(words: list[str], phrases: list[tuple[list[str], str]]) -> list[tuple[int, str]]:
    """(start, label) of each place where the words of a phrase stand one after the other."""
    out = []
    for phrase, label in phrases:
        at = -1
        try:
            while True:
                at = words.index(phrase[0], at + 1)
                if words[at : at + len(phrase)] == phrase:
                    out.append((at, label))
        except ValueError:
            pass
    return out


def scan_licenses(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks for every row of docs (doc_id, text).

    n_base: places of PHRASES; first_word, last_word: their smallest and largest first word (else null); base_labels: their labels; labels: those and the
    labels of templates that some block contains; score: 1 if there is a phrase, else the largest containment found (0: none); blocks: (line of the first word,
    label, containment) of every matching block. Null and empty texts have no words. Other columns are ignored.
    """
    index = Index(document_counts(docs, templates), templates, threshold)
    phrases = [(p.split(), label) for p, label in PHRASES.items()]
    hints = [p[-1] for p, _ in phrases]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.doc_id, batch.text, strict=True):
                words = words_of(text) if isinstance(text, str) else []
                distinct = set(words)
                places = _places(words, [p for p, hint in zip(phrases, hints, strict=True) if hint in distinct])
                blocks = []
                if found := index.scan(words, distinct):
                    ends = list(accumulate(len(words_of(line)) for line in text.split("\n")))
                    blocks = [{"line": bisect_right(ends, at), "label": label, "containment": share} for at, label, share in found]
                starts, base = [p for p, _ in places], {label for _, label in places}
                labels = sorted(base | {b["label"] for b in blocks})
                score = 1.0 if base else max((b["containment"] for b in blocks), default=0.0)
                rows.append((doc_id, len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(labels), score, blocks))
            out = pd.DataFrame(rows, columns=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"])
            yield out.astype({"doc_id": "Int64", "first_word": "Int64", "last_word": "Int64"})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks array<struct<line: int, label: string, containment: double>>")
