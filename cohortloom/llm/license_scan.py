"""License scans by patience alignment.

A text and a template are sequences of words (letters and digits, lower case).
Where enough words of a template stand close together, the stretch around them
is aligned with it: words that occur once in both are anchors, the longest
increasing subsequence of anchors is kept, and each gap between two anchors is
aligned in the same way; a gap without anchors gives its equal ends. Coverage
is the share of the template's words that are aligned.

A cover may hold foreign words, up to half of the template's length; what
surrounds it makes no difference, since windows of one size are aligned
throughout a text.

Defined results: null and empty texts hold no license; a text may hold several,
one row for each stretch and the template that covers it best (ties: the longer
one, then its name); repeated rows get equal results; an empty table gives no
rows; other columns may have any name. Work on a text is linear in its length.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

COVER = 0.8
_WORD = re.compile(r"[a-z0-9]+")

#: Notices, opening paragraphs and short whole texts of well-known licenses.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0 header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MIT": "Released under the MIT License",
    "MIT text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MIT full text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "BSD-3-Clause": "Released under the BSD 3 Clause License",
    "BSD text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "ISC text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "ISC full text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0",
    "CC-BY name": "licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-NC name": "licensed under a Creative Commons Attribution NonCommercial 4.0 International License",
    "CC0-1.0": "released into the public domain under CC0 1.0",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Proprietary": "All rights reserved",
}


def aligned(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Patience alignment: increasing pairs of places of equal words."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        once_a, once_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: j for j, w in enumerate(b[b0:b1], b0) if once_b[w] == 1}
        pairs = [(i, place[w]) for i, w in enumerate(a[a0:a1], a0) if once_a[w] == 1 and w in place]
        anchors = increasing(pairs)
        if not anchors:
            continue
        edge = (a0 - 1, b0 - 1)
        for i, j in [*anchors, (a1, b1)]:
            todo.append((edge[0] + 1, i, edge[1] + 1, j))
            edge = (i, j)
        out += anchors
    return sorted(out)


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest subsequence whose second places increase, by patience sorting."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(pairs):
        pile = bisect_left(tops, j)
        back.append(at[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(j)
            at.append(k)
        else:
            tops[pile], at[pile] = j, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


class Scanner:
    """Templates, with the words by which a stretch that may hold one is noticed."""

    def __init__(self, templates: dict[str, str] = TEMPLATES, cover: float = COVER):
        self.cover = cover
        self.templates = [(name, _WORD.findall(text.lower())) for name, text in sorted(templates.items())]
        # Covered to a share of ``cover``, a template misses at most (1 - cover) n words: of any more than that, one is there.
        common = Counter(w for _, words in self.templates for w in set(words))
        self.seeds: dict[str, list[tuple[int, int]]] = {}
        for t, (_, words) in enumerate(self.templates):
            need = int((1 - cover) * len(words) + 1e-9) + 1
            order = sorted(range(len(words)), key=lambda k: (len(words[k]) < 4, common[words[k]], -len(words[k]), k))
            for k in order[:need]:
                self.seeds.setdefault(words[k], []).append((t, k))
        self.seed = re.compile(r"(?<![a-z0-9])(?:" + "|".join(sorted(map(re.escape, self.seeds), key=len, reverse=True)) + r")(?![a-z0-9])")

    def __call__(self, text: str | None) -> list[tuple[str, float, int, int, int]]:
        """(template, coverage, aligned words, start, end) of each license, in code points of the text."""
        low = lowered(text or "")
        if not self.seed.search(low):
            return []
        spans = [(m[0], m.start(), m.end()) for m in _WORD.finditer(low)]
        words = [w for w, _, _ in spans]
        stretches: dict[int, list[list[int]]] = {}
        for at, w in enumerate(words):
            for t, k in self.seeds.get(w, ()):
                n = len(self.templates[t][1])
                slack = n // 2 + 2
                lo, hi = max(0, at - k - slack), min(len(words), at - k + n + slack)
                runs = stretches.setdefault(t, [])
                if runs and lo <= runs[-1][1]:
                    runs[-1][1] = max(hi, runs[-1][1])
                else:
                    runs.append([lo, hi])
        found = []
        for t, runs in stretches.items():
            name, template = self.templates[t]
            for lo, hi in runs:
                for a, b, n in self._within(words, lo, hi, template):
                    found.append((n / len(template), n, name, a, b))
        # Of stretches that overlap the one with most aligned words stays.
        out: list[tuple[str, float, int, int, int]] = []
        taken: list[tuple[int, int]] = []
        for share, n, name, a, b in sorted(found, key=lambda x: (-x[1], -x[0], x[2], x[3])):
            # What is taken is kept in order, so that only two neighbours can overlap.
            k = bisect_left(taken, (a, b))
            if (k == 0 or taken[k - 1][1] <= a) and (k == len(taken) or b <= taken[k][0]):
                taken.insert(k, (a, b))
                out.append((name, share, n, spans[a][1], spans[b - 1][2]))
        return sorted(out, key=lambda x: (x[3], x[0]))

    def _within(self, words: list[str], lo: int, hi: int, template: list[str]) -> Iterator[tuple[int, int, int]]:
        """(first word, end, aligned words) of each cover of a template between two places.

        A cover spreads over ``1.5 n + 2`` words at most. Windows of that size, however long
        the stretch is, are aligned where they hold enough of the template's words.
        """
        n, vocabulary = len(template), Counter(template)
        size, need = n + n // 2 + 2, self.cover * n - 1e-9
        while hi - lo >= need:
            first = self._first(words, lo, hi, vocabulary, size, need)
            if first is None:
                return
            best = None
            # The first window that can hold a cover ends at ``first``; the cover begins in it, and ends a window later at most.
            for end in sorted({*range(first, min(hi, first + size), max(1, n // 8)), min(hi, first + size)}):
                whole = (max(lo, end - size), end)
                for a, b in {whole, self._tight(words, *whole, vocabulary, (1, -1)), self._tight(words, *whole, vocabulary, (-1, 1))}:
                    pairs = aligned(words[a:b], template)
                    if len(pairs) >= need:
                        cover = (a + pairs[0][0], a + pairs[-1][0] + 1, len(pairs))
                        # Most words first; of equal covers the shortest, then the first.
                        if cover[1] - cover[0] <= size and (best is None or (cover[2], cover[0] - cover[1], -cover[0]) > (best[2], best[0] - best[1], -best[0])):
                            best = cover
            if best:
                yield best
                lo = best[1]
            else:
                lo = max(lo + 1, first - size + max(1, n // 8))

    @staticmethod
    def _first(words: list[str], lo: int, hi: int, vocabulary: Counter, size: int, need: float) -> int | None:
        """The end of the first window that holds enough words of the template."""
        have, hits = Counter(), 0
        for at in range(lo, hi):
            w = words[at]
            if have[w] < vocabulary[w]:
                hits += 1
            have[w] += 1
            if at - lo >= size:
                gone = words[at - size]
                have[gone] -= 1
                if have[gone] < vocabulary[gone]:
                    hits -= 1
            if hits >= need:
                return at + 1
        return None

    @staticmethod
    def _tight(words: list[str], a: int, b: int, vocabulary: Counter, ends: tuple[int, int]) -> tuple[int, int]:
        """The window without words at its ends that the template has not, or that stand in it often enough without them."""
        have = Counter(words[a:b])
        for step in ends:
            while a < b:
                w = words[a if step == 1 else b - 1]
                if have[w] <= vocabulary[w]:
                    break
                have[w] -= 1
                a, b = (a + 1, b) if step == 1 else (a, b - 1)
        return a, b


def lowered(text: str) -> str:
    """Lower case, character by character where a longer result would shift what follows."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, cover: float = COVER) -> DataFrame:
    """(``doc_id``, ``license``, ``coverage``, ``n_words``, ``start``, ``end``) for each license that a text holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, cover)
        for b in batches:
            row, found = [], []
            for k, x in enumerate(b.column(1)):
                for hit in scanner(x.as_py()):
                    row.append(k)
                    found.append(hit)
            kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, type=pa.int64())), *(pa.array([f[j] for f in found], type=kind) for j, kind in enumerate(kinds))], ["doc_id", "license", "coverage", "n_words", "start", "end"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, license string, coverage double, n_words bigint, start bigint, end bigint")
