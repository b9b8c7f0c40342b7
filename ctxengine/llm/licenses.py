"""License scans by patience alignment.

A text and a template are aligned on words that are unique in both: the longest increasing
subsequence of their places gives anchors, and the gaps between anchors are aligned in the
same way. Coverage is the share of the template's words that are aligned.

A window of a text is aligned wherever pairs of the template's neighbouring words occur, so
each passage of a long text is looked at, and a notice may occur more than once.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The warranty disclaimer that the permissive licences share, in two wordings.
_AS_IS_BSD = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
    "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE "
    "OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_AS_IS_ISC = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY "
    "SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
    "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_BSD_2 = (
    f"{_BSD}: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
    "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
)
_NO_WARRANTY_GNU = "is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU"
#: Public licence texts and notices, by identifier.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-text": _MIT,
    "MIT-full": (
        f"{_MIT} THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE "
        "OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC": f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. {_AS_IS_ISC}",
    "0BSD": f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. {_AS_IS_ISC}",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, "
        "or (at your option) any later version."
    ),
    "GPL-2.0-header": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, "
        f"or (at your option) any later version. This program {_NO_WARRANTY_GNU} General Public License for more details."
    ),
    "LGPL-2.1-header": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, "
        f"or (at your option) any later version. This library {_NO_WARRANTY_GNU} Lesser General Public License for more details."
    ),
    "AGPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, "
        f"or (at your option) any later version. This program {_NO_WARRANTY_GNU} Affero General Public License for more details."
    ),
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "BSD": _BSD,
    "BSD-2-Clause": f"{_BSD_2} {_AS_IS_BSD}",
    "BSD-3-Clause": (
        f"{_BSD_2} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_AS_IS_BSD}"
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use "
        "this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you "
        "must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must "
        "be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
    ),
    "BSL-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, "
        "distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright "
        "notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all "
        "derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
        "for any purpose, commercial or non-commercial, and by any means."
    ),
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "All-rights-reserved": "All rights reserved.",
}
#: Words that only the end of a sentence adds to are equal without it.
TOKEN = re.compile(r"\w+(?:[.+-]\w+)*")
#: Fixed value: the share of a template's words that makes a text carry it.
COVERAGE = 0.8


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


def increasing(values: list[int]) -> list[int]:
    """Indexes of a longest strictly increasing subsequence, by patience sorting."""
    tops: list[int] = []
    piles: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        back[i] = piles[k - 1] if k else -1
        tops[k : k + 1] = [v]
        piles[k : k + 1] = [i]
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """(place in text, place in template) of aligned words, increasing in both."""
    found: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        # Equal ends need no anchor.
        while a < b and c < d and text[a] == template[c]:
            found.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            found.append((b, d))
        places: list[dict[str, int]] = []
        for words, low, high in ((text, a, b), (template, c, d)):
            at: dict[str, int] = {}
            for i in range(low, high):
                at[words[i]] = -1 if words[i] in at else i
            places.append(at)
        common = [(j, places[0][w]) for w, j in places[1].items() if j >= 0 and places[0].get(w, -1) >= 0]
        common.sort()
        anchors = [common[i] for i in increasing([p for _, p in common])]
        if not anchors:
            continue
        for j, i in anchors:
            found.append((i, j))
            todo.append((a, i, c, j))
            a, c = i + 1, j + 1
        todo.append((a, b, c, d))
    return sorted(found)


class Scanner:
    def __init__(self, templates: dict[str, str], coverage: float):
        self.words = {name: tokens(t) for name, t in templates.items()}
        self.coverage = coverage
        self.pairs: dict[tuple[str, str], list[str]] = {}
        for name, w in self.words.items():
            for p in dict.fromkeys(zip(w, w[1:], strict=False)):
                self.pairs.setdefault(p, []).append(name)

    def scan(self, text: str | None) -> list[tuple[str, float, int, int, int]]:
        """(template, coverage, first word, end word, aligned words), best first; windows of one
        template do not overlap."""
        words = tokens(text)
        known = self.pairs
        hits: dict[str, list[int]] = {}
        for i, p in enumerate(zip(words, words[1:], strict=False)):
            if p in known:
                for name in known[p]:
                    hits.setdefault(name, []).append(i)
        out = []
        for name, at in hits.items():
            size = len(self.words[name])
            low = at[0]
            spans = []
            for before, here in zip(at, [*at[1:], None], strict=True):
                if here is None or here - before > size:
                    spans.append((max(0, low - size), min(len(words), before + size + 2)))
                    low = here
            for a, b in spans:
                out += self._windows(name, words, a, b)
        return sorted(out, key=lambda x: (-x[1], -x[4], x[2], x[0]))

    def _windows(self, name: str, words: list[str], a: int, b: int) -> list[tuple[str, float, int, int, int]]:
        template, size = self.words[name], len(self.words[name])
        pairs = align(words[a:b], template)
        # The densest run of aligned words: a stray one far away does not stretch the span.
        best, low = (0, 0, 0), 0
        for high in range(len(pairs)):
            while pairs[high][0] - pairs[low][0] > 2 * len(template):
                low += 1
            best = max(best, (high + 1 - low, -low, high))
        n, low, high = best[0], -best[1], best[2]
        share = n / len(template)
        if share < self.coverage:
            # Two copies side by side have no unique words: each is looked at by itself.
            if b - a > 2 * len(template) + 2:
                spans = [(s, s + 2 * size) for s in range(a, b, size)]
                spans += [(s, s + size) for s in range(a, b - 1) if words[s : s + 2] == template[:2]]
                return self._apart(name, words, spans, a, b)
            return []
        s, e = a + pairs[low][0], a + pairs[high][0] + 1
        out = [(name, share, s, e, n)]
        for x, y in ((a, s), (e, b)):
            # Many copies are not aligned as a whole again for each; no run is wider than half of these windows.
            wide = [(k, k + 4 * size) for k in range(x, y, size)] if y - x > 8 * size else []
            out += self._apart(name, words, wide, x, y) if wide else self._windows(name, words, x, y)
        return out

    def _apart(self, name: str, words: list[str], spans: list[tuple[int, int]], a: int, b: int) -> list[tuple[str, float, int, int, int]]:
        """What is found in the spans, without overlaps: most words first."""
        tried = [x for s, e in spans for x in self._windows(name, words, s, min(b, e))]
        out, taken = [], bytearray(b - a)
        for x in sorted(tried, key=lambda x: (-x[4], x[3] - x[2], x[2])):
            if not any(taken[x[2] - a : x[3] - a]):
                out.append(x)
                taken[x[2] - a : x[3] - a] = b"\x01" * (x[3] - x[2])
        return out


def scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """One row per document: doc_id, license and coverage of its best template, first_word,
    end_word and matched words of it, and found: all templates with coverage of at least
    `coverage` and their spans (in words). Null, empty and unmatched texts have null license,
    zero coverage and no spans. Rows are independent; repeated ones repeat."""
    templates = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, coverage)
        kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("first_word", pa.int32()), ("end_word", pa.int32()), ("matched", pa.int32())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = [[dict(zip(("license", "coverage", "first_word", "end_word", "matched"), x, strict=True)) for x in scanner.scan(t)] for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, kind)], ["doc_id", "found"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, found array<struct<license:string,coverage:double,first_word:int,end_word:int,matched:int>>")
    best = F.try_element_at("found", F.lit(1))
    return rows.select("doc_id", best["license"].alias("license"), F.coalesce(best["coverage"], F.lit(0.0)).alias("coverage"), best["first_word"].alias("first_word"), best["end_word"].alias("end_word"), F.coalesce(best["matched"], F.lit(0)).alias("matched"), "found")
