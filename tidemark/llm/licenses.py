"""License scan: winnowed template fingerprints, then banded alignment.

Templates are cut into words; of the hashes of GRAM words in a row the least of each WINDOW is a
fingerprint of the template, in an inverted index (a few hundred entries, shipped with the task).
A document's grams that are in the index vote for a template and a diagonal; where enough votes for
a match lie within a band (as wide as a match of this template may shift), the text is aligned with the
template around the diagonal, which gives the words matched, the coverage of the template and the span
in the document. Matched words are masked, and what is left is aligned again. A match counts from SIMILAR on, words
matched over the template's words and the document's words inserted between; of matches that
overlap the one with more matched words stays, of equal ones that of the shorter template.

The whole text is scanned. Null and empty texts match nothing; rows without a match give no row,
repeated rows repeat theirs. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import _BYTE, column, mix, range_hash, text_blocks

GRAM, WINDOW, BAND, SIMILAR = 2, 2, 6, 0.8
OUT = "doc_id long, license string, coverage double, similarity double, matched long, template_words long, start_byte long, end_byte long"

# Wordings of common notices and licences.
TEMPLATES = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD-line": "Released under the BSD License.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause-endorsement": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "CC-BY-4.0-line": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0-line": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0-work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "AGPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT-line": "Released under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Proprietary-line": "All rights reserved.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
}
# How the short licences end.
MIT_END = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
ISC_END = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
ZLIB_END = "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
UNLICENSE_END = "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."

#: Whole texts of six short licences, and more of the opening of the Unlicense. The long ones (Apache, GPL, MPL) are known by the notices that refer to them.
TEMPLATES |= {
    "0BSD-full": f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. {ISC_END}",
    "BSD-2-Clause-full": f"{TEMPLATES['BSD-2-Clause']} {BSD_END}",
    "BSD-3-Clause-full": f"{TEMPLATES['BSD-2-Clause']} 3. {TEMPLATES['BSD-3-Clause-endorsement']} {BSD_END}",
    "ISC-full": f"{TEMPLATES['ISC']} {ISC_END}",
    "MIT-full": f"{TEMPLATES['MIT']} {MIT_END}",
    "Unlicense-opening": f"{TEMPLATES['Unlicense']} {UNLICENSE_END}",
    "Zlib-full": f"{TEMPLATES['Zlib']} {ZLIB_END}",
}

#: Word bytes, lower-cased; other bytes separate.
_FOLD = np.zeros(256, np.uint8)
for _c in (*range(48, 58), *range(97, 123), *range(128, 256)):
    _FOLD[_c] = _c
for _c in range(65, 91):
    _FOLD[_c] = _c + 32


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of each word."""
    folded = _FOLD[data]
    solid = np.concatenate([[False], folded > 0, [False]])
    edge = np.flatnonzero(solid[1:] != solid[:-1])
    start, end = edge[::2], edge[1::2]
    return start, end, range_hash(_BYTE[folded], start, end) if len(start) else np.empty(0, np.uint64)


def grams(hashes: np.ndarray, gram: int) -> np.ndarray:
    n = len(hashes) - gram + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(gram):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + n]
    return mix(out)


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places of the fingerprints: the least of each window, the last of equals."""
    if len(hashes) <= window:
        return np.array([len(hashes) - 1 - np.argmin(hashes[::-1])]) if len(hashes) else np.empty(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(hashes, window)
    return np.unique(np.arange(len(views)) + window - 1 - np.argmin(views[:, ::-1], axis=1))


class Index:
    """Fingerprint -> (template, place), as arrays sorted by fingerprint."""

    def __init__(self, templates: dict[str, str]):
        # shorter ones first: of templates with as many words matched, that of more coverage comes first
        self.names = sorted(templates, key=lambda n: (len(templates[n].split()), n))
        self.words = [words(np.frombuffer(templates[n].encode(), np.uint8))[2] for n in self.names]
        rows = []
        for t, w in enumerate(self.words):
            g = grams(w, GRAM)
            rows += [(int(g[p]), t, int(p)) for p in winnow(g, WINDOW)]
        # a word left out spoils two grams, one put in spoils one: a match keeps all fingerprints but
        # 2 (1 - SIMILAR) n at most, so fewer votes can't be one
        kept = [sum(r[1] == t for r in rows) - 2 * (1 - SIMILAR) * len(w) for t, w in enumerate(self.words)]
        self.need = [max(1, math.ceil(k - 1e-9)) for k in kept]
        rows.sort()
        self.hash = np.array([r[0] for r in rows], np.uint64)
        self.template, self.place = (np.array([r[i] for r in rows], np.int64) for i in (1, 2))

    def votes(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(template, place in it, place in the document) of each indexed gram of a document."""
        g = grams(hashes, GRAM)
        lo, hi = np.searchsorted(self.hash, g), np.searchsorted(self.hash, g, side="right")
        hit = np.flatnonzero(hi > lo)
        n = (hi - lo)[hit]
        at = np.repeat(lo[hit], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return self.template[at], self.place[at], np.repeat(hit, n)


def align(template: np.ndarray, text: np.ndarray, diagonal: int, band: int = BAND, gap: float = 0.0) -> tuple[int, int, int]:
    """(words matched, first, last + 1 in text) of the alignment in a band with most matches, less
    `gap` for each word of the text between them; of those the one that begins last. A template word
    stands at about its place plus the diagonal."""
    width = 2 * band + 1
    none = (0.0, -1, 0)
    before = [none] * width  # (score, start, matches) by place in the band, for the template so far
    best, end = none, -1
    for i, word in enumerate(template):
        now: list[tuple[float, int, int]] = []
        for d in range(width):
            j = i + diagonal + d - band
            cell = before[d + 1] if d + 1 < width else none  # the word has no partner
            if d:
                score, start, matches = now[d - 1]  # a word of the text has none
                if score > gap:
                    cell = max(cell, (score - gap, start, matches))
            if 0 <= j < len(text) and word == text[j]:
                score, start, matches = before[d]
                pair = (score + 1, start if start >= 0 else j, matches + 1)
                if pair > best:
                    best, end = pair, j + 1
                cell = max(cell, pair)
            now.append(cell)
        before = now
    return best[2], best[1], end


def diagonals(votes: np.ndarray, need: int, band: int = BAND) -> list[int]:
    """Where at least `need` votes lie within a band: the fullest place of each run, and its median."""
    votes = np.sort(votes)
    count = np.searchsorted(votes, votes + band, side="right") - np.arange(len(votes))
    out, at = [], 0
    while at < len(votes):
        if count[at] < need:
            more = np.flatnonzero(count[at:] >= need)
            if not len(more):
                break
            at += int(more[0])
        end = int(np.searchsorted(votes, votes[at] + band, side="right"))
        best = at + int(np.argmax(count[at:end]))
        last = best + int(count[best])
        out.append(int(votes[(best + last - 1) // 2]))
        at = last
    return out


def apart(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Of matches that overlap, the one with more matched words."""
    kept: list[tuple[int, int, int, int]] = []
    for f in sorted(found, key=lambda f: (-f[1], f[3] - f[2], f[0], f[2])):
        if all(f[3] <= x[2] or f[2] >= x[3] for x in kept):
            kept.append(f)
    return kept


def scan(hashes: np.ndarray, index: Index) -> list[tuple[int, int, int, int]]:
    """(template, matched, first word, last word + 1) of the matches of a document."""
    t, p, at = index.votes(hashes)
    found = []
    for k in np.unique(t):
        own = t == k
        template = index.words[k]
        n = len(template)
        shift = int((1 / SIMILAR - 1) * n + 1e-9)  # words put in and left out, of a match
        text, diagonal, place = hashes, (at - p)[own], at[own]
        while True:
            hits = []
            for middle in diagonals(diagonal, index.need[k], shift):
                # the votes of a match lie within `shift`, so within twice that of the middle of votes around
                m, s, e = align(template, text, middle, 2 * shift, SIMILAR)
                if m and m >= SIMILAR * (n + max(0, e - s - m)):
                    hits.append((int(k), m, s, e))
            if not hits:
                break
            hits = apart(hits)
            found += hits
            free = np.ones(len(text), bool)
            for _, _, s, e in hits:
                free[s:e] = False
            text = np.where(free, text, np.uint64(0))
            left = free[place] & free[place + GRAM - 1]
            diagonal, place = diagonal[left], place[left]
    return sorted(apart(found), key=lambda f: f[2])


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """One row per match of a template in a document."""
    templates = templates or TEMPLATES

    def run(batches):
        index = Index(templates)
        for batch in batches:
            ids = column(batch, "doc_id").to_pylist()
            rows = []
            for first, data, bounds in text_blocks(column(batch, "text")):
                # a space between texts keeps their words apart
                apart = np.full(len(data) + len(bounds) - 1, 32, np.uint8)
                apart[np.arange(len(data)) + np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))] = data
                start, end, hashes = words(apart)
                cut = np.searchsorted(start, bounds + np.arange(len(bounds)))
                voted = np.unique(np.searchsorted(cut, index.votes(hashes)[2], side="right") - 1)
                for k in voted:
                    a, b = cut[k], cut[k + 1]
                    base = bounds[k] + k
                    for t, m, s, e in scan(hashes[a:b], index):
                        n = len(index.words[t])
                        rows.append((ids[first + k], index.names[t], m / n, m / (n + max(0, e - s - m)), m, n, int(start[a + s] - base), int(end[a + e - 1] - base)))
            cols = list(zip(*rows, strict=True)) or [()] * 8
            kinds = [pa.int64(), pa.string(), pa.float64(), pa.float64(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in OUT.split(", ")])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, OUT)
