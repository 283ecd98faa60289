"""License scans: MinHash bands over overlapping windows, then exact shingle containment.

Text and templates are normalised to words of ASCII letters and digits and other letters (everything else separates) and shingled by five words. Templates
are grouped by length. A match is a stretch of a text, of up to ``STRETCH`` times its template's length, that holds at least ``min_containment`` of the
template's shingles; words between these may be others. Each group's windows are ``STRETCH`` times as long as its longest template and begin
every quarter of the template, or closer where a low ``min_containment`` leaves less to be found. They begin anew in every text, so what is retrieved from
a text doesn't depend on others. Bands have one row, so a window retrieves a template as soon as they share one of the group's minima; the number of bands follows
from the least Jaccard similarity that the window nearest to a match can have, so that a match is retrieved with probability ``CERTAINTY``.
Only retrieved (window, template) pairs are verified, within the window and a template's length on either side: runs of the template's shingles that lie within one template
length of each other must hold at least ``min_containment`` of all of them.

A template of under five words is one shingle of its own length. It is looked up at every word of the texts, by the hash of as many words, and
found wherever these words stand.

Templates are a parameter (about a kilobyte each), sent to every task; DEFAULT_NOTICES holds well-known license notices. Notices of a family
share most of their wording, so one passage may be found as several of them; ``containment`` tells them apart.

Defined results: null and empty texts give no row; a text shorter than a template can still match by containment; a template without words is never found; finds
of one template within its length of each other are one row; of several templates in one place each has its row (ties too); a null id is kept; repeated rows give their rows each; very long texts are
scanned whole; other columns are not read, so their names cannot clash; an empty table gives no row.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SHINGLE_WORDS, as_chunks, lower_ascii, mix64, shingle_hashes, short_hash, short_hashes, span_hashes, words_per_text

MIN_CONTAINMENT = 0.75
CERTAINTY = 0.9999
#: A match is at most so many times as long as its template.
STRETCH = 1.5
#: Templates of one group differ in length by this factor at most.
GROUP_RATIO = 1.25

#: Public license notices, by their fixed wording. Paragraphs that also occur alone are notices of their own.
DEFAULT_NOTICES: dict[str, str] = {
    "All-rights-reserved": "All rights reserved",
    "MIT-line": "Released under the MIT License",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3",
    "CC-BY-4.0-line": "Licensed under CC BY 4.0",
    "CC-BY-SA-4.0-line": "Licensed under CC BY-SA 4.0",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": (
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the "
        "public domain worldwide. This software is distributed without any warranty. You should have received a copy of the CC0 Public Domain "
        "Dedication along with this software. If not, see <http://creativecommons.org/publicdomain/zero/1.0/>."
    ),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the Software."
    ),
    "MIT-disclaimer": (
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
        "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
        "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies."
    ),
    "ISC-disclaimer": (
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
        "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY "
        "DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
        "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution."
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    ),
    "BSD-3-Clause-third": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission."
    ),
    "BSD-disclaimer": (
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
        "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
        "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
        "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
        "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
        "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may '
        "obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express '
        "or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "GPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the "
        "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU General Public License for more details."
    ),
    "LGPL-3.0-or-later": (
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This library is distributed in "
        "the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU Lesser General Public License for more details."
    ),
    "LGPL-2.1-or-later": (
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published "
        "by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version. This library is distributed in "
        "the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU Lesser General Public License for more details."
    ),
    "AGPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in "
        "the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU Affero General Public License for more details."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software"
    ),
    "Unlicense-dedication": (
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the "
        "software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and "
        "successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this "
        "software under copyright law."
    ),
}

#: Above any hash that a band looks up.
_NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)
_WORD = np.zeros(256, bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _WORD[_a:_b] = True


def plain_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of letters and digits."""
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = _WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & (np.append(True, ~inside[:-1]) | edge[:-1]))
    ends = np.flatnonzero(inside & (np.append(~inside[1:], True) | edge[1:])) + 1
    return starts, ends


def bands_needed(jaccard: float, certainty: float = CERTAINTY) -> int:
    """One-row bands that retrieve a pair of this similarity with the certainty asked for."""
    return 1 if jaccard >= 1 else max(1, ceil(log(1 - certainty) / log(1 - jaccard)))


@dataclass
class _Group:
    window: int
    stride: int
    bands: int
    names: list[int] = field(default_factory=list)
    tables: list[dict[int, list[int]]] = field(default_factory=list)
    filters: list[np.ndarray] = field(default_factory=list)


class Scanner:
    def __init__(self, templates: dict[str, str], min_containment: float = MIN_CONTAINMENT) -> None:
        self.min_containment = min_containment
        self.names = sorted(templates)
        column = pa.array([templates[n] for n in self.names], pa.string())
        self.sets: list[np.ndarray] = []
        self.lengths: list[int] = []
        self.short: dict[int, dict[int, list[int]]] = {}  # words: hash: templates
        for _, _, data, offsets in as_chunks(column):
            starts, ends = plain_spans(data, offsets)
            words = span_hashes(lower_ascii(data), starts, ends)
            borders = words_per_text(offsets, starts)
            for a, b in zip(borders[:-1], borders[1:]):
                shingles = shingle_hashes(words[a:b])
                if 0 < b - a < SHINGLE_WORDS:
                    self.short.setdefault(int(b - a), {}).setdefault(int(short_hash(words[a:b])[0]), []).append(len(self.sets))
                self.sets.append(np.unique(shingles))
                self.lengths.append(max(1, len(shingles)))
        order = [i for i in sorted(range(len(self.names)), key=self.lengths.__getitem__) if len(self.sets[i])]
        self.groups: list[_Group] = []
        while order:
            least = self.lengths[order[0]]
            own = [i for i in order if self.lengths[i] <= max(least, int(least * GROUP_RATIO))]
            order = order[len(own) :]
            longest = max(self.lengths[i] for i in own)
            small = min(len(self.sets[i]) for i in own)
            wanted = max(1, ceil(min_containment * small))
            stride = max(1, min(longest // 4, wanted))
            # the nearest window has a whole match but for up to half a stride of it; a window's length is one of whole strides
            window = -(-ceil(STRETCH * longest) // stride) * stride
            found = wanted - stride // 2
            jaccard = 1.0 if window == 1 else found / (window + small - found)
            group = _Group(window, stride, bands_needed(jaccard), own)
            for k in range(group.bands):
                table: dict[int, list[int]] = defaultdict(list)
                for i in own:
                    table[int(self._order(self.sets[i], k).min())].append(i)
                known = np.zeros(1 << 16, bool)
                known[[v >> 48 for v in table]] = True
                group.tables.append(dict(table))
                group.filters.append(known)
            self.groups.append(group)

    @staticmethod
    def _order(shingles: np.ndarray, k: int) -> np.ndarray:
        return mix64(shingles ^ np.uint64((k + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))

    def _retrieve(self, shingles: np.ndarray, own: np.ndarray, borders: np.ndarray) -> set[tuple[int, int, int, int]]:
        """(text, template, first shingle, end shingle) of windows that share a band with a template."""
        out: set[tuple[int, int, int, int]] = set()
        orders: list[np.ndarray] = []
        lengths = np.diff(borders)
        for g in self.groups:
            strides = -(-lengths // g.stride)
            text = np.repeat(np.arange(len(lengths)), strides)
            place = np.arange(len(text)) - np.repeat(np.cumsum(strides) - strides, strides)
            starts = borders[text] + place * g.stride
            parts = g.window // g.stride
            for k in range(g.bands):
                if k == len(orders):
                    orders.append(np.where(own, self._order(shingles, k), _NEVER))
                least = np.minimum.reduceat(orders[k], starts)
                window = least.copy()
                for shift in range(1, min(parts, len(least))):
                    same = text[shift:] == text[:-shift]
                    window[:-shift] = np.where(same, np.minimum(window[:-shift], least[shift:]), window[:-shift])
                for at in np.flatnonzero(g.filters[k][(window >> np.uint64(48)).astype(np.int64)]).tolist():
                    for t in g.tables[k].get(int(window[at]), ()):
                        out.add((int(text[at]), t, int(starts[at]), min(int(starts[at]) + g.window, int(borders[text[at] + 1]))))
        return out

    def scan(self, column: pa.Array) -> Iterator[tuple[int, str, int, int, float]]:
        """(row, template, first word, end word, containment) of every find."""
        for first, end, data, offsets in as_chunks(column, 1 << 20):
            starts, ends = plain_spans(data, offsets)
            words = span_hashes(lower_ascii(data), starts, ends)
            borders = words_per_text(offsets, starts)
            # one shingle per starting word; near a text's end they would run over into the next text and count for nothing
            every = np.full(len(words), 0, np.uint64)
            full = shingle_hashes(words)
            every[: len(full)] = full
            own = np.ones(len(words), bool)
            for a, b in zip(borders[:-1].tolist(), borders[1:].tolist()):
                own[max(a, b - SHINGLE_WORDS + 1) : b] = False
            if not len(every):
                continue
            for row, t, a, b in self._short_finds(words, borders):
                yield first + row, self.names[t], a, b, 1.0
            spans: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
            for doc, t, a, b in self._retrieve(every, own, borders):
                reach = self.lengths[t]
                spans[doc, t].append((max(a - reach, int(borders[doc])), min(b + reach, int(borders[doc + 1]))))
            for (doc, t), places in sorted(spans.items()):
                places.sort()
                merged = [list(places[0])]
                for a, b in places[1:]:
                    if a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                for a, b in merged:
                    yield from self._verify(first + doc, t, every, own, int(borders[doc]), a, b)

    def _short_finds(self, words: np.ndarray, borders: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(row, template, first word, end word) of templates of under five words; overlapping ones are one."""
        for size, table in self.short.items():
            every = short_hashes(words, size)
            hits = np.flatnonzero(np.isin(every, np.array(list(table), np.uint64)))
            rows = np.searchsorted(borders, hits, "right") - 1
            whole = hits + size <= borders[rows + 1]  # the others run over into the next text
            open_: dict[int, list[int]] = {}
            for at, row in zip(hits[whole].tolist(), rows[whole].tolist()):
                a = at - int(borders[row])
                for t in table[int(every[at])]:
                    last = open_.get(t)
                    if last and last[0] == row and a < last[2]:
                        last[2] = a + size
                        continue
                    if last:
                        yield last[0], t, last[1], last[2]
                    open_[t] = [row, a, a + size]
            for t, (row, a, b) in open_.items():
                yield row, t, a, b

    def _verify(self, row: int, t: int, every: np.ndarray, own: np.ndarray, base: int, a: int, b: int) -> Iterator[tuple[int, str, int, int, float]]:
        """Exact containment in runs of the template's shingles that lie within one template length of each other."""
        wanted = self.sets[t]
        hits = np.flatnonzero(own[a:b] & np.isin(every[a:b], wanted)) + a
        if len(hits) == 0:
            return
        reach = max(self.lengths[t], SHINGLE_WORDS)
        for run in np.split(hits, np.flatnonzero(np.diff(hits) > reach) + 1):
            containment = len(np.unique(every[run])) / len(wanted)
            if containment >= self.min_containment:
                yield row, self.names[t], int(run[0]) - base, int(run[-1]) - base + SHINGLE_WORDS, containment


def scan_licenses(
    docs: DataFrame, templates: dict[str, str] | None = None, *, id_col: str = "doc_id", text_col: str = "text", min_containment: float = MIN_CONTAINMENT
) -> DataFrame:
    """(doc_id, license, first_word, end_word, containment): a row for every find."""
    chosen = DEFAULT_NOTICES if templates is None else templates
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(chosen, min_containment)
        for batch in batches:
            found = list(scanner.scan(batch.column(1)))
            rows, names, first, end, share = (list(x) for x in zip(*found)) if found else ([], [], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(names, pa.string()), pa.array(first, pa.int32()), pa.array(end, pa.int32()), pa.array(share, pa.float64())],
                names=["doc_id", "license", "first_word", "end_word", "containment"],
            )

    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return plain.mapInArrow(run, f"doc_id {kind}, license string, first_word int, end_word int, containment double")
