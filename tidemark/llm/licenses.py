"""Licence scans: passages of a text against licence templates by Dice coefficient over word bigrams.

A passage is a line, a paragraph (lines up to an empty one) or the whole text. Two
bags of a and b bigrams with Dice coefficient d or more differ in size by a factor
of at most (2 - d) / d, so only templates within those bounds are candidates for a
passage; the bigrams that a passage shares with them are then tallied through an
index of the templates' bigrams.

A notice that stands in other text has no such passage of its own. So spans of words
are tried too, within the same sizes, from each bigram of a template that has enough
others of it behind it; a span counts where no better or equal licence is found.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import map_batches, table, texts

# Public licence notices and texts, by SPDX identifier.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
        'http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, '
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished "
        "to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND '
        "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
        "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the "
        "License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
        "FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear "
        "in all copies.",
    ),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("All-Rights-Reserved", "All rights reserved."),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND '
        "FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
        "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
        "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND '
        "FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
        "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
        "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear "
        'in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT '
        "SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
        "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "LGPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the "
        "License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
        "FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    ),
    (
        "AGPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the "
        "License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
        "FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a "
        "compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted "
        "to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software "
        "must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is "
        "not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ),
)

#: Normal form: ASCII lower case, any other ASCII character than a letter or digit parts words. Bytes of other letters stay.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


#: A word in the text as it stands.
WORD = re.compile(r"(?:[^\x00-\x7f]|[0-9A-Za-z])+")


class Match(NamedTuple):
    passage: str
    start: int
    end: int
    template: int
    dice: float


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(NORMAL).split()


class Templates:
    """Templates by size, and the bigrams of all as an index; templates of under two words are left out."""

    def __init__(self, templates: tuple[tuple[str, str], ...], least: float):
        self.least, self.bags, self.names = least, [], [name for name, _ in templates]
        for place, (_, text) in enumerate(templates):
            words = words_of(text)
            if len(words) > 1:
                self.bags.append((len(words) - 1, place, Counter(zip(words, words[1:], strict=False))))
        self.bags.sort(key=lambda b: b[:2])
        self.sizes = [size for size, _, _ in self.bags]
        self.index: dict[tuple[bytes, bytes], list[tuple[int, int]]] = defaultdict(list)
        for at, (_, _, bag) in enumerate(self.bags):
            for pair, n in bag.items():
                self.index[pair].append((at, n))

    def nearest(self, words: list[bytes]) -> tuple[int, float] | None:
        """The template of the highest Dice coefficient of at least `least` (then the earliest), and that."""
        n = len(words) - 1
        if n < 1:
            return None
        low = bisect_left(self.sizes, n * self.least / (2 - self.least) - 1e-9)
        high = bisect_right(self.sizes, n * (2 - self.least) / self.least + 1e-9)
        if low == high:
            return None
        shared: Counter[int] = Counter()
        index = self.index
        for pair, count in Counter([p for p in zip(words, words[1:], strict=False) if p in index]).items():
            for at, most in index[pair]:
                if low <= at < high:
                    shared[at] += min(count, most)
        found = [(2 * s / (n + self.sizes[at]), -self.bags[at][1]) for at, s in shared.items()]
        dice, place = max(found, default=(0.0, 0))
        return (-place, dice) if dice >= self.least else None


    def spans(self, words: list[bytes]) -> list[tuple[int, int, int, float]]:
        """First word, end word, template, Dice of spans of at least `least`, those of one template apart; the most alike first."""
        pairs = list(zip(words, words[1:], strict=False))
        places: dict[int, list[int]] = defaultdict(list)
        for at, pair in enumerate(pairs):
            for bag, _ in self.index.get(pair, ()):
                places[bag].append(at)
        chosen = []
        for bag, hits in places.items():
            size, place, template = self.bags[bag]
            longest = int(size * (2 - self.least) / self.least + 1e-9)
            fewest = math.ceil(size * self.least / (2 - self.least) - 1e-9)  # shared bigrams of a span, at the least
            made = []
            for i in range(len(hits) - fewest + 1):
                if hits[i + fewest - 1] - hits[i] >= longest:
                    continue
                shared, seen, best = 0, Counter(), (0.0, 0, 0)
                for at in hits[i : i + longest]:
                    n = at - hits[i] + 1
                    if n > longest:
                        break
                    seen[pairs[at]] += 1
                    shared += seen[pairs[at]] <= template[pairs[at]]
                    best = max(best, (2 * shared / (n + size), 3 * shared - n - size, at))
                if best[0] >= self.least:
                    made.append((-best[1], hits[i], best[2] + 2, place, best[0]))
            taken = Taken()
            chosen += [m for m in sorted(made) if taken.add(m[1], m[2])]
        return [m[1:] for m in sorted(chosen)]


class Taken:
    """Spans that do not overlap, in order."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def overlap(self, start: int, end: int) -> slice:
        return slice(bisect_right(self.ends, start), bisect_left(self.starts, end))

    def add(self, start: int, end: int) -> bool:
        """Takes the span if nothing there is taken."""
        there = self.overlap(start, end)
        if there.start < there.stop:
            return False
        self.starts.insert(there.start, start)
        self.ends.insert(there.start, end)
        return True


def passages(text: str) -> list[tuple[str, int, int]]:
    """kind, start, end of the lines with a character, of paragraphs of several lines, and of a text of several such."""
    lines, found, at, block, blocks = text.split("\n"), [], 0, [], 0
    for line in [*lines, ""]:
        if line.strip():
            found.append(("line", at, at + len(line)))
            block.append(found[-1])
        else:
            if len(block) > 1:
                found.append(("paragraph", block[0][1], block[-1][2]))
            blocks += bool(block)
            block = []
        at += len(line) + 1
    if blocks > 1:
        found.append(("text", 0, len(text)))
    return found


def scan_text(text: str, known: Templates) -> list[Match]:
    found = []
    lines: list[tuple[int, list[bytes]]] = []
    starts: list[int] = []
    for kind, start, end in passages(text):
        if kind == "line":
            words = words_of(text[start:end])
            lines.append((start, words))
            starts.append(start)
        else:  # its lines are the last ones so far
            words = [w for _, line in lines[bisect_left(starts, start) :] for w in line]
        if best := known.nearest(words):
            found.append(Match(kind, start, end, *best))
    spans = known.spans([w for _, line in lines for w in line])
    if spans:
        at = [(m.start(), m.end()) for m in WORD.finditer(text)]
        taken: dict[tuple[str, int], tuple[Taken, dict[int, Match]]] = defaultdict(lambda: (Taken(), {}))

        def take(match: Match) -> None:
            there, own = taken[match.passage, match.template]
            if there.add(match.start, match.end):
                own[match.start] = match

        for match in found:
            take(match)
        for first, end, template, dice in spans:
            match = Match("span", at[first][0], at[end - 1][1], template, dice)
            others = [own[s] for there, own in taken.values() for s in there.starts[there.overlap(match.start, match.end)]]
            if not any(o.dice >= dice or known.names[o.template] == known.names[template] for o in others):
                take(match)
                found.append(match)
    return found


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = 0.85) -> DataFrame:
    """doc_id, passage (kind), start, end (code points), template, license, dice: a row for each passage that matches.

    A span is a notice inside other text; it is left out where a passage or span of the same licence, or of no lower Dice, overlaps.
    A null or empty text, and passages of one word, match nothing; a passage takes its best template, the
    earliest of equals. Repeated rows are scanned alike; an empty table has no matches.
    """
    schema = "doc_id long, passage string, start int, end int, template int, license string, dice double"

    def each(columns: dict[str, list], known: Templates) -> pa.RecordBatch | None:
        rows = [(d, *m) for d, t in zip(columns["doc_id"], columns["text"], strict=True) for m in scan_text(t, known)]
        if not rows:
            return None
        d, kind, start, end, place, dice = map(list, zip(*rows, strict=True))
        names = [templates[p][0] for p in place]
        kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((d, kind, start, end, place, names, dice), kinds, strict=True)], [x.split()[0] for x in schema.split(", ")])

    return map_batches(texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text"), each, schema, lambda: Templates(templates, least))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "passage", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "license", F.round("dice", 6).alias("dice"))
