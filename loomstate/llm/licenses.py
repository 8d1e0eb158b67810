"""Licence scans: texts held against licence templates by the Dice coefficient over word bigrams.

A text is normalised to lower-case words without marks. Units are all spans of its words, wherever lines begin or end,
so that blank lines, comment marks and prose beside a notice don't matter. A template is a candidate for a text only if
they share t/(2-t) times its distinct bigrams, as no span reaches the threshold t with less; a span of more than (2-t)/t
times as many doesn't reach it either. Documents with the same notice are each judged alone; nothing is shuffled.

Defined results: null and empty texts have no licence; of spans with the same coefficient the one that shares most, of
these the shortest, of these the first is given, by the lines of its first and last word; a text can have several licences.
Words speak for one licence: of spans of different templates with words in common, the one that explains most is kept (shared
less other bigrams, then the higher coefficient; equal ones of the same words are all kept), and the others are looked for in
what it leaves. The coefficient alone would prefer the two clauses inside a BSD-3-Clause text that names its holder; repeated rows give repeated results; null identifiers are kept as null;
texts of any length are scanned whole; other columns aren't read; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, partial
from importlib import resources
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, column_of, read_table, text_column, texts_of

THRESHOLD = 0.8
WORD = re.compile(r"[^\W_]+")
#: Short notices as they stand at a text's foot, and the wording of short licences.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "This work has been dedicated to the public domain under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("WTFPL", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed."),
)

#: Whole licences, in license_texts/NAME.txt, without what follows their terms.
WHOLE = ("AGPL-3.0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "GPL-1.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MPL-1.1", "MPL-2.0")
GNU = (("GPL", "", "1.0 2.0 3.0"), ("LGPL", "Library", "2.0"), ("LGPL", "Lesser", "2.1 3.0"), ("AGPL", "Affero", "3.0"))
CC = (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC", "Attribution-NonCommercial"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))
CC_VERSIONS = (("4.0", "International"), ("3.0", "Unported"), ("2.5", "Generic"), ("2.0", "Generic"))


def gnu_headers() -> Iterator[tuple[str, str]]:
    """The grant alone and the standard header; all versions have the same forms, so that just the version decides."""
    for family, kind, versions in GNU:
        for name, number in ((f"{family}-{v}", v.removesuffix(".0")) for v in versions.split()):
            title = " ".join(f"GNU {kind} General Public License".split())
            yield name, f"This work is licensed under the {title}, version {number}."
            for thing in ("program", "library"):
                free = f"This {thing} is free software; you can redistribute it and/or modify it under the terms of the {title}"
                hope = f"This {thing} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {title} for more details. You should have received a copy of the {title} along with this {thing}; if not,"
                later = f"{free} as published by the Free Software Foundation; either version {number} of the License, or (at your option) any later version."
                only = f"{free} version {number} as published by the Free Software Foundation."
                for grant in (later, only):
                    yield name, grant
                    yield name, f"{grant} {hope} see https://www.gnu.org/licenses/."
                    yield name, f"{grant} {hope} write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA"


def cc_notices() -> Iterator[tuple[str, str]]:
    for short, title in CC:
        for version, scope in CC_VERSIONS:
            yield f"CC-{short}-{version}", f"Licensed under CC {short} {version}."
            yield f"CC-{short}-{version}", f"This work is licensed under a Creative Commons {title} {version} {scope} License."


#: Versions that the notices above would take for their own.
OTHER_VERSIONS = (
    ("Apache-1.1", "Licensed under the Apache License, Version 1.1."),
    ("Apache-1.0", "Licensed under the Apache License, Version 1.0."),
    ("MPL-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/ Software distributed under the License is distributed on an AS IS basis, WITHOUT WARRANTY OF ANY KIND, either express or implied. See the License for the specific language governing rights and limitations under the License."),
)
#: A parameter of the scan.
TEMPLATES = (*NOTICES, *OTHER_VERSIONS, *gnu_headers(), *cc_notices(), *((x, resources.files(__package__).joinpath("license_texts", f"{x}.txt").read_text("utf-8")) for x in WHOLE))
TEMPLATES = tuple(dict.fromkeys(TEMPLATES))


def bigrams(words: list[str]) -> set[tuple[str, str]]:
    return set(zip(words, words[1:]))


def normalised_words(text: str) -> list[str]:
    return WORD.findall(text.lower())


@lru_cache(maxsize=4)
def indexed(templates: tuple) -> tuple[list[tuple[str, set]], frozenset, dict[tuple, list[int]]]:
    sets = [(name, bigrams(normalised_words(text))) for name, text in templates]
    index: dict[tuple, list[int]] = {}
    for i, (_, grams) in enumerate(sets):
        for gram in grams:
            index.setdefault(gram, []).append(i)
    return sets, frozenset(index), index


class Stream:
    """The bigrams of a text by position, with the places of the equal ones before and after each."""

    def __init__(self, words: list[str]):
        ids: dict[tuple, int] = {}
        self.ids = np.fromiter((ids.setdefault(gram, len(ids)) for gram in zip(words, words[1:])), np.int64, len(words) - 1)
        self.numbers, self.size = ids, len(words) - 1
        order = np.argsort(self.ids, kind="stable")
        same = self.ids[order[1:]] == self.ids[order[:-1]]
        self.before, self.after = np.full(self.size, -1), np.full(self.size, self.size)
        self.before[order[1:][same]], self.after[order[:-1][same]] = order[:-1][same], order[1:][same]

    def spans(self, grams: set, threshold: float, low: int = 0, high: int | None = None) -> list[tuple]:
        """(dice, shared, distinct, first, last): the template's spans from low to high that share no word, best first.

        A best span begins with a shared bigram that it doesn't hold again, and ends with one that it hasn't held before.
        """
        marks = np.zeros(len(self.numbers), bool)
        marks[[self.numbers[gram] for gram in grams if gram in self.numbers]] = True
        shared = marks[self.ids]
        high = self.size if high is None else high
        least, most = least_shared(len(grams), threshold), int((2 - threshold) / threshold * len(grams) + 1e-9)

        def best_from(first: int, end: int) -> None:
            end, size = min(end, int(self.after[first])), 2 * most
            while True:
                stop = min(first + size, end)
                new = self.before[first:stop] < first
                distinct = np.cumsum(new)
                if stop == end or distinct[-1] > most:
                    break
                size *= 2
            common = np.cumsum(new & shared[first:stop])
            dice = 2 * common / (distinct + len(grams))
            k = int(dice.argmax())
            if dice[k] >= threshold:
                heapq.heappush(heap, (-float(dice[k]), -int(common[k]), k, first, int(distinct[k])))

        heap: list[tuple] = []
        places = (low + np.flatnonzero(shared[low:high])).tolist()
        names, held, to = self.ids[places].tolist(), {}, 0
        for k, first in enumerate(places):
            while len(held) < least and to < len(places):
                held[names[to]] = held.get(names[to], 0) + 1
                to += 1
            if len(held) < least:
                break
            if places[to - 1] < self.after[first]:
                best_from(first, high)
            held[names[k]] -= 1
            if not held[names[k]]:
                del held[names[k]]
        found: list[tuple] = []
        taken: list[tuple[int, int]] = []
        while heap:
            dice, common, length, first, distinct = heapq.heappop(heap)
            at = bisect_right(taken, (first, self.size))
            if at and taken[at - 1][1] + 1 >= first:
                continue
            if at < len(taken) and taken[at][0] <= first + length + 1:
                if (end := taken[at][0] - 1) > first:
                    best_from(first, end)
                continue
            taken.insert(at, (first, first + length))
            found.append((-dice, -common, distinct, first, first + length))
        return found


def least_shared(size: int, threshold: float) -> int:
    """Distinct bigrams that a span must share with a template of that size: all others would only lower the coefficient."""
    return max(1, math.ceil(threshold / (2 - threshold) * size - 1e-9))


def scan(text: str, templates: tuple, threshold: float) -> list[tuple]:
    """(licence, dice, first line, last line), the best span of each licence that has words of its own."""
    sets, known, index = indexed(templates)
    words = normalised_words(text)
    counts = Counter(chain.from_iterable(index[gram] for gram in known.intersection(zip(words, words[1:]))))
    near = [i for i, n in counts.items() if n >= least_shared(len(sets[i][1]), threshold)]
    if not near:
        return []
    stream = Stream(words)
    heap: list[tuple] = []

    def push(i: int, low: int, high: int) -> None:
        for dice, shared, distinct, a, b in stream.spans(sets[i][1], threshold, low, high):
            heapq.heappush(heap, (distinct - 2 * shared, -dice, b - a, a, i))

    for i in near:
        push(i, 0, stream.size)
    taken: list[tuple[int, int]] = []
    ranks: dict[tuple[int, int], tuple] = {}
    best: dict[str, tuple] = {}
    while heap:
        *rank, length, a, i = heapq.heappop(heap)
        b = a + length
        at = to = bisect_right(taken, (a, stream.size))
        if at and taken[at - 1][1] + 1 >= a:
            at -= 1
        while to < len(taken) and taken[to][0] <= b + 1:
            to += 1
        if at == to:
            taken.insert(at, (a, b))
            ranks[a, b] = rank
        elif taken[at:to] != [(a, b)] or ranks[a, b] != rank:
            # What the taken spans leave of this one may still hold the template.
            edges = [(a - 2, a - 2), *taken[at:to], (b + 2, b + 2)]
            for (_, end), (start, _) in zip(edges, edges[1:]):
                if start - 1 > end + 2:
                    push(i, max(a, end + 2), min(b + 1, start - 1))
            continue
        name = sets[i][0]
        best[name] = max(best.get(name, (0,)), (-rank[1], -rank[0], -length, -a))
    line = [k for k, x in enumerate(text.split("\n")) for _ in normalised_words(x)]
    return [(name, dice, line[-a], line[1 - a - n]) for name, (dice, _, n, a) in sorted(best.items())]


FOUND = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("dice", pa.float64()), ("first_line", pa.int32()), ("last_line", pa.int32())])


def scan_rows(parts: Iterator[pa.RecordBatch], templates: tuple, threshold: float) -> Iterator[pa.RecordBatch]:
    def rows():
        for batch in parts:
            for doc_id, text in zip(column_of(batch, "doc_id").to_pylist(), texts_of(batch, "text"), strict=True):
                for found in scan(text.decode("utf-8", "replace"), templates, threshold):
                    yield (doc_id, *found)

    yield from batches(rows(), FOUND)


def license_scan(docs: DataFrame, templates: tuple = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, license, dice, first_line, last_line: a row for each licence that a document has."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text"))
    return rows.mapInArrow(partial(scan_rows, templates=tuple(templates), threshold=threshold), "doc_id long, license string, dice double, first_line int, last_line int")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(read_table(spark, sf_dir, "documents"))
