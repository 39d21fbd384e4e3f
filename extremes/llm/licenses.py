"""License scans by patience alignment (operator 10).

A template is laid along a passage of a text: words that are unique in both, and the longest run of them that is in
order in both, are anchors; the gaps between anchors are aligned in the same way, and a gap without anchors by its longest
common subsequence. Coverage is the share of the template's words that are aligned, within a passage a quarter longer than it.

Passages are taken where they hold enough of the template's words, in any order, to reach the coverage. Where the alignment of none of
them does, an exact check follows by the length of the longest common subsequence. So every passage that can reach the coverage is found.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_WORD = re.compile(r"[^\W_]+")

# The wording of common license notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the Software."
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the "
        "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    ),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "ISC-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies."
    ),
    "BSD-3-Clause-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
        "met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    ),
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "Unlicense-text": "This is free and unencumbered software released into the public domain.",
    "BSD-2-Clause-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
        "met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    ),
}


def rising(values: list[int]) -> list[int]:
    """Positions of a longest strictly increasing subsequence, by patience piles."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for i, v in enumerate(values):
        k = bisect.bisect_left(tops, v)
        back.append(at[k - 1] if k else -1)
        tops[k : k + 1] = [v]
        at[k : k + 1] = [i]
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def common_subsequence(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of positions of a longest common subsequence; a row of the table is one integer, a bit for each word of ``a``."""
    at: dict[str, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    rows = [full]
    for w in b:
        v = rows[-1]
        u = v & at.get(w, 0)
        rows.append(((v + u) | (v - u)) & full)
    size = lambda i, j: i - (rows[j] & ((1 << i) - 1)).bit_count()  # noqa: E731  of a[:i] and b[:j]
    out, i, j = [], len(a), len(b)
    while i and j and (here := size(i, j)):
        if size(i, j - 1) == here:
            j -= 1
        elif size(i - 1, j) == here:
            i -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of aligned positions of two word lists, in order."""
    found: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {w: i for i, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
        both = [(i, where[w]) for i, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and w in where]
        anchors = [both[k] for k in rising([j for _, j in both])]
        if not anchors:
            if in_a.keys() & in_b.keys():
                found += [(a0 + i, b0 + j) for i, j in common_subsequence(a[a0:a1], b[b0:b1])]
            continue
        i0, j0 = a0, b0
        for i, j in anchors:
            found.append((i, j))
            todo.append((i0, i, j0, j))
            i0, j0 = i + 1, j + 1
        todo.append((i0, a1, j0, b1))
    return sorted(found)


class Hit(NamedTuple):
    name: str
    size: int  # words of the template
    matched: int
    first: int  # words of the text, both ends included
    last: int

    def beats(self, other: Hit) -> bool:
        """Whether this hit, which matches as many words at least, explains their common passage better than ``other``.

        A longer template must find half of the words that it has beyond the shorter one, so a template that is a part of another gives way to
        it where the rest stands as well, and only there.
        """
        return self.matched - other.matched >= (self.size - other.size) / 2


class Scanner:
    """Templates as words, with the words by which a text is picked for alignment.

    To cover a share c of a template's words, a text must hold one at least of any floor((1 - c) m) + 1 words of it; the
    template's longest words serve. Templates without words are never found.
    """

    def __init__(self, templates: dict[str, str], coverage: float = 0.8):
        self.coverage = coverage
        self.templates = {k: w for k, t in templates.items() if (w := [w.lower() for w in _WORD.findall(t)])}
        self.counts = {k: Counter(w) for k, w in self.templates.items()}
        self.need = {k: max(1, math.ceil(coverage * len(w) - 1e-9)) for k, w in self.templates.items()}
        self.reach = {k: len(w) + max(2, len(w) // 4) for k, w in self.templates.items()}
        triggers = set()
        self.of_word: dict[str, list[str]] = {}
        for name, counts in self.counts.items():
            spare = len(self.templates[name]) - self.need[name] + 1
            for w in sorted(counts, key=lambda w: (-len(w), w)):
                if spare <= 0:
                    break
                triggers.add(w)
                spare -= counts[w]
            for w in counts:
                self.of_word.setdefault(w, []).append(name)
        self.any = re.compile("|".join(sorted(map(re.escape, triggers), key=lambda w: (-len(w), w)))) if triggers else None

    def scan(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """(template, coverage, start, end in characters) of the places where a template is covered, in order.

        Where several templates are covered in places that overlap, the one that explains most of the passage is given.
        """
        if not text or not self.any or not self.any.search(low := text.lower()):
            return []
        # where lower-casing changes lengths, the words of the text as it is
        spans = [(m.start(), m.end()) for m in _WORD.finditer(low if len(low) == len(text) else text)]
        words = [text[i:j].lower() for i, j in spans]
        places: dict[str, list[int]] = {}
        for i, w in enumerate(words):
            if w in self.of_word:
                places.setdefault(w, []).append(i)
        most: Counter[str] = Counter()
        for w, at in places.items():
            for name in self.of_word[w]:
                most[name] += min(self.counts[name][w], len(at))
        hits = [hit for name, n in most.items() if n >= self.need[name] for hit in self._hits(name, words, sorted(i for w in self.counts[name] for i in places.get(w, ())))]
        return [(h.name, h.matched / h.size, spans[h.first][0], spans[h.last][1]) for h in self._best(hits)]

    def _bags(self, name: str, words: list[str], at: list[int], end: int) -> list[int]:
        """For the passage from each place of a template's word, up to ``end`` at most: how many of the template's words it holds, in any order."""
        counts, reach = self.counts[name], self.reach[name]
        held: Counter[str] = Counter()
        out, total, j = [], 0, 0
        for i, start in enumerate(at):
            while j < len(at) and at[j] < min(start + reach, end):
                w = words[at[j]]
                total += held[w] < counts[w]
                held[w] += 1
                j += 1
            out.append(total)
            w = words[start]
            held[w] -= 1
            total -= held[w] < counts[w]
        return out

    def _hits(self, name: str, words: list[str], at: list[int]) -> list[Hit]:
        """All places where the template is covered, none within another; ``at`` are the places of its words."""
        template, need, reach = self.templates[name], self.need[name], self.reach[name]
        out = []
        todo = [(0, len(words))]
        while todo:
            begin, end = todo.pop()
            own = at[bisect.bisect_left(at, begin) : bisect.bisect_left(at, end)]
            bags, k = self._bags(name, words, own, end), 0
            while k < len(own):
                if bags[k] < need:
                    k += 1
                    continue
                stop = bisect.bisect_left(own, own[k] + reach)
                near = [j for j in range(k, stop) if bags[j] >= need]
                passage = lambda j: words[own[j] : min(own[j] + reach, end)]  # noqa: E731, B023
                best: list[tuple[int, int]] = []
                for j in sorted(near, key=lambda j: -bags[j]):  # the fullest first, as far as another can still be better
                    if bags[j] <= len(best):
                        break
                    pairs = align(template, passage(j))
                    if len(pairs) > len(best):
                        best = [(a, own[j] + b) for a, b in pairs]
                if len(best) < need:  # the exact check
                    for j in near:
                        pairs = common_subsequence(template, passage(j))
                        if len(pairs) > len(best):
                            best = [(a, own[j] + b) for a, b in pairs]
                if len(best) < need:
                    k = stop
                    continue
                first, last = best[0][1], best[-1][1]
                out.append(Hit(name, len(template), len(best), first, last))
                todo.append((own[k], first))
                k = bisect.bisect_right(own, last)
        return out

    @staticmethod
    def _best(hits: list[Hit]) -> list[Hit]:
        """Of hits that overlap those that explain most, in the order of the text."""
        kept: list[Hit] = []
        for hit in sorted(hits, key=lambda h: (-h.matched, h.size, h.first, h.name)):
            at = bisect.bisect_left(kept, hit.first, key=lambda h: h.last)  # the first that ends at its start or later
            stop = at
            while stop < len(kept) and kept[stop].first <= hit.last:
                stop += 1
            if not any(h.beats(hit) for h in kept[at:stop]):
                kept[at:stop] = [hit]
        return kept


def read_templates(spark: SparkSession, path: str, most_bytes: int = 16 << 20) -> dict[str, str]:
    """Templates from a folder of text files, by file name without its ending; more than ``most_bytes`` of them raise. Files without words are never found."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.\w+)?$", 1).alias("name"), "value")
    if (files.agg(F.sum(F.octet_length("value"))).first()[0] or 0) > most_bytes:
        raise ValueError(f"templates of more than {most_bytes} bytes")
    return {r["name"]: r["value"] for r in files.collect()}


def scan_licenses(docs: DataFrame, scanner: Scanner | None = None, out: str = "licenses") -> DataFrame:
    """``docs`` with an array ``out`` of structs (license, coverage, start, end), offsets in code points, in order.

    Null and empty texts, and texts without a license, have an empty array; a license that stands twice is listed twice.
    Only ``text`` is read, and read whole; repeated rows get equal answers, an empty table gives an empty one; other
    columns stay as they are, one with the name ``out`` is replaced. Without ``scanner`` the notices in TEMPLATES are
    sought; full license texts can be given as a scanner's templates (see ``read_templates``).
    """
    held = scanner or Scanner(TEMPLATES)

    @F.pandas_udf("array<struct<license: string, coverage: double, start: long, end: long>>")
    def scan(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series([[dict(zip(("license", "coverage", "start", "end"), x, strict=True)) for x in held.scan(t)] for t in part])

    return docs.withColumn(out, scan(F.col("text")))
