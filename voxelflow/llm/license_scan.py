"""License scan: patience alignment of texts with license templates.

Words are anchored where they occur once in both; the longest increasing run of anchors is kept, and the gaps between them, and
before and after, are aligned in the same way. The share of a template's words that are aligned is its coverage. The only filter before
is a bound that is never below the coverage: the words of the template that the text has, each counted as often as the template
has it. Most texts fail it for all templates at once.

A text may hold a license several times, and words are then unique in a part of it only. So stretches of a template and a half whose
words reach the threshold are aligned first; then what is left before, between and after the licenses found is aligned whole, in
which words may stand between any two of the license: numbers, marks of quotation, another column. Templates of fewer than LONG words
are lines, which must stand in one stretch: three words scattered over a book in the right order are no license. Anchors are
unique in the part that is aligned.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from .common import tidy
from .words import PLAIN, word_hashes

#: Names and wording of licenses and of the lines that refer to them.
TEMPLATES = {
    "MIT-line": "Released under the MIT License.",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "reserved-line": "All rights reserved.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}
#: Share of a template's words that must be aligned.
THRESHOLD = 0.8
#: Words from which a template is aligned with all of a text.
LONG = 20

# as the hashes of words see them: signs beyond ASCII that stand around words are made spaces first, one for one
_WORD = re.compile("[A-Za-z0-9\x80-\U0010ffff]+")
_SIGNS = "[\u00a0\u00a9\u00ab\u00bb\u2010-\u201f\u2022\u2026]"


def words(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """Lower-cased words and where they stand."""
    found = list(_WORD.finditer(text))
    return [m[0].lower() for m in found], [m.span() for m in found]


def _climb(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, given by their first numbers, in which the second grow, too."""
    tops: list[int] = []
    ends: list[int] = []
    before: list[int] = []
    for i, (_, y) in enumerate(pairs):
        at = bisect_left(tops, y)
        before.append(ends[at - 1] if at else -1)
        if at == len(tops):
            tops.append(y)
            ends.append(i)
        else:
            tops[at], ends[at] = y, i
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(pairs[i])
        i = before[i]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of positions of equal words, in order in both, by patience."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, p, q = todo.pop()
        while i < j and p < q and a[i] == b[p]:
            out.append((i, p))
            i, p = i + 1, p + 1
        while i < j and p < q and a[j - 1] == b[q - 1]:
            j, q = j - 1, q - 1
            out.append((j, q))
        if i == j or p == q:
            continue
        left, right = Counter(a[i:j]), Counter(b[p:q])
        spots = {w: p + k for k, w in enumerate(b[p:q])}
        anchors = _climb([(i + k, spots[w]) for k, w in enumerate(a[i:j]) if left[w] == 1 and right.get(w) == 1])
        if not anchors:
            continue
        for x, y in anchors:
            out.append((x, y))
            todo.append((i, x, p, y))
            i, p = x + 1, y + 1
        todo.append((i, j, p, q))
    return sorted(out)


class Scanner:
    """The templates, made ready: their words, and the counts that bound a text's coverage."""

    def __init__(self, templates: dict[str, str], threshold: float):
        self.names = list(templates)
        self.words = [words(t)[0] for t in templates.values()]
        if not all(self.words):
            raise ValueError("a template has no words")
        if not all(t.isascii() for t in templates.values()):
            raise ValueError("a template must be ASCII")
        self.counts = [Counter(w) for w in self.words]
        self.threshold = threshold
        vocabulary = sorted({x for w in self.words for x in w})
        hashes = np.array([next(iter(word_hashes(pa.array([w]), PLAIN)))[0] for w in vocabulary], np.uint64)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.table = np.array([[c[vocabulary[i]] for i in order] for c in self.counts], np.int32)
        self.sizes = np.array([len(w) for w in self.words])

    def possible(self, hashed: np.ndarray) -> np.ndarray:
        """The templates that the words of a text could cover."""
        at = np.minimum(np.searchsorted(self.hashes, hashed), len(self.hashes) - 1)
        counts = np.bincount(at[self.hashes[at] == hashed], minlength=len(self.hashes))
        return np.flatnonzero(np.minimum(self.table, counts).sum(axis=1) >= self.threshold * self.sizes)

    def places(self, found: list[str], which: int) -> list[tuple[int, int, int]]:
        """(aligned words, first, last) of each place where a template is covered, in order, none overlapping."""
        out = list(self.dense(found, which))
        size = len(self.words[which])
        if size < LONG:
            return out
        ends = [-1, *(p for _, a, b in out for p in (a, b)), len(found)]
        todo = list(zip(ends[::2], ends[1::2], strict=True))
        while todo:
            a, b = todo.pop()
            part = found[a + 1 : b]
            here = Counter(w for w in part if w in self.counts[which])
            if sum(min(n, self.counts[which][w]) for w, n in here.items()) < self.threshold * size:
                continue
            pairs = align(part, self.words[which])
            if len(pairs) >= self.threshold * size:
                first, last = a + 1 + pairs[0][0], a + 1 + pairs[-1][0]
                out.append((len(pairs), first, last))
                todo += [(a, first), (last, b)]
        return sorted(out, key=lambda m: m[1])

    def dense(self, found: list[str], which: int) -> Iterator[tuple[int, int, int]]:
        """As `places`, of licenses in stretches of at most a template and a half.

        A stretch that ends where the bound is reached, with half a template more, is aligned; after a license the search goes on
        behind it, else the stretch begins a word later.
        """
        need, size = self.counts[which], len(self.words[which])
        reach, least = size + size // 2 + 2, self.threshold * size
        inside: Counter = Counter()
        have, a, k = 0, 0, 0
        spots = [i for i, w in enumerate(found) if w in need]

        def leave() -> None:
            nonlocal have, a
            word = found[spots[a]]
            have -= inside[word] <= need[word]
            inside[word] -= 1
            a += 1

        while k < len(spots):
            i = spots[k]
            inside[found[i]] += 1
            have += inside[found[i]] <= need[found[i]]
            k += 1
            while spots[a] <= i - reach:
                leave()
            while have >= least:
                start = spots[a]
                pairs = align(found[start : i + size // 2 + 2], self.words[which])
                if len(pairs) >= least:
                    last = start + pairs[-1][0]
                    yield len(pairs), start + pairs[0][0], last
                    inside.clear()
                    have, a = 0, bisect_right(spots, last)
                    k = a
                else:
                    leave()

    def scan(self, text: str, hashed: np.ndarray) -> list[tuple[float, int, int, int]]:
        """(coverage, template, start, end) of each license found, in code points; the best at a place comes first."""
        possible = self.possible(hashed)
        if not len(possible):
            return []
        found, spans = words(text)
        out = [(n / len(self.words[t]), int(t), spans[a][0], spans[b][1]) for t in possible for n, a, b in self.places(found, t)]
        return sorted(out, key=lambda m: (-m[0], -len(self.words[m[1]]), self.names[m[1]], m[2]))


def _scan(scanner: Scanner):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, coverage, n, listed = [], [], [], []
            texts = pc.replace_substring_regex(batch.column("text"), _SIGNS, " ")
            for text, hashed in zip(texts, word_hashes(texts, PLAIN), strict=True):
                found = scanner.scan(text.as_py(), hashed) if len(scanner.possible(hashed)) else []
                best.append(scanner.names[found[0][1]] if found else None)
                coverage.append(round(found[0][0], 6) if found else 0.0)
                n.append(len(found))
                listed.append(",".join(f"{scanner.names[t]}:{a}:{b}:{c:.4f}" for c, t, a, b in sorted(found, key=lambda m: (m[2], m[3], m[1]))))
            yield pa.record_batch([batch.column("id"), pa.array(best, pa.string()), pa.array(coverage, pa.float64()), pa.array(n, pa.int64()), pa.array(listed, pa.string())], ["id", "license", "coverage", "n_matches", "matches"])

    return scan


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id_col, license (the best covered, of these the longest, then by name; null if none), coverage,
    n_matches, matches (name:start:end:coverage by place, in code points).

    A template counts where at least `threshold` of its words are aligned: within a template and a half, or, of LONG words on, wherever
    they stand in the text. Words are compared in lower case, without signs. Null
    text counts as empty and has no license. Repeated rows and null ids are kept; other columns are ignored; an empty table
    gives an empty result. A template must have a word.
    """
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    fields = [T.StructField("id", source.schema["id"].dataType), T.StructField("license", T.StringType()), T.StructField("coverage", T.DoubleType()), T.StructField("n_matches", T.LongType()), T.StructField("matches", T.StringType())]
    return source.mapInArrow(tidy(_scan(Scanner(templates, threshold))), T.StructType(fields)).withColumnRenamed("id", id_col)
