"""License notices by patience alignment with templates.

Coverage is the share of template words that are aligned, in order, with words of
a stretch of text; density is the share of the stretch's words that are aligned.
A notice is a stretch that reaches both thresholds.

A text is looked at only where it can reach the least coverage: in windows of the
longest notice (the template's length divided by the density) that hold enough
of the template's words, repeats counted. There each occurrence of one of the
template's rarest words (taken until their places are too many to be all missed)
is an anchor: the words on either side are aligned by patience with the template's
words on that side. Words unique to both are anchors, of which the longest
increasing subsequence counts; the gaps between them are aligned in the same way,
and a gap without such words by the longest common subsequence of its few words.
The best run of the aligned words that reaches both thresholds is a notice.

An exact check follows: the aligned words of a notice are counted by its longest
common subsequence with the template, and windows that still hold enough template
words beside all notices are aligned exactly (``exact``), since words that are
unique by chance can mislead the anchors. No notice is lost.

Words are letters and digits in lower case. Defined results: a null or empty
text has no notices. Repeated rows each get their rows. A text gets a row for each
of its disjoint notices: of those that overlap the one with most aligned words
counts, then the densest, then the first; what is left beside it is aligned again.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import ALNUM, FOLD, blocks, span_hashes, text_bytes, word_spans

COVERAGE, DENSITY = 0.8, 0.6

#: Notices in common use (fixed values).
TEMPLATES = {
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "mit-notice": "Released under the MIT License.",
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or "
        "agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
        "limitations under the License."),
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, "
        "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
        "furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be "
        "included in all copies or substantial portions of the Software."),
    "gpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program "
        "is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    "bsd-conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
        "the following disclaimer in the documentation and/or other materials provided with the distribution."),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
        "that the above copyright notice and this permission notice appear in all copies."),
    "mpl-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
        "with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    "boost-1.0-header": (
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at "
        "http://www.boost.org/LICENSE_1_0.txt)"),
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any "
        "damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including "
        "commercial applications, and to alter it and redistribute it freely"),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, "
        "sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or "
        "non-commercial, and by any means."),
}


def patience(a: list, b: list, open_left: bool = False, open_right: bool = False) -> list[tuple[int, int]]:
    """Aligned places (i, j) with a[i] == b[j], increasing in both. At an open end
    of ``a`` words beyond the alignment are expected: its words are aligned as far
    from that end as they can be."""
    out, todo = [], [(0, len(a), 0, len(b), open_left, open_right)]
    while todo:
        i, m, j, n, left, right = todo.pop()
        while not left and i < m and j < n and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while not right and i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            out.append((m, n))
        if i == m or j == n:
            continue
        in_a, in_b = Counter(a[i:m]), Counter(b[j:n])
        place = {b[y]: y for y in range(j, n) if in_b[b[y]] == 1}
        pairs = [(x, place[a[x]]) for x in range(i, m) if in_a[a[x]] == 1 and a[x] in place]
        anchors = increasing(pairs)
        if not anchors:
            if not in_a.keys().isdisjoint(in_b):
                out += [(i + x, j + y) for x, y in common(a[i:m], b[j:n], left)]
            continue
        last = (i - 1, j - 1)
        for x, y in anchors:
            out.append((x, y))
            todo.append((last[0] + 1, x, last[1] + 1, y, left and last[0] < i, False))
            last = x, y
        todo.append((last[0] + 1, m, last[1] + 1, n, False, right))
    return sorted(out)


def table(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """rows[i, j]: the longest common subsequence of the last i words of a and the last j words of b."""
    rows = np.zeros((len(a) + 1, len(b) + 1), np.int64)
    back = b[::-1]
    for i, x in enumerate(a[::-1], 1):
        new = rows[i, 1:]
        np.maximum(rows[i - 1, 1:], rows[i - 1, :-1] + (back == x), out=new)
        np.maximum.accumulate(new, out=new)
    return rows


def common(a: list, b: list, late: bool = False) -> list[tuple[int, int]]:
    """Places of a longest common subsequence, as early in ``a`` as it can be (or as late)."""
    if late:
        return [(len(a) - 1 - x, len(b) - 1 - y) for x, y in common(a[::-1], b[::-1])][::-1]
    rows = table(np.array(a), np.array(b))
    out, i, j = [], 0, 0
    while rows[len(a) - i, len(b) - j]:
        here = rows[len(a) - i, len(b) - j]
        y = j
        while rows[len(a) - i, len(b) - y - 1] == here:  # the last place of b from which as many follow
            y += 1
        k = next((k for k in range(j, y + 1) if b[k] == a[i]), None)
        if k is not None and rows[len(a) - i - 1, len(b) - k - 1] == here - 1:
            out.append((i, k))
            j = k + 1
        i += 1
    return out


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence that increases in the second number too, by piles."""
    tops, top_at, before = [], [], []
    for k, (_, y) in enumerate(pairs):
        pile = bisect_left(tops, y)
        before.append(top_at[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(y)
            top_at.append(k)
        else:
            tops[pile], top_at[pile] = y, k
    out, k = [], top_at[-1] if top_at else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def neighbours(words: list[tuple[int, int]], end: int) -> list[tuple[int, int, int, int]]:
    """(place, word, place of the same word before, and after) of each (place, word)."""
    last, after = {}, []
    for x, w in reversed(words):
        after.append(last.get(w, end))
        last[w] = x
    last, out = {}, []
    for (x, w), later in zip(words, reversed(after)):
        out.append((x, w, last.get(w, -1), later))
        last[w] = x
    return out


class Scanner:
    def __init__(self, templates: dict[str, str], coverage: float, density: float):
        self.names, self.coverage, self.density = list(templates), coverage, density
        offsets, data = text_bytes(pa.array(list(templates.values()), pa.large_string()))
        data = FOLD[data]
        starts, ends, first = word_spans(offsets, data, ALNUM)
        self.vocabulary, words = np.unique(span_hashes(data, starts, ends), return_inverse=True)
        self.words = [words[a:b].tolist() for a, b in zip(first[:-1], first[1:])]
        self.weight = np.array([np.bincount(w, minlength=len(self.vocabulary)) for w in self.words])

    def block(self, offsets: np.ndarray, data: np.ndarray):
        """(text, template, aligned words, first word, end word) of each notice."""
        data = FOLD[data]
        starts, ends, first = word_spans(offsets, data, ALNUM)
        words = span_hashes(data, starts, ends)
        at = np.searchsorted(self.vocabulary, words)
        at[at == len(self.vocabulary)] = 0
        symbol = np.where(self.vocabulary[at] == words, at, -1) if len(words) else np.zeros(0, np.int64)
        known = np.flatnonzero(symbol >= 0)
        text = np.searchsorted(first, known, side="right") - 1
        counts = np.zeros((len(offsets) - 1, len(self.vocabulary)), np.int32)
        np.add.at(counts, (text, symbol[known]), 1)
        size = self.weight.sum(axis=1)
        possible = (counts > 0).astype(np.int64) @ self.weight.T >= self.coverage * size
        for d, t in zip(*np.nonzero(possible)):
            for notice in self.align(symbol[first[d]: first[d + 1]], int(t), counts[d]):
                yield int(d), self.names[t], *notice

    def align(self, text: np.ndarray, t: int, counts: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(aligned words, template words, first word, end word) of disjoint notices, in order."""
        template = self.words[t]
        m = len(template)
        places: dict[int, list[int]] = {}
        for q, w in enumerate(template):
            places.setdefault(w, []).append(q)
        # A notice of at most m aligned words spans at most m / density words.
        spare, reach = m - self.coverage * m, int(m / self.density)
        known = np.flatnonzero(np.isin(text, list(places)))
        known = list(zip(known.tolist(), text[known].tolist()))
        rare, missed = set(), 0
        for w in sorted(places, key=lambda x: (counts[x], x)):
            if missed > spare:
                break
            missed += len(places[w])
            rare.add(w)
        words, seen, out = text.tolist(), {}, []
        anchors = neighbours([(x, w) for x, w in known if w in rare], len(words))
        todo = self.stretches(known, places, m, reach)
        while todo:
            lo, hi = todo.pop()
            inside = known[bisect_left(known, (lo,)): bisect_left(known, (hi,))]
            found = self.anchored(words, anchors, places, template, reach, lo, hi, seen)
            if found:
                n, a, b = found
                if n < m:
                    n = int(table(text[a:b], np.array(template))[-1, -1])
                out.append((n, m, a, b))
                todo += [(lo, a), (b, hi)]
                continue
            for lo, hi in self.stretches(inside, places, m, reach):
                found = self.exact(text[lo:hi], places, m, reach)
                if found:
                    n, a, b, first = found
                    out.append((n, m, lo + a, lo + b))
                    todo.append((lo + b, hi))
                    if a > first:  # before it, only what ends at ``first`` or later is a notice
                        todo.append((lo + max(0, first - reach), lo + a))
        return sorted(out, key=lambda x: x[2])

    def stretches(self, known: list[tuple[int, int]], places: dict[int, list[int]], m: int, reach: int) -> list[tuple[int, int]]:
        """Unions of the windows of ``reach`` words that hold enough of the template's words."""
        out, held, first, total = [], Counter(), 0, 0
        for x, w in known:
            held[w] += 1
            total += held[w] <= len(places[w])
            while known[first][0] <= x - reach:
                gone = known[first][1]
                total -= held[gone] <= len(places[gone])
                held[gone] -= 1
                first += 1
            if total >= self.coverage * m:
                lo = known[first][0]
                if out and lo <= out[-1][1]:
                    out[-1] = out[-1][0], x + 1
                else:
                    out.append((lo, x + 1))
        return out

    def anchored(self, text: list[int], anchors: list[tuple[int, int, int, int]], places: dict[int, list[int]],
                 template: list[int], reach: int, lo: int, hi: int, seen: dict) -> tuple[int, int, int] | None:
        """(aligned words, first word, end word) of the best notice around an anchor,
        of those within ``reach`` words after the first one's end."""
        best, first = None, hi
        for x, w, before, after in islice(anchors, bisect_left(anchors, (lo,)), None):
            if x >= hi or x > first + reach:
                break
            l, r = max(lo, x - reach), min(hi, x + reach + 1)
            if len(places[w]) == 1:  # aligned once: the next ones belong to other notices
                l, r = max(l, before + 1), min(r, after)
            for q in places[w]:
                if (x, q, l, r) not in seen:
                    xs = [l + i for i, _ in patience(text[l:x], template[:q], open_left=True)]
                    xs += [x, *(x + 1 + i for i, _ in patience(text[x + 1: r], template[q + 1:], open_right=True))]
                    seen[x, q, l, r] = self.run(xs, len(template))
                rank = seen[x, q, l, r]
                if rank:
                    first = min(first, rank[1] + rank[2])
                    best = rank if best is None else min(best, rank)
        return best and (-best[0], best[2], best[2] + best[1])

    def run(self, xs: list[int], m: int) -> tuple[int, int, int] | None:
        """(-aligned words, length, first word) of the best run of aligned words that reaches both thresholds."""
        at, n = np.array(xs), len(xs)
        while n >= max(1, self.coverage * m):
            spans = at[n - 1:] - at[: len(at) - n + 1] + 1
            k = int(spans.argmin())
            if n >= self.density * spans[k]:
                return -n, int(spans[k]), int(at[k])
            n -= 1
        return None

    def exact(self, text: np.ndarray, places: dict[int, list[int]], m: int, reach: int) -> tuple[int, int, int, int] | None:
        """(aligned words, first word, end word, end of the first) of the best notice
        that is whole within ``reach`` words after the first one's end.

        latest[q, n] is the last word at which an alignment of n words with the
        template's first q places can begin, all up to the word that is read."""
        if len(text) < self.coverage * m:
            return None
        latest = np.full((m + 1, m + 1), -1, np.int64)
        need = np.arange(m + 1)
        enough = need >= self.coverage * m
        enough[0] = False
        best, first = None, len(text)
        at = np.flatnonzero(np.isin(text, list(places)))
        for x, w in zip(at.tolist(), text[at].tolist()):
            if x > first + reach:
                break
            for q in reversed(places[w]):  # the rows read are those before this word
                new = latest[q, :-1].copy()
                new[0] = x
                below = latest[q + 1:, 1:]
                if (new > below[0]).any():
                    np.maximum(below, new, out=below)
            start = latest[m]
            good = np.flatnonzero(enough & (start >= 0) & (need >= self.density * (x + 1 - start)))
            if len(good):
                n = int(good[-1])
                first = min(first, x + 1)
                rank = (-n, x + 1 - int(start[n]), int(start[n]))
                if best is None or rank < best:
                    best = rank
        return best and (-best[0], best[2], best[2] + best[1], first)


def _scan(templates: dict[str, str], coverage: float, density: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, coverage, density)
        for batch in batches:
            offsets, data = text_bytes(batch.column("text"))
            rows = [(a + d, *more) for a, b in blocks(offsets)
                    for d, *more in scanner.block(offsets[a: b + 1] - offsets[a], data[offsets[a]: offsets[b]])]
            columns = list(zip(*rows)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column("row").take(pa.array(columns[0], pa.int64())), pa.array(columns[1], pa.string()),
                 *[pa.array(c, pa.int64()) for c in columns[2:]]],
                names=["row", "license", "n_aligned", "n_template", "first_word", "end_word"])
    return run


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, coverage: float = COVERAGE, density: float = DENSITY, key: str = "doc_id") -> DataFrame:
    """(key, license, n_aligned, n_template, first_word, end_word): one row for each notice found."""
    kind = docs.schema[key].dataType.simpleString()
    texts = docs.select(F.col(f"`{key}`").alias("row"), F.col("text").cast("string").alias("text"))
    found = texts.mapInArrow(_scan(templates, coverage, density),
                             f"row {kind}, license string, n_aligned long, n_template long, first_word long, end_word long")
    return found.withColumnRenamed("row", key)
