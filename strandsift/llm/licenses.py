"""License scan: winnowed fingerprints pick candidates, banded alignment measures them.

Templates are cut to words; each run of ``GRAM`` words is hashed, and of every ``WINDOW`` consecutive hashes the least
is kept (winnowing). The kept hashes form an inverted index: hash -> (template, place). Every run of a document looks
itself up, so any ``GRAM + WINDOW - 1`` shared words meet the index. Hits of one template that lie near each other
become a region, around the diagonal that the hits agree on; in it the template is aligned with the document's
words by local alignment inside a band, which allows inserted, missing and changed words. A match reports how much of
the template is covered and the span of the text in code points."""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandsift.llm.common import encoded

GRAM, WINDOW, BAND = 3, 3, 8
_MATCH, _CHANGE, _GAP = 2, -1, -1

#: License notices, each with its SPDX-like name.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "MIT": "Released under the MIT License.",
    "MIT-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction,
        including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
        subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.""",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation,
        either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
        MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "LGPL-header": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation;
        either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
        MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.""",
    "AGPL-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation,
        either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
        MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.""",
    "ISC-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission
        notice appear in all copies.""",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "BSD-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.""",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "All-rights-reserved": "All rights reserved.",
}

#: ASCII letters are lower-cased; ASCII other than letters and digits separates words; bytes above 127 belong to them.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def _hash(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=6).digest(), "little") | 1


def grams(codes: np.ndarray) -> np.ndarray:
    """Hash of each run of ``GRAM`` codes (of all, if fewer); codes 0, words that no template has, spoil theirs (0)."""
    width = min(GRAM, len(codes))
    if not width:
        return np.zeros(0, np.uint64)
    n = len(codes) - width + 1
    out = np.zeros(n, np.uint64)
    known = np.ones(n, bool)
    for k in range(width):
        out += codes[k : n + k] * _MIX[k]
        known &= codes[k : n + k] > 0
    return np.where(known, out ^ (out >> np.uint64(29)), np.uint64(0))


def winnow(hashes: np.ndarray) -> np.ndarray:
    """The places kept: the least known hash of each ``WINDOW`` consecutive ones, the last of equals."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64)
    high = np.where(hashes == 0, np.uint64(2**64 - 1), hashes)
    if n <= WINDOW:
        best = np.array([n - 1 - int(high[::-1].argmin())])
    else:
        seen = np.lib.stride_tricks.sliding_window_view(high, WINDOW)
        best = np.unique(np.arange(len(seen)) + WINDOW - 1 - seen[:, ::-1].argmin(1))
    return best[hashes[best] > 0]


def align(template: np.ndarray, words: np.ndarray, diagonal: int, band: int = BAND) -> tuple[int, int, int]:
    """(matched words, first, end): best local alignment with ``words`` whose place minus the template's stays within
    ``band`` of ``diagonal``; first and end are words."""
    m, n = len(template), len(words)
    low = np.iinfo(np.int32).min // 2
    score = np.zeros((m + 1, n + 1), np.int32)
    column = np.arange(1, n + 1)
    for i in range(1, m + 1):
        inside = np.abs(column - i - diagonal) <= band
        step = np.where(words == template[i - 1], _MATCH, _CHANGE)
        best = np.maximum(np.maximum(score[i - 1, :-1] + step, score[i - 1, 1:] + _GAP), 0)
        best = np.where(inside, best, low)
        slid = np.maximum.accumulate(best - column * _GAP) + column * _GAP
        score[i, 1:] = np.where(inside, np.maximum(best, slid), 0)
    i, j = np.unravel_index(score.argmax(), score.shape)
    end, matched, first = int(j), 0, int(j)
    while i > 0 and j > 0 and score[i, j] > 0:
        same = template[i - 1] == words[j - 1]
        if score[i, j] == score[i - 1, j - 1] + (_MATCH if same else _CHANGE):
            i, j = i - 1, j - 1
            if same:
                matched, first = matched + 1, int(j)
        elif score[i, j] == score[i - 1, j] + _GAP:
            i -= 1
        else:
            j -= 1
    return matched, first, end


def _regions(hits: list[tuple[int, int]], size: int, band: int, words: int) -> Iterator[tuple[int, int, int]]:
    """(first word, end, diagonal) of where a template of ``size`` words may lie: hits (place, diagonal) within ``band``
    diagonals of each other and not too far apart, so that a phrase that the template repeats makes one region for each
    of its diagonals and not one for each hit."""
    strips: list[list[tuple[int, int]]] = []
    for diagonal, place in sorted((d, p) for p, d in hits):
        if not strips or diagonal - strips[-1][0][1] > band:
            strips.append([])
        strips[-1].append((place, diagonal))
    for strip in strips:
        group: list[tuple[int, int]] = []
        for place, diagonal in [*sorted(strip), (1 << 60, 0)]:
            if group and place - group[-1][0] > size + band:
                middle = sorted(d for _, d in group)[len(group) // 2]
                yield max(0, middle - band), min(words, middle + size + band), middle
                group = []
            group.append((place, diagonal))


class Scanner:
    def __init__(self, templates: dict[str, str] | None = None, coverage: float = 0.8):
        self.coverage = coverage
        self.names = list(templates or TEMPLATES)
        cut = [(templates or TEMPLATES)[k].encode().translate(_TABLE).split() for k in self.names]
        self.codes = {w: _hash(w) for ws in cut for w in ws}
        self.templates = [np.array([self.codes[w] for w in ws], np.uint64) for ws in cut]
        keys, where = [], []
        for t, codes in enumerate(self.templates):
            hashes = grams(codes)
            for p in winnow(hashes).tolist():
                keys.append(hashes[p])
                where.append((t, p))
        order = np.argsort(np.array(keys, np.uint64), kind="stable")
        self.keys = np.array(keys, np.uint64)[order]
        self.where = np.array(where, np.int64).reshape(-1, 2)[order]

    def scan(self, text: bytes) -> list[tuple[str, int, int, float]]:
        """(template, start, end, coverage) of the matches, in code points, in order; matches do not overlap: of two
        that do, the one with more matched words stays."""
        look = self.codes.get
        codes = np.array([look(w, 0) for w in text.translate(_TABLE).split()], np.uint64)
        hashes = grams(codes)
        if not hashes.any():
            return []
        kept = np.flatnonzero(hashes)
        low, high = np.searchsorted(self.keys, hashes[kept]), np.searchsorted(self.keys, hashes[kept], "right")
        hits: dict[int, list[tuple[int, int]]] = {}
        for place, a, b in zip(kept.tolist(), low.tolist(), high.tolist(), strict=True):
            for t, p in self.where[a:b].tolist():
                hits.setdefault(t, []).append((place, place - p))
        found = []
        for t, own in hits.items():
            template = self.templates[t]
            band = min(BAND, max(1, len(template) // 3))
            for begin, end, middle in _regions(own, len(template), band, len(codes)):
                matched, a, b = align(template, codes[begin:end], middle - begin, band)
                if matched >= self.coverage * len(template):
                    found.append((matched, begin + a, begin + b, t, matched / len(template)))
        if not found:
            return []
        found.sort(key=lambda f: (-f[0], -f[4], f[1], f[3]))
        taken: list[tuple] = []  # (first, end) and the match, by place
        for f in found:
            k = bisect.bisect_left(taken, (f[1],))
            if (k == 0 or taken[k - 1][1] <= f[1]) and (k == len(taken) or f[2] <= taken[k][0]):
                taken.insert(k, (f[1], f[2], f))
        spans = [m.span() for m in _WORD.finditer(text.decode("utf-8", "replace"))]
        return [(self.names[t], spans[a][0], spans[b - 1][1], share) for _, _, (_, a, b, t, share) in taken]


def scan(docs: DataFrame, scanner: Scanner | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id column, matches) for every row: array of struct(license, start, end, coverage) in the order of the text.

    Null and empty texts match nothing; rows that repeat get a row each; an empty table gives an empty result; other
    columns are ignored. The templates are a fixed list, and so is what each task is sent."""
    scanner = scanner or Scanner()
    kind = docs.schema[id_column].dataType.simpleString()
    item = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("coverage", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[{"license": n, "start": a, "end": b, "coverage": c} for n, a, b, c in scanner.scan(t)] for t in encoded(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, item)], names=["id", "matches"])

    out = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text")).mapInArrow(run, f"id {kind}, matches array<struct<license:string,start:long,end:long,coverage:double>>")
    return out.select(F.col("id").alias(id_column), "matches")
