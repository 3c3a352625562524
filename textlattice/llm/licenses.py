"""License scans: winnowed fingerprints of templates pick candidates, banded alignment reports spans.

Words of the templates and of the texts become 64-bit hashes; hashes of GRAM words are winnowed
(the least of each WINDOW neighbours), so any shared run of GRAM + WINDOW - 1 words shares a
fingerprint.  An inverted index of the templates (bounded: a stated list) gives hits; hits of one
template on near diagonals make a candidate, and an edit alignment of words in a band around them
gives matched words, coverage and the span in the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

GRAM, WINDOW, BAND, COVERAGE = 3, 2, 8, 0.8
#: Texts are worked on together up to so many characters.
TOGETHER = 1 << 20
WORD = re.compile(r"\w+")
_KNOWN: dict[str, int] = {}

#: Notices that projects put into their files, as their stewards publish them.
TEMPLATES = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "MIT-line": "Released under the MIT License.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
    "software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
    "See the License for the specific language governing permissions and limitations under the License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), "
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
    "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, "
    "but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
    "provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
    "You can obtain one at http://mozilla.org/MPL/2.0/.",
}


def word_hashes(words: list[str]) -> np.ndarray:
    out = []
    for w in words:
        h = _KNOWN.get(w)
        if h is None:
            h = xxh64_intdigest(w)
            if len(_KNOWN) >= 300_000:
                _KNOWN.clear()
            _KNOWN[w] = h
        out.append(h)
    return np.array(out, np.uint64)


def grams(hashes: np.ndarray) -> np.ndarray:
    n = max(len(hashes) - GRAM + 1, 0)
    out = np.zeros(n, np.uint64)
    for i in range(GRAM):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n]
    out ^= out >> np.uint64(32)
    return out * np.uint64(0xD6E8FEB86659FD93)


def winnowed(g: np.ndarray) -> np.ndarray:
    """Positions of the least of each WINDOW neighbours (all of fewer)."""
    if len(g) < WINDOW:
        return np.arange(len(g))
    w = np.lib.stride_tricks.sliding_window_view(g, WINDOW)
    return np.unique(w.argmin(1) + np.arange(len(w)))


class Index:
    def __init__(self, templates: dict[str, str]):
        self.names = list(templates)
        self.words = [WORD.findall(t.lower()) for t in templates.values()]
        self.postings: dict[int, list[tuple[int, int]]] = {}
        for t, found in enumerate(self.words):
            g = grams(word_hashes(found))
            for at in winnowed(g).tolist():
                self.postings.setdefault(int(g[at]), []).append((t, at))
        self.keys = np.array(sorted(self.postings), np.uint64)


def align(template: list[str], text: list[str], shift: int) -> tuple[int, int, int]:
    """Words of the template matched within the band around ``text[i + shift]``, and their first and last place in the text.

    Longest common subsequence in a band of BAND words to each side; of equal ones the shortest span.
    """
    m, width = len(template), 2 * BAND + 1
    best = [(0, 0, 0)] * (width + 1)  # matched, -span, first; the column is the place in the band
    for i in range(m):
        row: list[tuple[int, int, int]] = []
        for b in range(width):
            j = i + shift + b - BAND
            up = best[b + 1] if b + 1 < width else (0, 0, 0)  # template word skipped
            left = row[b - 1] if b else (0, 0, 0)  # text word skipped
            cell = max(up, left)
            if 0 <= j < len(text) and text[j] == template[i]:
                n, _, first = best[b]
                start = first if n else j
                cell = max(cell, (n + 1, start - j, start))
            row.append(cell)
        best = [*row, (0, 0, 0)]
    n, minus, first = max(best)
    return n, first, first - minus


def scan(index: Index, texts: list[str]) -> list[list[dict]]:
    """Matches of each text: license, coverage, span in characters and words."""
    spans = [[m.span() for m in WORD.finditer(t)] for t in texts]
    words = [WORD.findall(t.lower()) for t in texts]
    for i, (s, w) in enumerate(zip(spans, words)):
        if len(s) != len(w):  # lower case changed what a word is
            words[i] = [texts[i][a:b].lower() for a, b in s]
    ends = np.array(list(accumulate(map(len, words))), np.int64)
    g = grams(word_hashes([w for x in words for w in x]))
    doc = np.searchsorted(ends, np.arange(len(g)), "right")
    inside = np.arange(len(g)) + GRAM <= ends[doc] if len(g) else np.zeros(0, bool)
    hits = np.flatnonzero(np.isin(g, index.keys) & inside)
    out: list[list[dict]] = [[] for _ in texts]
    found: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for at in hits.tolist():
        d = int(doc[at])
        place = at - int(ends[d]) + len(words[d])
        for t, pos in index.postings[int(g[at])]:
            found.setdefault((d, t), []).append((place - pos, place))
    for (d, t), diagonals in sorted(found.items()):
        taken = -1
        last = None
        for shift, place in sorted(diagonals):
            if last is not None and shift - last <= BAND // 2:
                continue
            last = shift
            n, a, b = align(index.words[t], words[d], shift)
            if n >= COVERAGE * len(index.words[t]) and a > taken:
                taken = b
                out[d].append({"license": index.names[t], "coverage": round(n / len(index.words[t]), 4), "start": spans[d][a][0], "end": spans[d][b][1], "matched_words": n})
    return out


MATCH = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int32()), ("end", pa.int32()), ("matched_words", pa.int32())]))


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, matches)`` of every row; ``matches`` is an array of license, coverage, start, end (characters) and matched words.

    A text may match several templates, and one template at several places that do not overlap.
    A null or empty text has no matches; repeated rows match alike; other columns are not read; an
    empty table gives no rows.  No shuffle.
    """
    index = Index(templates or TEMPLATES)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                first, texts, size = at, [], 0
                while at < batch.num_rows and size < TOGETHER:
                    texts.append(batch.column("text")[at].as_py() or "")
                    size += len(texts[-1])
                    at += 1
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(first, at - first), pa.array(scan(index, texts), MATCH)], names=["id", "matches"])

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    ddl = "array<struct<license: string, coverage: double, start: int, end: int, matched_words: int>>"
    return narrow.mapInArrow(run, f"id {kind}, matches {ddl}").withColumnRenamed("id", id_col)
