"""License scans by patience alignment.

Each template is aligned with windows of a text's words that begin at a word of the template and hold ``stretch`` times as many words
as it. Alignment anchors on the words that come once in both the window and the template, takes the longest run of anchors in
increasing order, and aligns the gaps between them in the same way; where a gap has no such word, equal words at its two ends are
matched. Coverage is the share of the template's words that are matched; a window counts from ``least`` on. Of overlapping finds the
one with more matched words stays, then the shorter one.

A window is aligned only where it shares enough words with the template, each counted as often as both have it. Coverage cannot be
larger than that share, so nothing is lost: the finds are those of aligning every window, whatever the templates.

Defined cases: a null text has no words; a template of one word is found at each place of it, one without words nowhere; repeated rows
each get a row; several copies of a notice in one text are several finds; other columns are ignored; an empty table gives an empty
result. Texts of any length are scanned whole.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from math import ceil
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, ship, table

# Short notices and the operative text of common public licences.
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, "
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
    "furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission "
    "notice appear in all copies.",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code "
    "must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions "
    "and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
    "http://www.apache.org/licenses/LICENSE-2.0",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either "
    "version 3 of the License, or (at your option) any later version.",
}
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _longest_increasing(values: list[int]) -> list[int]:
    """Indices of a longest increasing subsequence."""
    tails: list[int] = []
    at: list[int] = []
    before = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        tails[k : k + 1] = [v]
        at[k : k + 1] = [i]
        before[i] = at[k - 1] if k else -1
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched positions (in a, in b), increasing in both, by patience alignment."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if a0 >= a1 or b0 >= b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {a[i]: i for i in range(a0, a1) if in_a[a[i]] == 1}
        anchors = [(place[b[j]], j) for j in range(b0, b1) if in_b[b[j]] == 1 and b[j] in place]
        if anchors:
            chain = [anchors[i] for i in _longest_increasing([i for i, _ in anchors])]
            out += chain
            edges = [(a0 - 1, b0 - 1), *chain, (a1, b1)]
            todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:], strict=False)]
            continue
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
    return sorted(out)


class Scanner:
    """Finds templates in texts; it lives in a task."""

    def __init__(self, templates: dict[str, str], least: float, stretch: int = 3):
        self.least, self.stretch = least, stretch
        self.templates = {k: w for k, t in templates.items() if (w := words_of(t))}
        self.counts = {k: Counter(t) for k, t in self.templates.items()}
        self.vocabulary = frozenset(w for t in self.templates.values() for w in t)

    def windows(self, words: list[str], name: str) -> Iterator[int]:
        """Where windows begin that share enough words with a template to reach the least coverage."""
        own, n = self.counts[name], len(self.templates[name])
        need, width = ceil(self.least * n - 1e-9), self.stretch * n
        hits = [p for p, w in enumerate(words) if w in own]
        held: Counter[str] = Counter()
        shared = end = 0
        for p in hits:
            while end < len(hits) and hits[end] < p + width:
                w = words[hits[end]]
                held[w] += 1
                shared += held[w] <= own[w]
                end += 1
            if shared >= need:
                yield p
            shared -= held[words[p]] <= own[words[p]]
            held[words[p]] -= 1

    def scan(self, text: str | None) -> list[tuple[int, int, str, float]]:
        """(start, end, template, coverage) in code points, in order."""
        low = (text or "").lower()
        if len(low) != len(text or ""):  # lower case of other length: keep positions of the text itself
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        words = _WORD.findall(low)
        seen = Counter(w for w in words if w in self.vocabulary)
        found: set[tuple[int, int, int, str]] = set()
        for k, own in self.counts.items():
            n = len(self.templates[k])
            if sum(min(c, seen[w]) for w, c in own.items()) < self.least * n - 1e-9:
                continue
            for p in self.windows(words, k):
                pairs = align(words[p : p + self.stretch * n], self.templates[k])
                if len(pairs) >= self.least * n - 1e-9:
                    found.add((-len(pairs), p + pairs[0][0], p + pairs[-1][0], k))
        if not found:
            return []
        spots = [m.span() for m in _WORD.finditer(low)]
        kept: list[tuple[int, int, str, float]] = []
        for m, first, last, k in sorted(found, key=lambda f: (f[0], f[0] / len(self.templates[f[3]]), f[2] - f[1], f[1], f[3])):
            s, e = spots[first][0], spots[last][1]
            at = bisect_left(kept, s, key=itemgetter(0))
            if (at == 0 or kept[at - 1][1] <= s) and (at == len(kept) or e <= kept[at][0]):
                insort(kept, (s, e, k, -m / len(self.templates[k])))
        return kept


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.8, stretch: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, found) of every row; found is an array of (start, end, license, coverage)."""
    ship(docs.sparkSession)
    templates = TEMPLATES if templates is None else templates
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("license", pa.string()), ("coverage", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, least, stretch)
        for b in batches:
            texts = b.column(1)
            found = [[{"start": s, "end": e, "license": k, "coverage": c} for s, e, k, c in scanner.scan(texts[i].as_py())] for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind)], names=["doc_id", "found"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lean(run), "doc_id long, found array<struct<start: int, end: int, license: string, coverage: double>>")


def op3_licenses(spark, sf_dir: str) -> DataFrame:
    shown = F.transform("found", lambda x: F.concat_ws(":", x["license"], x["start"], x["end"], F.format_number(x["coverage"], 3)))
    return scan(table(spark, sf_dir, "documents")).select("doc_id", F.size("found").cast("long").alias("n_found"), F.array_join(shown, ",").alias("licenses"))
