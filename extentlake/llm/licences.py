"""Licence scans with a trained paragraph classifier.

A paragraph is a line with a word, or a run of such lines (a wrapped notice).  It is a sparse bag of hashed 1-, 2- and 3-grams of its
words.  A logistic regression over the families in TEMPLATES and a class `none` gives probabilities, calibrated by a
temperature.  A family is found when its probability reaches CONFIDENT and the paragraph resembles one of its templates: the
share of the template's 3-word shingles that it holds, or of its own that the template holds, reaches CONFIRMED.  What is
nearest to a family but less sure than that, and holds at least HINTS pairs of words in a row that templates have, is `unknown`.  A run is
told where none of its lines has the family by itself, and unknown where none of its lines is anything.

The classifier is trained here, by full-batch gradient steps, on damaged copies of the templates and on generated and template-like text
without a licence (EXAMPLES a family, fixed seed), on the driver and once a process; its weights are a sorted hash array.

Only paragraphs with a pair of words in a row that a template has (as most have none, found by one vectorised look-up over all words) are
scored: all others are `none`.  Nulls: a null or empty text has no paragraph.  Repeated rows: each gives a
row.  Extra columns are not read.  An empty table gives no rows.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernel import ALNUM, slices, windows, word_bounds, word_hashes
from .shared import table

EXAMPLES, STEPS, RATE, RIDGE = 60, 150, 2.0, 1e-4
CONFIDENT, CONFIRMED, HINTS = 0.7, 0.6, 4
UNKNOWN = "unknown"
#: Opening or notice texts of common licences, and their short forms, by family.
TEMPLATES = {
    "agpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Released under the BSD License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0.", "SPDX-License-Identifier: CC-BY-4.0"],
    "cc-by-nc": ["This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "cc-by-sa": ["This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0.", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "cc0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "This work is dedicated to the public domain under CC0 1.0 Universal.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "epl": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
        "SPDX-License-Identifier: EPL-2.0",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Released under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
    ],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "SPDX-License-Identifier: Unlicense",
    ],
}
FAMILIES = [*sorted(TEMPLATES), "none"]


def _hashed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    data = [t.encode() for t in texts]
    at = np.concatenate([[0], np.cumsum([len(d) for d in data])])
    text = np.frombuffer(b"".join(data), np.uint8)
    start, end, before = word_bounds(text, at, ALNUM)
    return word_hashes(text, start, end, True), before


def grams(words: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of 1-, 2- and 3-grams of all paragraphs, and the paragraph of each."""
    values, owners = [], []
    for k in (1, 2, 3):
        value, cut = windows(words, before, k)
        values.append(value)
        owners.append(np.repeat(np.arange(len(before) - 1), np.diff(cut)))
    return np.concatenate(values), np.concatenate(owners)


class Classifier:
    """Sorted hashes of the templates' n-grams, a weight of each for every family, a temperature, and the templates' shingles."""

    def __init__(self) -> None:
        texts, label = _training()
        words, before = _hashed([t for f in FAMILIES[:-1] for t in TEMPLATES[f]])
        self.vocabulary = np.unique(grams(words, before)[0])
        x = self._bags(*grams(*_hashed(texts)), len(texts))
        y = np.eye(len(FAMILIES))[label]
        held = np.arange(len(texts)) % 5 == 0
        self.weights, self.offset, self.temperature = np.zeros((len(self.vocabulary), len(FAMILIES))), np.zeros(len(FAMILIES)), 1.0
        for _ in range(STEPS):
            error = (y - self._softmax(x @ self.weights + self.offset))[~held] / (~held).sum()
            self.weights += RATE * (len(FAMILIES) * x[~held].T @ error - RIDGE * self.weights)
            self.offset += RATE * error.sum(0)
        logits = x[held] @ self.weights + self.offset
        loss = {t: -np.log(np.maximum(self._softmax(logits / t)[np.arange(len(logits)), label[held]], 1e-9)).mean() for t in (0.25, 0.5, 0.75, 1.0, 1.5, 2.0)}
        self.temperature = min(loss, key=loss.get)
        self.templates = []
        for f, name in enumerate(FAMILIES[:-1]):
            for t in TEMPLATES[name]:
                words, before = _hashed([t])
                self.templates.append((f, np.unique(windows(words, before, min(3, len(words)))[0])))

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def _bags(self, value: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        at, ok = self.known(value)
        x = np.zeros((n, len(self.vocabulary)))
        x[owner[ok], at[ok]] = 1
        return x / np.maximum(np.sqrt(x.sum(1, keepdims=True)), 1)

    def known(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.vocabulary, value), len(self.vocabulary) - 1)
        return at, self.vocabulary[at] == value

    def classified(self, words: np.ndarray, before: np.ndarray) -> list[tuple[int, str, float, float]]:
        """(paragraph, family or unknown, probability, resemblance) of paragraphs with either."""
        pair, cut = windows(words, before, 2)
        _, ok = self.known(pair)
        hints = np.concatenate([[0], np.cumsum(ok)])[cut]
        hints = hints[1:] - hints[:-1]
        close = np.flatnonzero(hints > 0)
        out = []
        for first in range(0, len(close), 512):
            some = close[first : first + 512]
            size = np.diff(before)[some]
            cut = np.concatenate([[0], np.cumsum(size)])
            at = np.repeat(before[some] - cut[:-1], size) + np.arange(int(size.sum()))
            own = words[at]
            p = self._softmax((self._bags(*grams(own, cut), len(some)) @ self.weights + self.offset) / self.temperature)
            best = p.argmax(1)
            for i in np.flatnonzero(best < len(FAMILIES) - 1):
                mine = np.unique(windows(own[cut[i] : cut[i + 1]], np.array([0, size[i]]), int(min(3, size[i])))[0])
                alike = 0.0
                for f, shingles in self.templates:
                    if f == best[i]:
                        common = len(np.intersect1d(mine, shingles, assume_unique=True))
                        alike = max(alike, common / len(shingles), common / len(mine) if len(mine) >= 4 else 0.0)
                if alike >= CONFIRMED and p[i].max() >= CONFIDENT:
                    out.append((int(some[i]), FAMILIES[best[i]], float(p[i, best[i]]), alike))
                elif hints[some[i]] >= HINTS:
                    out.append((int(some[i]), UNKNOWN, float(p[i, best[i]]), alike))
        return out

    def scanned(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[list[tuple[str, int, float]]]]:
        """How many lines with a word each text has, and (family or unknown, line, probability) of what it holds."""
        breaks = np.flatnonzero(data == 10) + 1
        edges = np.unique(np.concatenate([at, breaks, [0, len(data)]]))
        start, stop, before = word_bounds(data, edges, ALNUM)
        words = word_hashes(data, start, stop, True)
        doc = np.searchsorted(at, edges[:-1], "right") - 1
        filled = np.diff(before) > 0
        n = np.bincount(doc[filled], minlength=len(at) - 1) if len(doc) else np.zeros(len(at) - 1, np.int64)
        found: list[list] = [[] for _ in range(len(at) - 1)]
        if not len(words):
            return n, found
        newline = np.concatenate([[0], np.cumsum(data == 10)])
        line = lambda p: int(newline[edges[p]] - newline[at[doc[p]]])
        held: dict[int, set] = {}
        for p, family, chance, _ in self.classified(words, before):
            found[doc[p]].append((family, line(p), chance))
            held.setdefault(p, set()).add(family)
        # runs of two filled lines or more within a text
        new = np.ones(len(filled), bool)
        new[1:] = ~filled[1:] | ~filled[:-1] | (doc[1:] != doc[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(filled))
        first, last = first[last - first > 1], last[last - first > 1]
        if len(first):
            size = before[last] - before[first]
            cut = np.concatenate([[0], np.cumsum(size)])
            own = words[np.repeat(before[first] - cut[:-1], size) + np.arange(int(size.sum()))]
            for r, family, chance, _ in self.classified(own, cut):
                lines = set().union(*(held.get(p, ()) for p in range(first[r], last[r])))
                if family not in lines and not (family == UNKNOWN and lines):
                    found[doc[first[r]]].append((family, line(first[r]), chance))
        return n, [sorted(x, key=lambda y: (y[1], y[0])) for x in found]


def _training() -> tuple[list[str], np.ndarray]:
    rnd = random.Random(11)
    filler = lambda: "".join(rnd.choice(["th", "er", "on", "an", "re", "la", "de", "ung", "ment", "os"]) for _ in range(rnd.randint(1, 4)))
    common = "the of and to in is it that for with this by as on under source work terms license version public use file copy software free general".split()
    texts, label = [], []
    for f, name in enumerate(FAMILIES[:-1]):
        for i in range(EXAMPLES):
            words = TEMPLATES[name][i % len(TEMPLATES[name])].split()
            if i >= len(TEMPLATES[name]):
                words = [filler() if rnd.random() < 0.08 else w for w in words if rnd.random() > 0.06] or words
                words = [filler() for _ in range(rnd.choice([0, 0, 0, 3]))] + words + [filler() for _ in range(rnd.choice([0, 0, 4]))]
            texts.append(" ".join(words))
            label.append(f)
    everything = [w for t in TEMPLATES.values() for s in t for w in s.split()]
    for _ in range(EXAMPLES * len(FAMILIES)):
        pool = rnd.choice([common, [filler() for _ in range(12)], everything, common + [filler() for _ in range(9)]])
        texts.append(" ".join(rnd.choice(pool) for _ in range(rnd.randint(3, 30))))
        label.append(len(FAMILIES) - 1)
    return texts, np.array(label)


@lru_cache(maxsize=1)
def trained() -> Classifier:
    return Classifier()


def scanned(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_paragraphs, n_licences, n_unknown, families, findings): findings are family:line:probability, comma-joined; lines count from 0."""
    sent = docs.sparkSession.sparkContext.broadcast(trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, at in slices(batch.column(1)):
                n, rows = sent.value.scanned(data, at)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, end - first),
                        pa.array(n, pa.int64()),
                        pa.array([sum(x[0] != UNKNOWN for x in r) for r in rows], pa.int64()),
                        pa.array([sum(x[0] == UNKNOWN for x in r) for r in rows], pa.int64()),
                        pa.array([",".join(sorted({x[0] for x in r} - {UNKNOWN})) for r in rows], pa.string()),
                        pa.array([",".join(f"{f}:{line}:{c:.3f}" for f, line, c in r) for r in rows], pa.string()),
                    ],
                    ["doc_id", "n_paragraphs", "n_licences", "n_unknown", "families", "findings"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_paragraphs long, n_licences long, n_unknown long, families string, findings string")


def op6_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(table(spark, sf_dir, "documents"))


QUERIES = {"op6_licence_scan": op6_licence_scan}
SQL: dict[str, str] = {}
