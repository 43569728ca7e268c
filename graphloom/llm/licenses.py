"""License scans: a paragraph classifier trained on perturbed notices, calibrated, confirmed by templates.

A paragraph is a run of lines with words, so a wrapped notice is in one piece.  It is looked at in units:
each line and each whole paragraph up to 64 words, and overlapping windows of 10, 24 and 64 words over all of
it, so that a notice of any length is found in a paragraph of any length.  A unit is a bag of hashed word 1-,
2- and 3-grams; sums over running totals score every unit.  A multinomial logistic regression over licence families
and an "unknown" class is fitted on windows of the templates below, with words dropped and replaced and ordinary
text around them, against ordinary windows of the corpus (a bounded sample) and scrambled notices.  The temperature
and the probability below which a family isn't claimed come from templates and paragraphs that a first fit has not
seen; the second fit takes them all.  A claim is confirmed if the unit shares half of its word pairs
with a template of the family, and more than with any of another.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import text as tx
from graphloom.llm.common import hashed_fraction, per_slice, texts

TEMPLATES = {
    "agpl-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "Licensed under the GNU Affero General Public License, version 3.", "Released under the AGPL-3.0 license.", "This work is licensed under the GNU Affero General Public License, version 3."],
    "all-rights-reserved": ["All rights reserved.", "Copyright (c) 2020 Example Inc. All rights reserved.", "No part of this work may be reproduced without prior written permission. All rights reserved.", "All rights reserved by the author."],
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0', "SPDX-License-Identifier: Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.', "Released under the Apache License 2.0.", "This project is available under the terms of the Apache License, Version 2.0."],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "Released under the BSD 3-Clause License.", "Licensed under the BSD 2-Clause License."],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Content is available under the CC BY 3.0 license."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Available under CC BY-NC-SA 4.0."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Text is available under the CC BY-SA 3.0 license."],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Released under CC0 1.0 Universal.", "Dedicated to the public domain under CC0."],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "Released under the GNU GPL version 3.", "Licensed under the GNU General Public License, version 2.", "This project is available under the terms of the GNU General Public License v3.0.", "Distributed under the GPL, version 2 or later."],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Released under the ISC License.", "Licensed under the ISC license.", "This project is available under the terms of the ISC License."],
    "lgpl": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", "Licensed under the GNU Lesser General Public License, version 3.", "This work is licensed under the GNU Lesser General Public License, version 3.", "Released under the LGPL-2.1 license."],
    "mit": [
        "Released under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
        "Licensed under the MIT license.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
        "This project is available under the terms of the MIT License, see LICENSE.",
    ],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0.", "Released under the MPL 2.0.", "This work is licensed under the Mozilla Public License, version 2.0."],
    "unlicense": ["This is free and unencumbered software released into the public domain.", "Released under the Unlicense."],
}
#: Sentences with the vocabulary of notices that grant nothing.
OTHERWISE = ["The driving licence must be renewed every ten years.", "Version 2.0 was released under great time pressure.", "The general public was not permitted to enter the work site.", "All seats are reserved.", "He has the right to remain silent.", "Our software is distributed in many countries.", "Permission to land was granted by the tower.", "The attribution of the painting to the master is disputed.", "A warranty of two years applies to all devices.", "The license plate was under the seat.", "The author lives in public housing.", "This work was published in 1984.", "See the file for the conditions of use.", "Copyright law is a difficult subject."]
BITS, GRAMS = 20, (1, 2, 3)
#: Words of a window; each begins half a window after the one before.
WINDOWS = (10, 24, 64)
#: Ordinary paragraphs of the corpus in the fit at most, and perturbed copies of each template.
MAX_PARAGRAPHS, COPIES = 1500, 40
#: Words scored at once; only a bound on memory.
CHUNK = 1 << 16
CONFIRM = 0.5
UNKNOWN = "unknown"


def _windows(begin: np.ndarray, end: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, stop) of the windows of `size` words over ranges that are longer than that; the last one ends with its range."""
    long = end - begin > size
    begin, end = begin[long], end[long]
    n = -(-(end - begin - size) // (size // 2)) + 1
    own = np.repeat(np.arange(len(n)), n)
    start = np.minimum(begin[own] + (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)) * (size // 2), end[own] - size)
    return start, start + size


def units(words: tx.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop) of each unit as word numbers, by start, and of every word its line and paragraph in its text."""
    n, text = len(words.start), words.text_of()
    ends = np.flatnonzero(words.data == 10)
    line = np.searchsorted(ends, words.start)
    step = np.diff(line, prepend=0)
    step[words.first[:-1][words.first[:-1] < n]] = 9
    fresh_line, fresh_paragraph = np.flatnonzero(step > 0), np.flatnonzero(step > 1)
    found = []
    line_end, paragraph_end = np.append(fresh_line[1:], n), np.append(fresh_paragraph[1:], n)
    short = line_end - fresh_line <= WINDOWS[-1]
    found.append((fresh_line[short], line_end[short]))
    wrapped = (paragraph_end - fresh_paragraph <= WINDOWS[-1]) & (np.searchsorted(fresh_line, paragraph_end) - np.searchsorted(fresh_line, fresh_paragraph) > 1)
    found.append((fresh_paragraph[wrapped], paragraph_end[wrapped]))
    found += [_windows(fresh_paragraph, paragraph_end, size) for size in WINDOWS]
    start, stop = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((stop, start))
    number = np.searchsorted(fresh_paragraph, np.arange(n), "right") - 1
    begin = words.first[:-1][text]
    return start[order], stop[order], line - np.searchsorted(ends, words.offsets[:-1])[text], number - number[begin] if n else number


def _buckets(hashes: np.ndarray, k: int) -> np.ndarray:
    """Bucket of the k-gram that begins at each of the words, those near the end left out."""
    n = max(0, len(hashes) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(tx._BASE) + hashes[j : n + j]
    return (tx.mix(out + np.uint64(k)) >> np.uint64(64 - BITS)).astype(np.int64)


def _once(buckets: np.ndarray, instead: int) -> np.ndarray:
    """The buckets with `instead` where one only repeats the one before it."""
    out = buckets.copy()
    out[1:][buckets[1:] == buckets[:-1]] = instead
    return out


def _bigrams(paragraph: str) -> set:
    words = re.findall(r"[0-9a-z\x80-\U0010ffff]+", paragraph.lower())
    return set(zip(words, words[1:])) | ({(words[0], "")} if len(words) == 1 else set())


_TEMPLATE_PAIRS = {family: [_bigrams(t) for t in ts] for family, ts in TEMPLATES.items()}


def similarity(paragraph: str, family: str) -> float:
    """Best share of word pairs in common with a template of the family, of the shorter of the two, three at least."""
    own = _bigrams(paragraph)
    return max((len(own & t) / max(3, min(len(own), len(t))) if len(t) > 2 else len(own & t) / len(t) for t in _TEMPLATE_PAIRS.get(family, [])), default=0.0)


@dataclass
class Model:
    names: list[str]  # the last is unknown
    used: np.ndarray  # buckets of the n-grams that some template has
    weight: np.ndarray  # a row for each of them
    bias: np.ndarray
    temperature: float
    threshold: float
    accuracy: float = 0.0

    def __post_init__(self):
        # row of each bucket; the last row is 0 and that of all other n-grams
        self.row = np.full(1 << BITS, len(self.used), np.int32)
        self.row[self.used] = np.arange(len(self.used))
        self.rows = np.vstack([self.weight, np.zeros((1, len(self.names)), np.float32)])

    def logits(self, hashes: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Scores of the units, which come by start, over the words with the given hashes.

        The sum over a unit's known n-grams by the root of their number, so that other text beside a notice doesn't
        count; an n-gram that only repeats the one before it counts once.
        """
        out = np.empty((len(start), len(self.names)))
        for a in range(0, len(start), CHUNK):
            b = min(a + CHUNK, len(start))
            low, high = int(start[a]), int(stop[a:b].max())
            own, begin, end = hashes[low:high], start[a:b] - low, stop[a:b] - low
            z, n = np.zeros((b - a, len(self.names))), np.zeros(b - a)
            for k in GRAMS:
                last = np.maximum(end - k + 1, begin)
                row = self.row[_once(_buckets(own, k), (1 << BITS) - 1)]
                live = np.flatnonzero(row < len(self.used))
                total = np.zeros((len(live) + 1, len(self.names)))
                np.cumsum(self.rows[row[live]], axis=0, dtype=np.float64, out=total[1:])
                first, until = np.searchsorted(live, begin), np.searchsorted(live, last)
                z += total[until] - total[first]
                n += until - first
            out[a:b] = z / np.sqrt(np.maximum(n, 1))[:, None] + self.bias
        return out

    def probabilities(self, hashes: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return _softmax(self.logits(hashes, start, stop) / self.temperature)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _examples(ordinary: list[str], seed: int) -> list[tuple[str, str, str]]:
    """(unit, label, source): all units of one source, a template or a paragraph, are held out together."""
    rng = random.Random(seed)
    stock = [p.split() for p in ordinary] or [["the", "of", "text"]]

    def filler(n: int) -> list[str]:
        own = rng.choice(stock)
        at = rng.randint(0, max(0, len(own) - n))
        return (own[at : at + n] * (n // max(1, len(own)) + 1))[:n]

    def unit(w: list[str]) -> list[str]:
        # alone on its lines, or in a window that holds most of itself or of the notice
        size = rng.choice((0, *WINDOWS))
        if not size:
            return w if len(w) <= WINDOWS[-1] else w[(at := rng.randint(0, len(w) - WINDOWS[-1])) : at + WINDOWS[-1]]
        held = min(len(w), rng.randint(-(-size * 6 // 10), size))
        at = rng.randint(0, len(w) - held)
        left = rng.randint(0, size - held)
        return filler(left) + w[at : at + held] + filler(size - held - left)

    found = []
    for family, templates in TEMPLATES.items():
        for t in templates:
            words = t.split()
            for i in range(COPIES if len(words) < 40 else 2 * COPIES):
                w = list(words)
                if i:
                    rate = rng.choice([0.0, 0.05, 0.12])
                    w = [x for x in w if rng.random() >= rate] or words
                    w = [filler(1)[0] if rng.random() < rate else x for x in w]
                    w = unit(w)
                one = " ".join(w[: WINDOWS[-1]])
                # without the word that names its family a notice is that of another, or as near to several and so of none
                near = {f: similarity(one, f) for f in TEMPLATES}
                top = [f for f, x in near.items() if x == max(near.values())]
                found.append((one, top[0] if len(top) == 1 else UNKNOWN, t))
            for _ in range(COPIES // 6):
                # the words of a notice out of order, among others: no notice
                w = rng.sample(words, max(1, min(20, len(words) // 3))) + filler(rng.randint(3, 12))
                rng.shuffle(w)
                found.append((" ".join(w), UNKNOWN, t))
    for t in OTHERWISE:
        found += [(" ".join(unit(t.split()) if i else t.split()), UNKNOWN, t) for i in range(12)]
    for p in ordinary:
        w = p.split()
        for size in WINDOWS:
            at = rng.randint(0, max(0, len(w) - size))
            found.append((" ".join(w[at : at + size]), UNKNOWN, p))
    rng.shuffle(found)
    return found


class _Fit:
    """Examples as sparse rows, and the weights found for some of them by full-batch Adam."""

    def __init__(self, examples: list[tuple[str, str, str]], names: list[str]):
        self.names, self.y = names, np.array([names.index(x) for _, x, _ in examples])
        words = tx.Words(tx.lower(pa.array([t for t, _, _ in examples], pa.string())))
        known = np.zeros(1 << BITS, bool)
        for t in [t for ts in TEMPLATES.values() for t in ts]:
            for k in GRAMS:
                known[_buckets(tx.Words(tx.lower(pa.array([t]))).hash, k)] = True
        known[-1] = False  # stands for a repeated one
        text, rows, columns = words.text_of(), [], []
        for k in GRAMS:
            own = _once(_buckets(words.hash, k), -1)
            inside = (text[: len(own)] == text[k - 1 : k - 1 + len(own)]) & known[own]
            rows.append(text[: len(own)][inside])
            columns.append(own[inside])
        row, n = np.concatenate(rows), len(examples)
        self.used, column = np.unique(np.concatenate(columns), return_inverse=True)
        self.scale = (1 / np.sqrt(np.maximum(np.bincount(row, minlength=n), 1))).astype(np.float32)
        order = np.argsort(row, kind="stable")
        self.by_row, self.at_row = column[order], np.searchsorted(row[order], np.arange(n + 1))
        order = np.argsort(column, kind="stable")
        self.by_column, self.at_column = row[order], np.searchsorted(column[order], np.arange(len(self.used) + 1))

    def logits(self, w: np.ndarray, b: np.ndarray) -> np.ndarray:
        return tx.segment_sum(w[self.by_row], self.at_row) * self.scale[:, None] + b

    def run(self, train: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
        classes = len(self.names)
        share = np.bincount(self.y[train], minlength=classes)
        each = ((1 / classes / np.maximum(share, 1))[self.y] * train).astype(np.float32)
        target = np.eye(classes, dtype=np.float32)[self.y]
        w, b = np.zeros((len(self.used), classes), np.float32), np.zeros(classes, np.float32)
        m, v = np.zeros((len(self.used) + 1, classes), np.float32), np.zeros((len(self.used) + 1, classes), np.float32)
        for step in range(1, rounds + 1):
            error = (_softmax(self.logits(w, b)) - target) * each[:, None]
            grad = np.vstack([tx.segment_sum((error * self.scale[:, None])[self.by_column], self.at_column) + 1e-6 * w, error.sum(axis=0)])
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            w, b = w - move[:-1], b - move[-1]
        return w, b


def held_out(examples: list[tuple[str, str, str]]) -> np.ndarray:
    """A quarter of the sources with all their units: the last of a family's templates and every fourth other source."""
    others = sorted({s for _, y, s in examples if y == UNKNOWN} - {t for ts in TEMPLATES.values() for t in ts})
    out = {t for ts in TEMPLATES.values() for i, t in enumerate(ts) if i % 4 == 3 or (i and i == len(ts) - 1 < 3)} | set(others[::4])
    return np.array([s in out for _, _, s in examples])


def fit(ordinary: list[str], seed: int = 5, rounds: int = 150) -> Model:
    """Fits on the templates and on ordinary paragraphs (those that look like a template are left out)."""
    ordinary = [p for p in ordinary if p.split() and all(similarity(p, f) < CONFIRM for f in TEMPLATES)]
    examples, names = _examples(ordinary, seed), [*sorted(TEMPLATES), UNKNOWN]
    data, held, unknown = _Fit(examples, names), held_out(examples), len(names) - 1
    z, right = data.logits(*data.run(~held, rounds))[held], data.y[held]
    loss = lambda t: -np.log(np.maximum(_softmax(z / t)[np.arange(len(right)), right], 1e-12)).mean()
    temperature = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 3.0, 4.0), key=loss)
    p = _softmax(z / temperature)
    best = p[:, :-1].max(axis=1)
    # a family is claimed above what the unseen unknown units reach
    threshold = float(np.clip(best[right == unknown].max(initial=0.5), 0.5, 0.9))
    called = np.where(best >= threshold, p[:, :-1].argmax(axis=1), unknown)
    w, b = data.run(np.ones(len(held), bool), rounds)
    return Model(names, data.used, w, b, float(temperature), threshold, float((called == right).mean()))


def train(docs: DataFrame, max_paragraphs: int = MAX_PARAGRAPHS, seed: int = 5) -> Model:
    """Fits in a task on about `max_paragraphs` ordinary paragraphs at most: one line of each seeded sample text and the two that follow it."""
    n = docs.where("text is not null").count()
    sample = texts(docs).where(F.col("doc_id").isNotNull() & hashed_fraction(F.col("doc_id"), max_paragraphs / max(1, n), seed))
    lines = F.split("text", "\n")
    at = F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.size(lines)).cast("int")
    one = sample.select(F.concat_ws(" ", F.slice(lines, at + 1, 3)).alias("p"))

    def run(rows: pa.Table) -> pa.Table:
        m = fit(sorted(rows.column("p").to_pylist()), seed)
        return pa.table({"names": [m.names], "used": pa.array([m.used.astype(np.int32)], pa.list_(pa.int32())), "weight": pa.array([m.weight.tobytes()], pa.binary()), "bias": [m.bias.astype(float).tolist()], **{k: [getattr(m, k)] for k in ("temperature", "threshold", "accuracy")}})

    made = one.groupBy().applyInArrow(run, "names array<string>, used array<int>, weight binary, bias array<double>, temperature double, threshold double, accuracy double").first()
    if made is None:  # an empty table has no ordinary paragraphs
        return fit([], seed)
    return Model(list(made.names), np.array(made.used), np.frombuffer(made.weight, np.float32).reshape(len(made.used), -1), np.array(made.bias, np.float32), made.temperature, made.threshold, made.accuracy)


def claims(column: pa.Array, model: Model) -> list[tuple[int, int, str, int, float, float, bool]]:
    """(text, paragraph, family, line, probability, similarity, confirmed) of each family claimed in a paragraph, by its best unit.

    The best unit is a confirmed one, then that of the highest probability times similarity, then the first; line is that of its first word.  A
    unit that overlaps a better one of another family claims nothing: it holds a part of the same notice.
    """
    words = tx.Words(tx.lower(tx.clean(column)))
    start, stop, line, paragraph = units(words)
    p = model.probabilities(words.hash, start, stop)
    family = p[:, :-1].argmax(axis=1) if len(p) else np.zeros(0, np.int64)
    chance = p[np.arange(len(p)), family]
    text, asked = words.text_of(), []
    for i in np.flatnonzero(chance >= model.threshold).tolist():
        a, b, name = int(start[i]), int(stop[i]), model.names[family[i]]
        own = words.data[words.start[a] : words.stop[b - 1]].tobytes().decode("utf-8", "replace")
        close = similarity(own, name)
        sure = close >= CONFIRM and all(similarity(own, f) < close for f in TEMPLATES if f != name)
        asked.append(((not sure, -round(float(chance[i]) * close, 4), i), round(float(chance[i]), 4), a, b, name, close, sure))
    asked.sort()
    best: dict = {}
    taken: dict = {}
    for _, probability, a, b, name, close, sure in asked:
        key = (int(text[a]), int(paragraph[a]))
        if all(b <= x or y <= a or other == name for x, y, other in taken.get(key, ())):
            taken.setdefault(key, []).append((a, b, name))
            best.setdefault((*key, name), (int(line[a]), probability, close, sure))
    return [(t, q, name, *found) for (t, q, name), found in sorted(best.items())]


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, paragraph, line, family, probability, similarity, confirmed): a row for each family claimed in a paragraph.

    Paragraphs are runs of lines with words and numbered from 0, and so are lines, empty ones included.  Null,
    empty and ordinary texts give no rows; repeated rows repeat their results; rows without a doc_id report
    a null id; of families with one probability the first by name is a unit's.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make(batch: pa.RecordBatch) -> dict:
        found = claims(batch.column(1), held.value)
        text, *rest = zip(*found) if found else [()] * 7
        paragraph, family, line, probability, close, sure = map(list, rest)
        return {"doc_id": batch.column(0).take(pa.array(text, pa.int64())), "paragraph": paragraph, "line": line, "family": family, "probability": probability, "similarity": np.round(np.array(close, float), 4), "confirmed": sure}

    return per_slice(texts(docs, id_col, text_col), make, "doc_id long, paragraph long, line long, family string, probability double, similarity double, confirmed boolean")
