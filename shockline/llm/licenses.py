"""Licence scanning with a trained paragraph classifier.

A sparse logistic regression over word uni- and bigrams gives each paragraph a
licence family or ``unknown``; its probabilities are calibrated with a
temperature on held-out paragraphs.  A prediction counts if the paragraph's
words also match a template of the family; between families whose templates
share almost all words, the words in which these differ decide.  Version
numbers say nothing about a family, so all digits count as one.  Paragraphs are lines, and windows
of about a template's length, which find notices that are wrapped over lines or
stand within a longer one; comment marks around lines are left out.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shockline.llm.text import PLACE, Run, Words, mix, slices, words

#: Wording of public licence notices and of typical paragraphs of the licences, by family.
TEMPLATES: dict[str, list[str]] = {
    "agpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Licensed under the Apache License, Version 2.0.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Released under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "cc-by": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "cc-by-nc": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
        "You may not use the material for commercial purposes.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "cc-by-sa": [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ],
    "cc0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Released under CC0 1.0 Universal, public domain dedication.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "gpl": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU General Public License, version 3.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "proprietary": [
        "All rights reserved. No part of this work may be reproduced or distributed without the prior written permission of the owner.",
        "This software is proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited.",
        "SPDX-License-Identifier: LicenseRef-Proprietary",
    ],
}
UNKNOWN = "unknown"
WIDTH = 1 << 13
#: Marks around words that don't belong to them; characters outside of words are white space here.
TRIM = np.arange(256, dtype=np.uint8)
TRIM[[*b"\"'(),;:<>[]{}!?"]] = 32
TRIM[48:58] = 48
#: Bytes that frame the lines of a comment.
MARK = np.zeros(256, dtype=bool)
MARK[[*b" \t\r\v\f\"'(),;:<>[]{}!?#*/%|=~-"]] = True


@dataclass
class Paragraphs:
    """Lines with a word; first[i]: document i's first.  begin, end: bytes; tokens: edges in words; words: all of the run."""

    begin: np.ndarray
    end: np.ndarray
    tokens: np.ndarray
    first: np.ndarray
    words: Words


def plain(run: Run) -> Run:
    """The run without marks around words and without the comment marks that begin and end its lines."""
    data = TRIM[run.data]
    if len(data):
        body = ~MARK[run.data]
        begin = np.unique(np.concatenate([[0], np.flatnonzero(run.data == 10) + 1, run.offsets]))
        begin = begin[begin < len(data)]
        before = np.zeros(len(data) + 1, np.int64)
        np.cumsum(body & (run.data != 10), out=before[1:])
        lens = np.diff(np.append(begin, len(data)))
        opens, closes = np.repeat(before[begin], lens), np.repeat(before[np.append(begin[1:], len(data))], lens)
        data[((before[1:] == opens) | (before[:-1] == closes)) & (data != 10)] = 32
    return Run(run.first, data, run.offsets)


def paragraphs(run: Run) -> Paragraphs:
    """Each line with a word besides comment marks."""
    w = words(plain(run), lower=True)
    data = run.data
    cuts = np.unique(np.concatenate([np.flatnonzero(data == 10) + 1, run.offsets]))
    cuts = cuts[cuts <= len(data)]
    begin, end = cuts[:-1], cuts[1:]
    a, b = np.searchsorted(w.start, begin), np.searchsorted(w.start, end)
    solid = b > a
    begin, end = begin[solid], end[solid]
    return Paragraphs(begin, end, np.append(a[solid], len(w.start)), np.searchsorted(begin, run.offsets), w)


def bags(h: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of the words and word pairs of spans of h, interleaved, and the spans' edges in them."""
    uni = (mix(h) % np.uint64(WIDTH)).astype(np.int64)
    prev = np.zeros_like(h)
    prev[1:] = h[:-1]
    prev[edges[:-1][edges[:-1] < len(h)]] = 0
    bi = (mix(prev * PLACE[0] + h * PLACE[1]) % np.uint64(WIDTH)).astype(np.int64)
    return np.stack([uni, bi], axis=1).ravel(), 2 * edges


@dataclass
class Classifier:
    """weights[feature, family], bias, temperature; family 0 is unknown."""

    families: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def probabilities(self, h: np.ndarray, edges: np.ndarray) -> np.ndarray:
        if len(edges) < 2:
            return np.zeros((0, len(self.families)))
        features, cuts = bags(h, edges)
        total = np.zeros((len(edges) - 1, len(self.families)))
        for k in range(0, len(total), 4096):  # spans at a time
            a, b = cuts[k], cuts[min(k + 4096, len(total))]
            total[k : k + 4096] = np.add.reduceat(self.weights[features[a:b]], cuts[k : min(k + 4096, len(total))] - a, axis=0)
        z = (total / np.sqrt(np.diff(cuts))[:, None] + self.bias) / self.temperature
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        return p / p.sum(axis=1, keepdims=True)


def token_hashes(text: str) -> np.ndarray:
    run = next(slices(pa.array([text])), None)
    if run is None:
        return np.zeros(0, np.uint64)
    return words(plain(run), lower=True).hash


def fit(negatives: list[np.ndarray], seed: int = 5, copies: int = 30, rounds: int = 120, rate: float = 0.5, decay: float = 1e-5) -> Classifier:
    """Trains on noisy copies of the templates (words dropped, cut to a part, framed by other words) against
    paragraphs that are none; every fifth example is held out to find the temperature."""
    rng = np.random.default_rng(seed)
    families = [UNKNOWN, *sorted(TEMPLATES)]
    pool = np.concatenate(negatives) if negatives else mix(np.arange(5000, dtype=np.uint64))
    examples: list[tuple[np.ndarray, int]] = [(n, 0) for n in negatives if len(n)]
    for k, family in enumerate(families[1:], 1):
        for text in TEMPLATES[family]:
            h = token_hashes(text)
            examples.append((h, k))
            for _ in range(copies):
                part = h[rng.random(len(h)) > 0.08]
                if len(part) > 14 and rng.random() < 0.5:
                    a = int(rng.integers(0, len(part) // 3))
                    part = part[a : a + int(rng.integers(len(part) // 2, len(part) + 1))]
                if rng.random() < 0.4:
                    part = np.concatenate([rng.choice(pool, int(rng.integers(1, 12))), part, rng.choice(pool, int(rng.integers(1, 12)))])
                if len(part):
                    examples.append((part, k))
    for _ in range(len(TEMPLATES) * copies):  # words of licences in any order say nothing
        a = token_hashes(str(rng.choice(sum(TEMPLATES.values(), []))))
        examples.append((rng.permutation(np.concatenate([rng.choice(pool, 20), rng.choice(a, 3)])), 0))
    edges = np.zeros(len(examples) + 1, np.int64)
    np.cumsum([len(h) for h, _ in examples], out=edges[1:])
    features, cuts = bags(np.concatenate([h for h, _ in examples]), edges)
    y = np.array([k for _, k in examples])
    rows = np.repeat(np.arange(len(y)), np.diff(cuts))
    scale = 1 / np.sqrt(np.diff(cuts))
    held = np.arange(len(y)) % 5 == 4
    weight = np.where(held, 0, 1 / np.bincount(y, minlength=len(families))[y]) / len(families)
    w, b = np.zeros((WIDTH, len(families))), np.zeros(len(families))
    gold = np.eye(len(families))[y]
    m, v = np.zeros_like(w), np.zeros_like(w)

    def logits() -> np.ndarray:
        return np.add.reduceat(w[features], cuts[:-1], axis=0) * scale[:, None] + b

    def softmax(z: np.ndarray) -> np.ndarray:
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    for step in range(1, rounds + 1):
        g = (softmax(logits()) - gold) * weight[:, None]
        grad = np.stack([np.bincount(features, weights=(g[:, k] * scale)[rows], minlength=WIDTH) for k in range(len(families))], axis=1) + decay * w
        m += 0.1 * (grad - m)
        v += 0.001 * (grad * grad - v)
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-6)
        b -= rate * g.sum(axis=0)
    z = logits()[held]
    losses = {t: -np.log(softmax(z / t)[np.arange(len(z)), y[held]] + 1e-12).mean() for t in (0.5, 0.7, 1.0, 1.5, 2.0, 3.0, 5.0)}
    return Classifier(families, w.astype(np.float32), b, min(losses, key=losses.get))


CUE = r"(?i)(licen[sc]|copyright|permission|redistribut|warrant|all rights|spdx|creative commons|public domain)"


PIECES = "of long, at long, words binary"


def train(docs: DataFrame, sample: int = 400, per_document: int = 20, piece_words: int = 64) -> Classifier:
    """Fits the classifier; its examples of no licence are a bounded sample of paragraphs.

    Of the ``sample`` documents with the lowest hash of doc_id and text, whole
    texts are cut into lines and these into pieces of at most ``piece_words``
    words; those of the ``per_document`` lowest hashes that hold no licence word
    count.  The choice doesn't depend on the order of rows or tasks.
    """
    keyed = docs.where("text is not null").select(F.xxhash64("doc_id", "text").alias("of"), "text")
    lowest = [r["of"] for r in keyed.select("of").distinct().orderBy("of").limit(sample).collect()]
    if not lowest:
        return fit([])

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), []
            for i, text in zip(ids, batch.column(1).to_pylist(), strict=True):
                pieces = []
                for line in text.split("\n"):
                    found = line.split(" ")
                    pieces += [" ".join(found[k : k + piece_words]) for k in range(0, len(found), piece_words)]
                some = sorted({(zlib.crc32(x.encode()), x) for x in pieces if x.strip() and not re.search(CUE, x)})[:per_document]
                out += [(i, h, token_hashes(x).tobytes()) for h, x in some]
            cols = list(zip(*out, strict=True)) if out else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["of", "at", "words"])

    rows = keyed.where(F.col("of") <= lowest[-1]).mapInArrow(mapped, PIECES).distinct().orderBy("of", "at", "words").collect()
    return fit([np.frombuffer(r["words"], np.uint64) for r in rows if r["words"]])


@dataclass
class Template:
    """words in order; has[v]: whether it holds word v of the vocabulary; need: distinct words that confirm; reach: a window's length.

    rivals: templates of other families that share almost all words with it.
    """

    family: str
    words: list[int]
    has: np.ndarray
    need: int
    reach: int

    def __post_init__(self) -> None:
        self.set = set(self.words)
        self.rivals: list[Template] = []

    def is_like(self, other: "Template") -> bool:
        return self.family != other.family and len(self.set & other.set) >= 0.75 * len(self.set | other.set)


def templates(least: float) -> tuple[np.ndarray, list[Template]]:
    """The sorted vocabulary of all templates, and the templates; a window holds a quarter more words than a template, and two."""
    texts = [(f, token_hashes(t)) for f, found in TEMPLATES.items() for t in found]
    vocabulary = np.unique(np.concatenate([h for _, h in texts]))
    found = [Template(f, h.tolist(), np.isin(vocabulary, h), math.ceil(least * len(set(h.tolist())) - 1e-9), len(h) + len(h) // 4 + 2) for f, h in texts]
    for t in found:
        t.rivals = [r for r in found if t.is_like(r)]
    return vocabulary, found


def confirmed(h: np.ndarray, found: list[Template], least: float) -> tuple[str, float, float, int]:
    """Family, share, fit and reach of the template that a paragraph fits best, and "" if none is held to ``least``.

    The fit is the share of a template's distinct words that the paragraph
    holds, times their number; the share is the largest of the family.  Of a
    template and its rivals that one counts which agrees with the paragraph
    in the most of the words in which they differ.
    """
    own = set(h.tolist())
    held = [(len(own & t.set) ** 2 / len(t.set), t.reach, t) for t in found if len(own & t.set) >= least * len(t.set)]
    if not held:
        return "", 0.0, 0.0, 0
    fit, _, best = max(held, key=lambda x: x[:2])
    alike = [best, *(r for r in best.rivals if len(own & r.set) >= least * len(r.set))]
    every = set().union(*(t.set for t in alike))
    best = max(alike, key=lambda t: (-len((own & every) ^ t.set), t is best))
    share = max(len(own & t.set) / len(t.set) for t in found + alike if t.family == best.family)
    return best.family, share, fit, best.reach


def windows(h: np.ndarray, floor: np.ndarray, vocabulary: np.ndarray, found: list[Template]) -> list[tuple[int, int]]:
    """Spans of words that may hold a template, the closest around its words.

    floor[k]: the first word that may be in a span with word k; words in none have len(h).  Within a template's
    reach from each of its words on, distinct ones are counted: a word counts for the starts after its last place.
    """
    v = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
    at = np.flatnonzero((vocabulary[v] == h) & (floor < len(h)))
    v = v[at]
    order = np.lexsort((at, v))
    last = np.full(len(at), -1)
    same = v[order][1:] == v[order][:-1]
    last[order[1:][same]] = at[order[:-1][same]]
    last = np.maximum(last, floor[at] - 1)
    spans = []
    for t in found:
        few = np.flatnonzero(t.has[v])
        if len(few) < t.need:
            continue
        p, ids = at[few], v[few]
        since = np.searchsorted(p, np.maximum(last[few], p - t.reach), side="right")
        count = np.cumsum(np.bincount(since, minlength=len(p))) - np.arange(len(p))
        good = np.flatnonzero(count >= t.need)
        k = 0
        while k < len(good):
            near = good[k : int(np.searchsorted(good, np.searchsorted(p, p[good[k]] + t.reach)))]
            near = near[floor[p[near]] == floor[p[good[k]]]]
            a = int(near[count[near].argmax()])
            most, seen, b = int(count[a]), set(), a
            while len(seen) < most:
                seen.add(int(ids[b]))
                b += 1
            seen, a = set(), b
            while len(seen) < most:
                a -= 1
                seen.add(int(ids[a]))
            spans.append(extended(h, floor, int(p[a]), int(p[b - 1]) + 1, t.words))
            k = max(k + 1, int(np.searchsorted(good, b)))
    return sorted(set(spans))


def extended(h: np.ndarray, floor: np.ndarray, a: int, b: int, text: list[int]) -> tuple[int, int]:
    """The span with the words before and after it that the template has there too."""

    def steps(k: int, move: int) -> int:
        most = 0
        for j in (j for j, word in enumerate(text) if word == int(h[k])):
            n = 1
            while 0 <= k + n * move < len(h) and 0 <= j + n * move < len(text) and floor[k + n * move] == floor[k] and int(h[k + n * move]) == text[j + n * move]:
                n += 1
            most = max(most, n - 1)
        return most

    return a - steps(a, -1), b + steps(b - 1, 1)


PARAGRAPHS = "doc_id long, paragraph int, start long, end long, family string, probability double, template_share double"


def notices(found: Paragraphs, model: Classifier, vocabulary: np.ndarray, known: list[Template], least_probability: float, least_share: float) -> list[tuple]:
    """(first word, end, line or -1, family, probability, share) of the notices of a run; no two share a word.

    Of lines and windows that do, the one that fits a template best stays (share times words held), then a line of
    no more than the template's reach, then the shorter.  The words left are searched again until no more is found.
    The probability is that of the predicted family and of those with templates like its own, between which the
    comparison decides.
    """
    h = found.words.hash
    by_family = {f: [t for t in known if t.family == f] for f in TEMPLATES}
    groups = {f: [f, *sorted({r.family for t in by_family[f] for r in t.rivals})] for f in TEMPLATES}
    together = np.eye(len(model.families))
    for k, f in enumerate(model.families[1:], 1):
        together[k, [model.families.index(g) for g in groups[f]]] = 1
    doc = np.repeat(found.words.first[:-1], np.diff(found.words.first))
    floor, taken = doc.copy(), []

    def likely(words: np.ndarray, edges: np.ndarray, starts: np.ndarray, line: bool) -> Iterator[tuple]:
        p = model.probabilities(words, edges)
        best = p.argmax(axis=1) if len(p) else np.zeros(0, int)
        p = (p * together[best]).sum(axis=1).clip(0, 1)
        for k in np.flatnonzero((best > 0) & (p >= least_probability)).tolist():
            own, n = words[edges[k] : edges[k + 1]], int(edges[k + 1] - edges[k])
            family, share, held, reach = confirmed(own, [t for f in groups[model.families[best[k]]] for t in by_family[f]], least_share)
            if family:
                yield -held, not line or n > reach, n, int(starts[k]), int(starts[k]) + n, k if line else -1, family, float(p[k]), share

    chosen = list(likely(h, found.tokens, found.tokens, True))
    while True:
        spans = windows(h, floor, vocabulary, known)
        edges = np.zeros(len(spans) + 1, np.int64)
        np.cumsum([b - a for a, b in spans], out=edges[1:])
        if spans:
            chosen += likely(np.concatenate([h[a:b] for a, b in spans]), edges, np.array([a for a, _ in spans]), False)
        new = []
        for *_, a, b, line, family, probability, share in sorted(chosen):
            if floor[a] < len(h) and (floor[a:b] == floor[a]).all():
                floor[a:b] = len(h)
                new.append((a, b, line, family, probability, share))
        if not new:
            return sorted(taken)
        taken += new
        # Only documents with a new notice are searched again, and no span may cross one.
        after = np.append(doc, len(h))
        for _, b, *_ in taken:
            after[b] = b
        again = np.isin(doc, doc[[a for a, *_ in new]]) & (floor < len(h))
        floor, chosen = np.where(again, np.maximum.accumulate(after)[:-1], len(h)), []


def scan(docs: DataFrame, model: Classifier, least_probability: float = 0.5, least_share: float = 0.6) -> DataFrame:
    """One row per notice of a confirmed licence family (columns PARAGRAPHS; start and end in code points).

    A notice is a line, or words of about a template's length that run over
    lines or stand within one, anywhere in the text; no two overlap.
    ``paragraph`` is the place of its first line among the document's lines
    with a word.  Null, empty and blank texts have none; repeated rows and null
    ids give rows of their own; among equal probabilities the first family by
    name wins; an empty table gives no rows.
    """
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64()]
    names = [c.split()[0] for c in PARAGRAPHS.split(", ")]
    vocabulary, known = templates(least_share)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            for run in slices(batch.column(1)):
                found = paragraphs(run)
                for a, b, line, family, probability, share in notices(found, model, vocabulary, known, least_probability, least_share):
                    k = int(np.searchsorted(found.tokens, a, side="right")) - 1
                    i = int(np.searchsorted(found.first, k, side="right")) - 1
                    begin, end = (found.begin[k], found.end[k]) if line >= 0 else (found.words.start[a], found.words.end[b - 1])
                    head = run.data[run.offsets[i] : begin].tobytes().decode()
                    body = run.data[begin:end].tobytes().decode().rstrip("\n")
                    rows.append((ids[run.first + i], k - int(found.first[i]), len(head), len(head) + len(body), family, probability, share))
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in types]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    return docs.select("doc_id", "text").mapInArrow(mapped, PARAGRAPHS)


def digest(docs: DataFrame, model: Classifier | None = None) -> DataFrame:
    """Per document id: n_licenses (notices), families (joined, in order of name), best family and its probability."""
    found = scan(docs, model or train(docs))
    per = found.groupBy("doc_id").agg(
        F.count("*").alias("n_licenses"),
        F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"),
        F.max_by("family", F.struct("probability", "family")).alias("family"),
        F.max("probability").alias("probability"),
    )
    out = docs.select("doc_id").distinct().join(per.withColumnRenamed("doc_id", "_id"), F.col("doc_id").eqNullSafe(F.col("_id")), "left").drop("_id")
    return out.select("doc_id", F.coalesce("n_licenses", F.lit(0)).cast("long").alias("n_licenses"), F.coalesce("families", F.lit("")).alias("families"), F.coalesce("family", F.lit(UNKNOWN)).alias("family"), F.coalesce("probability", F.lit(0.0)).alias("probability"))
