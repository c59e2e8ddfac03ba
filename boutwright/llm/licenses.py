"""Licence scans: a trained paragraph classifier with template confirmation.

A paragraph is a line with a word; lines that a notice is wrapped over are also joined and read as
one. Each paragraph that holds a word of ``SCORED`` is scored by a multinomial logistic
regression over sparse word 1- to 3-grams, with one class a licence family and one for unknown.
It is trained here on the templates below, on their variants (names filled in, words dropped,
notices joined), and, as the unknown class, on the scored
paragraphs and first lines of bounded samples of the corpus that are unlike every template. The unknown class is calibrated on held-out variants: a temperature by least log loss, and
a threshold that at most 1 in 1,000 held-out unknowns pass. A prediction stands only if the
paragraph also holds 0.8 of the word 3-grams of a template of that family.

``SCORED`` is ``GATES`` and, derived from the templates, the words without which less than
``CONFIRM`` of a template's 3-grams are left; so paragraphs without any of it cannot be confirmed
and are not scored. Found are paragraphs with a word of ``GATES``, and all that are confirmed.

Defined cases: null and empty texts have no paragraphs; of families of equal probability the
first by name wins; repeated rows are scanned each; an empty table gives an empty result; other
input columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

#: Labelled-negative paragraphs come from at most so many documents (least id hash).
SAMPLE = 500
DIMS = 1 << 15
UNKNOWN = "unknown"
CONFIRM = 0.8
GATES = ("licen", "copyright", "permission", "public domain", "warranty", "redistribution", "spdx", "rights reserved")

#: Short notices of public licences, by family.
TEMPLATES = {
    "agpl": ["This program is licensed under the GNU Affero General Public License, version 3.", "Licensed under the AGPL-3.0 license."],
    "apache": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "SPDX-License-Identifier: Apache-2.0", "Released under the Apache License 2.0."],
    "bsd": ["Released under the BSD License.", "Licensed under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "SPDX-License-Identifier: BSD-3-Clause"],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc0": ["Licensed under CC0 1.0 Universal.", "Released into the public domain.", "This work is dedicated to the public domain."],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "This work is licensed under the GNU General Public License, version 2.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.", "Licensed under the GPL-3.0 license."],
    "isc": ["Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."],
    "lgpl": ["This library is licensed under the GNU Lesser General Public License, version 3.", "Licensed under the LGPL-2.1 license."],
    "mit": ["Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.", "SPDX-License-Identifier: MIT"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0."],
    "proprietary": ["All rights reserved.", "Copyright. All rights reserved.", "All rights reserved. No part of this work may be reproduced without written permission."],
}
#: Words that lead into notices in training variants, and unknown paragraphs that only mention licences.
LEADS = ("", "Note: ", "This project is ", "The text: ", "Copyright 2020 the authors. ")
MENTIONS = ("Please read the license before use.", "The driver license office opens at nine.", "He asked for permission to leave.", "A license fee applies to each copy.", "The warranty lasts two years.", "Copyright law differs between countries.", "They granted a fishing license to the public.", "Your license agreement version is out of date.")

_WORD = re.compile(r"[a-z0-9]+(?:[-.][a-z0-9]+)*")


def tokens(paragraph: str) -> list[str]:
    return _WORD.findall(paragraph.lower())


def grams(ws: list[str], sizes: tuple[int, ...] = (1, 2, 3)) -> set[str]:
    return {" ".join(ws[i : i + n]) for n in sizes for i in range(len(ws) - n + 1)}


def shape(template: str) -> set[str]:
    """What a paragraph is compared with: the 3-grams, or all grams of a shorter template."""
    ws = tokens(template)
    return grams(ws, (3,)) or grams(ws)


def scored_words() -> tuple[str, ...]:
    out = list(GATES)
    for t in (t for ts in TEMPLATES.values() for t in ts):
        grams_ = shape(t)
        # only within a word: what stands between the words of a paragraph is not known
        while len(left := [g for g in grams_ if not any(x in w for w in g.split() for x in out)]) / len(grams_) >= CONFIRM:
            out.append(max({w for g in left for w in g.split()}, key=lambda w: (len(w), w)))
    return tuple(out)


SCORED = scored_words()
SHAPES = [(f, shape(t)) for f, ts in TEMPLATES.items() for t in ts]
#: A notice is wrapped over as many lines with a word as the longest template has words, at most.
WRAP = max(len(tokens(t)) for ts in TEMPLATES.values() for t in ts)
#: The templates of a gram.
INDEX: dict[str, list[int]] = {}
for _t, (_, _s) in enumerate(SHAPES):
    for _g in _s:
        INDEX.setdefault(_g, []).append(_t)


def hashed(paragraph: str) -> np.ndarray:
    """Sparse features of a paragraph: distinct columns."""
    return np.array(sorted({zlib.crc32(g.encode()) % DIMS for g in grams(tokens(paragraph))}), np.int64)


class Sparse:
    """Examples as sorted sparse rows, for sums by row and by column."""

    def __init__(self, examples: list[np.ndarray]):
        size = np.array([len(e) for e in examples], np.int64)
        self.n, self.filled = len(examples), np.flatnonzero(size)
        self.owner, self.cols = np.repeat(np.arange(len(examples)), size), np.concatenate([*examples, np.zeros(0, np.int64)])
        self.value = (1 / np.sqrt(size.clip(1)))[self.owner][:, None]
        self.starts = (np.cumsum(size) - size)[self.filled]
        self.by_col = np.argsort(self.cols, kind="stable")
        self.used, self.col_starts = np.unique(self.cols[self.by_col], return_index=True)

    def times(self, weights: np.ndarray) -> np.ndarray:
        out = np.zeros((self.n, weights.shape[1]))
        if len(self.filled):
            out[self.filled] = np.add.reduceat(weights[self.cols] * self.value, self.starts)
        return out

    def gradient(self, err: np.ndarray) -> np.ndarray:
        """Summed by used column."""
        return np.add.reduceat((err[self.owner] * self.value)[self.by_col], self.col_starts)


class Classifier:
    def __init__(self, classes: list[str], weights: np.ndarray, bias: np.ndarray, temperature: float = 1.0, threshold: float = 0.5):
        self.classes, self.weights, self.bias, self.temperature, self.threshold = classes, weights, bias, temperature, threshold
        self.shapes = {f: [shape(t) for t in ts] for f, ts in TEMPLATES.items()}

    def logits(self, examples: list[np.ndarray]) -> np.ndarray:
        return Sparse(examples).times(self.weights) + self.bias

    def probabilities(self, paragraphs: list[str]) -> np.ndarray:
        return softmax(self.logits([hashed(p) for p in paragraphs]) / self.temperature)

    def similarity(self, paragraph: str, family: str) -> float:
        ws = tokens(paragraph)
        own = grams(ws, (3,)) | grams(ws)
        return max(len(s & own) / len(s) for s in self.shapes[family])

    def predict(self, paragraphs: list[str]) -> list[tuple[str, float, float]]:
        """(family or unknown, probability, template similarity) of each paragraph."""
        out = []
        for p, row in zip(paragraphs, self.probabilities(paragraphs) if paragraphs else ()):
            k = int(np.argmax(row))
            family, prob = self.classes[k], float(row[k])
            like = 0.0 if family == UNKNOWN else self.similarity(p, family)
            if family != UNKNOWN and (prob < self.threshold or like < CONFIRM):
                family = UNKNOWN
            out.append((family, prob, like))
        return out


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def variants(template: str) -> list[str]:
    ws = template.split()
    out = [lead + template for lead in LEADS] + [template.lower(), template.rstrip(".")]
    out += [" ".join(ws[:i] + ws[i + 1 :]) for i in range(0, len(ws), max(1, len(ws) // 4)) if len(ws) > 5]
    return out + [f"{template} {template}"]


def fit(negatives: list[str], rounds: int = 200, rate: float = 2.0, decay: float = 1e-4) -> Classifier:
    """Full-batch descent on the log loss; every fifth example is held out for calibration."""
    classes = [*sorted(TEMPLATES), UNKNOWN]
    pairs = [(v, f) for f, ts in sorted(TEMPLATES.items()) for t in ts for v in variants(t)]
    pairs += [(m, UNKNOWN) for m in MENTIONS for _ in range(3)]
    pairs += [(n, UNKNOWN) for n in negatives]
    x = [hashed(p) for p, _ in pairs]
    y = np.array([classes.index(f) for _, f in pairs])
    held = np.arange(len(pairs)) % 5 == 4
    weight = 1 / np.bincount(y[~held], minlength=len(classes))[y].clip(1)
    model = Classifier(classes, np.zeros((DIMS, len(classes))), np.zeros(len(classes)))
    train = np.flatnonzero(~held)
    rows = Sparse([x[i] for i in train])
    goal = np.eye(len(classes))[y[train]]
    w = weight[train][:, None] / weight[train].sum()
    speed, pull = np.zeros((len(rows.used), len(classes))), np.zeros_like(model.bias)
    for _ in range(rounds):
        err = w * (softmax(rows.times(model.weights) + model.bias) - goal)
        speed = 0.9 * speed - rate * (rows.gradient(err) + decay * model.weights[rows.used])
        pull = 0.9 * pull - rate * err.sum(axis=0)
        model.weights[rows.used] += speed
        model.bias += pull
    test = np.flatnonzero(held)
    z = model.logits([x[i] for i in test])
    losses = {t: -np.log(softmax(z / t)[np.arange(len(test)), y[test]] + 1e-12).mean() for t in np.geomspace(0.02, 2, 25)}
    model.temperature = float(min(losses, key=losses.get))
    p = softmax(z / model.temperature)
    clean = np.sort(p[y[test] == len(classes) - 1, :-1].max(axis=1))
    model.threshold = float(max(0.5, clean[int(0.999 * (len(clean) - 1))] if len(clean) else 0.5))
    return model


def holds(text: str, gates: tuple[str, ...]) -> bool:
    low = text.lower()
    return any(g in low for g in gates)


def paragraphs(text: str) -> Iterator[tuple[int, str]]:
    """(number, paragraph) of the lines that can be confirmed or hold a licence word."""
    if not holds(text, SCORED):
        return
    for k, line in enumerate(text.split("\n")):
        if holds(line, SCORED):
            yield k, line.strip()


def wrapped(text: str) -> Iterator[tuple[int, int, str]]:
    """(first line, last line, lines joined) where following lines together hold ``CONFIRM`` of a template, and none of a family's spans holds another."""
    if "\n" not in text or not holds(text, SCORED):
        return
    block = []
    for k, line in enumerate([*text.split("\n"), ""]):
        if ws := tokens(line):
            block.append((k, line.strip(), ws))
            continue
        if len(block) > 1 and any(holds(x, SCORED) for _, x, _ in block):
            for start, end in _spans([x for *_, x in block]):
                yield block[start][0], block[end][0], " ".join(x for _, x, _ in block[start : end + 1])
        block = []


def _spans(lines: list[list[str]]) -> list[tuple[int, int]]:
    words = [w for ws in lines for w in ws]
    at = [k for k, ws in enumerate(lines) for _ in ws]
    hits: dict[int, list[tuple[int, int, str]]] = {}  # by template: first and last line of its grams, in order
    for i in range(len(words)):
        for n in (1, 2, 3):
            if i + n <= len(words) and (g := " ".join(words[i : i + n])) in INDEX:
                for t in INDEX[g]:
                    hits.setdefault(t, []).append((at[i], at[i + n - 1], g))
    spans: dict[str, set[tuple[int, int]]] = {}
    for t, found in hits.items():
        family, grams_ = SHAPES[t]
        count, low, met = {}, 0, 0
        for k, (_, _, g) in enumerate(found):  # a sliding window over the grams, as short as it can be
            count[g] = count.get(g, 0) + 1
            met += count[g] == 1
            while met / len(grams_) >= CONFIRM:
                start, _, h = found[low]
                if count[h] == 1 and (met - 1) / len(grams_) < CONFIRM:
                    end = max(x for _, x, _ in found[max(low, k - 8) : k + 1])  # at most 9 grams end within 3 words
                    if end - start < WRAP:
                        spans.setdefault(family, set()).add((start, end))
                count[h] -= 1
                met -= count[h] == 0
                low += 1
    out = set()
    for own in spans.values():
        least = None
        for start, end in sorted(own, key=lambda x: (-x[0], x[1])):  # those that start later come first
            if least is None or end < least:
                least = end
                if start < end:
                    out.add((start, end))
    return sorted(out)


def found_in(text: str, model: Classifier) -> list[dict]:
    """The paragraphs with a licence word and all confirmed ones; lines of a confirmed span that are unknown alone are part of it."""
    lines, spans = list(paragraphs(text)), list(wrapped(text))
    got = model.predict([q for _, q in lines] + [q for *_, q in spans])
    sure = [(a, b, x) for (a, b, _), x in zip(spans, got[len(lines) :]) if x[0] != UNKNOWN]
    inside = {k for a, b, _ in sure for k in range(a, b + 1)}
    out = [(k, x) for (k, q), x in zip(lines, got) if x[0] != UNKNOWN or holds(q, GATES) and k not in inside]
    out += [(a, x) for a, _, x in sure]
    return [{"paragraph": k, "family": f, "probability": p, "similarity": s} for k, (f, p, s) in sorted(out)]


def train(docs: DataFrame, sample: int = SAMPLE, text: str = "text", doc_id: str = "doc_id") -> Classifier:
    """The classifier, with unknowns unlike every template: all scored lines of at most ``sample`` documents that hold one, and first lines of as many of all."""
    rows = docs.select(F.col(doc_id).alias("__id"), F.col(text).cast("string").alias("t")).where(F.col("__id").isNotNull())
    scored = lambda c: F.lower(c).rlike("|".join(map(re.escape, SCORED)))

    def some(source: DataFrame) -> DataFrame:
        ids = source.select("__id").distinct().orderBy(F.xxhash64("__id"), "__id").limit(sample)
        return rows.join(F.broadcast(ids), "__id")

    first = some(rows).select(F.element_at(F.split("t", "\n"), 1).alias("line")).where(F.length("line") > 0).dropDuplicates().limit(sample)
    mentions = some(rows.where(scored("t"))).select(F.explode(F.split("t", "\n")).alias("line")).where(scored("line"))
    lines = sorted({r["line"].strip() for r in first.unionByName(mentions.dropDuplicates()).collect()})
    shapes = [s for f in TEMPLATES.values() for t in f if (s := grams(tokens(t), (3,)))]
    negatives = [x for x in lines if (own := grams(tokens(x), (3,))) is not None and not any(len(s & own) >= 0.5 * len(s) for s in shapes)]
    return fit(negatives)


def scan(docs: DataFrame, model: Classifier, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns and found: the paragraphs (number, family, probability, similarity) with a licence word or confirmed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("paragraph", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("similarity", pa.float64())]))
        for b in batches:
            found = [found_in(x.as_py() or "", model) for x in b.column("__text")]
            yield pa.RecordBatch.from_pydict({k: b.column(k) for k in keep} | {"found": pa.array(found, kind)})

    src = docs.select(*keep, F.col(text).cast("string").alias("__text"))
    item = T.StructType([T.StructField("paragraph", T.IntegerType()), T.StructField("family", T.StringType()), T.StructField("probability", T.DoubleType()), T.StructField("similarity", T.DoubleType())])
    return src.mapInArrow(run, T.StructType([src.schema[k] for k in keep] + [T.StructField("found", T.ArrayType(item))]))


def licences(docs: DataFrame, model: Classifier | None = None) -> DataFrame:
    """doc_id, license, probability, n_paragraphs (with a licence word or confirmed), n_confirmed and confirmed (all that are) of every document."""
    found = scan(docs, model or train(docs))
    sure = F.filter("found", lambda x: x["family"] != UNKNOWN)
    best = F.array_max(F.transform(sure, lambda x: F.struct(x["probability"].alias("p"), x["similarity"].alias("s"), (-x["paragraph"]).alias("n"), x["family"].alias("f"))))
    none = F.when(F.size("found") > 0, UNKNOWN).otherwise("none")
    return found.select("doc_id", F.coalesce(best["f"], none).alias("license"), F.round(best["p"], 4).alias("probability"), F.size("found").alias("n_paragraphs"), F.size(sure).alias("n_confirmed"), sure.alias("confirmed"))


def op3_licenses(spark, sf_dir):
    return licences(table(spark, sf_dir, "documents"))
