"""Toxicity by a weighted lexicon, matched with Aho-Corasick over folded text.

Folding lower-cases, drops accents and zero-width characters, and turns homoglyphs and digits
that stand for letters into the letters. The lexicon is learned from labelled rows of the
training folds: folded words, and word beginnings of 5 to 9 letters, that are far likelier in
toxic documents, weighted by log odds. A phrase of an entry and its neighbour that occurs in
clean training documents and in no toxic one is an exception and cancels the entry. The sum of
weights over a text, divided by the logarithm of its length, goes through a logistic curve
fitted to the training rows.

``SAMPLE`` bounds the labelled rows that training reads (those of least id hash); every document
is scored over its whole text. Labels, lang, source and doc_id are never inputs of a score.

Defined cases: null and empty texts match nothing and get the score of no evidence; ties between
entries go to the heavier one; without labelled rows of both kinds the lexicon is empty and every
score is 0; repeated rows are scored each; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

SAMPLE = 20_000
FOLDS = 5


@dataclass(frozen=True)
class Settings:
    """An entry needs so many toxic training documents, such log odds and such a likelihood ratio (chance
    gives about 2 ln of the number of candidates); word beginnings of ``prefixes`` letters are candidates
    too. The defaults are those that ``choose_toxicity`` ranks first on the training folds of sf0.1."""

    least_docs: int = 5
    least_weight: float = 2.0
    least_ratio: float = 12.0
    prefixes: tuple[int, ...] = (5, 6, 7, 8, 9)



#: Letters of other scripts that look like Latin ones.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o",
    "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ɡ": "g", "ⅼ": "l", "ո": "n", "ս": "u",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t",
    "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ł": "l", "ø": "o", "đ": "d",
}
#: Digits and signs that stand for letters.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
SIGNS = {"@": "a", "$": "s", "!": "i"}
ZERO_WIDTH = dict.fromkeys(map(ord, "­​‌‍⁠﻿"))

_LETTERS = str.maketrans(HOMOGLYPHS | DIGITS) | ZERO_WIDTH
_SIGN = re.compile(r"[@$!](?=\w)")
_GAP = re.compile(r"[\W_]+")


def fold(text: str | None) -> str:
    """Folded words with one space around each."""
    s = (text or "").lower()
    if not s.isascii():
        s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
    s = _SIGN.sub(lambda m: SIGNS[m[0]], s).translate(_LETTERS)
    return f" {_GAP.sub(' ', s).strip()} "


def features(folded: str, prefixes: tuple[int, ...] = Settings.prefixes) -> set[str]:
    """Lexicon candidates of a text: whole words (" word ") and word beginnings (" worth")."""
    out = set()
    for w in set(folded.split()):
        out.add(f" {w} ")
        out.update(f" {w[:k]}" for k in prefixes if k < len(w))
    return out


class Matcher:
    """Lexicon and exceptions in one automaton."""

    def __init__(self, lexicon: dict[str, float], exceptions: set[str] = frozenset()):
        import ahocorasick

        self.found = ahocorasick.Automaton()
        for k, w in lexicon.items():
            self.found.add_word(k, (len(k), w))
        self.size = len(lexicon)
        self.exceptions = exceptions
        if self.size:
            self.found.make_automaton()

    def hits(self, folded: str) -> dict[int, float]:
        """Start of each matched word with the weight of its heaviest entry."""
        out: dict[int, float] = {}
        if self.size:
            for end, (n, w) in self.found.iter(folded):
                start = end - n + 1
                if out.get(start, 0.0) < w:
                    out[start] = w
        return out

    def phrases(self, folded: str, start: int) -> list[str]:
        """The word at ``start`` with the word before and the word after."""
        end = folded.find(" ", start + 1)
        after = folded[start + 1 : folded.find(" ", end + 1) if end + 1 < len(folded) else end]
        before = folded[folded.rfind(" ", 0, start) + 1 if start else 0 : end].strip()
        return [before, after]

    def evidence(self, folded: str) -> float:
        got = self.hits(folded)
        if self.exceptions:
            got = {s: w for s, w in got.items() if not any(p in self.exceptions for p in self.phrases(folded, s))}
        return sum(got.values()) / math.log2(16 + folded.count(" ")) if got else 0.0


def _counted(rows: Iterator[tuple[Counter, Counter]], most: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Feature counts by label; handed on whenever the tables grow large."""
    pos, neg = Counter(), Counter()

    def out() -> pa.RecordBatch:
        keys = sorted(pos.keys() | neg.keys())
        return pa.RecordBatch.from_pydict({"f": pa.array(keys, pa.string()), "pos": pa.array([pos[k] for k in keys], pa.int64()), "neg": pa.array([neg[k] for k in keys], pa.int64())})

    for toxic, feats in rows:
        (pos if toxic else neg).update(feats)
        if len(pos) + len(neg) > most:
            yield out()
            pos, neg = Counter(), Counter()
    if pos or neg:
        yield out()


def _ratio(p: int, q: int):
    """G statistic of a feature's counts against p toxic and q clean documents."""
    share = (F.col("pos") + F.col("neg")) / F.lit(float(p + q))

    def part(seen, all_, expected):
        return F.when(seen > 0, seen * F.log(seen / (expected * F.lit(float(all_))))).otherwise(0.0)

    has = part(F.col("pos"), p, share) + part(F.col("neg"), q, share)
    return 2 * (has + part(p - F.col("pos"), p, 1 - share) + part(q - F.col("neg"), q, 1 - share))


def _totals(df: DataFrame, feats) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _counted((t, feats(fold(x.as_py()))) for b in batches for x, t in zip(b.column("text"), b.column("toxic").to_pylist()))

    return df.mapInArrow(run, "f string, pos long, neg long").groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """text and toxic of at most ``sample`` labelled documents of the training folds."""
    ids = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    ids = ids.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", "toxic")


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


class Model:
    def __init__(self, lexicon: dict[str, float], exceptions: set[str], slope: float, shift: float):
        self.lexicon, self.exceptions, self.slope, self.shift = lexicon, exceptions, slope, shift

    def score(self, matcher: Matcher, text: str | None) -> float:
        if not self.lexicon:
            return 0.0
        x = self.slope * matcher.evidence(fold(text)) + self.shift
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, x))))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, settings: Settings = Settings()) -> Model:
    rows = training_rows(docs, labels, sample).persist()
    try:
        n = {r["toxic"]: r["count"] for r in rows.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).count().collect()}
        p, q = n.get(1, 0), n.get(0, 0)
        if not p or not q:
            return Model({}, set(), 0.0, 0.0)
        odds = F.log((F.col("pos") + 0.5) / (p + 1.0)) - F.log((F.col("neg") + 0.5) / (q + 1.0))
        best = _totals(rows, partial(features, prefixes=settings.prefixes)).where(F.col("pos") >= settings.least_docs)
        best = best.withColumn("w", odds).where((F.col("w") >= settings.least_weight) & (_ratio(p, q) >= settings.least_ratio))
        lexicon = {r["f"]: r["w"] for r in best.collect()}  # words of ``sample`` texts that have passed the tests
        if not lexicon:
            return Model({}, set(), 0.0, 0.0)
        near = _totals(rows, _Phrases(lexicon)).where((F.col("pos") == 0) & (F.col("neg") >= 3))
        exceptions = {r["f"] for r in near.collect()}
        seen = rows.mapInArrow(_Evidence(lexicon, exceptions), "x double, toxic int").toPandas()  # ``sample`` rows at most
        return Model(lexicon, exceptions, *fit_curve(seen["x"].to_numpy(), (seen["toxic"] > 0).to_numpy()))
    finally:
        rows.unpersist()


class _Phrases:
    def __init__(self, lexicon):
        self.lexicon, self.m = lexicon, None

    def __getstate__(self):
        return {"lexicon": self.lexicon, "m": None}

    def __call__(self, folded: str) -> set[str]:
        self.m = self.m or Matcher(self.lexicon)
        return {p for s in self.m.hits(folded) for p in self.m.phrases(folded, s) if " " in p}


class _Evidence:
    def __init__(self, lexicon, exceptions):
        self.lexicon, self.exceptions = lexicon, exceptions

    def __call__(self, batches):
        m = Matcher(self.lexicon, self.exceptions)
        for b in batches:
            x = [m.evidence(fold(t.as_py())) for t in b.column("text")]
            yield pa.RecordBatch.from_pydict({"x": pa.array(x, pa.float64()), "toxic": b.column("toxic").cast(pa.int32())})


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and shift of a logistic curve, both kinds weighing alike; the slope is never negative."""
    w = np.where(y, 0.5 / max(y.sum(), 1), 0.5 / max((~y).sum(), 1))
    a = np.stack([x, np.ones_like(x)], axis=1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        g = a.T @ (w * (p - y)) + ridge * beta * [1, 0]
        h = (a * (w * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ a + np.diag([ridge, 1e-9])
        step = np.linalg.solve(h, g)
        beta -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return max(float(beta[0]), 0.0), float(beta[1])


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns and score of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Matcher(model.lexicon, model.exceptions)
        for b in batches:
            got = [model.score(m, x.as_py()) for x in b.column("__text")]
            yield pa.RecordBatch.from_pydict({k: b.column(k) for k in keep} | {"score": pa.array(got, pa.float64())})

    src = docs.select(*keep, F.col(text).cast("string").alias("__text"))
    return src.mapInArrow(run, T.StructType([src.schema[k] for k in keep] + [T.StructField("score", T.DoubleType())]))


def op6_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
