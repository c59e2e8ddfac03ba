"""Periodic runs of words: stretches that repeat themselves at least three times over.

A run is a stretch of at least ``MIN_WORDS`` words and three of its smallest periods that no
neighbouring word extends. In each text:

1. Every eight words inside a run stand there a second time (a period further or earlier). So the
   stretches in which each eight words occur twice in the text hold all runs; what lies outside
   them needs no automaton.
2. A suffix automaton of a stretch: its states are classes of strings with the same end positions.
   From the longest strings to the shortest, the end positions of a state go into those of its
   suffix link, the smaller ordered set into the larger. A position and its new neighbour at a
   distance d that the state's length reaches are the ends of a square: d words twice.
3. A square is extended in both directions to its run, once for each run. Any run of period d
   holds a square at each place whose two ends are neighbours in the state where they first meet
   (a closer end would give the run a smaller period), so no run is missed; and for the same
   reason d is the smallest period.

Defined cases: a null or blank text has no words and no runs; repeated rows are worked out each;
of runs with equal exponents the one that starts first is the best, then the one of the smaller
period; an empty table gives an empty result; very long texts take memory in proportion to the
words of their longest repeated stretch; a column of the input that has the name of an output
column is replaced by it, other columns are not read unless they are named in ``keep``.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

MIN_WORDS = 24
MIN_PERIODS = 3
#: Words of the grams that must recur inside a run; at most a third of MIN_WORDS.
GRAM_DOUBLINGS = 3
BLOCK = 512

Run = tuple[int, int, int]


# where runs can be ----------------------------------------------------------------------------
def repeated_stretches(ids: np.ndarray) -> list[tuple[int, int]]:
    """[start, stop) of the longest stretches of at least MIN_WORDS words in which each 8 words occur twice or more in ``ids``."""
    if len(ids) < MIN_WORDS:
        return []
    gram, counts = ids.astype(np.int64), None
    for k in range(GRAM_DOUBLINGS):
        joined = gram[: -(1 << k)] * len(ids) + gram[1 << k :]  # ranks stay below the number of words
        _, gram, counts = np.unique(joined, return_inverse=True, return_counts=True)
    again = counts[gram] > 1
    edges = np.flatnonzero(np.diff(np.concatenate(([0], again.view(np.int8), [0]))))
    size = 1 << GRAM_DOUBLINGS
    return [(a, b + size - 1) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()) if b - a + size - 1 >= MIN_WORDS]


# suffix automaton -----------------------------------------------------------------------------
def suffix_automaton(seq: Sequence[int]) -> tuple[list[int], list[int], list[int]]:
    """Length, suffix link and own end position (-1 for copies and the root) of each state."""
    length, link, own, step = [0], [-1], [-1], [{}]
    last = 0
    for at, c in enumerate(seq):
        new = len(length)
        length.append(at + 1)
        link.append(0)
        own.append(at)
        step.append({})
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 != length[q]:
                copy = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                own.append(-1)
                step.append(step[q].copy())
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = copy
                q = copy
            link[new] = q
        last = new
    return length, link, own


class Ends:
    """Ordered end positions, in blocks of bounded size."""

    __slots__ = ("blocks", "tops", "size")

    def __init__(self, x: int):
        self.blocks, self.tops, self.size = [[x]], [x], 1

    def add(self, x: int) -> tuple[int, int]:
        """Insert and give the neighbours (-1 where there is none)."""
        b = min(bisect_left(self.tops, x), len(self.tops) - 1)
        block = self.blocks[b]
        i = bisect_left(block, x)
        before = block[i - 1] if i else self.blocks[b - 1][-1] if b else -1
        after = block[i] if i < len(block) else self.blocks[b + 1][0] if b + 1 < len(self.blocks) else -1
        block.insert(i, x)
        self.tops[b] = block[-1]
        self.size += 1
        if len(block) > 2 * BLOCK:
            self.blocks[b : b + 1] = [block[:BLOCK], block[BLOCK:]]
            self.tops[b : b + 1] = [block[BLOCK - 1], block[-1]]
        return before, after


def squares(seq: Sequence[int]) -> Iterator[tuple[int, int]]:
    """(end, period) of squares: of each run at least one, of its smallest period."""
    length, link, own = suffix_automaton(seq)
    sets: list[Ends | None] = [Ends(x) if x >= 0 else None for x in own]
    for state in sorted(range(1, len(length)), key=length.__getitem__, reverse=True):
        to, small = link[state], sets[state]
        sets[state] = None
        if to == 0:  # the empty string's state holds no square
            continue
        large, reach = sets[to], length[to]
        if large is None:
            sets[to] = small
            continue
        if small.size > large.size:
            small, large = large, small
        for block in small.blocks:
            for x in block:
                before, after = large.add(x)
                if before >= 0 and x - before <= reach:
                    yield x, x - before
                if after >= 0 and after - x <= reach:
                    yield after, after - x
        sets[to] = large


def runs_of_stretch(seq: Sequence[int]) -> list[Run]:
    """(start, length, period) of the runs of a stretch."""
    known: dict[int, tuple[list[int], list[int]]] = {}
    out, n = [], len(seq)
    for end, d in squares(seq):
        starts, stops = known.setdefault(d, ([], []))
        first = end - 2 * d + 1
        k = bisect_right(starts, first)
        if k and stops[k - 1] > end:
            continue
        i, j = first, end + 1
        while i > 0 and seq[i - 1] == seq[i - 1 + d]:
            i -= 1
        while j < n and seq[j] == seq[j - d]:
            j += 1
        k = bisect_left(starts, i)
        starts.insert(k, i)
        stops.insert(k, j)
        if j - i >= max(MIN_WORDS, MIN_PERIODS * d):
            out.append((i, j - i, d))
    return out


def runs_of(words: Sequence) -> list[Run]:
    """Runs of a whole text's words, by start, then period."""
    if len(words) < MIN_WORDS:
        return []
    index: dict = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words))
    out = []
    for a, b in repeated_stretches(ids):
        out += [(a + i, length, d) for i, length, d in runs_of_stretch(ids[a:b].tolist())]
    return sorted(out, key=lambda r: (r[0], r[2]))


def best_of(runs: list[Run]) -> Run | None:
    """The run of the greatest length / period; of equal ones the first in order."""
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words that stay when each run keeps its first period."""
    if not runs:
        return words
    stays = np.ones(len(words), bool)
    for start, length, d in runs:
        stays[start + d : start + length] = False
    return [words[i] for i in np.flatnonzero(stays).tolist()]


# Spark ----------------------------------------------------------------------------------------
RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
_RUN = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])
OUTPUT = ["n_words", "runs", "best", "collapsed"]


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        many, runs, best, kept = [], [], [], []
        for x in b.column("text"):
            words = (x.as_py() or "").encode("utf-8", "surrogatepass").split()
            found = runs_of(words)
            many.append(len(words))
            runs.append([dict(zip(RUN.names, r)) for r in found])
            top = best_of(found)
            best.append(top and dict(zip(RUN.names, top)))
            kept.append(b" ".join(collapsed(words, found)).decode("utf-8", "surrogatepass"))
        cols = [b.column("doc"), pa.array(many, pa.int64()), pa.array(runs, pa.list_(_RUN)), pa.array(best, _RUN), pa.array(kept, pa.string())]
        yield pa.RecordBatch.from_arrays(cols, ["doc", *OUTPUT])


def periodic_runs(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns, n_words, runs (array of start, length, period in words), best (the run of the greatest exponent, or null) and collapsed (the words outside all but the first period of each run)."""
    own = [F.col(f"`{c}`") for c in keep if c not in OUTPUT] or [F.lit(0).alias("__none")]
    src = docs.select(F.struct(*own).alias("doc"), F.col(f"`{text}`").cast("string").alias("text"))
    schema = T.StructType([src.schema["doc"], T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("best", RUN), T.StructField("collapsed", T.StringType())])
    return src.mapInArrow(_find, schema).select("doc.*", *OUTPUT).drop("__none")


# the contract's query -------------------------------------------------------------------------
def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Every tenth document (by CRC-32 of its id) made periodic from some word on; a null id is left alone."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def _plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = []
        for i, x in zip(b.column("doc_id").to_pylist(), b.column("text")):
            words = (x.as_py() or "").encode("utf-8", "surrogatepass").split()
            texts.append(b" ".join(planted(i, words)).decode("utf-8", "surrogatepass"))
        yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "text": pa.array(texts, pa.string())})


def run_digests(docs: DataFrame) -> DataFrame:
    """The contract's columns over ``docs`` (doc_id, text)."""
    src = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    found = periodic_runs(src.mapInArrow(_plant, src.schema), ["doc_id"])
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_periods(spark, sf_dir):
    return run_digests(table(spark, sf_dir, "documents"))
