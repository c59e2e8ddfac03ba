"""Rolled statistics over the part of a history that was known at each cutoff.

A row of a participant counts for a later bout once it was captured strictly before that bout's
date; a row without a capture time was known from the start. So a late capture changes which rows
stand before a bout, and with them the rank that decides their weights: neither a window over the
rows nor a running sum over the captures can say it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .history import whole_keys

BLOCK = 64


class Visible:
    """Counts, sums and decayed sums over the visible part of any prefix of a career.

    Positions stand in blocks. A block keeps, over its visible rows, how many there are, plain sums
    and sums whose weights halve every ``half_life`` visible rows from the block's end; a prefix is
    made of whole blocks, each decayed by the visible rows after it, and a part of one block.
    Showing a row or asking for a prefix costs one block and one number a block.
    """

    def __init__(self, values: np.ndarray, half_life: float):
        n, k = values.shape
        blocks = -(-n // BLOCK)
        self.decay = 0.5 ** (1 / half_life)
        self.known = ~np.isnan(values)
        self.values = np.where(self.known, values, 0.0)
        self.shown = np.zeros(n, bool)
        self.count = np.zeros(blocks, np.int64)
        self.sums = np.zeros((blocks, 4, k))  # decayed values and weights, plain values and counts

    def _part(self, a: int, b: int) -> tuple[int, np.ndarray]:
        at = a + np.flatnonzero(self.shown[a:b])
        w = self.decay ** np.arange(len(at) - 1, -1, -1)[:, None]
        v, known = self.values[at], self.known[at]
        return len(at), np.stack([(w * v).sum(0), (w * known).sum(0), v.sum(0), known.sum(0)])

    def show(self, i: int) -> None:
        self.shown[i] = True
        b = i // BLOCK
        self.count[b], self.sums[b] = self._part(b * BLOCK, (b + 1) * BLOCK)

    def before(self, i: int) -> tuple[int, np.ndarray]:
        """Visible rows before position ``i`` and their four sums."""
        b = i // BLOCK
        n, sums = self._part(b * BLOCK, i)
        if b:
            after = n + np.concatenate((np.cumsum(self.count[:b][::-1])[::-1][1:], [0]))
            old = self.sums[:b]
            sums[:2] += (self.decay**after[:, None, None] * old[:, :2]).sum(0)
            sums[2:] += old[:, 2:].sum(0)
            n += int(self.count[:b].sum())
        return n, sums


#: Careers of up to as many rows are taken as a matrix of rows by earlier rows, in slices of bounded memory.
DENSE, CELLS = 4096, 1 << 20


def _career(day: np.ndarray, captured: np.ndarray, values: np.ndarray, half_life: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Visible rows, their means and their decayed means before each row; rows stand in the order of the career."""
    n, k = values.shape
    many, sums = (_dense if n <= DENSE else _blocks)(day, captured, values, half_life)
    s, w, total, count = sums.transpose(1, 0, 2)
    mean, ewm = np.full((n, k), np.nan), np.full((n, k), np.nan)
    has = count > 0
    mean[has], ewm[has] = total[has] / count[has], s[has] / w[has]
    return many, mean, ewm


def _dense(day: np.ndarray, captured: np.ndarray, values: np.ndarray, half_life: float) -> tuple[np.ndarray, np.ndarray]:
    """Visible rows before each row and their four sums, by products of matrices."""
    n, k = values.shape
    known = ~np.isnan(values)
    both = np.concatenate((np.where(known, values, 0.0), known), axis=1)
    fade = (0.5 ** (1 / half_life)) ** np.arange(n)
    many, sums = np.zeros(n, np.int64), np.zeros((n, 4, k))
    step = max(16, min(96, CELLS // n))  # a slice takes no columns after its rows
    for a in range(0, n, step):
        b = min(a + step, n)
        seen = (captured[:b] < day[a:b, None]) & (np.arange(b) < np.arange(a, b)[:, None])
        upto = np.cumsum(seen, axis=1, dtype=np.int32)
        many[a:b] = upto[:, -1]
        sums[a:b, :2] = (np.where(seen, fade[upto[:, -1:] - upto], 0.0) @ both[:b]).reshape(-1, 2, k)
        sums[a:b, 2:] = (seen.astype(float) @ both[:b]).reshape(-1, 2, k)
    return many, sums


def _blocks(day: np.ndarray, captured: np.ndarray, values: np.ndarray, half_life: float) -> tuple[np.ndarray, np.ndarray]:
    """As ``_dense``, for careers too long for a matrix."""
    n, k = values.shape
    seen = Visible(values, half_life)
    many, sums = np.zeros(n, np.int64), np.zeros((n, 4, k))
    shows = np.argsort(captured, kind="stable")
    at = 0
    for i in np.argsort(day, kind="stable").tolist():
        while at < n and captured[shows[at]] < day[i]:
            seen.show(int(shows[at]))
            at += 1
        many[i], sums[i] = seen.before(i)
    return many, sums


def visible_rolling(rows: DataFrame, captured: str, stats: tuple[str, ...], half_life: float = 3.0, entity: str = "entity", date: str = "event_date", tie: str = "fight_id") -> DataFrame:
    """``rows`` with n_visible and, for each statistic, mean_* and ewm_* of the earlier rows of the participant (by date, then ``tie``) that were captured before the row's date.

    Weights halve every ``half_life`` visible rows; a row without a value keeps its place in the
    weights; a null capture time is early enough for every date; a date that is null is never asked
    for and never seen. One participant's dates, captures and statistics stand in memory at a time.
    """
    never = np.iinfo(np.int64).max
    k = len(stats)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in whole_keys(batches):
            day = t.column("day").fill_null(-never).to_numpy().copy()
            shown = t.column("shown").to_numpy().copy()
            shown[day == -never] = never
            values = np.stack([t.column(f"v{j}").to_numpy() for j in range(k)], axis=1) if k else np.zeros((len(day), 0))
            found = [_career(day[a:b], shown[a:b], values[a:b], half_life) for a, b in zip(starts, starts[1:])]
            many, mean, ewm = (np.concatenate(x) for x in zip(*found))
            cols = [pa.array(many)] + [pa.array(m[:, j], from_pandas=True) for j in range(k) for m in (mean, ewm)]
            yield pa.RecordBatch.from_arrays([t.column("row").combine_chunks(), *cols], names)

    names = ["row", "n_visible", *[f"{p}_{s}" for s in stats for p in ("mean", "ewm")]]
    day = F.unix_micros(F.col(date).cast("timestamp"))
    shown = F.when(F.col(captured).isNull(), F.lit(-never)).otherwise(F.unix_micros(F.col(captured).cast("timestamp")))
    # what the pass reads is made after the sort, so only the rows themselves are shuffled
    ordered = rows.repartition(F.col(entity)).sortWithinPartitions(entity, date, tie)
    src = ordered.select(F.struct("*").alias("row"), F.to_json(F.struct(entity)).alias("key"), day.alias("day"), shown.alias("shown"), *[F.col(s).cast("double").alias(f"v{j}") for j, s in enumerate(stats)])
    schema = T.StructType([src.schema["row"], T.StructField("n_visible", T.LongType()), *[T.StructField(n, T.DoubleType()) for n in names[2:]]])
    return src.mapInArrow(run, schema).select("row.*", *names[1:])
