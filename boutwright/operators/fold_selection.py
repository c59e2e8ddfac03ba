"""Features chosen anew in each walk-forward fold, by greedy forward selection from sums of products.

A least-squares fit and its error need only the sums of products of all pairs of columns (features,
target and one). These sums are made once, for each stretch of time between two fold borders, by
partial sums in the tasks; a fold's training sums are those of all stretches before it. They have
(features + 2) squared numbers a stretch, whatever the number of rows, so any number of candidate
sets costs no further pass.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RIDGE = 1e-9


def borders(first: dt.date, last: dt.date, years: int = 5, months: int = 6) -> list[dt.date]:
    """Starts of the folds' test stretches, and the day after the last row: the first ``years`` train alone."""

    def later(day: dt.date, by: int) -> dt.date:
        y, m = divmod(day.month - 1 + by, 12)
        end = (dt.date(day.year + y + (m == 11), (m + 1) % 12 + 1, 1) - dt.timedelta(days=1)).day
        return dt.date(day.year + y, m + 1, min(day.day, end))

    out = [later(first, 12 * years)]
    while out[-1] < last:
        out.append(min(later(first, 12 * years + months * len(out)), last + dt.timedelta(days=1)))
    return out if len(out) > 1 else []


def product_sums(df: DataFrame, features: list[str], target: str, date: str, cuts: list[dt.date]) -> np.ndarray:
    """[stretch, i, j]: sums of products of (features..., target, 1); stretch k lies between cut k - 1 and cut k. Unknown features count as 0, rows without a target or date not at all."""
    k = len(features) + 2
    days = [(c - dt.date(1970, 1, 1)).days for c in cuts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(days) + 1, k, k))
        for b in batches:
            x = np.column_stack([*(b.column(i).to_numpy(zero_copy_only=False) for i in range(1, k)), np.ones(b.num_rows)])
            part = np.searchsorted(days, b.column(0).to_numpy(zero_copy_only=False), side="right")
            for p in np.unique(part):
                rows = x[part == p]
                total[p] += rows.T @ rows
        at = np.argwhere(total)
        yield pa.RecordBatch.from_pydict({"p": pa.array(at[:, 0]), "i": pa.array(at[:, 1]), "j": pa.array(at[:, 2]), "v": pa.array(total[tuple(at.T)])})

    src = df.where(F.col(target).isNotNull() & F.col(date).isNotNull()).select(F.datediff(F.to_date(date), F.lit("1970-01-01").cast("date")).cast("long").alias("day"), *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f"f{i}") for i, f in enumerate(features)], F.col(target).cast("double").alias("y"))
    sums = src.mapInArrow(run, "p long, i long, j long, v double").groupBy("p", "i", "j").agg(F.sum("v").alias("v"))
    out = np.zeros((len(days) + 1, k, k))
    for r in sums.collect():  # stretches x columns squared
        out[r["p"], r["i"], r["j"]] = r["v"]
    return out


def fit(sums: np.ndarray, chosen: list[int]) -> tuple[np.ndarray, float]:
    """Coefficients (the constant last) and squared error of the least-squares fit on columns ``chosen``."""
    y, one = sums.shape[0] - 2, sums.shape[0] - 1
    at = [*chosen, one]
    a, b = sums[np.ix_(at, at)], sums[at, y]
    w = np.linalg.solve(a + RIDGE * np.diag(np.append(np.diag(a)[:-1] + 1, 0.0)), b)
    return w, squared_error(sums, chosen, w)


def squared_error(sums: np.ndarray, chosen: list[int], w: np.ndarray) -> float:
    y, one = sums.shape[0] - 2, sums.shape[0] - 1
    at = [*chosen, one]
    return float(sums[y, y] - 2 * w @ sums[at, y] + w @ sums[np.ix_(at, at)] @ w)


def greedy(sums: np.ndarray, most: int, least_gain: float) -> list[int]:
    """Columns in the order chosen: each time the one that lowers the squared error most (the first of equal ones), while it falls by the share ``least_gain``."""
    chosen: list[int] = []
    error = fit(sums, chosen)[1]
    while len(chosen) < min(most, sums.shape[0] - 2):
        tried = [(fit(sums, [*chosen, c])[1], c) for c in range(sums.shape[0] - 2) if c not in chosen]
        best, c = min(tried, key=lambda t: (round(t[0], 9), t[1]))
        if error - best <= least_gain * error:
            break
        chosen.append(c)
        error = best
    return chosen


def forward_selection(df: DataFrame, features: list[str], target: str = "target", date: str = "event_date", most: int = 8, least_gain: float = 1e-4, years: int = 5, months: int = 6, least_train: int = 100, least_test: int = 5) -> DataFrame:
    """fold, fold_start, fold_end, n_train, n_test, features (in the order chosen), train_error and test_error (mean squared) of each fold.

    The first ``years`` train alone; each fold tests the next ``months`` on what was chosen and
    fitted before it. Folds with fewer rows than ``least_train`` or ``least_test`` are left out.
    """
    spark = df.sparkSession
    schema = "fold int, fold_start date, fold_end date, n_train long, n_test long, features array<string>, train_error double, test_error double"
    first, last = df.where(F.col(target).isNotNull()).agg(F.min(F.to_date(date)), F.max(F.to_date(date))).first()
    cuts = borders(first, last, years, months) if first is not None else []
    out = []
    if cuts:
        sums = product_sums(df, features, target, date, cuts)
        for i in range(len(cuts) - 1):
            train, test = sums[: i + 1].sum(0), sums[i + 1]
            n_train, n_test = round(train[-1, -1]), round(test[-1, -1])
            if n_train >= least_train and n_test >= least_test:
                chosen = greedy(train, most, least_gain)
                w, error = fit(train, chosen)
                out.append((len(out) + 1, cuts[i], cuts[i + 1], n_train, n_test, [features[c] for c in chosen], error / n_train, squared_error(test, chosen, w) / n_test))
    return spark.createDataFrame(out, schema)
