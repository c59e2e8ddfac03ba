"""Feature selection from sums against fits over rows, calibration inside folds, and verdicts that all occur."""

import datetime as dt
import random
from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from boutwright.operators import evaluation as E
from boutwright.operators import fold_selection as S
from boutwright.operators import learning as L
from boutwright.operators import promotion as G
from boutwright.plans import registry
from tests.conftest import DATA


def _plain(rows, features, most, gain, years, months):
    """Every candidate fitted on the rows themselves."""
    x = np.array([[0.0 if v is None else v for v in r[2]] + [1.0] for r in rows if r[1] is not None])
    y = np.array([r[1] for r in rows if r[1] is not None])
    day = np.array([r[0] for r in rows if r[1] is not None])
    cuts = S.borders(min(day), max(day), years, months)
    for a, b in zip(cuts, cuts[1:]):
        train, test = day < a, (day >= a) & (day < b)
        if train.sum() < 100 or test.sum() < 5:
            continue
        fit = lambda cols: np.linalg.lstsq(x[train][:, [*cols, -1]], y[train], rcond=None)[0]  # noqa: B023, E731
        error = lambda cols, part, w: float(((y[part] - x[part][:, [*cols, -1]] @ w) ** 2).sum())
        chosen, last = [], error([], train, fit([]))
        while len(chosen) < most:
            left = [(round(error([*chosen, c], train, fit([*chosen, c])), 9), c) for c in range(len(features)) if c not in chosen]
            best, c = min(left)
            if last - best <= gain * last:
                break
            chosen, last = [*chosen, c], best
        yield a, b, int(train.sum()), int(test.sum()), [features[c] for c in chosen], last / train.sum(), error(chosen, test, fit(chosen)) / test.sum()


def test_forward_selection_equals_fits_over_the_rows(spark):
    df = spark.read.parquet(f"{DATA}/sf0.001/lineitem.parquet")
    features = ["l_discount", "l_tax", "price", "l_linenumber", "noise"]
    df = df.select(F.to_date("l_shipdate").alias("event_date"), F.when(F.col("l_partkey") % 50 > 0, (F.col("l_quantity") > 25).cast("double")).alias("target"), "l_discount", "l_tax", F.when(F.col("l_suppkey") % 9 > 0, F.col("l_extendedprice") / 10000).alias("price"), F.col("l_linenumber").cast("double").alias("l_linenumber"), (F.col("l_orderkey") % 7).cast("double").alias("noise"))
    got = S.forward_selection(df.repartition(5), features, most=4, least_gain=1e-3, years=2).collect()
    rows = [(r[0], r[1], r[2:]) for r in df.collect()]
    want = list(_plain(rows, features, 4, 1e-3, 2, 6))
    assert len(got) == len(want) > 4
    for g, w in zip(got, want):
        assert (g.fold_start, g.fold_end, g.n_train, g.n_test, g.features) == w[:5]
        assert g.train_error == pytest.approx(w[5], rel=1e-6) and g.test_error == pytest.approx(w[6], rel=1e-5)
    assert any(g.features for g in got)
    assert S.forward_selection(df.limit(0), features).collect() == []


def test_fold_borders_keep_to_month_ends():
    assert S.borders(dt.date(2019, 8, 31), dt.date(2021, 3, 1), 1, 6) == [dt.date(2020, 8, 31), dt.date(2021, 2, 28), dt.date(2021, 3, 2)]
    assert S.borders(dt.date(2020, 1, 1), dt.date(2020, 5, 1), 1, 6) == []


def test_cross_fitted_calibration_lowers_the_error_of_a_skewed_model(spark):
    rng = random.Random(3)
    rows = [(i, i // 2, x := rng.random(), float(rng.random() < 0.15 + 0.25 * x)) for i in range(4000)]
    df = spark.createDataFrame(rows, "id long, grp long, x double, target double").withColumn("junk", F.pmod(F.xxhash64("id"), F.lit(97)).cast("double"))
    train, test = df.where("id < 2500").persist(), df.where("id >= 2500").persist()
    out = L.cross_calibrated(train, test, ["x", "junk"], "grp", ["id", "target"], fit=partial(L.boosted, rounds=15, depth=6)).persist()
    assert out.count() == 1500 and out.where("calibrated is null").count() == 0
    ece = {p: G.arm_metrics(out.withColumn("k", F.lit(1)), ["k"], p=p).first() for p in ("prob", "calibrated")}
    assert ece["calibrated"].ece < 0.6 * ece["prob"].ece and ece["calibrated"].brier < ece["prob"].brier


def test_the_search_takes_all_features_and_folds(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(L, "searched", lambda dealt, *a: seen.append((dealt, *a)) or spark.createDataFrame([("1", "1", 0.25)], "rounds string, depth string, brier double"))
    registry.queries()["parameter_search"](spark, f"{DATA}/sf0.001")
    dealt, features, folds, grid = seen[0]
    assert features == ["prob_a", "market_a", "fights_a", "fights_b", "price"] and folds == [1, 2, 3, 4, 5] and len(grid["rounds"]) * len(grid["depth"]) == 9 and max(grid["rounds"]) == 20 and max(grid["depth"]) == 4
    rows = {r["segment"]: r["count"] for r in dealt.groupBy("segment").count().collect()}
    assert sorted(rows) == [0, 1, 2, 3, 4, 5] and sum(rows.values()) == spark.read.parquet(f"{DATA}/sf0.001/lineitem.parquet").count()


def test_calibration_over_cells_is_that_of_the_rows(spark):
    df = spark.range(4000).selectExpr("id", "id DIV 2 grp", "CAST(id % 17 AS DOUBLE) x", "CAST(id * 7 % 5 AS DOUBLE) junk", "CAST(xxhash64(id) % 20 + id % 17 > 9 AS DOUBLE) target")
    train, test, features, fit = df.where("id < 3000"), df.where("id >= 3000"), ["x", "junk"], partial(L.boosted, rounds=3, depth=2)
    binned = L.bins(train, features)
    a, b = L.cells(train.withColumn("part", L.part_of("grp")), binned, features, ["part", "target"]), L.cells(test, binned, features, ["target"])
    rows = L.cross_calibrated(train, test, features, "grp", ["target"], fit=fit).withColumn("k", F.lit(1))
    cells = L.cross_calibrated(a, b, features, "grp", ["target", "weight"], fit=fit, weight="weight").withColumn("k", F.lit(1))
    assert b.count() < 200
    for p in ("prob", "calibrated"):
        want, got = G.arm_metrics(rows, ["k"], p=p).first(), G.arm_metrics(cells, ["k"], p=p, weight="weight").first()
        assert got.n == want.n == 1000 and tuple(got) == pytest.approx(tuple(want), abs=1e-9)


@pytest.mark.parametrize(
    "name, column, values",
    [
        ("profile_changes", "verdict", {"repeated_profile", "missing_profile", "name_changed", "value_lost", "no_decision", "stale_decision", "other_name", "other_value", "unresolved", "unsafe_value", "accepted", "current_only"}),
        ("rejection_reason", "reason", {"newcomer", "low_probability", "long_odds", "second_model", "line_against", "sharp_against", "edge", "accepted"}),
        ("trading_bar", "trading_bar", {True, False}),
        ("selection_gate", "passed", {True, False}),
    ],
)
def test_every_verdict_occurs(spark, name, column, values):
    got = registry.queries()[name](spark, f"{DATA}/sf0.01").select(column).distinct().collect()
    assert {r[0] for r in got} == values


def test_a_better_candidate_passes_the_gate(spark):
    rng = random.Random(5)
    rows = []
    for i in range(3000):
        p = rng.random()
        y = int(rng.random() < p)
        day = dt.date(2022, 1, 1) + dt.timedelta(days=i % 1000)
        for arm, q in (("control", 0.5 * p + 0.3), ("better", p), ("worse", 1 - p)):
            rows.append((arm, day, y, q, "s" if i % 3 else "t"))
    df = spark.createDataFrame(rows, "arm string, event_date date, target int, prob double, part string")
    got = {r.candidate: r for r in G.selection_gate(df, "control", "part").collect()}
    assert got["better"].passed and got["better"].score > 0 and not got["worse"].passed and not got["worse"].calibration_improvement
    assert not {r.candidate: r for r in G.selection_gate(df.where("event_date < '2022-06-01' or event_date > '2024-09-20'"), "control", "part").collect()}["better"].fresh_data_credibility


def test_unpaired_bootstrap_has_the_width_of_the_exact_variance(spark):
    rng = random.Random(8)
    arm = lambda shift, n, off: [(off + i, 1.0, shift + rng.gauss(0, 1)) for i in range(n)]
    a, b = arm(0.1, 900, 0), arm(0.0, 600, 0)
    make = lambda rows: spark.createDataFrame(rows, "bet long, stake double, pnl double")
    r = E.unpaired_bootstrap(make(a), make(b), "bet", 1500).first()
    mean = lambda rows: sum(x[2] for x in rows) / len(rows)
    var = lambda rows: sum((x[2] - mean(rows)) ** 2 for x in rows) / len(rows) ** 2
    sd = (var(a) + var(b)) ** 0.5
    assert (r.n_a, r.n_b) == (900, 600) and r.roi_diff == pytest.approx(mean(a) - mean(b))
    assert abs(r.high - r.low - 3.92 * sd) < 0.5 * sd and abs((r.high + r.low) / 2 - r.roi_diff) < 0.25 * sd
    assert E.unpaired_bootstrap(make(a[:0]), make(b), "bet", 50).first().roi_a == 0
