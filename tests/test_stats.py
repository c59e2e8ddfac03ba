"""What SQL cannot show: bootstraps against exact variance, noise by its moments, models against a coin, refusals."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from boutwright.operators import evaluation as E
from boutwright.operators import learning as L
from boutwright.operators import lines as P
from boutwright.operators import refresh as R
from boutwright.operators import states as T
from boutwright.operators import dedupe as D
from boutwright.sources import payloads, supplements, tables


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(3)
    p = rng.uniform(0.05, 0.95, 2000)
    y = (rng.uniform(size=2000) < p).astype(int)
    rows = [(i, int(t), float(a), float(min(max(a + e, 0.02), 0.98)), i // 2, float(a) ** 2) for i, (a, t, e) in enumerate(zip(p, y, rng.normal(0, 0.15, 2000)))]
    return spark.createDataFrame(rows, "id long, target int, good double, noisy double, pair long, x double").repartition(4).persist()


def test_bootstrap_intervals_of_metrics(scored):
    got = {r.model: r for r in E.metric_intervals(E.bootstrap_metrics(scored, "id", probs=("good", "noisy"), rounds=400)).collect()}
    rows = scored.collect()
    for name in ("good", "noisy"):
        loss = np.array([(r[name] - r.target) ** 2 for r in rows])
        se = loss.std() / np.sqrt(len(loss))
        assert got[name].brier_lo < loss.mean() < got[name].brier_hi
        assert (got[name].brier_hi - got[name].brier_lo) == pytest.approx(3.92 * se, rel=0.2)
    again = {r.model: r for r in E.metric_intervals(E.bootstrap_metrics(scored.repartition(7), "id", probs=("good", "noisy"), rounds=400)).collect()}
    assert again["good"].brier_lo == pytest.approx(got["good"].brier_lo)


def test_paired_comparison_of_metrics(scored):
    got = {r.metric: r for r in E.metric_comparison(E.bootstrap_metrics(scored, "id", probs=("noisy", "good"), rounds=400), "noisy", "good").collect()}
    d = np.array([(r.good - r.target) ** 2 - (r.noisy - r.target) ** 2 for r in scored.collect()])
    assert got["brier"]["diff"] == pytest.approx(d.mean(), abs=3 * d.std() / np.sqrt(2000 * 400) + 1e-4)
    assert got["brier"].hi - got["brier"].lo == pytest.approx(3.92 * d.std() / np.sqrt(2000), rel=0.2) and got["brier"].p_value < 0.05


def test_noise_has_its_moments(scored):
    df = scored.select("id", F.lit(0.5).alias("a"), F.lit(0.5).alias("b")).unionByName(scored.select(F.lit(-1).cast("long").alias("id"), F.lit(None).cast("double").alias("a"), F.lit(None).cast("double").alias("b")).limit(1))
    two = L.antithetic_noise(df, "a", "b", "id").where("a is not null").agg(F.max(F.abs(F.col("a") + F.col("b") - 1)), F.avg("a"), F.stddev("a")).first()
    assert two[0] < 1e-12 and abs(two[1] - 0.5) < 0.003 and abs(two[2] - 0.03) < 0.003
    one = L.odds_noise(df, ["a", "b"], "id")
    r = one.agg(F.avg("a"), F.stddev("b"), F.corr("a", "b"), F.count(F.when(F.col("a").isNull(), 1))).first()
    assert abs(r[0] - 0.5) < 0.003 and abs(r[1] - 0.03) < 0.003 and abs(r[2]) < 0.08 and r[3] == 1


def test_models_learn_what_there_is(scored):
    df = scored.select("id", "pair", F.col("target").cast("double").alias("target"), F.when(F.col("id") % 10 > 0, F.col("x")).alias("x"), F.rand(5).alias("junk")).persist()
    model = L.boosted(df, ["x", "junk"], rounds=8, depth=3)
    loss = E.losses(L.predicted(model, df, ["target"]), [], p="prob").first()
    assert loss.brier < 0.2 and loss.accuracy > 0.65
    rank = L.permutation_ranking(model, df, ["x", "junk"], "id").collect()
    assert rank[0].feature == "x" and rank[0].importance > 5 * abs(rank[1].importance)
    cal = L.calibrated(L.predicted(model, df, ["target"])).transform(L.predicted(model, df, ["target"]))
    assert cal.orderBy("prob").select("prediction").toPandas()["prediction"].is_monotonic_increasing
    folds = L.time_series_folds(df.withColumn("day", (F.col("pair") % 50).cast("int")), "pair", "day", 2)
    best = L.grid_search(df, ["x"], folds, "pair", {"rounds": [2], "depth": [1, 3]}).collect()
    assert len(best) == 2 and best[0].brier <= best[1].brier < 0.25


def test_refusals(spark, tmp_path):
    frame = spark.createDataFrame([(1, 2.0)], "k int, r double")
    twice = spark.createDataFrame([(1, "v", 3.0), (1, "v", 3.0)], "k int, policy string, r double")
    with pytest.raises(ValueError):
        P.observed_overlay(frame, twice, "k", ["r"], "policy")
    rows = spark.createDataFrame([("professional", 1, "win")], "history_type string, grp int, subject_result string")
    with pytest.raises(ValueError):
        supplements.reviewed_history(rows, "professional", "grp", F.max("grp").cast("string"), "2")
    frame.write.parquet(str(tmp_path / "a"))
    good = {"a": tables.digest(frame)}
    assert tables.read_verified(spark, {"a": str(tmp_path / "a")}, good)["a"].count() == 1
    with pytest.raises(ValueError):
        tables.read_verified(spark, {"a": str(tmp_path / "a")}, {"a": (2, good["a"][1])})


def test_an_incomplete_scan_removes_nothing(spark):
    old = spark.createDataFrame([(1, 7, "2020-01-01", 1, 2)], "key int, event int, day string, a_id int, b_id int")
    assert R.card_changes(old, old.limit(0), complete=False).count() == 0
    assert [r.change for r in R.card_changes(old, old.limit(0)).collect()] == ["removed"]


def test_duplicates_of_the_baseline_survive(spark):
    acc = spark.createDataFrame([(1, "x"), (1, "x"), (None, "y"), (2, "z")], "k int, v string")
    same = R.duplicate_report(acc, R.appended(acc, spark.createDataFrame([(3, "n", 1)], "k int, v string, other int")), F.col("k")).first()
    assert same.passed and same.inherited_duplicates == 1 and same.inherited_invalid == 1
    worse = R.duplicate_report(acc, acc.where("v <> 'x'").unionByName(spark.createDataFrame([(1, "x"), (2, "q")], "k int, v string")), F.col("k")).first()
    assert not worse.passed and worse.changed_duplicates == 1 and worse.new_duplicates == 1


def test_window_status_and_selections(spark):
    df = spark.createDataFrame([(None, "2020-01-02 00:00:00"), ("2020-01-02 12:00:00", "2020-01-02 00:00:00")], "e string, n string")
    status = lambda closed: [r[0] for r in df.select(T.window_status(F.to_timestamp("e"), F.to_timestamp("n"), fail_closed=closed)).collect()]
    assert status(False) == ["unknown", "open"] and status(True) == ["closed", "open"]
    tree = '"main":{"sp":{"m":[{"id":1,"name":"A","odds":"1.5"},{"id":2,"name":"B","odds":"bad"},{"x":{"handicap":"","odds":"bad"}}],"l":{"name":"L","id":3,"odds":[{"header":"1","odds":2},{"odds":9}]}}},"other":{"sp":{"z":{"id":1,"name":"Z","odds":1}}}'
    t = spark.createDataFrame([(1, f'{{"results":[{{{tree}}}]}}'), (2, None), (3, f'{{"results":{{{tree},"others":[null,{{"sp":{{"q":{{"header":"h"}}}}}}]}}}}'), (4, f"{{{tree}}}"), (5, '{"results":[]}')], "k int, p string")
    got = [(r.k, r.market_group, r.market_name, r.decimal_odds) for r in t.lateralJoin(payloads.Selections(F.col("p").outer())).collect()]
    main = [("main", "l", 2.0), ("main", "m", 1.5), ("main", "m.x", None)]
    assert sorted(got, key=str) == [(1, *m) for m in main] + [(3, *m) for m in main] + [(3, "others", "q", None)]


def test_summary_of_duplicates_and_priorities(spark):
    parts = [spark.createDataFrame([(1, 10), (2, 20)], "k int, v int"), spark.createDataFrame([(2, 21)], "k int, v int")]
    assert sorted((r.k, r.v) for r in D.keep_last_source(parts, ["k"], F.asc("v")).collect()) == [(1, 10), (2, 21)]


def test_wide_roll_returns_what_is_kept(spark):
    from boutwright.operators import features as X

    stats = tuple(f"s{j}" for j in range(X.WIDE + 1))
    df = spark.range(100).select(F.col("id").alias("fight_id"), (F.col("id") % 2).alias("entity"), F.expr("date_add(DATE '2020-01-01', CAST(id AS INT))").alias("event_date"), *[F.col("id").cast("double").alias(s) for s in stats])
    out = X.rolled(df, stats, keep=("fight_id",))
    assert out.columns == ["fight_id", *[f"roll_{s}" for s in stats]]
    means = {r.fight_id: r.roll_s0 for r in out.collect()}
    assert means[0] is None and means[2] == 0.0
    w = [0.5 ** (i / 3) for i in range(49)]
    assert abs(means[98] - sum(x * v for x, v in zip(w, range(96, -1, -2))) / sum(w)) < 1e-9


def test_variants_meet_in_one_join(spark):
    import datetime as dt

    from boutwright.operators import variants

    schema = "row_id int, event_date date, fighter_a string, fighter_b string, a_kd int, b_kd int, xx_kd int"
    old = spark.sql("SELECT 1 row_id, DATE '2020-01-01' event_date, 'A' fighter_a, 'B' fighter_b, 1 a_kd, 2 b_kd, 0.5D a_odds, CAST(NULL AS DOUBLE) b_odds")
    new = spark.createDataFrame([(1, dt.date(2020, 1, 1), "b", "a", 20, 10, 7), (2, dt.date(2021, 1, 1), "c", "d", 5, 6, 8)], schema)
    rows = variants.variant_rows(old, new, "2020-01-01", ["a_kd"], ["a_odds", "b_odds"])
    assert sum(rows._jdf.queryExecution().optimizedPlan().toString().count(j) for j in ("Join FullOuter", "Join LeftOuter", "Join LeftAnti")) == 1
    got = {(r.variant, r.fighter_a): (r.a_kd, r.b_kd, r.xx_kd, r.a_odds, r.b_odds) for r in rows.collect()}
    c = {(v, "c"): (5, 6, 8, None, None) for v in variants.VARIANTS if v != "legacy_only"}
    a = {(v, "A"): (1, 2, None, 0.5, None) for v in ("legacy_only", "append_only", "hybrid_legacy_first")}
    b = {("pulled_all", "b"): (20, 10, 7, None, None), ("hybrid_pulled_from_overlap", "b"): (20, 10, 7, None, None), ("pulled_plus_legacy_market", "b"): (20, 10, 7, None, 0.5)}
    assert got == {**c, **a, **b, **{(v, "A"): (10, 2, 7, 0.5, None) for v in ("best_of_both_fields", "best_of_both_full_history")}}
    sets = variants.dataset_variants(old, new, "2020-01-01", ["a_kd"], ["a_odds", "b_odds"])
    assert sets["pulled_all"].columns == new.columns and sets["legacy_only"].columns == old.columns


def test_rounds_are_drawn_once_for_a_comparison(spark):
    """Both models come from one pass over the rows, and looked-up weights are the searched ones."""
    df = spark.range(60).select("id", (F.col("id") % 2).alias("target"), (F.col("id") % 7 / 10).alias("p"), (F.col("id") % 5 / 10).alias("q"))
    out = E.metric_comparison(E.bootstrap_metrics(df, "id", probs=("p", "q"), rounds=20), "p", "q")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1
    assert out.count() == len(E.METRICS)
    draws = E.poisson_weights(np.arange(3000), 200, 1)
    share = np.bincount(draws.astype(int).ravel(), minlength=4)[:4] / draws.size
    assert np.allclose(share, [np.exp(-1) / x for x in (1, 1, 2, 6)], atol=2e-3)


def test_cards_are_compared_once(spark):
    """What differs is written once and read by every kind of change, so no plan compares the cards again."""
    schema = "key int, event int, day string, a_id int, b_id int"
    old = spark.createDataFrame([(1, 7, "d", 1, 2), (2, 7, "d", 1, 3), (3, 7, "d", 5, 4)], schema)
    new = spark.createDataFrame([(1, 7, "d", 2, 1), (2, 7, "e", 1, 3), (4, 8, "d", 1, 6)], schema)
    out = R.card_changes(old, new)
    assert "Join FullOuter" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.old_key or 0, r.new_key or 0, r.change) for r in out.collect()) == [(0, 4, "added"), (1, 1, "reversed"), (2, 2, "rescheduled"), (3, 0, "removed")]
