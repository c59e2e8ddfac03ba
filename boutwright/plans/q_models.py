"""Queries of feature selection, calibration, search, importance, gates and profile decisions."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import fold_selection as S
from ..operators import learning as L
from ..operators import profiles as P
from ..operators import promotion as G
from .fixtures import PREDICTIONS, predictions, r6, run_sql

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _training(spark, d) -> DataFrame:
    p = predictions(spark, d).select("event_id", "bout_id", "event_date", F.col("target").cast("double").alias("target"), "prob_a", "market_a", F.col("fights_a").cast("double").alias("fights_a"), F.col("fights_b").cast("double").alias("fights_b"), "price")
    return p.withColumn("price", F.when(F.col("bout_id") % 9 > 0, F.col("price") / 10000))


FEATURES = ["prob_a", "market_a", "fights_a", "fights_b", "price"]


@query()
def forward_selection(spark, d):
    """Features of each walk-forward fold by greedy selection from sums of products: no SQL; tested against fits over the rows."""
    out = S.forward_selection(_training(spark, d), FEATURES, most=3, years=2)
    return out.select("fold", "fold_start", "fold_end", "n_train", "n_test", "features", r6("train_error").alias("train_error"), r6("test_error").alias("test_error"))


@query()
def calibrated_walk_forward(spark, d):
    """Boosted trees with a calibration cross-fitted inside each fold's training rows: no SQL; tested to lower the calibration error of a skewed model."""
    p = _training(spark, d).na.fill(0.0)
    dealt, out = L.with_series(p, "event_id", "event_date", [*FEATURES, "target"], 2), None
    for k in (1, 2):
        train, test = (L.rows_of(dealt, k, x) for x in ("train", "test"))
        binned = L.bins(train, FEATURES)
        train, test = L.cells(train.withColumn("part", L.part_of("event_id")), binned, FEATURES, ["part", "target"]), L.cells(test, binned, FEATURES, ["target"])
        scored = L.cross_calibrated(train, test, FEATURES, "event_id", ["target", "weight"], fit=partial(L.boosted, rounds=4, depth=3), weight="weight")
        for kind in ("prob", "calibrated"):
            m = G.arm_metrics(scored.withColumn("fold", F.lit(k)), ["fold"], p=kind, weight="weight").withColumn("scores", F.lit(kind))
            out = m if out is None else out.unionByName(m)
    return out.select("fold", "scores", "n", *[r6(c).alias(c) for c in ("brier", "log_loss", "accuracy", "ece")])


@query()
def permutation_importance(spark, d):
    """Features ranked by how much the log loss rises when they are exchanged among rows, and the best two: no SQL; tested on a feature that decides and one that does not."""
    p = _training(spark, d).na.fill(0.0)
    ranked = L.permutation_ranking(L.boosted(p, FEATURES, rounds=4, depth=3), p, FEATURES, "bout_id")
    return ranked.select("feature", r6("importance").alias("importance"))


@query()
def parameter_search(spark, d):
    """Rounds and depth of boosted trees over all features by mean Brier over five time-series folds: no SQL; tested on the order of what is found."""
    p = _training(spark, d).na.fill(0.0)
    dealt = L.with_series(p, "event_id", "event_date", [*FEATURES, "target"], 5)
    return L.searched(dealt, FEATURES, [1, 2, 3, 4, 5], {"rounds": [5, 10, 20], "depth": [2, 3, 4]}).withColumn("brier", r6("brier"))


_ARMS = {"model": "prob_a", "second": "second_a", "mean": "(prob_a + market_a) / 2", "sure": "CASE WHEN market_a > 0.5 THEN 0.95 ELSE 0.05 END", "nudged": "CASE WHEN slice = 'F' THEN market_a ELSE 0.9 * market_a + 0.05 END"}
_SCORES = " UNION ALL ".join(f"SELECT '{a}' arm, event_date, target, slice, {e} prob FROM predictions" for a, e in {**_ARMS, "market": "market_a"}.items())


@query(f"""WITH {PREDICTIONS}, s AS ({_SCORES}), r AS (SELECT *, year(event_date) y, pow(prob - target, 2) q, -(target * ln(greatest(1e-15, least(1 - 1e-15, prob))) + (1 - target) * ln(1 - greatest(1e-15, least(1 - 1e-15, prob)))) l, CASE WHEN (prob >= 0.5) = (target = 1) THEN 1.0 ELSE 0.0 END h, least(floor(round(prob * 10, 9)), 9) b FROM s),
m AS (SELECT arm, count(*) n, avg(q) brier, avg(l) ll, avg(h) acc FROM r GROUP BY 1), e AS (SELECT arm, sum(n * d) / sum(n) ece FROM (SELECT arm, b, count(*) n, abs(avg(prob) - avg(target)) d FROM r GROUP BY 1, 2) z GROUP BY 1),
k AS (SELECT m.*, ece FROM m JOIN e ON m.arm = e.arm), c AS (SELECT brier cb, ll cl, acc ca, ece ce FROM k WHERE arm = 'market'), f AS (SELECT arm, count(*) fn, avg(q) fb FROM r WHERE event_date > (SELECT max(event_date) FROM r) - 180 GROUP BY 1),
ye AS (SELECT arm, y, sum(n * d) / sum(n) ece FROM (SELECT arm, y, b, count(*) n, abs(avg(prob) - avg(target)) d FROM r GROUP BY 1, 2, 3) z GROUP BY 1, 2), yb AS (SELECT arm, y, avg(q) brier FROM r GROUP BY 1, 2), yy AS (SELECT yb.arm, yb.y, brier, ece FROM yb JOIN ye ON yb.arm = ye.arm AND yb.y = ye.y),
w AS (SELECT a.arm, max(greatest((a.brier - o.brier) / o.brier, (a.ece - o.ece) / o.ece)) worst FROM yy a JOIN yy o ON a.y = o.y AND o.arm = 'market' GROUP BY 1), g AS (SELECT arm, max(n / total) widest FROM (SELECT arm, slice, count(*) n, avg(q) brier, sum(count(*)) OVER (PARTITION BY arm) total FROM r GROUP BY 1, 2) z, c WHERE brier < cb GROUP BY 1),
j AS (SELECT k.arm candidate, brier < cb OR ece < ce calibration_improvement, greatest((brier - cb) / cb, (ll - cl) / cl, (ece - ce) / ce, (ca - acc) / ca) <= 0.05 no_material_degradation, fn >= 20 AND fb <= (SELECT fb FROM f WHERE arm = 'market') fresh_data_credibility, worst <= 0.1 year_by_year_stability,
 coalesce(widest >= 0.1, true) not_slice_driven, NOT (acc > ca AND NOT (brier < cb OR ece < ce)) not_accuracy_only, round(-(brier - cb) / cb - (ece - ce) / ce - greatest(0, (ll - cl) / cl), 6) score FROM k, c, f, w LEFT JOIN g ON g.arm = w.arm WHERE k.arm <> 'market' AND f.arm = k.arm AND w.arm = k.arm)
SELECT *, calibration_improvement AND no_material_degradation AND fresh_data_credibility AND year_by_year_stability AND not_slice_driven AND not_accuracy_only passed FROM j""")
def selection_gate(spark, d):
    scores = run_sql(spark, d, _SCORES, predictions=predictions(spark, d))
    return G.selection_gate(scores.withColumn("prob", F.col("prob").cast("double")), "market", "slice").withColumn("score", r6("score"))


_BARS = "SELECT o_orderkey k, CAST(o_orderkey % 7 - 3 AS DOUBLE) / 16 new_roi, CAST(o_custkey % 7 - 3 AS DOUBLE) / 16 old_roi, CAST(o_orderkey % 11 - 5 AS DOUBLE) new_profit, CAST(o_custkey % 11 - 5 AS DOUBLE) old_profit, CAST(o_orderkey % 9 AS DOUBLE) / 32 new_drawdown, CAST(o_custkey % 5 AS DOUBLE) / 32 old_drawdown, CAST(o_orderkey % 13 - 6 AS DOUBLE) / 128 new_clv, CASE WHEN o_custkey % 4 > 0 THEN CAST(o_custkey % 13 - 6 AS DOUBLE) / 128 END old_clv, CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_orderkey % 17 AS DOUBLE) / 16 END p_value FROM orders"


@query(f"""WITH x AS (SELECT *, new_roi > old_roi OR new_profit > old_profit gain FROM ({_BARS}) z), y AS (SELECT list_filter([CASE WHEN NOT gain THEN 'no_gain' END, CASE WHEN gain AND p_value > 0.25 THEN 'indistinct' END, CASE WHEN old_drawdown > 0 AND new_drawdown > 2 * old_drawdown THEN 'drawdown' END, CASE WHEN new_clv < old_clv - 0.01 THEN 'closing_line' END], lambda f: f IS NOT NULL) f, k FROM x)
SELECT coalesce(array_to_string(f, ','), '') failures, len(f) = 0 trading_bar, count(*) n, sum(k)::BIGINT ks FROM y GROUP BY 1, 2""")
def trading_bar(spark, d):
    x = G.trading_bar(run_sql(spark, d, _BARS))
    return x.groupBy(F.array_join("failures", ",").alias("failures"), "trading_bar").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("ks"))


_OLD = "SELECT o_orderkey + CASE WHEN o_orderkey % 101 = 1 THEN 7 ELSE 0 END id, concat('N', CAST(o_orderkey % 90 AS VARCHAR(9))) name, CAST(o_custkey % 60 + 150 AS VARCHAR(9)) height, CASE WHEN o_orderkey % 4 > 0 THEN o_orderpriority END stance FROM orders WHERE o_orderkey % 31 > 0"
_NEW = "SELECT o_orderkey id, CASE WHEN o_orderkey % 41 = 2 THEN 'Other' ELSE concat('n', CAST(o_orderkey % 90 AS VARCHAR(9))) END name, CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_custkey % 60 + 151 AS VARCHAR(9)) WHEN o_orderkey % 43 = 3 THEN ' ' ELSE CAST(o_custkey % 60 + 150 AS VARCHAR(9)) END height, o_orderpriority stance FROM orders WHERE o_orderkey % 37 > 0"
#: Decisions on heights, in two rounds; the hash is that of the cell as it was seen.
_LOG = """SELECT o_orderkey AS key, 'height' field, 1 seq, CASE WHEN o_orderkey % 3 = 0 THEN 'n-x' ELSE concat('N', CAST(o_orderkey % 90 AS VARCHAR(9))) END name, CAST(o_custkey % 60 + 151 AS VARCHAR(9)) raw_value, CAST(o_custkey % 60 + 151 AS VARCHAR(9)) safe_value, 'pending' status, CAST(o_custkey % 60 + 150 AS VARCHAR(9)) seen FROM orders WHERE o_orderkey % 7 > 1
UNION ALL SELECT o_orderkey, 'height', 2, concat('N', CAST(o_orderkey % 90 AS VARCHAR(9))), CAST(o_custkey % 60 + CASE WHEN o_orderkey % 13 = 4 THEN 150 ELSE 151 END AS VARCHAR(9)), CAST(o_custkey % 60 + CASE WHEN o_orderkey % 17 = 5 THEN 150 ELSE 151 END AS VARCHAR(9)), CASE o_orderkey % 4 WHEN 0 THEN 'accepted' WHEN 1 THEN 'current_only' WHEN 2 THEN 'Accepted' ELSE 'rejected' END, CAST(o_custkey % 60 + CASE WHEN o_orderkey % 19 = 6 THEN 149 ELSE 150 END AS VARCHAR(9)) FROM orders WHERE o_orderkey % 7 > 3"""


@query(f"""WITH o AS ({_OLD}), n AS ({_NEW}), l AS (SELECT * FROM ({_LOG}) z QUALIFY row_number() OVER (PARTITION BY key, field ORDER BY seq DESC, status DESC) = 1), o1 AS (SELECT * FROM o QUALIFY count(*) OVER (PARTITION BY id) = 1), n1 AS (SELECT * FROM n QUALIFY count(*) OVER (PARTITION BY id) = 1),
d AS (SELECT n1.id, n1.name, f.field, coalesce(trim(CASE f.field WHEN 'height' THEN o1.height ELSE o1.stance END), '') b, coalesce(trim(CASE f.field WHEN 'height' THEN n1.height ELSE n1.stance END), '') a FROM n1 LEFT JOIN o1 ON o1.id = n1.id, (VALUES ('height'), ('stance')) f(field)),
v AS (SELECT d.id AS key, d.field, d.b AS "before", d.a AS "after", CASE WHEN b <> '' AND a = '' THEN 'value_lost' WHEN l.key IS NULL THEN 'no_decision' WHEN l.seen <> d.b THEN 'stale_decision' WHEN lower(l.name) <> lower(d.name) THEN 'other_name' WHEN l.raw_value <> d.a THEN 'other_value' WHEN lower(l.status) NOT IN ('accepted', 'current_only') THEN 'unresolved'
 WHEN lower(l.status) = 'accepted' AND l.safe_value <> d.a THEN 'unsafe_value' ELSE lower(l.status) END verdict FROM d LEFT JOIN l ON l.key = d.id AND l.field = d.field WHERE a <> b)
SELECT * FROM v UNION ALL SELECT DISTINCT id, '', 'accepted', '', 'repeated_profile' FROM o QUALIFY count(*) OVER (PARTITION BY id) > 1 UNION ALL SELECT id, '', name, '', 'missing_profile' FROM (SELECT DISTINCT id, name FROM o) z WHERE id NOT IN (SELECT id FROM n)
UNION ALL SELECT o1.id, 'name', o1.name, n1.name, 'name_changed' FROM o1 JOIN n1 ON o1.id = n1.id WHERE lower(o1.name) <> lower(n1.name)""")
def profile_changes(spark, d):
    """Every verdict on changed profiles: decisions of two rounds, some taken on values that no longer stand."""
    log = run_sql(spark, d, _LOG).withColumn("cell", P.cell_hash(F.col("key"), F.col("field"), F.col("seen")))
    return P.assess(run_sql(spark, d, _OLD), run_sql(spark, d, _NEW), log, "id", "name", ["height", "stance"])
