"""Queries of selection, simulation and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import evaluation as E
from ..operators import selection as X
from ..operators import simulate as M
from .fixtures import BETS, PREDICTIONS, bets, predictions, r6

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df, *names):
    return df.select(*[r6(c).alias(c) if c in names else c for c in df.columns])


def _weight(p, s, m):
    return f"""greatest(0.15, least(0.50, CASE WHEN 2 * abs({p} - 0.5) >= 0.30 THEN 0.30 + least(1, (2 * abs({p} - 0.5) - 0.30) / (1 - 0.30)) * (0.50 - 0.30) ELSE 0.15 + 2 * abs({p} - 0.5) / 0.30 * (0.30 - 0.15) END
 + CASE WHEN ({p} > {m} AND {s} - {m} > 0.05) OR ({p} < {m} AND {m} - {s} > 0.05) THEN 0.10 ELSE 0 END))"""


_SIDES = f"""{PREDICTIONS},
w AS (SELECT *, {_weight('prob_a', 'second_a', 'market_a')} wa, {_weight('prob_b', 'second_b', 'market_b')} wb FROM predictions),
bl AS (SELECT *, wa * prob_a + (1 - wa) * market_a ba, wb * prob_b + (1 - wb) * market_b bb FROM w),
sd AS (SELECT bout_id, event_id, event_date, fights_a, fights_b, target, 'a' side, prob_a prob, second_a sec, market_a market, ba / (ba + bb) blended FROM bl
 UNION ALL SELECT bout_id, event_id, event_date, fights_a, fights_b, target, 'b', prob_b, second_b, market_b, bb / (ba + bb) FROM bl),
sides AS (SELECT *, 1 / market odds, blended - market edge FROM sd),
judged AS (SELECT *, CASE WHEN NOT (fights_a >= 2 AND fights_b >= 2) THEN 'newcomer' WHEN NOT blended >= 0.40 THEN 'low_probability' WHEN NOT odds <= 3.0 THEN 'long_odds' WHEN NOT sec - market >= 0.01 THEN 'second_model'
 WHEN NOT edge >= CASE WHEN odds <= 2 THEN 0.02 ELSE 0.02 + 0.02 * (odds - 2) END THEN 'edge' ELSE 'accepted' END reason FROM sides)"""


#: The same sides with tiers and lines, judged by all gates in order.
_GATED = f"""{_SIDES},
gated AS (SELECT *, event_id % 4 ta, bout_id % 10 % 4 tb, CAST(bout_id % 11 - 5 AS DOUBLE) / 64 m, bout_id % 5 = 0 OR bout_id % 3 = 0 quick, CASE WHEN odds <= 2 THEN 0.02 ELSE 0.02 + 0.02 * (odds - 2) END need FROM sides),
ruled AS (SELECT *, NOT (fights_a <= 0 AND ta NOT IN (1, 2)) AND NOT (fights_b <= 0 AND tb NOT IN (1, 2)) allowed, CASE WHEN side = 'a' THEN m < -0.02 ELSE m > 0.02 END against,
 greatest(CASE WHEN fights_a >= 3 THEN 0 WHEN ta = 1 THEN 0.02 WHEN ta = 2 THEN 0.03 ELSE 0.04 END, CASE WHEN fights_b >= 3 THEN 0 WHEN tb = 1 THEN 0.02 WHEN tb = 2 THEN 0.03 ELSE 0.04 END) extra, CASE WHEN fights_a < 3 OR fights_b < 3 THEN 0.5 ELSE 1.0 END size FROM gated),
verdicts AS (SELECT *, CASE WHEN NOT allowed THEN 'newcomer' WHEN NOT blended >= 0.40 THEN 'low_probability' WHEN NOT odds <= 3.0 THEN 'long_odds' WHEN NOT sec - market >= 0.01 THEN 'second_model'
 WHEN against AND NOT edge >= need + extra + 0.02 THEN 'line_against' WHEN against AND quick THEN 'sharp_against' WHEN NOT edge >= need + extra THEN 'edge' ELSE 'accepted' END reason FROM ruled)"""


def _gated(spark, d):
    c = F.col
    more = {"tier_a": c("event_id") % 4, "tier_b": c("bout_id") % 10 % 4, "line_movement": (c("bout_id") % 11 - 5).cast("double") / 64, "line_is_sharp": F.when(c("bout_id") % 5 == 0, 1).otherwise(0), "line_steam_move": F.when(c("bout_id") % 3 == 0, 1)}
    return predictions(spark, d).withColumns(more)


_ALL = {"tiers": True, "lines": True}


@query(f"WITH {_GATED} SELECT reason, side, count(*) n, round(avg(edge), 6) mean_edge FROM verdicts GROUP BY 1, 2")
def rejection_reason(spark, d):
    s = X.sides(_gated(spark, d)).withColumn("reason", X.rejection_reason(**_ALL))
    return s.groupBy("reason", "side").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("edge")).alias("mean_edge"))


@query(f"WITH {_GATED}, v AS (SELECT * FROM verdicts WHERE reason = 'accepted' QUALIFY row_number() OVER (PARTITION BY bout_id ORDER BY edge DESC, side, size DESC) = 1) SELECT bout_id, side, round(blended, 6) blended, round(odds, 6) odds, round(edge, 6) edge, size::DOUBLE size FROM v")
def value_side(spark, d):
    return rounded(X.value_bets(_gated(spark, d), **_ALL).select("bout_id", "side", "blended", "odds", "edge", "size"), "blended", "odds", "edge")


@query(f"WITH {_GATED} SELECT bout_id, side, round(edge, 6) edge FROM verdicts WHERE reason = 'edge' AND edge >= 0.005")
def near_miss(spark, d):
    return rounded(X.near_misses(_gated(spark, d), 0.005, **_ALL).select("bout_id", "side", "edge"), "edge")


@query(f"WITH {_SIDES} SELECT reason, side, count(*) n, round(avg(edge), 6) mean_edge FROM judged GROUP BY 1, 2")
def flat_gate_reason(spark, d):
    """The gates without tiers and lines: two bouts on both sides."""
    s = X.sides(predictions(spark, d)).withColumn("reason", X.rejection_reason())
    return s.groupBy("reason", "side").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("edge")).alias("mean_edge"))


@query(f"""WITH {_SIDES}, g AS (SELECT bout_id, max(edge) FILTER (WHERE side = 'a') ea, max(edge) FILTER (WHERE side = 'b') eb, bool_or(reason = 'accepted') FILTER (WHERE side = 'a') oa, bool_or(reason = 'accepted') FILTER (WHERE side = 'b') ob FROM judged GROUP BY 1)
SELECT bout_id, CASE WHEN ea >= eb AND oa THEN 'a' ELSE 'b' END side, round(CASE WHEN ea >= eb AND oa THEN ea ELSE eb END, 6) edge FROM g WHERE (ea >= eb AND oa) OR ob""")
def backtest_candidates(spark, d):
    return rounded(X.backtest_candidates(predictions(spark, d)), "edge")


@query(f"""WITH {_SIDES}, c AS (SELECT *, prob * (odds - 1) - (1 - prob) ev FROM sides) SELECT bout_id, side, round(ev, 6) ev, round(least(0.05 + 0.01 * (prob - 0.65) / 0.05, 0.08) * 1000, 2) stake FROM c WHERE prob >= 0.65 AND sec >= 0.50 AND ev > 0""")
def conviction(spark, d):
    return rounded(X.conviction_bets(predictions(spark, d)).select("bout_id", "side", "ev", "stake"), "ev")


_GATES = ("newcomer", "low_probability", "long_odds", "second_model", "line_against", "sharp_against", "edge")


@query(f"""WITH {_GATED} SELECT count(*) AS "all", {", ".join(f"count(*) FILTER (WHERE reason NOT IN ({', '.join(repr(x) for x in _GATES[: i + 1])})) {g}" for i, g in enumerate(_GATES))} FROM verdicts""")
def filter_funnel(spark, d):
    return X.funnel(_gated(spark, d), **_ALL)


@query(f"""WITH {PREDICTIONS}, p AS (SELECT bout_id, CASE WHEN prob_a >= prob_b THEN 'a' ELSE 'b' END side, greatest(prob_a, prob_b) prob, CASE WHEN prob_a >= prob_b THEN market_a ELSE market_b END m, fights_a, fights_b FROM predictions)
SELECT bout_id, side, round(prob, 6) prob, CASE WHEN fights_a < 1 OR fights_b < 1 THEN 'newcomer' WHEN m <= 0 THEN 'no_price' WHEN 1 / m > 6 THEN 'long_odds' ELSE 'taken' END reason FROM p""")
def flat_picks(spark, d):
    return rounded(X.flat_picks(predictions(spark, d)), "prob")


@query(f"""WITH {PREDICTIONS} SELECT slice, count(*) n, round(avg(pow(prob_a - target, 2)), 6) brier, round(avg(-(target * ln(greatest(1e-15, least(1 - 1e-15, prob_a))) + (1 - target) * ln(1 - greatest(1e-15, least(1 - 1e-15, prob_a))))), 6) log_loss,
 round(avg(CASE WHEN (CASE WHEN prob_a >= 0.5 THEN 1 ELSE 0 END) = target THEN 1.0 ELSE 0.0 END), 6) accuracy FROM predictions GROUP BY 1""")
def brier_logloss(spark, d):
    return rounded(E.losses(predictions(spark, d), ["slice"]), "brier", "log_loss", "accuracy")


_BINS = f"{PREDICTIONS}, bins AS (SELECT slice, CAST(least(floor(round(prob_a * 10, 9)), 9) AS INTEGER) bin, count(*) n, avg(prob_a) mean_prob, avg(target) rate FROM predictions GROUP BY 1, 2)"


@query(f"WITH {_BINS} SELECT slice, bin, n, round(mean_prob, 6) mean_prob, round(rate, 6) rate FROM bins")
def ece_bins(spark, d):
    return rounded(E.calibration_bins(predictions(spark, d), ["slice"]), "mean_prob", "rate")


@query(f"WITH {_BINS} SELECT slice, round(sum(n * abs(mean_prob - rate)) / sum(n), 6) ece FROM bins GROUP BY 1")
def ece(spark, d):
    return rounded(E.calibration_error(E.calibration_bins(predictions(spark, d), ["slice"]), ["slice"]), "ece")


@query(f"""WITH {PREDICTIONS}, s AS (SELECT slice, round(prob_a, 6) p, CAST(sum(target) AS DOUBLE) pos, CAST(sum(1 - target) AS DOUBLE) neg FROM predictions GROUP BY 1, 2),
b AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY slice ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) below FROM s) SELECT slice, round(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 6) auc FROM b GROUP BY 1""")
def auc_rank(spark, d):
    return rounded(E.auc(predictions(spark, d), ["slice"]), "auc")


@query(f"""WITH {PREDICTIONS}, x AS (SELECT (CASE WHEN prob_a >= 0.5 THEN 1 ELSE 0 END) = target ra, (CASE WHEN market_a >= 0.5 THEN 1 ELSE 0 END) = target rb FROM predictions),
c AS (SELECT CAST(sum(CASE WHEN ra AND NOT rb THEN 1 ELSE 0 END) AS BIGINT) only_a, CAST(sum(CASE WHEN NOT ra AND rb THEN 1 ELSE 0 END) AS BIGINT) only_b FROM x)
SELECT only_a, only_b, round(CAST((abs(only_a - only_b) - 1) * (abs(only_a - only_b) - 1) AS DOUBLE) / (only_a + only_b), 6) statistic FROM c""")
def mcnemar(spark, d):
    return rounded(E.mcnemar(predictions(spark, d), "target", "prob_a", "market_a"), "statistic")


@query(f"WITH {PREDICTIONS} SELECT slice, " + ", ".join(f"CAST(sum(CASE WHEN (CASE WHEN prob_a >= 0.5 THEN 1 ELSE 0 END) = {a} AND target = {b} THEN 1 ELSE 0 END) AS BIGINT) {n}" for n, a, b in (("tp", 1, 1), ("fp", 1, 0), ("fn", 0, 1), ("tn", 0, 0))) + " FROM predictions GROUP BY 1")
def confusion_counts(spark, d):
    return E.confusion(predictions(spark, d), ["slice"])


@query(f"""WITH {BETS} SELECT strategy, count(*) n, round(sum(pnl), 4) profit, round(sum(stake), 4) staked, round(sum(pnl) / sum(stake), 6) roi, round(avg(won), 6) win_rate, round(avg(pnl / stake) / stddev_samp(pnl / stake) * sqrt(300), 6) sharpe, round(avg(pnl / stake - edge), 6) edge_gap FROM bets GROUP BY 1""")
def strategy_summary(spark, d):
    out = E.bet_summary(bets(spark, d), ["strategy"])
    return rounded(out.withColumn("profit", F.round("profit", 4)).withColumn("staked", F.round("staked", 4)), "roi", "win_rate", "sharpe", "edge_gap")


@query(f"""WITH {BETS}, b AS (SELECT *, year(event_date) y, 1000 + sum(pnl) OVER (PARTITION BY strategy, year(event_date) ORDER BY event_date, bet_id) bank FROM bets),
p AS (SELECT *, greatest(1000, max(bank) OVER (PARTITION BY strategy, y ORDER BY event_date, bet_id)) peak FROM b)
SELECT strategy, CAST(y AS INTEGER) AS "year", count(*) n, round(arg_max(bank, (event_date, bet_id)), 4) final, round(max(peak), 4) peak, round(max(peak - bank), 4) max_drawdown, round(max((peak - bank) / peak), 6) max_drawdown_share FROM p GROUP BY 1, 2""")
def year_drawdown(spark, d):
    out = E.drawdown_by(bets(spark, d).withColumn("year", F.year("event_date")), ["strategy", "year"], ["event_date", "bet_id"])
    return rounded(out.select("strategy", "year", "n", *[F.round(c, 4).alias(c) for c in ("final", "peak", "max_drawdown")], "max_drawdown_share"), "max_drawdown_share")


@query(f"""WITH {BETS}, e AS (SELECT strategy, event_date, sum(pnl) p, sum(stake) s FROM bets GROUP BY 1, 2), t AS (SELECT strategy, sum(pnl) tp, sum(stake) ts FROM bets GROUP BY 1)
SELECT e.strategy, event_date, round(tp / ts, 6) roi, round((tp - p) / (ts - s), 6) roi_without, round((tp - p) / (ts - s) - tp / ts, 6) shift, abs((tp - p) / (ts - s) - tp / ts) > 0.0005 fragile FROM e JOIN t ON e.strategy = t.strategy""")
def leave_one_out(spark, d):
    return rounded(E.leave_one_out(bets(spark, d), "event_date", "strategy", 0.0005), "roi", "roi_without", "shift")


@query(f"""WITH {BETS}, e AS (SELECT event_date, sum(pnl) pnl, count(*) n_bets FROM bets GROUP BY 1)
SELECT event_date, round(pnl, 4) pnl, n_bets, 'best' kind FROM (SELECT * FROM e ORDER BY pnl DESC, event_date LIMIT 5) UNION ALL SELECT event_date, round(pnl, 4), n_bets, 'worst' FROM (SELECT * FROM e ORDER BY pnl, event_date LIMIT 5)""")
def top_events(spark, d):
    return E.extremes(bets(spark, d), "event_date", 5).withColumn("pnl", F.round("pnl", 4))


@query(f"""WITH {BETS}, f AS (SELECT *, year(event_date) * 2 + CASE WHEN month(event_date) > 6 THEN 1 ELSE 0 END fold FROM bets),
g AS (SELECT strategy, fold, count(*) n, sum(pnl) pnl FROM f WHERE edge >= 0.08 GROUP BY 1, 2), a AS (SELECT DISTINCT strategy, fold FROM f)
SELECT a.strategy, CAST(a.fold AS INTEGER) fold, coalesce(n, 0) n, round(coalesce(pnl, 0), 4) pnl FROM a LEFT JOIN g ON a.strategy = g.strategy AND a.fold = g.fold""")
def fold_summary(spark, d):
    b = bets(spark, d).withColumn("fold", (F.year("event_date") * 2 + (F.month("event_date") > 6).cast("int")).cast("int"))
    return E.fold_summary(b.where("edge >= 0.08"), b.select("strategy", "fold").distinct()).withColumn("pnl", F.round("pnl", 4)).select("strategy", "fold", "n", "pnl")


def _staked(spark, d):
    b = bets(spark, d)
    return b.withColumn("pool", F.concat_ws("-", "strategy", F.year("event_date"), F.month("event_date"))).withColumn("prob", 1 / F.col("odds") + F.col("edge"))


_STAKED = f"""{BETS}, st AS (SELECT *, strategy || '-' || year(event_date) || '-' || month(event_date) pool, 1 / odds + edge prob FROM bets),
nm AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY event_date, bet_id) i FROM st)"""


def _fold_sql(share: str) -> str:
    want = f"cash * least(greatest({share} * (((odds - 1) * prob - (1 - prob)) / (odds - 1)), 0), 0.04)"
    return f"CASE WHEN {want} < 1 OR cash < 400 THEN 0 ELSE {want} END"


@query(f"""WITH RECURSIVE {_STAKED}, fold(pool, i, cash, peak, staked, n, dd) AS (SELECT DISTINCT pool, CAST(0 AS BIGINT), CAST(1000 AS DOUBLE), CAST(1000 AS DOUBLE), CAST(0 AS DOUBLE), 0, CAST(0 AS DOUBLE) FROM nm
 UNION ALL SELECT pool, i, c2, greatest(peak, c2), staked + stake, n + CASE WHEN stake > 0 THEN 1 ELSE 0 END, greatest(dd, greatest(peak, c2) - c2) FROM (
  SELECT pool, i, peak, staked, n, dd, stake, cash + CASE WHEN won = 1 THEN stake * (odds - 1) ELSE -stake END c2 FROM (SELECT f.pool, nm.i, cash, peak, staked, n, dd, odds, won, {_fold_sql('0.25')} stake FROM fold f JOIN nm ON nm.pool = f.pool AND nm.i = f.i + 1) y) z)
SELECT pool, round(cash, 4) final, round(peak, 4) peak, round(staked, 4) staked, CAST(n AS INTEGER) n_bets, round(dd, 4) max_drawdown FROM fold QUALIFY row_number() OVER (PARTITION BY pool ORDER BY i DESC) = 1""")
def kelly_fold(spark, d):
    out = M.kelly_fold(_staked(spark, d), ["pool"], ["event_date", "bet_id"])
    return out.select("pool", *[F.round(c, 4).alias(c) for c in ("final", "peak", "staked")], "n_bets", F.round("max_drawdown", 4).alias("max_drawdown"))


@query(f"""WITH {_STAKED}, fr AS (SELECT pool, event_date, least(greatest(0.25 * (((odds - 1) * prob - (1 - prob)) / (odds - 1)), 0), 0.04) f, CASE WHEN won = 1 THEN odds - 1 ELSE -1 END g FROM st),
dy AS (SELECT pool, event_date, sum(f) a, sum(f * g) r FROM fr GROUP BY 1, 2)
SELECT pool, count(*) n_days, round(1000 * product(1 + CASE WHEN a > 1 THEN r / a ELSE r END), 4) final FROM dy GROUP BY 1""")
def batched_settlement(spark, d):
    return M.batched_settlement(_staked(spark, d), ["pool"], "event_date").select("pool", "n_days", F.round("final", 4).alias("final"))


@query()
def param_sweep(spark, d):
    """Three stake shares in parallel: the fold of kelly_fold over a grid; tested against a plain loop."""
    out = M.sweep(_staked(spark, d), ["pool"], ["event_date", "bet_id"], [0.1, 0.25, 0.5])
    return out.select("pool", "share", *[F.round(c, 4).alias(c) for c in ("final", "peak", "staked", "max_drawdown")], "n_bets")


@query(f"""WITH {BETS}, x AS (SELECT bet_id, stake * 4 s, fill_prob p, greatest(0.01, least(0.99, fill_prob + 0.005)) ask, 180 - 145 * (1 - 4 * fill_prob * (1 - fill_prob)) dep FROM bets), y AS (SELECT *, least(s, 0.25 * dep) want FROM x),
z AS (SELECT *, least(want, dep * 0.10) q0, least(greatest(want - dep * 0.10, 0), dep * 0.15) q1 FROM y)
SELECT bet_id, round(q0 + q1, 6) filled, round((q0 + q1) / (q0 / ask + q1 / (ask + 0.01)), 6) fill_price, CASE WHEN dep < 50 THEN 'thin' WHEN (q0 + q1) / (q0 / ask + q1 / (ask + 0.01)) / ask - 1 > 0.03 THEN 'slippage' ELSE 'filled' END status FROM z""")
def realistic_fill(spark, d):
    out = M.realistic_fill(bets(spark, d).withColumn("s", F.col("stake") * 4), "fill_prob", "s")
    return rounded(out.select("bet_id", "filled", "fill_price", "status"), "filled", "fill_price")


@query()
def paired_bootstrap(spark, d):
    """Hash-drawn Poisson bootstrap; tested for its interval against the exact variance."""
    b = bets(spark, d)
    out = E.paired_bootstrap(b.where("strategy <= '3-MEDIUM'"), b.where("strategy >= '3-MEDIUM'"), "event_date")
    return rounded(out, "profit_diff", "roi_diff", "low", "high", "p_value")


@query()
def unpaired_bootstrap(spark, d):
    """ROI of two sets of bets against each other; drawn, so no SQL: tested for its interval against the exact variance."""
    b = bets(spark, d)
    return rounded(E.unpaired_bootstrap(b.where("strategy <= '3-MEDIUM'"), b.where("strategy > '3-MEDIUM'"), "bet_id"), "roi_a", "roi_b", "roi_diff", "low", "high", "p_value")


@query(f"""WITH {PREDICTIONS}, m AS (SELECT slice, avg(pow(prob_a - target, 2)) bn, avg(pow(market_a - target, 2)) bo, avg(-(target * ln(prob_a) + (1 - target) * ln(1 - prob_a))) ln_, avg(-(target * ln(market_a) + (1 - target) * ln(1 - market_a))) lo FROM predictions GROUP BY 1),
cb AS (SELECT slice, which, b, count(*) n, avg(p) mp, avg(target) rt FROM (SELECT slice, target, 'n' which, prob_a p, least(floor(round(prob_a * 10, 9)), 9) b FROM predictions UNION ALL SELECT slice, target, 'o', market_a, least(floor(round(market_a * 10, 9)), 9) FROM predictions) z GROUP BY 1, 2, 3),
ec AS (SELECT slice, sum(n * abs(mp - rt)) FILTER (WHERE which = 'n') / sum(n) FILTER (WHERE which = 'n') en, sum(n * abs(mp - rt)) FILTER (WHERE which = 'o') / sum(n) FILTER (WHERE which = 'o') eo FROM cb GROUP BY 1)
SELECT m.slice, (bn < bo AND en <= 1.1 * eo) OR (en < eo AND bn <= 1.1 * bo) model_bar, round(-(bn - bo) - (en - eo) - greatest(0, ln_ - lo), 6) score FROM m JOIN ec ON m.slice = ec.slice""")
def promotion_gate(spark, d):
    p = predictions(spark, d)
    m = None
    for kind, col in (("new", "prob_a"), ("old", "market_a")):
        loss = E.losses(p, ["slice"], p=col).select("slice", F.col("brier").alias(f"brier_{kind}"), F.col("log_loss").alias(f"ll_{kind}"))
        ece = E.calibration_error(E.calibration_bins(p, ["slice"], p=col), ["slice"]).withColumnRenamed("ece", f"ece_{kind}")
        part = loss.join(ece, "slice")
        m = part if m is None else m.join(part, "slice")
    return rounded(E.promotion(m).select("slice", "model_bar", "score"), "score")


@query(f"""WITH {PREDICTIONS}, w AS (SELECT bout_id, event_date, pow(2, -date_diff('day', event_date, DATE '2000-01-01') / 730.0) w FROM predictions) SELECT year(event_date)::INTEGER AS "year", round(sum(w) / (SELECT avg(w) FROM w), 4) weight FROM w GROUP BY 1""")
def sample_weights(spark, d):
    p = predictions(spark, d).select(F.year("event_date").alias("year"), S.sample_weight(F.datediff(F.lit("2000-01-01").cast("date"), "event_date")).alias("w"))
    mean = p.agg(F.avg("w")).first()[0]
    return p.groupBy("year").agg(F.round(F.sum("w") / F.lit(mean), 4).alias("weight"))
