"""Queries of ledgers, audits, bootstraps, folds and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import learning as L
from ..operators import ledger as G
from .fixtures import BETS, PREDICTIONS, bets, predictions, r6, run_sql

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _shown(df):
    return df.select(*[r6(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


_LEDGER = """SELECT o_orderpriority grp, CASE o_orderkey % 5 WHEN 0 THEN 'won' WHEN 1 THEN 'lost' WHEN 2 THEN 'open' WHEN 3 THEN 'pending' ELSE 'won' END status, CASE WHEN o_orderkey % 4001 > 0 OR o_orderpriority > '3' THEN CAST(o_custkey % 50 + 1 AS DOUBLE) END AS cost, CAST(o_custkey % 20 + 1 AS DOUBLE) shares, CASE WHEN o_orderkey % 7 > 0 THEN CAST(o_orderkey % 9 AS DOUBLE) / 8 END price, CAST(o_custkey % 30 - 12 AS DOUBLE) pnl, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 17 - 8 AS DOUBLE) / 64 END clv, o_custkey % 200 token FROM orders"""


@query(f"""WITH b AS ({_LEDGER}), g AS (SELECT grp, count(*) n, count(*) FILTER (WHERE status IN ('open', 'pending')) n_open, count(*) FILTER (WHERE status IN ('won', 'lost')) n_settled, count(*) FILTER (WHERE status = 'won') wins, count(*) FILTER (WHERE status IN ('won', 'lost') AND cost IS NULL) settled_unknown, count(*) FILTER (WHERE status = 'open' AND cost IS NULL) open_unknown,
 coalesce(sum(cost) FILTER (WHERE status IN ('won', 'lost')), 0) w, coalesce(sum(pnl) FILTER (WHERE status IN ('won', 'lost') AND cost IS NOT NULL), 0) r, coalesce(sum(shares * price - cost) FILTER (WHERE status = 'open'), 0) u, coalesce(sum(cost) FILTER (WHERE status = 'open'), 0) o, avg(clv) avg_clv, count(clv) n_clv, avg(CASE WHEN clv > 0 THEN 1.0 WHEN clv IS NOT NULL THEN 0.0 END) positive_clv FROM b GROUP BY 1)
SELECT grp, n, n_open, n_settled, wins, round(wins / n_settled, 6) win_rate, CASE WHEN settled_unknown = 0 THEN w END wagered, CASE WHEN settled_unknown = 0 THEN r END realised, CASE WHEN open_unknown = 0 THEN u END unrealised, CASE WHEN settled_unknown = 0 AND open_unknown = 0 THEN r + u END total, CASE WHEN settled_unknown = 0 THEN round(r / w, 6) END roi, CASE WHEN open_unknown = 0 THEN o END open_invested, settled_unknown, open_unknown, round(avg_clv, 6) avg_clv, n_clv, round(positive_clv, 6) positive_clv FROM g""")
def ledger_summary(spark, d):
    return _shown(G.ledger_summary(run_sql(spark, d, _LEDGER), ["grp"]))


@query(f"""WITH g AS (SELECT token, count(*) n_bets, sum(shares) shares, CASE WHEN bool_and(cost IS NOT NULL) THEN sum(cost) END AS cost, max(price) price FROM ({_LEDGER}) b GROUP BY 1)
SELECT token, n_bets, shares, cost, price, round(cost / shares, 6) avg_price, shares * price AS value, shares * price - cost profit, round((shares * price - cost) / cost, 6) profit_share FROM g""")
def token_positions(spark, d):
    return _shown(G.positions(run_sql(spark, d, _LEDGER), "token"))


_PATHS = "SELECT user_id % 10 grp, CAST(user_id % 5 + 1 AS DOUBLE) shares, CAST(event_id % 4 AS DOUBLE) / 4 AS cost, CASE WHEN event_id % 3 > 0 THEN CAST(event_id % 8 AS DOUBLE) / 8 END exit_price, CAST(event_id % 2 AS DOUBLE) payout FROM events"


@query(f"""WITH x AS (SELECT *, payout * shares - cost held, CASE WHEN exit_price IS NOT NULL THEN exit_price * shares - cost ELSE payout * shares - cost END sold FROM ({_PATHS}) p)
SELECT grp, count(*) n, count(exit_price) n_exits, sum(sold) exit_pnl, sum(held) hold_pnl, sum(sold - held) gain, round(avg(CASE WHEN sold > held THEN 1.0 ELSE 0.0 END), 6) better_share FROM x GROUP BY 1""")
def hold_or_exit(spark, d):
    return _shown(G.hold_or_exit(run_sql(spark, d, _PATHS), ["grp"]))


@query(f"""WITH {BETS}, g AS (SELECT strategy, year(event_date)::INTEGER AS "year", count(*) n, avg(edge) claimed, sum(pnl) / sum(stake) realised, stddev_samp(pnl / stake) sd FROM bets GROUP BY 1, 2), z AS (SELECT *, realised - claimed gap, CASE WHEN n >= 30 AND sd > 0 THEN (realised - claimed) / (sd / sqrt(n)) END z FROM g)
SELECT strategy, "year", n, round(claimed, 6) claimed, round(realised, 6) realised, round(gap, 6) gap, round(z, 6) z, CASE WHEN coalesce(z > 3, gap > 0.05) THEN 'suspiciously_high' WHEN coalesce(z < -3, gap < -0.05) THEN 'execution_drag' ELSE 'consistent' END verdict FROM z""")
def edge_check(spark, d):
    return _shown(G.edge_check(bets(spark, d).withColumn("year", F.year("event_date")), ["strategy", "year"]))


_TRADE = f"{BETS}, tb AS (SELECT *, CASE WHEN bet_id % 3 = 0 THEN 'C' ELSE 'S' END trader, 1 / odds market, 1 / odds + edge prob FROM bets)"


def _traded(spark, d):
    return bets(spark, d).withColumns({"trader": F.when(F.col("bet_id") % 3 == 0, "C").otherwise("S"), "market": 1 / F.col("odds"), "prob": 1 / F.col("odds") + F.col("edge")})


@query(f"""WITH {_TRADE}, a AS (SELECT count(*) n, sum(stake) staked, sum(stake) FILTER (WHERE trader = 'C') t, count(*) FILTER (WHERE trader = 'C') trader_bets FROM tb WHERE edge > 0.02), b AS (SELECT count(*) base_n, sum(stake) base_staked FROM tb WHERE edge <= 0.04)
SELECT n, round(staked, 4) staked, trader_bets, base_n, round(base_staked, 4) base_staked, round(n / base_n, 6) ratio, round(t / staked, 6) trader_share, n / base_n > 1.5 excess_bets, t / staked > 0.4 overexposed FROM a, b""")
def volume_check(spark, d):
    t = _traded(spark, d)
    out = G.volume_check(t.where("edge > 0.02"), t.where("edge <= 0.04"))
    return out.withColumns({"staked": F.round("staked", 4), "base_staked": F.round("base_staked", 4), "ratio": r6("ratio"), "trader_share": r6("trader_share")})


@query(f"""WITH {_TRADE}, a AS (SELECT count(*) FILTER (WHERE trader = 'C') n, avg(CASE WHEN market < 0.4 THEN 1.0 ELSE 0.0 END) FILTER (WHERE trader = 'C') u, count(*) FILTER (WHERE trader = 'C' AND odds > 3 AND prob < 0.7) n_marginal, avg(won) FILTER (WHERE trader = 'C') w, avg(won) FILTER (WHERE trader = 'S') o FROM tb)
SELECT n, round(u, 6) underdog_share, n_marginal, round(w, 6) win_rate, round(o, 6) other_rate, n_marginal > 0 marginal, w < o - 0.1 low_win_rate, u > 0.5 underdog_heavy FROM a""")
def trader_audit(spark, d):
    return _shown(G.trader_audit(_traded(spark, d)))


_SAVED = "SELECT o_orderkey k, o_orderdate + (o_orderkey % 20) * INTERVAL 1 HOUR made_at, CASE WHEN o_orderkey % 7 > 0 THEN 'c1' END contract, CAST(o_custkey % 64 AS DOUBLE) / 64 a_market FROM orders WHERE o_orderkey % 9 > 0"
_ASKED = "SELECT o_orderkey k, o_orderdate + INTERVAL 20 HOUR asked_at, 'c1' contract, CAST((o_custkey + o_orderkey % 4) % 64 AS DOUBLE) / 64 a_market FROM orders"


@query(f"""WITH s AS ({_SAVED}), n AS ({_ASKED}), x AS (SELECT n.k, CASE WHEN s.k IS NULL THEN 'missing' WHEN s.contract IS DISTINCT FROM n.contract THEN 'contract' WHEN date_diff('microsecond', made_at, asked_at) / 3.6e9 > 12 THEN 'age' WHEN abs(n.a_market - s.a_market) > 0.03 THEN 'odds' END reason FROM n LEFT JOIN s ON s.k = n.k) SELECT k, reason IS NOT NULL stale, reason FROM x""")
def stale_predictions(spark, d):
    return G.stale_predictions(run_sql(spark, d, _SAVED), run_sql(spark, d, _ASKED), "k")


_PRICES = "SELECT user_id token, ts at_time, 0.2 + value / 1000 price FROM events"
_FILLED = "SELECT event_id bet_id, user_id token, ts + (event_id % 30) * INTERVAL 1 MINUTE starts_at, CAST(0.25 AS DOUBLE) fill FROM events WHERE event_type = 'purchase' OR event_id % 3 = 0"


@query(f"""WITH p AS (SELECT user_id token, ts t, CAST(0.2 + value / 1000 AS DOUBLE) price FROM events), b AS ({_FILLED}), x AS (SELECT b.bet_id, b.fill, b.starts_at, p.t, p.price FROM b ASOF LEFT JOIN p ON b.token = p.token AND b.starts_at >= p.t)
SELECT bet_id, round(CASE WHEN date_diff('microsecond', t, starts_at) <= 6e8 THEN price END, 6) closing, round(CASE WHEN date_diff('microsecond', t, starts_at) <= 6e8 THEN price / fill - 1 END, 6) clv FROM x""")
def closing_capture(spark, d):
    """Prices of the last ten minutes before each start, on a time line."""
    p = run_sql(spark, d, _PRICES).withColumnRenamed("at_time", "at").withColumn("price", F.col("price").cast("double"))
    b = run_sql(spark, d, _FILLED)
    return _shown(G.closing_capture(b, p, "token"))


@query(f"""WITH {BETS}, p AS (SELECT strategy, year(event_date)::INTEGER AS "year", count(*) n, sum(pnl) / sum(stake) roi FROM bets GROUP BY 1, 2) SELECT strategy, "year", n, round(roi, 6) roi, coalesce(abs(roi - avg(roi) OVER w) > 1.5 * stddev_samp(roi) OVER w, false) outlier FROM p WINDOW w AS (PARTITION BY strategy)""")
def outlier_years(spark, d):
    return _shown(E.outlier_years(bets(spark, d), ["strategy"]))


@query(f"""WITH {BETS}, b AS (SELECT strategy, bet_id, event_date, 1000 + sum(pnl) OVER (PARTITION BY strategy ORDER BY event_date, bet_id) bank FROM bets), u AS (SELECT *, bank < greatest(1000, max(bank) OVER (PARTITION BY strategy ORDER BY event_date, bet_id)) under FROM b),
g AS (SELECT *, sum((NOT under)::INT) OVER (PARTITION BY strategy ORDER BY event_date, bet_id) g FROM u), r AS (SELECT strategy, g, count(*) n FROM g WHERE under GROUP BY 1, 2) SELECT s.strategy, coalesce(max(n), 0) longest FROM (SELECT DISTINCT strategy FROM bets) s LEFT JOIN r ON r.strategy = s.strategy GROUP BY 1""")
def drawdown_length(spark, d):
    return E.drawdown_length(bets(spark, d), ["strategy"], ["event_date", "bet_id"])


def _model_sql(name: str, col: str) -> str:
    return f"""SELECT slice, '{name}' model, n, brier, log_loss, accuracy, ece, auc FROM (SELECT slice, count(*) n, avg(pow({col} - target, 2)) brier, avg(-(target * ln({col}) + (1 - target) * ln(1 - {col}))) log_loss, avg((({col} >= 0.5)::INT = target)::INT) accuracy FROM predictions WHERE {col} IS NOT NULL GROUP BY 1) a
 JOIN (SELECT slice, sum(n * abs(mp - rt)) / sum(n) ece FROM (SELECT slice, least(floor(round({col} * 10, 9)), 9) b, count(*) n, avg({col}) mp, avg(target) rt FROM predictions WHERE {col} IS NOT NULL GROUP BY 1, 2) x GROUP BY 1) e USING (slice)
 JOIN (SELECT slice, sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)) auc FROM (SELECT *, coalesce(sum(neg) OVER (PARTITION BY slice ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) below FROM (SELECT slice, {col} p, sum(target) pos, sum(1 - target) neg FROM predictions WHERE {col} IS NOT NULL GROUP BY 1, 2) y) z GROUP BY 1) u USING (slice)"""


@query(f"WITH {PREDICTIONS}, m AS ({_model_sql('model', 'prob_a')} UNION ALL {_model_sql('market', 'market_a')} UNION ALL {_model_sql('second', 'second_a')}) SELECT slice, model, n, round(brier, 6) brier, round(log_loss, 6) log_loss, round(accuracy, 6) accuracy, round(ece, 6) ece, round(auc, 6) auc FROM m")
def model_baselines(spark, d):
    """Model, market and second model side by side."""
    return _shown(E.with_baselines(predictions(spark, d), ["slice"], {"model": "prob_a", "market": "market_a", "second": "second_a"}))


@query(f"""WITH {PREDICTIONS}, s AS (SELECT *, 'all' s FROM predictions UNION ALL SELECT *, 'fresh' FROM predictions WHERE event_date >= DATE '1998-01-01' UNION ALL SELECT *, 'favourite' FROM predictions WHERE market_a > 0.5 UNION ALL SELECT *, 'underdog' FROM predictions WHERE market_a < 0.5 UNION ALL SELECT *, 'band' FROM predictions WHERE prob_a BETWEEN 0.4 AND 0.65)
SELECT s AS slice, count(*) n, round(avg(pow(prob_a - target, 2)), 6) brier, round(avg(((prob_a >= 0.5)::INT = target)::INT), 6) accuracy FROM s GROUP BY 1""")
def prediction_slices(spark, d):
    p, c = predictions(spark, d), F.col
    s = E.sliced(p.drop("slice"), {"all": F.lit(True), "fresh": c("event_date") >= F.lit("1998-01-01").cast("date"), "favourite": c("market_a") > 0.5, "underdog": c("market_a") < 0.5, "band": c("prob_a").between(0.4, 0.65)})
    return _shown(E.losses(s, ["slice"]).select("slice", "n", "brier", "accuracy"))


@query()
def bootstrap_intervals(spark, d):
    """Poisson bootstrap of model metrics: no SQL; tested against the exact variance."""
    return _shown(E.metric_intervals(E.bootstrap_metrics(predictions(spark, d), "bout_id", probs=("prob_a", "market_a"), rounds=500)))


@query()
def bootstrap_comparison(spark, d):
    """Paired bootstrap of two models' metrics: no SQL; tested against the exact variance."""
    return _shown(E.metric_comparison(E.bootstrap_metrics(predictions(spark, d), "bout_id", probs=("prob_a", "market_a"), rounds=500), "market_a", "prob_a"))


@query(f"""WITH {PREDICTIONS}, g AS (SELECT event_id, row_number() OVER (ORDER BY min(event_date), event_id) - 1 i FROM predictions GROUP BY 1), t AS (SELECT count(*) n, count(*) // 6 sz FROM g), f AS (SELECT k + 1 fold, n - (5 - k) * sz b, sz FROM t, (SELECT unnest(range(0, 5)) k) z),
x AS (SELECT fold, CASE WHEN i < b THEN 'train' ELSE 'test' END part, event_id FROM f JOIN g ON i < b + sz) SELECT fold::INTEGER fold, part, count(*) n, sum(event_id)::BIGINT ids FROM x GROUP BY 1, 2""")
def time_series_folds(spark, d):
    out = L.time_series_folds(predictions(spark, d), "event_id", "event_date")
    return out.groupBy("fold", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query()
def noised_odds(spark, d):
    """Hash-drawn noise on prices, independent and antithetic: no SQL; tested for its moments."""
    p = predictions(spark, d).select("bout_id", "market_a", "market_b")
    one = L.odds_noise(p, ["market_a", "market_b"], "bout_id").withColumn("kind", F.lit("independent"))
    two = L.antithetic_noise(p, "market_a", "market_b", "bout_id").withColumn("kind", F.lit("antithetic"))
    return _shown(one.unionByName(two))


@query()
def boosted_walk_forward(spark, d):
    """Boosted trees against logistic regression over time-series folds: no SQL; tested to beat a coin."""
    p = predictions(spark, d).select("event_id", "bout_id", "event_date", F.col("target").cast("double").alias("target"), "prob_a", "market_a", F.col("fights_a").cast("double").alias("fights_a"), "price")
    p = p.withColumn("prob_a", F.when(F.col("bout_id") % 9 > 0, F.col("prob_a")))
    features, out = ["prob_a", "market_a", "fights_a", "price"], None
    dealt = L.with_series(p, "event_id", "event_date", [*features, "target"], 2)
    for k in (1, 2):
        train, test = L.rows_of(dealt, k, "train"), L.rows_of(dealt, k, "test").na.fill(0.5)
        binned = L.bins(train, features)
        a, b = (L.cells(x, binned, features, ["target"]) for x in (train, test))
        boosted = L.after_rounds(L.trees(a, features), b, features, [20]).withColumnRenamed("prob_20", "prob")
        logistic = L.predicted(L.logistic(train.na.fill(0.5), features), test, ["target"])
        for name, scored, weight in (("boosted", boosted, "weight"), ("logistic", logistic, None)):
            s = E.losses(scored, [], "target", "prob", weight).withColumns({"fold": F.lit(k), "model": F.lit(name)})
            out = s if out is None else out.unionByName(s)
    return _shown(out.select("fold", "model", "n", "brier", "log_loss", "accuracy"))
