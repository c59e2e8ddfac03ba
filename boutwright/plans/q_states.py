"""Queries of states at other times, overlays, coverage, alerts and rankings of results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as X
from ..operators import history as H
from ..operators import states as T
from .fixtures import BETS, BOUTS, LONG, bets, bouts, predictions, r6, run_sql, table

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


def _long(spark, d):
    return H.long_rows(bouts(spark, d)).withColumn("won", F.when(F.col("result") == "win", 1.0).otherwise(0.0))


_ASKS = "SELECT o_orderkey ask_id, o_custkey % 100 + 1 entity, CAST(o_orderdate AS DATE) as_of FROM orders"


@query(f"""WITH {LONG}, ak AS ({_ASKS}), n AS (SELECT *, CASE WHEN result = 'win' THEN 1.0 ELSE 0.0 END won, row_number() OVER (PARTITION BY entity ORDER BY event_date, fight_id) i FROM long)
SELECT ask_id, ak.entity, as_of, count(fight_id) num_fights, count(*) FILTER (WHERE result = 'win') wins, count(*) FILTER (WHERE result = 'loss') losses, date_diff('day', max(event_date), as_of)::INTEGER days_since, round(sum(won * pow(2, i / 3.0 - 100)) / sum(pow(2, i / 3.0 - 100)), 6) roll_won, round(sum(landed * pow(2, i / 3.0 - 100)) / sum(pow(2, i / 3.0 - 100)), 6) roll_landed
FROM ak LEFT JOIN n ON n.entity = ak.entity AND n.event_date < ak.as_of GROUP BY 1, 2, 3""")
def state_as_of(spark, d):
    """What a participant's row would read at any date."""
    return _shown(T.as_of_state(_long(spark, d), run_sql(spark, d, _ASKS), ("won", "landed")))


@query(f"""WITH {LONG}, n AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY event_date, fight_id) i, CASE WHEN result = 'win' THEN 1.0 ELSE 0.0 END won FROM long), tg AS (SELECT fight_id FROM bouts WHERE event_date >= (SELECT max(event_date) - 30 FROM bouts)),
e AS (SELECT x.fight_id, x.side, sum(y.won * pow(2, (y.i - x.i) / 3.0)) / sum(pow(2, (y.i - x.i) / 3.0)) rate FROM n x LEFT JOIN n y ON x.entity = y.entity AND y.i < x.i GROUP BY 1, 2), w AS (SELECT n.*, e.rate FROM n JOIN e ON n.fight_id = e.fight_id AND n.side = e.side), o AS (SELECT w.*, v.rate orate FROM w JOIN w v ON v.fight_id = w.fight_id AND v.entity = w.opponent),
p AS (SELECT x.fight_id, x.side, x.rate, y.orate, y.i - greatest(x.i - 6, 0) k FROM o x LEFT JOIN o y ON x.entity = y.entity AND y.i < x.i AND y.i >= x.i - 5 WHERE x.fight_id IN (SELECT fight_id FROM tg)) SELECT fight_id, side, round(any_value(rate), 6) roll_won, round(sum(k * orate) / sum(CASE WHEN orate IS NOT NULL THEN k END), 6) opp_strength FROM p GROUP BY 1, 2""")
def incremental_features(spark, d):
    """Features of the last month's bouts from the rows they need; equal to those of a full run."""
    rows = _long(spark, d)
    last = rows.agg(F.date_sub(F.max("event_date"), 30)).first()[0]
    targets = rows.where(F.col("event_date") >= F.lit(last)).select("fight_id").distinct()
    need = X.rolled(T.needed_rows(rows, targets), ("won",))
    out = H.schedule_strength(need, "roll_won").join(targets, "fight_id", "left_semi")
    return _shown(out.select("fight_id", "side", "roll_won", "opp_strength"))


_CW = "OVER (PARTITION BY entity ORDER BY event_date, fight_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query(f"""WITH {LONG}, c AS (SELECT fight_id, entity, row_number() OVER (PARTITION BY entity ORDER BY event_date, fight_id) - 1 num_fights, coalesce(sum((result = 'win')::INT) {_CW}, 0)::BIGINT wins FROM long WHERE fight_id % 3 > 0)
SELECT b.fight_id, coalesce(x.num_fights, b.n_rounds) a_fights, y.num_fights b_fights, x.wins a_wins, y.wins b_wins FROM bouts b LEFT JOIN c x ON x.fight_id = b.fight_id AND x.entity = b.a_id LEFT JOIN c y ON y.fight_id = b.fight_id AND y.entity = b.b_id""")
def tracked_overlay(spark, d):
    """Counters over tracked bouts attached anew; sparse columns filled from history."""
    b = bouts(spark, d)
    counters = T.tracked_counters(H.long_rows(b), F.col("fight_id") % 3 > 0)
    out = T.overlaid_counters(b.select("fight_id", "a_id", "b_id", "n_rounds", F.lit(99).alias("a_wins")), counters, ["num_fights", "wins"])
    out = T.filled(out, {"a_num_fights": "n_rounds"})
    return out.select("fight_id", F.col("a_num_fights").alias("a_fights"), F.col("b_num_fights").alias("b_fights"), "a_wins", "b_wins")


_P = "OVER (PARTITION BY least(a_id, b_id), greatest(a_id, b_id) ORDER BY event_date, fight_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query(f"""WITH {BOUTS}, c AS (SELECT *, CASE WHEN fight_id % 2 = 0 THEN winner END w2 FROM bouts) SELECT fight_id, (count(w2) {_P} > 0)::INT::BIGINT is_rematch, CAST(coalesce(sum(CASE WHEN w2 = least(a_id, b_id) THEN 1 WHEN w2 = greatest(a_id, b_id) THEN -1 ELSE 0 END) {_P}, 0) * CASE WHEN a_id < b_id THEN 1 ELSE -1 END AS BIGINT) h2h_diff FROM c""")
def decisive_meetings(spark, d):
    b = bouts(spark, d).withColumn("winner", F.when(F.col("fight_id") % 2 == 0, F.col("winner")))
    return T.decisive_meetings(b).select("fight_id", "is_rematch", "h2h_diff")


_FEATS = "SELECT l_orderkey * 10 + l_linenumber bout_id, CASE WHEN l_partkey % 4 = 0 THEN l_tax END x, CASE WHEN l_suppkey % 5 = 0 THEN l_tax END y FROM lineitem WHERE l_partkey % 9 > 0"


@query(f"WITH f AS (SELECT bout_id, bool_or(x IS NOT NULL OR y IS NOT NULL) c FROM ({_FEATS}) z GROUP BY 1) SELECT coalesce(c, false) covered, count(*) n, sum(l_orderkey)::BIGINT ids FROM lineitem LEFT JOIN f ON bout_id = l_orderkey * 10 + l_linenumber GROUP BY 1")
def coverage_mask(spark, d):
    out = T.covered(predictions(spark, d), run_sql(spark, d, _FEATS), ["bout_id"], ["x", "y"])
    return out.groupBy("covered").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query("""WITH t AS (SELECT o_orderkey k, o_custkey % 500 ev, o_orderkey % 3 > 0 expected FROM orders), r AS (SELECT DISTINCT l_orderkey k FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01 00:00:00'), g AS (SELECT ev, count(*) n, count(r.k) n_covered FROM t LEFT JOIN r ON r.k = t.k WHERE expected GROUP BY 1)
SELECT *, n - n_covered n_missing, CASE WHEN n_covered = n THEN 'complete' WHEN n_covered > 0 THEN 'partial' ELSE 'unavailable' END status FROM g""")
def coverage_by_event(spark, d):
    t = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 500).alias("ev"), (F.col("o_orderkey") % 3 > 0).alias("expected"))
    r = table(spark, d, "lineitem").where("l_shipdate < TIMESTAMP '1998-01-01 00:00:00'").select(F.col("l_orderkey").alias("k"))
    return T.coverage_by_event(t, r, "k", "ev")


_LINES = "SELECT o_orderkey k, CAST(o_custkey % 41 - 20 AS DOUBLE) / 100 movement, o_orderkey % 5 = 0 steam, CASE WHEN o_custkey % 41 > 22 THEN 'toward_a' WHEN o_custkey % 41 < 18 THEN 'toward_b' ELSE 'stable' END direction, CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_orderkey % 100 AS DOUBLE) / 100 END a_now, CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_custkey % 100 AS DOUBLE) / 100 END b_now, o_orderkey % 7 = 0 started FROM orders"


@query(f"SELECT k, CASE WHEN a_now < 0.05 THEN 'price_floor_a' WHEN b_now < 0.05 THEN 'price_floor_b' WHEN NOT started AND abs(movement) >= 0.15 THEN 'large_move_' || direction WHEN NOT started AND steam THEN 'steam_' || direction END alert FROM ({_LINES}) z")
def market_alerts(spark, d):
    return T.market_alerts(run_sql(spark, d, _LINES)).select("k", "alert")


@query(f"""WITH {BETS}, g AS (SELECT concat(strategy, '-', year(event_date)) profile, CASE WHEN year(event_date) > 1995 THEN count(*) END settled, sum(pnl) profit, sum(pnl) / sum(stake) roi, avg(won) win_rate FROM bets GROUP BY strategy, year(event_date)),
s AS (SELECT concat(strategy, '-', year(event_date)) sweep, avg(edge) > 0.05 flag, round(avg(edge), 2) gap, round(sum(pnl) / sum(stake), 6) roi, CASE WHEN year(event_date) % 2 = 0 THEN round(avg(fill_prob), 6) END clv, round(max(-pnl), 6) drawdown, count(*) n FROM bets GROUP BY strategy, year(event_date))
SELECT profile, 'profile' kind, row_number() OVER (ORDER BY coalesce(settled, 0) > 0 DESC, profit DESC, roi DESC, win_rate DESC, profile)::INTEGER rank FROM g UNION ALL SELECT sweep, 'sweep', row_number() OVER (ORDER BY flag, gap, roi DESC, coalesce(clv, -999) DESC, drawdown, n, sweep)::INTEGER FROM s""")
def leaderboards(spark, d):
    """Profiles and sweep configurations in their orders."""
    b = bets(spark, d).withColumn("profile", F.concat("strategy", F.lit("-"), F.year("event_date")))
    g = b.groupBy("profile", F.year("event_date").alias("y")).agg(F.count(F.lit(1)).alias("settled"), F.sum("pnl").alias("profit"), (F.sum("pnl") / F.sum("stake")).alias("roi"), F.avg("won").alias("win_rate")).withColumn("settled", F.when(F.col("y") > 1995, F.col("settled")))
    s = b.groupBy(F.col("profile").alias("sweep"), F.year("event_date").alias("y")).agg((F.avg("edge") > 0.05).alias("flag"), F.round(F.avg("edge"), 2).alias("gap"), F.round(F.sum("pnl") / F.sum("stake"), 6).alias("roi"), F.round(F.avg("fill_prob"), 6).alias("clv"), F.round(F.max(-F.col("pnl")), 6).alias("drawdown"), F.count(F.lit(1)).alias("n")).withColumn("clv", F.when(F.col("y") % 2 == 0, F.col("clv")))
    return T.ranked_profiles(g).select("profile", F.lit("profile").alias("kind"), "rank").unionByName(T.ranked_sweeps(s).select(F.col("sweep").alias("profile"), F.lit("sweep").alias("kind"), "rank"))


@query(f"""WITH {LONG}, m AS (SELECT entity, result, CASE WHEN fight_id % 997 > 0 THEN lower(method) ELSE '' END AS me FROM long)
SELECT entity, count(*) fights, count(*) FILTER (WHERE result = 'win') wins, count(*) FILTER (WHERE result = 'loss') losses, round(count(*) FILTER (WHERE result = 'win') / count(*), 6) win_pct, CASE WHEN bool_and(result <> 'win' OR me <> '') THEN round(count(*) FILTER (WHERE result = 'win' AND me LIKE '%ko%') / nullif(count(*) FILTER (WHERE result = 'win'), 0), 6) END ko_rate,
 CASE WHEN bool_and(result <> 'win' OR me <> '') THEN round(count(*) FILTER (WHERE result = 'win' AND me LIKE '%sub%') / nullif(count(*) FILTER (WHERE result = 'win'), 0), 6) END sub_rate, CASE WHEN bool_and(result <> 'win' OR me <> '') THEN round(count(*) FILTER (WHERE result = 'win' AND me LIKE '%dec%') / nullif(count(*) FILTER (WHERE result = 'win'), 0), 6) END dec_rate FROM m GROUP BY 1""")
def amateur_summary(spark, d):
    rows = _long(spark, d).withColumn("method", F.when(F.col("fight_id") % 997 > 0, F.col("method")))
    return _shown(T.amateur_summary(rows, "entity"))


_RANKS = "SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) as_of, CASE WHEN s_suppkey % 3 = 0 THEN 'pfp' ELSE o_orderpriority END division, s_suppkey AS name, CAST(1 + (s_suppkey * 7 + month(o_orderdate)) % 15 AS INT) AS rank FROM orders JOIN supplier ON o_custkey % 40 = s_suppkey % 40 WHERE month(o_orderdate) % 2 = 0 AND s_suppkey <= 400"


@query(f"""WITH {BOUTS}, rk AS ({_RANKS}), sn AS (SELECT DISTINCT as_of FROM rk), at_ AS (SELECT DISTINCT event_date, (SELECT max(as_of) FROM sn WHERE as_of <= event_date) snapshot FROM bouts)
SELECT b.fight_id, snapshot, aw.rank a_wc_rank, bw.rank b_wc_rank, ap.rank a_pfp_rank, bp.rank b_pfp_rank FROM bouts b JOIN at_ t ON t.event_date = b.event_date LEFT JOIN rk aw ON aw.as_of = snapshot AND aw.division = weight_class AND aw.name = a_id LEFT JOIN rk bw ON bw.as_of = snapshot AND bw.division = weight_class AND bw.name = b_id
 LEFT JOIN rk ap ON ap.as_of = snapshot AND ap.division = 'pfp' AND ap.name = a_id LEFT JOIN rk bp ON bp.as_of = snapshot AND bp.division = 'pfp' AND bp.name = b_id""")
def rankings_at_bouts(spark, d):
    out = T.rankings_at(bouts(spark, d).select("fight_id", "event_date", "weight_class", "a_id", "b_id"), run_sql(spark, d, _RANKS))
    return out.select("fight_id", "snapshot", "a_wc_rank", "b_wc_rank", "a_pfp_rank", "b_pfp_rank")


_SOURCES = "SELECT l_suppkey entity, CAST(date_trunc('month', l_shipdate) AS DATE) as_of, l_linenumber % 3 precedence, CAST(l_quantity AS INT) % 15 AS rank FROM lineitem"


@query(f"WITH s AS ({_SOURCES}), m AS (SELECT entity, as_of, min(precedence) p FROM s GROUP BY 1, 2) SELECT s.entity, s.as_of, min(rank) AS rank, any_value(p) precedence, count(DISTINCT rank) > 1 conflict FROM s JOIN m ON s.entity = m.entity AND s.as_of = m.as_of AND precedence = p GROUP BY 1, 2")
def source_precedence(spark, d):
    return T.best_source(run_sql(spark, d, _SOURCES), ["entity", "as_of"], "precedence", "rank")
