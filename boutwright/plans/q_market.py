"""Queries of quotes, prices and line movement."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import market as M
from .fixtures import BETS, BOUTS, QUOTES, bets, bouts, quotes, r6, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df, *names):
    """Doubles of ``names`` to six places."""
    return df.select(*[r6(c).alias(c) if c in names else c for c in df.columns])


@query("""WITH x AS (SELECT l_orderkey k, l_linenumber n, 1.05 + 20 * l_discount a, 1.05 + 20 * l_tax b, CAST(l_quantity * 10 - 260 AS DOUBLE) am FROM lineitem)
SELECT k, n, round(CASE WHEN am > 0 THEN 100 / (am + 100) WHEN am < 0 THEN -am / (-am + 100) END, 6) american, round(CASE WHEN a >= 2 THEN (a - 1) * 100 WHEN a > 1 THEN -100 / (a - 1) END, 6) to_american,
 round((1 / a) / (1 / a + 1 / b), 6) fair_a, round(1 / a + 1 / b - 1, 6) vig, round(0.5 * (a - 1) - 0.5, 6) ev FROM x""")
def odds_scalars(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), (1.05 + 20 * F.col("l_discount")).alias("a"), (1.05 + 20 * F.col("l_tax")).alias("b"), (F.col("l_quantity") * 10 - 260).alias("am"))
    pa, pb = S.decimal_to_prob(F.col("a")), S.decimal_to_prob(F.col("b"))
    return x.select("k", "n", r6(S.american_to_prob(F.col("am"))).alias("american"), r6(S.decimal_to_american(F.col("a"))).alias("to_american"), r6(S.no_vig(pa, pb)).alias("fair_a"), r6(pa + pb - 1).alias("vig"), r6(S.expected_value(F.lit(0.5), F.col("a"))).alias("ev"))


@query(f"WITH {QUOTES} SELECT market, round(avg(a_prob), 6) a_avg, round(avg(b_prob), 6) b_avg, count(*) num_quotes, arg_min(bookmaker, quote_id) first_book, round(avg(a_prob) / (avg(a_prob) + avg(b_prob)), 6) a_fair FROM quotes GROUP BY 1")
def consensus(spark, d):
    return rounded(M.consensus(quotes(spark, d), "market"), "a_avg", "b_avg", "a_fair")


@query(f"""WITH {QUOTES} SELECT market, round(arg_max(a_prob, (offset_days, quote_id)), 6) open_prob, round(arg_min(a_prob, (offset_days, quote_id)), 6) close_prob,
 round(arg_min(a_prob, (offset_days, quote_id)) FILTER (WHERE offset_days >= 7), 6) entry_prob, CAST(min(offset_days) FILTER (WHERE offset_days >= 7) AS INTEGER) entry_offset FROM quotes GROUP BY 1""")
def opening_closing(spark, d):
    return rounded(M.opening_closing(quotes(spark, d), "market", 7), "open_prob", "close_prob", "entry_prob")


@query(f"""WITH {QUOTES}, s AS (SELECT *, a_prob - lag(a_prob) OVER (PARTITION BY market ORDER BY snapshot_time, quote_id) dd, row_number() OVER (PARTITION BY market ORDER BY snapshot_time, quote_id) i FROM quotes),
g AS (SELECT market, count(*) n_points, arg_min(a_prob, i) o, arg_max(a_prob, i) c, max(abs(dd)) m, count(dd) >= 2 AND (coalesce(bool_and(dd > 0.005), false) OR coalesce(bool_and(dd < -0.005), false)) st FROM s GROUP BY 1)
SELECT market, n_points, CASE WHEN n_points >= 2 THEN round(o, 6) END open_prob, CASE WHEN n_points >= 2 THEN round(c, 6) END current_prob, CASE WHEN n_points >= 2 THEN round(c - o, 6) END movement, CASE WHEN n_points >= 2 THEN round(m, 6) END max_step,
 CASE WHEN n_points >= 2 THEN st END steam, CASE WHEN n_points >= 2 THEN abs(c - o) > 0.05 END sharp, CASE WHEN n_points >= 2 THEN CASE WHEN c - o > 0.02 THEN 'toward_a' WHEN c - o < -0.02 THEN 'toward_b' ELSE 'stable' END END direction FROM g""")
def line_movement(spark, d):
    return rounded(M.line_movement(quotes(spark, d), "market", ["snapshot_time", "quote_id"]), "open_prob", "current_prob", "movement", "max_step")


@query(f"""WITH {QUOTES}, p AS (SELECT *, CASE WHEN offset_days >= 20 THEN 'opening' WHEN offset_days >= 10 THEN 'middle' ELSE 'end' END ph FROM quotes)
SELECT market, min(snapshot_time) FILTER (WHERE ph = 'opening') opening_time, count(DISTINCT bookmaker) FILTER (WHERE ph = 'opening') opening_books, round(avg(a_prob) FILTER (WHERE ph = 'opening'), 6) opening_prob,
 min(snapshot_time) FILTER (WHERE ph = 'end') end_time, count(DISTINCT bookmaker) FILTER (WHERE ph = 'end') end_books, round(avg(a_prob) FILTER (WHERE ph = 'end'), 6) end_prob FROM p GROUP BY 1""")
def phase_snapshots(spark, d):
    phase = F.when(F.col("offset_days") >= 20, "opening").when(F.col("offset_days") >= 10, "middle").otherwise("end")
    return rounded(M.phase_snapshots(quotes(spark, d), "market", phase, ["opening", "end"]), "opening_prob", "end_prob")


@query(f"WITH {QUOTES} SELECT market, count(DISTINCT snapshot_time) times, count(*) \"rows\", count(DISTINCT snapshot_time) >= 2 healthy FROM quotes GROUP BY 1")
def history_health(spark, d):
    return M.history_health(quotes(spark, d), "market")


@query("""WITH l AS (SELECT user_id k, CAST(ts AS DATE) \"day\", count(*) n FROM events GROUP BY 1, 2),
r0 AS (SELECT user_id k, CAST(ts AS DATE) \"day\", avg(value) v, max(CASE WHEN event_type = 'click' THEN value END) c FROM events WHERE event_type IN ('click', 'view') GROUP BY 1, 2),
r AS (SELECT *, 0 pri FROM r0 UNION ALL SELECT k, \"day\" - 1, v, c, 1 FROM r0),
b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY k, \"day\" ORDER BY CASE WHEN v IS NULL THEN 0 ELSE 1 END + CASE WHEN c IS NULL THEN 0 ELSE 1 END DESC, pri) = 1)
SELECT l.k, l.\"day\", n, round(v, 6) v, round(c, 6) c, b.pri shifted FROM l LEFT JOIN b ON l.k = b.k AND l.\"day\" = b.\"day\"""")
def prev_day_fallback(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("k"), F.to_date("ts").alias("day"), "event_type", "value", "event_id")
    left = e.groupBy("k", "day").agg(F.count(F.lit(1)).alias("n"))
    right = e.where("event_type in ('click', 'view')").groupBy("k", "day").agg(F.avg("value").alias("v"), F.max(F.when(F.col("event_type") == "click", F.col("value"))).alias("c"))
    return rounded(M.with_previous_day(left, right, "k", "day", ["v", "c"]), "v", "c")


@query(f"""WITH {BOUTS}, o AS (SELECT event_date, CASE WHEN fight_id % 2 = 0 THEN b_id ELSE a_id END a_id, CASE WHEN fight_id % 2 = 0 THEN a_id ELSE b_id END b_id,
  1.05 + 20 * CASE WHEN fight_id % 2 = 0 THEN b_d ELSE a_d END a_price, 1.05 + 20 * CASE WHEN fight_id % 2 = 0 THEN a_d ELSE b_d END b_price, fight_id % 30 offset_days, fight_id oid FROM bouts WHERE status <> 'P'),
p AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY event_date, least(a_id, b_id), greatest(a_id, b_id) ORDER BY offset_days DESC, oid) = 1)
SELECT b.fight_id, round(CASE WHEN p.a_id = b.a_id THEN p.a_price ELSE p.b_price END, 6) a_price, round(CASE WHEN p.a_id = b.a_id THEN p.b_price ELSE p.a_price END, 6) b_price
FROM bouts b LEFT JOIN p ON p.event_date = b.event_date AND least(p.a_id, p.b_id) = least(b.a_id, b.b_id) AND greatest(p.a_id, p.b_id) = greatest(b.a_id, b.b_id)""")
def moneyline_overlay(spark, d):
    b = bouts(spark, d)
    swap = F.col("fight_id") % 2 == 0
    flip = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    odds = b.where("status <> 'P'").select("event_date", flip("a_id", "b_id").alias("a_id"), flip("b_id", "a_id").alias("b_id"), (1.05 + 20 * flip("a_d", "b_d")).alias("a_price"), (1.05 + 20 * flip("b_d", "a_d")).alias("b_price"), (F.col("fight_id") % 30).alias("offset_days"), F.col("fight_id").alias("oid"))
    out = M.overlay_reoriented(b.select("fight_id", "event_date", "a_id", "b_id"), odds, [F.desc("offset_days"), F.asc("oid")])
    return rounded(out.select("fight_id", "a_price", "b_price"), "a_price", "b_price")


_LAYERS = {"entry": (3, 4), "opening": (5, 2), "requested": (7, 3), "closing": (2, 5)}


@query("WITH x AS (SELECT event_id, " + ", ".join(f"CASE WHEN event_id % {m} = 0 THEN value + {i} END {n}_a, CASE WHEN event_id % {k} = 0 THEN value - {i} END {n}_b" for i, (n, (m, k)) in enumerate(_LAYERS.items())) + """ FROM events)
SELECT event_id, round(CASE WHEN entry_a IS NOT NULL AND entry_b IS NOT NULL THEN entry_a WHEN opening_a IS NOT NULL THEN opening_a WHEN requested_a IS NOT NULL THEN requested_a WHEN closing_a IS NOT NULL THEN closing_a END, 6) a_market,
 round(CASE WHEN entry_a IS NOT NULL AND entry_b IS NOT NULL THEN entry_b WHEN opening_a IS NOT NULL THEN opening_b WHEN requested_a IS NOT NULL THEN requested_b WHEN closing_a IS NOT NULL THEN closing_b END, 6) b_market,
 CASE WHEN entry_a IS NOT NULL AND entry_b IS NOT NULL THEN 'entry' WHEN opening_a IS NOT NULL THEN 'opening' WHEN requested_a IS NOT NULL THEN 'requested' WHEN closing_a IS NOT NULL THEN 'closing' END odds_source FROM x""")
def layered_price(spark, d):
    e, k = table(spark, d, "events"), F.col("event_id")
    cols = [F.when(k % m == 0, F.col("value") + s * i).alias(f"{n}_{side}") for i, (n, ms) in enumerate(_LAYERS.items()) for side, m, s in (("a", ms[0], 1), ("b", ms[1], -1))]
    return rounded(M.layered_price(e.select("event_id", *cols)).select("event_id", "a_market", "b_market", "odds_source"), "a_market", "b_market")


@query("""WITH x AS (SELECT vec_id, [abs(v) + 0.01 for v in embedding[1:32]] b, [abs(v) + 0.02 for v in embedding[33:64]] a FROM embeddings)
SELECT vec_id, round(list_max(b), 5) best_bid, round(list_min(a), 5) best_ask, round(list_min(a) - list_max(b), 5) spread, round(list_sum([v * v for v in b]), 4) bid_notional, round(list_sum([v * v for v in a]), 4) ask_notional, CAST(len(a) + len(b) AS INTEGER) n_levels FROM x""")
def order_book(spark, d):
    level = lambda add: lambda x: F.struct((F.abs(x.cast("double")) + add).alias("price"), (F.abs(x.cast("double")) + add).alias("size"))
    e = table(spark, d, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 32), level(0.01)).alias("bids"), F.transform(F.slice("embedding", 33, 32), level(0.02)).alias("asks"))
    out = M.book_summary(e, "bids", "asks")
    return out.select("vec_id", *[F.round(c, 5).alias(c) for c in ("best_bid", "best_ask", "spread")], *[F.round(c, 4).alias(c) for c in ("bid_notional", "ask_notional")], "n_levels")


@query(f"""WITH {BETS}, t AS (SELECT user_id bet_id, count(DISTINCT ts) times FROM events GROUP BY 1),
v AS (SELECT CASE WHEN close_prob <= 0 THEN 0 ELSE (1 / fill_prob) / (1 / close_prob) - 1 END v FROM bets SEMI JOIN (SELECT * FROM t WHERE times >= 2) t2 ON bets.bet_id = t2.bet_id)
SELECT count(*) n, round(avg(v), 6) mean_clv, round(median(v), 6) median_clv, round(avg(CASE WHEN v > 0 THEN 1.0 ELSE 0.0 END), 6) positive_share, count(*) >= 80 sufficient FROM v""")
def fair_clv(spark, d):
    times = table(spark, d, "events").groupBy(F.col("user_id").alias("bet_id")).agg(F.count_distinct("ts").alias("times"))
    return rounded(M.fair_clv(bets(spark, d), times, "bet_id"), "mean_clv", "median_clv", "positive_share")


@query("""SELECT event_type, CAST(to_timestamp(floor(epoch(ts) / 300) * 300) AT TIME ZONE 'UTC' AS TIMESTAMP) window_start, count(*) n, arg_min(value, (ts, event_id)) open_price, arg_max(value, (ts, event_id)) close_price FROM events GROUP BY 1, 2""")
def five_minute_windows(spark, d):
    e = table(spark, d, "events").withColumn("window_start", S.window_start(F.col("ts")).cast("timestamp_ntz"))
    at = F.struct("ts", "event_id")
    return e.groupBy("event_type", "window_start").agg(F.count(F.lit(1)).alias("n"), F.min_by("value", at).alias("open_price"), F.max_by("value", at).alias("close_price"))


@query("""WITH h AS (SELECT event_id, epoch(TIMESTAMP '2024-01-31 00:00:00' - ts) / 3600 hrs FROM events)
SELECT CASE WHEN hrs > 48 THEN 'not_open' WHEN hrs <= 1 THEN 'closed' ELSE 'open' END status, count(*) n FROM h GROUP BY 1""")
def entry_window(spark, d):
    s = S.entry_window(F.lit("2024-01-31 00:00:00"), F.col("ts"))
    return table(spark, d, "events").groupBy(s.alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH e AS (SELECT user_id, CAST(ts AS DATE) \"day\", event_type, avg(value) v FROM events GROUP BY 1, 2, 3)
SELECT user_id, \"day\", round(avg(v) FILTER (WHERE event_type = 'click'), 6) click, round(avg(v) FILTER (WHERE event_type = 'view'), 6) \"view\", round(avg(v) FILTER (WHERE event_type = 'purchase'), 6) purchase FROM e GROUP BY 1, 2""")
def phase_pivot(spark, d):
    e = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day"), "event_type").agg(F.avg("value").alias("v"))
    out = e.groupBy("user_id", "day").pivot("event_type", ["click", "view", "purchase"]).agg(F.avg("v"))
    return rounded(out, "click", "view", "purchase")


@query("""SELECT market, times, quotes_n, round(min_p, 6) min_p, round(max_p, 6) max_p, round(max_p - min_p, 6) span, CASE WHEN max_p - min_p > 0.3 THEN 'large_move' WHEN min_p < 0.02 THEN 'price_floor' ELSE 'none' END alert
FROM (SELECT user_id market, count(DISTINCT ts) times, count(*) quotes_n, min(1 / (1 + value)) min_p, max(1 / (1 + value)) max_p FROM events GROUP BY 1)""")
def price_alerts(spark, d):
    q = quotes(spark, d).groupBy("market").agg(F.count_distinct("snapshot_time").alias("times"), F.count(F.lit(1)).alias("quotes_n"), F.min("a_prob").alias("min_p"), F.max("a_prob").alias("max_p"))
    span = F.col("max_p") - F.col("min_p")
    out = q.withColumn("span", span).withColumn("alert", F.when(span > 0.3, "large_move").when(F.col("min_p") < 0.02, "price_floor").otherwise("none"))
    return rounded(out, "min_p", "max_p", "span")
