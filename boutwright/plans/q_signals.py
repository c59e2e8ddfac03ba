"""Signals of three strategies over the same market windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import signals as S
from .fixtures import run_sql

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Books in 64ths, so that sums and comparisons are exact.
_M = "SELECT event_id k, ts asked, ts + INTERVAL 5 MINUTE - INTERVAL 1 SECOND * CAST(event_id % 320 AS INT) window_end, event_id % 41 > 0 active, event_id % 43 = 0 closed, event_id % 47 > 0 accepting, CAST(event_id % 97 - 48 AS DOUBLE) move, CASE WHEN event_id % 5 > 0 THEN CAST(event_id % 61 AS DOUBLE) / 64 END price_up, CAST(event_id % 59 AS DOUBLE) / 64 price_down, CASE WHEN event_id % 7 > 0 THEN CAST(event_id % 53 AS DOUBLE) / 64 END up_bid, CASE WHEN event_id % 11 > 0 THEN CAST(event_id % 53 + event_id % 4 AS DOUBLE) / 64 END up_ask, CAST(event_id % 31 AS DOUBLE) * 2 up_top, CAST(event_id % 29 AS DOUBLE) * 8 up_total, CASE WHEN event_id % 8 > 0 THEN CAST(event_id % 37 AS DOUBLE) / 64 END down_bid, CASE WHEN event_id % 13 > 0 THEN CAST(event_id % 37 + event_id % 5 AS DOUBLE) / 64 END down_ask, CAST(event_id % 23 AS DOUBLE) * 3 down_top, CAST(event_id % 19 AS DOUBLE) * 10 down_total FROM events".replace("INTERVAL 1 SECOND * CAST(event_id % 320 AS INT)", "CAST(event_id % 320 AS INT) * INTERVAL 1 SECOND")
_PROFILES = {
    "momentum": S.Profile(entry_seconds=150, entry_tolerance=120, weekdays_only=True, start_hour=2, end_hour=22, max_spread=2 / 64),
    "cheap_side": S.Profile(style="cheap_side", maker=True, entry_seconds=150, entry_tolerance=140, min_price=0.0625, max_price=0.5, max_spread=3 / 64, max_spread_share=0.25),
    "probability_capture": S.Profile(style="probability_capture", entry_seconds=150, entry_tolerance=140, max_price=0.75, max_gap=1 / 64, max_spread=3 / 64),
}
_BEFORE = "WHEN l <= 0 THEN 'market_closed' WHEN NOT active OR closed OR NOT accepting THEN 'market_not_tradeable'"


def _side(s: str) -> str:
    return f"{{'d': '{s}', 'b': {s}_bid, 'a': {s}_ask, 's': coalesce(({s}_bid + {s}_ask) / 2, price_{s}), 'w': {s}_ask - {s}_bid, 't': {s}_top, 'n': {s}_total}}"


def _thin(spread: str) -> str:
    return f"WHEN x.w IS NULL THEN 'missing_spread' WHEN x.w > {spread} THEN 'spread_too_wide'"


_END = "WHEN x.t < 10 THEN 'thin_top_ask' WHEN x.n < 50 THEN 'thin_book' ELSE 'trade' END"


@query(f"""WITH m AS (SELECT *, epoch(window_end) - epoch(asked) l FROM ({_M}) z), u AS (SELECT *, {_side('up')} u, {_side('down')} d FROM m),
a AS (SELECT *, CASE WHEN move > 0 THEN u ELSE d END x FROM u), b AS (SELECT *, CASE WHEN coalesce(u.a > 0, false) AND (NOT coalesce(d.a > 0, false) OR u.a <= d.a) THEN u WHEN d.a > 0 THEN d END x FROM u), c AS (SELECT *, CASE WHEN u.a IS NOT NULL AND u.s IS NOT NULL AND (d.a IS NULL OR d.s IS NULL OR u.s >= d.s) THEN u WHEN d.a IS NOT NULL AND d.s IS NOT NULL THEN d END x FROM u),
r AS (SELECT 'momentum' style, k, x.d direction, CASE {_BEFORE} WHEN abs(l - 150) > 120 THEN 'outside_entry_window' WHEN isodow(asked) > 5 OR hour(asked) < 2 OR hour(asked) >= 22 THEN 'outside_trading_hours' WHEN abs(move) < 20 THEN 'insufficient_impulse' WHEN x.s IS NULL THEN 'missing_market_price' WHEN x.s < 0.55 THEN 'skew_not_supportive' WHEN x.a IS NULL THEN 'no_ask' WHEN x.a <= 0 THEN 'invalid_entry_price' WHEN x.a < 0.05 THEN 'entry_price_too_low' WHEN x.a > 0.95 THEN 'entry_price_too_high' {_thin('0.03125')} {_END} reason FROM a
UNION ALL SELECT 'cheap_side', k, x.d, CASE {_BEFORE} WHEN abs(l - 150) > 140 THEN 'outside_entry_window' WHEN x.d IS NULL THEN 'no_ask' WHEN x.b IS NULL THEN 'no_entry_price' WHEN x.b <= 0 THEN 'invalid_entry_price' WHEN x.b < 0.0625 OR x.b > 0.5 THEN 'cheap_side_out_of_range' {_thin('0.046875')} WHEN x.w > x.b * 0.25 THEN 'relative_spread_too_wide' {_END} FROM b
UNION ALL SELECT 'probability_capture', k, x.d, CASE {_BEFORE} WHEN abs(l - 150) > 140 THEN 'outside_entry_window' WHEN x.s IS NULL THEN 'missing_market_price' WHEN x.s < 0.55 THEN 'skew_not_supportive' WHEN x.a <= 0 THEN 'invalid_entry_price' WHEN x.a < 0.05 THEN 'entry_price_too_low' WHEN x.a > 0.75 THEN 'entry_price_too_high' WHEN x.a - x.s > 0.015625 THEN 'entry_support_gap_too_wide' {_thin('0.046875')} {_END} FROM c)
SELECT style, direction, reason, count(*) n, sum(k)::BIGINT ks FROM r GROUP BY 1, 2, 3""")
def market_signals(spark, d):
    m, out = run_sql(spark, d, _M).withColumnRenamed("asked", "at"), None
    for style, p in _PROFILES.items():
        part = S.signals(m, p).select(F.lit(style).alias("style"), "direction", "reason", "k")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("style", "direction", "reason").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("ks"))
