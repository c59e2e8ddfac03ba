"""Queries of odds summaries: cleaning, snapshots, market features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import summaries as O
from .fixtures import r6, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Summary rows of the events table, as SQL that both engines read.
_ROWS = """SELECT user_id event_id, event_type bookmaker, CASE WHEN event_id % 2 = 0 THEN 'start' ELSE 'end' END market_phase, CASE WHEN event_id % 3 = 0 THEN '162_1' WHEN event_id % 3 = 1 THEN '162_2' ELSE '162_3' END market_key,
 CASE WHEN event_id % 3 < 2 AND event_id % 11 <> 0 THEN 0.9 + value / 40 END home_odds, CASE WHEN event_id % 3 < 2 THEN 4 - value / 120 END away_odds, CASE WHEN event_id % 3 = 2 THEN 1.5 + value / 100 END over_odds, CASE WHEN event_id % 3 = 2 THEN 3 - value / 100 END under_odds,
 CASE WHEN event_id % 3 > 0 THEN concat(event_id % 5 - 2, '.5') WHEN event_id % 7 = 0 THEN '1.5' WHEN event_id % 5 = 0 THEN ' ' END handicap, ts added_at, CASE WHEN event_id % 13 <> 0 THEN ts + INTERVAL 4 DAY END updated_at, event_id row_id FROM events"""
#: Versions of events: two users share a fight key, a later version replaces an earlier one.
_EVENTS = """SELECT user_id event_id, concat('k', CAST(floor(user_id / 2) AS INT)) fight_key, CASE WHEN user_id % 17 <> 0 THEN TIMESTAMP '2024-01-25 00:00:00' + (user_id % 9) * INTERVAL 1 DAY END starts_at, max(ts) seen_at FROM events GROUP BY 1, 2, 3"""


def _tables(spark, d):
    e = table(spark, d, "events")
    make = lambda q: spark.sql(q.replace("FROM events", "FROM {e}"), e=e)
    return make(_EVENTS), make(_ROWS)


_MKT = f"""sr AS ({_ROWS}), ev AS ({_EVENTS}),
le AS (SELECT fight_key, arg_max(event_id, (seen_at, event_id)) event_id, arg_max(coalesce(starts_at, TIMESTAMP '1900-01-01'), (seen_at, event_id)) s0 FROM ev GROUP BY 1), la AS (SELECT fight_key, event_id, nullif(s0, TIMESTAMP '1900-01-01') starts_at FROM le),
ml AS (SELECT *, 1 / home_odds l, 1 / away_odds r, try_cast(handicap AS DOUBLE) pts FROM sr WHERE trim(coalesce(handicap, '')) = '' AND home_odds > 1 AND away_odds > 1 QUALIFY row_number() OVER (PARTITION BY event_id, bookmaker, market_phase ORDER BY added_at, market_key, row_id) = 1),
hc AS (SELECT *, 1 / home_odds l, 1 / away_odds r, try_cast(handicap AS DOUBLE) pts FROM sr WHERE market_key = '162_2' AND home_odds > 1 AND away_odds > 1 QUALIFY row_number() OVER (PARTITION BY event_id, bookmaker, market_phase ORDER BY added_at, row_id) = 1),
tt AS (SELECT *, 1 / over_odds l, 1 / under_odds r, try_cast(handicap AS DOUBLE) pts FROM sr WHERE market_key = '162_3' AND over_odds > 1 AND under_odds > 1 QUALIFY row_number() OVER (PARTITION BY event_id, bookmaker, market_phase ORDER BY added_at, row_id) = 1)"""


def _phases(t: str) -> str:
    part = lambda p, n: f"min(added_at) FILTER (WHERE market_phase = '{p}') {n}_at, nullif(count(DISTINCT bookmaker) FILTER (WHERE market_phase = '{p}'), 0) {n}_books, avg(l) FILTER (WHERE market_phase = '{p}') {n}_l, avg(r) FILTER (WHERE market_phase = '{p}') {n}_r, avg(pts) FILTER (WHERE market_phase = '{p}') {n}_p"
    return f"SELECT event_id, {part('start', 'opening')}, {part('end', 'end')} FROM {t} GROUP BY 1"


_SNAP = f"{_MKT}, pm AS ({_phases('ml')}), up AS (SELECT event_id, min(updated_at) first_update, max(updated_at) last_update FROM sr GROUP BY 1), sn AS (SELECT la.*, pm.* EXCLUDE (event_id), first_update, last_update FROM la LEFT JOIN pm ON la.event_id = pm.event_id LEFT JOIN up ON la.event_id = up.event_id)"


@query(f"WITH {_MKT} SELECT (SELECT count(*) FROM sr WHERE NOT coalesce(home_odds <= 1, false) AND NOT coalesce(away_odds <= 1, false) AND NOT coalesce(over_odds <= 1, false) AND NOT coalesce(under_odds <= 1, false)) n_sane, (SELECT count(*) FROM sr WHERE home_odds IS NOT NULL AND away_odds IS NOT NULL AND trim(coalesce(handicap, '')) = '') n_straight, (SELECT count(*) FROM ml) n_moneyline, (SELECT count(*) FROM hc) n_handicap, (SELECT count(*) FROM tt) n_totals")
def summary_cleaning(spark, d):
    rows = _tables(spark, d)[1]
    parts = {"n_sane": O.sane_rows(rows), "n_straight": O.straight_rows(rows), "n_moneyline": O.market_rows(rows, "home_odds", "away_odds"), "n_handicap": O.market_rows(rows, "home_odds", "away_odds", O.HANDICAP), "n_totals": O.market_rows(rows, "over_odds", "under_odds", O.TOTALS)}
    out = None
    for n, df in parts.items():
        one = df.agg(F.count(F.lit(1)).alias(n))
        out = one if out is None else out.crossJoin(one)  # one row each
    return out


@query(f"WITH {_SNAP} SELECT fight_key, event_id, opening_at, opening_books, round(opening_l, 6) opening_left, round(opening_r, 6) opening_right, end_at, end_books, round(end_l, 6) end_left, round(end_r, 6) end_right, first_update, last_update FROM sn")
def event_snapshots(spark, d):
    out = O.event_snapshots(*_tables(spark, d))
    return out.select("fight_key", "event_id", "opening_at", "opening_books", r6("opening_left").alias("opening_left"), r6("opening_right").alias("opening_right"), "end_at", "end_books", r6("end_left").alias("end_left"), r6("end_right").alias("end_right"), "first_update", "last_update")


@query(f"WITH {_SNAP} SELECT fight_key, round(opening_l, 6) opening_a, round(opening_r, 6) opening_b, round(opening_l - opening_r, 6) opening_diff, opening_books, round(date_diff('microsecond', opening_at, starts_at) / 3.6e9, 6) lead_hours FROM sn")
def opening_features(spark, d):
    out = O.opening_features(O.event_snapshots(*_tables(spark, d)))
    return out.select("fight_key", *[r6(c).alias(c) for c in ("opening_a", "opening_b", "opening_diff")], "opening_books", r6("lead_hours").alias("lead_hours"))


def _moves_sql(n: str) -> str:
    t = n[0]
    return f"round({t}.opening_l, 6) {n}_opening_left, round({t}.opening_r, 6) {n}_opening_right, round({t}.opening_p, 6) {n}_opening_points, round({t}.end_l, 6) {n}_end_left, round({t}.end_r, 6) {n}_end_right, round({t}.end_p, 6) {n}_end_points, round(abs({t}.end_l - {t}.opening_l) + abs({t}.end_r - {t}.opening_r), 6) {n}_prob_move, round(abs({t}.end_p - {t}.opening_p), 6) {n}_points_move"


@query(f"WITH {_MKT}, ph AS ({_phases('hc')}), pt AS ({_phases('tt')}) SELECT fight_key, {_moves_sql('handicap')}, {_moves_sql('totals')} FROM la LEFT JOIN ph h ON la.event_id = h.event_id LEFT JOIN pt t ON la.event_id = t.event_id")
def market_moves(spark, d):
    out = O.market_moves(*_tables(spark, d))
    return out.select("fight_key", *[r6(c).alias(c) for c in out.columns if c != "fight_key"])


_EXPANDED = f"""{_SNAP}, wm AS (SELECT event_id, avg(l + r - 1) overround, avg(l) FILTER (WHERE market_phase = 'start') ol, avg(r) FILTER (WHERE market_phase = 'start') orr, avg(l) FILTER (WHERE market_phase = 'end') el, avg(r) FILTER (WHERE market_phase = 'end') er FROM ml GROUP BY 1),
pe AS (SELECT sr.event_id, count(DISTINCT bookmaker) books, count(DISTINCT market_key) markets, max((market_key = '162_3')::INT) has_totals, max((market_key = '162_2')::INT) has_handicap, avg(CASE WHEN market_key = '162_2' AND market_phase = 'end' THEN try_cast(handicap AS DOUBLE) END) hd,
 avg(CASE WHEN market_key = '162_3' AND market_phase = 'end' THEN try_cast(handicap AS DOUBLE) END) td, CASE WHEN max(starts_at) IS NOT NULL THEN coalesce(max((date_diff('microsecond', updated_at, starts_at) / 3.6e9 <= 2)::INT), 0) END late FROM sr LEFT JOIN la ON la.event_id = sr.event_id GROUP BY 1),
cv AS (SELECT event_id, fight_key, nullif(count(opening_l) OVER (PARTITION BY CAST(starts_at AS DATE)) / count(fight_key) OVER (PARTITION BY CAST(starts_at AS DATE)), 0) coverage FROM sn),
ex AS (SELECT fight_key, books, round(overround, 6) overround, round(el - ol, 6) move_a, round(er - orr, 6) move_b, CAST(sign(el - 0.5) * sign(td) AS DOUBLE) agreement, round(hd, 6) handicap_direction, round(td, 6) total_direction, late late_update, (overround IS NOT NULL)::INT has_moneyline, has_totals, has_handicap, round(coverage, 6) coverage, books * markets depth
 FROM cv JOIN pe ON cv.event_id = pe.event_id LEFT JOIN wm ON wm.event_id = cv.event_id)"""


def _shown(df):
    return df.select(*[r6(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(f"WITH {_EXPANDED} SELECT * FROM ex")
def expanded_market_features(spark, d):
    return _shown(O.expanded_features(*_tables(spark, d)))


@query(f"""WITH {_EXPANDED}, ph AS ({_phases('hc')}), pt AS ({_phases('tt')}), bo AS (SELECT o_orderkey fight_id, concat('k', o_custkey % 200) fight_key FROM orders),
op AS (SELECT fight_key, round(opening_l, 6) opening_a, round(opening_r, 6) opening_b, round(opening_l - opening_r, 6) opening_diff, opening_books, round(date_diff('microsecond', opening_at, starts_at) / 3.6e9, 6) lead_hours FROM sn),
mm AS (SELECT fight_key, {_moves_sql('handicap')}, {_moves_sql('totals')} FROM la LEFT JOIN ph h ON la.event_id = h.event_id LEFT JOIN pt t ON la.event_id = t.event_id)
SELECT bo.*, op.* EXCLUDE (fight_key), mm.* EXCLUDE (fight_key), ex.* EXCLUDE (fight_key) FROM bo LEFT JOIN op ON bo.fight_key = op.fight_key LEFT JOIN mm ON bo.fight_key = mm.fight_key LEFT JOIN ex ON bo.fight_key = ex.fight_key""")
def market_augmented(spark, d):
    """All market families on every bout."""
    b = table(spark, d, "orders").select(F.col("o_orderkey").alias("fight_id"), F.concat(F.lit("k"), F.col("o_custkey") % 200).alias("fight_key"))
    return _shown(O.augmented(b, *_tables(spark, d)))
