"""Queries of feature families, their sources, and the gate of live rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import provenance as P
from .fixtures import r6, run_sql

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Features by name, each with what makes it unknown.
_FEATURES = {
    "a_roll_landed": 3, "b_roll_landed": 5, "diff_num_fights": 7, "a_implied_prob": 4, "b_close_odds_prob": 6, "a_rank": 9, "diff_height": 11, "same_stance": 8, "is_title_bout": 13, "b_wc_move": 10, "a_ko_rate": 12, "diff_win_pct": 14, "b_amateur_wins": 15, "a_pre_ufc_wins": 16,
    "diff_opp_strength": 17, "striker_edge": 18, "is_rematch": 19, "line_movement": 20,
}
_FRAME = "SELECT l_orderkey k, l_partkey p, l_suppkey s, " + ", ".join(f"CASE WHEN (l_partkey + {i}) % {m} > 0 THEN l_quantity + {i} END {n}" for i, (n, m) in enumerate(_FEATURES.items())) + " FROM lineitem"
_OWN = {n: f"(s + {i}) % 3 = 0" for i, n in enumerate(_FEATURES) if n != "is_rematch"}
_LEGACY = {n: f"(k + {i}) % 4 > 1" for i, n in enumerate(_FEATURES)}
_BUCKETS = " UNION ALL ".join(f"SELECT '{n}' feature, {n} IS NOT NULL known, {_OWN.get(n, 'false')} own, {_LEGACY[n]} legacy FROM f" for n in _FEATURES)
_FAMILY = "CASE feature " + " ".join(f"WHEN '{n}' THEN '{f}'" for n, f in {
    "a_roll_landed": "historical_performance", "b_roll_landed": "historical_performance", "diff_num_fights": "historical_performance", "a_implied_prob": "market_odds", "b_close_odds_prob": "market_odds", "a_rank": "rankings", "diff_height": "physical_profile", "same_stance": "physical_profile",
    "is_title_bout": "event_context", "b_wc_move": "event_context", "a_ko_rate": "career_record", "diff_win_pct": "career_record", "b_amateur_wins": "amateur_history", "a_pre_ufc_wins": "pre_ufc_history", "diff_opp_strength": "experimental", "striker_edge": "style_matchup", "is_rematch": "rematch_h2h", "line_movement": "misc",
}.items()) + " END"


def _frame(spark, d):
    exprs = lambda m: {n: F.expr(e) for n, e in m.items()}
    return run_sql(spark, d, _FRAME), list(_FEATURES), exprs(_OWN), exprs(_LEGACY)


@query(f"""WITH f AS ({_FRAME}), x AS ({_BUCKETS}), y AS (SELECT feature, count(*) FILTER (WHERE known AND own AND NOT legacy) own_only, count(*) FILTER (WHERE known AND legacy AND NOT own) legacy_only, count(*) FILTER (WHERE known AND own AND legacy) mixed, count(*) FILTER (WHERE known AND NOT own AND NOT legacy) defaults, count(*) FILTER (WHERE NOT known) AS unknown FROM x GROUP BY 1)
SELECT feature, {_FAMILY} family, own_only, legacy_only, mixed, defaults, unknown, concat_ws(',', CASE WHEN own_only + mixed > 0 THEN 'own' END, CASE WHEN legacy_only + mixed > 0 THEN 'legacy' END, CASE WHEN defaults > 0 THEN 'default' END) sources FROM y""")
def feature_sources(spark, d):
    return P.source_buckets(*_frame(spark, d))


_ROWED = _BUCKETS.replace(" FROM f", ", k, p, s, r FROM g")


@query(f"""WITH f AS ({_FRAME}), g AS (SELECT *, row_number() OVER () r FROM f), x AS (SELECT *, {_FAMILY} family FROM ({_ROWED}) z), y AS (SELECT family, r, bool_or(known) kn, bool_or(known AND legacy) old, bool_or(known AND own) new, bool_or(known AND NOT own AND NOT legacy) dflt, bool_and(known) complete, count(*) n FROM x GROUP BY 1, 2)
SELECT family, max(n) n_features, count(*) FILTER (WHERE kn) any_known, count(*) FILTER (WHERE old) any_legacy, count(*) FILTER (WHERE kn AND new AND NOT old) own_alone, count(*) FILTER (WHERE kn AND dflt AND NOT old AND NOT new) defaults_alone, round(avg(complete::INT), 6) complete FROM y GROUP BY 1""")
def feature_families(spark, d):
    return P.family_summary(*_frame(spark, d)).withColumn("complete", r6("complete"))


_PARTS = [f"CASE WHEN (o_orderkey + {i}) % {3 + i} > 0 THEN CAST({i} AS DOUBLE) END {s}_{c}" for s in "ab" for i, c in enumerate(P.CRITICAL, 1 if s == "a" else 2)]
_LIVE = f"""SELECT o_orderkey k, CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'wiki' WHEN 2 THEN ' Fallback' WHEN 3 THEN 'UFCStats' ELSE 'processed' END a_source, CASE o_custkey % 11 WHEN 0 THEN '' WHEN 1 THEN 'fallback' WHEN 2 THEN 'ufcstats' ELSE 'processed' END b_source,
 CASE WHEN o_orderkey % 2 = 0 THEN 'Unavailable' END a_history, CASE WHEN o_custkey % 2 = 0 THEN 'unavailable' ELSE 'loaded' END b_history, CAST(o_orderkey % 5 AS INT) a_bouts, CAST(o_custkey % 4 AS INT) b_bouts, o_orderkey % 23 > 0 a_confirmed, CASE WHEN o_custkey % 29 > 0 THEN true END b_confirmed, {', '.join(_PARTS)} FROM orders"""


def _reasons(s: str) -> str:
    src = f"lower(trim(coalesce({s}_source, '')))"
    known = f"{src} IN ('processed', 'ufcstats', 'fallback')"
    tests = {"identity_unconfirmed": f"NOT coalesce({s}_confirmed, false)", "no_source": f"{src} = ''", "unsupported_source": f"{src} <> '' AND NOT {known}", "history_unavailable": f"{src} = 'ufcstats' AND lower(coalesce({s}_history, '')) = 'unavailable'", "fallback_source": f"{src} = 'fallback'", "missing_features": f"{known} AND {s}_bouts >= 2 AND {s}_missing > 4"}
    return ", ".join(f"CASE WHEN {t} THEN '{s}:{n}' END" for n, t in tests.items())


@query(f"""WITH x AS ({_LIVE}), m AS (SELECT *, {', '.join(f"({' + '.join(f'CASE WHEN {s}_{c} IS NULL THEN 1 ELSE 0 END' for c in P.CRITICAL)}) {s}_missing" for s in 'ab')} FROM x)
SELECT k, a_missing, b_missing, concat_ws(',', {_reasons('a')}, {_reasons('b')}) reasons, length(concat_ws(',', {_reasons('a')}, {_reasons('b')})) > 0 blocked FROM m""")
def live_gate(spark, d):
    return P.live_gate(run_sql(spark, d, _LIVE)).select("k", "a_missing", "b_missing", F.array_join("reasons", ",").alias("reasons"), "blocked")
