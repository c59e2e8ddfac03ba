"""Queries of the feature matrix: rates of a bout, rolled statistics, matchup features, context."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as X
from ..operators import history as H
from .fixtures import BOUTS, bouts, r6, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Raw counts of a side, as SQL that both engines read; {s} is the side.
_COUNTS = {
    "sig_str_landed": "{s}_landed", "sig_str_attempted": "{s}_landed + {s}_id % 20", "td_landed": "CAST({s}_id % 4 AS DOUBLE)", "td_attempted": "CAST({s}_id % 4 + fight_id % 3 AS DOUBLE)",
    "kd": "CAST((fight_id + {s}_id) % 3 AS DOUBLE)", "sub_att": "CAST(({s}_id + fight_id) % 4 AS DOUBLE)", "rev": "CAST(fight_id % 2 AS DOUBLE)",
    "ctrl_seconds": "CASE WHEN fight_id % 6 = 0 THEN NULL ELSE {s}_landed * 7 END", "total_str_landed": "{s}_landed * 1.6", "head_landed": "{s}_landed * 0.5", "body_landed": "{s}_landed * 0.3", "leg_landed": "{s}_landed * 0.2",
    "distance_landed": "{s}_landed * 0.6", "clinch_landed": "{s}_landed * 0.15", "ground_landed": "{s}_landed * 0.25", "distance_attempted": "{s}_landed * 0.6 + {s}_id % 5", "clinch_attempted": "{s}_landed * 0.15 + {s}_id % 3",
    "ground_attempted": "CASE WHEN fight_id % 4 = 0 THEN 0.0 ELSE {s}_landed * 0.25 + 1 END",
}
_AGE = "CASE WHEN ({s}_id + fight_id) % 9 = 0 THEN NULL ELSE CAST(20 + ({s}_id + fight_id) % 21 AS DOUBLE) END"
_RAW = ", ".join(f"CAST({e.format(s=s)} AS DOUBLE) {s}_{k}" for s in "ab" for k, e in {**_COUNTS, "age": _AGE}.items())
_STATS = f"{BOUTS}, sb AS (SELECT fight_id, event_date, weight_class, method, n_rounds, winner, a_id, b_id, {_RAW} FROM bouts)"


def stat_bouts(spark, d):
    return bouts(spark, d).selectExpr("fight_id", "event_date", "weight_class", "method", "n_rounds", "winner", "a_id", "b_id", *[f"CAST({e.format(s=s)} AS DOUBLE) {s}_{k}" for s in "ab" for k, e in {**_COUNTS, "age": _AGE}.items()])


def _rates_sql(s: str, o: str) -> dict[str, str]:
    def over(a: str, b: str, scale: str = "") -> str:
        return f"CASE WHEN {b} > 0 THEN {a} / {b}{scale} END"

    minutes = "(n_rounds * 5.0)"
    out = {
        "slpm": over(f"{s}_sig_str_landed", minutes), "sapm": over(f"{o}_sig_str_landed", minutes), "str_acc": over(f"{s}_sig_str_landed", f"{s}_sig_str_attempted", " * 100"),
        "str_def": f"CASE WHEN {o}_sig_str_attempted > 0 THEN (1 - {o}_sig_str_landed / {o}_sig_str_attempted) * 100 END", "td_avg": over(f"{s}_td_landed", minutes, " * 15"), "td_acc": over(f"{s}_td_landed", f"{s}_td_attempted", " * 100"),
        "td_def": f"CASE WHEN {o}_td_attempted > 0 THEN (1 - {o}_td_landed / {o}_td_attempted) * 100 END", "sub_avg": over(f"{s}_sub_att", minutes, " * 15"), "total_str_pm": over(f"{s}_total_str_landed", minutes),
        "sig_str_share": over(f"{s}_sig_str_landed", f"{s}_total_str_landed"), "control_share": over(f"{s}_ctrl_seconds", f"({minutes} * 60)"), "control_per_td": over(f"{s}_ctrl_seconds", f"{s}_td_landed"),
        "finish_threat": over(f"(coalesce({s}_kd, 0) + coalesce({s}_sub_att, 0))", minutes),
    }
    out |= {f"{p}_str_share": over(f"{s}_{p}_landed", f"{s}_sig_str_landed") for p in ("head", "body", "leg", "distance", "clinch", "ground")}
    out |= {f"{p}_acc": over(f"{s}_{p}_landed", f"{s}_{p}_attempted") for p in ("distance", "clinch", "ground")}
    return out | {c: f"{s}_{c}" for c in X.BASE if c not in out}


def _side_sql(s: str, o: str) -> str:
    own, opp = _rates_sql(s, o), _rates_sql(o, s)
    cols = [f"{e} {k}" for k, e in own.items()] + [f"{opp[k]} opp_{k}" for k in (*X.BASE, *X.EXTENDED)]
    return f"SELECT fight_id, event_date, method, n_rounds, '{s}' side, {s}_id entity, {o}_id opponent, CASE WHEN winner = {s}_id THEN 'win' WHEN winner = {o}_id THEN 'loss' ELSE 'draw' END result, CASE WHEN winner = {s}_id THEN 1.0 ELSE 0.0 END won, {', '.join(cols)} FROM sb"


_ROWS = f"{_STATS}, pr AS ({_side_sql('a', 'b')} UNION ALL {_side_sql('b', 'a')})"
_N = "pn AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY event_date, fight_id) i FROM pr)"


def _ewm_sql(stats) -> str:
    means = ", ".join(f"sum(y.{s} * pow(2, (y.i - x.i) / 3.0)) / sum(CASE WHEN y.{s} IS NOT NULL THEN pow(2, (y.i - x.i) / 3.0) END) roll_{s}" for s in stats)
    return f"ro AS (SELECT x.fight_id, x.side, {means} FROM pn x LEFT JOIN pn y ON x.entity = y.entity AND y.i < x.i GROUP BY 1, 2)"


_SHOWN = ("slpm", "str_acc", "td_avg", "sub_avg", "total_str_pm", "sig_str_share", "control_per_td", "finish_threat", "ground_acc", "leg_str_share")


@query(f"WITH {_ROWS} SELECT fight_id, side, {', '.join(f'round({c}, 6) {c}' for c in _SHOWN)}, round(opp_td_def, 6) opp_td_def, result FROM pr")
def bout_rates(spark, d):
    """Rates of every bout, both sides mirrored."""
    rows = X.participant_rows(stat_bouts(spark, d), F.col("n_rounds") * 5.0)
    return rows.select("fight_id", "side", *[r6(c).alias(c) for c in (*_SHOWN, "opp_td_def")], "result")


@query(f"WITH {_ROWS}, {_N}, {_ewm_sql(X.ROLLED)} SELECT fight_id, side, {', '.join(f'round(roll_{s}, 6) roll_{s}' for s in X.ROLLED)} FROM ro")
def rolled_statistics(spark, d):
    """All 55 rolled statistics of both participants before each bout."""
    rows = X.participant_rows(stat_bouts(spark, d), F.col("n_rounds") * 5.0)
    return X.rolled(rows, keep=("fight_id", "side")).select("fight_id", "side", *[r6(f"roll_{s}").alias(f"roll_{s}") for s in X.ROLLED])


_NEED = ("slpm", "sapm", "str_def", "td_def", "sig_str_landed", "ctrl_seconds", "opp_kd", "opp_sig_str_landed", "opp_sig_str_attempted", "won")
_CW = "OVER (PARTITION BY entity ORDER BY event_date, fight_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_MG = "CASE WHEN lower(method) LIKE '%dec%' THEN 'dec' WHEN lower(method) LIKE '%sub%' THEN 'sub' WHEN lower(method) LIKE '%ko%' THEN 'ko' END"


def _derived_sql(s: str, o: str) -> dict[str, str]:
    e, p = ("ea", "eb") if s == "a" else ("eb", "ea")
    c, age = ("ca", "cb")[s == "b"], f"b.{s}_age"
    rate = {m: f"{c}.wins_{m} / nullif({c}.wins, 0)" for m in ("ko", "sub", "dec")}
    return {
        **{f"{m}_rate": x for m, x in rate.items()}, "win_pct": f"{c}.wins / nullif({c}.wins + {c}.losses, 0)", "cage_rust": f"CASE WHEN {c}.gap > 365 THEN 1.0 WHEN {c}.gap IS NOT NULL THEN 0.0 END", "layoff_log": f"ln(1 + {c}.gap)",
        "striker_edge": f"({rate['ko']}) * (1 - {p}.roll_str_def / 100)", "grappler_edge": f"({rate['sub']}) * (1 - {p}.roll_td_def / 100)", "fight_pace": f"({e}.roll_slpm + {e}.roll_sapm)",
        "ctrl_efficiency": f"{e}.roll_sig_str_landed / CASE WHEN {e}.roll_ctrl_seconds < 1 THEN 1 ELSE {e}.roll_ctrl_seconds END", "age_over_35": f"CASE WHEN {age} > 35 THEN 1.0 WHEN {age} IS NOT NULL THEN 0.0 END",
        "age_under_25": f"CASE WHEN {age} < 25 THEN 1.0 WHEN {age} IS NOT NULL THEN 0.0 END", "age_squared": f"{age} * {age}", "ko_absorption": f"{e}.roll_opp_kd", "strikes_avoided_pct": f"1 - {e}.roll_opp_sig_str_landed / nullif({e}.roll_opp_sig_str_attempted, 0)",
    }


_DA, _DB = _derived_sql("a", "b"), _derived_sql("b", "a")
_DIFF = ("slpm", "sapm", "str_def", "td_def", "opp_kd", "won")


@query(f"""WITH {_ROWS}, {_N}, {_ewm_sql(_NEED)},
cc AS (SELECT fight_id, side, coalesce(sum((result = 'win')::INT) {_CW}, 0) wins, coalesce(sum((result = 'loss')::INT) {_CW}, 0) losses, {', '.join(f"coalesce(sum((result = 'win' AND {_MG} = '{m}')::INT) {_CW}, 0) wins_{m}" for m in ('ko', 'sub', 'dec'))},
 date_diff('day', lag(event_date) OVER (PARTITION BY entity ORDER BY event_date, fight_id), event_date) gap FROM pr)
SELECT b.fight_id, {', '.join(f'round({_DA[k]}, 6) a_{k}, round({_DB[k]}, 6) b_{k}, round(({_DA[k]}) - ({_DB[k]}), 6) diff_{k}' for k in X.DERIVED)}, {', '.join(f'round(ea.roll_{k} - eb.roll_{k}, 6) diff_roll_{k}' for k in _DIFF)},
 round(abs({_DA['fight_pace']} - {_DB['fight_pace']}), 6) pace_mismatch
FROM sb b JOIN ro ea ON ea.fight_id = b.fight_id AND ea.side = 'a' JOIN ro eb ON eb.fight_id = b.fight_id AND eb.side = 'b' JOIN cc ca ON ca.fight_id = b.fight_id AND ca.side = 'a' JOIN cc cb ON cb.fight_id = b.fight_id AND cb.side = 'b'""")
def feature_matrix(spark, d):
    """Rolled statistics, counters and derived matchup features of every bout."""
    ages, kept = ("a_age", "b_age"), ("fight_id", "event_date", "method", "n_rounds", "side", "entity", "result")
    rows = X.participant_rows(stat_bouts(spark, d), F.col("n_rounds") * 5.0, ("method", "n_rounds", *ages))
    rows = H.prior_counts(X.rolled(rows, _NEED, keep=(*kept, *ages)))
    names = [*[f"roll_{s}" for s in _NEED], "wins", "losses", "wins_ko", "wins_sub", "wins_dec", "days_since"]
    out = X.matchup(H.side_by_side(rows, names, ages))
    out = H.differences(out, [f"roll_{k}" for k in _DIFF])
    shown = [f"{p}_{k}" for k in X.DERIVED for p in ("a", "b", "diff")] + [f"diff_roll_{k}" for k in _DIFF] + ["pace_mismatch"]
    return out.select("fight_id", *[r6(c).alias(c) for c in shown])


@query("""WITH x AS (SELECT o_orderkey k, CASE o_orderkey % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 WHEN 2 THEN 1.0 WHEN 3 THEN 0.0 END t, CASE WHEN o_orderkey % 3 <> 0 THEN (o_orderkey % 5 + 1)::DOUBLE END n,
 CASE WHEN o_custkey % 4 <> 0 THEN (o_custkey % 16)::DOUBLE END a, CASE WHEN o_custkey % 3 <> 0 THEN (o_custkey % 11)::DOUBLE END b, CASE o_custkey % 6 WHEN 0 THEN 0.0 WHEN 1 THEN 1.0 WHEN 2 THEN 2.0 WHEN 3 THEN 3.0 END sa, CASE o_orderkey % 2 WHEN 0 THEN 0.0 ELSE 1.0 END sb FROM orders)
SELECT k, t is_title_bout, n num_rounds_feat, t is_empty_arena, a a_wc_rank_feat, b b_wc_rank_feat, b a_pfp_rank_feat, a b_pfp_rank_feat, a - b diff_wc_rank, b - a diff_pfp_rank, sa a_stance, CASE WHEN sa IS NOT NULL THEN (sa = sb)::INT::DOUBLE END same_stance FROM x""")
def honest_context(spark, d):
    """Context columns whose unknowns stay unknown."""
    k, p = F.col("o_orderkey"), F.col("o_custkey")
    flag = F.element_at(F.array(*[F.lit(x) for x in (" TRUE", "no", "1", "0.0", "maybe")]), (k % 5 + 1).cast("int"))
    stance = F.element_at(F.array(*[F.lit(x) for x in ("Orthodox", " SOUTHPAW ", "switch", "open  stance", "", "?")]), (p % 6 + 1).cast("int"))
    a, b = F.when(p % 4 != 0, (p % 16).cast("string")).otherwise("NR"), F.when(p % 3 != 0, (p % 11).cast("string"))
    raw = table(spark, d, "orders").select(k.alias("k"), flag.alias("title_bout"), flag.alias("empty_arena"), F.when(k % 3 != 0, k % 5 + 1).alias("num_rounds"), a.alias("a_wc_rank"), b.alias("b_wc_rank"), b.alias("a_pfp_rank"), a.alias("b_pfp_rank"), X.stance_code(stance).alias("a_stance"), X.stance_code(F.when(k % 2 == 0, "orthodox").otherwise("Southpaw")).alias("b_stance"))
    out = X.context(raw)
    return out.select("k", "is_title_bout", "num_rounds_feat", "is_empty_arena", *[f"{s}_{k}_rank_feat" for k in ("wc", "pfp") for s in "ab"], "diff_wc_rank", "diff_pfp_rank", "a_stance", (F.col("a_stance") == F.col("b_stance")).cast("double").alias("same_stance"))
