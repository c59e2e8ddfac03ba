"""The eight training sets of two sources, each bout with the fields that its set takes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import variants as V
from ..sources.tables import written
from .fixtures import BOUTS, bouts, run_sql

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_OLD = "SELECT fight_id row_id, CASE WHEN fight_id % 97 > 0 THEN event_date END event_date, concat('P', CAST(a_id AS VARCHAR(9))) fighter_a, concat('p-', CAST(b_id AS VARCHAR(9))) fighter_b, CASE WHEN fight_id % 5 > 0 THEN a_landed END a_kd, b_landed b_kd, CASE WHEN fight_id % 3 > 0 THEN method END method, CASE WHEN fight_id % 4 > 0 THEN a_d END a_odds, b_d b_odds FROM bouts WHERE fight_id % 4 <> 1 AND event_date < DATE '2000-07-01'"
_NEW = "SELECT fight_id row_id, event_date, CASE WHEN fight_id % 5 = 2 THEN concat('p ', CAST(b_id AS VARCHAR(9))) ELSE concat('p', CAST(a_id AS VARCHAR(9))) END fighter_a, CASE WHEN fight_id % 5 = 2 THEN concat('P', CAST(a_id AS VARCHAR(9))) ELSE concat('P ', CAST(b_id AS VARCHAR(9))) END fighter_b, CASE WHEN fight_id % 5 = 2 THEN b_landed + 1 ELSE a_landed + 1 END a_kd, CASE WHEN fight_id % 7 > 0 THEN CASE WHEN fight_id % 5 = 2 THEN a_landed + 1 ELSE b_landed + 1 END END b_kd, CASE WHEN fight_id % 6 > 0 THEN concat('N ', method) END method, CASE WHEN fight_id % 8 = 0 THEN a_d + 1 END a_odds, CAST(NULL AS DOUBLE) b_odds FROM bouts WHERE fight_id % 3 <> 2 AND event_date >= DATE '1993-01-01'"
_CUT = "1997-06-01"
#: In the older source side b is written with a hyphen, in the newer with a space: both stand for the same plain name "p <id>"; side a is "p<id>".
_KEY = """SELECT *, replace(lower(fighter_a), '-', ' ') na, replace(lower(fighter_b), '-', ' ') nb, CAST(event_date AS VARCHAR) || '|' || least(na, nb) || '|' || greatest(na, nb) bk FROM"""
_SHOW = "bk, fighter_a, fighter_b, a_kd, b_kd, method, a_odds, b_odds"
_FLIP = "SELECT n.bk, n.event_date, o.bk IS NOT NULL both_, CASE WHEN o.na <> n.na THEN n.fighter_b ELSE n.fighter_a END fighter_a, CASE WHEN o.na <> n.na THEN n.fighter_a ELSE n.fighter_b END fighter_b, CASE WHEN o.na <> n.na THEN n.b_kd ELSE n.a_kd END a_kd, CASE WHEN o.na <> n.na THEN n.a_kd ELSE n.b_kd END b_kd, n.method, CASE WHEN o.na <> n.na THEN n.b_odds ELSE n.a_odds END a_odds, CASE WHEN o.na <> n.na THEN n.a_odds ELSE n.b_odds END b_odds FROM n LEFT JOIN o ON o.bk = n.bk"


def _merged(o: str, n: str) -> str:
    return f"SELECT coalesce(x.bk, y.bk) bk, coalesce(x.fighter_a, y.fighter_a) fighter_a, coalesce(x.fighter_b, y.fighter_b) fighter_b, coalesce(y.a_kd, x.a_kd) a_kd, coalesce(y.b_kd, x.b_kd) b_kd, coalesce(y.method, x.method) AS method, coalesce(x.a_odds, y.a_odds) a_odds, coalesce(x.b_odds, y.b_odds) b_odds FROM ({o}) x FULL JOIN ({n}) y ON x.bk = y.bk"


@query(f"""WITH {BOUTS}, o AS (SELECT * FROM ({_KEY} ({_OLD}) z) k WHERE event_date IS NOT NULL QUALIFY row_number() OVER (PARTITION BY bk ORDER BY row_id) = 1), n AS (SELECT * FROM ({_KEY} ({_NEW}) z) k QUALIFY row_number() OVER (PARTITION BY bk ORDER BY row_id) = 1), f AS ({_FLIP}),
v AS (SELECT 'legacy_only' variant, {_SHOW} FROM o UNION ALL SELECT 'pulled_all', {_SHOW} FROM n UNION ALL SELECT 'append_only', {_SHOW} FROM o UNION ALL SELECT 'append_only', {_SHOW} FROM n WHERE event_date > (SELECT max(event_date) FROM o)
UNION ALL SELECT 'pulled_plus_legacy_market', n.bk, n.fighter_a, n.fighter_b, n.a_kd, n.b_kd, n.method, coalesce(n.a_odds, CASE WHEN o.na = n.na THEN o.a_odds ELSE o.b_odds END), coalesce(n.b_odds, CASE WHEN o.na = n.na THEN o.b_odds ELSE o.a_odds END) FROM n LEFT JOIN o ON o.bk = n.bk
UNION ALL SELECT 'hybrid_legacy_first', {_SHOW} FROM o UNION ALL SELECT 'hybrid_legacy_first', {_SHOW} FROM n WHERE bk NOT IN (SELECT bk FROM o) UNION ALL SELECT 'hybrid_pulled_from_overlap', {_SHOW} FROM o WHERE event_date < DATE '{_CUT}' UNION ALL SELECT 'hybrid_pulled_from_overlap', {_SHOW} FROM n WHERE event_date >= DATE '{_CUT}'
UNION ALL SELECT 'best_of_both_fields', {_SHOW} FROM o WHERE event_date < DATE '{_CUT}' UNION ALL SELECT 'best_of_both_fields', * FROM ({_merged(f"SELECT * FROM o WHERE event_date >= DATE '{_CUT}'", f"SELECT * FROM f WHERE event_date >= DATE '{_CUT}'")}) q
UNION ALL SELECT 'best_of_both_full_history', * FROM ({_merged("SELECT * FROM o", "SELECT * FROM f WHERE event_date >= (SELECT min(event_date) FROM o)")}) q)
SELECT variant, fighter_a, fighter_b, a_kd, b_kd, method, round(a_odds, 6) a_odds, round(b_odds, 6) b_odds FROM v""")
def dataset_variants(spark, d):
    b = written(bouts(spark, d), "bouts")  # both sources and the older one's days read it
    rows = V.variant_rows(run_sql(spark, d, _OLD, bouts=b), run_sql(spark, d, _NEW, bouts=b), _CUT, ["a_kd", "b_kd", "method"], ["a_odds", "b_odds"])
    return rows.select("variant", "fighter_a", "fighter_b", "a_kd", "b_kd", "method", F.round("a_odds", 6).alias("a_odds"), F.round("b_odds", 6).alias("b_odds"))
