"""Queries of supplements, reviewed histories and pulled statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import supplements as U
from .fixtures import BOUTS, bouts, r6, run_sql

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Supplement rows of every bout: mirrored copies, tracked bouts, undated rows, missing names.
_RAW = """SELECT fight_id * 2 row_id, CASE WHEN fight_id % 37 > 0 THEN event_date END event_date, concat('p', CAST(a_id AS VARCHAR(19))) a_name, CASE WHEN fight_id % 41 > 0 THEN concat('p', CAST(b_id AS VARCHAR(19))) END b_name, substr(md5(CAST(a_id AS VARCHAR(19))), 1, 16) a_ref, CASE WHEN fight_id % 3 > 0 THEN substr(md5(CAST(b_id AS VARCHAR(19))), 1, 16) END b_ref,
 CASE WHEN winner = a_id THEN concat('p', CAST(a_id AS VARCHAR(19))) WHEN winner = b_id THEN concat('p', CAST(b_id AS VARCHAR(19))) END winner, method, CASE WHEN fight_id % 5 > 0 THEN CAST(n_rounds AS VARCHAR(9)) ELSE '--' END finish_round, CASE WHEN fight_id % 6 = 0 THEN ' UFC' WHEN fight_id % 6 = 1 THEN 'wufc' ELSE 'RX' END organisation, weight_class FROM bouts
UNION ALL SELECT fight_id * 2 + 1, CASE WHEN fight_id % 37 > 0 THEN event_date END, concat('p', CAST(b_id AS VARCHAR(19))), concat('p', CAST(a_id AS VARCHAR(19))), NULL, NULL, CASE WHEN winner = a_id THEN concat('p', CAST(a_id AS VARCHAR(19))) WHEN winner = b_id THEN concat('p', CAST(b_id AS VARCHAR(19))) END, method, '3', 'RX long label', weight_class FROM bouts WHERE fight_id % 4 = 0"""
_SHARED = "SELECT DISTINCT concat('p', CAST(a_id AS VARCHAR(19))) name_key FROM bouts WHERE a_id % 5 = 0"
_QUARANTINED = "SELECT DISTINCT concat('p', CAST(a_id AS VARCHAR(19))) name_key FROM bouts WHERE a_id % 11 = 0"
_REVIEWED = "SELECT DISTINCT concat('name:p', CAST(a_id AS VARCHAR(19))) entity FROM bouts WHERE a_id % 13 = 0"


def _raw(spark, d):
    b = bouts(spark, d)
    return [run_sql(spark, d, q, bouts=b) for q in (_RAW, _SHARED, _QUARANTINED, _REVIEWED)]


_LONG = f"""{BOUTS}, raw AS ({_RAW}), sh AS ({_SHARED}), qu AS ({_QUARANTINED}), rv AS ({_REVIEWED}), once AS (SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY event_date, least(a_name, b_name), greatest(a_name, b_name) ORDER BY length(coalesce(organisation, '')) DESC, row_id) = 1)"""


def _sides(source: str) -> str:
    one = lambda s, o: f"SELECT row_id, event_date, method, try_cast(finish_round AS DOUBLE) finish_round, organisation, {s}_name AS name, {s}_ref ref, {o}_name opponent, {o}_ref oref, CASE WHEN winner = {s}_name THEN 'win' WHEN winner = {o}_name THEN 'loss' ELSE 'draw' END result FROM {source} WHERE {s}_name IS NOT NULL"
    key = lambda n, r: f"CASE WHEN {n} IN (SELECT name_key FROM sh) THEN 'id:' || {r} ELSE 'name:' || {n} END"
    return f"lr AS (SELECT *, {key('name', 'ref')} entity, {key('opponent', 'oref')} opponent_key FROM ({one('a', 'b')} UNION ALL {one('b', 'a')}) z)"


_SHOW = "row_id, event_date, name, result, finish_round, entity, opponent_key"


@query(f"WITH {_LONG}, {_sides('raw')} SELECT {_SHOW} FROM lr")
def supplement_rows(spark, d):
    raw, shared, _, _ = _raw(spark, d)
    return U.long_rows(raw, shared).select(*_SHOW.split(", "))


_FILTER = "lf AS (SELECT * FROM lr WHERE name NOT IN (SELECT name_key FROM qu) AND coalesce(opponent, '') NOT IN (SELECT name_key FROM qu) AND coalesce(entity, '') NOT IN (SELECT entity FROM rv))"
_COLLAPSE = "c1 AS (SELECT * FROM lf QUALIFY row_number() OVER (PARTITION BY entity, event_date, list_aggregate(list_sort(string_split(coalesce(opponent_key, ''), ' ')), 'string_agg', ' ') ORDER BY row_id) = 1 OR entity IS NULL), c2 AS (SELECT * FROM c1 QUALIFY row_number() OVER (PARTITION BY entity, event_date, replace(coalesce(opponent_key, ''), ' ', '') ORDER BY row_id) = 1 OR entity IS NULL)"


@query(f"WITH {_LONG}, tr AS (SELECT * FROM once WHERE trim(lower(organisation)) <> 'ufc'), {_sides('tr')}, {_FILTER}, {_COLLAPSE} SELECT {_SHOW} FROM c2 WHERE event_date IS NOT NULL")
def professional_supplement(spark, d):
    return U.professional(*_raw(spark, d)).select(*_SHOW.split(", "))


@query(f"WITH {_LONG}, {_sides('once')}, {_FILTER}, {_COLLAPSE} SELECT {_SHOW} FROM c2")
def amateur_supplement(spark, d):
    return U.amateur(*_raw(spark, d)).select(*_SHOW.split(", "))


_REV = "SELECT o_orderkey row_id, o_custkey grp, CASE WHEN o_orderkey % 3 = 0 THEN 'amateur' ELSE 'professional' END history_type, CASE WHEN o_orderkey % 61 > 0 THEN CAST(o_orderdate AS DATE) END event_date, CASE WHEN o_orderkey % 5 = 0 THEN 'loss' WHEN o_orderkey % 67 = 3 THEN '?' ELSE 'win' END subject_result, CASE WHEN o_custkey % 17 > 0 THEN 'match' END dob_match FROM orders"


@query(f"WITH r AS (SELECT * FROM ({_REV}) z WHERE history_type = 'professional'), g AS (SELECT grp FROM r GROUP BY 1 HAVING bool_and(coalesce(event_date IS NOT NULL AND subject_result IN ('win', 'loss', 'draw') AND dob_match = 'match', false))) SELECT row_id, grp, subject_result FROM r WHERE grp IN (SELECT grp FROM g)")
def reviewed_history(spark, d):
    rows = run_sql(spark, d, _REV)
    digest = F.hex(F.sum(F.crc32(F.concat_ws("|", "row_id", "subject_result").cast("binary"))).cast("long"))
    pin = rows.agg(digest.alias("d")).first()["d"]
    changed = rows.withColumn("subject_result", F.when(F.col("row_id") == rows.agg(F.max("row_id")).first()[0], "?").otherwise(F.col("subject_result")))
    try:
        U.reviewed_history(changed, "professional", "grp", digest, pin)
    except ValueError:
        pass
    else:
        raise RuntimeError("a row that changed since the review was taken")
    return U.reviewed_history(rows, "professional", "grp", digest, pin).select("row_id", "grp", "subject_result")


#: Every line of an order is a round of one side; some counts and control times are unknown.
_STATS = "SELECT l_orderkey fight_id, concat('p', CAST(l_suppkey AS VARCHAR(19))) AS name, CASE WHEN l_partkey % 7 > 0 THEN CAST(l_linenumber AS VARCHAR(9)) ELSE '--' END KD, '1' SUB_ATT, CASE WHEN l_partkey % 3 = 0 THEN '' ELSE '2' END REV_, CASE WHEN l_partkey % 29 > 0 THEN concat(CAST(l_partkey % 5 AS VARCHAR(9)), ':', lpad(CAST(l_suppkey % 60 AS VARCHAR(9)), 2, '0')) ELSE '--' END CTRL, CASE WHEN l_orderkey % 9 > 0 THEN concat(CAST(l_linenumber AS VARCHAR(9)), ' of ', CAST(l_linenumber + 3 AS VARCHAR(9))) ELSE '---' END pair FROM lineitem"
_TOT = f"st AS ({_STATS}), tt AS (SELECT fight_id, name, sum(try_cast(KD AS DOUBLE)) kd, sum(try_cast(SUB_ATT AS DOUBLE)) sub_att, sum(try_cast(REV_ AS DOUBLE)) rev, CASE WHEN NOT bool_or(CTRL = '--') THEN sum(try_cast(split_part(CTRL, ':', 1) AS DOUBLE) * 60 + try_cast(split_part(CTRL, ':', 2) AS DOUBLE)) END ctrl_seconds, sum(try_cast(split_part(pair, ' of ', 1) AS DOUBLE)) landed, sum(try_cast(nullif(split_part(pair, ' of ', 2), '') AS DOUBLE)) attempted FROM st GROUP BY 1, 2)"


def _totals(spark, d):
    s = run_sql(spark, d, _STATS).withColumnsRenamed({"SUB_ATT": "SUB.ATT", "REV_": "REV."})
    return U.round_totals(s.select("*", *[F.col("pair").alias(c) for c in U.PULLED]), ["fight_id", "name"])


@query(f"WITH {_TOT} SELECT fight_id, name, kd, sub_att, rev, ctrl_seconds, landed sig_str_landed, attempted sig_str_attempted, landed ground_landed, attempted td_attempted FROM tt")
def round_totals(spark, d):
    return _totals(spark, d).select("fight_id", "name", "kd", "sub_att", "rev", "ctrl_seconds", "sig_str_landed", "sig_str_attempted", "ground_landed", "td_attempted")


_RES = "SELECT fight_id, event_date, concat('p', CAST(a_id AS VARCHAR(19))) a_name, concat('p', CAST(b_id AS VARCHAR(19))) b_name, CASE WHEN winner = a_id THEN 'W/L' WHEN winner = b_id THEN 'L/W' ELSE 'D/D' END outcome, CASE WHEN fight_id % 19 = 0 THEN 'DQ' ELSE method END method, CAST(n_rounds % 5 + 1 AS VARCHAR(9)) round, CASE WHEN fight_id % 23 > 0 THEN concat('4:', lpad(CAST(fight_id % 60 AS VARCHAR(9)), 2, '0')) ELSE '--' END AS time_ FROM bouts"


@query(f"""WITH {BOUTS}, {_TOT}, rs AS ({_RES}) SELECT rs.fight_id, event_date, (outcome = 'W/L')::INT target, round(((try_cast(round AS INT) - 1) * 300 + CASE WHEN time_ <> '--' THEN 240 + rs.fight_id % 60 END) / 60, 6) AS "minutes", a.kd a_kd, b.kd b_kd, a.landed a_sig_str_landed, b.attempted b_sig_str_attempted, b.ctrl_seconds b_ctrl_seconds
FROM rs LEFT JOIN tt a ON a.fight_id = rs.fight_id AND a.name = a_name LEFT JOIN tt b ON b.fight_id = rs.fight_id AND b.name = b_name WHERE outcome <> 'D/D' AND method <> 'DQ'""")
def pulled_training_rows(spark, d):
    results = run_sql(spark, d, _RES, bouts=bouts(spark, d)).withColumnRenamed("time_", "time")
    out = U.training_rows(results, _totals(spark, d))
    return out.select("fight_id", "event_date", "target", r6("minutes").alias("minutes"), "a_kd", "b_kd", "a_sig_str_landed", "b_sig_str_attempted", "b_ctrl_seconds")
