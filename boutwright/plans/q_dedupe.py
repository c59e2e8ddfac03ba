"""Queries of deduplication, merging, version comparison and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import dedupe as D
from ..operators import history as H
from ..operators import quality as Q
from .fixtures import BOUTS, LONG, bouts, r6, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"""WITH {BOUTS}, m AS (SELECT fight_id * 2 row_id, event_date, a_id x, b_id y, weight_class org FROM bouts UNION ALL SELECT fight_id * 2 + 1, event_date, b_id, a_id, weight_class || ' tour' FROM bouts WHERE status = 'F')
SELECT row_id, event_date, least(x, y) lo, greatest(x, y) hi, org FROM m QUALIFY row_number() OVER (PARTITION BY event_date, least(x, y), greatest(x, y) ORDER BY length(org) DESC, row_id) = 1""")
def mirror_dedupe(spark, d):
    b = bouts(spark, d)
    one = b.select((F.col("fight_id") * 2).alias("row_id"), "event_date", F.col("a_id").alias("x"), F.col("b_id").alias("y"), F.col("weight_class").alias("org"))
    two = b.where("status = 'F'").select((F.col("fight_id") * 2 + 1).alias("row_id"), "event_date", F.col("b_id").alias("x"), F.col("a_id").alias("y"), F.concat("weight_class", F.lit(" tour")).alias("org"))
    rows = one.unionByName(two).withColumn("lo", F.least("x", "y")).withColumn("hi", F.greatest("x", "y"))
    return D.keep_best(rows, ["event_date", "lo", "hi"], [F.desc(F.length("org")), F.asc("row_id")]).select("row_id", "event_date", "lo", "hi", "org")


@query(f"""WITH {LONG}, r AS (SELECT entity, event_date \"day\", opponent opp_key, opponent % 10 flat_key, CASE WHEN fight_id % 7 = 0 THEN NULL ELSE fight_id % 3 END tier, fight_id row_id FROM long),
a AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY entity, \"day\", opp_key ORDER BY tier NULLS LAST, row_id) = 1)
SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY entity, \"day\", flat_key ORDER BY tier NULLS LAST, row_id) = 1""")
def bout_collapse(spark, d):
    f = F.col("fight_id")
    rows = H.long_rows(bouts(spark, d)).select("entity", F.col("event_date").alias("day"), F.col("opponent").alias("opp_key"), (F.col("opponent") % 10).alias("flat_key"), F.when(f % 7 != 0, f % 3).alias("tier"), f.alias("row_id"))
    return D.collapse_bouts(rows)


@query(f"""WITH {LONG} SELECT entity, opponent, CASE WHEN count(DISTINCT method) <= 1 THEN min(method) END method, min(result) result, count(*) n_rows FROM long GROUP BY 1, 2 HAVING count(DISTINCT result) <= 1""")
def conflict_reconcile(spark, d):
    return D.reconcile(H.long_rows(bouts(spark, d)), ["entity", "opponent"])


@query("""WITH u AS (SELECT l_orderkey, l_linenumber, l_extendedprice v, 0 p FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, l_extendedprice + 1, 1 FROM lineitem WHERE l_linestatus = 'F'
UNION ALL SELECT l_orderkey, l_linenumber, l_extendedprice + 2, 2 FROM lineitem WHERE l_returnflag = 'R')
SELECT l_orderkey, l_linenumber, round(v, 6) v, p priority FROM u QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY p DESC, v) = 1""")
def keep_last_priority(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus", "l_returnflag", F.col("l_extendedprice").alias("v"))
    parts = [li, li.where("l_linestatus = 'F'").withColumn("v", F.col("v") + 1), li.where("l_returnflag = 'R'").withColumn("v", F.col("v") + 2)]
    parts = [p.drop("l_linestatus", "l_returnflag") for p in parts]
    return D.keep_last_source(parts, ["l_orderkey", "l_linenumber"], F.asc("v")).withColumn("v", r6("v"))


#: Two versions of the orders that overlap in time: every order is in one or both.
_OLD_DAYS, _NEW_DAYS = "o_orderdate < TIMESTAMP '1999-01-01'", "o_orderdate >= TIMESTAMP '1997-01-01'"
_OLD = f"SELECT o_orderkey k, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END price, o_orderpriority prio FROM orders WHERE {_OLD_DAYS}"
_NEW = f"SELECT o_orderkey k, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice + 1 END price, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderstatus END prio FROM orders WHERE {_NEW_DAYS}"


def _versions(spark, d):
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    old = o.where(_OLD_DAYS).select(k.alias("k"), F.when(k % 5 != 0, F.col("o_totalprice")).alias("price"), F.col("o_orderpriority").alias("prio"))
    new = o.where(_NEW_DAYS).select(k.alias("k"), F.when(k % 7 != 0, F.col("o_totalprice") + 1).alias("price"), F.when(k % 4 != 0, F.col("o_orderstatus")).alias("prio"))
    return old, new


@query(f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT coalesce(o.k, n.k) k, round(coalesce(n.price, o.price), 6) price, coalesce(o.prio, n.prio) prio, CASE WHEN o.k IS NULL THEN 'new' WHEN n.k IS NULL THEN 'old' ELSE 'both' END source FROM o FULL JOIN n ON o.k = n.k")
def field_coalesce(spark, d):
    return D.merge_fields(*_versions(spark, d), ["k"], ["price"], ["prio"]).withColumn("price", r6("price"))


@query(f"""WITH o AS ({_OLD}), n AS ({_NEW}), x AS (SELECT o.price op, n.price np, o.prio oq, n.prio nq FROM o JOIN n ON o.k = n.k),
u AS (SELECT 'price' field, CAST(op AS VARCHAR) a, CAST(np AS VARCHAR) b FROM x UNION ALL SELECT 'prio', oq, nq FROM x)
SELECT field, count(*) n_keys, CAST(sum(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) both_known, CAST(sum(CASE WHEN a = b THEN 1 ELSE 0 END) AS BIGINT) equal,
 CAST(sum(CASE WHEN a IS NOT NULL AND b IS NULL THEN 1 ELSE 0 END) AS BIGINT) only_old, CAST(sum(CASE WHEN a IS NULL AND b IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) only_new FROM u GROUP BY 1""")
def field_overlap(spark, d):
    return D.field_overlap(*_versions(spark, d), "k", ["price", "prio"])


@query(f"""WITH o AS (SELECT o_orderkey k, o_custkey p, CAST(o_orderdate AS DATE) dd FROM orders WHERE {_OLD_DAYS}), n AS (SELECT CASE WHEN o_orderkey % 11 = 0 THEN o_orderkey + 10000000 ELSE o_orderkey END k, o_custkey p,
 CAST(o_orderdate AS DATE) + CAST(CASE WHEN o_orderkey % 13 = 0 THEN 7 ELSE 0 END AS INTEGER) dd FROM orders WHERE {_NEW_DAYS}),
b AS (SELECT coalesce(o.k, n.k) k, coalesce(n.p, o.p) p, o.dd od, n.dd nd FROM o FULL JOIN n ON o.k = n.k),
g AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY k) i FROM b WHERE nd IS NULL), c AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY k) i FROM b WHERE od IS NULL),
m AS (SELECT coalesce(c.k, g.k) k, coalesce(c.p, g.p) p, g.od, c.nd FROM g FULL JOIN c ON g.p = c.p AND g.i = c.i)
SELECT k, p, od old_day, nd new_day, CASE WHEN od = nd THEN 'unchanged' ELSE 'rescheduled' END status FROM b WHERE od IS NOT NULL AND nd IS NOT NULL
UNION ALL SELECT k, p, od, nd, CASE WHEN od IS NULL THEN 'added' WHEN nd IS NULL THEN 'removed' ELSE 'rescheduled' END FROM m""")
def version_diff(spark, d):
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    day = F.to_date("o_orderdate")
    old = o.where(_OLD_DAYS).select(k.alias("k"), F.col("o_custkey").alias("p"), day.alias("d"))
    new = o.where(_NEW_DAYS).select(F.when(k % 11 == 0, k + 10000000).otherwise(k).alias("k"), F.col("o_custkey").alias("p"), F.date_add(day, F.when(k % 13 == 0, 7).otherwise(0)).alias("d"))
    return D.version_diff(old, new, "k", "p", "d")


@query(f"""WITH a AS (SELECT o_custkey k, o_orderstatus s FROM orders WHERE {_OLD_DAYS}), b AS (SELECT o_custkey k, o_orderstatus s FROM orders WHERE {_NEW_DAYS})
SELECT k, s, 'lost' change FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT k, s, 'new' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def row_changes(spark, d):
    o = table(spark, d, "orders")
    pick = lambda days: o.where(days).select(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("s"))
    return D.row_changes(pick(_OLD_DAYS), pick(_NEW_DAYS))


@query(f"WITH {BOUTS} SELECT event_date, a_id, b_id, count(*) n_rows FROM bouts GROUP BY 1, 2, 3 HAVING count(*) > 1")
def dup_report(spark, d):
    return D.duplicate_keys(bouts(spark, d), ["event_date", "a_id", "b_id"])


@query("""WITH o AS (SELECT user_id id, min(event_id) v FROM events WHERE event_type = 'signup' AND value > 50 GROUP BY 1), n AS (SELECT user_id id, event_id v FROM events)
SELECT id, v FROM o UNION ALL SELECT id, v FROM (SELECT * FROM n WHERE id NOT IN (SELECT id FROM o) QUALIFY row_number() OVER (PARTITION BY id ORDER BY v) = 1)""")
def append_unique(spark, d):
    e = table(spark, d, "events")
    old = e.where("event_type = 'signup' and value > 50").groupBy(F.col("user_id").alias("id")).agg(F.min("event_id").alias("v"))
    return D.append_unique(old, e.select(F.col("user_id").alias("id"), F.col("event_id").alias("v")), "id", F.asc("v"))


@query("""WITH x AS (SELECT l_orderkey k, l_linenumber n, l_quantity landed, l_quantity + (l_partkey % 9) - 2 attempted, l_discount * 1200 pct, l_tax p FROM lineitem)
SELECT k, n, landed > attempted landed_over, pct > 100 OR pct < 0 pct_range, p < 0 OR p > 0.07 prob_range, CAST((landed > attempted)::INT + (pct > 100 OR pct < 0)::INT + (p < 0 OR p > 0.07)::INT AS INTEGER) n_faults FROM x WHERE landed > attempted OR pct > 100 OR pct < 0 OR p < 0 OR p > 0.07""")
def value_anomalies(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("landed"), (F.col("l_quantity") + F.col("l_partkey") % 9 - 2).alias("attempted"), (F.col("l_discount") * 1200).alias("pct"), F.col("l_tax").alias("p"))
    rules = {"landed_over": F.col("landed") > F.col("attempted"), "pct_range": ~F.col("pct").between(0, 100), "prob_range": ~F.col("p").between(0, 0.07)}
    return Q.faults(x, rules).select("k", "n", *rules, "n_faults")


@query("""SELECT l_returnflag grp, count(*) n, round(avg(CASE WHEN l_discount > 0 THEN 1.0 ELSE 0.0 END), 6) cov_discount, round(avg(CASE WHEN l_tax > 0 THEN 1.0 ELSE 0.0 END), 6) cov_tax, avg(CASE WHEN l_discount > 0 THEN 1.0 ELSE 0.0 END) >= 0.9 AND avg(CASE WHEN l_tax > 0 THEN 1.0 ELSE 0.0 END) >= 0.88 passes FROM lineitem GROUP BY 1""")
def coverage_floors(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("grp"), F.when(F.col("l_discount") > 0, F.col("l_discount")).alias("discount"), F.when(F.col("l_tax") > 0, F.col("l_tax")).alias("tax"))
    out = Q.coverage(li, ["grp"], {"discount": 0.9, "tax": 0.88})
    return out.select("grp", "n", r6("cov_discount").alias("cov_discount"), r6("cov_tax").alias("cov_tax"), "passes")


@query("""WITH x AS (SELECT l_orderkey k, l_linenumber n, l_extendedprice live, l_extendedprice + CASE WHEN l_partkey % 3 = 0 THEN 0.5 WHEN l_partkey % 3 = 1 THEN 0 END train FROM lineitem)
SELECT CASE WHEN train IS NULL THEN 'live_only' WHEN abs(live - train) <= 0.01 THEN 'match' ELSE 'mismatch' END verdict, count(*) n FROM x GROUP BY 1""")
def parity_classes(spark, d):
    p = F.col("l_partkey") % 3
    x = table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("live"), (F.col("l_extendedprice") + F.when(p == 0, 0.5).when(p == 1, 0.0)).alias("train"))
    return x.groupBy(Q.parity(F.col("live"), F.col("train"), 0.01).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH x AS (SELECT o_orderkey k, CASE o_orderkey % 6 WHEN 0 THEN 'W/L' WHEN 1 THEN 'L/W' WHEN 2 THEN 'D/D' WHEN 3 THEN 'NC/NC' WHEN 4 THEN 'W/W' END o, CASE WHEN o_orderkey % 5 = 0 THEN 'Overturned (DQ)' ELSE 'Decision' END m FROM orders),
y AS (SELECT CASE WHEN o IS NULL THEN 'unknown' WHEN o IN ('W/L', 'L/W') THEN (CASE WHEN m LIKE '%DQ%' THEN 'disqualification' ELSE 'normal' END) WHEN o = 'D/D' THEN 'draw' WHEN o = 'NC/NC' THEN 'no_contest' ELSE 'contradictory' END kind, CASE o WHEN 'W/L' THEN 'a' WHEN 'L/W' THEN 'b' END winner_side FROM x)
SELECT kind, winner_side, kind = 'normal' is_target, kind IN ('unknown', 'contradictory') quarantined, count(*) n FROM y GROUP BY 1, 2, 3, 4""")
def official_results(spark, d):
    k = F.col("o_orderkey")
    o = F.when(k % 6 == 0, " w / l").when(k % 6 == 1, "L/W").when(k % 6 == 2, "D/D").when(k % 6 == 3, "NC/NC").when(k % 6 == 4, "W/W")
    m = F.when(k % 5 == 0, "Overturned (DQ)").otherwise("Decision")
    return table(spark, d, "orders").select(S.official_result(o, m).alias("r")).groupBy("r.kind", "r.winner_side", "r.is_target", "r.quarantined").agg(F.count(F.lit(1)).alias("n"))
