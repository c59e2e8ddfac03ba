"""Queries of streams, retention and checks of what is published."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import ledger
from ..operators import lines as P
from ..operators import quality as Q
from ..operators import refresh as R
from ..streaming import streams
from .fixtures import r6, run_sql, table
from .q_parsing import _checkpoints, _stream
from .q_refresh import _ACC, _CAND

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""SELECT CASE WHEN event_id % 3 > 0 THEN 'x' || user_id ELSE strftime(CAST(ts AS DATE), '%Y-%m-%d') END || '|t' || (event_id % 50) || '|' || event_type || '|' || (event_id % 4) || '|' || (event_id % 2) AS key, 1::BIGINT n FROM events GROUP BY 1""")
def stream_unique_activity(spark, d):
    """Activities come several times, some without a transaction; repeats of an identity within two months are dropped by the stream."""
    s = _stream(spark, d)
    own = s.select(F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("X"), "user_id")).alias("tx"), F.to_date("ts").alias("at"), F.concat(F.lit("t"), F.col("event_id") % 50).alias("token"), F.col("event_type").alias("side"), (F.col("event_id") % 4).alias("size"), (F.col("event_id") % 2).alias("price"), "ts")
    own = own.withColumn("key", ledger.activity_key(own))
    root = f"{_checkpoints(spark)}/activity-{uuid.uuid4().hex}"
    q = streams.unique_activity(own, "key", "ts", "60 days").select("key", "ts").writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("key string, ts timestamp").parquet(f"{root}/out").groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT user_id k FROM events")
def stream_unique_sink(spark, d):
    """A sink that holds every key once, however often batches are replayed."""
    root = f"{_checkpoints(spark)}/unique-{uuid.uuid4().hex}"
    for i in range(2):  # the second query replays everything
        streams.append_unique(_stream(spark, d).select(F.col("user_id").alias("k"), "event_id"), f"{root}/out", f"{root}/state{i}", "k").awaitTermination()
    return spark.read.parquet(f"{root}/out").select("k")


@query("""WITH x AS (SELECT event_id row_id, ts, date_diff('day', CAST(ts AS DATE), DATE '2024-01-31') age FROM events), y AS (SELECT *, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts DESC, row_id DESC) n FROM x WHERE age < 20) SELECT row_id FROM y WHERE age < 5 OR n <= 2""")
def snapshot_retention(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("row_id"), "ts")
    return streams.retained(e, "ts", "2024-01-31", 5, 20, 2).select("row_id")


_SEL = "SELECT event_id row_id, user_id k, CASE event_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE '' END side, CASE WHEN event_id % 7 > 0 THEN 1.5 + value / 100 END odds, date_trunc('DAY', ts) snapshot_time, date_trunc('DAY', ts) - INTERVAL 6 HOUR updated_at FROM events"


@query(f"""WITH r AS ({_SEL}), s AS (SELECT k, snapshot_time, updated_at, arg_min(1 / odds, row_id) FILTER (WHERE side = 'a') ap, arg_min(1 / odds, row_id) FILTER (WHERE side = 'b') bp FROM r WHERE side <> '' AND odds IS NOT NULL GROUP BY 1, 2, 3), o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY snapshot_time) i, row_number() OVER (PARTITION BY k ORDER BY snapshot_time DESC) j FROM s),
g AS (SELECT k, count(*) n_snapshots, max(ap) FILTER (WHERE i = 1) fa, max(bp) FILTER (WHERE i = 1) fb, max(ap) FILTER (WHERE j = 1) la, max(bp) FILTER (WHERE j = 1) lb FROM o GROUP BY 1)
SELECT k, n_snapshots, round(la, 6) a_prob, round(lb, 6) b_prob, round(la - lb, 6) diff_prob, 6.0 stale_hours, round(la - fa, 6) move_a, round(lb - fb, 6) move_b, round(abs(la - fa) + abs(lb - fb), 6) move_abs FROM g""")
def moneyline_snapshots(spark, d):
    out = P.moneyline_snapshots(run_sql(spark, d, _SEL), "k")
    return out.select(*[r6(c).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


_PROC = "SELECT l_orderkey * 10 + l_linenumber row_id, CASE WHEN l_orderkey % 211 > 0 THEN l_shipdate END event_date, l_suppkey % 50 a_id, CASE WHEN l_orderkey % 307 > 0 THEN l_partkey % 50 END b_id, CAST(l_quantity AS INT) % 3 target, l_tax * 12.6 x_share, l_discount * 1005 y_pct, l_quantity td_landed, l_quantity + l_partkey % 11 - 1 td_attempted FROM lineitem"


@query(f"""WITH x AS ({_PROC}), y AS (SELECT row_id, list_filter([CASE WHEN event_date IS NULL THEN 'no_date' END, CASE WHEN b_id IS NULL OR a_id = b_id THEN 'participants' END, CASE WHEN target = 2 THEN 'target' END, CASE WHEN x_share > 1 THEN 'x_share' END, CASE WHEN y_pct > 100 THEN 'y_pct' END, CASE WHEN td_landed > td_attempted THEN 'td_landed' END], lambda f: f IS NOT NULL) faults FROM x)
SELECT unnest(faults) fault, count(*) n, sum(row_id)::BIGINT ids FROM y GROUP BY 1""")
def processed_faults(spark, d):
    out = Q.named_faults(run_sql(spark, d, _PROC), "event_date", ("a_id", "b_id"), "target")
    return out.select("row_id", F.explode("faults").alias("fault")).groupBy("fault").agg(F.count(F.lit(1)).alias("n"), F.sum("row_id").alias("ids"))


_OLDR = "SELECT o_orderkey k FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01 00:00:00'"
_NEWR = "SELECT o_orderkey k, CASE o_orderkey % 6 WHEN 0 THEN 'W/L' WHEN 1 THEN 'L/W' WHEN 2 THEN 'D/D' WHEN 3 THEN 'W' WHEN 4 THEN 'NC/NC' ELSE 'L/L' END outcome, CASE WHEN o_orderkey % 7 = 0 THEN 'DQ' ELSE 'Decision' END method FROM orders"


@query(f"""WITH n AS (SELECT * FROM ({_NEWR}) z WHERE k NOT IN ({_OLDR})), c AS (SELECT CASE WHEN outcome = 'W' THEN 'unknown' WHEN outcome = 'L/L' THEN 'contradictory' WHEN outcome = 'D/D' THEN 'draw' WHEN outcome = 'NC/NC' THEN 'no_contest' WHEN method = 'DQ' THEN 'disqualification' ELSE 'normal' END kind FROM n)
SELECT kind, count(*) n, count(*) FILTER (WHERE kind = 'normal') n_targets, kind IN ('unknown', 'contradictory') quarantined FROM c GROUP BY 1""")
def incoming_results(spark, d):
    return Q.incoming_results(run_sql(spark, d, _OLDR), run_sql(spark, d, _NEWR), "k")


@query(f"""WITH a AS ({_ACC}), c AS ({_CAND}), x AS (SELECT za r, count(*) n FROM a za GROUP BY 1), y AS (SELECT zc r, count(*) n FROM c zc GROUP BY 1), p AS (SELECT coalesce(x.r, y.r) r, coalesce(x.n, 0) o, coalesce(y.n, 0) w FROM x FULL JOIN y ON x.r = y.r),
k AS (SELECT r.k, sum(o) o, sum(w) w, sum(greatest(w - o, 0)) more, sum(greatest(o - w, 0)) less FROM p GROUP BY 1), f AS (SELECT count(*) n FROM k WHERE CASE WHEN k IS NULL THEN more + less > 0 ELSE greatest(w - 1, 0) > greatest(o - 1, 0) OR (o > 1 AND (w < o OR less > 0)) END)
SELECT 'duplicates' report, n = 0 passed FROM f UNION ALL SELECT 'preserved', (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM c)) = 0 UNION ALL SELECT 'nothing_new', (SELECT count(*) FROM (SELECT * FROM c EXCEPT ALL SELECT * FROM a)) = 0 UNION ALL SELECT 'same_rows', (SELECT count(*) FROM a) = (SELECT count(*) FROM c)""")
def publication_bundle(spark, d):
    acc, cand = run_sql(spark, d, _ACC), run_sql(spark, d, _CAND)
    kept = lambda x, y: R.lost_occurrences(x, y).agg((F.count(F.lit(1)) == 0).alias("passed"))
    same = acc.agg(F.count(F.lit(1)).alias("a")).crossJoin(F.broadcast(cand.agg(F.count(F.lit(1)).alias("c")))).select((F.col("a") == F.col("c")).alias("passed"))  # one row beside one row
    return Q.publication_bundle({"duplicates": R.duplicate_report(acc, cand, F.col("k")), "preserved": kept(acc, cand), "nothing_new": kept(cand, acc), "same_rows": same})
