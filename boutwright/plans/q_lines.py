"""Queries of price lines and overlays."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import lines as P
from ..sources import line_store
from .fixtures import BOUTS, QUOTES, bouts, quotes, r6, run_sql, table
from .q_parsing import _checkpoints

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Two to four quotes of every bout at different offsets, some the other way round, some impossible; as SQL that both engines read.
_N = 4
_ODDS = " UNION ALL ".join(
    f"""SELECT fight_id * {_N} + {i} row_id, event_date, CASE WHEN (fight_id + {i}) % 3 = 0 THEN b_id ELSE a_id END a_id, CASE WHEN (fight_id + {i}) % 3 = 0 THEN a_id ELSE b_id END b_id, CAST({7 - 2 * i} AS INT) offset_days, CAST(fight_id % 5 AS INT) query_date,
 CASE WHEN (fight_id + {i}) % 19 = 0 THEN NULL ELSE CAST(16 + (fight_id * 7 + {i} * 13) % 40 AS DOUBLE) / 64 END a_prob, CASE WHEN (fight_id + {i}) % 19 = 0 THEN NULL ELSE CAST(48 - (fight_id * 7 + {i} * 13) % 40 AS DOUBLE) / 64 END b_prob,
 CASE WHEN fight_id % 10 = 0 THEN 1.06 ELSE 1 + (fight_id % 9) / 4.0 END a_odds, CASE WHEN fight_id % 10 = 0 THEN 1.06 WHEN fight_id % 10 <> 1 THEN 3.5 - (fight_id % 4) END b_odds FROM bouts"""
    + (f" WHERE fight_id % {_N} >= {i - 1}" if i > 1 else "")
    for i in range(_N)
)


def _odds(spark, d):
    b = bouts(spark, d)
    return spark.sql(_ODDS.replace("FROM bouts", "FROM {b}"), b=b)


_OD = f"{BOUTS}, od AS ({_ODDS})"


@query(f"WITH {_OD} SELECT offset_days, count(*) n FROM od WHERE NOT coalesce(a_odds <= 1 OR b_odds <= 1 OR (abs(a_odds - b_odds) <= 1e-12 AND a_odds < 2 AND 2 / a_odds > 1.2), false) OR a_odds IS NULL OR b_odds IS NULL GROUP BY 1")
def valid_moneylines(spark, d):
    return P.valid_moneyline(_odds(spark, d)).groupBy("offset_days").agg(F.count(F.lit(1)).alias("n"))


_MOVES = f"""{_OD}, o1 AS (SELECT *, least(a_id, b_id) lo, greatest(a_id, b_id) hi, first_value(a_id) OVER w fa, count(*) OVER (PARTITION BY event_date, least(a_id, b_id), greatest(a_id, b_id)) n FROM od WINDOW w AS (PARTITION BY event_date, least(a_id, b_id), greatest(a_id, b_id) ORDER BY offset_days DESC, query_date, row_id)),
o2 AS (SELECT *, CASE WHEN a_id = fa THEN a_prob ELSE b_prob END p FROM o1 WHERE n >= 2), o3 AS (SELECT *, row_number() OVER w i, p - lag(p) OVER w dp FROM o2 WHERE p IS NOT NULL WINDOW w AS (PARTITION BY event_date, lo, hi ORDER BY offset_days DESC, query_date, row_id)),
o4 AS (SELECT event_date, lo, hi, any_value(fa) a_id, any_value(n) num_snapshots, count(*) k, arg_min(p, i) op, arg_max(p, i) cp, count(dp) >= 2 AND (coalesce(bool_and(dp > 0.005), false) OR coalesce(bool_and(dp < -0.005), false)) steam FROM o3 GROUP BY 1, 2, 3),
mv AS (SELECT event_date, a_id, CASE WHEN a_id = lo THEN hi ELSE lo END b_id, CASE WHEN k >= 2 THEN op END open_prob, CASE WHEN k >= 2 THEN cp END current_prob, CASE WHEN k >= 2 THEN cp - op END line_movement, CASE WHEN k >= 2 THEN steam::INT END line_steam_move, num_snapshots FROM o4)"""
_L6 = "round(line_movement, 6) line_movement, round(abs(line_movement), 6) line_abs_movement, (abs(line_movement) > 0.05)::INT line_is_sharp, line_steam_move, (line_movement > 0.02)::INT line_direction_toward_a, (line_movement < -0.02)::INT line_direction_toward_b"


@query(f"WITH {_MOVES} SELECT event_date, a_id, b_id, round(open_prob, 6) open_prob, round(current_prob, 6) current_prob, {_L6}, num_snapshots FROM mv")
def pair_movement(spark, d):
    out = P.pair_movement(_odds(spark, d))
    return out.select(*[r6(c).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


@query(f"WITH {_MOVES}, ja AS (SELECT fight_id, CASE WHEN m.a_id = b.a_id THEN line_movement ELSE -line_movement END line_movement, line_steam_move FROM bouts b LEFT JOIN mv m ON b.event_date = m.event_date AND least(b.a_id, b.b_id) = least(m.a_id, m.b_id) AND greatest(b.a_id, b.b_id) = greatest(m.a_id, m.b_id)) SELECT fight_id, {_L6} FROM ja")
def movement_attached(spark, d):
    out = P.attach_movement(bouts(spark, d), P.pair_movement(_odds(spark, d)))
    return out.select("fight_id", r6("line_movement").alias("line_movement"), r6("line_abs_movement").alias("line_abs_movement"), *P.LINE[2:])


@query(f"""WITH {QUOTES}, mn AS (SELECT market, date_trunc('hour', snapshot_time) t, avg(a_prob) p FROM quotes GROUP BY 1, 2), st AS (SELECT *, row_number() OVER w i, p - lag(p) OVER w dp FROM mn WINDOW w AS (PARTITION BY market ORDER BY t)),
g AS (SELECT market, count(*) n_points, arg_min(p, i) op, arg_max(p, i) cp, max(abs(dp)) ms, count(dp) >= 2 AND (coalesce(bool_and(dp > 0.005), false) OR coalesce(bool_and(dp < -0.005), false)) steam, date_diff('hour', min(t), max(t))::DOUBLE h FROM st GROUP BY 1),
x AS (SELECT *, CASE WHEN n_points >= 2 THEN cp - op END line_movement, CASE WHEN n_points >= 2 THEN steam::INT END line_steam_move FROM g)
SELECT market, n_points, CASE WHEN n_points >= 2 THEN round(op, 6) END open_prob, CASE WHEN n_points >= 2 THEN round(cp, 6) END current_prob, CASE WHEN n_points >= 2 THEN round(ms, 6) END max_step, {_L6}, CASE WHEN n_points >= 2 THEN h END hours_tracked FROM x""")
def snapshot_movement(spark, d):
    out = P.snapshot_movement(quotes(spark, d).withColumn("snapshot_time", F.date_trunc("hour", "snapshot_time").cast("timestamp_ntz")), "market")
    return out.select(*[r6(c).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


@query(f"""WITH {_OD}, w AS (SELECT *, least(a_id, b_id) lo, greatest(a_id, b_id) hi FROM od WHERE offset_days >= 5 QUALIFY row_number() OVER (PARTITION BY event_date, least(a_id, b_id), greatest(a_id, b_id) ORDER BY offset_days DESC, query_date DESC, row_id DESC) = 1)
SELECT fight_id, round(CASE WHEN w.a_id = b.a_id THEN a_prob ELSE b_prob END, 6) a_prob, round(CASE WHEN w.a_id = b.a_id THEN b_prob ELSE a_prob END, 6) b_prob FROM bouts b LEFT JOIN w ON w.event_date = b.event_date AND lo = least(b.a_id, b.b_id) AND hi = greatest(b.a_id, b.b_id)""")
def opening_overlay(spark, d):
    return P.opening_overlay(bouts(spark, d).select("fight_id", "event_date", "a_id", "b_id"), _odds(spark, d)).select("fight_id", r6("a_prob").alias("a_prob"), r6("b_prob").alias("b_prob"))


_METHODS = ", ".join(f"CASE WHEN (row_id + {i}) % 7 <> 0 THEN ((row_id * {i + 3}) % 50) / 100.0 END {c}" for i, c in enumerate(P.METHODS))


@query(f"""WITH {_OD}, me AS (SELECT row_id, event_date, a_id, b_id, {_METHODS} FROM od), w AS (SELECT *, least(a_id, b_id) lo, greatest(a_id, b_id) hi FROM me QUALIFY row_number() OVER (PARTITION BY event_date, least(a_id, b_id), greatest(a_id, b_id) ORDER BY row_id DESC) = 1)
SELECT fight_id, {', '.join(f"round(CASE WHEN w.a_id = b.a_id THEN {c} ELSE {('b' if c[0] == 'a' else 'a') + c[1:]} END, 6) {c}" for c in P.METHODS)} FROM bouts b LEFT JOIN w ON w.event_date = b.event_date AND lo = least(b.a_id, b.b_id) AND hi = greatest(b.a_id, b.b_id)""")
def method_overlay(spark, d):
    """Six method probabilities of the last row of each bout key, turned to the bout's sides."""
    rows = _odds(spark, d).selectExpr("row_id", "event_date", "a_id", "b_id", *_METHODS.split(", CASE")[:1], *["CASE" + x for x in _METHODS.split(", CASE")[1:]])
    out = P.overlay_sides(bouts(spark, d).select("fight_id", "event_date", "a_id", "b_id"), rows, [F.desc("row_id")], list(P.METHODS[:3]))
    return out.select("fight_id", *[r6(c).alias(c) for c in P.METHODS])


@query("""WITH x AS (SELECT o_orderkey k, CASE WHEN o_orderkey % 4 > 0 THEN o_custkey % 9 END::DOUBLE r, CASE WHEN o_orderkey % 5 > 0 THEN o_custkey % 7 END::DOUBLE s, o_orderkey % 3 > 0 has, CASE WHEN o_orderkey % 2 = 0 THEN 'v1' END own, CASE WHEN o_custkey % 4 > 0 THEN o_custkey % 9 + o_orderkey % 2 END::DOUBLE nr, (o_custkey % 6)::DOUBLE ns FROM orders),
y AS (SELECT *, has AND own IS NOT NULL mine, CASE WHEN has THEN nr END n1, CASE WHEN has THEN ns END n2 FROM x)
SELECT k, CASE WHEN mine THEN n1 ELSE coalesce(r, n1) END r, CASE WHEN mine THEN n2 ELSE coalesce(s, n2) END s, CASE WHEN mine THEN (CASE WHEN r IS NULL AND s IS NULL THEN '{}' WHEN r IS NULL THEN '{"s":' || s || '}' WHEN s IS NULL THEN '{"r":' || r || '}' ELSE '{"r":' || r || ',"s":' || s || '}' END) END legacy_values,
 CASE WHEN mine THEN (CASE WHEN coalesce(r <> n1, false) AND coalesce(s <> n2, false) THEN '["r","s"]' WHEN coalesce(r <> n1, false) THEN '["r"]' WHEN coalesce(s <> n2, false) THEN '["s"]' ELSE '[]' END) END legacy_conflicts FROM y""")
def observed_overlay(spark, d):
    k, p = F.col("o_orderkey"), F.col("o_custkey")
    o = table(spark, d, "orders")
    frame = o.select(k.alias("k"), F.when(k % 4 > 0, p % 9).cast("double").alias("r"), F.when(k % 5 > 0, p % 7).cast("double").alias("s"))
    seen = o.where(k % 3 > 0).select(k.alias("k"), F.when(k % 2 == 0, "v1").alias("policy"), F.when(p % 4 > 0, p % 9 + k % 2).cast("double").alias("r"), (p % 6).cast("double").alias("s"))
    return P.observed_overlay(frame, seen, "k", ["r", "s"], "policy")


_OUT = "oc AS (SELECT l_orderkey k, CASE WHEN l_linenumber % 2 = 0 THEN 'a' ELSE 'b' END side, CASE l_partkey % 4 WHEN 0 THEN 'ko' WHEN 1 THEN 'sub' WHEN 2 THEN 'dec' ELSE 'other' END AS method, CASE WHEN l_suppkey % 5 = 0 THEN 0.0 WHEN l_suppkey % 2 = 0 THEN 100.0 + l_quantity ELSE -100.0 - l_quantity END price, l_linestatus ls FROM lineitem), ip AS (SELECT *, CASE WHEN price > 0 THEN 100 / (price + 100) WHEN price < 0 THEN -price / (-price + 100) END p FROM oc)"
_AVG = ", ".join(f"avg(p) FILTER (WHERE side = '{c[0]}' AND method = '{c[2:-5]}') {c}" for c in P.METHODS)


def _outcomes(spark, d):
    q = F.col("l_quantity")
    method = F.element_at(F.array(*[F.lit(x) for x in ("ko", "sub", "dec", "other")]), (F.col("l_partkey") % 4 + 1).cast("int"))
    price = F.when(F.col("l_suppkey") % 5 == 0, 0.0).when(F.col("l_suppkey") % 2 == 0, 100 + q).otherwise(-100 - q)
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.when(F.col("l_linenumber") % 2 == 0, "a").otherwise("b").alias("side"), method.alias("method"), price.alias("price"), F.col("l_linestatus").alias("ls"))


@query(f"WITH {_OUT} SELECT k, {', '.join(f'round({c}, 6) {c}' for c in P.METHODS)} FROM (SELECT k, {_AVG} FROM ip GROUP BY 1)")
def method_probabilities(spark, d):
    return P.method_probabilities(_outcomes(spark, d), "k").select("k", *[r6(c).alias(c) for c in P.METHODS])


@query(f"WITH {_OUT}, pt AS (SELECT k, ls, {_AVG} FROM ip GROUP BY 1, 2) SELECT k, {', '.join(f'round(avg({c}), 6) {c}' for c in P.METHODS)} FROM pt GROUP BY 1")
def methods_merged(spark, d):
    """Two captures of the same bouts (open and closed lines), merged."""
    return P.merged_methods(P.method_probabilities(_outcomes(spark, d), "k", "ls"), "k").select("k", *[r6(c).alias(c) for c in P.METHODS])


@query("""WITH h AS (SELECT event_id, user_id % 20 pair, concat(user_id % 20, '-', event_type) key, ts, CASE WHEN event_type <> 'signup' THEN date_trunc('day', ts) + INTERVAL 2 DAY END starts_at FROM events), p AS (SELECT pair, key, max(starts_at) s, max(ts) t FROM h GROUP BY 1, 2),
b AS (SELECT pair, key FROM p QUALIFY row_number() OVER (PARTITION BY pair ORDER BY s DESC NULLS LAST, t DESC NULLS LAST, key DESC) = 1) SELECT h.event_id, h.pair, h.key FROM h JOIN b ON h.pair = b.pair AND h.key = b.key""")
def latest_fight_key(spark, d):
    e = table(spark, d, "events")
    h = e.select("event_id", (F.col("user_id") % 20).alias("pair"), F.concat(F.col("user_id") % 20, F.lit("-"), "event_type").alias("key"), F.col("ts").alias("snapshot_time"), F.when(F.col("event_type") != "signup", F.date_trunc("day", "ts") + F.expr("INTERVAL 2 DAY")).alias("starts_at"))
    return P.latest_key(h, "pair", "key").select("event_id", "pair", "key")


@query(f"""WITH {_OD}, pick AS (SELECT least(a_id, b_id) lo, greatest(a_id, b_id) hi FROM bouts GROUP BY 1, 2 ORDER BY count(*) DESC, 1, 2 LIMIT 1)
SELECT event_date, offset_days, row_id, round(CASE WHEN a_id = lo THEN a_prob ELSE b_prob END, 6) prob, a_id <> lo turned FROM od JOIN pick ON least(a_id, b_id) = lo AND greatest(a_id, b_id) = hi""")
def pair_timeline(spark, d):
    """Timeline of the pair that meets most often."""
    b = bouts(spark, d)
    most = b.groupBy(F.least("a_id", "b_id").alias("lo"), F.greatest("a_id", "b_id").alias("hi")).count().orderBy(F.desc("count"), "lo", "hi").first()
    return P.timeline(_odds(spark, d), F.lit(most["lo"]), F.lit(most["hi"])).withColumn("prob", r6("prob"))


@query("SELECT event_id FROM events WHERE ts <= TIMESTAMP '2024-01-10 23:59:59.999999' AND user_id % 2 = 0 UNION ALL SELECT event_id FROM events WHERE ts <= TIMESTAMP '2024-01-10 12:30:00' AND user_id % 2 = 1")
def as_of_cutoff(spark, d):
    """A bare date holds to the end of its day, a time to itself."""
    e = table(spark, d, "events")
    cut = F.when(F.col("user_id") % 2 == 0, "2024-01-10").otherwise("2024-01-10T12:30:00")
    return P.visible(e, cut, "ts").select("event_id")


_SAID = "SELECT event_id row_id, CASE WHEN event_id % 3 > 0 THEN concat('Ánn ', CAST(user_id % 40 AS VARCHAR(9))) ELSE concat('Bo-', CAST(event_id % 25 AS VARCHAR(9))) END fighter_a, CASE WHEN event_id % 3 = 0 THEN concat('ann ', CAST(user_id % 40 AS VARCHAR(9))) ELSE concat('Bo ', CAST(event_id % 25 AS VARCHAR(9))) END fighter_b, CAST(NULL AS VARCHAR(9)) event_id, date_trunc('MONTH', ts) + INTERVAL 40 DAY starts_at, ts snapshot_time, 1 / (1 + value) a_prob, value / (1 + value) b_prob, user_id % 40 x, event_id % 25 y FROM events"


@query(f"""WITH s AS ({_SAID}), p AS (SELECT x, y FROM s GROUP BY 1, 2 ORDER BY count(*) DESC, x, y LIMIT 1), h AS (SELECT s.* FROM s JOIN p ON p.x = s.x AND p.y = s.y WHERE snapshot_time < TIMESTAMP '2024-01-21 00:00:00')
SELECT row_id, snapshot_time, round(CASE WHEN row_id % 3 = 0 THEN b_prob ELSE a_prob END, 6) prob FROM h WHERE starts_at = (SELECT max(starts_at) FROM h)""")
def pair_line_history(spark, d):
    """All quotes stored in two batches, the first one twice; then the history of the pair that is quoted most, as of a day, from its bucket and days alone."""
    s = run_sql(spark, d, _SAID)
    top = s.groupBy("x", "y").count().orderBy(F.desc("count"), "x", "y").first()  # one pair is asked for
    root = f"{_checkpoints(spark)}/line-store-{uuid.uuid4().hex}"
    early = F.col("snapshot_time") < F.lit("2024-01-12").cast("timestamp_ntz")
    for part, batch in ((s.where(early), 0), (s.where(early), 0), (s.where(~early), 1)):
        line_store.save(part.drop("x", "y"), root, batch)
    got = line_store.line_history(spark, root, f"Ann {top['x']}", f"Bo {top['y']}", as_of="2024-01-20")
    return got.select("row_id", "snapshot_time", r6("a_prob").alias("prob"))
