"""Queries of streams that carry state over many files, of restarts and repeated passes, and of committed sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import learning as L
from ..sources import commits, tables
from ..streaming import streams, tracker
from .fixtures import bouts, predictions, r6, run_sql, table
from .q_parsing import SQL as _PARSING_SQL
from .q_parsing import _checkpoints
from .q_refresh import _CARD1, _CARD2
from .q_refresh import SQL as _REFRESH_SQL

QUERIES, SQL = {}, {}
SLICES = 6


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _arriving(spark, d) -> DataFrame:
    """Quotes of events with the slice they come in: by day, up to three days late, so neighbouring slices overlap."""
    e = table(spark, d, "events").select("event_id", F.col("user_id").alias("market"), F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("snapshot_time"), (1 / (1 + F.col("value"))).alias("a_prob"))
    day = F.datediff(F.to_date("snapshot_time"), F.lit("2024-01-01").cast("date")) + F.pmod(F.col("event_id") * 7919, F.lit(4))
    return e.withColumn("slice", F.least(F.greatest(F.floor(day / 6), F.lit(0)), F.lit(SLICES - 1)))


def _arrive(quotes: DataFrame, folder: str, slices: range) -> None:
    """Some slices as files, one slice after the other; rows of a slice stand in no order."""
    for i in slices:
        quotes.where(F.col("slice") == i).drop("slice").repartition(2, F.xxhash64("event_id")).write.mode("append").parquet(folder)


_FOLD = f"""SELECT y.market, y.kind, y.direction, y.k, y.snapshot_time, y.move, y.op, y.p, y.i, CASE WHEN abs(y.move) >= r.last + {tracker.AGAIN} THEN abs(y.move) ELSE r.last END, abs(y.move) >= r.last + {tracker.AGAIN}
  FROM r JOIN y ON y.market = r.market AND y.kind = r.kind AND y.direction = r.direction AND y.k = r.k + 1"""


@query(f"""WITH RECURSIVE q AS (SELECT user_id market, date_trunc('hour', ts) snapshot_time, CAST(floor(avg(1 / (1 + value)) * 1e6 + 0.5) AS BIGINT) p FROM events GROUP BY 1, 2),
c AS (SELECT * FROM q WHERE p IS NOT NULL AND snapshot_time < (SELECT max(snapshot_time) FROM q) - INTERVAL 4 DAY),
n AS (SELECT *, row_number() OVER w i, p - lag(p) OVER w d, first_value(p) OVER w op FROM c WINDOW w AS (PARTITION BY market ORDER BY snapshot_time)),
s AS (SELECT *, p - op move, CASE WHEN p - op > {tracker.DIRECTED} THEN 'toward_a' WHEN p - op < -{tracker.DIRECTED} THEN 'toward_b' ELSE 'stable' END direction, abs(p - op) > {tracker.SHARP} sharp,
  i >= 3 AND (min(d) OVER w > {tracker.STEADY} OR max(d) OVER w < -{tracker.STEADY}) steam FROM n WINDOW w AS (PARTITION BY market ORDER BY snapshot_time)),
x AS (SELECT *, 'sharp' kind FROM s WHERE sharp UNION ALL SELECT *, 'steam' FROM s WHERE steam), y AS (SELECT *, row_number() OVER (PARTITION BY market, kind, direction ORDER BY i) k FROM x),
r AS (SELECT market, kind, direction, k, snapshot_time, move, op, p, i, abs(move) AS last, true fired FROM y WHERE k = 1 UNION ALL {_FOLD})
SELECT market, snapshot_time, kind, direction, move / 1e6 movement, op / 1e6 opening, p / 1e6 AS "current", i n_snapshots FROM r WHERE fired""")
def stream_line_pass(spark, d):
    """Alerts of lines whose quotes come in six overlapping slices; the pass is stopped after three and goes on from its checkpoint."""
    quotes, root = _arriving(spark, d), f"{_checkpoints(spark)}/lines-{uuid.uuid4().hex}"
    for part in (range(SLICES // 2), range(SLICES // 2, SLICES)):
        _arrive(quotes, f"{root}/quotes", part)
        src = streams.quote_stream(spark, f"{root}/quotes", quotes.drop("slice").schema, files_per_batch=2)
        alerts = tracker.line_alerts(src, "market", "snapshot_time", "a_prob", "4 days")
        alerts.writeStream.format("parquet").option("path", f"{root}/alerts").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(alerts.schema).parquet(f"{root}/alerts").withColumn("snapshot_time", F.col("snapshot_time").cast("timestamp_ntz"))


@query("""WITH RECURSIVE m AS (SELECT event_type k, CAST(ts AS DATE) AS "day", max(value) magnitude FROM events GROUP BY 1, 2), y AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY "day") i FROM m),
r AS (SELECT k, "day", i, magnitude AS last, true fired FROM y WHERE i = 1 UNION ALL SELECT y.k, y."day", y.i, CASE WHEN y.magnitude >= r.last + 0.5 THEN y.magnitude ELSE r.last END, y.magnitude >= r.last + 0.5 FROM r JOIN y ON y.k = r.k AND y.i = r.i + 1)
SELECT k, "day", last magnitude FROM r WHERE fired""")
def stream_realerts(spark, d):
    """The largest value of each day and kind alerts when it has grown by a half since the kind's last alert; a file holds three days."""
    e = table(spark, d, "events").groupBy(F.col("event_type").alias("k"), F.to_date("ts").alias("day")).agg(F.max("value").alias("magnitude"))
    root = f"{_checkpoints(spark)}/realerts-{uuid.uuid4().hex}"
    first, last = e.agg(F.min("day"), F.max("day")).first()
    days = (last - first).days if last else -1
    for at in range(0, days + 1, 3):  # days of the month
        part = F.datediff("day", F.lit(first))
        e.where((part >= at) & (part < at + 3)).coalesce(1).write.mode("append").parquet(f"{root}/in")
    src = streams.quote_stream(spark, f"{root}/in", e.schema)
    out = streams.realerts(src, "k", "day", "magnitude", 0.5)
    out.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{root}/out")


#: A third, incomplete scan: bouts are missing, days move, sides turn, and bouts that the second scan left out come in.
_CARD3 = """SELECT CASE WHEN o_orderkey % 13 = 2 OR o_orderkey % 17 = 3 THEN o_orderkey + 100000000 ELSE o_orderkey END AS key, o_custkey % 97 event, CASE WHEN o_orderkey % 31 = 6 THEN CAST(o_orderdate AS DATE) + INTERVAL 7 DAY WHEN o_orderkey % 19 = 4 THEN CAST(o_orderdate AS DATE) + INTERVAL 3 DAY ELSE CAST(o_orderdate AS DATE) END dd,
 CASE WHEN o_orderkey % 37 = 7 THEN o_orderkey * 2 + 1 WHEN o_orderkey % 17 = 3 THEN o_orderkey * 2 + 900000001 WHEN o_orderkey % 43 = 9 THEN o_orderkey * 2 + 700000001 ELSE o_custkey * 2 END a_id, CASE WHEN o_orderkey % 37 = 7 THEN o_custkey * 2 ELSE o_orderkey * 2 + 1 END b_id FROM orders WHERE o_orderkey % 41 <> 8"""


def _changes_sql(old: str, new: str, complete: bool) -> str:
    sql = _REFRESH_SQL["card_changes"].replace(_CARD1, "@old").replace(_CARD2, "@new").replace("@old", old).replace("@new", new)
    return sql if complete else sql[: sql.rindex("UNION ALL")]


@query(f"""WITH x3 AS ({_changes_sql(_CARD2, _CARD3, False)}), n AS ({_CARD3}), o AS ({_CARD2})
SELECT 2 scan, * FROM ({_changes_sql(_CARD1, _CARD2, True)}) z UNION ALL SELECT 3, * FROM x3 UNION ALL SELECT 3, NULL, key, 'stands' FROM n UNION ALL SELECT 3, NULL, key, 'stands' FROM o WHERE key NOT IN (SELECT key FROM n) AND key NOT IN (SELECT old_key FROM x3 WHERE old_key IS NOT NULL)""")
def stream_card_monitor(spark, d):
    """Three scans of all cards, the third incomplete; the second is saved twice, and a second monitor replays what the first one did."""
    root = f"{_checkpoints(spark)}/cards-{uuid.uuid4().hex}"
    scans = [run_sql(spark, d, q).select("key", "event", F.to_date("dd").alias("day"), "a_id", "b_id", (F.col("event") % 20).cast("int").alias("days_to_event")) for q in (_CARD1, _CARD2, _CARD3)]
    for i in (1, 2, 2):
        tracker.save_scan(scans[i - 1], f"{root}/feed", i)
    tracker.monitor_cards(spark, f"{root}/feed", f"{root}/out", f"{root}/first").awaitTermination()
    tracker.save_scan(scans[2], f"{root}/feed", 3, complete=False)
    tracker.monitor_cards(spark, f"{root}/feed", f"{root}/out", f"{root}/second").awaitTermination()
    out = None
    for e in commits.entries(spark, f"{root}/out"):
        if e["batch"] > 1:
            part = commits.read_frame(spark, f"{root}/out", e, "changes").select(F.lit(e["batch"]).cast("int").alias("scan"), "old_key", "new_key", "change")
            out = part if out is None else out.unionByName(part)
    card = commits.read_frame(spark, f"{root}/out", e, "card").select(F.lit(3).alias("scan"), F.lit(None).cast("long").alias("old_key"), F.col("key").alias("new_key"), F.lit("stands").alias("change"))
    return out.unionByName(card)


@query(f"""WITH f AS ({_PARSING_SQL["walk_forward_folds"]}), s AS (SELECT count(*) folds, sum(n)::BIGINT rows, max(fold_end) last_end FROM f) SELECT 'fold' part, fold_start, fold_end, n FROM f UNION ALL SELECT 'summary', NULL, last_end, rows FROM s""")
def walk_forward_artifacts(spark, d):
    """Folds, summary and report of a walk-forward run as one version; the run dies before its report once and is repeated, and the version is written twice."""
    first, last = predictions(spark, d).agg(F.trunc(F.min("event_date"), "year"), F.max("event_date")).first()
    per = predictions(spark, d).groupBy("event_date").count()
    f = L.folds(str(first), str(last), spark)
    folds = per.join(F.broadcast(f), (F.col("event_date") >= F.col("fold_start")) & (F.col("event_date") < F.col("fold_end"))).groupBy("fold_start", "fold_end").agg(F.sum("count").alias("n"))
    root = f"{_checkpoints(spark)}/walk-forward-{uuid.uuid4().hex}"
    summary = folds.agg(F.max("fold_end").alias("fold_end"), F.sum("n").alias("n"))
    frames = {"folds": folds, "summary": summary, "report": summary.select(F.to_json(F.struct("*")).alias("report"))}
    dies = {"folds": folds, "report": summary.where("n < 0")}
    try:
        tables.publish(spark, dies, root, version=0)
    except ValueError:  # an empty report is refused, after the folds were written
        pass
    for _ in range(2):
        tables.publish(spark, frames, root, version=0)
    if sorted(e["note"]["names"] for e in commits.entries(spark, root)) != [sorted(frames)]:
        raise RuntimeError("more than one version stands")
    rows = tables.read_published(spark, root, "folds").select(F.lit("fold").alias("part"), "fold_start", "fold_end", "n")
    return rows.unionByName(tables.read_published(spark, root, "summary").select(F.lit("summary").alias("part"), F.lit(None).cast("date").alias("fold_start"), "fold_end", "n"))


@query("""SELECT CAST(o_orderpriority AS VARCHAR) weight_class, count(*) n, round(sum(o_totalprice), 2) total FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING min(l_suppkey) <> max(l_suppkey)) GROUP BY 1""")
def feature_matrix_sink(spark, d):
    """The bout frame saved as two versions, the second one with prices; readers get the second as a whole."""
    root = f"{_checkpoints(spark)}/matrix-{uuid.uuid4().hex}"
    b = bouts(spark, d)
    for cols in (("fight_id", "weight_class"), ("fight_id", "weight_class", "price")):
        tables.publish(spark, {"features": b.select(*cols)}, root)
    got = tables.read_published(spark, root, "features")
    return got.groupBy("weight_class").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("price"), 2).alias("total"))
