"""Queries of scans and sinks: payload files, bout files, odds sources, snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import lines as P
from ..operators import selection as B
from ..functions import scalars as S
from ..sources import payloads, tables
from .fixtures import BOUTS, PREDICTIONS, bouts, predictions, quotes, r6, run_sql, table
from .q_parsing import _checkpoints

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""SELECT o_orderkey k, CAST(o_orderkey AS VARCHAR) event_id, 'Ann ' || (o_custkey % 50) a_name, CASE WHEN o_orderkey % 7 > 0 THEN 'Bo' ELSE '' END b_name, CAST(o_orderdate AS TIMESTAMP) starts_at, CASE WHEN o_orderkey % 7 > 0 THEN 'ann ' || (o_custkey % 50) || '__bo__' || strftime(o_orderdate, '%Y-%m-%d') ELSE '' END fight_key FROM orders""")
def event_payloads(spark, d):
    o = table(spark, d, "orders")
    name = lambda c: F.struct(c.alias("name"))
    ev = F.struct(F.col("o_orderkey").cast("string").alias("id"), name(F.concat(F.lit("Ann "), F.col("o_custkey") % 50)).alias("home"), name(F.when(F.col("o_orderkey") % 7 > 0, "Bo").otherwise("")).alias("away"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).cast("string").alias("time"))
    out = payloads.event_rows(o.select(F.col("o_orderkey").alias("k"), F.to_json(F.struct(F.array(ev).alias("results"))).alias("p")), "p", "upcoming")
    return out.select("k", "event_id", "a_name", "b_name", F.col("starts_at").cast("timestamp_ntz").alias("starts_at"), "fight_key")


_SUM = "SELECT event_id k, concat('{\"results\":{\"', event_type, '\":{\"matching_dir\":1,\"odds_update\":{\"162_1\":\"', CAST(1700000000 + event_id AS VARCHAR(19)), '\",\"162_2\":\"1600000000\"},\"odds\":{\"start\":{\"162_1\":{\"id\":\"', CAST(event_id AS VARCHAR(19)), '\",\"home_od\":\"1.5\",\"away_od\":', CASE WHEN event_id % 3 = 0 THEN '\"-\"' ELSE '\"2.25\"' END, ',\"add_time\":\"1700000000\"},\"162_3\":{\"id\":\"9\"}},\"end\":{\"162_3\":{\"over_od\":\"1.75\",\"under_od\":\"2.0\",\"handicap\":\"2.5\"}}}}}}') p FROM events"


@query("""SELECT event_id k, event_type bookmaker, 1 matching_dir, 'start' market_phase, '162_1' market_key, CAST(event_id AS VARCHAR) line_id, 1.5 home_odds, CASE WHEN event_id % 3 > 0 THEN 2.25 END away_odds, NULL::DOUBLE over_odds, NULL handicap, TIMESTAMP '2023-11-14 22:13:20' added_at, TIMESTAMP '2023-11-14 22:13:20' + event_id * INTERVAL 1 SECOND updated_at FROM events
UNION ALL SELECT event_id, event_type, 1, 'end', '162_3', NULL, NULL, NULL, 1.75, '2.5', NULL, TIMESTAMP '2023-11-14 22:13:20' + event_id * INTERVAL 1 SECOND FROM events""")
def summary_payloads(spark, d):
    out = payloads.summary_rows(run_sql(spark, d, _SUM), "p", "k")
    return out.select("k", "bookmaker", "matching_dir", "market_phase", "market_key", "line_id", "home_odds", "away_odds", "over_odds", "handicap", F.col("added_at").cast("timestamp_ntz").alias("added_at"), F.col("updated_at").cast("timestamp_ntz").alias("updated_at"))


#: Payloads as they come: a market whose odds are a list, one that is a selection, a list of selections, a nested tree, an unpriced selection and a block that is no group.
_PRE = (
    "SELECT event_id k, concat('{\"success\":1,\"results\":[{\"FI\":\"', CAST(event_id AS VARCHAR(19)), '\",\"event_id\":', CAST(user_id AS VARCHAR(19)), "
    "',\"main\":{\"sp\":{\"fight_lines\":{\"id\":\"9\",\"name\":\"Fight Lines\",\"odds\":[{\"id\":1,\"name\":\"A\",\"odds\":\"', CAST(1 + event_id % 8 AS VARCHAR(9)), '.5\"},{\"id\":2,\"name\":\"B\",\"header\":\"To Win\",\"odds\":\"n/a\"},{\"id\":3,\"name\":\"no price\"}]},\"to_win\":{\"id\":4,\"name\":\"C\",\"odds\":1.25}}},"
    "\"schedule\":{\"sp\":{\"main\":[{\"id\":5,\"name\":\"A\",\"odds\":\"3.0\"},{\"id\":6,\"name\":\"B\",\"odds\":\"1.4\"}]}},', "
    "CASE WHEN event_id % 2 = 0 THEN '\"others\":[{\"sp\":{\"rounds\":{\"deep\":{\"id\":\"x\",\"handicap\":2.5,\"odds\":\"2.0\"}}}},{\"sp\":{\"method\":{\"odds\":[{\"id\":7,\"name\":\"KO\",\"odds\":\"4\"}]}}},null]' ELSE '\"others\":{\"sp\":{\"rounds\":{\"deep\":{\"id\":\"x\",\"handicap\":2.5,\"odds\":\"2.0\"}}}}' END, "
    "',\"extra\":{\"sp\":{\"none\":{\"id\":8,\"name\":\"Z\",\"odds\":2}}}}]}') p FROM events"
)


@query("""WITH e AS (SELECT event_id k, CAST(event_id AS VARCHAR) fi, CAST(user_id AS VARCHAR) event_id, CAST(1 + event_id % 8 AS DOUBLE) + 0.5 o, event_id % 2 = 0 even FROM events)
SELECT k, fi, event_id, 'main' market_group, 'fight_lines' market_name, '1' selection_id, 'A' selection_name, '' header, '' handicap, o decimal_odds FROM e UNION ALL SELECT k, fi, event_id, 'main', 'fight_lines', '2', 'B', 'To Win', '', NULL FROM e
UNION ALL SELECT k, fi, event_id, 'main', 'to_win', '4', 'C', '', '', 1.25 FROM e UNION ALL SELECT k, fi, event_id, 'schedule', 'main', '5', 'A', '', '', 3.0 FROM e UNION ALL SELECT k, fi, event_id, 'schedule', 'main', '6', 'B', '', '', 1.4 FROM e
UNION ALL SELECT k, fi, event_id, 'others', 'rounds.deep', 'x', '', '', '2.5', 2.0 FROM e UNION ALL SELECT k, fi, event_id, 'others', 'method', '7', 'KO', '', '', 4.0 FROM e WHERE even""")
def prematch_selections(spark, d):
    """Selections of irregular market trees by a Python table function."""
    p = run_sql(spark, d, _PRE)
    return p.lateralJoin(payloads.Selections(F.col("p").outer())).drop("p")


@query("""SELECT 'f' || (o_orderkey % 50) || '.json' file, count(*) n, sum(o_totalprice)::DECIMAL(18, 2)::DOUBLE total, o_orderkey % 50 < 25 enveloped FROM orders GROUP BY 1, 4""")
def raw_json_files(spark, d):
    """A folder of raw payload files, half of them in an envelope with metadata, written and scanned."""
    o = table(spark, d, "orders").groupBy((F.col("o_orderkey") % 50).alias("f")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total"))
    own = F.to_json(F.struct("n", "total"))
    text = F.when(F.col("f") < 25, F.concat(F.lit('{"payload":'), own, F.lit(',"metadata":{"by":"test"}}'))).otherwise(own)
    root = f"{_checkpoints(spark)}/raw-{uuid.uuid4().hex}"
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    for r in o.select("f", text.alias("t")).collect():  # fifty files
        path = fs.Path(f"{root}/f{r['f']}.json")
        out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
        out.write(bytearray(r["t"].encode()))
        out.close()
    got = payloads.raw_files(spark, root)
    return got.select("file", F.get_json_object("payload", "$.n").cast("bigint").alias("n"), F.get_json_object("payload", "$.total").cast("double").alias("total"), F.col("metadata").isNotNull().alias("enveloped"))


_CSV = "SELECT fight_id, CASE WHEN fight_id % 3 = 0 THEN CAST(event_date AS VARCHAR(10)) WHEN fight_id % 3 = 1 THEN concat(CAST(month(event_date) AS VARCHAR(2)), '/', CAST(day(event_date) AS VARCHAR(2)), '/', CAST(year(event_date) AS VARCHAR(4))) ELSE '--' END dd, concat('p', CAST(a_id AS VARCHAR(9))) ra, concat('p', CAST(b_id AS VARCHAR(9))) bb, CASE WHEN winner = a_id THEN (CASE WHEN fight_id % 2 = 0 THEN 'Red' ELSE concat('p', CAST(a_id AS VARCHAR(9))) END) WHEN winner = b_id THEN (CASE WHEN fight_id % 2 = 0 THEN 'Blue' ELSE concat('p', CAST(b_id AS VARCHAR(9))) END) ELSE '' END w, CAST(a_id % 40 AS VARCHAR(9)) pct, CASE WHEN fight_id % 5 = 0 THEN 'True' WHEN fight_id % 5 = 1 THEN '0' ELSE '--' END tb FROM bouts"


@query(f"""WITH {BOUTS} SELECT fight_id, event_date, 'p' || a_id fighter_a, 'p' || b_id fighter_b, CASE WHEN winner = a_id THEN 1 WHEN winner = b_id THEN 0 END target, CASE WHEN a_id % 40 <= 1 THEN a_id % 40 * 100 ELSE a_id % 40 END::DOUBLE a_str_acc, 182.88 a_height, 193.04 b_reach, CASE fight_id % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 END title_bout FROM bouts WHERE fight_id % 3 < 2""")
def bout_file_scan(spark, d):
    """A CSV with other column names, written and scanned with parsers and target."""
    raw = run_sql(spark, d, _CSV, bouts=bouts(spark, d))
    root = f"{_checkpoints(spark)}/bouts-{uuid.uuid4().hex}"
    out = raw.select("fight_id", F.col("dd").alias("Date"), F.col("ra").alias("R_fighter"), F.col("bb").alias("Blue Fighter"), F.col("w").alias("Winner"), F.concat("pct", F.lit("%")).alias("R_avg_SIG_STR_pct"), F.lit("6' 0\"").alias("R_Height"), F.lit('76"').alias("B_Reach"), F.col("tb").alias("Title Bout"))
    out.write.csv(root, header=True, quoteAll=True, escape='"')
    cols = ", ".join(f"`{c}` string" for c in out.columns)
    got = tables.bouts_of(spark.read.csv(root, schema=cols, header=True, escape='"'))
    return got.select(F.col("fight_id").cast("bigint").alias("fight_id"), "event_date", "fighter_a", "fighter_b", "target", "a_str_acc", "a_height", "b_reach", "title_bout")


_SRC = {"legacy": (0, 1), "bfo": (1, 2), "bfo_recovered": (2, 3), "odds_api": (3, 5)}
_SRCQ = {k: f"SELECT fight_id * 10 + {i} row_id, event_date, CAST(fight_id % 3 AS INT) offset_days, concat('P', CAST(a_id AS VARCHAR(9))) a_name, concat('Q', CAST(b_id AS VARCHAR(9))) b_name, CASE WHEN fight_id % 11 = {i} THEN 1.06 ELSE CAST(1.5 + {i} AS DOUBLE) END a_odds, CASE WHEN fight_id % 11 = {i} THEN 1.06 ELSE CAST(2.5 AS DOUBLE) END b_odds, CAST('2020-01-0{i + 1}' AS VARCHAR(10)) query_date FROM bouts WHERE fight_id % {m} = 0" for k, (i, m) in _SRC.items()}


@query(f"""WITH {BOUTS}, u AS ({' UNION ALL '.join(f"SELECT *, {i} p, '{k}' source_kind FROM ({q}) z{i}" for i, (k, q) in enumerate(_SRCQ.items()))}), v AS (SELECT * FROM u WHERE NOT (a_odds = 1.06 AND b_odds = 1.06))
SELECT row_id, source_kind, offset_days * 24.0 hours_to_start, source_kind = 'odds_api' AND offset_days > 0 verified_prefight FROM v QUALIFY row_number() OVER (PARTITION BY event_date, lower(a_name), lower(b_name), offset_days ORDER BY p DESC, row_id DESC) = 1""")
def historical_odds(spark, d):
    """Four sources by priority, with provenance; impossible favourites are left out first."""
    b = bouts(spark, d)
    out = tables.historical_odds({k: run_sql(spark, d, q, bouts=b).withColumn("a_odds", F.col("a_odds").cast("double")).withColumn("b_odds", F.col("b_odds").cast("double")) for k, q in _SRCQ.items()})
    return out.select("row_id", "source_kind", "hours_to_start", "verified_prefight")


@query("""SELECT user_id market, arg_min(value, (ts, event_id)) opening, count(*) n, CAST(count(DISTINCT CAST(ts AS DATE)) AS BIGINT) AS "days" FROM events GROUP BY 1""")
def snapshot_sink(spark, d):
    """Quotes saved in two passes by day, with the opening line of every market at its first sight."""
    e = table(spark, d, "events").select(F.col("user_id").alias("market"), F.col("ts").alias("at"), "value", F.col("event_id").alias("row_id"))
    root = f"{_checkpoints(spark)}/snapshots-{uuid.uuid4().hex}"
    cut = "timestamp_ntz'2024-01-12 00:00:00'"
    for i, part in enumerate((e.where(f"at < {cut}"), e.where(f"at < {cut}"), e.where(f"at >= {cut}"))):
        tables.save_snapshot(part, root, "market", "at", max(0, i - 1))  # the first pass is repeated
    saved = tables.saved_snapshots(spark, root, e.schema).groupBy("market").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("day").alias("days"))
    return saved.join(tables.saved_openings(spark, root, e.schema).select("market", F.col("value").alias("opening")), "market")


@query(f"""WITH {PREDICTIONS}, q AS (SELECT bout_id, 'verified' kind, CASE WHEN bout_id % 3 > 0 THEN 'f' END file, CASE WHEN bout_id % 4 > 0 THEN event_date END observed_at, bout_id % 60 AS "hours", prob_a + 0.05 prob FROM predictions) SELECT bout_id FROM q WHERE file IS NOT NULL AND observed_at IS NOT NULL AND "hours" >= 24 AND prob > 0 AND prob < 1""")
def verified_entries(spark, d):
    p = predictions(spark, d)
    rows = p.select("bout_id", F.lit("verified").alias("kind"), F.when(F.col("bout_id") % 3 > 0, "f").alias("file"), F.when(F.col("bout_id") % 4 > 0, F.col("event_date")).alias("observed_at"), (F.col("bout_id") % 60).alias("hours"), (F.col("prob_a") + 0.05).alias("prob"))
    return B.verified_entry(rows, 24).select("bout_id")


@query("""WITH x AS (SELECT l_orderkey * 10 + l_linenumber id, CASE WHEN l_linenumber % 2 = 0 THEN 'a' ELSE 'b' END side, CAST(l_partkey % 11 - 5 AS DOUBLE) / 64 m, CASE WHEN l_partkey % 5 = 0 THEN 1 ELSE 0 END sharp, CASE WHEN l_suppkey % 7 = 0 THEN 1 END steam, CAST(l_suppkey % 16 AS DOUBLE) / 128 edge, 1.5 + CAST(l_partkey % 5 AS DOUBLE) / 4 odds FROM lineitem),
y AS (SELECT *, CASE WHEN side = 'a' THEN m < -0.02 ELSE m > 0.02 END against, CASE WHEN odds <= 2 THEN 0.02 ELSE 0.02 + 0.02 * (odds - 2) END need FROM x) SELECT CASE WHEN against AND edge < need + 0.02 THEN 'line_against' WHEN against AND (sharp = 1 OR coalesce(steam, 0) = 1) THEN 'sharp_against' ELSE 'accepted' END reason, side, count(*) n, sum(id)::BIGINT ids FROM y GROUP BY 1, 2""")
def line_gates(spark, d):
    c = F.col
    x = table(spark, d, "lineitem").select((c("l_orderkey") * 10 + c("l_linenumber")).alias("id"), F.when(c("l_linenumber") % 2 == 0, "a").otherwise("b").alias("side"), ((c("l_partkey") % 11 - 5).cast("double") / 64).alias("line_movement"), F.when(c("l_partkey") % 5 == 0, 1).otherwise(0).alias("line_is_sharp"), F.when(c("l_suppkey") % 7 == 0, 1).alias("line_steam_move"), ((c("l_suppkey") % 16).cast("double") / 128).alias("edge"), (1.5 + (c("l_partkey") % 5).cast("double") / 4).alias("odds"))
    reason = F.lit("accepted")
    for name, ok in reversed(B.line_gates()):
        reason = F.when(~ok, name).otherwise(reason)
    return x.groupBy(reason.alias("reason"), "side").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


@query("""SELECT l_orderkey k, l_linenumber n, CASE WHEN s < 1 THEN 0 ELSE round(s, 2) END stake FROM (SELECT *, 100 * greatest(0, least(0.25 * ((b * p - (1 - p)) / b), 0.04)) s FROM (SELECT l_orderkey, l_linenumber, CAST(l_partkey % 65 AS DOUBLE) / 64 p, 0.5 + CAST(l_suppkey % 16 AS DOUBLE) / 8 b FROM lineitem) x) y""")
def kelly_stakes(spark, d):
    p, o = (F.col("l_partkey") % 65).cast("double") / 64, 1.5 + (F.col("l_suppkey") % 16).cast("double") / 8
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), S.kelly_stake(p, o, F.lit(100.0)).alias("stake"))


@query("""WITH x AS (SELECT l_orderkey k, l_linenumber n, CAST(l_partkey % 5 AS DOUBLE) / 8 a, CASE WHEN l_suppkey % 7 > 0 THEN CAST(l_suppkey % 5 AS DOUBLE) / 8 END b FROM lineitem)
SELECT k, n, round(CASE WHEN a + b = 0 THEN 0.5 ELSE a / (a + b) END, 6) fair, round(CASE WHEN a > 0 AND b > 0 THEN a / (a + b) END, 6) strict FROM x""")
def fair_probabilities(spark, d):
    """The book's share taken out of two prices: a half where both are nothing, or unknown where either is (strict)."""
    a, b = (F.col("l_partkey") % 5).cast("double") / 8, F.when(F.col("l_suppkey") % 7 > 0, (F.col("l_suppkey") % 5).cast("double") / 8)
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.round(S.remove_vig(a, b), 6).alias("fair"), F.round(S.no_vig(a, b), 6).alias("strict"))
