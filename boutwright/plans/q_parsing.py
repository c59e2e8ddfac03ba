"""Queries of names, parsing, sources, careers, learning data and streams."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import scalars as S
from ..operators import careers as C
from ..operators import history as H
from ..operators import learning as L
from ..sources import payloads, tables
from ..streaming import streams
from .fixtures import BOUTS, LONG, PREDICTIONS, bouts, predictions, r6, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""SELECT l_orderkey k, l_linenumber n, CAST(l_quantity AS INTEGER)::DOUBLE landed, (CAST(l_quantity AS INTEGER) + 10)::DOUBLE attempted, CAST((l_linenumber - 1) * 300 + (l_partkey % 5) * 60 + l_suppkey % 60 AS INTEGER) "seconds",
 round(((5 + l_partkey % 2) * 12 + l_suppkey % 12) * 2.54, 2) height, round((60 + l_partkey % 20) * 2.54, 2) reach, CASE WHEN l_partkey % 2 = 0 THEN (CASE WHEN l_suppkey % 101 = 1 THEN 100 ELSE l_suppkey % 101 END)::DOUBLE ELSE round(l_discount * 100, 6) END pct,
 CASE l_orderkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 WHEN 2 THEN 1.0 END flag, CASE l_orderkey % 3 WHEN 0 THEN 'dec' WHEN 1 THEN 'sub' ELSE 'ko' END grp FROM lineitem""")
def parsed_figures(spark, d):
    k, p, s = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")
    q = F.col("l_quantity").cast("int")
    li = table(spark, d, "lineitem")
    of = F.concat_ws(" of ", q, q + 10)
    clock = F.concat(p % 5, F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))
    height = F.concat(5 + p % 2, F.lit("' "), s % 12, F.lit('"'))
    pct = F.when(p % 2 == 0, F.concat(s % 101, F.lit("%"))).otherwise(F.col("l_discount").cast("string"))
    flag = F.when(k % 4 == 0, " Yes").when(k % 4 == 1, "FALSE").when(k % 4 == 2, "1").otherwise("--")
    method = F.when(k % 3 == 0, "Decision - Split").when(k % 3 == 1, "SUB Choke").otherwise("KO/TKO")
    return li.select(k.alias("k"), F.col("l_linenumber").alias("n"), S.landed(of).alias("landed"), S.attempted(of).alias("attempted"), S.total_seconds(F.col("l_linenumber"), clock).alias("seconds"), S.height_cm(height).alias("height"), S.reach_cm(F.concat(60 + p % 20, F.lit('"'))).alias("reach"), r6(S.percent(pct)).alias("pct"), S.nullable_binary(flag).alias("flag"), S.method_group(method).alias("grp"))


@query(r"""WITH c AS (SELECT c_custkey, lower(c_name) n FROM customer), k AS (SELECT c_custkey, trim(regexp_replace(n, '[^a-z0-9]+', ' ', 'g')) key FROM c)
SELECT c_custkey, key name_key, list_aggregate(list_sort(string_split(key, ' ')), 'string_agg', ' ') sorted_key, contains(' ' || key || ' report ', ' ' || key || ' ') appears FROM k""")
def name_keys(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", N.normalise(F.col("c_name")).alias("name_key"), N.sorted_tokens(F.col("c_name")).alias("sorted_key"), N.appears_in(F.col("c_name"), F.concat("c_name", F.lit(" Report."))).alias("appears"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) k, CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) > 50 THEN 'high' ELSE 'low' END level FROM events""")
def json_flatten(spark, d):
    k = F.from_json("props", "k long")["k"]
    return table(spark, d, "events").select("event_id", k.alias("k"), F.when(k > 50, "high").otherwise("low").alias("level"))


@query(r"""SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1, 's') title, regexp_extract(html, '<html[^>]*\blang="([^"]*)"', 1) page_lang, CAST(len(regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"', 1)) AS INTEGER) n_links, CAST(len(regexp_extract_all(html, '<p[ >]')) AS INTEGER) n_paragraphs FROM pages""")
def html_figures(spark, d):
    return payloads.page_figures(table(spark, d, "pages").select("page_id", "html"), "html").drop("html")


@query("""WITH e AS (SELECT event_id, value v, event_type t FROM events)
SELECT CAST(event_id AS VARCHAR) id, t bookmaker, 'ann' a_name, 'Bob' b_name, 1.5 + v / 100 a_odds, 2.5 b_odds, round((1 / (1.5 + v / 100)) / (1 / (1.5 + v / 100) + 0.4), 6) a_fair FROM e""")
def odds_payload(spark, d):
    e = table(spark, d, "events")
    side = lambda n, p: F.struct(F.lit(n).alias("name"), p.alias("price"))
    market = lambda key, xs: F.struct(F.lit(key).alias("key"), F.array(*xs).alias("outcomes"))
    h2h = market("h2h", [side("Bob", F.lit(2.5)), side("ann", 1.5 + F.col("value") / 100)])
    other = market("totals", [side("Over", F.lit(1.9)), side("Under", F.lit(1.9))])
    book = F.struct(F.col("event_type").alias("key"), F.array(h2h, other).alias("markets"))
    ev = F.struct(F.col("event_id").cast("string").alias("id"), F.lit("2024-02-01T00:00:00Z").alias("commence_time"), F.lit("Bob").alias("home_team"), F.lit("ann").alias("away_team"), F.array(book).alias("bookmakers"))
    return payloads.odds_rows(e.select(F.to_json(F.array(ev)).alias("p")), "p").select("id", "bookmaker", "a_name", "b_name", "a_odds", "b_odds", r6("a_fair").alias("a_fair"))


@query()
def selection_tree(spark, d):
    """Irregular trees by a Python table function: rows only."""
    e = table(spark, d, "events").select("event_id", "props")
    tree = payloads.SelectionTree(F.col("props").outer())
    return e.lateralJoin(tree).select("event_id", "path", "name", "value")


_TRACK = f"""{LONG}, tr AS (SELECT entity, event_date, event_date >= DATE '1998-01-01' AND method <> 'Submission' tracked FROM long), sp AS (SELECT fight_id, entity, event_date, result, method, CAST(fight_id % 3 + 1 AS INTEGER) tier FROM long)"""


def _supplement(spark, d):
    long = H.long_rows(bouts(spark, d))
    f = F.col("fight_id")
    tracked = long.select("entity", "event_date", F.expr("event_date >= DATE '1998-01-01' AND method <> 'Submission'").alias("tracked"))
    extra = long.select("fight_id", "entity", "event_date", "result", "method", (f % 3 + 1).cast("int").alias("tier"))
    return tracked, extra


@query(f"""WITH {_TRACK}, db AS (SELECT entity, coalesce(min(event_date) FILTER (WHERE tracked), min(event_date)) debut FROM tr GROUP BY 1)
SELECT sp.fight_id, sp.entity FROM sp LEFT JOIN db ON sp.entity = db.entity WHERE (debut IS NULL OR sp.event_date < debut) AND NOT EXISTS (SELECT 1 FROM tr WHERE tr.tracked AND tr.entity = sp.entity AND tr.event_date = sp.event_date)""")
def debut_cutoff(spark, d):
    tracked, extra = _supplement(spark, d)
    return C.before_debut(extra, tracked).select("fight_id", "entity")


@query(f"""WITH {_TRACK} SELECT entity, count(*) fights, CAST(sum(CASE WHEN result = 'win' THEN 1 ELSE 0 END) AS BIGINT) wins, CAST(sum(CASE WHEN result = 'loss' THEN 1 ELSE 0 END) AS BIGINT) losses,
 round(sum(CASE WHEN result = 'win' AND lower(method) LIKE '%ko%' THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN result = 'win' THEN 1 ELSE 0 END), 0), 6) ko_rate, round(sum(CASE WHEN result = 'win' AND lower(method) LIKE '%sub%' THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN result = 'win' THEN 1 ELSE 0 END), 0), 6) sub_rate,
 round(sum(CASE WHEN result = 'win' AND lower(method) LIKE '%dec%' THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN result = 'win' THEN 1 ELSE 0 END), 0), 6) dec_rate, min(tier) best_tier FROM sp GROUP BY 1""")
def career_summary(spark, d):
    out = C.summary(_supplement(spark, d)[1], ["entity"])
    return out.select("entity", "fights", "wins", "losses", *[r6(c).alias(c) for c in ("ko_rate", "sub_rate", "dec_rate")], "best_tier")


@query(f"""WITH {_TRACK}, q AS (SELECT fight_id ask_id, entity, event_date FROM long)
SELECT q.entity, ask_id, CAST(coalesce(sum(CASE WHEN result = 'win' THEN 1 ELSE 0 END), 0) AS BIGINT) wins, CAST(coalesce(sum(CASE WHEN result = 'loss' THEN 1 ELSE 0 END), 0) AS BIGINT) losses FROM q LEFT JOIN sp ON sp.entity = q.entity AND sp.event_date < q.event_date GROUP BY 1, 2""")
def summary_at_date(spark, d):
    asks = H.long_rows(bouts(spark, d)).select("entity", F.col("event_date").alias("as_of"), F.col("fight_id").alias("ask_id"))
    return C.summary_at(_supplement(spark, d)[1], asks).select("entity", "ask_id", "wins", "losses")


@query("""WITH r AS (SELECT lower(c_mktsegment) || (c_custkey % 50) name_key, c_nationkey id FROM customer) SELECT name_key, count(DISTINCT id) n_ids FROM r GROUP BY 1 HAVING count(DISTINCT id) > 1""")
def ambiguous_names(spark, d):
    return C.ambiguous_names(table(spark, d, "customer").select(F.concat(F.lower("c_mktsegment"), (F.col("c_custkey") % 50).cast("string")).alias("name_key"), F.col("c_nationkey").alias("id")))


@query(f"""WITH {BOUTS}, f AS (SELECT fight_id, a_landed, b_landed, a_landed - b_landed diff_landed, CASE WHEN winner = a_id THEN 1 ELSE 0 END target FROM bouts)
SELECT fight_id, a_landed, b_landed, diff_landed, target, 0 mirror FROM f UNION ALL SELECT fight_id, b_landed, a_landed, -diff_landed, 1 - target, 1 FROM f""")
def mirror_augment(spark, d):
    b = bouts(spark, d).select("fight_id", "a_landed", "b_landed", (F.col("a_landed") - F.col("b_landed")).alias("diff_landed"), F.coalesce((F.col("winner") == F.col("a_id")).cast("int"), F.lit(0)).alias("target"))
    return L.mirrored(b)


@query(f"""WITH {PREDICTIONS}, c AS (SELECT event_date, count(*) n FROM predictions GROUP BY 1), t AS (SELECT event_date, coalesce(sum(n) OVER (ORDER BY event_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) b FROM c),
k AS (SELECT min(event_date) cut FROM t WHERE b >= 0.8 * (SELECT count(*) FROM predictions)) SELECT CASE WHEN event_date >= cut THEN 'test' ELSE 'train' END split, count(*) n, min(event_date) first_day FROM predictions, k GROUP BY 1""")
def temporal_holdout(spark, d):
    out = L.temporal_holdout(predictions(spark, d), ["event_date"])
    return out.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("event_date").alias("first_day"))


@query("""WITH x AS (SELECT l_orderkey k, l_linenumber n, CASE WHEN l_partkey % 5 <> 0 THEN l_quantity END q, CASE WHEN l_suppkey % 3 <> 0 THEN l_tax END t FROM lineitem)
SELECT k, n, round(coalesce(q, (SELECT median(q) FROM x)), 6) q_filled, round(coalesce(t, (SELECT median(t) FROM x)), 6) t_filled, CAST(q IS NULL AS INTEGER) q_missing, CAST(t IS NULL AS INTEGER) t_missing FROM x""")
def median_imputation(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.when(F.col("l_partkey") % 5 != 0, F.col("l_quantity")).alias("q"), F.when(F.col("l_suppkey") % 3 != 0, F.col("l_tax")).alias("t"))
    return L.impute(x, ["q", "t"]).select("k", "n", r6("q_filled").alias("q_filled"), r6("t_filled").alias("t_filled"), "q_missing", "t_missing")


@query(f"""WITH {PREDICTIONS} SELECT bout_id, round((prob_a + 1 - prob_b) / 2, 6) p FROM predictions""")
def symmetrised_score(spark, d):
    return predictions(spark, d).select("bout_id", r6(L.symmetrised(F.col("prob_a"), F.col("prob_b"))).alias("p"))


@query(f"""WITH {PREDICTIONS}, lim AS (SELECT date_trunc('year', min(event_date)) a, max(event_date) b FROM predictions), f AS (SELECT CAST(unnest(generate_series(a::TIMESTAMP, b::TIMESTAMP, INTERVAL 6 MONTH)) AS DATE) fold_start FROM lim),
g AS (SELECT fold_start, CAST(fold_start + INTERVAL 6 MONTH AS DATE) fold_end FROM f) SELECT fold_start, fold_end, count(*) n FROM g JOIN predictions p ON p.event_date >= fold_start AND p.event_date < fold_end GROUP BY 1, 2""")
def walk_forward_folds(spark, d):
    first, last = predictions(spark, d).agg(F.trunc(F.min("event_date"), "year"), F.max("event_date")).first()
    f = L.folds(str(first), str(last), spark)
    per = predictions(spark, d).groupBy("event_date").count()  # days, not rows, meet the folds
    return per.join(F.broadcast(f), (F.col("event_date") >= F.col("fold_start")) & (F.col("event_date") < F.col("fold_end"))).groupBy("fold_start", "fold_end").agg(F.sum("count").alias("n"))


def _stream(spark, d, columns=("event_id", "ts", "user_id", "event_type", "value"), files=4):
    """Events as a stream of several files, one a batch, each with rows of all days in no order."""
    e = table(spark, d, "events")
    root = f"{_checkpoints(spark)}/feed-{uuid.uuid4().hex}"
    e.repartition(files, F.xxhash64("event_id")).write.parquet(root)
    return streams.quote_stream(spark, root, e.schema).select(*columns)


@query("""SELECT CAST(to_timestamp(floor(epoch(ts) / 3600) * 3600) AT TIME ZONE 'UTC' AS TIMESTAMP) window_start, event_type, count(*) n, arg_min(value, (ts, event_id)) open_price, arg_max(value, (ts, event_id)) close_price FROM events GROUP BY 1, 2""")
def stream_tumbling(spark, d):
    out = streams.tumbling(_stream(spark, d), "ts", "event_type", "1 hour", "60 days")
    got = streams.run_to_files(spark, out, f"{_checkpoints(spark)}/tumbling-{uuid.uuid4().hex}")
    return got.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""SELECT user_id, arg_min(value, (ts, event_id)) opening, min(ts) seen_at FROM events GROUP BY 1""")
def stream_first_seen(spark, d):
    got = streams.run_to_files(spark, streams.first_seen(_stream(spark, d), "user_id", "ts", "value"), f"{_checkpoints(spark)}/first-{uuid.uuid4().hex}")
    return got.withColumn("seen_at", F.col("seen_at").cast("timestamp_ntz"))


def _checkpoints(spark) -> str:
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if not folder and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return folder or tempfile.mkdtemp(prefix="boutwright-streams-")


@query("""WITH t AS (SELECT event_date, 'x' x, pnl FROM (SELECT CAST(o_orderdate AS DATE) event_date, o_totalprice pnl FROM orders)) SELECT year(event_date)::INTEGER AS "year", round(sum(pnl), 2) total FROM t GROUP BY 1""")
def published_totals(spark, d):
    """Through an atomic publication and back."""
    o = table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    root = f"{_checkpoints(spark)}/published-{uuid.uuid4().hex}"
    tables.publish(spark, {"totals": o}, root)
    return tables.read_published(spark, root, "totals")
