"""Views of the test tables as bouts, participant rows, quotes and predictions: once in Spark, once in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str) -> Column:
    """Six places: the engines' sums differ in the last bits."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def bouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bout for each order of two suppliers or more: the least and the largest supplier meet."""
    line = table(spark, sf_dir, "lineitem")
    side = line.groupBy("l_orderkey", "l_suppkey").agg(F.sum("l_quantity").alias("q"), F.avg("l_discount").alias("d"), F.count(F.lit(1)).alias("n"), F.min("l_returnflag").alias("flag"))
    who = F.struct(F.col("l_suppkey").alias("id"), "q", "d")
    met = side.groupBy("l_orderkey").agg(F.min(who).alias("a"), F.max(who).alias("b"), F.sum("n").alias("n_lines"), F.min("flag").alias("flag")).where("a.id <> b.id")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("event_date"), "o_orderpriority", "o_orderstatus", "o_totalprice")
    out = met.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    winner = F.when(F.col("a.q") > F.col("b.q"), F.col("a.id")).when(F.col("a.q") < F.col("b.q"), F.col("b.id"))
    method = F.when(F.col("flag") == "A", "KO/TKO").when(F.col("flag") == "N", "Decision - Unanimous").otherwise("Submission")
    return out.select(
        F.col("l_orderkey").alias("fight_id"), "event_date", F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"),
        F.col("a.q").alias("a_landed"), F.col("b.q").alias("b_landed"), F.col("a.d").alias("a_d"), F.col("b.d").alias("b_d"),
        F.col("o_orderpriority").alias("weight_class"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"),
        F.col("n_lines").cast("int").alias("n_rounds"), method.alias("method"), winner.alias("winner"),
    )


BOUTS = """
bout_side AS (SELECT l_orderkey, l_suppkey, sum(l_quantity) q, avg(l_discount) d, count(*) n, min(l_returnflag) flag FROM lineitem GROUP BY 1, 2),
bout_met AS (SELECT l_orderkey, min(l_suppkey) a_id, max(l_suppkey) b_id, arg_min(q, l_suppkey) a_landed, arg_max(q, l_suppkey) b_landed,
   arg_min(d, l_suppkey) a_d, arg_max(d, l_suppkey) b_d, CAST(sum(n) AS INTEGER) n_rounds, min(flag) flag
   FROM bout_side GROUP BY 1 HAVING min(l_suppkey) <> max(l_suppkey)),
bouts AS (SELECT l_orderkey fight_id, CAST(o_orderdate AS DATE) event_date, a_id, b_id, a_landed, b_landed, a_d, b_d, o_orderpriority weight_class,
   o_orderstatus status, o_totalprice price, n_rounds, CASE flag WHEN 'A' THEN 'KO/TKO' WHEN 'N' THEN 'Decision - Unanimous' ELSE 'Submission' END AS method,
   CASE WHEN a_landed > b_landed THEN a_id WHEN a_landed < b_landed THEN b_id END AS winner
   FROM bout_met JOIN orders ON o_orderkey = l_orderkey)"""

LONG = (
    BOUTS
    + """,
long AS (
  SELECT fight_id, event_date, 'a' side, a_id entity, b_id opponent, a_landed landed, b_landed opp_landed, weight_class, method, n_rounds,
    CASE WHEN winner = a_id THEN 'win' WHEN winner = b_id THEN 'loss' ELSE 'draw' END result FROM bouts
  UNION ALL
  SELECT fight_id, event_date, 'b', b_id, a_id, b_landed, a_landed, weight_class, method, n_rounds,
    CASE WHEN winner = b_id THEN 'win' WHEN winner = a_id THEN 'loss' ELSE 'draw' END FROM bouts)"""
)


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bookmaker's quote for each event: market = user, bookmaker = event type."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("quote_id"), F.col("user_id").alias("market"), F.col("event_type").alias("bookmaker"), F.col("ts").alias("snapshot_time"), (1 / (1 + F.col("value"))).alias("a_prob"), (1 - 1 / (1 + F.col("value"))).alias("b_prob"), F.datediff(F.lit("2024-02-01").cast("date"), F.to_date("ts")).alias("offset_days"), "value")


QUOTES = """
quotes AS (SELECT event_id quote_id, user_id market, event_type bookmaker, ts snapshot_time, 1 / (1 + value) a_prob, 1 - 1 / (1 + value) b_prob,
  date_diff('day', CAST(ts AS DATE), DATE '2024-02-01') offset_days, value FROM events)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model and market probabilities of both sides of each line, with its outcome."""
    li = table(spark, sf_dir, "lineitem")
    p, m = 0.05 + 9 * F.col("l_discount"), 0.1 + 10 * F.col("l_tax")
    return li.select(
        F.col("l_orderkey").alias("event_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("bout_id"), F.to_date("l_shipdate").alias("event_date"), p.alias("prob_a"), (1 - p).alias("prob_b"),
        m.alias("market_a"), (1 - m).alias("market_b"), (0.5 * p + 0.25).alias("second_a"), (0.75 - 0.5 * p).alias("second_b"),
        (F.col("l_suppkey") % 7).cast("int").alias("fights_a"), (F.col("l_partkey") % 7).cast("int").alias("fights_b"), (F.col("l_quantity") > 25).cast("int").alias("target"), F.col("l_linestatus").alias("slice"), F.col("l_extendedprice").alias("price"),
    )


PREDICTIONS = """
predictions AS (SELECT l_orderkey event_id, l_orderkey * 10 + l_linenumber bout_id, CAST(l_shipdate AS DATE) event_date, 0.05 + 9 * l_discount prob_a, 1 - (0.05 + 9 * l_discount) prob_b,
  0.1 + 10 * l_tax market_a, 1 - (0.1 + 10 * l_tax) market_b, 0.5 * (0.05 + 9 * l_discount) + 0.25 second_a, 0.75 - 0.5 * (0.05 + 9 * l_discount) second_b,
  CAST(l_suppkey % 7 AS INTEGER) fights_a, CAST(l_partkey % 7 AS INTEGER) fights_b, CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END target, l_linestatus slice, l_extendedprice price FROM lineitem)"""


def bets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A settled bet for each order: stake, profit, claimed edge, fill and closing price."""
    o = table(spark, sf_dir, "orders")
    stake = F.pmod(F.col("o_totalprice"), F.lit(50.0)) + 1
    won = F.col("o_orderstatus") == "F"
    odds = 1.5 + F.col("o_custkey") % 20 / 10
    return o.select(F.col("o_orderkey").alias("bet_id"), F.to_date("o_orderdate").alias("event_date"), F.col("o_orderpriority").alias("strategy"), stake.alias("stake"), odds.alias("odds"), won.cast("int").alias("won"), F.when(won, stake * (odds - 1)).otherwise(-stake).alias("pnl"), (F.col("o_custkey") % 11 / 100).alias("edge"), (1 / odds).alias("fill_prob"), (1 / odds + (F.col("o_orderkey") % 9 - 4) / 100).alias("close_prob"))


BETS = """
bets0 AS (SELECT o_orderkey bet_id, CAST(o_orderdate AS DATE) event_date, o_orderpriority strategy, o_totalprice % 50.0 + 1 stake, 1.5 + o_custkey % 20 / 10 odds,
  CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END won, o_custkey % 11 / 100 edge, o_orderkey FROM orders),
bets AS (SELECT bet_id, event_date, strategy, stake, odds, won, CASE WHEN won = 1 THEN stake * (odds - 1) ELSE -stake END pnl, edge, 1 / odds fill_prob,
  1 / odds + (o_orderkey % 9 - 4) / 100 close_prob FROM bets0)"""


def run_sql(spark: SparkSession, sf_dir: str, text: str, **views: DataFrame) -> DataFrame:
    """A fixture's SQL over the test tables and ``views``; the same text serves as a part of the oracle."""
    import re

    names = {m for m in re.findall(r"\b(?:FROM|JOIN)\s+([a-z_]+)\b", text)}
    text = text.replace("{", "{{").replace("}", "}}")  # braces of the text are no placeholders
    known = views | {n: table(spark, sf_dir, n) for n in names - views.keys() if n in TABLES}
    for n in known:
        text = re.sub(rf"\b(FROM|JOIN)(\s+){n}\b", rf"\1\2{{{n}}}", text)
    return spark.sql(text, **known)


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
