"""Quotes, consensus, line movement, phases and the joins that attach them to bouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


def consensus(quotes: DataFrame, key: str) -> DataFrame:
    """Mean prices and how many quotes a market has (rows, not distinct books), with its first book by quote id."""
    out = quotes.groupBy(key).agg(F.avg("a_prob").alias("a_avg"), F.avg("b_prob").alias("b_avg"), F.count(F.lit(1)).alias("num_quotes"), F.min_by("bookmaker", "quote_id").alias("first_book"))
    return out.withColumn("a_fair", S.no_vig(F.col("a_avg"), F.col("b_avg")))


def opening_closing(quotes: DataFrame, key: str, entry_days: int) -> DataFrame:
    """Opening (largest offset), closing (least) and entry (least that is at least ``entry_days``) price of a market."""
    at = F.struct("offset_days", "quote_id")
    late = F.when(F.col("offset_days") >= entry_days, at)
    return quotes.groupBy(key).agg(
        F.max_by("a_prob", at).alias("open_prob"), F.min_by("a_prob", at).alias("close_prob"), F.min_by(F.when(late.isNotNull(), F.col("a_prob")), late).alias("entry_prob"), F.min(late)["offset_days"].alias("entry_offset")
    )


def line_movement(points: DataFrame, key: str, order: list[str], prob: str = "a_prob", steam_step: float = 0.005) -> DataFrame:
    """Open, current, movement, largest step, steam (two or more steps, all one way), sharp and direction of each series."""
    w = Window.partitionBy(key).orderBy(*order)
    steps = points.where(F.col(prob).isNotNull()).select(key, prob, (F.col(prob) - F.lag(prob).over(w)).alias("d"), F.row_number().over(w).alias("i"))
    up, down = F.coalesce(F.every(F.col("d") > steam_step), F.lit(False)), F.coalesce(F.every(F.col("d") < -steam_step), F.lit(False))
    out = steps.groupBy(key).agg(F.count(F.lit(1)).alias("n_points"), F.min_by(prob, "i").alias("open_prob"), F.max_by(prob, "i").alias("current_prob"), F.max(F.abs("d")).alias("max_step"), ((F.count("d") >= 2) & (up | down)).alias("steam"))
    known, move = F.col("n_points") >= 2, F.col("current_prob") - F.col("open_prob")
    return out.select(key, "n_points", *[F.when(known, x).alias(n) for n, x in (("open_prob", F.col("open_prob")), ("current_prob", F.col("current_prob")), ("movement", move), ("max_step", F.col("max_step")), ("steam", F.col("steam")), ("sharp", F.abs(move) > 0.05), ("direction", S.movement_direction(move)))])


def phase_snapshots(quotes: DataFrame, key: str, phase: Column, phases: list[str]) -> DataFrame:
    """Per market and phase: first time, distinct books and mean price, one grouped pass for all phases."""
    own = quotes.withColumn("__p", phase)
    aggs = []
    for p in phases:
        here = F.col("__p") == p
        aggs += [F.min(F.when(here, F.col("snapshot_time"))).alias(f"{p}_time"), F.count_distinct(F.when(here, F.col("bookmaker"))).alias(f"{p}_books"), F.avg(F.when(here, F.col("a_prob"))).alias(f"{p}_prob")]
    return own.groupBy(key).agg(*aggs)


def history_health(quotes: DataFrame, key: str) -> DataFrame:
    n = quotes.groupBy(key).agg(F.count_distinct("snapshot_time").alias("times"), F.count(F.lit(1)).alias("rows"))
    return n.withColumn("healthy", F.col("times") >= 2)


def with_previous_day(left: DataFrame, right: DataFrame, key: str, day: str, signals: list[str]) -> DataFrame:
    """Left join on (key, day) where a right row also serves the day before; richest signals win, then the exact day."""
    exact = right.withColumn("__pri", F.lit(0))
    shifted = right.withColumn(day, F.date_sub(day, 1)).withColumn("__pri", F.lit(1))
    rich = sum((F.col(s).isNotNull().cast("int") for s in signals), F.lit(0))
    best = exact.unionByName(shifted).groupBy(key, day).agg(F.max_by(F.struct(*signals, F.col("__pri").alias("shifted")), F.struct(rich, -F.col("__pri"))).alias("__x"))
    return left.join(best, [key, day], "left").select(left["*"], "__x.*")


def overlay_reoriented(bouts: DataFrame, odds: DataFrame, rank: list[Column]) -> DataFrame:
    """Attach one odds row a (date, unordered pair), picked by ``rank``; prices swap where the sides do."""
    pair = lambda df: df.withColumn("__lo", F.least("a_id", "b_id")).withColumn("__hi", F.greatest("a_id", "b_id"))
    w = Window.partitionBy("event_date", "__lo", "__hi").orderBy(*rank)
    one = pair(odds).withColumn("__n", F.row_number().over(w)).where("__n = 1").select("event_date", "__lo", "__hi", F.col("a_id").alias("__oa"), F.col("a_price").alias("__pa"), F.col("b_price").alias("__pb"))
    out = pair(bouts).join(one, ["event_date", "__lo", "__hi"], "left")
    same = F.col("__oa") == F.col("a_id")
    return out.withColumn("a_price", F.when(same, F.col("__pa")).otherwise(F.col("__pb"))).withColumn("b_price", F.when(same, F.col("__pb")).otherwise(F.col("__pa"))).drop("__lo", "__hi", "__oa", "__pa", "__pb")


def layered_price(df: DataFrame) -> DataFrame:
    """entry over opening over requested over closing. The entry layer asks for both sides, the others for side a alone, and each sets both."""
    entry = F.col("entry_a").isNotNull() & F.col("entry_b").isNotNull()
    layers = [(entry, "entry"), (F.col("opening_a").isNotNull(), "opening"), (F.col("requested_a").isNotNull(), "requested"), (F.col("closing_a").isNotNull(), "closing")]

    def pick(f) -> Column:
        out = None
        for cond, name in layers:
            out = F.when(cond, f(name)) if out is None else out.when(cond, f(name))
        return out

    return df.withColumn("a_market", pick(lambda n: F.col(f"{n}_a"))).withColumn("b_market", pick(lambda n: F.col(f"{n}_b"))).withColumn("odds_source", pick(F.lit))


def book_summary(df: DataFrame, bids: str, asks: str) -> DataFrame:
    """Best bid and ask, spread, depth and notional of arrays of (price, size)."""
    best_bid = F.array_max(F.transform(bids, lambda x: x["price"]))
    best_ask = F.array_min(F.transform(asks, lambda x: x["price"]))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x["price"] * x["size"])
    return df.withColumn("best_bid", best_bid).withColumn("best_ask", best_ask).withColumn("spread", best_ask - best_bid).withColumn("bid_notional", total(bids)).withColumn("ask_notional", total(asks)).withColumn("n_levels", F.size(bids) + F.size(asks))


def fair_clv(bets: DataFrame, times: DataFrame, key: str, enough: int = 80) -> DataFrame:
    """Closing-line value over bets whose market has two snapshots or more."""
    ok = times.where("times >= 2").select(key)
    v = S.closing_line_value(F.col("fill_prob"), F.col("close_prob"))
    return bets.join(ok, key, "left_semi").agg(F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean_clv"), F.median(v).alias("median_clv"), F.avg((v > 0).cast("double")).alias("positive_share")).withColumn("sufficient", F.col("n") >= enough)
