"""Careers outside the tracked organisation: debuts, eligible history and summaries at a date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def debuts(tracked: DataFrame) -> DataFrame:
    """First tracked date of an entity, else its first date of any kind."""
    return tracked.groupBy("entity").agg(F.coalesce(F.min(F.when(F.col("tracked"), F.col("event_date"))), F.min("event_date")).alias("debut"))


def before_debut(supplement: DataFrame, tracked: DataFrame) -> DataFrame:
    """Supplement rows strictly before the debut and not on a day with a tracked bout."""
    days = tracked.where("tracked").select("entity", "event_date").distinct()
    return supplement.join(debuts(tracked), "entity", "left").where(F.col("debut").isNull() | (F.col("event_date") < F.col("debut"))).join(days, ["entity", "event_date"], "left_anti")


def summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and rates on wins; the three method patterns may overlap, so rates need not sum to one."""
    won = F.col("result") == "win"
    m = F.lower("method")
    hit = lambda p: F.sum(F.when(won & m.rlike(p), 1).otherwise(0))
    wins = F.sum(F.when(won, 1).otherwise(0))
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("fights"), wins.cast("long").alias("wins"), F.sum(F.when(F.col("result") == "loss", 1).otherwise(0)).cast("long").alias("losses"), F.try_divide(hit("ko|tko"), wins).alias("ko_rate"), F.try_divide(hit("sub"), wins).alias("sub_rate"), F.try_divide(hit("dec"), wins).alias("dec_rate"), F.min("tier").alias("best_tier")
    )


def summary_at(rows: DataFrame, asks: DataFrame) -> DataFrame:
    """Wins and losses of an entity strictly before each asked date, by one running sum."""
    from pyspark.sql import Window

    a = asks.select("entity", F.col("as_of").alias("t"), F.lit(0).alias("k"), "ask_id", F.lit(None).cast("string").alias("result"))
    r = rows.select("entity", F.col("event_date").alias("t"), F.lit(1).alias("k"), F.lit(None).cast(asks.schema["ask_id"].dataType).alias("ask_id"), "result")
    w = Window.partitionBy("entity").orderBy("t", "k").rowsBetween(Window.unboundedPreceding, -1)
    n = lambda x: F.coalesce(F.sum(F.when(F.col("result") == x, 1)).over(w), F.lit(0)).cast("long").alias(n_ := {"win": "wins", "loss": "losses"}[x])  # noqa: E731, F841
    return a.unionByName(r).select("entity", "k", "ask_id", n("win"), n("loss")).where("k = 0").drop("k")


def ambiguous_names(rows: DataFrame) -> DataFrame:
    """Name keys that stand for more than one id."""
    return rows.groupBy("name_key").agg(F.count_distinct("id").alias("n_ids")).where("n_ids > 1")
