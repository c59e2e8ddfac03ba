"""Deduplication, conflict rules, field-level merges and version comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pair_key(a: str, b: str) -> Column:
    return F.concat_ws("#", F.array_sort(F.array(F.col(a).cast("string"), F.col(b).cast("string"))))


def keep_best(df: DataFrame, keys: list[Column | str], rank: list[Column]) -> DataFrame:
    """One row a key: the first by ``rank``."""
    w = Window.partitionBy(*keys).orderBy(*rank)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def collapse_bouts(rows: DataFrame) -> DataFrame:
    """Two passes: by (entity, day, ordered opponent key), then by the flat one; the best tier survives."""
    tier = [F.asc_nulls_last("tier"), F.asc("row_id")]
    return keep_best(keep_best(rows, ["entity", "day", "opp_key"], tier), ["entity", "day", "flat_key"], tier)


def reconcile(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row a bout: methods that differ become null, results that differ drop the bout."""
    # least and largest tell whether values differ; counting distinct ones would copy every row twice more
    ends = [f(c).alias(n) for c in ("method", "result") for f, n in ((F.min, c), (F.max, f"__{c}"))]
    g = rows.groupBy(*keys).agg(*ends, F.count(F.lit(1)).alias("n_rows"))
    out = g.where("result is null or result = __result").withColumn("method", F.when(F.col("method") == F.col("__method"), F.col("method")))
    return out.select(*keys, "method", "result", "n_rows")


def keep_last_source(frames: list[DataFrame], keys: list[str], order: Column) -> DataFrame:
    """Union of sources of rising priority; the last of a key wins."""
    out = None
    for i, f in enumerate(frames):
        f = f.withColumn("priority", F.lit(i))
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    return keep_best(out, keys, [F.desc("priority"), order])


def merge_fields(old: DataFrame, new: DataFrame, keys: list[str], prefer_new: list[str], prefer_old: list[str]) -> DataFrame:
    """All keys of both; each field from its preferred side where that knows it."""
    o, n = old.alias("o"), new.alias("n")
    cond = None
    for k in keys:
        c = F.col(f"o.{k}") == F.col(f"n.{k}")
        cond = c if cond is None else cond & c
    pick = [F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in prefer_new] + [F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c) for c in prefer_old]
    source = F.when(F.col(f"o.{keys[0]}").isNull(), "new").when(F.col(f"n.{keys[0]}").isNull(), "old").otherwise("both")
    return o.join(n, cond, "full").select(*[F.coalesce(F.col(f"o.{k}"), F.col(f"n.{k}")).alias(k) for k in keys], *pick, source.alias("source"))


def field_overlap(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Per field over shared keys: both known, equal, only old, only new."""
    x = old.alias("o").join(new.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"))
    items = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"o.{f}").cast("string").alias("a"), F.col(f"n.{f}").cast("string").alias("b")) for f in fields])
    x = x.select(F.explode(items).alias("x")).select("x.*")
    one = lambda c: F.sum(F.when(c, 1).otherwise(0)).alias
    a, b = F.col("a").isNotNull(), F.col("b").isNotNull()
    return x.groupBy("field").agg(F.count(F.lit(1)).alias("n_keys"), one(a & b)("both_known"), one(a & b & (F.col("a") == F.col("b")))("equal"), one(a & ~b)("only_old"), one(~a & b)("only_new"))


def version_diff(old: DataFrame, new: DataFrame, key: str, pair: str, day: str) -> DataFrame:
    """Status of each target between two versions: unchanged, rescheduled (same pair, other key), added or removed."""
    o, n = old.select(F.col(key).alias("k"), F.col(pair).alias("p"), F.col(day).alias("d")), new.select(F.col(key).alias("k"), F.col(pair).alias("p"), F.col(day).alias("d"))
    both = o.alias("o").join(n.alias("n"), "k", "full").select("k", F.coalesce("n.p", "o.p").alias("p"), F.col("o.d").alias("old_day"), F.col("n.d").alias("new_day"))
    same = both.where("old_day is not null and new_day is not null").select("k", "p", "old_day", "new_day", F.when(F.col("old_day") == F.col("new_day"), "unchanged").otherwise("rescheduled").alias("status"))
    gone, come = both.where("new_day is null"), both.where("old_day is null")
    w = Window.partitionBy("p").orderBy("k")
    gone, come = gone.withColumn("i", F.row_number().over(w)), come.withColumn("i", F.row_number().over(w))
    moved = gone.alias("g").join(come.alias("c"), (F.col("g.p") == F.col("c.p")) & (F.col("g.i") == F.col("c.i")), "full")
    moved = moved.select(F.coalesce("c.k", "g.k").alias("k"), F.coalesce("c.p", "g.p").alias("p"), F.col("g.old_day").alias("old_day"), F.col("c.new_day").alias("new_day"))
    status = F.when(F.col("old_day").isNull(), "added").when(F.col("new_day").isNull(), "removed").otherwise("rescheduled")
    return same.unionByName(moved.withColumn("status", status))


def row_changes(accepted: DataFrame, candidate: DataFrame) -> DataFrame:
    """Multiset difference both ways: rows lost and rows new."""
    return accepted.exceptAll(candidate).withColumn("change", F.lit("lost")).unionByName(candidate.exceptAll(accepted).withColumn("change", F.lit("new")))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def append_unique(old: DataFrame, new: DataFrame, key: str, order: Column) -> DataFrame:
    """Old rows as they are and the first new row of each unknown key."""
    fresh = keep_best(new.join(old.select(key), key, "left_anti"), [key], [order])
    return old.unionByName(fresh.select(*old.columns))
