"""Changes of profiles between an accepted and a candidate table, each held against a log of decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _text(c: Column) -> Column:
    return F.coalesce(F.trim(c.cast("string")), F.lit(""))


def cell_hash(key: Column, field: Column, before: Column) -> Column:
    """What a decision was taken on: the cell and the value that stood there."""
    return F.sha2(F.concat_ws("\x1f", _text(key), _text(field), _text(before)), 256)


def standing(log: DataFrame) -> DataFrame:
    """The last decision of each cell (key, field) of the log, by seq; ``n_superseded`` earlier ones no longer count."""
    w = Window.partitionBy("key", "field")
    ranked = log.withColumn("__n", F.row_number().over(w.orderBy(F.desc("seq"), F.desc("status")))).withColumn("n_superseded", F.count(F.lit(1)).over(w) - 1)
    return ranked.where("__n = 1").drop("__n")


def changed_cells(accepted: DataFrame, candidate: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, field, before, after of cells that differ; a profile that is new counts with all its values. Keys stand once on either side."""

    def cells(df: DataFrame, out: str) -> DataFrame:
        return df.select(F.col(key).alias("key"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), _text(F.col(f)).alias(out)) for f in fields])).alias("x")).select("key", "x.*")

    both = cells(accepted, "before").join(cells(candidate, "after"), ["key", "field"], "right")
    return both.select("key", "field", F.coalesce("before", F.lit("")).alias("before"), "after").where("before <> after")


def assess(accepted: DataFrame, candidate: DataFrame, log: DataFrame, key: str, name: str, fields: list[str]) -> DataFrame:
    """key, field, before, after and verdict for every changed cell, name and missing or repeated profile.

    Rows of ``log``: key, field, seq, name, raw_value, safe_value, status and cell (``cell_hash`` of
    what was seen). Verdicts that let a change stand: ``accepted`` and ``current_only``. All others
    are issues: repeated_profile and missing_profile (of the accepted or the candidate table),
    name_changed, value_lost, no_decision, stale_decision (the accepted value is not the one that was
    decided on), other_name, other_value, unresolved, unsafe_value. A repeated profile is judged no
    further. The first that holds is the verdict, in this order.
    """
    once = lambda df: df.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(key)))
    old, new = once(accepted), once(candidate)
    repeated = [df.where("__n > 1").select(F.col(key).alias("key"), F.lit("").alias("field"), F.lit(s).alias("before"), F.lit("").alias("after"), F.lit("repeated_profile").alias("verdict")).distinct() for df, s in ((old, "accepted"), (new, "candidate"))]
    old, new = old.where("__n = 1"), new.where("__n = 1")
    gone = accepted.join(candidate.select(key), key, "left_anti").select(F.col(key).alias("key"), F.lit("").alias("field"), _text(F.col(name)).alias("before"), F.lit("").alias("after"), F.lit("missing_profile").alias("verdict")).distinct()
    names = changed_cells(old, new, key, [name]).join(old.select(F.col(key).alias("key")), "key", "left_semi")
    names = names.where(F.lower("before") != F.lower("after")).withColumn("field", F.lit("name")).withColumn("verdict", F.lit("name_changed"))
    cells = changed_cells(old, new, key, fields).join(new.select(F.col(key).alias("key"), _text(F.col(name)).alias("now")), "key")
    said = standing(log).select("key", "field", F.lower(_text(F.col("name"))).alias("said"), _text(F.col("raw_value")).alias("raw"), _text(F.col("safe_value")).alias("safe"), F.lower(_text(F.col("status"))).alias("status"), "cell", F.lit(True).alias("decided"))
    x = cells.join(said, ["key", "field"], "left")
    verdict = (
        F.when((F.col("before") != "") & (F.col("after") == ""), "value_lost").when(F.col("decided").isNull(), "no_decision")
        .when(~F.col("cell").eqNullSafe(cell_hash(F.col("key"), F.col("field"), F.col("before"))), "stale_decision").when(F.col("said") != F.lower("now"), "other_name").when(F.col("raw") != F.col("after"), "other_value")
        .when(~F.col("status").isin("accepted", "current_only"), "unresolved").when((F.col("status") == "accepted") & (F.col("safe") != F.col("after")), "unsafe_value").otherwise(F.col("status"))
    )
    out = x.select("key", "field", "before", "after", verdict.alias("verdict"))
    for part in (*repeated, gone, names.select("key", "field", "before", "after", "verdict")):
        out = out.unionByName(part)
    return out
