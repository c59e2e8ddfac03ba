"""Data-quality checks: rule faults, coverage floors, schema drift and parity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def faults(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows that break a rule, with a flag a rule; an unknown figure breaks none."""
    flags = [F.coalesce(c, F.lit(False)).alias(k) for k, c in rules.items()]
    out = df.select("*", *flags).withColumn("n_faults", sum((F.col(k).cast("int") for k in rules), F.lit(0)))
    return out.where("n_faults > 0")


def coverage(df: DataFrame, keys: list[str], floors: dict[str, float]) -> DataFrame:
    """Known share of each column and whether all reach their floors."""
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.col(c).isNotNull().cast("double")).alias(f"cov_{c}") for c in floors])
    ok = F.lit(True)
    for c, least in floors.items():
        ok = ok & (F.col(f"cov_{c}") >= least)
    return out.withColumn("passes", ok)


def parity(live: Column, train: Column, tolerance: float) -> Column:
    return F.when(live.isNull() & train.isNull(), "both_missing").when(train.isNull(), "live_only").when(live.isNull(), "train_only").when(F.abs(live - train) <= tolerance, "match").otherwise("mismatch")


def schema_report(df: DataFrame, expected: dict[str, str]) -> dict[str, list[str]]:
    """Columns missing, unexpected or of another type."""
    own = dict(df.dtypes)
    return {"missing": [c for c in expected if c not in own], "unexpected": [c for c in own if c not in expected], "type": [c for c in expected if c in own and own[c] != expected[c]]}


def named_faults(df: DataFrame, date: str, sides: tuple[str, str], target: str) -> DataFrame:
    """Rows with a fault that their columns' names let one see: no date, no or equal participants, a target that is not 0 or 1, shares and probabilities outside [0, 1], percentages outside [0, 100], landed over attempted."""
    c, names = F.col, df.columns
    rules = {"no_date": c(date).isNull(), "participants": c(sides[0]).isNull() | c(sides[1]).isNull() | (c(sides[0]) == c(sides[1])), "target": c(target).isNotNull() & ~c(target).isin(0, 1)}
    rules |= {n: ~c(n).between(0, 1) for n in names if n.endswith(("_share", "_prob"))} | {n: ~c(n).between(0, 100) for n in names if n.endswith(("_pct", "_acc", "_def"))}
    rules |= {n: c(n) > c(n.replace("_landed", "_attempted")) for n in names if n.endswith("_landed") and n.replace("_landed", "_attempted") in names}
    hits = F.filter(F.array(*[F.when(F.coalesce(cond, F.lit(False)), n) for n, cond in rules.items()]), lambda x: x.isNotNull())
    return df.withColumn("faults", hits).where(F.size("faults") > 0)


def incoming_results(accepted: DataFrame, candidate: DataFrame, key: str) -> DataFrame:
    """Classes of the results that are new in the candidate, and whether any must be quarantined."""
    from ..functions.scalars import official_result

    new = candidate.join(accepted.select(key), key, "left_anti").withColumn("r", official_result(F.col("outcome"), F.col("method")))
    return new.groupBy(F.col("r.kind").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("r.is_target"), 1)).alias("n_targets"), F.max("r.quarantined").alias("quarantined"))


def publication_bundle(reports: dict[str, DataFrame]) -> DataFrame:
    """One row a report and whether it passed; each report is one row with ``passed``."""
    out = None
    for name, df in reports.items():
        part = df.select(F.lit(name).alias("report"), "passed")
        out = part if out is None else out.unionByName(part)
    return out
