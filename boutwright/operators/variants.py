"""Training sets from an older and a newer source of the same bouts: eight ways to combine them.

A bout is its day and its unordered pair of names. Where both sources have it the other way round,
the newer row is turned to the older one's sides before any field is taken. Of several rows of one
source and bout the first by ``row_id`` counts; rows without a day or a name count in no set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import normalise

SIDES = ("fighter_a", "fighter_b")


def keyed(df: DataFrame) -> DataFrame:
    """One row a bout, with its key and its plain names."""
    a, b = (normalise(F.col(c)) for c in SIDES)
    out = df.withColumns({"__a": a, "__b": b, "__key": F.concat_ws("|", F.col("event_date").cast("string"), F.least(a, b), F.greatest(a, b))})
    out = out.where("event_date is not null and __a <> '' and __b <> ''")
    return out.withColumn("__n", F.row_number().over(Window.partitionBy("__key").orderBy("row_id"))).where("__n = 1").drop("__n")


def turned(df: DataFrame, cond: Column) -> DataFrame:
    """Sides exchanged where ``cond`` holds: fighter_a and fighter_b, and each a_* with its b_*."""
    have = set(df.columns)
    pairs = [(x, y) for x, y in [SIDES, *((c, "b_" + c[2:]) for c in df.columns if c.startswith("a_"))] if x in have and y in have]
    return df.withColumns({c: F.when(cond, F.col(o)).otherwise(F.col(c)) for x, y in pairs for c, o in ((x, y), (y, x))})


#: The eight sets.
VARIANTS = ("legacy_only", "pulled_all", "append_only", "pulled_plus_legacy_market", "hybrid_legacy_first", "hybrid_pulled_from_overlap", "best_of_both_fields", "best_of_both_full_history")


def variant_rows(old: DataFrame, new: DataFrame, overlap: str, prefer_new: list[str], market: list[str]) -> DataFrame:
    """All eight sets as one table of ``variant`` and the fields of both sources (null where a set's source has no such field).

    ``overlap`` is the day from which the newer source is trusted beside the older one. Both sources
    are keyed once and meet in one join; a bout's own two rows and the older source's first and last
    day decide which sets it is in and with which fields. Where a set takes a field from both, it
    comes from the newer row for ``prefer_new`` where that knows it, for all others from the older
    row first; unknown ``market`` fields of the newer rows may be filled from the older.
    """
    fields = [c for c in dict.fromkeys([*old.columns, *new.columns])]
    has_old, has_new, types = set(old.columns), set(new.columns), dict(new.dtypes) | dict(old.dtypes)
    keyed_old, keyed_new = keyed(old), keyed(new)
    o = keyed_old.select("__key", F.struct("__a", *old.columns).alias("o"))
    n = keyed_new.select("__key", F.struct("__a", *new.columns).alias("n"))
    ends = keyed_old.agg(F.max("event_date").alias("last"), F.min("event_date").alias("first"))
    both = o.join(n, "__key", "full").crossJoin(F.broadcast(ends))  # one row of dates
    in_old, in_new, day = F.col("o").isNotNull(), F.col("n").isNotNull(), F.coalesce("n.event_date", "o.event_date")
    opposite = in_old & in_new & (F.col("o.__a") != F.col("n.__a"))
    unknown = lambda c: F.lit(None).cast(types[c])

    def partner(c: str, have: set[str]) -> str:
        swap = {"a_": "b_", "b_": "a_"}
        x = {SIDES[0]: SIDES[1], SIDES[1]: SIDES[0]}.get(c) or (swap[c[:2]] + c[2:] if c[:2] in swap else c)
        return x if x in have else c

    def older(c: str) -> Column:
        return F.col(f"o.{c}") if c in has_old else unknown(c)

    def newer(c: str) -> Column:
        return F.col(f"n.{c}") if c in has_new else unknown(c)

    def turned(c: str) -> Column:
        """The newer row's field on the older one's sides."""
        return F.when(opposite, F.col(f"n.{partner(c, has_new)}")).otherwise(F.col(f"n.{c}")) if c in has_new else unknown(c)

    def filled(c: str) -> Column:
        if c not in market:
            return newer(c)
        other = partner(c, set(market))
        return F.coalesce(newer(c), F.when(opposite, older(other)).otherwise(older(c)))

    def merged(c: str, in_new: Column) -> Column:
        x, y = older(c), F.when(in_new, turned(c))
        if c in (*SIDES, "row_id"):
            return F.when(in_old, x if c in has_old else y).otherwise(y)
        return F.coalesce(y, x) if c in prefer_new else F.coalesce(x, y)

    def row(of) -> Column:
        return F.struct(*[of(c).alias(c) for c in fields])

    from_cut = day >= F.lit(overlap).cast("date")
    later, since = in_new & (day > F.col("last")), in_new & (day >= F.col("first"))
    either = F.when(in_old, row(older)).otherwise(row(newer))
    sets = {
        "legacy_only": F.when(in_old, row(older)),
        "pulled_all": F.when(in_new, row(newer)),
        "append_only": F.when(in_old, row(older)).when(later, row(newer)),
        "pulled_plus_legacy_market": F.when(in_new, row(filled)),
        "hybrid_legacy_first": either,
        "hybrid_pulled_from_overlap": F.when(~from_cut & in_old, row(older)).when(from_cut & in_new, row(newer)),
        "best_of_both_fields": F.when(~from_cut & in_old, row(older)).when(from_cut, row(lambda c: merged(c, in_new))),
        "best_of_both_full_history": F.when(in_old | since, row(lambda c: merged(c, since))),
    }
    listed = F.array(*[F.struct(F.lit(v).alias("variant"), sets[v].alias("x")) for v in VARIANTS])
    return both.select(F.explode(F.filter(listed, lambda s: s["x"].isNotNull())).alias("s")).select("s.variant", "s.x.*")


def dataset_variants(old: DataFrame, new: DataFrame, overlap: str, prefer_new: list[str], market: list[str]) -> dict[str, DataFrame]:
    """The eight sets of ``variant_rows`` by name."""
    rows = variant_rows(old, new, overlap, prefer_new, market)
    of_old, of_new = old.columns, [*new.columns, *[c for c in market if c not in new.columns]]
    columns = {"legacy_only": of_old, "pulled_all": new.columns, "pulled_plus_legacy_market": of_new}
    return {v: rows.where(F.col("variant") == v).select(*columns.get(v, rows.columns[1:])) for v in VARIANTS}
