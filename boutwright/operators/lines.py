"""Price lines of a pair over time, and overlays of observed sources onto bouts.

A pair is unordered: rows are keyed by the lesser and the larger side, and turned to the asked
orientation when they are attached.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .market import line_movement

PAIR = ("event_date", "__lo", "__hi")


def with_pair(df: DataFrame, a: str = "a_id", b: str = "b_id") -> DataFrame:
    return df.withColumn("__lo", F.least(a, b)).withColumn("__hi", F.greatest(a, b))


def valid_moneyline(odds: DataFrame, a: str = "a_odds", b: str = "b_odds") -> DataFrame:
    """Rows whose prices can describe two sides: both above 1, and no heavy favourite on both; rows without both prices stay."""
    x, y = F.col(a), F.col(b)
    both = x.isNotNull() & y.isNotNull()
    twice = (F.abs(x - y) <= 1e-12) & (x < 2) & S.implausible_favourites(x, x)
    return odds.where(~F.coalesce(both & ((x <= 1) | (y <= 1) | twice), F.lit(False)))


def movement_features(df: DataFrame) -> DataFrame:
    """line_* columns from open_prob and current_prob, sharp and steam."""
    move = F.col("current_prob") - F.col("open_prob")
    way = F.when(move.isNotNull(), S.movement_direction(move))
    return df.withColumns({"line_movement": move, "line_abs_movement": F.abs(move), "line_is_sharp": F.col("sharp").cast("int"), "line_steam_move": F.col("steam").cast("int"), "line_direction_toward_a": (way == "toward_a").cast("int"), "line_direction_toward_b": (way == "toward_b").cast("int")})


def pair_movement(odds: DataFrame) -> DataFrame:
    """Movement of each bout's line, oldest offset first, turned to the orientation of its oldest row; pairs with one row are left out."""
    key = F.concat_ws("|", *PAIR)
    w = Window.partitionBy(*PAIR).orderBy(F.desc("offset_days"), "query_date", "row_id")
    own = with_pair(odds).withColumn("__first", F.first("a_id").over(w)).withColumn("__key", key)
    own = own.withColumn("prob", F.when(F.col("a_id") == F.col("__first"), F.col("a_prob")).otherwise(F.col("b_prob")))
    moves = line_movement(own.withColumn("__neg", -F.col("offset_days")), "__key", ["__neg", "query_date", "row_id"], "prob")
    who = own.groupBy("__key", *PAIR).agg(F.first("__first").alias("a_id"), F.count(F.lit(1)).alias("num_snapshots")).where("num_snapshots >= 2")
    other = F.when(F.col("a_id") == F.col("__lo"), F.col("__hi")).otherwise(F.col("__lo"))
    out = movement_features(who.join(moves, "__key"))
    return out.select("event_date", "a_id", other.alias("b_id"), "open_prob", "current_prob", *LINE, "num_snapshots")


LINE = ("line_movement", "line_abs_movement", "line_is_sharp", "line_steam_move", "line_direction_toward_a", "line_direction_toward_b")


def attach_movement(bouts: DataFrame, moves: DataFrame) -> DataFrame:
    """Line features on bouts whichever way round the pair stands; a turned pair changes sign and direction."""
    m = with_pair(moves).select(*PAIR, F.col("a_id").alias("__ma"), *[F.col(c).alias(f"__{c}") for c in LINE])
    out = with_pair(bouts).join(m, list(PAIR), "left")
    same = F.col("__ma") == F.col("a_id")
    turned = {"line_movement": -F.col("__line_movement"), "line_direction_toward_a": F.col("__line_direction_toward_b"), "line_direction_toward_b": F.col("__line_direction_toward_a")}
    cols = {c: F.when(same, F.col(f"__{c}")).otherwise(turned.get(c, F.col(f"__{c}"))) for c in LINE}
    return out.withColumns(cols).select(*bouts.columns, *LINE)


def snapshot_movement(quotes: DataFrame, key: str) -> DataFrame:
    """Movement over a market's snapshots, each the mean of its books; hours between the first and the last."""
    mean = quotes.groupBy(key, "snapshot_time").agg(F.avg("a_prob").alias("a_prob"))
    hours = mean.where("a_prob is not null").groupBy(key).agg(((F.unix_micros(F.max("snapshot_time").cast("timestamp")) - F.unix_micros(F.min("snapshot_time").cast("timestamp"))) / 3.6e9).alias("hours_tracked"))
    out = movement_features(line_movement(mean, key, ["snapshot_time"]))
    return out.join(hours, key).select(key, "n_points", "open_prob", "current_prob", "max_step", *LINE, F.when(F.col("n_points") >= 2, F.col("hours_tracked")).alias("hours_tracked"))


def opening_overlay(bouts: DataFrame, odds: DataFrame, days: int = 5) -> DataFrame:
    """The oldest quote at least ``days`` before each bout (the latest query of equal offsets), turned to the bout's sides."""
    return overlay_sides(bouts, odds.where(F.col("offset_days") >= days), [F.desc("offset_days"), F.desc("query_date"), F.desc("row_id")], ["a_prob"])


def overlay_sides(bouts: DataFrame, rows: DataFrame, rank: list[Column], columns: list[str]) -> DataFrame:
    """One row a bout key, picked by ``rank``; each a_* column and its b_* partner trade places where the sides do."""
    both = [c for a in columns for c in (a, "b" + a[1:])]
    w = Window.partitionBy(*PAIR).orderBy(*rank)
    one = with_pair(rows).withColumn("__n", F.row_number().over(w)).where("__n = 1").select(*PAIR, F.col("a_id").alias("__oa"), *[F.col(c).alias(f"__{c}") for c in both])
    out = with_pair(bouts).join(one, list(PAIR), "left")
    same = F.col("__oa") == F.col("a_id")
    partner = lambda c: ("b" if c[0] == "a" else "a") + c[1:]
    return out.withColumns({c: F.when(same, F.col(f"__{c}")).otherwise(F.col(f"__{partner(c)}")) for c in both}).select(*bouts.columns, *both)


def observed_overlay(frame: DataFrame, overlay: DataFrame, key: str, columns: list[str], owned: str) -> DataFrame:
    """Observed values over legacy ones: rows with an ``owned`` mark take the observation even where it is unknown, others only fill gaps.

    ``legacy_values`` keeps what an owned row had, ``legacy_conflicts`` lists the columns that differed.
    A key that the overlay holds twice is an error.
    """
    twice = overlay.groupBy(key).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"overlay holds {twice[0][0]!r} more than once")
    o = overlay.select(key, F.col(owned).alias("__owned"), *[F.col(c).alias(f"__{c}") for c in columns])
    out = frame.join(o, key, "left")
    mine = F.col("__owned").isNotNull()
    old = F.map_filter(F.create_map(*[x for c in sorted(columns) for x in (F.lit(c), F.col(c))]), lambda k, v: v.isNotNull())
    differs = F.filter(F.array(*[F.when(F.col(c) != F.col(f"__{c}"), c) for c in columns]), lambda c: c.isNotNull())
    marks = {"legacy_values": F.to_json(F.when(mine, old)), "legacy_conflicts": F.when(mine, F.to_json(differs))}
    out = out.withColumns(marks)
    return out.withColumns({c: F.when(mine, F.col(f"__{c}")).otherwise(F.coalesce(c, f"__{c}")) for c in columns}).select(*frame.columns, *marks)


#: Rows that one task gathers into means, which stand in its memory.
TASK_ROWS = 250_000


def method_probabilities(outcomes: DataFrame, *keys: str, price: str = "price") -> DataFrame:
    """Mean implied probability of each side and method of a bout; outcomes have side (a, b) and method (ko, sub, dec).

    The first key is the bout, others tell its captures apart. Rows are dealt by the bout over as many
    tasks as their number asks for; shrunk by means first, they would be packed into a few large tasks.
    """
    sc = outcomes.sparkSession.sparkContext
    which = F.array_position(F.array(*[F.lit(c) for c in METHODS]), F.concat("side", F.lit("_"), "method", F.lit("_prob"))).cast("int")
    rows = outcomes.select(*keys, which.alias("__which"), S.american_to_prob(F.col(price)).alias("__p"))
    rows = rows.repartition(max(sc.defaultParallelism, -(-outcomes.count() // TASK_ROWS)), keys[0])
    return rows.groupBy(*keys).agg(*[F.avg(F.when(F.col("__which") == i, F.col("__p"))).alias(c) for i, c in enumerate(METHODS, 1)])


METHODS = tuple(f"{s}_{m}_prob" for s in "ab" for m in ("ko", "sub", "dec"))


def merged_methods(results: DataFrame, key: str, columns: tuple[str, ...] = METHODS) -> DataFrame:
    """Results of a bout's captures, one row each: the mean of those that have a value."""
    return results.groupBy(key).agg(*[F.avg(c).alias(c) for c in columns])


def latest_key(history: DataFrame, pair: str, key: str) -> DataFrame:
    """Of each pair's fight keys the rows of the latest: by start, then snapshot (unknown first), then key."""
    per = history.groupBy(pair, key).agg(F.max("starts_at").alias("s"), F.max("snapshot_time").alias("t"))
    best = per.groupBy(pair).agg(F.max(F.struct("s", "t", key))[key].alias(key))
    return history.join(best, [pair, key], "left_semi")


def timeline(odds: DataFrame, a: Column, b: Column) -> DataFrame:
    """All quotes of one pair in either order, oldest offset first, turned to (a, b)."""
    same, other = (F.col("a_id") == a) & (F.col("b_id") == b), (F.col("a_id") == b) & (F.col("b_id") == a)
    p = F.when(same, F.col("a_prob")).otherwise(F.col("b_prob"))
    return odds.where(same | other).select("event_date", "offset_days", "row_id", p.alias("prob"), (~same).alias("turned")).orderBy("event_date", F.desc("offset_days"), "row_id")


def visible(history: DataFrame, as_of: Column, time: str = "snapshot_time") -> DataFrame:
    """Rows at or before a cutoff text; a bare date means the end of that day."""
    cut = F.try_to_timestamp(as_of)
    end = F.when(as_of.rlike("[T ]"), cut).otherwise(cut + F.expr("INTERVAL 1 DAY") - F.expr("INTERVAL 1 MICROSECOND"))
    return history.where(F.col(time).cast("timestamp") <= end)


def moneyline_snapshots(rows: DataFrame, key: str) -> DataFrame:
    """Snapshots, last prices of both sides, staleness and moves since the first snapshot; rows have side, odds, snapshot_time, updated_at, row_id."""
    p = 1 / F.col("odds")
    first = lambda s: F.min_by(F.when(F.col("side") == s, p), F.when((F.col("side") == s) & F.col("odds").isNotNull(), F.col("row_id"))).alias(f"{s}_prob")
    snaps = rows.where(F.col("side").isin("a", "b") & F.col("odds").isNotNull()).groupBy(key, "snapshot_time", "updated_at").agg(first("a"), first("b"))
    at = F.struct("snapshot_time", "updated_at")
    ends = F.struct("a_prob", "b_prob", "snapshot_time", "updated_at")
    out = snaps.groupBy(key).agg(F.count(F.lit(1)).alias("n_snapshots"), F.min_by(ends, at).alias("f"), F.max_by(ends, at).alias("l"))
    stale = (F.unix_micros(F.col("l.snapshot_time").cast("timestamp")) - F.unix_micros(F.col("l.updated_at").cast("timestamp"))) / 3.6e9
    a, b = F.col("l.a_prob") - F.col("f.a_prob"), F.col("l.b_prob") - F.col("f.b_prob")
    return out.select(key, "n_snapshots", F.col("l.a_prob").alias("a_prob"), F.col("l.b_prob").alias("b_prob"), (F.col("l.a_prob") - F.col("l.b_prob")).alias("diff_prob"), stale.alias("stale_hours"), a.alias("move_a"), b.alias("move_b"), (F.abs(a) + F.abs(b)).alias("move_abs"))
