"""Odds summaries of an event: cleaned rows, snapshots by market and phase, and the features made of them.

Rows are event_id, bookmaker, market_phase (start or end), market_key, home/away/over/under odds,
handicap (text), added_at, updated_at and row_id. Each market is cleaned once and then summed in
one conditional pass for both phases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Keys of the handicap and totals markets.
HANDICAP, TOTALS = "162_2", "162_3"
ODDS = ("home_odds", "away_odds", "over_odds", "under_odds")
PHASES = {"start": "opening", "end": "end"}


def decimal_ok(o: Column) -> Column:
    return F.coalesce(o > 1, F.lit(False))


def sane_rows(rows: DataFrame) -> DataFrame:
    """Rows without an odds value that is no decimal price; unknown values do no harm."""
    bad = F.lit(False)
    for c in ODDS:
        bad = bad | (F.col(c).isNotNull() & ~decimal_ok(F.col(c)))
    return rows.where(~bad)


def straight_rows(rows: DataFrame) -> DataFrame:
    """Rows with both winner prices and no handicap."""
    return rows.where(F.col("home_odds").isNotNull() & F.col("away_odds").isNotNull() & (F.length(F.trim(F.coalesce("handicap", F.lit("")))) == 0))


def market_rows(rows: DataFrame, left: str, right: str, market_key: str | None = None) -> DataFrame:
    """The first valid row of each event, bookmaker and phase, with both implied probabilities; without a market key, straight winner rows."""
    own = straight_rows(rows) if market_key is None else rows.where(F.col("market_key") == market_key)
    own = own.where(decimal_ok(F.col(left)) & decimal_ok(F.col(right)))
    first = Window.partitionBy("event_id", "bookmaker", "market_phase").orderBy(F.asc_nulls_last("added_at"), F.asc_nulls_last("market_key"), "row_id")
    own = own.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    return own.select("event_id", "bookmaker", "market_phase", "added_at", (1 / F.col(left)).alias("left"), (1 / F.col(right)).alias("right"), F.col("handicap").try_cast("double").alias("points"))


def phase_summary(market: DataFrame) -> DataFrame:
    """event_id and, for either phase, first time, distinct books, mean probabilities and mean handicap."""
    aggs = []
    for phase, name in PHASES.items():
        here = F.col("market_phase") == phase
        only = lambda c: F.when(here, F.col(c))  # noqa: B023, E731
        aggs += [F.min(only("added_at")).alias(f"{name}_at"), F.count_distinct(only("bookmaker")).alias(f"{name}_books"), F.avg(only("left")).alias(f"{name}_left"), F.avg(only("right")).alias(f"{name}_right"), F.avg(only("points")).alias(f"{name}_points")]
    out = market.groupBy("event_id").agg(*aggs)
    return out.withColumns({f"{n}_books": F.when(F.col(f"{n}_books") > 0, F.col(f"{n}_books")) for n in PHASES.values()})


def latest_events(events: DataFrame) -> DataFrame:
    """The last seen version of each fight key (larger event id of equal times)."""
    last = F.max(F.struct("seen_at", "event_id", "starts_at")).alias("x")
    return events.groupBy("fight_key").agg(last).select("fight_key", "x.event_id", "x.starts_at")


def event_snapshots(events: DataFrame, rows: DataFrame) -> DataFrame:
    """A row a fight: opening and end prices of the winner market and the range of updates."""
    updates = rows.groupBy("event_id").agg(F.min("updated_at").alias("first_update"), F.max("updated_at").alias("last_update"))
    prices = phase_summary(market_rows(rows, "home_odds", "away_odds")).drop("opening_points", "end_points")
    return latest_events(events).join(prices, "event_id", "left").join(updates, "event_id", "left")


def opening_features(snapshots: DataFrame) -> DataFrame:
    """Opening prices, their difference, books and hours of lead, from event_snapshots()."""
    lead = (F.unix_micros(F.col("starts_at").cast("timestamp")) - F.unix_micros(F.col("opening_at").cast("timestamp"))) / 3.6e9
    return snapshots.select("fight_key", F.col("opening_left").alias("opening_a"), F.col("opening_right").alias("opening_b"), (F.col("opening_left") - F.col("opening_right")).alias("opening_diff"), "opening_books", lead.alias("lead_hours"))


def market_moves(events: DataFrame, rows: DataFrame) -> DataFrame:
    """A row a fight: opening and end of the handicap and totals markets, and how far prices and handicaps moved."""
    out = latest_events(events).select("event_id", "fight_key")
    for name, key, left, right in (("handicap", HANDICAP, "home_odds", "away_odds"), ("totals", TOTALS, "over_odds", "under_odds")):
        s = phase_summary(market_rows(rows, left, right, key))
        c = lambda n: F.col(n)
        own = [c(f"{p}_{k}").alias(f"{name}_{p}_{k}") for p in PHASES.values() for k in ("left", "right", "points")]
        moved = (F.abs(c("end_left") - c("opening_left")) + F.abs(c("end_right") - c("opening_right"))).alias(f"{name}_prob_move")
        out = out.join(s.select("event_id", *own, moved, F.abs(c("end_points") - c("opening_points")).alias(f"{name}_points_move")), "event_id", "left")
    return out.drop("event_id")


def expanded_features(events: DataFrame, rows: DataFrame, late_hours: float = 2.0) -> DataFrame:
    """A row a fight with summary rows: books, overround, moves, agreement of markets, late updates, coverage and depth.

    Directions come from end rows; where the whole table has none, from all rows. A late update is
    any within ``late_hours`` of the start or after it. Coverage is the share of the day's fights
    that have an opening price.
    """
    snaps = event_snapshots(events, rows)
    winner = market_rows(rows, "home_odds", "away_odds").groupBy("event_id").agg(
        F.avg(F.col("left") + F.col("right") - 1).alias("overround"),
        *[F.avg(F.when(F.col("market_phase") == p, F.col(s))).alias(f"{n}_{s}") for p, n in PHASES.items() for s in ("left", "right")],
    )
    points, end = F.col("handicap").try_cast("double"), F.col("market_phase") == "end"
    has_end = rows.where(end & F.col("market_key").isin(HANDICAP, TOTALS)).select("market_key").distinct().agg(F.collect_set("market_key").alias("ends")).first()["ends"]  # two keys at most
    starts = latest_events(events).select("event_id", "starts_at")
    known = rows.join(starts, "event_id", "left").withColumn("hours", (F.unix_micros(F.col("starts_at").cast("timestamp")) - F.unix_micros(F.col("updated_at").cast("timestamp"))) / 3.6e9)

    def direction(key: str) -> Column:
        return F.avg(F.when((F.col("market_key") == key) & (end if key in has_end else F.lit(True)), points))

    per = known.groupBy("event_id").agg(
        F.count_distinct("bookmaker").alias("books"), F.count_distinct("market_key").alias("markets"),
        *[F.max((F.col("market_key") == k).cast("int")).alias(f"has_{n}") for n, k in (("totals", TOTALS), ("handicap", HANDICAP))],
        direction(HANDICAP).alias("handicap_direction"), direction(TOTALS).alias("total_direction"),
        F.when(F.max("starts_at").isNotNull(), F.coalesce(F.max((F.col("hours") <= late_hours).cast("int")), F.lit(0))).alias("late_update"),
    )
    per = per.join(winner, "event_id", "left")
    day = Window.partitionBy(F.to_date("starts_at"))
    card = snaps.select("event_id", "fight_key", (F.count("opening_left").over(day) / F.count("fight_key").over(day)).alias("covered"))
    card = card.withColumn("coverage", F.when(F.col("covered") > 0, F.col("covered")))
    out = card.join(per, "event_id")
    return out.select(
        "fight_key", "books", "overround", (F.col("end_left") - F.col("opening_left")).alias("move_a"), (F.col("end_right") - F.col("opening_right")).alias("move_b"),
        (F.signum(F.col("end_left") - 0.5) * F.signum("total_direction")).alias("agreement"), "handicap_direction", "total_direction", "late_update",
        F.col("overround").isNotNull().cast("int").alias("has_moneyline"), "has_totals", "has_handicap", "coverage", (F.col("books") * F.col("markets")).alias("depth"),
    )


def augmented(bouts: DataFrame, events: DataFrame, rows: DataFrame) -> DataFrame:
    """``bouts`` (fight_key) with opening, market and expanded features; a bout without any keeps nulls."""
    out = bouts
    for part in (opening_features(event_snapshots(events, rows)), market_moves(events, rows), expanded_features(events, rows)):
        out = out.join(part, "fight_key", "left")
    return out
