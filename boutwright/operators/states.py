"""State of participants at other times than their bouts, overlays of history, coverage, alerts and rankings of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import history as H
from .features import rolled


def as_of_state(rows: DataFrame, asks: DataFrame, stats: tuple[str, ...]) -> DataFrame:
    """Rolled statistics, counters and streaks of participants just before any asked date.

    An ask (ask_id, entity, as_of) becomes a drawn bout without figures at its date, behind all real
    bouts of earlier days and before those of the day, and reads what it would see.
    """
    cols = {c: t for c, t in rows.dtypes}
    blank = {c: F.lit(None).cast(t) for c, t in cols.items()} | {"entity": F.col("entity").cast(cols["entity"]), "event_date": F.col("as_of").cast(cols["event_date"]), "result": F.lit("draw"), "fight_id": F.lit(-1).cast(cols["fight_id"])}
    # several asks of one participant and day see the same: one virtual bout serves them all
    days = asks.select("entity", "as_of").distinct().select(*[v.alias(c) for c, v in blank.items()], F.lit(True).alias("__virtual"))
    both = rows.withColumn("__virtual", F.lit(False)).unionByName(days)
    return _read(both, asks, stats)


def _read(both: DataFrame, asks: DataFrame, stats: tuple[str, ...]) -> DataFrame:
    real = ~F.col("__virtual")
    # a virtual bout must not count for later ones: it is no bout in any sum
    w = H.before()
    counted = lambda c: F.coalesce(F.sum(F.when(c & real, 1).otherwise(0)).over(w), F.lit(0)).cast("long")
    own = both.withColumns({"num_fights": counted(F.lit(True)), "wins": counted(F.col("result") == "win"), "losses": counted(F.col("result") == "loss")})
    seen = own.withColumn("__last", F.last(F.when(real, F.col("event_date")), ignorenulls=True).over(w))
    state = F.struct("num_fights", "wins", "losses", F.datediff("event_date", "__last").alias("days_since"))
    virtual = seen.where("__virtual").select("entity", F.col("event_date").alias("as_of"), state.alias("s"))
    # means at the virtual bout are those after its last real one
    after = after_means(both.where(real).drop("__virtual"), stats)
    means = H.as_of(asks, after, ["entity"], "as_of", "event_date", [f"roll_{s}" for s in stats], strict=True).drop("event_date_used")
    out = means.join(virtual.withColumnRenamed("as_of", "__d").withColumnRenamed("entity", "__e"), (F.col("entity") == F.col("__e")) & (F.col("as_of").cast("date") == F.col("__d")), "left")
    return out.select(*asks.columns, F.coalesce("s.num_fights", F.lit(0)).alias("num_fights"), F.coalesce("s.wins", F.lit(0)).alias("wins"), F.coalesce("s.losses", F.lit(0)).alias("losses"), "s.days_since", *[f"roll_{s}" for s in stats])


def after_means(rows: DataFrame, stats: tuple[str, ...], half_life: float = 3.0) -> DataFrame:
    """entity, event_date and roll_* after the last bout of each day: the mean of what came before and that day's value, weighed on."""
    cols = [*stats]
    end = rows.groupBy("entity").agg(F.max("event_date").alias("event_date"))
    tail = end.select(*[F.lit(None).cast(t).alias(c) if c not in ("entity", "event_date", "fight_id") else F.date_add("event_date", 1).alias(c) if c == "event_date" else F.lit(-1).cast(t).alias(c) if c == "fight_id" else F.col(c) for c, t in rows.dtypes])
    r = rolled(rows.unionByName(tail), tuple(cols), half_life)
    nxt = H.entity()
    last = r.select("entity", "event_date", *[F.lead(f"roll_{s}").over(nxt).alias(f"roll_{s}") for s in cols], F.lead("event_date").over(nxt).alias("__next"))
    return last.where(F.col("__next").isNotNull() & (F.col("__next") != F.col("event_date"))).drop("__next")


def needed_rows(rows: DataFrame, targets: DataFrame, last: int = 5) -> DataFrame:
    """The rows that features of new bouts depend on: those bouts, their participants' histories, and the histories of the last ``last`` opponents.

    Targets have fight_id; two semi-joins, so a refresh touches only what it must.
    """
    ids = targets.select("fight_id").distinct()
    here = rows.join(ids, "fight_id", "left_semi")
    own = here.select("entity").distinct()
    history = rows.join(own, "entity", "left_semi")
    rank = F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("event_date"), F.desc("fight_id")))
    first = here.groupBy("entity").agg(F.count(F.lit(1)).alias("__k"))
    met = history.join(first, "entity").withColumn("__n", rank).where(F.col("__n") <= last + F.col("__k"))
    return rows.join(own.unionByName(met.select(F.col("opponent").alias("entity"))).distinct(), "entity", "left_semi")


def tracked_counters(rows: DataFrame, tracked: Column) -> DataFrame:
    """fight_id, entity and counters over tracked bouts alone."""
    return H.prior_counts(rows.where(tracked)).select("fight_id", "entity", "num_fights", "wins", "losses", "draws")


def overlaid_counters(bouts: DataFrame, counters: DataFrame, names: list[str]) -> DataFrame:
    """a_* and b_* counters of the bout are dropped and attached again from ``counters``; a bout it lacks has nulls."""
    out = bouts.drop(*[f"{s}_{n}" for s in "ab" for n in names])
    for s in "ab":
        out = out.join(counters.select("fight_id", F.col("entity").alias(f"{s}_id"), *[F.col(n).alias(f"{s}_{n}") for n in names]), ["fight_id", f"{s}_id"], "left")
    return out


def filled(df: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """Sparse columns filled from their history columns, which are dropped; ``pairs`` maps a column to its history."""
    out = df.withColumns({c: F.coalesce(c, h) if c in df.columns else F.col(h) for c, h in pairs.items()})
    return out.drop(*pairs.values())


def decisive_meetings(bouts: DataFrame) -> DataFrame:
    """As head_to_head, but a bout without a winner leaves no trace."""
    lo, hi = F.least("a_id", "b_id"), F.greatest("a_id", "b_id")
    w = H.before("__lo", "__hi")
    out = bouts.withColumns({"__lo": lo, "__hi": hi, "__s": F.when(F.col("winner") == lo, 1).when(F.col("winner") == hi, -1).otherwise(0)})
    lead = F.coalesce(F.sum("__s").over(w), F.lit(0)) * F.when(F.col("a_id") == F.col("__lo"), 1).otherwise(-1)
    return out.withColumns({"is_rematch": (F.count("winner").over(w) > 0).cast("long"), "h2h_diff": lead.cast("long")}).drop("__lo", "__hi", "__s")


def covered(predictions: DataFrame, features: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Predictions with ``covered``: whether the features of their key (first row of equal keys by known values) hold any of the columns."""
    has = sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0)) > 0
    one = features.groupBy(*keys).agg(F.max(has).alias("covered"))
    return predictions.join(one, keys, "left").withColumn("covered", F.coalesce("covered", F.lit(False)))


def coverage_by_event(tracked: DataFrame, records: DataFrame, key: str, event: str) -> DataFrame:
    """Fights, covered and missing ones and a status of each event; tracked rows have ``expected``."""
    seen = records.select(key).distinct().withColumn("__c", F.lit(True))
    hit = F.coalesce("__c", F.lit(False))
    out = tracked.where("expected").join(seen, key, "left").groupBy(event).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(hit, 1)).alias("n_covered"))
    status = F.when(F.col("n_covered") == F.col("n"), "complete").when(F.col("n_covered") > 0, "partial").otherwise("unavailable")
    return out.withColumns({"n_missing": F.col("n") - F.col("n_covered"), "status": status})


def market_alerts(df: DataFrame, move: float = 0.15, floor: float = 0.05) -> DataFrame:
    """Advisory alert of a line: price_floor of a side, large_move or steam before the start; null where nothing is unusual.

    Rows have movement, steam, direction, a_now, b_now (current prices, may be unknown) and started.
    """
    c = F.col
    low = F.when(c("a_now") < floor, "price_floor_a").when(c("b_now") < floor, "price_floor_b")
    big = ~c("started") & (F.abs(F.coalesce("movement", F.lit(0.0))) >= move)
    return df.withColumn("alert", F.coalesce(low, F.when(big, F.concat(F.lit("large_move_"), c("direction"))), F.when(~c("started") & F.coalesce("steam", F.lit(False)), F.concat(F.lit("steam_"), c("direction")))))


def ranked_profiles(results: DataFrame) -> DataFrame:
    """Profiles from the best: with settled bets first, then profit, return and win rate."""
    n = F.coalesce("settled", F.lit(0))
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return results.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(n > 0), F.desc(z("profit")), F.desc(z("roi")), F.desc(z("win_rate")), "profile")))  # a row a profile: few


def ranked_sweeps(results: DataFrame) -> DataFrame:
    """Sweep rows by flag (none first), gap, then return, closing value, drawdown and number of bets."""
    order = [F.coalesce("flag", F.lit(False)), F.coalesce("gap", F.lit(0.0)), F.desc("roi"), F.desc(F.coalesce("clv", F.lit(-999.0))), "drawdown", "n", "sweep"]
    return results.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # a row a configuration: few


def amateur_summary(rows: DataFrame, key: str) -> DataFrame:
    """Bouts, wins, losses, win share and finish rates of each identity; rates are null where a win's method is unknown."""
    won = F.col("result") == "win"
    m = F.lower(F.coalesce("method", F.lit("")))
    wins = F.count(F.when(won, 1))
    rate = lambda words: F.when((wins > 0) & F.every(~won | (F.length(m) > 0)), F.count(F.when(won & m.rlike(words), 1)) / wins)
    return rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("fights"), wins.alias("wins"), F.count(F.when(F.col("result") == "loss", 1)).alias("losses"), (wins / F.count(F.lit(1))).alias("win_pct"),
        rate("ko|punch|kick|knee|elbow|slam|stomp").alias("ko_rate"), rate("sub|choke|armbar|triangle|guillotine|kimura|americana|lock|hook|crank").alias("sub_rate"), rate("dec|unanimous|split|majority").alias("dec_rate"),
    )


def rankings_at(bouts: DataFrame, ranks: DataFrame) -> DataFrame:
    """Class and pound-for-pound rank of both sides from the latest snapshot at or before each bout.

    Ranks have as_of, division, name, rank; the division is the bout's class or "pfp". Snapshot days
    are few, so each bout's snapshot is found first and then joined exactly.
    """
    days = ranks.select("as_of").distinct()
    out = bouts.join(snapshot_of(bouts, days), "event_date", "left")
    r = ranks.select(F.col("as_of").alias("snapshot"), "division", "name", "rank")
    for s in "ab":
        for kind, division in (("wc", F.col("weight_class")), ("pfp", F.lit("pfp"))):
            own = r.select(F.col("snapshot").alias("__s"), F.col("division").alias("__d"), F.col("name").alias("__n"), F.col("rank").alias(f"{s}_{kind}_rank"))
            out = out.join(own, (F.col("snapshot") == F.col("__s")) & (division == F.col("__d")) & (F.col(f"{s}_id") == F.col("__n")), "left").drop("__s", "__d", "__n")
    return out


def snapshot_of(bouts: DataFrame, days: DataFrame) -> DataFrame:
    """event_date and the latest snapshot day at or before it, over the distinct days of both."""
    both = bouts.select(F.col("event_date").alias("t")).distinct().withColumn("s", F.lit(None).cast("date")).unionByName(days.select(F.col("as_of").alias("t"), F.col("as_of").alias("s")))
    w = Window.orderBy("t").rangeBetween(Window.unboundedPreceding, Window.currentRow)  # a row a day: some thousands
    return both.withColumn("snapshot", F.max("s").over(w)).where("s is null").select(F.col("t").alias("event_date"), "snapshot").distinct()


def window_status(event: Column, now: Column, opens_h: float = 48, closes_h: float = 1, fail_closed: bool = False) -> Column:
    """As scalars.entry_window; with ``fail_closed`` an unknown time is closed."""
    out = S.entry_window(event, now, opens_h, closes_h)
    return F.when(out == "unknown", "closed").otherwise(out) if fail_closed else out


def best_source(rows: DataFrame, keys: list[str], precedence: str, value: str) -> DataFrame:
    """Of each key the value of the source that comes first, and ``conflict`` where sources of that rank differ; callers refuse conflicts."""
    first = rows.groupBy(*keys).agg(F.min(precedence).alias("__p"))
    top = rows.join(first, keys).where(F.col(precedence) == F.col("__p"))
    return top.groupBy(*keys).agg(F.min(value).alias(value), F.min("__p").alias(precedence), (F.count_distinct(value) > 1).alias("conflict"))
