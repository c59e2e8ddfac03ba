"""Point-in-time history: every value of a bout uses strictly earlier rows of its participant.

Rows stand in (event_date, fight_id) order. All windows of one participant share a partition and
an order, so Catalyst sorts and shuffles once for all of them.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import method_group

ORDER = ("event_date", "fight_id")


def entity(*keys: str) -> Window:
    return Window.partitionBy(*(keys or ("entity",))).orderBy(*ORDER)


def before(*keys: str) -> Window:
    """All strictly earlier rows of the key."""
    return entity(*keys).rowsBetween(Window.unboundedPreceding, -1)


def last(n: int, *keys: str) -> Window:
    return entity(*keys).rowsBetween(-n, -1)


def whole_keys(batches, name: str = "key"):
    """Sorted batches as tables that hold whole keys, each with the first rows of its keys (and its length at the end); a key that goes on in the next batch is held until it ends."""
    held: list[pa.RecordBatch] = []

    def table():
        t = pa.Table.from_batches(held).combine_chunks()
        return t, [0, *_changes(t.column(name).combine_chunks()), t.num_rows]

    for b in batches:
        if not b.num_rows:
            continue
        keys = b.column(name)
        if held and held[-1].column(name)[-1].as_py() != keys[0].as_py():
            yield table()
            held = []
        last = max(_changes(keys), default=0)
        if last:
            held.append(b.slice(0, last))
            yield table()
            held = []
        held.append(b.slice(last))
    if held:
        yield table()


def _changes(keys: pa.Array) -> list[int]:
    """Where a key differs from the one before it; keys have no nulls."""
    import pyarrow.compute as pc

    differs = pc.not_equal(keys.slice(1), keys.slice(0, max(0, len(keys) - 1)))
    return (differs.to_numpy(zero_copy_only=False).nonzero()[0] + 1).tolist()


def result_of(winner: Column, own: Column, other: Column) -> Column:
    """win or loss where the winner is a side; anything else, unknown included, is a draw."""
    return F.when(winner == own, "win").when(winner == other, "loss").otherwise("draw")


def long_rows(bouts: DataFrame) -> DataFrame:
    """Two rows a bout, one for each participant, with the opponent's figures mirrored."""

    def side(s: str, o: str) -> Column:
        own, other = F.col(f"{s}_id"), F.col(f"{o}_id")
        return F.struct(F.lit(s).alias("side"), own.alias("entity"), other.alias("opponent"), F.col(f"{s}_landed").alias("landed"), F.col(f"{o}_landed").alias("opp_landed"), result_of(F.col("winner"), own, other).alias("result"))

    return bouts.select("fight_id", "event_date", "weight_class", "method", "n_rounds", F.explode(F.array(side("a", "b"), side("b", "a"))).alias("x")).select("fight_id", "event_date", "weight_class", "method", "n_rounds", "x.*")


def prior_counts(rows: DataFrame) -> DataFrame:
    """Counters over earlier bouts: results, wins by method, rounds, days since the last one."""
    w = before()

    def count(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, 1).otherwise(0)).over(w), F.lit(0)).cast("long")

    won, group = F.col("result") == "win", method_group(F.col("method"))
    return rows.select(
        "*",
        (F.row_number().over(entity()) - 1).cast("long").alias("num_fights"),
        count(won).alias("wins"), count(F.col("result") == "loss").alias("losses"), count(F.col("result") == "draw").alias("draws"),
        *[count(won & (group == m)).alias(f"wins_{m}") for m in ("ko", "sub", "dec")],
        F.coalesce(F.sum("n_rounds").over(w), F.lit(0)).cast("long").alias("total_rounds"),
        F.datediff("event_date", F.lag("event_date").over(entity())).cast("long").alias("days_since"),
    )


def streaks(rows: DataFrame) -> DataFrame:
    """Current win and loss streak before the bout and the longest win streak so far; a draw ends both."""
    w = before()
    grouped = rows.withColumn("__w", F.sum(F.when(F.col("result") != "win", 1).otherwise(0)).over(entity())).withColumn("__l", F.sum(F.when(F.col("result") != "loss", 1).otherwise(0)).over(entity()))
    run = grouped.withColumn("__rw", F.sum(F.when(F.col("result") == "win", 1).otherwise(0)).over(entity("entity", "__w"))).withColumn("__rl", F.sum(F.when(F.col("result") == "loss", 1).otherwise(0)).over(entity("entity", "__l")))
    zero = F.lit(0)
    out = run.withColumn("win_streak", F.coalesce(F.lag("__rw").over(entity()), zero)).withColumn("lose_streak", F.coalesce(F.lag("__rl").over(entity()), zero))
    return out.withColumn("longest_win_streak", F.coalesce(F.max("__rw").over(w), zero)).drop("__w", "__l", "__rw", "__rl")


def loss_methods(rows: DataFrame) -> DataFrame:
    """Earlier losses by method and whether one of the last two bouts was lost by knockout."""
    lost, group = F.col("result") == "loss", method_group(F.col("method"))
    hit = lambda m: F.when(lost & (group == m), 1).otherwise(0)
    zero = F.lit(0)
    return rows.select("*", *[F.coalesce(F.sum(hit(m)).over(before()), zero).cast("long").alias(f"losses_{m}") for m in ("ko", "sub", "dec")], F.coalesce(F.max(hit("ko")).over(last(2)), zero).cast("long").alias("recent_ko_loss"))


def both_sides(bouts: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    """Participant columns back on the bout as a_* and b_* (one grouped pass, no two joins)."""
    return bouts.join(side_by_side(rows, columns), "fight_id", "left")


def side_by_side(rows: DataFrame, columns: list[str], carried: tuple[str, ...] = ()) -> DataFrame:
    """Both participants' rows as one row a bout: ``columns`` as a_* and b_*; ``carried`` stand alike in both rows."""
    pick = lambda s: [F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{s}_{c}") for c in columns]
    return rows.groupBy("fight_id").agg(*[F.first(c).alias(c) for c in carried], *pick("a"), *pick("b"))


def differences(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select("*", *[(F.col(f"a_{c}") - F.col(f"b_{c}")).alias(f"diff_{c}") for c in columns])


def schedule_strength(rows: DataFrame, value: str, n: int = 5) -> DataFrame:
    """Weighted mean of the last ``n`` opponents' ``value`` in those bouts; weights 1..k, gaps keep their rank."""
    met = rows.select("fight_id", F.col("entity").alias("opponent"), F.col(value).alias("__ov"))
    joined = rows.join(met, ["fight_id", "opponent"], "left")
    items = F.collect_list(F.struct(F.col("__ov").alias("v"))).over(last(n))
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("w"), F.lit(0).alias("i"))
    step = lambda a, x: F.struct((a["s"] + F.coalesce(x["v"], F.lit(0.0)) * (a["i"] + 1)).alias("s"), (a["w"] + F.when(x["v"].isNull(), 0.0).otherwise((a["i"] + 1).cast("double"))).alias("w"), (a["i"] + 1).alias("i"))
    return joined.withColumn("opp_strength", F.aggregate(items, zero, step, lambda a: F.when(a["w"] > 0, a["s"] / a["w"]))).drop("__ov")


def head_to_head(bouts: DataFrame) -> DataFrame:
    """Whether the pair met before and how far side a leads; orientation does not matter."""
    lo, hi = F.least("a_id", "b_id"), F.greatest("a_id", "b_id")
    sign = F.when(F.col("winner") == lo, 1).when(F.col("winner") == hi, -1).otherwise(0)
    w = before("__lo", "__hi")
    out = bouts.withColumn("__lo", lo).withColumn("__hi", hi).withColumn("__s", sign)
    lead = F.coalesce(F.sum("__s").over(w), F.lit(0)) * F.when(F.col("a_id") == F.col("__lo"), 1).otherwise(-1)
    return out.withColumn("is_rematch", (F.count(F.lit(1)).over(w) > 0).cast("long")).withColumn("h2h_diff", lead.cast("long")).drop("__lo", "__hi", "__s")


def class_moves(rows: DataFrame) -> DataFrame:
    """1 where a participant's class is not the mode of their earlier ones (the first seen of equal modes); null without any."""
    per = entity("entity", "weight_class")
    first = rows.where(F.col("weight_class").isNotNull()).select("*", F.row_number().over(entity()).alias("__i"), F.row_number().over(per).alias("__k"))
    first = first.withColumn("__f", F.first("__i").over(per))
    # a class leads once its count passes all others': the running best of (count, earliest first)
    best = F.max(F.struct(F.col("__k").alias("k"), (-F.col("__f")).alias("f"), F.col("weight_class").alias("c"))).over(before())
    out = first.withColumn("__m", best["c"])
    return out.withColumn("class_move", F.when(F.col("__m").isNotNull(), (F.col("__m") != F.col("weight_class")).cast("long"))).drop("__i", "__k", "__f", "__m")


def momentum(rows: DataFrame, value: str, n: int = 5) -> DataFrame:
    """Least-squares slope of the last ``n`` values by position; 0 with fewer than two."""
    i = F.row_number().over(entity()).cast("double")
    out = rows.withColumn("__i", i)
    w = last(n)
    return out.withColumn("momentum", F.when(F.count(value).over(w) < 2, 0.0).otherwise(F.regr_slope(F.col(value), F.col("__i")).over(w))).drop("__i")


def opponents_mean(rows: DataFrame, value: str, n: int = 5, initial: float = 1500.0) -> DataFrame:
    return rows.withColumn("opponents_mean", F.coalesce(F.avg(value).over(last(n)), F.lit(initial)))


def established(bouts: DataFrame) -> DataFrame:
    """1 where both sides had a bout on a strictly earlier date."""
    ids = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"{s}_id").alias("entity")) for s in "ab"])).alias("x")
    seen = bouts.select("fight_id", "event_date", ids).select("fight_id", "event_date", "x.*")
    seen = seen.withColumn("old", F.min("event_date").over(Window.partitionBy("entity")) < F.col("event_date"))
    return bouts.join(seen.groupBy("fight_id").agg(F.every("old").cast("long").alias("established")), "fight_id")


def available_history(rows: DataFrame, captured: str, value: str) -> DataFrame:
    """Count and mean of the values captured strictly before each bout.

    Captures and bouts of a participant are merged on one time line and summed along it, which
    costs a sort where a range join would pair every bout with every earlier one.
    """
    seen = rows.select("entity", F.col(captured).alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("fight_id"), F.col(value).alias("v"))
    asks = rows.select("entity", F.col("event_date").alias("at"), F.lit(0).alias("kind"), "fight_id", F.lit(None).cast("double").alias("v"))
    w = Window.partitionBy("entity").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, -1)
    both = seen.unionByName(asks).select("entity", "fight_id", "kind", F.coalesce(F.sum(F.when(F.col("kind") == 1, 1)).over(w), F.lit(0)).cast("long").alias("n_visible"), F.avg("v").over(w).alias("mean_visible"))
    return both.where("kind = 0").drop("kind")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, columns: list[str], strict: bool = False) -> DataFrame:
    """The latest right row at or (``strict``) strictly before each left row's time, by union and a running last value."""
    payload = F.struct(F.col(right_time).alias("__rt"), *columns)
    kind = {"l": 0, "r": 1} if strict else {"l": 1, "r": 0}
    ls = left.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col(left_time).alias("__t"), F.lit(kind["l"]).alias("__o"), F.struct("*").alias("__l"), F.lit(None).cast(right.select(payload.alias("p")).schema["p"].dataType).alias("__r"))
    rs = right.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col(right_time).alias("__t"), F.lit(kind["r"]).alias("__o"), F.lit(None).cast(ls.schema["__l"].dataType).alias("__l"), payload.alias("__r"))
    w = Window.partitionBy(*[f"__k_{k}" for k in keys]).orderBy("__t", "__o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = ls.unionByName(rs).withColumn("__r", F.last("__r", ignorenulls=True).over(w)).where(F.col("__l").isNotNull())
    return out.select("__l.*", *[F.col(f"__r.{c}").alias(c) for c in columns], F.col("__r.__rt").alias(f"{right_time}_used"))


def elo(bouts: DataFrame, pool: str | None = None, k: float = 32.0, start: float = 1500.0) -> DataFrame:
    """fight_id, event_date and each side's id and rating before and after its bout; K is half as much again below five bouts, a draw counts a half.

    A rating couples both participants, so bouts are folded in time order; one rating holds over all
    bouts. The bouts of each month are sorted side by side and packed; the packs, which are few and
    small, are put in order and streamed through the fold, which keeps two numbers a participant and
    no bouts. Ratings are written as they come, so the fold's task hands nothing to a shuffle.
    ``pool`` names a column that splits participants who never meet (leagues), whose bouts are then
    folded side by side.
    """
    from ..sources.tables import written

    def pack(batches):
        seq = 0
        for b in batches:
            keys = list(zip(b.column("pool").to_pylist(), b.column("month").to_pylist()))
            at = 0
            for i in range(1, len(keys) + 1):
                if i == len(keys) or keys[i] != keys[at]:
                    part, sink = b.slice(at, i - at), pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                        out.write_batch(part)
                    yield pa.RecordBatch.from_arrays([part.column("pool")[:1], part.column("month")[:1], pa.array([seq], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["pool", "month", "seq", "bouts"])
                    at, seq = i, seq + 1

    def unpacked(batches):
        for b in batches:
            for x in b.column("bouts"):
                yield from pa.ipc.open_stream(x.as_buffer())

    def fold(batches):
        state: dict = {}
        for b in unpacked(batches):
            keys = b.column("pool").to_pylist()
            ids = list(zip(keys, b.column("a_id").to_pylist())), list(zip(keys, b.column("b_id").to_pylist()))
            out = [[], [], [], []]
            for x, y, w in zip(*ids, b.column("winner").to_pylist()):
                (rx, nx), (ry, ny) = state.get(x, (start, 0)), state.get(y, (start, 0))
                want = 1 / (1 + 10 ** ((ry - rx) / 400))
                got = 1.0 if w == x[1] else 0.0 if w == y[1] else 0.5
                change = got - want
                state[x] = rx + k * (1.5 if nx < 5 else 1.0) * change, nx + 1
                state[y] = ry - k * (1.5 if ny < 5 else 1.0) * change, ny + 1
                for col, v in zip(out, (rx, ry, state[x][0], state[y][0])):
                    col.append(v)
            kept = {c: b.column(c) for c in ("fight_id", "event_date", "a_id", "b_id")}
            yield pa.RecordBatch.from_pydict(kept | {n: pa.array(c, pa.float64()) for n, c in zip(("elo_a", "elo_b", "after_a", "after_b"), out)})

    cols = bouts.select((F.col(pool) if pool else F.lit(0)).alias("pool"), F.trunc("event_date", "month").alias("month"), "fight_id", "event_date", "a_id", "b_id", "winner")
    # a month of a pool is in one task, so its packs count on in the order of its bouts
    packs = cols.repartition("pool", "month").sortWithinPartitions("pool", "month", "event_date", "fight_id")
    packs = packs.mapInArrow(pack, cols.select("pool", "month").schema.add("seq", "long").add("bouts", "binary"))
    ordered = (packs.repartition("pool") if pool else packs.repartition(1)).sortWithinPartitions("month", "seq")
    kept = cols.select("fight_id", "event_date", "a_id", "b_id").schema
    for n in ("elo_a", "elo_b", "after_a", "after_b"):
        kept = kept.add(n, "double")
    return written(ordered.mapInArrow(fold, kept), "ratings")


def rating_rows(ratings: DataFrame) -> DataFrame:
    """Two rows a bout: participant, opponent, rating before, the opponent's before, rating after."""
    side = lambda s, o: F.struct(F.lit(s).alias("side"), F.col(f"{s}_id").alias("entity"), F.col(f"{o}_id").alias("opponent"), F.col(f"elo_{s}").alias("rating"), F.col(f"elo_{o}").alias("opp_rating"), F.col(f"after_{s}").alias("after"))
    return ratings.select("fight_id", "event_date", F.explode(F.array(side("a", "b"), side("b", "a"))).alias("x")).select("fight_id", "event_date", "x.*")
