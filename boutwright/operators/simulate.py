"""Sequential bankroll simulations: one ordered fold a (strategy, parameter) group.

State couples all bets of a group, so groups are the unit of parallel work. Bets are streamed in
order through their group's fold; batched settlement sums each day first and folds the days.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def kelly_fold(bets: DataFrame, keys: list[str], order: list[str], share: Column | float = 0.25, cap: float = 0.04, start: float = 1000.0, stop: float = 0.4) -> DataFrame:
    """Immediate settlement: stake min(share * f, cap) of equity, none under 1 or once equity falls below ``stop`` of the start.

    Bets are sorted by group and order on the cluster and streamed through the fold, which keeps five
    numbers of the group at hand, however many bets it has.
    """
    share = share if isinstance(share, Column) else F.lit(share)
    f = ((F.col("odds") - 1) * F.col("prob") - (1 - F.col("prob"))) / (F.col("odds") - 1)
    part = F.least(F.greatest(share * f, F.lit(0.0)), F.lit(cap)).cast("double")
    gain = F.when(F.col("won") == 1, F.col("odds") - 1).otherwise(-1.0).cast("double")
    cols = bets.select(*keys, *[F.col(o).alias(f"__o{i}") for i, o in enumerate(order)], part.alias("__f"), gain.alias("__g"))
    ordered = cols.repartition(*keys).sortWithinPartitions(*keys, *[f"__o{i}" for i in range(len(order))])
    names, schema = ("final", "peak", "staked", "n_bets", "max_drawdown"), cols.select(*keys).schema
    for n in names:
        schema = schema.add(n, T.IntegerType() if n == "n_bets" else T.DoubleType())

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, cash, peak, staked, n, low = None, start, start, 0.0, 0, 0.0

        def done(groups: list) -> pa.RecordBatch:
            flat = [(*k, *v) for k, v in groups]
            return pa.RecordBatch.from_pydict({c: pa.array([r[i] for r in flat], types[c]) for i, c in enumerate((*keys, *names))})

        types = {n: pa.int32() if n == "n_bets" else pa.float64() for n in names}
        for batch in batches:
            types |= {k: batch.schema.field(k).type for k in keys}
            ended = []
            for key, f, g in zip(zip(*[batch.column(k).to_pylist() for k in keys]), batch.column("__f").to_pylist(), batch.column("__g").to_pylist()):
                if key != at:
                    if at is not None:
                        ended.append((at, (cash, peak, staked, n, low)))
                    at, cash, peak, staked, n, low = key, start, start, 0.0, 0, 0.0
                stake = cash * f if f is not None else 0.0
                if stake < 1 or cash < stop * start:
                    continue
                cash += stake * g
                peak, staked, n = max(peak, cash), staked + stake, n + 1
                low = max(low, peak - cash)
            if ended:
                yield done(ended)
        if at is not None:
            yield done([(at, (cash, peak, staked, n, low))])

    return ordered.mapInArrow(fold, schema)


def batched_settlement(bets: DataFrame, keys: list[str], day: str, share: float = 0.25, cap: float = 0.04, start: float = 1000.0) -> DataFrame:
    """Bets of a day are sized on the equity before it and settle together when the day is over; cash limits their sum."""
    f = (((F.col("odds") - 1) * F.col("prob")) - (1 - F.col("prob"))) / (F.col("odds") - 1)
    frac = F.least(F.greatest(F.lit(share) * f, F.lit(0.0)), F.lit(cap))
    gain = F.when(F.col("won") == 1, F.col("odds") - 1).otherwise(-1.0)
    # within a day all stakes are fractions of one equity: the day's return is a sum, scaled if it asks for more than there is
    per = bets.groupBy(*keys, day).agg(F.sum(frac).alias("asked"), F.sum(frac * gain).alias("ret"))
    fit = F.when(F.col("asked") > 1, F.col("ret") / F.col("asked")).otherwise(F.col("ret"))
    seq = F.sort_array(F.collect_list(F.struct(F.col(day), fit.alias("r"), F.least(F.col("asked"), F.lit(1.0)).alias("a"))))
    zero = F.struct(F.lit(start).alias("equity"), F.lit(0.0).alias("staked"))
    step = lambda s, x: F.struct((s["equity"] * (1 + x["r"])).alias("equity"), (s["staked"] + s["equity"] * x["a"]).alias("staked"))
    out = per.groupBy(*keys).agg(F.aggregate(seq, zero, step).alias("s"), F.count(F.lit(1)).alias("n_days"))
    return out.select(*keys, "n_days", F.col("s.equity").alias("final"), F.col("s.staked").alias("staked"))


def sweep(bets: DataFrame, keys: list[str], order: list[str], shares: list[float]) -> DataFrame:
    """kelly_fold for each share in parallel; the grid is exploded onto the bets, so it is part of the group key."""
    grid = bets.withColumn("share", F.explode(F.array(*map(F.lit, shares))))
    return kelly_fold(grid, [*keys, "share"], order, F.col("share"))


def liquidity(p: Column) -> Column:
    """Assumed depth of a market, largest at even prices."""
    return 180 - 145 * (1 - 4 * p * (1 - p))


def realistic_fill(df: DataFrame, prob: str, stake: str, tick: float = 0.01, half_spread: float = 0.005) -> DataFrame:
    """Fill a stake against four synthetic levels above the ask: at most a quarter of the depth, none under 50, none with slippage over 3 %."""
    ask = F.greatest(F.lit(0.01), F.least(F.lit(0.99), F.col(prob) + half_spread))
    depth = liquidity(F.col(prob))
    want = F.least(F.col(stake), 0.25 * depth)
    levels = F.transform(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(s).alias("share")) for i, s in enumerate((0.10, 0.15, 0.25, 0.50))]), lambda x: F.struct((ask + x["i"] * tick).alias("price"), (depth * x["share"]).alias("size")))
    zero = F.struct(want.alias("left"), F.lit(0.0).alias("shares"))
    step = lambda s, x: F.struct((s["left"] - F.least(s["left"], x["size"])).alias("left"), (s["shares"] + F.least(s["left"], x["size"]) / x["price"]).alias("shares"))
    out = df.withColumn("__f", F.aggregate(levels, zero, step)).withColumn("filled", want - F.col("__f.left"))
    avg = F.try_divide(F.col("filled"), F.col("__f.shares"))
    reason = F.when(depth < 50, "thin").when(avg / ask - 1 > 0.03, "slippage").otherwise("filled")
    return out.withColumn("fill_price", avg).withColumn("status", reason).drop("__f")
