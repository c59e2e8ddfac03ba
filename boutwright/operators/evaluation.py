"""Scores of predictions and bet logs: losses, calibration, drawdowns, bootstraps and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _mean(c: Column, weight: str | None) -> Column:
    return F.sum(F.col(weight) * c) / F.sum(weight) if weight else F.avg(c)


def _rows(weight: str | None) -> Column:
    return (F.sum(weight).cast("long") if weight else F.count(F.lit(1))).alias("n")


def losses(df: DataFrame, keys: list[str], y: str = "target", p: str = "prob_a", weight: str | None = None) -> DataFrame:
    """n, brier, log_loss and accuracy by ``keys``; a row stands for ``weight`` rows."""
    q = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), F.col(p)))
    t = F.col(y)
    return df.groupBy(*keys).agg(_rows(weight), _mean(F.pow(F.col(p) - t, 2.0), weight).alias("brier"), _mean(-(t * F.log(q) + (1 - t) * F.log(1 - q)), weight).alias("log_loss"), _mean(((F.col(p) >= 0.5).cast("int") == t).cast("double"), weight).alias("accuracy"))


def calibration_bins(df: DataFrame, keys: list[str], y: str = "target", p: str = "prob_a", bins: int = 10, weight: str | None = None) -> DataFrame:
    b = F.least(F.floor(F.round(F.col(p) * bins, 9)), F.lit(bins - 1)).cast("int")
    return df.groupBy(*keys, b.alias("bin")).agg(_rows(weight), _mean(F.col(p), weight).alias("mean_prob"), _mean(F.col(y), weight).alias("rate"))


def calibration_error(bins: DataFrame, keys: list[str]) -> DataFrame:
    return bins.groupBy(*keys).agg((F.sum(F.col("n") * F.abs(F.col("mean_prob") - F.col("rate"))) / F.sum("n")).alias("ece"))


def auc(df: DataFrame, keys: list[str], y: str = "target", p: str = "prob_a") -> DataFrame:
    """Rank-sum AUC from counts by distinct score: no window over all rows, ties count a half."""
    by = df.groupBy(*keys, F.col(p).alias("__p")).agg(F.sum(y).cast("double").alias("pos"), F.sum(1 - F.col(y)).cast("double").alias("neg"))
    w = Window.partitionBy(*keys).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    below = by.withColumn("__below", F.coalesce(F.sum("neg").over(w), F.lit(0.0)))
    return below.groupBy(*keys).agg(F.try_divide(F.sum(F.col("pos") * (F.col("__below") + F.col("neg") / 2)), F.sum("pos") * F.sum("neg")).alias("auc"))


def mcnemar(df: DataFrame, y: str, a: str, b: str) -> DataFrame:
    """Continuity-corrected statistic of two models' 0.5 decisions."""
    ra, rb = (F.col(a) >= 0.5).cast("int") == F.col(y), (F.col(b) >= 0.5).cast("int") == F.col(y)
    out = df.agg(F.sum((ra & ~rb).cast("long")).alias("only_a"), F.sum((~ra & rb).cast("long")).alias("only_b"))
    d = F.abs(F.col("only_a") - F.col("only_b")) - 1
    return out.withColumn("statistic", F.try_divide((d * d).cast("double"), (F.col("only_a") + F.col("only_b")).cast("double")))


def bet_summary(bets: DataFrame, keys: list[str], per_year: float = 300.0) -> DataFrame:
    r = F.col("pnl") / F.col("stake")
    return bets.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("pnl").alias("profit"), F.sum("stake").alias("staked"), (F.sum("pnl") / F.sum("stake")).alias("roi"), F.avg("won").alias("win_rate"), (F.avg(r) / F.stddev_samp(r) * F.sqrt(F.lit(per_year))).alias("sharpe"), F.avg(F.col("pnl") / F.col("stake") - F.col("edge")).alias("edge_gap"))


def drawdown_by(bets: DataFrame, keys: list[str], order: list[str], start: float = 1000.0) -> DataFrame:
    """Bankroll path of each key: end, peak and the largest fall below a running peak."""
    w = Window.partitionBy(*keys).orderBy(*order)
    bank = bets.withColumn("bank", F.lit(start) + F.sum("pnl").over(w))
    peak = bank.withColumn("peak", F.greatest(F.lit(start), F.max("bank").over(w)))
    return peak.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max_by("bank", F.struct(*order)).alias("final"), F.max("peak").alias("peak"), F.max(F.col("peak") - F.col("bank")).alias("max_drawdown"), F.max((F.col("peak") - F.col("bank")) / F.col("peak")).alias("max_drawdown_share"))


def leave_one_out(bets: DataFrame, event: str, key: str, limit: float = 0.05) -> DataFrame:
    """ROI of a key without each of its events: totals less the event's sums."""
    per = bets.groupBy(key, event).agg(F.sum("pnl").alias("p"), F.sum("stake").alias("s"))
    all_ = bets.groupBy(key).agg(F.sum("pnl").alias("tp"), F.sum("stake").alias("ts"))
    out = per.join(all_, key)
    roi, rest = F.col("tp") / F.col("ts"), F.try_divide(F.col("tp") - F.col("p"), F.col("ts") - F.col("s"))
    return out.select(key, event, roi.alias("roi"), rest.alias("roi_without"), (rest - roi).alias("shift"), (F.abs(rest - roi) > limit).alias("fragile"))


def extremes(bets: DataFrame, event: str, n: int) -> DataFrame:
    """The n best and the n worst events."""
    per = bets.groupBy(event).agg(F.sum("pnl").alias("pnl"), F.count(F.lit(1)).alias("n_bets"))
    top = per.orderBy(F.desc("pnl"), event).limit(n).withColumn("kind", F.lit("best"))
    return top.unionByName(per.orderBy("pnl", event).limit(n).withColumn("kind", F.lit("worst")))


def fold_summary(bets: DataFrame, folds: DataFrame) -> DataFrame:
    """All (strategy, fold) pairs of the fold table with zeros where nothing was bet."""
    got = bets.groupBy("strategy", "fold").agg(F.count(F.lit(1)).alias("n"), F.sum("pnl").alias("pnl"))
    return folds.join(got, ["strategy", "fold"], "left").na.fill(0, ["n"]).na.fill(0.0, ["pnl"])


def poisson_weights(ids, rounds: int, seed: int):
    """[row, round]: Poisson weights drawn from hashes of the ids (uint64), alike wherever a row stands."""
    import numpy as np

    cdf = np.cumsum([np.exp(-1.0) / float(np.prod(np.arange(1, k + 1))) for k in range(12)])
    h = ids.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(rounds, dtype=np.uint64)[None, :] * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(seed)
    for shift, mix in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(mix)
    h ^= h >> np.uint64(31)
    # the first bits of a draw tell its weight, unless a limit of the distribution lies between their draws
    edges = np.arange((1 << DRAW_BITS) + 1) / (1 << DRAW_BITS)
    low, high = np.searchsorted(cdf, edges[:-1], side="right"), np.searchsorted(cdf, edges[1:], side="left")
    at = (h >> np.uint64(64 - DRAW_BITS)).astype(np.uint16)
    out = low.astype(float)[at]
    open_ = np.flatnonzero((low != high)[at])
    out.flat[open_] = np.searchsorted(cdf, (h.flat[open_] >> np.uint64(11)).astype(float) / 2.0**53, side="right")
    return out


#: First bits of a draw that are looked up, and rows whose weights for all rounds stand in a processor's cache.
DRAW_BITS, DRAWN = 12, 256


def bootstrap_sums(df: DataFrame, row: str, columns: list[str], rounds: int, seed: int) -> DataFrame:
    """round and the weighted sums of ``columns`` in it: a task adds up its rows for all rounds and hands on the sums alone."""
    import numpy as np
    import pandas as pd

    def sums(frames):
        total = np.zeros((rounds, len(columns)))
        for f in frames:
            for at in range(0, len(f), DRAWN):
                g = f.iloc[at : at + DRAWN]
                total += poisson_weights(g["id"].to_numpy(), rounds, seed).T @ g[[f"c{i}" for i in range(len(columns))]].to_numpy(float)
        yield pd.DataFrame({"round": np.arange(rounds, dtype=np.int32), **{f"c{i}": total[:, i] for i in range(len(columns))}})

    src = df.select(F.xxhash64(row).alias("id"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"c{i}") for i, c in enumerate(columns)])
    part = src.mapInPandas(sums, "round int, " + ", ".join(f"c{i} double" for i in range(len(columns))))
    return part.groupBy("round").agg(*[F.sum(f"c{i}").alias(c) for i, c in enumerate(columns)])


def _interval(diff: str) -> list[Column]:
    return [F.percentile(diff, F.lit(0.025)).alias("low"), F.percentile(diff, F.lit(0.975)).alias("high"), F.avg((F.col(diff) <= 0).cast("double")).alias("p_value")]


def paired_bootstrap(a: DataFrame, b: DataFrame, event: str, rounds: int = 2000, seed: int = 42) -> DataFrame:
    """Observed profit and ROI differences, and an event-clustered Poisson bootstrap of the former; an absent event counts nothing."""
    sums = lambda df, s: df.groupBy(event).agg(F.sum("pnl").alias(f"p{s}"), F.sum("stake").alias(f"s{s}"))
    d = sums(a, "a").join(sums(b, "b"), event, "full").na.fill(0.0, ["pa", "pb", "sa", "sb"]).withColumn("d", F.col("pa") - F.col("pb"))
    roi = lambda s: F.coalesce(F.try_divide(F.sum(f"p{s}"), F.sum(f"s{s}")), F.lit(0.0))
    seen = d.agg(F.count(F.lit(1)).alias("n_events"), F.sum("d").alias("profit_diff"), (roi("a") - roi("b")).alias("roi_diff"))
    drawn = bootstrap_sums(d, event, ["d"], rounds, seed).agg(*_interval("d"))
    return seen.crossJoin(F.broadcast(drawn))  # one row beside one row


def unpaired_bootstrap(a: DataFrame, b: DataFrame, bet: str, rounds: int = 2000, seed: int = 42) -> DataFrame:
    """Observed ROI difference of two independent sets of bets, its 95 % interval and the share of rounds in which the first is no better; each bet draws its own weights, apart for either set."""
    roi = lambda p, s: F.coalesce(F.try_divide(p, s), F.lit(0.0))
    arm = lambda df: df.agg(F.count(F.lit(1)).alias("n"), roi(F.sum("pnl"), F.sum("stake")).alias("roi"))
    seen = arm(a).withColumnsRenamed({"n": "n_a", "roi": "roi_a"}).crossJoin(F.broadcast(arm(b).withColumnsRenamed({"n": "n_b", "roi": "roi_b"})))  # one row beside one row
    draw = lambda df, s, x: bootstrap_sums(df, bet, ["pnl", "stake"], rounds, s).select("round", roi(F.col("pnl"), F.col("stake")).alias(x))
    drawn = draw(a, seed, "ra").join(draw(b, seed + 1, "rb"), "round").select((F.col("ra") - F.col("rb")).alias("d")).agg(*_interval("d"))
    return seen.withColumn("roi_diff", F.col("roi_a") - F.col("roi_b")).crossJoin(F.broadcast(drawn))


def promotion(metrics: DataFrame) -> DataFrame:
    """Model bar: Brier or calibration better, the other at most a tenth worse; and the selection score."""
    better_b, better_e = F.col("brier_new") < F.col("brier_old"), F.col("ece_new") < F.col("ece_old")
    ok = (better_b & (F.col("ece_new") <= 1.1 * F.col("ece_old"))) | (better_e & (F.col("brier_new") <= 1.1 * F.col("brier_old")))
    score = -(F.col("brier_new") - F.col("brier_old")) - (F.col("ece_new") - F.col("ece_old")) - F.greatest(F.lit(0.0), F.col("ll_new") - F.col("ll_old"))
    return metrics.withColumn("model_bar", ok).withColumn("score", score)


def confusion(df: DataFrame, keys: list[str], y: str = "target", p: str = "prob_a") -> DataFrame:
    hit: Column = (F.col(p) >= 0.5).cast("int")
    one = lambda a, b: F.sum(((hit == a) & (F.col(y) == b)).cast("long"))
    return df.groupBy(*keys).agg(one(1, 1).alias("tp"), one(1, 0).alias("fp"), one(0, 1).alias("fn"), one(0, 0).alias("tn"))


def bootstrap_metrics(df: DataFrame, row: str, y: str = "target", probs: tuple[str, ...] = ("prob_a",), rounds: int = 1000, seed: int = 42) -> DataFrame:
    """round, model and accuracy, brier, log_loss, ece of Poisson bootstrap samples of the rows.

    Each row draws its weights from a hash of its id, alike for all models (paired) and wherever it
    stands. A task adds up weights, losses and calibration bins of its rows for all rounds and hands
    on only these sums, so nothing is resampled and nothing grows with the rows.
    """
    import numpy as np
    import pandas as pd

    width = 3 + 3 * 10 + 1

    def sums(frames):
        total = np.zeros((len(probs), rounds, width))
        for f in frames:
            for at in range(0, len(f), DRAWN):
                g = f.iloc[at : at + DRAWN]
                w, t = poisson_weights(g["id"].to_numpy(), rounds, seed), g["y"].to_numpy(float)
                for i in range(len(probs)):
                    p = g[f"p{i}"].to_numpy(float)
                    q = np.clip(p, 1e-15, 1 - 1e-15)
                    x = np.zeros((len(g), width))
                    x[:, 0], x[:, 1], x[:, 2], x[:, 3] = 1, (p > 0.5) == (t > 0.5), (p - t) ** 2, -(t * np.log(q) + (1 - t) * np.log(1 - q))
                    b = np.minimum(np.floor(np.round(p * 10, 9)), 9).astype(int)
                    for k, v in enumerate((np.ones_like(p), p, t)):
                        x[np.arange(len(g)), 4 + 10 * k + b] = v
                    total[i] += w.T @ x
        rows = [(r, i, total[i, r].tolist()) for i in range(len(probs)) for r in range(rounds)]
        yield pd.DataFrame(rows, columns=["round", "model", "s"])

    src = df.select(F.xxhash64(row).alias("id"), F.col(y).cast("double").alias("y"), *[F.col(p).cast("double").alias(f"p{i}") for i, p in enumerate(probs)])
    part = src.mapInPandas(sums, "round int, model int, s array<double>")
    s = part.groupBy("round", "model").agg(*[F.sum(F.get("s", i)).alias(f"s{i}") for i in range(width)])
    n = F.col("s0")
    ece = sum((F.abs(F.col(f"s{14 + b}") - F.col(f"s{24 + b}")) for b in range(10)), F.lit(0.0)) / n
    name = F.element_at(F.array(*[F.lit(p) for p in probs]), F.col("model") + 1)
    return s.where(n > 0).select("round", name.alias("model"), (F.col("s1") / n).alias("accuracy"), (F.col("s2") / n).alias("brier"), (F.col("s3") / n).alias("log_loss"), ece.alias("ece"))


METRICS = ("accuracy", "brier", "log_loss", "ece")


def metric_intervals(samples: DataFrame) -> DataFrame:
    """95 % intervals of each model's metrics over bootstrap rounds."""
    return samples.groupBy("model").agg(*[F.percentile(m, F.lit(q)).alias(f"{m}_{n}") for m in METRICS for q, n in ((0.025, "lo"), (0.975, "hi"))])


def metric_comparison(samples: DataFrame, base: str, challenger: str) -> DataFrame:
    """Mean paired difference of each metric, its interval and the share of rounds in which the challenger is no better."""
    # one pass over the rounds: a join of two parts of the samples would draw them twice
    of = lambda model, m: F.max(F.when(F.col("model") == model, F.col(m)))
    has = [F.count_if(F.col("model") == m).alias(f"__{i}") for i, m in enumerate((base, challenger))]
    d = samples.where(F.col("model").isin(base, challenger)).groupBy("round").agg(*has, *[(of(challenger, m) - of(base, m)).alias(m) for m in METRICS]).where("__0 > 0 and __1 > 0")
    worse = lambda m: F.col(m) <= 0 if m == "accuracy" else F.col(m) >= 0
    out = [F.struct(F.lit(m).alias("metric"), F.avg(m).alias("diff"), F.percentile(m, F.lit(0.025)).alias("lo"), F.percentile(m, F.lit(0.975)).alias("hi"), F.avg(worse(m).cast("double")).alias("p_value")) for m in METRICS]
    return d.agg(F.array(*out).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def drawdown_length(bets: DataFrame, keys: list[str], order: list[str], start: float = 1000.0) -> DataFrame:
    """Longest run of bets below an earlier peak of the bankroll."""
    w = Window.partitionBy(*keys).orderBy(*order)
    bank = bets.withColumn("__b", F.lit(start) + F.sum("pnl").over(w)).withColumn("__i", F.row_number().over(w))
    low = bank.withColumn("__under", F.col("__b") < F.greatest(F.lit(start), F.max("__b").over(w)))
    run = low.withColumn("__g", F.sum((~F.col("__under")).cast("int")).over(w)).where("__under").groupBy(*keys, "__g").count()
    return bets.select(*keys).distinct().join(run.groupBy(*keys).agg(F.max("count").alias("longest")), keys, "left").na.fill(0, ["longest"])


def outlier_years(bets: DataFrame, keys: list[str], limit: float = 1.5) -> DataFrame:
    """ROI by year and whether it lies more than ``limit`` sample deviations from the key's mean year."""
    per = bets.groupBy(*keys, F.year("event_date").alias("year")).agg(F.count(F.lit(1)).alias("n"), (F.sum("pnl") / F.sum("stake")).alias("roi"))
    w = Window.partitionBy(*keys)
    far = F.abs(F.col("roi") - F.avg("roi").over(w)) > limit * F.stddev_samp("roi").over(w)
    return per.withColumn("outlier", F.coalesce(far, F.lit(False)))


def with_baselines(df: DataFrame, keys: list[str], models: dict[str, str], y: str = "target") -> DataFrame:
    """Losses and calibration of several probability columns side by side, a row a key and model; rows a model does not cover are left out of it."""
    out = None
    for name, col in models.items():
        own = df.where(F.col(col).isNotNull())
        part = losses(own, keys, y, col).join(calibration_error(calibration_bins(own, keys, y, col), keys), keys).join(auc(own, keys, y, col), keys).withColumn("model", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def sliced(df: DataFrame, slices: dict[str, Column]) -> DataFrame:
    """Every row once for each slice it is in, with the slice's name."""
    hit = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in slices.items()]), lambda s: s.isNotNull())
    return df.withColumn("slice", F.explode(hit))
