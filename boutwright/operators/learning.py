"""Training data: mirrored rows, holdouts, folds, noise, imputation and models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def swapped(df: DataFrame) -> DataFrame:
    """Sides exchanged: a_x and b_x trade places, diff_x changes sign."""
    cols = set(df.columns)

    def out(c: str) -> Column:
        if c.startswith("a_") and "b_" + c[2:] in cols:
            return F.col("b_" + c[2:]).alias(c)
        if c.startswith("b_") and "a_" + c[2:] in cols:
            return F.col("a_" + c[2:]).alias(c)
        return (-F.col(c)).alias(c) if c.startswith("diff_") else F.col(c)

    return df.select(*[out(c) for c in df.columns])


def mirrored(df: DataFrame, target: str = "target") -> DataFrame:
    """Rows and their mirror images with the target flipped; a pair shares its group."""
    return df.withColumn("mirror", F.lit(0)).unionByName(swapped(df).withColumn(target, 1 - F.col(target)).withColumn("mirror", F.lit(1)))


def temporal_holdout(df: DataFrame, order: list[str], share: float = 0.8) -> DataFrame:
    """train or test by time. The cut comes from counts by day, so no window spans all rows."""
    day = order[0]
    counts = df.groupBy(day).count()
    total = counts.agg(F.sum("count")).first()[0] or 0
    w = Window.orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    cut = counts.withColumn("before", F.coalesce(F.sum("count").over(w), F.lit(0))).where(F.col("before") >= share * total).agg(F.min(day)).first()[0]
    test = F.col(day) >= F.lit(cut) if cut is not None else F.lit(False)
    return df.withColumn("split", F.when(test, "test").otherwise("train"))


def impute(df: DataFrame, columns: list[str]) -> DataFrame:
    """Medians for unknowns, with a flag for each."""
    row = df.agg(*[F.percentile(c, F.lit(0.5)).alias(c) for c in columns]).first()
    return df.select("*", *[F.coalesce(F.col(c), F.lit(row[c])).alias(f"{c}_filled") for c in columns], *[F.col(c).isNull().cast("int").alias(f"{c}_missing") for c in columns])


def symmetrised(p: Column, p_swapped: Column) -> Column:
    return (p + 1 - p_swapped) / 2


def antithetic_noise(df: DataFrame, a: str, b: str, key: str, sd: float = 0.03, seed: int = 7) -> DataFrame:
    """Noise from a hash of the key added to a and taken from b, so their sum stays; clipped to [0.02, 0.98]."""
    u = lambda s: (F.pmod(F.xxhash64(F.col(key), F.lit(s)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    z = F.sqrt(-2 * F.log(u(seed))) * F.cos(2 * 3.141592653589793 * u(seed + 1))
    pa = F.greatest(F.lit(0.02), F.least(F.lit(0.98), F.col(a) + sd * z))
    return df.withColumn(a, pa).withColumn(b, F.when(F.col(b).isNotNull(), 1 - F.col(a)))


def folds(start: str, end: str, spark, months: int = 6) -> DataFrame:
    """Walk-forward windows [fold_start, fold_end)."""
    f = spark.sql(f"SELECT explode(sequence(DATE '{start}', DATE '{end}', INTERVAL {months} MONTHS)) AS fold_start")
    return f.withColumn("fold_end", F.add_months("fold_start", months))


def logistic(df: DataFrame, features: list[str], target: str = "target"):
    """A fitted logistic model over the features."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    steps = [VectorAssembler(inputCols=features, outputCol="raw", handleInvalid="skip"), StandardScaler(inputCol="raw", outputCol="features"), LogisticRegression(labelCol=target, regParam=0.01, maxIter=30)]
    return Pipeline(stages=steps).fit(df)


def time_series_folds(df: DataFrame, group: str, day: str, splits: int = 5) -> DataFrame:
    """(fold, part, group): expanding training groups and the next block of test groups; mirrored rows of a group stay together.

    Groups are numbered by day, then group: days are counted first, so no window spans all groups.
    """
    groups = df.groupBy(group).agg(F.min(day).alias("__d"))
    counts = groups.groupBy("__d").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select("__d", F.coalesce(F.sum("__n").over(Window.orderBy("__d").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    total = counts.agg(F.sum("__n")).first()[0] or 0
    test = total // (splits + 1)
    at = groups.join(before, "__d").withColumn("__i", F.col("__before") + F.row_number().over(Window.partitionBy("__d").orderBy(group)) - 1)
    begin = lambda k: total - (splits - k) * test
    parts = [F.when(F.col("__i") < begin(k), F.struct(F.lit(k + 1).alias("fold"), F.lit("train").alias("part"))).when(F.col("__i") < begin(k) + test, F.struct(F.lit(k + 1).alias("fold"), F.lit("test").alias("part"))) for k in range(splits)]
    return at.select(group, F.explode(F.filter(F.array(*parts), lambda x: x.isNotNull())).alias("x")).select("x.fold", "x.part", group)


def with_folds(df: DataFrame, folds: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """``group`` and ``columns`` of the rows of ``df`` with ``parts``: the (fold, part) pairs of their group; written once, so that no fit shuffles the rows or reads their sources again."""
    from ..sources.tables import written

    dealt = folds.groupBy(group).agg(F.collect_list(F.struct("fold", "part")).alias("parts"))
    return written(df.select(group, *[c for c in columns if c != group]).join(dealt, group), "folds")


def with_series(df: DataFrame, group: str, day: str, columns: list[str], splits: int = 5) -> DataFrame:
    """``group`` and ``columns`` of the rows of ``df`` with ``segment``: how many test blocks of ``time_series_folds`` have begun before their group or with it.

    The rows are shuffled once and written. Where a block begins is then one day and one group of
    that day, so the folds need no joins: fold k trains on the segments below k and is tested on k.
    """
    from ..sources.tables import written

    rows = df.select(F.col(group).alias("__g"), F.col(day).alias("__day"), *[c for c in columns if c != group])
    at = written(rows.withColumns({"__d": F.min("__day").over(Window.partitionBy("__g")), "__first": F.row_number().over(Window.partitionBy("__g").orderBy("__g")) == 1}).drop("__day"), "series")
    counts = sorted(((r["__d"], r["n"]) for r in at.where("__first").groupBy("__d").agg(F.count(F.lit(1)).alias("n")).collect()), key=lambda x: (x[0] is not None, x[0]))
    total = sum(n for _, n in counts)
    begins, before, found = [total - (splits - k) * (total // (splits + 1)) for k in range(splits)], 0, []
    for d, n in counts:
        found += [(d, b - before) for b in begins if before <= b < before + n]
        before += n
    days = sorted({d for d, _ in found if d is not None})
    numbered = at.where(F.col("__first") & F.col("__d").isin(days)).withColumn("__i", F.row_number().over(Window.partitionBy("__d").orderBy("__g")) - 1)
    wanted = F.lit(False)
    for d, i in found:
        wanted = wanted | ((F.col("__d") == F.lit(d)) & (F.col("__i") == i))
    first = {(r["__d"], r["__i"]): r["__g"] for r in numbered.where(wanted).select("__d", "__i", "__g").collect()} if days else {}
    segment = F.lit(0)
    for d, i in found:
        g = first.get((d, i))
        begun = F.lit(True) if d is None else (F.col("__d") >= F.lit(d)) if g is None else (F.col("__d") > F.lit(d)) | ((F.col("__d") == F.lit(d)) & (F.col("__g") >= F.lit(g)))
        segment = segment + begun.cast("int")
    return at.where("__g is not null and __d is not null").select(F.col("__g").alias(group), *[c for c in columns if c != group], segment.alias("segment"))


def rows_of(dealt: DataFrame, fold: int, part: str) -> DataFrame:
    """The rows of ``with_folds`` or ``with_series`` that are in ``part`` of a fold."""
    if "segment" in dealt.columns:
        return dealt.where(F.col("segment") < fold if part == "train" else F.col("segment") == fold).drop("segment")
    return dealt.where(F.exists("parts", lambda x: (x["fold"] == fold) & (x["part"] == part))).drop("parts")


def odds_noise(df: DataFrame, columns: list[str], key: str, sd: float = 0.03, seed: int = 7) -> DataFrame:
    """Independent noise from hashes of the key on each column, clipped to [0.02, 0.98]; unknown stays unknown."""

    def z(i: int) -> Column:
        u = lambda s: (F.pmod(F.xxhash64(F.col(key), F.lit(i), F.lit(s)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
        return F.sqrt(-2 * F.log(u(seed))) * F.cos(2 * 3.141592653589793 * u(seed + 1))

    noisy = lambda c, i: F.when(F.col(c).isNotNull(), F.greatest(F.lit(0.02), F.least(F.lit(0.98), F.col(c) + sd * z(i))))
    return df.withColumns({c: noisy(c, i) for i, c in enumerate(columns)})


#: Fixed value: bins of a feature, as many as Spark's trees take unless told otherwise.
BINS = 32
#: Trees look at all cells for their splits, up to this number's square; a feature of theirs has ``BINS`` values at most.
LOOKED_AT = 1024


def bins(df: DataFrame, features: list[str]):
    """A model that adds the bin ``__bin_x`` of every feature x: a bin for each value if there are at most ``BINS``, else one between each two of the quantiles of all rows; unknown values keep a level of their own (-999)."""
    import math

    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import Bucketizer, SQLTransformer

    fill = SQLTransformer(statement="SELECT *, " + ", ".join(f"coalesce(`{f}`, -999D) AS `__{f}`" for f in features) + " FROM __THIS__")
    full = fill.transform(df.select(*features))
    kinds = full.agg(*[F.approx_count_distinct(f"__{f}").alias(f) for f in features]).first()
    few = [f for f in features if kinds[f] <= 2 * BINS]
    shares = F.array(*[F.lit(i / BINS) for i in range(1, BINS)])
    # values that are few are bounded as a set; quantiles are true to a hundredth of a bin
    seen = full.agg(*[(F.collect_set(f"__{f}") if f in few else F.percentile_approx(f"__{f}", shares, 100 * BINS)).alias(f) for f in features]).first()
    if many := [f for f in few if len(seen[f]) > BINS]:
        more = full.agg(*[F.percentile_approx(f"__{f}", shares, 100 * BINS).alias(f) for f in many]).first()
    splits = []
    for f in features:
        values = sorted({float(v) for v in ((more if f in many else seen)[f] or [])})
        edges = [a + (b - a) / 2 for a, b in zip(values, values[1:])] if f in few and f not in many else values
        # an edge belongs to the bin below it
        splits.append([-math.inf, *sorted({math.nextafter(e, math.inf) for e in edges} or {0.0}), math.inf])
    return PipelineModel([fill, Bucketizer(splitsArray=splits, inputCols=[f"__{f}" for f in features], outputCols=[f"__bin_{f}" for f in features])])


def cells(df: DataFrame, model, features: list[str], keys: list[str], weight: str | None = None) -> DataFrame:
    """The rows that are alike in ``keys`` and in the bins of all features, counted as ``weight``: ``features`` are the bins' numbers; written, as each tree reads them.

    Trees see bins alone, so they and their scores are those of the rows. Every row counts, however
    many there are; cells are no more than the rows.
    """
    from ..sources.tables import written

    n = F.sum(weight) if weight else F.count(F.lit(1))
    own = model.transform(df).groupBy(*keys, *[f"__bin_{f}" for f in features]).agg(n.cast("double").alias("weight"))
    # without metadata, by which trees would take bins for categories
    return written(own.select(*keys, *[F.col(f"__bin_{f}").alias(f, metadata={}) for f in features], "weight"), "cells")


def trees(counted: DataFrame, features: list[str], target: str = "target", rounds: int = 20, depth: int = 4):
    """Gradient-boosted trees over ``cells``; they read ``features`` from a vector of that name."""
    from pyspark.ml.classification import GBTClassifier

    return GBTClassifier(labelCol=target, weightCol="weight", maxIter=rounds, maxDepth=depth, maxBins=LOOKED_AT, stepSize=0.15, seed=7).fit(_assembled(counted, features))


def _assembled(df: DataFrame, columns: list[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=columns, outputCol="features").transform(df)


def boosted(df: DataFrame, features: list[str], target: str = "target", rounds: int = 20, depth: int = 4, weight: str | None = None):
    """A fitted gradient-boosted tree model over the features, by their bins; unknown values keep a level of their own (-999). The rows are read three times, however many rounds there are."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import VectorAssembler

    binned = bins(df, features)
    model = trees(cells(df, binned, features, [target], weight), features, target, rounds, depth)
    return PipelineModel([*binned.stages, VectorAssembler(inputCols=[f"__bin_{f}" for f in features], outputCol="features"), model])


def after_rounds(model, counted: DataFrame, features: list[str], rounds: list[int]) -> DataFrame:
    """``cells`` with the probability ``prob_r`` that the first r trees of a model give, for each r of ``rounds``: they are the trees of a model of r rounds."""
    margin, out = F.lit(0.0), {}
    scored = _assembled(counted, features)
    for i, (tree, w) in enumerate(zip(model.trees, model.treeWeights), 1):
        scored = tree.setPredictionCol(f"__tree_{i}").transform(scored)
        margin = margin + F.lit(float(w)) * F.col(f"__tree_{i}")
        if i in rounds:
            out[f"prob_{i}"] = 1 / (1 + F.exp(-2 * margin))
    return scored.select(*counted.columns, *[p.alias(n) for n, p in out.items()])


def predicted(model, df: DataFrame, columns: list[str], out: str = "prob") -> DataFrame:
    """``columns`` and the model's probability of the target."""
    from pyspark.ml.functions import vector_to_array

    return model.transform(df).select(*columns, F.get(vector_to_array("probability"), 1).alias(out))


def calibrated(scores: DataFrame, target: str = "target", prob: str = "prob", weight: str | None = None):
    """A monotone calibration of probabilities, fitted by isotonic regression on held-out rows; transform() adds ``prediction``. Rows of one score count as their mean, so no more than the scores are sorted."""
    from pyspark.ml.regression import IsotonicRegression

    w = F.col(weight) if weight else F.lit(1.0)
    by = scores.groupBy(prob).agg((F.sum(w * F.col(target)) / F.sum(w)).alias(target), F.sum(w).alias("__w"))
    return IsotonicRegression(featuresCol=prob, labelCol=target, weightCol="__w").fit(by)


#: Rows of a slice within which a feature's values are exchanged.
SLICE_ROWS = 20_000


def permutation_ranking(model, df: DataFrame, features: list[str], key: str, target: str = "target") -> DataFrame:
    """Rise of the log loss when a feature's values are exchanged among rows, the largest first.

    Values move to the row of the next key hash, so a permutation is one window over hash slices;
    there are more slices the more rows there are (``SLICE_ROWS`` in each, 64 slices at least).
    """
    from .evaluation import losses

    whole = losses(predicted(model, df, [target]), [], target, "prob").first()
    base, slices, out = whole["log_loss"], max(64, whole["n"] // SLICE_ROWS), []
    w = Window.partitionBy("__s").orderBy("__h", key)
    mixed = df.withColumn("__h", F.xxhash64(key)).withColumn("__s", F.pmod("__h", F.lit(slices)))
    for f in features:
        moved = mixed.withColumn(f, F.coalesce(F.lead(f).over(w), F.first(f).over(w))).drop("__h", "__s")
        out.append((f, losses(predicted(model, moved, [target]), [], target, "prob").first()["log_loss"] - base))
    return df.sparkSession.createDataFrame(sorted(out, key=lambda x: (-x[1], x[0])), "feature string, importance double")


def grid_search(df: DataFrame, features: list[str], folds: DataFrame, group: str, grid: dict[str, list], target: str = "target") -> DataFrame:
    """Mean Brier score of boosted trees over the folds for every combination of ``grid`` (rounds, depth), the best first."""
    dealt = with_folds(df, folds, group, [*features, target])
    numbers = sorted(r["fold"] for r in dealt.select(F.explode("parts.fold").alias("fold")).distinct().collect())
    return searched(dealt, features, numbers, grid, target)


#: Models of a search that are fitted side by side: their cells are few, so one alone leaves most cores idle.
SIDE_BY_SIDE = 6


def searched(dealt: DataFrame, features: list[str], numbers: list[int], grid: dict[str, list], target: str = "target") -> DataFrame:
    """``grid_search`` over rows that are dealt to the folds ``numbers``: a fold's rows are counted once, and the most rounds of each depth are fitted, as fewer rounds are their first trees."""
    from itertools import product
    from multiprocessing.pool import ThreadPool

    from pyspark import inheritable_thread_target

    from .evaluation import losses

    rounds, depths, spark = sorted(set(grid.get("rounds", [20]))), sorted(set(grid.get("depth", [4]))), dealt.sparkSession

    def counted(k):
        train = rows_of(dealt, k, "train")
        binned = bins(train, features)
        return [cells(x, binned, features, [target]) for x in (train, rows_of(dealt, k, "test"))]

    def briers(job):
        (train, test), depth = job
        scored = after_rounds(trees(train, features, target, rounds[-1], depth), test, features, rounds)
        each = scored.select(target, "weight", F.explode(F.array(*[F.struct(F.lit(r).alias("rounds"), F.col(f"prob_{r}").alias("prob")) for r in rounds])).alias("x")).select(target, "weight", "x.*")
        return [((r["rounds"], depth), r["brier"]) for r in losses(each, ["rounds"], target, "prob", "weight").collect()]

    scores = {}
    with ThreadPool(SIDE_BY_SIDE) as pool:
        for found in pool.map(inheritable_thread_target(spark)(briers), list(product([counted(k) for k in numbers], depths[::-1])), chunksize=1):
            for setting, brier in found:
                scores.setdefault(setting, []).append(brier)
    out = []
    for combo in product(*grid.values()):
        own = {"rounds": 20, "depth": 4} | dict(zip(grid, combo))
        found = scores[own["rounds"], own["depth"]]
        out.append((*[str(x) for x in combo], sum(found) / len(found)))
    return spark.createDataFrame(sorted(out, key=lambda x: x[-1]), ", ".join(f"{k} string" for k in grid) + ", brier double")


def cross_calibrated(train: DataFrame, test: DataFrame, features: list[str], group: str, columns: list[str], target: str = "target", inner: int = 3, fit=None, weight: str | None = None) -> DataFrame:
    """``columns``, prob and calibrated of the test rows.

    The calibration is fitted on the training rows' scores by models that did not see them: groups
    are dealt into ``inner`` parts by hash, and each part is scored by a model of the others. The
    test rows' scores come from a model of all training rows. Rows may be ``cells`` of a ``weight``,
    with ``part_of`` for the group; ``fit`` then takes the weight too.
    """
    fit = fit or boosted
    more = {"weight": weight} if weight else {}
    part = F.col("part") if "part" in train.columns else part_of(group, inner)
    held = None
    for k in range(inner):
        scores = predicted(fit(train.where(part != k), features, target, **more), train.where(part == k), [target, *more.values()])
        held = scores if held is None else held.unionByName(scores)
    monotone = calibrated(held, target, weight=weight)
    return monotone.transform(predicted(fit(train, features, target, **more), test, columns)).withColumnRenamed("prediction", "calibrated")


def part_of(group: str, inner: int = 3) -> Column:
    """The inner part of a training group."""
    return F.pmod(F.xxhash64(group), F.lit(inner)).alias("part")
