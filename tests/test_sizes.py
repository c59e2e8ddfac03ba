"""Sizes that must not grow faster than the input: folds, slices and conflicts in one pass."""

from collections import defaultdict

from pyspark.sql import functions as F

from boutwright.operators import dedupe, learning, lines


def _rows(spark):
    return spark.range(600).selectExpr("id DIV 2 pair", "date_add(DATE'2020-01-01', CAST(id % 37 AS INT)) day", "CAST(id AS DOUBLE) x", "CAST(id % 2 AS DOUBLE) target")


def test_folds_are_dealt_once(spark):
    df = _rows(spark)
    folds = learning.time_series_folds(df, "pair", "day", 2)
    dealt = learning.with_folds(df, folds, "pair", ["x", "target"])
    for fold in (1, 2):
        for part in ("train", "test"):
            got = learning.rows_of(dealt, fold, part)
            assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
            want = df.join(folds.where((F.col("fold") == fold) & (F.col("part") == part)).select("pair"), "pair").select("pair", "x", "target")
            assert sorted(got.collect()) == sorted(want.collect()) != []


def test_series_deals_the_folds_without_joins(spark):
    df = spark.range(900).selectExpr("id DIV 2 pair", "CASE WHEN id % 7 > 0 THEN date_add(DATE'2020-01-01', CAST(id DIV 2 % 23 AS INT)) END day", "CAST(id AS DOUBLE) x")
    df = df.unionByName(spark.createDataFrame([(None, None, 1.0), (800, None, 2.0), (801, None, 3.0)], df.schema))
    for splits in (2, 5):
        folds, dealt = learning.time_series_folds(df, "pair", "day", splits), learning.with_series(df, "pair", "day", ["x"], splits)
        for fold in range(1, splits + 1):
            for part in ("train", "test"):
                got = learning.rows_of(dealt, fold, part)
                assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
                want = df.join(folds.where((F.col("fold") == fold) & (F.col("part") == part)).select("pair"), "pair").select("pair", "x")
                assert sorted(got.collect()) == sorted(want.collect()) != []


def _skewed(spark, rows):
    """Few values, some unknown, and a target that leans on them."""
    return spark.range(rows).selectExpr("CASE WHEN id % 9 > 0 THEN CAST(id * 7 % 11 AS DOUBLE) END x", "CAST(id * 13 % 9 AS DOUBLE) y", "CAST(xxhash64(id) % 10 + id * 7 % 11 > 5 AS DOUBLE) target")


def test_trees_over_cells_are_those_of_the_rows(spark, monkeypatch):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    df = _skewed(spark, 6000)
    plain = Pipeline(stages=[VectorAssembler(inputCols=["x", "y"], outputCol="features"), GBTClassifier(labelCol="target", maxIter=5, maxDepth=3, stepSize=0.15, seed=7)]).fit(df.na.fill(-999.0))
    fitted = []
    real = learning.trees
    monkeypatch.setattr(learning, "trees", lambda counted, *a, **k: fitted.append(counted.agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w")).first()) or real(counted, *a, **k))
    model = learning.boosted(df, ["x", "y"], rounds=5, depth=3)
    assert fitted[0].w == 6000 and fitted[0].n <= 12 * 9 * 2  # every row counts, none is fitted by itself
    probs = lambda m, d: [r.prob for r in learning.predicted(m, d, ["x", "y", "target"]).orderBy("x", "y", "target").collect()]
    a, b = probs(plain, df.na.fill(-999.0)), probs(model, df)
    assert len(a) == 6000 and max(abs(x - y) for x, y in zip(a, b)) < 1e-12 and len(set(a)) > 20


def test_many_values_are_cut_at_quantiles_of_all_rows(spark):
    df = spark.range(5000).selectExpr("CASE WHEN id % 10 > 0 THEN CAST(id AS DOUBLE) END x", "CAST(id % 2 AS DOUBLE) target")
    counted = learning.cells(df, learning.bins(df, ["x"]), ["x"], [])
    n = sorted((r.x, r.weight) for r in counted.collect())
    assert sum(w for _, w in n) == 5000 and n[0][1] == 500 and len(n) >= 28 and max(w for _, w in n[1:]) < 5000 / 32 + 20


def test_fewer_rounds_are_the_first_trees(spark):
    df = _skewed(spark, 2000)
    counted = learning.cells(df, learning.bins(df, ["x", "y"]), ["x", "y"], ["target"])
    both = learning.after_rounds(learning.trees(counted, ["x", "y"], rounds=4, depth=2), counted, ["x", "y"], [2, 4])
    for r in (2, 4):
        want = learning.predicted(learning.boosted(df, ["x", "y"], rounds=r, depth=2), df, ["target"]).agg(F.avg("prob")).first()[0]
        assert abs(both.agg(F.sum(F.col("weight") * F.col(f"prob_{r}")) / F.sum("weight")).first()[0] - want) < 1e-12


def test_slices_grow_with_the_rows(spark, monkeypatch):
    seen = []
    real = learning.F.pmod
    monkeypatch.setattr(learning.F, "pmod", lambda a, b: seen.append(str(b)) or real(a, b))
    monkeypatch.setattr(learning, "SLICE_ROWS", 6)
    df = _rows(spark)
    learning.permutation_ranking(learning.logistic(df, ["x"]), df, ["x"], "x")
    assert any("100" in s for s in seen)


def test_conflicts_without_copies_of_rows(spark):
    rows = [(1, "ko", "win"), (1, "ko", "win"), (2, "ko", "win"), (2, "sub", "win"), (3, "ko", "win"), (3, "ko", "loss"), (4, None, None), (5, None, "win"), (5, "ko", None), (5, "ko", "win")]
    out = dedupe.reconcile(spark.createDataFrame(rows, "k int, method string, result string"), ["k"])
    assert {tuple(r) for r in out.collect()} == {(1, "ko", "win", 2), (2, None, "win", 2), (4, None, None, 1), (5, "ko", "win", 3)}
    assert "Expand" not in out._jdf.queryExecution().executedPlan().toString()


def test_method_means_are_dealt_over_tasks_by_the_rows(spark, monkeypatch):
    """Groups of one task stay few however many bouts there are; the means equal a plain loop's."""
    monkeypatch.setattr(lines, "TASK_ROWS", 100)
    say = {0: "ko", 1: "sub", 2: "dec", 3: "other", 4: None}
    rows = [(i % 701, None if i % 11 == 0 else "ab"[i % 2], say[i * 7 // 3 % 5], None if i % 13 == 0 else float((-1) ** i * (100 + i % 90)), "OF"[i // 701 % 2] if i % 17 else None) for i in range(6000)]
    got = lines.merged_methods(lines.method_probabilities(spark.createDataFrame(rows, "k int, side string, method string, price double, ls string"), "k", "ls"), "k")
    assert got.withColumn("task", F.spark_partition_id()).select("task").distinct().count() > 50
    mean = lambda x: sum(x) / len(x) if x else None
    seen = defaultdict(list)
    for k, s, m, p, ls in rows:
        if p is not None:
            seen[k, f"{s}_{m}_prob", ls].append(100 / (p + 100) if p > 0 else -p / (100 - p))
    for r in got.collect():
        for c in lines.METHODS:
            want = mean([mean(x) for at in ("O", "F", None) if (x := seen[r.k, c, at])])
            assert r[c] is None if want is None else abs(r[c] - want) < 1e-12
    assert got.count() == 701
