"""Committed sinks, lines followed over many files with restarts, cards scan by scan, and histories as they were visible."""

import datetime as dt
import math
import random
import time

import pytest
from pyspark.sql import functions as F

from boutwright.operators import visible as V
from boutwright.sources import commits, tables
from boutwright.streaming import tracker


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# commits --------------------------------------------------------------------------------------
def test_repeated_and_dead_passes_leave_each_row_once(spark, tmp_path):
    root = str(tmp_path)
    day = lambda n: dt.datetime(2024, 1, n)
    one = spark.createDataFrame([(1, "x", day(1), 5.0), (2, "y", day(1), 6.0), (3, "x", day(2), 7.0)], "row_id long, k string, t timestamp, v double")
    two = spark.createDataFrame([(4, "x", day(3), 8.0), (5, "z", day(3), 9.0)], one.schema)
    broken = one.withColumn("v", F.when(F.col("row_id") == 3, F.raise_error(F.lit("died")).cast("double")).otherwise(F.col("v")))
    with pytest.raises(Exception, match="died"):
        tables.save_snapshot(broken, root, "k", "t", 0)
    assert rows(tables.saved_snapshots(spark, root, one.schema)) == []
    assert tables.save_snapshot(one, root, "k", "t", 0) and not tables.save_snapshot(one, root, "k", "t", 0)
    assert tables.save_snapshot(two, root, "k", "t", 1)
    assert [r[0] for r in rows(tables.saved_snapshots(spark, root, one.schema))] == [1, 2, 3, 4, 5]
    assert rows(tables.saved_openings(spark, root, one.schema).select("k", "v")) == [("x", 5.0), ("y", 6.0), ("z", 9.0)]


def test_of_two_writers_of_a_batch_one_counts(spark, tmp_path):
    path = f"{tmp_path}/{commits.LOG}/{0:020d}.json"
    assert commits._claim(spark, path, '{"batch":0,"path":"a","note":"{}"}') and not commits._claim(spark, path, '{"batch":0,"path":"b","note":"{}"}')
    assert [e["path"] for e in commits.entries(spark, str(tmp_path))] == ["a"]


def test_a_version_is_read_as_a_whole(spark, tmp_path):
    root = str(tmp_path)
    with pytest.raises(ValueError):
        tables.read_published(spark, root, "t")
    for i in range(3):
        assert tables.publish(spark, {"t": spark.range(i + 1), "u": spark.range(1)}, root) == i
    with pytest.raises(ValueError):
        tables.publish(spark, {"t": spark.range(9), "u": spark.range(0)}, root)
    assert tables.read_published(spark, root, "t").count() == 3 and tables.read_published(spark, root, "t", 1).count() == 2


# lines ----------------------------------------------------------------------------------------
def _quotes():
    rng, out = random.Random(4), []
    for market in range(6):
        p, drift = 0.5, (market - 2.5) / 60
        for hour in range(60):
            p = min(0.95, max(0.05, p + drift + rng.uniform(-0.03, 0.03) * (market % 2)))
            for _ in range(rng.randint(1, 3)):
                out.append((market, dt.datetime(2024, 1, 1) + dt.timedelta(hours=hour), None if rng.random() < 0.1 else round(p + rng.uniform(-0.01, 0.01), 4)))
    return out + [(9, dt.datetime(2024, 1, 5), 0.5)]


def _alerts(quotes, late_hours):
    """A plain loop over each market's snapshots."""
    end = max(q[1] for q in quotes) - dt.timedelta(hours=late_hours)
    for market in {q[0] for q in quotes}:
        at = {}
        for m, t, p in quotes:
            if m == market and p is not None and t < end:
                at.setdefault(t, []).append(p)
        line = [(t, int(sum(p) / len(p) * 1e6 + 0.5)) for t, p in sorted(at.items())]
        last = {}
        for i in range(1, len(line)):
            steps = [y[1] - x[1] for x, y in zip(line[:i], line[1 : i + 1])]
            move = line[i][1] - line[0][1]
            way = "toward_a" if move > 20000 else "toward_b" if move < -20000 else "stable"
            for kind, so in (("sharp", abs(move) > 50000), ("steam", i >= 2 and (min(steps) > 5000 or max(steps) < -5000))):
                if so and ((kind, way) not in last or abs(move) >= last[kind, way] + 50000):
                    last[kind, way] = abs(move)
                    yield market, line[i][0], kind, way, move / 1e6


@pytest.mark.parametrize("files, restart, idle", [(1, None, None), (5, None, None), (9, 4, None), (7, 3, 500.0)])
def test_alerts_do_not_depend_on_files_or_restarts(spark, tmp_path, files, restart, idle):
    quotes = _quotes()
    order = sorted(range(len(quotes)), key=lambda i: (quotes[i][1] + dt.timedelta(hours=i * 7 % 5), i))
    size = -(-len(order) // files)
    schema = "market int, t timestamp, p double"

    def run():
        src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        out = tracker.line_alerts(src, "market", "t", "p", "6 hours", idle_hours=idle)
        out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        return out.schema

    for f in range(files):
        part = [quotes[i] for i in order[f * size : (f + 1) * size]]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.02)
        if f == restart:
            run()
    got = spark.read.schema(run()).parquet(str(tmp_path / "out")).select("market", "t", "kind", "direction", "movement")
    assert rows(got) == sorted(_alerts(quotes, 6), key=str) and got.count() > 5


def test_a_pass_that_dies_goes_on_from_its_checkpoint(spark, tmp_path):
    """The sink dies in the second batch; after the restart each alert stands once."""
    quotes = _quotes()
    order = sorted(quotes, key=lambda q: q[1])
    size = -(-len(order) // 4)
    for f in range(4):
        spark.createDataFrame(order[f * size : (f + 1) * size], "market int, t timestamp, p double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.02)
    died = []

    def write(batch, batch_id):
        rows_ = batch.select("market", F.col("t").alias("at"), "kind", "direction", "movement")
        if batch_id == 2 and not died:
            died.append(1)
            raise RuntimeError("died")
        commits.commit_frames({"alerts": rows_}, str(tmp_path / "out"), batch_id)

    def run():
        src = spark.readStream.schema("market int, t timestamp, p double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        tracker.line_alerts(src, "market", "t", "p", "1 hour").writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()

    with pytest.raises(Exception, match="died"):
        run()
    run()
    got = commits.read_committed(spark, str(tmp_path / "out"), "alerts", "market int, at timestamp, kind string, direction string, movement double")
    assert died and rows(got) == sorted(_alerts(quotes, 1), key=str)


# cards ----------------------------------------------------------------------------------------
def test_incomplete_scans_remove_nothing_and_replays_change_nothing(spark, tmp_path):
    card = lambda *bouts: spark.createDataFrame([(k, 1, dt.date(2024, 5, 1), a, b, 5) for k, a, b in bouts], "key long, event long, day date, a_id long, b_id long, days_to_event int")
    feed, out = str(tmp_path / "feed"), str(tmp_path / "out")
    scans = [card((1, 11, 12), (2, 21, 22), (3, 31, 32)), card((1, 11, 12), (5, 21, 99)), card((1, 12, 11)), card((1, 12, 11), (3, 31, 32))]
    complete = [True, False, False, True]
    for i, (s, c) in enumerate(zip(scans, complete)):
        assert tracker.save_scan(s, feed, i, c) and not tracker.save_scan(s, feed, i, c)
        tracker.monitor_cards(spark, feed, out, str(tmp_path / f"cp{i % 2}")).awaitTermination()
    found = {e["batch"]: rows(commits.read_frame(spark, out, e, "changes")) for e in commits.entries(spark, out)}
    assert found == {0: [], 1: [(2, 5, "replaced")], 2: [(1, 1, "reversed")], 3: [(5, None, "removed")]}
    last = commits.latest(spark, out)
    assert [r[0] for r in rows(commits.read_frame(spark, out, last, "card").select("key"))] == [1, 3]
    notice = commits.read_frame(spark, out, commits.entries(spark, out)[1], "notice")
    assert rows(notice) == [(1, 21, 22, 99, 5)]


def test_quotes_without_a_time_or_a_price_are_passed_over(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    data = [(1, t0, 0.5), (1, None, 0.9), (1, t0 + dt.timedelta(hours=1), 0.6), (1, t0 + dt.timedelta(hours=2), None), (2, t0 + dt.timedelta(days=9), 0.5)]
    spark.createDataFrame(data, "market int, t timestamp, p double").coalesce(1).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("market int, t timestamp, p double").parquet(str(tmp_path / "in"))
    out = tracker.line_alerts(src, "market", "t", "p", "1 hour")
    out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert [(r.market, r.kind, r.n_snapshots) for r in spark.read.schema(out.schema).parquet(str(tmp_path / "out")).collect()] == [(1, "sharp", 2)]


# visible histories ----------------------------------------------------------------------------
def test_visible_rolling_equals_a_plain_loop(spark):
    rng, data = random.Random(2), []
    for i in range(700):
        day = dt.date(2020, 1, 1) + dt.timedelta(days=rng.randint(0, 900))
        captured = None if rng.random() < 0.2 else day + dt.timedelta(days=rng.choice([0, 1, 30, 400]))
        data.append((i, rng.choice([1, 1, 1, 1, 2, None]), day if rng.random() > 0.02 else None, captured, None if rng.random() < 0.15 else rng.uniform(0, 9), float(i % 7)))
    df = spark.createDataFrame(data, "fight_id long, entity int, event_date date, captured date, x double, y double").repartition(5)
    got = {r["fight_id"]: r for r in V.visible_rolling(df, "captured", ("x", "y"), 2.0).collect()}
    assert len(got) == len(data)
    for i, entity, day, _, _, _ in data:
        seen = [] if day is None else sorted((e, j, v, w) for j, o, e, c, v, w in data if o == entity and e is not None and (e, j) < (day, i) and (c is None or c < day))
        assert got[i]["n_visible"] == len(seen)
        for name, k in (("x", 2), ("y", 3)):
            pairs = [(0.5 ** ((len(seen) - 1 - r) / 2), s[k]) for r, s in enumerate(seen) if s[k] is not None]
            if not pairs:
                assert got[i][f"mean_{name}"] is None and got[i][f"ewm_{name}"] is None
            else:
                assert math.isclose(got[i][f"mean_{name}"], sum(v for _, v in pairs) / len(pairs), rel_tol=1e-9)
                assert math.isclose(got[i][f"ewm_{name}"], sum(w * v for w, v in pairs) / sum(w for w, _ in pairs), rel_tol=1e-9)


def test_many_statistics_roll_as_few_do(spark):
    """The pass over sorted rows against the windows, with unknown stretches longer than any weight."""
    from boutwright.operators import features as X

    rng = random.Random(9)
    stats = tuple(f"s{j}" for j in range(X.WIDE + 1))
    data = [(i, rng.choice([1, 1, 1, 1, 2, None]), dt.date(2000, 1, 1) + dt.timedelta(days=rng.randint(0, 4000)), *[None if j == 0 and 30 < i < 6000 or rng.random() < 0.2 else rng.uniform(0, 9) for j in range(len(stats))]) for i in range(7000)]
    df = spark.createDataFrame(data, "fight_id long, entity int, event_date date, " + ", ".join(f"{s} double" for s in stats)).repartition(4)
    wide = {r.fight_id: r for r in X.rolled(df, stats).collect()}
    few = {r.fight_id: r for r in X.rolled(df, stats[:2]).collect()}
    assert len(wide) == len(few) == len(data)
    for i, r in few.items():
        for s in stats[:2]:
            x, y = wide[i][f"roll_{s}"], r[f"roll_{s}"]
            assert (x is None) == (y is None) and (x is None or math.isclose(x, y, rel_tol=1e-9))


def test_visible_careers_cost_no_pass_a_row(monkeypatch):
    """Usual careers are taken as matrices, in slices, and agree with the blocks that long ones take."""
    import numpy as np

    rng = np.random.default_rng(4)
    day = np.sort(rng.integers(0, 500, 300))
    captured, values = day + rng.choice([-(10**9), 0, 3, 200], 300), np.where(rng.random((300, 2)) < 0.2, np.nan, rng.random((300, 2)))
    monkeypatch.setattr(V, "DENSE", 0)
    want = V._career(day, captured, values, 3.0)
    monkeypatch.setattr(V, "DENSE", 300)
    monkeypatch.setattr(V, "CELLS", 7000)
    monkeypatch.setattr(V, "Visible", None)
    for x, y in zip(want, V._career(day, captured, values, 3.0)):
        assert np.allclose(x, y, rtol=1e-12, equal_nan=True)
