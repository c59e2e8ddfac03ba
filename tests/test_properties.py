"""Properties that no single SQL comparison shows: no leaks, orientation, missing values, loops and streams."""

import datetime as dt
import math
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from boutwright.functions import names as N
from boutwright.functions import scalars as S
from boutwright.operators import evaluation as E
from boutwright.operators import features as X
from boutwright.operators import history as H
from boutwright.operators import learning as L
from boutwright.operators import quality as Q
from boutwright.operators import simulate as M
from boutwright.plans import fixtures
from boutwright.sources import tables
from boutwright.streaming import streams
from tests.conftest import DATA

SF = f"{DATA}/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_later_bouts_change_nothing(spark):
    b = fixtures.bouts(spark, SF).persist()
    cut = b.agg(F.expr("percentile_approx(event_date, 0.5)")).first()[0]

    def made(bouts):
        long = H.streaks(H.prior_counts(H.long_rows(bouts)))
        return H.schedule_strength(long, "landed").transform(lambda x: X.rolled(x, ("landed",))).withColumnRenamed("roll_landed", "e").where(F.col("event_date") <= F.lit(cut)).select("fight_id", "side", "wins", "win_streak", F.round("opp_strength", 9), F.round("e", 9))

    assert rows(made(b)) == rows(made(b.where(F.col("event_date") <= F.lit(cut))))


def test_orientation_negates_differences(spark):
    b = fixtures.bouts(spark, SF).select("fight_id", F.col("a_landed"), F.col("b_landed"), (F.col("a_landed") - F.col("b_landed")).alias("diff_landed"))
    s = L.swapped(b)
    j = b.alias("x").join(s.alias("y"), "fight_id")
    assert j.where("x.diff_landed <> -y.diff_landed or x.a_landed <> y.b_landed").count() == 0


def test_unknown_stays_unknown(spark):
    df = spark.createDataFrame([(1, None, None), (2, "--", 0.0), (3, "20 of 40", 0.5)], "i int, s string, p double")
    got = df.select(S.landed(F.col("s")), S.american_to_prob(F.lit(None).cast("double")), S.no_vig(F.col("p"), F.lit(0.5)), S.percent(F.col("s")), S.height_cm(F.col("s"))).collect()
    assert [r[0] for r in got] == [None, None, 20.0] and all(r[1] is None for r in got) and got[0][2] is None and got[1][2] is None and got[2][2] == 0.5


@pytest.mark.parametrize("block", [240, 60])
def test_ewm_against_loop(spark, block):
    data = [(1, dt.date(2020, 1, 1) + dt.timedelta(days=i), i, None if i % 4 == 1 else float(i * i % 7)) for i in range(300)]
    df = spark.createDataFrame(data, "entity int, event_date date, fight_id int, v double")
    got = {r.fight_id: r.roll_v for r in X.rolled(df, ("v",), block=block).collect()}
    for i in range(300):
        past = [(j, v) for _, _, j, v in data[:i] if v is not None]
        want = sum(v * 2 ** (j / 3) for j, v in past) / sum(2 ** (j / 3) for j, _ in past) if past else None
        assert got[i] is None if want is None else abs(got[i] - want) < (1e-9 if block > 200 else 1e-4)


def test_ewm_stands_still_over_a_block_of_unknown_values(spark):
    df = spark.createDataFrame([(1, dt.date(2020, 1, 1) + dt.timedelta(days=i), i, 3.5 if i == 0 else None) for i in range(40)], "entity int, event_date date, fight_id int, v double")
    assert [r.roll_v for r in X.rolled(df, ("v",), block=6).orderBy("fight_id").collect()] == [None] + [3.5] * 39


def test_elo_against_loop(spark):
    b = fixtures.bouts(spark, SF).persist()
    ratings = H.elo(b).persist()
    got = {r.fight_id: (r.elo_a, r.elo_b) for r in ratings.collect()}
    tail = {(r.fight_id, r.entity): (r.momentum, r.opponents_mean) for r in H.opponents_mean(H.momentum(H.rating_rows(ratings), "after"), "opp_rating").collect()}
    rating, seen, past, met = {}, {}, {}, {}
    for r in b.orderBy("event_date", "fight_id").collect():
        ra, rb = rating.get(r.a_id, 1500.0), rating.get(r.b_id, 1500.0)
        assert got[r.fight_id] == pytest.approx((ra, rb))
        e = 1 / (1 + 10 ** ((rb - ra) / 400))
        s = 1 if r.winner == r.a_id else 0 if r.winner == r.b_id else 0.5
        for x, old, other, d in ((r.a_id, ra, rb, s - e), (r.b_id, rb, ra, e - s)):
            y = past.setdefault(x, [])[-5:]
            want = np.polyfit(range(len(y)), y, 1)[0] if len(y) > 1 else 0.0, np.mean(met.get(x, [1500.0])[-5:])
            assert tail[r.fight_id, x] == pytest.approx(want, abs=1e-6)
            rating[x] = old + 32 * (1.5 if seen.get(x, 0) < 5 else 1) * d
            past[x].append(rating[x])
            met.setdefault(x, []).append(other)
            seen[x] = seen.get(x, 0) + 1
    leagues = b.withColumn("league", F.col("weight_class"))
    one = {r.fight_id: (r.elo_a, r.elo_b) for r in H.elo(b.where("weight_class = '1-URGENT'")).collect()}
    split = {r.fight_id: (r.elo_a, r.elo_b) for r in H.elo(leagues, "league").collect()}
    assert len(split) == len(got) and all(split[k] == pytest.approx(v) for k, v in one.items())


def test_elo_in_small_packs_hands_on_written_ratings(spark):
    b = fixtures.bouts(spark, SF)
    want = {r.fight_id: (r.elo_a, r.after_b) for r in H.elo(b).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # several packs a month
    try:
        out = H.elo(b)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r.fight_id: (r.elo_a, r.after_b) for r in out.collect()} == want and len(want) > 100
    assert "Exchange" not in out._jdf.queryExecution().toString()  # the fold's one task feeds no shuffle


def test_sweep_against_loop(spark):
    data = [("p", dt.date(2020, 1, 1) + dt.timedelta(days=i), i, 0.4 + i % 5 / 20, 1.8 + i % 3 / 2, i % 2) for i in range(40)]
    df = spark.createDataFrame(data, "pool string, event_date date, bet_id int, prob double, odds double, won int")
    for r in M.sweep(df, ["pool"], ["event_date", "bet_id"], [0.1, 0.5]).collect():
        cash = 1000.0
        for _, _, _, p, o, w in data:
            want = cash * min(max(r.share * ((o - 1) * p - (1 - p)) / (o - 1), 0), 0.04)
            stake = 0 if want < 1 or cash < 400 else want
            cash += stake * (o - 1) if w else -stake
        assert r.final == pytest.approx(cash)


def test_bootstrap_interval(spark):
    data = [(i, float((i * 37) % 101 - 40)) for i in range(400)]
    a = spark.createDataFrame([(i, x, 2.0) for i, x in data], "event int, pnl double, stake double")
    b = spark.createDataFrame([(i, 0.0, 1.0) for i in range(300)], "event int, pnl double, stake double")
    r = E.paired_bootstrap(a, b, "event", 1000).first()
    mean, sd = sum(x for _, x in data), math.sqrt(sum(x * x for _, x in data))
    assert r.n_events == 400 and r.profit_diff == pytest.approx(mean) and r.roi_diff == pytest.approx(mean / 800)
    assert abs((r.high + r.low) / 2 - mean) < 0.3 * sd and abs(r.high - r.low - 3.92 * sd) < 0.4 * sd


def test_names(spark):
    data = [("José  Łukasz-Núñez Jr.",), ("O'Brien",), ("Straße",), (None,), ("Þórr Œdipe ĦÆ",), ("Nguye\u0302\u0303n Va\u0306n",), ("Nguyễn_Văn",)]
    df = spark.createDataFrame(data, "n string")
    got = df.select(N.normalise(F.col("n")), N.normalise_exact(F.col("n")), N.canonical(F.col("n"))).collect()
    assert got[0][0] == "jose lukasz nunez jr" == got[0][1] and got[0][2] == "jose lukasz nunez" and got[1][0] == "o brien" == got[1][1] and got[2][0] == "strasse" == got[2][1] and got[3][0] is None
    assert [(r[0], r[1]) for r in got[4:]] == [("thorr oedipe hae",) * 2, ("nguyen van",) * 2, ("nguyen_van",) * 2]
    long = spark.createDataFrame([("Bobby Green III",), ("Zack Buzukia 2nd",)], "n string").select(N.canonical(F.col("n"), {"buzukia": "buzukja"}, {"robert green": "king green"})).collect()
    assert [r[0] for r in long] == ["king green", "zachary buzukja"]
    two = spark.createDataFrame([("Mike Smith", "Smith Michael", "michael smithe"), ("Jon Jones", "Joan Jones", "Xi")], "a string, b string, c string")
    got = two.select(N.same_person(F.col("a"), F.col("b")), N.fuzzy_same(F.lower("a"), F.lower("c"))).collect()
    assert got[0][0] and not got[1][0] and not got[1][1]


def test_schema_report_and_aliases(spark):
    df = tables.aliased(spark.range(1).selectExpr("id as `Red Fighter`", "'x' as `WINNER_side`"), {"red_fighter": "fighter_a", "winnerside": "winner"})
    assert df.columns == ["fighter_a", "winner"]
    assert Q.schema_report(df, {"fighter_a": "string", "gone": "int"}) == {"missing": ["gone"], "unexpected": ["winner"], "type": ["fighter_a"]}


def test_publish_refuses_empty(spark, tmp_path):
    with pytest.raises(ValueError):
        tables.publish(spark, {"t": spark.range(0)}, str(tmp_path))


def test_realerts_and_unique_sink(spark, tmp_path):
    spark.createDataFrame([(1, 1, 0.10), (1, 2, 0.12), (1, 3, 0.16), (2, 4, 0.30)], "k int, o int, m double").coalesce(1).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("k int, o int, m double").parquet(str(tmp_path / "in"))
    streams.realerts(src, "k", "o", "m").writeStream.format("memory").queryName("realerts_t").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert rows(spark.table("realerts_t").select("k", "o")) == [(1, 1), (1, 3), (2, 4)]
    for i in range(2):  # the second run replays everything
        src = spark.readStream.schema("k int, o int, m double").parquet(str(tmp_path / "in"))
        streams.append_unique(src, str(tmp_path / "out"), str(tmp_path / f"cp{i}x"), "k").awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_first_seen_over_files_out_of_order(spark, tmp_path):
    """A user with late rows only, an earlier opening in a later file, and a user who returns after months."""
    from boutwright.plans import registry
    from tests.compare import same

    d, day = tmp_path / "sf", lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    files = [[(1, day(100), 1, 5.0), (2, day(100), 4, 9.0)], [(3, day(10), 2, 6.0), (4, day(20), 1, 7.0)], [(5, day(200), 4, 8.0), (6, day(10), 2, 1.0)], [(7, day(300), 3, 2.0), (8, day(1), 4, 3.0)]]
    for i, rows in enumerate(files):
        f = spark.createDataFrame([(e, t, u, "view", v) for e, t, u, v in rows], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")
        f.coalesce(1).write.mode("append").parquet(str(d / "events.parquet"))
        time.sleep(0.05)  # files are read in the order of their times
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{d}/events.parquet/*.parquet')")
    assert same(spark, con, registry.queries()["stream_first_seen"], registry.oracle_sql()["stream_first_seen"], str(d)) == ""


def test_names_are_folded_once_and_alike_with_and_without_accents(spark):
    plain = ["Mike Jones Jr.", " O'Brien  x_1 ", "II", "", "a-B\tc", "JOE", "3rd 2nd"]
    df = spark.createDataFrame([(n,) for n in plain], "n string")
    # a letter with an accent takes the long way, with the same words before it
    got = df.select(N.normalise(F.col("n")), N.normalise(F.concat("n", F.lit(" é"))), N.canonical(F.col("n"))).collect()
    assert [f"{a} e".strip() for a, _, _ in got] == [b for _, b, _ in got]
    assert [c for *_, c in got] == ["michael jones", "o brien x_1", None, "", "a b c", "joseph", None]
    assert df.select(N.canonical(F.col("n")).alias("c"))._jdf.queryExecution().optimizedPlan().toString().count("octet_length") == 1
