"""The fuzzy join against all pairs, and pruned lookups in the store of quotes."""

import datetime as dt
import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from boutwright.functions import names as N
from boutwright.operators import name_matching as M
from boutwright.plans import q_identity
from boutwright.sources import line_store as L
from tests.conftest import DATA


def _alike(x, y):
    ratio = lambda a, b: SequenceMatcher(None, a, b, autojunk=False).ratio()
    p, q = x.split(), y.split()
    if min(len(p), len(q)) < 2 or min(len(x), len(y)) < 8 or ratio(x, y) < 0.92:
        return False
    f, s = ratio(p[0], q[0]), ratio(p[-1], q[-1])
    return f == 1 and s >= 0.8 or s == 1 and f >= 0.8 or min(f, s) >= 0.88


def test_fuzzy_join_equals_all_pairs(spark):
    rng = random.Random(6)
    part = lambda: "".join(rng.choice("abcdeinorst") for _ in range(rng.randint(2, 9)))
    left = [" ".join(part() for _ in range(rng.choice([1, 2, 2, 3]))) for _ in range(250)] + ["aaaa aaaa", "aaaaa aaaa", "ab ab ab ab", None, " "]
    right = []
    for x in left:
        y = list(x or "zz zz zz")
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            i = rng.randrange(len(y))
            y[i : i + 1] = rng.choice([[], [y[i], "x"], ["q"], [y[i], y[i]]])
        right.append("".join(y) if rng.random() < 0.9 else " ".join(reversed("".join(y).split())))
    make = lambda names: spark.createDataFrame([(n,) for n in names], "name string")
    keys = lambda names: {r[0] for r in make(names).select(N.canonical(F.col("name"))).collect() if r[0]}
    a, b = keys(left), keys(right)
    want = set()
    for x in a:
        for y in b:
            kind = "same" if x == y else "reversed" if x.split() == y.split()[::-1] else "similar" if _alike(x, y) else None
            if kind:
                want.add((x, y, kind))
    assert {tuple(r) for r in M.matches(make(left), make(right)).collect()} == want
    assert {k for *_, k in want} == {"same", "reversed", "similar"}
    met = M.candidates(make(a).toDF("key"), make(b).toDF("key")).count()
    assert len([1 for *_, k in want if k == "similar"]) <= met < len(a) * len(b) / 50


def test_common_words_alone_bring_no_names_together(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(5, 8)))
    names = {f"the {word()} {word()}" for _ in range(600)} | {f"{word()} {word()} attion" for _ in range(600)}
    near = {x[:-1] + "q" for x in sorted(names)[::40]}
    make = lambda rows: spark.createDataFrame([(n,) for n in sorted(rows)], "key string")
    got = M.meetings(make(names), make(names | near)).distinct()
    assert got.count() < len(names) ** 2 / 30  # half of all pairs share a whole word
    assert {tuple(r) for r in got.collect()} >= {(x, x[:-1] + "q") for x in sorted(names)[::40]} | {(x, x) for x in names}


def test_names_and_their_keys_never_pass_the_driver(spark):
    plan = q_identity.QUERIES["fuzzy_names"](spark, f"{DATA}/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert plan.count("fuzzy_same") == 1 and "keys(" not in plan  # the ratio is worked out after the pairs stand once each


def test_cut_names_meet_whenever_they_are_near():
    rng = random.Random(8)
    for _ in range(4000):
        x = "".join(rng.choice("ab c"[: rng.choice([2, 4])]) for _ in range(rng.randint(4, 60)))
        y = list(x)
        for _ in range(rng.randint(0, M._changes(len(x), len(x)))):
            i = rng.randrange(len(y) + 1)
            y[i : i + 1] = rng.choice([[], y[i : i + 1] + ["a"]])
        y = "".join(y)
        common = sum(b.size for b in SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks())
        if y and len(x) + len(y) - 2 * common <= M._changes(len(x), len(y)):
            assert M._cut(x, 0) & M._met(y, 0), (x, y)


def _store(spark, root):
    rows = []
    for i in range(3000):
        a, b = f"Ánn {i % 30}", f"Bo {i % 7}"
        x, y = (a, b) if i % 3 else (b, a)
        rows.append((i, x, y, f"e{i % 30}" if i % 4 == 1 else None, dt.datetime(2024, 3, 1 + i % 2), dt.datetime(2024, 1, 1) + dt.timedelta(hours=i % 700), i / 3000, 1 - i / 3000))
    df = spark.createDataFrame(rows, "row_id int, fighter_a string, fighter_b string, event_id string, starts_at timestamp_ntz, snapshot_time timestamp_ntz, a_prob double, b_prob double")
    assert L.save(df.where("row_id < 2000"), root, 0) and not L.save(df, root, 0) and L.save(df.where("row_id >= 2000"), root, 1)
    return rows


def test_pair_history_of_fights_and_times(spark, tmp_path):
    rows = _store(spark, str(tmp_path))
    mine = [r for r in rows if {r[1].replace("Á", "A"), r[2].replace("Á", "A")} == {"Ann 3", "Bo 3"}]
    got = lambda **k: [(r.row_id, round(r.a_prob, 6)) for r in L.line_history(spark, str(tmp_path), "ann 3", "BO 3", **k).collect()]
    prob = lambda r: round(r[6] if r[1].startswith("Á") else r[7], 6)
    want = lambda keep: [(r[0], prob(r)) for r in sorted(mine, key=lambda r: r[5]) if keep(r)]
    end = dt.datetime(2024, 1, 16)
    assert got(event_id="e3", as_of="2024-01-15") == want(lambda r: r[3] == "e3" and r[5] < end)
    noon = dt.datetime(2024, 1, 15, 6)
    in_time = [r for r in mine if r[4].day == 2 and r[5] <= noon]
    latest = max((r[5], "event::e3" if r[3] else "2024") for r in in_time)[1]  # the fight that was quoted last
    assert got(starts_at="2024-03-02 00:00:00", as_of="2024-01-15T06:00:00") == want(lambda r: r in in_time and (r[3] == "e3") == (latest == "event::e3"))
    assert got(as_of="2023-12-31") == [] and 0 < len(want(lambda r: r[3] == "e3" and r[5] < end)) < len(mine)


def test_a_lookup_reads_its_bucket_and_days_alone(spark, tmp_path):
    _store(spark, str(tmp_path))
    df = L.line_history(spark, str(tmp_path), "Ann 3", "Bo 3", event_id="e3", as_of="2024-01-05")
    df.collect()
    scan = next(x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan parquet" in x)
    partitions, pushed = scan.split("PartitionFilters: ")[1].split("PushedFilters: ")
    assert "(bucket#" in partitions and "(day#" in partitions and "EqualTo(pair_key" in pushed
    kept = L.stored(spark, str(tmp_path)).where("day <= '2024-01-05'").select("day", "bucket").distinct().count()
    assert df.count() > 0 and kept > L.BUCKETS  # one bucket of them is read
