"""Names of two tables that stand for the same person, typing errors included, without comparing all pairs.

Two names are similar if the Ratcliff-Obershelp ratio of their canonical forms is 0.92 or more and
their outer tokens agree (``names.fuzzy_same``). The ratio is 2 M / (la + lb) for M matched
characters, so at most d = 0.08 (la + lb) characters are not matched: that many deletions and
insertions turn one name into the other. Cut one name into d // 2 + 1 parts: one of them meets at
most one such change, so it stands in the other name unchanged or with one letter more or less,
not further from its place than the other changes can move it.

The outer tokens agree in one of three ways, and each has keys of its own: the first tokens are
equal, and what follows is cut; the last tokens are equal, and what precedes is cut; neither is
equal, both have four letters or more (their ratio is 0.88 at least), and the whole name is cut.
A common word alone therefore brings no two names together.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions import names as N
from ..sources.tables import written

#: Fixed value: the least ratio of two names, in hundredths.
RATIO = 92
LEAST_CHARS = 8


def _keys(df: DataFrame, name: str) -> DataFrame:
    """Each canonical name once; written, as names are folded slowly and all kinds of matches read them."""
    return written(df.select(N.canonical(F.col(f"`{name}`")).alias("key")).distinct(), "names").where("key is not null and key <> ''")


def _parts(n: int, k: int) -> list[tuple[int, int]]:
    """Start and length of ``k`` parts of ``n`` characters that do not overlap; none if there are too few characters. Long ones are even, so neighbouring ``n`` share theirs."""
    if n < k:
        return []
    w = n // k
    w -= w % 2 if w >= 8 else 0
    return [(i * (n - w) // (k - 1) if k > 1 else 0, w if k > 1 else n) for i in range(k)]


def _without_one(s: str) -> list[str]:
    return [s[:i] + s[i + 1 :] for i in range(len(s)) if not i or s[i] != s[i - 1]]


def _cut(s: str, shared: int) -> set[str]:
    """Keys of a left text; ``shared`` characters more stand on both sides."""
    n, out = len(s), set()
    total = n + shared
    least, most = -(-RATIO * total // (200 - RATIO)), (200 - RATIO) * total // RATIO
    for k in {_changes(total, t) // 2 + 1 for t in range(least, most + 1)}:
        parts = _parts(n, k)
        if not parts:
            out.add(f"{k}:")
        for i, (at, w) in enumerate(parts):
            part = s[at : at + w]
            out.add(f"{k}:{i}={part}")
            out.update(f"{k}:{i}-{x}" for x in _without_one(part))
    return out


def _met(s: str, shared: int) -> set[str]:
    """Keys of a right text that meet those of any left text near enough."""
    m, out = len(s), set()
    total = m + shared
    least, most = -(-RATIO * total // (200 - RATIO)), (200 - RATIO) * total // RATIO
    for n in range(max(0, least - shared), most - shared + 1):
        d = _changes(n + shared, total)
        k, more = d // 2 + 1, m - n
        if abs(more) > d:
            continue
        parts = _parts(n, k)
        if not parts:
            out.add(f"{k}:")
        for i, (at, w) in enumerate(parts):
            for longer in (0, 1, -1):
                for shift in range(-d, d + 1) if at else (0,):
                    after = more - shift - longer
                    if (after and at + w == n) or abs(shift) + abs(after) + abs(longer) > d or at + shift < 0 or w + longer < 0:
                        continue
                    sub = s[at + shift : at + shift + w + longer]
                    if len(sub) < w + longer:
                        continue
                    if longer == 0:
                        out.add(f"{k}:{i}={sub}")
                    elif longer == 1:
                        out.update(f"{k}:{i}={x}" for x in _without_one(sub))
                    else:
                        out.add(f"{k}:{i}-{sub}")
    return out


def _changes(a: int, b: int) -> int:
    """The most characters of two names of these lengths that may stay unmatched."""
    return (100 - RATIO) * (a + b) // 100


def _spread(df: DataFrame) -> DataFrame:
    """The rows over as many tasks as shuffles have: few bytes of names are much work."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _keyed(names: DataFrame, side: str) -> DataFrame:
    """Each name with the hashes of its keys; ``side`` is the new name of its column."""
    cut = _cut if side == "left_key" else _met

    @F.pandas_udf(ArrayType(StringType()))
    def keys(texts: pd.Series) -> pd.Series:
        def one(s: str) -> list[str]:
            first, last = s[: s.index(" ")], s[s.rindex(" ") + 1 :]
            out = [f"f {first} {x}" for x in cut(s[len(first) + 1 :], len(first) + 1)]
            out += [f"l {last} {x}" for x in cut(s[: -len(last) - 1], len(last) + 1)]
            return out + ([f"n {x}" for x in cut(s, 0)] if len(first) >= 4 and len(last) >= 4 else [])

        return texts.map(one)

    return _spread(names).select(F.col("key").alias(side), F.explode(keys("key")).alias("met")).select(side, F.xxhash64("met").alias("met"))


def meetings(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs (left_key, right_key) of ``key`` columns that share a key, once for each key they share; no similar pair is lost."""
    long = lambda df: df.where((F.length("key") >= LEAST_CHARS) & F.col("key").contains(" "))
    # a name has hundreds of keys, which Spark takes for one: by its estimate it would send them all through the driver
    return _keyed(long(left), "left_key").join(_keyed(long(right), "right_key").hint("merge"), "met").select("left_key", "right_key")


def candidates(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs (left_key, right_key) of ``key`` columns that meet and are few enough edits apart; no similar pair is lost."""
    changes = F.floor((100 - RATIO) * (F.length("left_key") + F.length("right_key")) / 100).cast("int")
    near = (F.abs(F.length("left_key") - F.length("right_key")) <= changes) & (F.call_function("levenshtein", F.col("left_key"), F.col("right_key"), changes) >= 0)
    return meetings(left, right).where(near).distinct()


def matches(left: DataFrame, right: DataFrame, left_name: str = "name", right_name: str = "name") -> DataFrame:
    """left_key, right_key (canonical names) and kind: same, reversed (all tokens in the opposite order) or similar; a pair has one kind, the first that holds.

    Names are taken once each, however many rows have them; join the result back by
    ``names.canonical``. Null and blank names match nothing.
    """
    a, b = _keys(left, left_name), _keys(right, right_name)
    turned = F.array_join(F.reverse(F.split("left_key", " ")), " ")
    l, r = a.withColumnRenamed("key", "left_key"), b.withColumnRenamed("key", "right_key")
    r = r.hint("merge")  # names grow with the tables
    same = l.join(r, F.col("left_key") == F.col("right_key")).withColumn("kind", F.lit("same"))
    back = l.withColumn("turned", turned).join(r, (F.col("turned") == F.col("right_key")) & (F.col("turned") != F.col("left_key"))).drop("turned").withColumn("kind", F.lit("reversed"))
    strict = same.unionByName(back)
    # written, or the ratio would be worked out once for each key that a pair shares
    near = _spread(written(candidates(a, b), "candidates"))
    alike = near.where(N.fuzzy_same(F.col("left_key"), F.col("right_key"))).join(strict.select("left_key", "right_key").hint("merge"), ["left_key", "right_key"], "left_anti").withColumn("kind", F.lit("similar"))
    return strict.unionByName(alike)
