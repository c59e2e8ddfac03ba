"""Chooses the toxicity lexicon's settings by cross-validation inside the training folds.

    python -m boutwright.llm.choose_toxicity /root/testdata/sf0.1

Rows of the held-out fold are never read: folds 1 to 4 take turns as the validation fold. Every
setting of the grid is ranked by the F1 of all its validation rows together; of equal ones the
stricter is first (more documents, weight and ratio an entry, fewer word beginnings). The script
reads at most ``SAMPLE`` labelled rows into the driver.
"""

from __future__ import annotations

import itertools
import math
import sys
from collections import Counter

import numpy as np

from . import toxicity as tox

GRID = {"least_docs": (3, 5, 8, 12), "least_weight": (1.0, 1.5, 2.0, 3.0), "least_ratio": (8.0, 12.0, 18.0, 25.0), "prefixes": ((), (4, 5, 6, 7, 8), (5, 6, 7, 8, 9))}


def _lexicon(pos: Counter, neg: Counter, p: int, q: int, s: tox.Settings) -> dict[str, float]:
    out = {}
    for f, a in pos.items():
        b = neg[f]
        if a < s.least_docs or len(f) - 1 not in s.prefixes and not f.endswith(" "):
            continue
        w = math.log((a + 0.5) / (p + 1)) - math.log((b + 0.5) / (q + 1))
        if w >= s.least_weight and _ratio(a, b, p, q) >= s.least_ratio:
            out[f] = w
    return out


def _ratio(a: int, b: int, p: int, q: int) -> float:
    share = (a + b) / (p + q)
    part = lambda seen, n, e: seen * math.log(seen / (e * n)) if seen else 0.0
    return 2 * (part(a, p, share) + part(b, q, share) + part(p - a, p, 1 - share) + part(q - b, q, 1 - share))


def rank(rows: list[tuple[int, bool, str]]) -> list[tuple[float, int, int, int, tox.Settings]]:
    """(F1, true, false, missed, settings) from the best; rows are (fold, toxic, folded text)."""
    every = tuple(sorted({k for p in GRID["prefixes"] for k in p}))
    feats = [tox.features(t, every) for _, _, t in rows]
    folds = sorted({f for f, _, _ in rows})
    total = Counter()
    for at in folds:
        pos, neg = Counter(), Counter()
        for (f, y, _), x in zip(rows, feats):
            if f != at:
                (pos if y else neg).update(x)
        pos = Counter({f: n for f, n in pos.items() if n >= min(GRID["least_docs"])})
        train = [(y, t) for f, y, t in rows if f != at]
        valid = [(y, t) for f, y, t in rows if f == at]
        p = sum(y for y, _ in train)
        done: dict[tuple, tuple[int, int, int]] = {}
        for combo in itertools.product(*GRID.values()):
            s = tox.Settings(**dict(zip(GRID, combo)))
            lexicon = _lexicon(pos, neg, p, len(train) - p, s)
            if (key := tuple(sorted(lexicon))) not in done:
                m = tox.Matcher(lexicon)
                seen: tuple[Counter, Counter] = Counter(), Counter()
                for y, t in train:
                    seen[y].update({x for i in m.hits(t) for x in m.phrases(t, i) if " " in x})
                m.exceptions = {x for x, n in seen[0].items() if n >= 3 and not seen[1][x]}
                model = tox.Model(lexicon, m.exceptions, *tox.fit_curve(np.array([m.evidence(t) for _, t in train]), np.array([y for y, _ in train]))) if lexicon else None
                said = [model is not None and model.slope * m.evidence(t) + model.shift >= 0 for _, t in valid]
                done[key] = tuple(sum(a == b for a, b in zip(((x, y) for x, (y, _) in zip(said, valid)), itertools.repeat(k))) for k in ((True, True), (True, False), (False, True)))
            total.update({(s, k): n for k, n in enumerate(done[key])})
    out = []
    for combo in itertools.product(*GRID.values()):
        s = tox.Settings(**dict(zip(GRID, combo)))
        a, b, c = (total[s, k] for k in range(3))
        out.append((2 * a / max(2 * a + b + c, 1), a, b, c, s))
    return sorted(out, key=lambda r: (-r[0], -r[4].least_docs, -r[4].least_weight, -r[4].least_ratio, len(r[4].prefixes)))


def main(sf_dir: str) -> None:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    docs, labels = tox.table(spark, sf_dir, "documents"), tox.table(spark, sf_dir, "labels")
    ids = labels.where(F.col("toxic").isNotNull() & ~tox.held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(tox.SAMPLE)
    fold = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % tox.FOLDS).alias("fold")
    rows = [(r.fold, r.toxic > 0, tox.fold(r.text)) for r in docs.join(ids, "doc_id").select(fold, "toxic", "text").collect()]
    print(len(rows), "rows,", sum(y for _, y, _ in rows), "toxic")
    for f1, a, b, c, s in rank(rows)[:12]:
        print(f"F1 {f1:.4f}: {a} true, {b} false, {c} missed: {s}")


if __name__ == "__main__":
    main(sys.argv[1])
