"""Runs queries on Spark and their SQL on DuckDB and compares all rows."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p / '*.parquet' if p.is_dir() else p}')")
    return con


def _plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return v
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    if isinstance(v, float):
        return round(v, 5) + 0.0
    if type(v).__name__ in ("Decimal",):
        return float(v)
    return v


def rows(cols, values):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in values), key=lambda r: tuple((x is None, str(x)) for x in r))


def same(spark, con, f, sql: str, sf_dir: str) -> str:
    """Empty if both give the same rows, else what differs."""
    df = f(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(sql)
    names = [c[0] for c in rel.description]
    want = rows(names, rel.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} rows and {len(want)}"
    for g, w in zip(got, want):
        if g != w and not all(a == b or isinstance(a, float) and isinstance(b, (int, float)) and abs(a - b) <= 2e-5 * max(1, abs(a)) for a, b in zip(g, w)):
            return f"{g} and {w}"
    return "" if got else "no rows"


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).parents[1]))
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    d = sys.argv[1]
    con, q, s = connect(d), e.queries(), e.oracle_sql()
    for k in sys.argv[2:] or sorted(s):
        t = time.time()
        try:
            said = same(spark, con, q[k], s[k], d) if k in s else f"{q[k](spark, d).count()} rows, no SQL"
        except Exception as x:
            said = f"{type(x).__name__}: {str(x)[:600]}"
        print("##", k, "ok" if not said else said, round(time.time() - t, 1), flush=True)
