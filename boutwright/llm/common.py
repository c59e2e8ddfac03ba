"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that ends a word: \x20 and \x09-\x0D (what bytes.split() splits on).
SPACE = " \t\n\x0b\f\r"
SPACE_RE = r"[\x20\x09-\x0D]+"
#: Largest row count that is broadcast; beyond it the same join is shuffled.
BROADCAST_ROWS = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A local master without one gets a folder of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="boutwright-"))
    return sc.getCheckpointDir()


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*written: DataFrame | tuple[SparkSession, str]) -> None:
    """Delete the files of materialised tables (or of a session's path) that nothing reads any more."""
    for df in written:
        spark, stored_at = df if isinstance(df, tuple) else (df.sparkSession, df.stored_at)
        sc = spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(stored_at)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def text_key(col: str = "text") -> Column:
    """16 bytes that stand for a whole text; equal for equal texts (null counts as empty)."""
    return F.unhex(F.md5(text_or_empty(col)))


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text as an array; empty for null and blank texts."""
    trimmed = F.btrim(text, F.lit(SPACE))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, SPACE_RE)).otherwise(F.array().cast("array<string>"))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows, else unchanged (the join then shuffles)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def without(docs: DataFrame, keys: DataFrame, on: dict[str, Column]) -> DataFrame:
    """Rows of ``docs`` whose key is not in ``keys``; ``on`` maps each column of ``keys`` to its expression over ``docs``."""
    keys = keys.toDF(*[f"__k{i}" for i, _ in enumerate(keys.columns)])
    cond = None
    for i, expr in enumerate(on.values()):
        c = expr.eqNullSafe(F.col(f"__k{i}"))
        cond = c if cond is None else cond & c
    return docs.join(small(keys), cond, "left_anti")
