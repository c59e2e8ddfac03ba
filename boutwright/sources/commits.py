"""A log of committed batches beside the files they wrote.

Data goes to a folder of its own first; a small file under ``_commits``, named by the batch and
moved into place only where no other has it, makes it count. Readers take committed folders alone.
So a pass that dies half-way leaves nothing to see, a pass that is repeated adds nothing, and of two
writers of one batch the first one counts.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

LOG = "_commits"
#: A commit file, as Spark reads it.
ENTRY = "batch long, path string, note string"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _claim(spark: SparkSession, path: str, text: str) -> bool:
    """Write ``text`` to ``path`` in one step unless it exists; whether this call did."""
    jvm, target, fs = _fs(spark, path)
    if fs.exists(target):
        return False
    temp = jvm.org.apache.hadoop.fs.Path(f"{target.getParent()}/.{uuid.uuid4().hex}.tmp")
    out = fs.create(temp, False)
    out.write(bytearray(text, "utf-8"))
    out.close()
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    try:
        files.rename(temp, target, spark.sparkContext._gateway.new_array(kind, 0))  # refuses a target that exists
        return True
    except Exception as e:
        fs.delete(temp, False)
        if "FileAlreadyExists" not in str(e) and not fs.exists(target):
            raise
        return False


def entries(spark: SparkSession, root: str) -> list[dict]:
    """What has been committed, by batch; one small entry a batch."""
    _, log, fs = _fs(spark, f"{root}/{LOG}")
    if not fs.exists(log):
        return []
    files = [s.getPath().toString() for s in fs.listStatus(log) if not s.getPath().getName().startswith(".")]
    if not files:
        return []
    found = spark.read.schema(ENTRY).json(files).collect()
    return sorted(({"batch": r["batch"], "path": r["path"], "note": json.loads(r["note"])} for r in found), key=lambda e: e["batch"])


def committed(spark: SparkSession, root: str, batch: int) -> bool:
    _, p, fs = _fs(spark, f"{root}/{LOG}/{batch:020d}.json")
    return fs.exists(p)


def commit_frames(frames: dict[str, DataFrame], root: str, batch: int, note: dict | None = None, partition_by: tuple[str, ...] = (), refuse_empty: bool = False) -> bool:
    """Write the frames, each under its name, and commit them together as ``batch``; False if that batch stands already."""
    spark = next(iter(frames.values())).sparkSession
    if committed(spark, root, batch):
        return False
    path = f"pass={batch:020d}-{uuid.uuid4().hex}"
    for name, df in frames.items():
        df.write.partitionBy(*partition_by).parquet(f"{root}/{name}/{path}")
        if refuse_empty and spark.read.parquet(f"{root}/{name}/{path}").isEmpty():
            raise ValueError(f"{name} is empty")
    if _claim(spark, f"{root}/{LOG}/{batch:020d}.json", json.dumps({"batch": batch, "path": path, "note": json.dumps(note or {})})):
        return True
    for name in frames:  # another writer was first
        _, p, fs = _fs(spark, f"{root}/{name}/{path}")
        fs.delete(p, True)
    return False


def read_frame(spark: SparkSession, root: str, entry: dict, name: str, schema=None) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(f"{root}/{name}/{entry['path']}")


def read_committed(spark: SparkSession, root: str, name: str, schema, before: int | None = None) -> DataFrame:
    """Rows of ``name`` in all committed batches (those before ``before``, if given); empty if there are none."""
    paths = [f"{root}/{name}/{e['path']}" for e in entries(spark, root) if before is None or e["batch"] < before]
    none = spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{root}/{name}").parquet(*paths).select(*none.columns) if paths else none


def latest(spark: SparkSession, root: str, before: int | None = None) -> dict | None:
    found = [e for e in entries(spark, root) if before is None or e["batch"] < before]
    return found[-1] if found else None
