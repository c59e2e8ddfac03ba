"""Streams of quotes: tumbling windows, first-seen lines, re-alerts and unique sinks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def quote_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def tumbling(stream: DataFrame, time: str, key: str, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Count, open and close of each key and window; rows later than ``late`` are left out."""
    s = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    at = F.struct(time, "event_id")
    return s.groupBy(F.window(time, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.min_by("value", at).alias("open_price"), F.max_by("value", at).alias("close_price")).select(F.col("w.start").alias("window_start"), key, "n", "open_price", "close_price")


def first_seen(stream: DataFrame, key: str, time: str, value: str, tie: str = "event_id") -> DataFrame:
    """The earliest known quote of each key over all rows, in whatever order they come; for complete mode, with one row of state a key."""
    s = stream.withColumn(time, F.col(time).cast("timestamp"))
    at = F.when(F.col(time).isNotNull() & F.col(value).isNotNull(), F.struct(time, tie))
    return s.groupBy(key).agg(F.min_by(value, at).alias("opening"), F.min(time).alias("seen_at"))


def realerts(stream: DataFrame, key: str, order: str, magnitude: str, step_size: float = 0.05, idle_ms: int | None = None) -> DataFrame:
    """An alert the first time and then whenever the magnitude has grown by ``step_size`` since the last; a key without news for ``idle_ms`` is forgotten (for streams that run on; None keeps keys)."""
    schema = f"{key} {dict(stream.dtypes)[key]}, {order} {dict(stream.dtypes)[order]}, magnitude double"

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        out = []
        for o, m in sorted(zip(*(pd.concat(list(frames))[[order, magnitude]].T.values.tolist()))):
            if last is None or m >= last + step_size:
                last = m
                out.append((k[0], o, m))
        if last is not None:
            state.update((float(last),))
            if idle_ms:
                state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=[key, order, "magnitude"])

    return stream.groupBy(key).applyInPandasWithState(step, schema, "last double", "append", GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout)


def append_unique(stream: DataFrame, path: str, checkpoint: str, key: str, buckets: int = 64):
    """A started query that appends only rows whose key the sink has not seen; replayed batches add nothing.

    The sink is partitioned by a hash of the key, and a batch reads the partitions of its own keys alone.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates([key]).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).persist()
        try:
            touched = [r["bucket"] for r in fresh.select("bucket").distinct().collect()]  # ``buckets`` at most
            try:
                old = spark.read.parquet(path).where(F.col("bucket").isin(touched)).select(key)
            except Exception as e:  # the first batch finds no sink
                if "PATH_NOT_FOUND" not in str(e):
                    raise
                new = fresh
            else:
                new = fresh.join(old, key, "left_anti")
            new.write.mode("append").partitionBy("bucket").parquet(path)
        finally:
            fresh.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def unique_activity(stream: DataFrame, key: str, time: str, late: str = "1 day") -> DataFrame:
    """Each activity once: repeats of a key within ``late`` of its time are dropped, and their state with them."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def retained(snapshots: DataFrame, time: str, now, full_days: int, keep_days: int, daily: int = 1) -> DataFrame:
    """Snapshots to keep: all of the last ``full_days``, the last ``daily`` of each older day, none beyond ``keep_days``; undated ones stay."""
    age = F.datediff(F.lit(now).cast("date"), F.to_date(time))
    n = F.row_number().over(Window.partitionBy(F.to_date(time)).orderBy(F.desc(time), F.desc("row_id")))
    ranked = snapshots.withColumn("__age", age).where("__age is null or __age < " + str(keep_days)).withColumn("__n", n)
    return ranked.where((F.col("__age") < full_days) | (F.col("__n") <= daily) | F.col("__age").isNull()).drop("__age", "__n")


def run_to_files(spark: SparkSession, df: DataFrame, root: str) -> DataFrame:
    """All that is available, in complete mode: each batch writes the whole result under its own id, and the last one counts; the ones before the last two are deleted."""
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/result/batch={batch_id}")  # a replayed batch replaces itself
        old = fs.Path(f"{root}/result/batch={batch_id - 2}")
        old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)

    q = df.writeStream.foreachBatch(write).outputMode("complete").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    last = q.lastProgress["batchId"] if q.lastProgress else 0
    return spark.read.schema(df.schema).parquet(f"{root}/result/batch={last}")
