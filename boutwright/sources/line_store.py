"""Quotes kept for lookups by pair: partitioned by day and by a bucket of the pair, sorted by pair, batch by batch."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.identity import event_or_pair_key
from ..functions.names import normalise
from ..operators import lines as P
from . import commits

BUCKETS = 16
#: Columns that belong to a side, and their partners.
SIDED = (("fighter_a", "fighter_b"), ("a_prob", "b_prob"), ("a_odds", "b_odds"))


def pair_key(a: Column, b: Column) -> Column:
    return F.array_join(F.array_sort(F.array(normalise(a), normalise(b))), "|")


def bucket(key: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def save(quotes: DataFrame, root: str, batch: int, buckets: int = BUCKETS) -> bool:
    """Quotes (fighter_a, fighter_b, event_id, starts_at, snapshot_time and prices) as one committed batch; False if it stands already. Rows without a snapshot time are left out."""
    key = pair_key(F.col("fighter_a"), F.col("fighter_b"))
    own = quotes.where("snapshot_time is not null").withColumns({"pair_key": key, "fight_key": event_or_pair_key(F.col("event_id"), F.col("starts_at"), F.col("fighter_a"), F.col("fighter_b"))})
    own = own.withColumns({"day": F.to_date("snapshot_time"), "bucket": bucket(F.col("pair_key"), buckets)})
    placed = own.repartition("day", "bucket").sortWithinPartitions("day", "bucket", "pair_key", "snapshot_time")
    return commits.commit_frames({"quotes": placed}, root, batch, {"buckets": buckets, "schema": own.schema.json()}, partition_by=("day", "bucket"))


def stored(spark: SparkSession, root: str) -> DataFrame:
    """All committed quotes."""
    found = commits.entries(spark, root)
    if not found:
        raise ValueError(f"no quotes are stored under {root}")
    schema = StructType.fromJson(json.loads(found[-1]["note"]["schema"]))
    return commits.read_committed(spark, root, "quotes", schema)


def _cutoff(as_of: str) -> dt.datetime:
    """A bare date means the end of that day."""
    end = dt.datetime.fromisoformat(as_of)
    return end if "T" in as_of or " " in as_of else end + dt.timedelta(days=1, microseconds=-1)


def line_history(spark: SparkSession, root: str, a: str, b: str, event_id: str | None = None, starts_at: str | None = None, as_of: str | None = None) -> DataFrame:
    """Quotes of a pair in either order, turned to (a, b), oldest first.

    ``event_id`` and ``starts_at`` keep that fight alone; without an event the pair's latest fight is
    taken; ``as_of`` is a date or a time. Only the pair's bucket and the days up to the cutoff are
    read, and of those only row groups that can hold the pair.
    """
    found = commits.entries(spark, root)
    key, own = spark.range(1).select(pair_key(F.lit(a), F.lit(b)), normalise(F.lit(a))).first()
    number = spark.range(1).select(bucket(F.lit(key), found[-1]["note"]["buckets"] if found else BUCKETS)).first()[0]
    df = stored(spark, root).where((F.col("bucket") == number) & (F.col("pair_key") == key))
    if as_of is not None:
        end = _cutoff(as_of)
        df = df.where((F.col("day") <= F.lit(end.date())) & (F.col("snapshot_time").cast("timestamp_ntz") <= F.lit(end.isoformat(sep=" ")).cast("timestamp_ntz")))
    if event_id:
        df = df.where(F.col("event_id") == event_id)
    if starts_at is not None:
        df = df.where(F.col("starts_at").cast("timestamp_ntz") == F.lit(starts_at).cast("timestamp_ntz"))
    if not event_id:
        df = P.latest_key(df, "pair_key", "fight_key")
    turned = normalise(F.col("fighter_a")) != F.lit(own)
    has = set(df.columns)
    swap = {c: F.when(turned, F.col(o)).otherwise(F.col(c)) for x, y in SIDED if x in has and y in has for c, o in ((x, y), (y, x))}
    return df.withColumns(swap).drop("day", "bucket").orderBy("snapshot_time")
