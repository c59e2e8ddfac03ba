"""Shards of near equal bytes by longest-processing-time scheduling.

Equal texts stay together. Groups go, largest first, to the least-loaded shard through a heap.
Groups over a 1/4,096 of a shard's share of bytes or of rows are few (131,072 at most, by counting)
and are scheduled one by one. All others are counted on the cluster by size class: the exact size
below 8 KiB, above that its 13 leading bits, so a class is at most 1/4,096 wide and there are some
thousands of classes for every doubling of the largest size, however many groups there are. The
members of a class follow each other in the schedule, so a class is dealt in one step: how many of
them each shard takes until loads are level. Members are numbered on the cluster and take their
shard by number. Slots number each shard's rows without gaps.

Defined cases: a null text has size 1; equal texts (null counts as empty) share a shard; repeated
rows get a slot each; an empty table gives an empty result; other input columns are not read.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, table, text_key, text_or_empty
from .packing import numbered

SHARDS = 16
#: Groups above a shard's share / BIG, in bytes or in rows, are scheduled on their own.
BIG = 4096
#: Leading bits of a size that make its class.
BITS = 13


def size_class(size: Column) -> Column:
    """The size with all but its BITS leading bits cleared."""
    drop = F.greatest(F.length(F.bin(size)) - BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", size, drop), drop)


def longest_first(items: list[tuple[object, float, int]], shards: int) -> dict[object, list[int]]:
    """How many of each item's members every shard takes; items are (name, size of a member, members).

    Members go from the largest to the least-loaded shard. Equal members are given at once up to a
    common level, and what is left of them (fewer than there are shards) through the heap.
    """
    loads, out = [0.0] * shards, {}
    for name, size, n in sorted(items, key=lambda x: (-x[1], str(x[0]))):
        given = [0] * shards
        if n >= shards:
            low, high = min(loads), max(loads) + size * (n + 1)
            for _ in range(80):  # the highest level that n members reach
                level = (low + high) / 2
                if sum(max(0, int((level - x) // size)) for x in loads) <= n:
                    low = level
                else:
                    high = level
            given = [max(0, int((low - x) // size)) for x in loads]
        heap = [(x + g * size, s) for s, (x, g) in enumerate(zip(loads, given))]
        heapq.heapify(heap)
        for _ in range(n - sum(given)):
            load, s = heap[0]
            given[s] += 1
            heapq.heapreplace(heap, (load + size, s))
        loads = [load for load, _ in sorted(heap, key=lambda x: x[1])]
        out[name] = given
    return out


def shard(docs: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    spark = docs.sparkSession
    t = text_or_empty(text)
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_key(text).alias("key"), (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"))
    rows = materialise(rows, "sizes")
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("many"))
    groups = materialise(groups.withColumn("class", size_class(F.col("bytes"))), "groups")
    total, count = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum("many"), F.lit(0))).first()
    alone = (F.col("bytes") > total / shards / BIG) | (F.col("many") > max(count / shards / BIG, 1))
    big = groups.where(alone).select("key", "bytes").collect()  # fewer than 2 * shards * BIG rows, whatever the corpus
    small = groups.where(~alone)
    classes = small.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.avg("bytes").alias("bytes")).collect()  # 2 ** BITS a doubling at most
    dealt = longest_first([(bytes(r["key"]), float(r["bytes"]), 1) for r in big] + [(r["class"], r["bytes"], r["n"]) for r in classes], shards)
    own = spark.createDataFrame([(bytearray(k), g.index(1)) for k, g in dealt.items() if isinstance(k, bytes)], "key binary, shard int")
    ends = spark.createDataFrame([(k, [sum(g[: s + 1]) for s in range(shards)]) for k, g in dealt.items() if not isinstance(k, bytes)], "class long, ends array<long>")
    ranked = numbered(small.select("key", "class"), "class", ["key"], "rank").join(F.broadcast(ends), "class")
    of_key = ranked.select("key", F.size(F.filter("ends", lambda e: e <= F.col("rank"))).alias("shard"))
    # rows of a group with many rows never meet in one task: its shard is looked up where they stand
    marked = rows.join(F.broadcast(own), "key", "left")
    placed = marked.where("shard is not null").drop("key").unionByName(marked.where("shard is null").drop("shard").join(of_key, "key").drop("key"))
    placed = numbered(materialise(placed, "placed"), "shard", ["doc_id", "text_crc32", "size"], "slot")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_sharding(spark, sf_dir):
    return shard(table(spark, sf_dir, "documents"))
