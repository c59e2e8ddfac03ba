"""SimHash near-duplicates with bit-sliced comparison.

1. A 64-bit fingerprint for each document (3-word shingles, XXH64, majority of bits).
2. Equal fingerprints collapse, so copies cost one row however many there are.
3. Fingerprints at most 3 bits apart agree wholly on one of any 4 parts of the bits, so each
   goes to 4 buckets. A bucket beyond ``MAX_BUCKET`` fingerprints is split again on the bits it
   has left, which loses no link; with 12 bits left it can hold 4,096 distinct ones at most.
4. In a bucket the fingerprints stand as 64 bit planes. All pairs at a lane distance s are
   compared at once by XOR of each plane with itself shifted by s; carry-save counters add the
   64 difference bits; a comparison is given up once every lane is past the radius.
5. Each bucket gives a spanning forest of its links; components join the buckets.

Defined cases: null and blank texts have fingerprint zero and link like any other; a null doc_id
never becomes a component's id unless all its ids are null; repeated rows stay repeated; an empty
table gives an empty result; other input columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, table, text_key, without
from .graph import components

RADIUS = 3
MAX_BUCKET = 4096
CHUNK = 1 << 16
ALL = (1 << 64) - 1


# fingerprints ---------------------------------------------------------------------------------
def fingerprint(text: str | None) -> int:
    """Unsigned SimHash of a whole text."""
    from xxhash import xxh64_intdigest

    ws = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not ws:
        return 0
    flat = b" ".join(ws)
    if len(ws) <= 3:
        return xxh64_intdigest(flat, 42)
    n = len(ws) - 2
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1)
    starts = np.concatenate(([0], ends[: n - 1])).tolist()
    view = memoryview(flat)
    counts = np.zeros(64, np.int64)
    stops = (ends[2:] - 1).tolist()
    for at in range(0, n, CHUNK):  # bounded memory for very long texts
        h = np.fromiter((xxh64_intdigest(view[s:e], 42) for s, e in zip(starts[at : at + CHUNK], stops[at : at + CHUNK])), np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = np.fromiter((fingerprint(x.as_py()) for x in b.column("text")), np.uint64, b.num_rows).view(np.int64)
        cols = {n: b.column(n) for n in b.schema.names if n != "text"} | {"fp": pa.array(fps)}
        yield pa.RecordBatch.from_pydict(cols)


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns and ``fp``, the fingerprint as a signed long."""
    src = docs.select(*keep, F.col(text).cast("string").alias("text"))
    schema = T.StructType([src.schema[c] for c in keep] + [T.StructField("fp", T.LongType())])
    return src.mapInArrow(_fingerprints, schema)


# candidate buckets ----------------------------------------------------------------------------
def _parts(mask: int) -> list[int]:
    """Masks of 4 near-equal parts of the set bits of ``mask`` (fewer where there are fewer bits)."""
    bits = [i for i in range(64) if mask >> i & 1]
    return [sum(1 << i for i in map(int, p)) for p in np.array_split(bits, 4) if len(p)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _split(keyed: DataFrame, masks: list[int]) -> tuple[DataFrame, list[int]]:
    """Each fingerprint of a bucket that agrees on ``mask`` to the buckets that agree on one part more."""
    spark = keyed.sparkSession
    finer = {m: [m | p for p in _parts(ALL & ~m)] for m in masks}
    rows = [(_signed(m), [_signed(x) for x in xs]) for m, xs in finer.items()]
    if len(rows) == 1:
        out = keyed.select("fp", F.explode(F.array(*map(F.lit, rows[0][1]))).alias("mask"))
    else:
        ways = F.broadcast(spark.createDataFrame(rows, "mask long, finer array<long>"))  # 4 ** depth rows
        out = keyed.join(ways, "mask").select("fp", F.explode("finer").alias("mask"))
    return out.withColumn("val", F.col("fp").bitwiseAND(F.col("mask"))), sorted({x for xs in finer.values() for x in xs})


def candidate_buckets(fps: DataFrame, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """``(fp, mask, val)``: all pairs within the radius share a bucket; none holds more than ``max_bucket`` (or 4,096)."""
    keyed, masks = _split(fps.select("fp").distinct(), [0])
    done = None
    while True:
        left = 64 - max(bin(m).count("1") for m in masks)
        if left <= 12:
            return keyed if done is None else done.unionByName(keyed)
        hot = keyed.groupBy("mask", "val").count().where(F.col("count") > max_bucket).select("mask", "val", F.lit(True).alias("hot"))
        hot = materialise(hot, "hot-buckets")
        if hot.isEmpty():
            return keyed if done is None else done.unionByName(keyed)
        tagged = materialise(keyed.join(hot, ["mask", "val"], "left"), "buckets")
        cold = tagged.where(F.col("hot").isNull()).drop("hot")
        done = cold if done is None else done.unionByName(cold)
        keyed, masks = _split(tagged.where("hot").select("fp", "mask"), masks)
        keyed = keyed.distinct()


# bit-sliced comparison ------------------------------------------------------------------------
def bit_planes(fps: np.ndarray) -> np.ndarray:
    """uint64 fingerprints to planes[bit, word]: lane i is bit i % 64 of word i // 64."""
    lanes = -(-len(fps) // 64) * 64
    padded = np.zeros(lanes, np.uint64)
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")).view(np.uint64)


def _shifted(planes: np.ndarray, s: int) -> np.ndarray:
    """Lane i gets what lane i + s holds."""
    q, r = divmod(s, 64)
    out = np.zeros_like(planes)
    part = planes[..., q:]
    out[..., : part.shape[-1]] = part >> np.uint64(r) if r else part
    if r and part.shape[-1] > 1:
        out[..., : part.shape[-1] - 1] |= part[..., 1:] << np.uint64(64 - r)
    return out


def within_radius(planes: np.ndarray, s: int, valid: np.ndarray) -> np.ndarray:
    """Word mask of the lanes i of ``valid`` whose fingerprint differs from lane i + s in at most 3 bits."""
    one, two, over = (np.zeros(planes.shape[1], np.uint64) for _ in range(3))
    for at in range(0, 64, 8):
        part = planes[at : at + 8]
        for diff in part ^ _shifted(part, s):
            carry = one & diff
            one ^= diff
            over |= two & carry  # four or more
            two ^= carry
        if not np.any(valid & ~over):
            break
    return valid & ~over


def bucket_forest(fps: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that span what is within the radius inside each group; rows of a group must be adjacent."""
    inverse = np.unique(group, return_inverse=True)[1]
    sizes = np.bincount(inverse)
    # larger groups first: later shifts need a prefix only
    order = np.lexsort((inverse, -sizes[inverse]))
    fps, gid = fps[order], inverse[order]
    size = sizes[gid]
    planes, lab = bit_planes(fps), np.arange(len(fps))
    for s in range(1, int(sizes.max(initial=1))):
        n = int(np.searchsorted(-size, -s, side="left"))  # lanes in groups of more than s
        if n <= s:
            break
        words_n = -(-n // 64)
        same = np.zeros(words_n * 64, np.uint8)
        same[: n - s] = gid[: n - s] == gid[s:n]
        valid = np.packbits(same, bitorder="little").view(np.uint64)
        hits = within_radius(planes[:, :words_n], s, valid)
        if not hits.any():
            continue
        i = np.flatnonzero(np.unpackbits(hits.view(np.uint8), bitorder="little"))
        i = i[lab[i] != lab[i + s]]
        if len(i):
            lab = _united(lab, i, i + s)
    linked = np.flatnonzero(lab != np.arange(len(fps)))
    return fps[linked], fps[lab[linked]]


def _united(lab: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    parent = lab.tolist()

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    out = np.array(parent)
    while True:  # flatten
        nxt = out[out]
        if np.array_equal(nxt, out):
            return out
        out = nxt


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets arrive sorted; a bucket that a batch cuts is carried to the next."""
    held = [np.zeros((0, 3), np.int64)]
    count = 0

    def flush(rows: np.ndarray) -> pa.RecordBatch | None:
        if len(rows) < 2:
            return None
        new = np.concatenate(([True], np.any(rows[1:, :2] != rows[:-1, :2], axis=1)))
        a, b = bucket_forest(rows[:, 2].copy().view(np.uint64), np.cumsum(new))
        return pa.RecordBatch.from_pydict({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))}) if len(a) else None

    for batch in batches:
        held.append(np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in ("mask", "val", "fp")], axis=1))
        count += batch.num_rows
        if count >= CHUNK:
            rows = np.concatenate(held)
            last = rows[-1, :2]
            cut = len(rows) - int(np.argmin(np.append(np.all(rows[::-1, :2] == last, axis=1), False)))
            held, count = [rows[cut:]], len(rows) - cut
            if (out := flush(rows[:cut])) is not None:
                yield out
    if (out := flush(np.concatenate(held))) is not None:
        yield out


def fingerprint_links(fps: DataFrame, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints that span all pairs within the radius."""
    keyed = candidate_buckets(fps, max_bucket)
    parts = keyed.repartition("mask", "val").sortWithinPartitions("mask", "val")
    return parts.mapInArrow(_links, "a long, b long")


def fp_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def near_duplicates(docs: DataFrame, keep: list[str], max_bucket: int = MAX_BUCKET) -> DataFrame:
    """``keep`` columns (first the id), ``fp`` and ``root``: the component's smallest fingerprint (its own where unlinked)."""
    marks = materialise(fingerprints(docs, keep), "fingerprints")
    roots = materialise(components(fingerprint_links(marks, max_bucket)), "roots")
    return marks.join(roots, marks["fp"] == roots["node"], "left").select(*keep, "fp", F.coalesce("root", "fp").alias("root"))


def component_ids(docs: DataFrame, doc_id: str = "doc_id", max_bucket: int = MAX_BUCKET) -> DataFrame:
    marks = materialise(fingerprints(docs, [doc_id]), "fingerprints")
    distinct = materialise(marks.groupBy("fp").agg(F.min(doc_id).alias("least_id")), "distinct-fps")
    roots = components(fingerprint_links(distinct, max_bucket))
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    named = materialise(named, "roots")
    # only linked fingerprints need their component's least id; the others have their own
    least = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = named.join(least, "root").select("fp", "component_id")
    return marks.join(named, "fp").select(doc_id, fp_hex(F.col("fp")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The pipeline's stage: of each near-duplicate group the document with the smallest doc_id stays.

    Among rows that also share the id the smallest text key stays, and of wholly equal ones one row.
    """
    keyed = docs.select("doc_id", text_key().alias("tkey"), "text")
    named = materialise(near_duplicates(keyed, ["doc_id", "tkey"]), "near-duplicates")
    rows = named.groupBy("root", "doc_id", "tkey").agg(F.count(F.lit(1)).alias("n"))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tkey")
    best = rows.groupBy("root").agg(F.min(rank).alias("best"))
    rows = materialise(rows.join(best, "root").withColumn("stays", rank == F.col("best")), "keepers")
    on = {"doc_id": F.col("doc_id"), "tkey": text_key()}
    gone = rows.where(~F.col("stays")).select("doc_id", "tkey")
    kept = without(docs, gone, on)
    twice = rows.where(F.col("stays") & (F.col("n") > 1)).select("doc_id", "tkey")
    if twice.isEmpty():
        return kept
    single = without(kept, twice, on)
    again = kept.withColumn("__t", text_key()).join(twice.toDF("__d", "__k"), F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__t") == F.col("__k")))
    return single.unionByName(again.dropDuplicates(["__d", "__k"]).drop("__d", "__k", "__t"))


def op10_simhash(spark, sf_dir):
    return component_ids(table(spark, sf_dir, "documents"))
