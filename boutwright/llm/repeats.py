"""Removal of long repeated substrings by prefix-free parsing.

A byte goes if a string of ``window`` bytes that covers it also starts anywhere else in the corpus
(another place of the same text included; matches never cross texts). The window is 400 bytes by
default; the pipeline takes ``PASSAGE``, the query both.

1. Equal texts collapse to one row with a count: a table bucketed by the text's key, so no later
   step shuffles texts again.
2. A rolling hash over 16 bytes triggers phrase starts, which depend on those bytes alone. Each
   window belongs to the first trigger it holds within ``reach`` bytes (a rarer kind first, then a
   commoner kind; a window without any stands for itself). The windows of one trigger are one row
   of the parse: the hash of what they all share from the trigger on (``z``) and the hash of the
   whole dictionary string that holds them (``f``).
3. Corpus order is only needed down to equality over a window, so suffixes are put in classes
   rather than sorted: where z occurs once nothing repeats; where (z, f) occurs twice all its
   windows do; only rows that share z but differ in f (the ends of repeats) are opened, once for
   each distinct (z, f), into parts of 64 windows, which are classed in the same way by the string
   they share and by their whole string; then into parts of 8 and into single windows.
4. Covered bytes are cut out of each distinct text, and every document takes its text's result.

A shorter ``passage`` may be judged beside the window. It comes first: all strings of ``passage``
bytes inside a window that starts elsewhere start elsewhere too, so step 2 for the window then reads
only runs of such strings (and texts with copies, whole).

A suffix array of the whole dictionary or parse would have to stand in one task; classes by
(z, f) give the same equalities with partial aggregation, and skewed keys only meet in joins,
which Spark splits. z is a 64-bit polynomial hash, f the XXH3 of all bytes: a wrong z costs time,
and only a pair of both that is wrong would cost bytes.

Defined cases: a null text is empty; texts shorter than the window lose nothing; very long texts
are parsed in overlapping segments of bounded memory; repeated rows are copies of each other and
go whole; an empty table gives an empty result; a column of the input that has the name of an
output column is replaced by it, all other columns are kept.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, shared_dir, table, text_key, text_or_empty

WINDOW = 400
#: The pipeline's window: 50 tokens of four bytes, the least length at which repeated training text is
#: usually cut; a passage of more than 50 words is longer than that in any language of short words.
PASSAGE = 200
GRAM = 16
RARE, COMMON = 96, 24
SEGMENT = 1 << 20
#: A row of the parse holds spans below 65,536 and distances below 32,768 bytes; both stay below a window.
MAX_WINDOW = 32_000
#: Windows that are opened together if the string they share occurs again.
PARTS = (64, 8, 1)

_rng = np.random.default_rng(7)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse."""
    both = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        out = np.full(n, base, np.uint64)
        out[0] = 1
        both.append(np.multiply.accumulate(out))
    return both[0], both[1]


def reach_of(window: int) -> int:
    """How far into a window its trigger may stand."""
    return window * 4 // 5


class Rolling:
    """Hashes of any substring of one segment, alike wherever it stands."""

    def __init__(self, seg: np.ndarray):
        up, self.down = _powers(1 << (len(seg) + 1).bit_length())
        self.sums = np.zeros(len(seg) + 1, np.uint64)
        np.cumsum(_BYTE[seg] * up[: len(seg)], out=self.sums[1:])
        self.view = memoryview(np.ascontiguousarray(seg))

    def at(self, start: np.ndarray, length) -> np.ndarray:
        return self._mixed((self.sums[start + length] - self.sums[start]) * self.down[start])

    def every(self, length: int) -> np.ndarray:
        """``at`` of all starts in order."""
        h = self.sums[length:] - self.sums[:-length]
        return self._mixed(np.multiply(h, self.down[: len(h)], out=h))

    @staticmethod
    def _mixed(h: np.ndarray) -> np.ndarray:
        h ^= h >> np.uint64(29)
        h *= _MIX
        return h ^ (h >> np.uint64(32))

    def exact(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """XXH3 of the bytes from each start to its stop."""
        view, digest = self.view, xxhash.xxh3_64_intdigest
        return np.array([digest(view[a:b]) for a, b in zip(start.tolist(), stop.tolist())], np.uint64)


def segments(data: bytes, window: int = WINDOW) -> Iterator[tuple[int, np.ndarray]]:
    """Overlapping pieces: each window starts in exactly one."""
    raw = np.frombuffer(data, np.uint8)
    for at in range(0, max(0, len(raw) - window + 1), SEGMENT):
        yield at, raw[at : at + SEGMENT + window - 1]


def _next(marks: np.ndarray, n: int) -> np.ndarray:
    """For each position below n the next mark at or after it (far beyond the end where there is none)."""
    ends = np.append(marks[marks < n], n - 1 if not (marks >= n).any() else marks[marks >= n][0])
    steps = np.diff(np.append(-1, np.minimum(ends, n - 1)))
    out = np.repeat(ends, steps)
    if not (marks >= n - 1).any():
        out[len(out) - steps[-1] :] = 1 << 40
    return out


def parse(seg: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """z, f, first and last window start and distance from there to the trigger of each row of one segment's parse, whether the segment itself repeats it, and spans of windows it repeats."""
    roll, n, reach = Rolling(seg), len(seg) - window + 1, reach_of(window)
    level = roll.every(GRAM) >> np.uint64(32)
    starts = np.arange(n)
    rare = _next(np.flatnonzero(level < (1 << 32) // RARE), n)
    anchor = np.where(rare - starts <= reach, rare, -1)
    if (open_ := np.flatnonzero(anchor < 0)).size:
        common = _next(np.flatnonzero(level < (1 << 32) // COMMON), n)[open_]
        anchor[open_] = np.where(common - open_ <= reach, common, -1 - open_)
    first = np.flatnonzero(np.diff(anchor, prepend=-(1 << 41)))
    last = np.append(first[1:], n) - 1
    own = anchor[first]
    f = roll.exact(first, last + window) ^ ((own - first).astype(np.uint64) << np.uint64(17)) * (own >= 0)
    alone = own < 0
    z = np.where(alone, f, roll.at(np.where(alone, 0, own), window - reach))
    if not alone.any():
        return z, f, first, last, own - last, np.zeros(len(z), np.int64), np.zeros((0, 2), np.int64)
    # windows without a trigger (short periods): one row for each distinct one, known repeats as spans
    at = np.flatnonzero(alone)
    _, one, inverse, times = np.unique(f[at], return_index=True, return_inverse=True, return_counts=True)
    keep = np.sort(np.append(np.flatnonzero(~alone), at[one]))
    twice = np.zeros(len(z), np.int64)
    twice[at] = times[inverse] > 1
    i = first[at[times[inverse] > 1]]
    edge = np.flatnonzero(np.diff(i, prepend=-9) != 1)
    sure = np.stack([i[edge], i[np.append(edge[1:], len(i)) - 1]], axis=1) if len(i) else np.zeros((0, 2), np.int64)
    gap = np.where(alone, 0, own - last)
    return z[keep], f[keep], first[keep], last[keep], gap[keep], twice[keep], sure


ROW = "key long, z long, f long, at long"


def _packed_at(first: np.ndarray, last: np.ndarray, top: np.ndarray, twice) -> np.ndarray:
    """first, last - first, top - last and "occurs twice already" in one number (31, 16, 15 bits and 1)."""
    return (first << 32) + ((last - first) << 16) + ((top - last) << 1) + twice


def _unpacked(at: np.ndarray) -> tuple[np.ndarray, ...]:
    first = at >> 32
    last = first + ((at >> 16) & 0xFFFF)
    return first, last, last + ((at >> 1) & 0x7FFF), at & 1


def _span(at: Column) -> list[Column]:
    first = F.shiftright(at, 32)
    return [first.alias("first"), (first + F.shiftright(at, 16).bitwiseAND(0xFFFF)).alias("last")]


def _batch(out: list) -> pa.RecordBatch:
    key, z, f, at, none = (np.concatenate(c) for c in zip(*out))
    return pa.RecordBatch.from_pydict({"key": pa.array(key, pa.int64()), "z": pa.array(z.view(np.int64), mask=none), "f": pa.array(f.view(np.int64)), "at": pa.array(at.astype(np.int64))})


def _spans_of(lists: pa.ListArray, gap: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """First and last starts of each row's spans in order, those with at most ``gap`` between them united."""
    ends, flat = lists.offsets.to_numpy(), lists.flatten()
    ends = ends - ends[0]
    firsts, lasts = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("first", "last"))
    for i, j in zip(ends[:-1].tolist(), ends[1:].tolist()):
        order = np.argsort(firsts[i:j])
        first, last = firsts[i:j][order], np.maximum.accumulate(lasts[i:j][order])
        if j - i > 1:
            new = first[1:] > last[:-1] + gap
            first, last = first[np.append(True, new)], last[np.append(new, True)]
        yield first, last


def _pieces(data: bytes, window: int, runs: list[tuple[int, int]] | None) -> Iterator[tuple[int, np.ndarray]]:
    """The segments of ``data``, or what they hold of the runs of window starts; each such start is in exactly one."""
    for base, seg in segments(data, window):
        for a, b in [(base, base + len(seg) - window)] if runs is None else runs:
            a, b = max(a, base), min(b, base + len(seg) - window)
            if a <= b:
                yield a, seg[a - base : b - base + window]


def _parse_rows(window: int, passage: int | None = None):
    """Rows of the parse; spans known to repeat within their segment have no z. With ``passage``, a text without copies is read where its ``spans`` of that many bytes leave room for a window."""
    room = window - (passage or window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, held = [], 0
            spans = _spans_of(b.column("spans"), 1) if passage else [None] * len(b)
            for key, x, many, found in zip(b.column("key").to_pylist(), b.column("text"), b.column("many").to_pylist(), spans):
                runs = [(i, j - room) for i, j in zip(*(x.tolist() for x in found)) if j - i >= room] if passage and not many else None
                if runs == []:
                    continue
                for at, seg in _pieces(x.as_py().encode("utf-8", "surrogatepass"), window, runs):
                    z, f, first, last, gap, twice, sure = parse(seg, window)
                    out.append((np.full(len(z), key), z, f, _packed_at(first + at, last + at, last + gap + at, twice | many), np.zeros(len(z), bool)))
                    if len(sure) and not many:
                        a = np.concatenate([np.arange(i, j + 1, window) for i, j in sure])
                        end = np.concatenate([np.minimum(np.arange(i, j + 1, window) + window - 1, j) for i, j in sure])
                        none = np.zeros(len(a), np.uint64)
                        out.append((np.full(len(a), key), none, none, _packed_at(a + at, end + at, end + at, 0), np.ones(len(a), bool)))
                    held += len(z)
                    if held > 1 << 20:
                        yield _batch(out)
                        out, held = [], 0
            if out:
                yield _batch(out)

    return run


def _part_rows(window: int, size: int):
    """Opened rows in parts of up to ``size`` windows by distance to the trigger; z is made of the row's z and the string the part's windows share, f of the part's whole string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.column("rows")
            ends = rows.offsets.to_numpy()
            flat = rows.flatten()
            all_z, all_at = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("z", "at"))
            ends = ends - ends[0]
            for i, (key, x) in enumerate(zip(b.column("key").to_pylist(), b.column("text"))):
                at, zs = all_at[ends[i] : ends[i + 1]], all_z[ends[i] : ends[i + 1]]
                order = np.argsort(at)
                at, zs = at[order], zs[order].view(np.uint64)
                first = at >> 32
                for base, seg in segments(x.as_py().encode("utf-8", "surrogatepass"), window):
                    a, b_ = np.searchsorted(first, [base, base + SEGMENT])
                    if a < b_:
                        yield _batch([_parts(key, base, Rolling(seg), zs[a:b_], at[a:b_], window, size)])

    return run


def _parts(key: int, base: int, roll: Rolling, z: np.ndarray, at: np.ndarray, window: int, size: int) -> tuple:
    first, last, top, twice = _unpacked(at)
    low, high = (top - last) // size, (top - first) // size
    many = high - low + 1
    row = np.repeat(np.arange(len(z)), many)
    k = low[row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    hi = top[row] - k * size
    start, stop = np.maximum(first[row], hi - size + 1), np.minimum(last[row], hi)
    core = roll.at(hi - base, window - size + 1) ^ ((k.astype(np.uint64) + z[row]) * _MIX)
    f = roll.exact(start - base, stop - base + window) ^ ((hi - start).astype(np.uint64) << np.uint64(17))
    return np.full(len(row), key), core, f, _packed_at(start, stop, hi.clip(stop), twice[row]), np.zeros(len(row), bool)


def cut(data: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What is left of ``data``, bytes removed, maximal removed runs; spans are [start, stop) in any order."""
    left, at, removed, runs, stop = [], 0, 0, 0, -1
    for a, b in sorted(spans):
        if a > stop:
            if stop > 0:
                at = stop
            left.append(data[at:a])
            runs += 1
            removed += b - a
            stop = b
        elif b > stop:
            removed += b - stop
            stop = b
    left.append(data[max(stop, 0) :])
    return b"".join(left), removed, runs


def _cut_text(data: bytes, many: int, spans: tuple[np.ndarray, np.ndarray], window: int) -> tuple[bytes, int, int]:
    if many and len(data) >= window:
        return cut(data, [(0, len(data))])
    return cut(data, list(zip(spans[0].tolist(), (spans[1] + window).tolist())))


def _cut_rows(window: int, passage: int | None = None):
    """The columns of OUTPUT, and with ``passage`` those of PASSAGE_OUTPUT; passage_text is null where it equals kept_text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = {c: [] for c in ["key", *OUTPUT, *(PASSAGE_OUTPUT if passage else [])]}
            passages = _spans_of(b.column("passages"), passage) if passage else [None] * len(b)
            for key, x, many, spans, shorter in zip(b.column("key").to_pylist(), b.column("text"), b.column("many").to_pylist(), _spans_of(b.column("spans"), window), passages):
                data = x.as_py().encode("utf-8", "surrogatepass")
                kept, removed, runs = _cut_text(data, many, spans, window)
                row = [key, len(data), removed, runs, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")]  # a cut inside a character leaves no half of it
                if passage:
                    left, removed, runs = _cut_text(data, many, shorter, passage)
                    row += [removed, runs, None if left == kept else left.decode("utf-8", "ignore")]
                for values, value in zip(out.values(), row):
                    values.append(value)
            yield pa.RecordBatch.from_pydict({c: pa.array(values, pa.string() if c in TEXTS else pa.int64()) for c, values in out.items()})

    return run


def distinct_texts(docs: DataFrame, text: str = "text") -> tuple[DataFrame, int]:
    """key, text, many (1 if several documents have it), bucketed by key as the session shuffles; and the key's seed.

    The key is a 64-bit hash. Should two texts ever share one, the next seed is taken.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for seed in range(8):
        name = f"boutwright_texts_{uuid.uuid4().hex}"
        texts = docs.select(_key(text, seed), text_or_empty(text).alias("text"), text_key(text).alias("sum")).groupBy("key")
        many = F.when(F.count(F.lit(1)) > 1, 1).otherwise(0).cast("long")
        texts = texts.agg(F.first("text").alias("text"), many.alias("many"), (F.min("sum") != F.max("sum")).alias("clash"))
        path = f"{shared_dir(spark)}/{name}"
        texts.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(n, "key").saveAsTable(name)
        if spark.table(name).where("clash").isEmpty():
            texts = spark.table(name).drop("clash")
            texts.stored_at, texts.name = path, name
            return texts, seed
        _forget(spark, name, path)
    raise RuntimeError("texts share a key under every seed")


def _forget(spark, name: str, path: str) -> None:
    """Drop the catalogue's entry of a table and delete its files."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    discard((spark, path))


def _key(text: str, seed: int) -> Column:
    return F.xxhash64(text_or_empty(text), F.lit(seed)).alias("key")


def _classed(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Spans whose (z, f) occurs again, and one row of each (z, f) whose z has others too, written."""
    rows = rows.withColumn("rid", F.xxhash64("key", "at"))
    pairs = rows.groupBy("z", "f").agg(F.sum(1 + F.col("at") % 2).alias("n"), F.min("rid").alias("rep"))
    kinds = pairs.groupBy("z").agg((F.count(F.lit(1)) > 1).alias("mixed"))
    pairs = pairs.join(kinds.hint("shuffle_hash"), "z").where("n > 1 or mixed")
    known = rows.join(pairs.hint("shuffle_hash"), ["z", "f"]).withColumn("open", F.expr("mixed and rid = rep")).where("open or at % 2 = 0")
    known = materialise(known.select("key", "z", "at", "n", "open"), name)
    sure = known.where("n > 1 and at % 2 = 0").select("key", *_span(F.col("at")))
    return sure, known.where("open").select("key", "z", F.when(F.col("n") > 1, F.col("at").bitwiseOR(1)).otherwise(F.col("at")).alias("at"))


def _check(window: int) -> None:
    if not 2 * GRAM <= window <= MAX_WINDOW:
        raise ValueError(f"a window of {window} bytes; between {2 * GRAM} and {MAX_WINDOW} can be taken")


def repeated_spans(texts: DataFrame, window: int = WINDOW, shorter: DataFrame | None = None, passage: int | None = None) -> DataFrame:
    """key and its spans (first, last window start) that start elsewhere too; texts with copies are left out.

    A window is at most ``MAX_WINDOW`` bytes: a span and its distance to the trigger must fit the
    bits that a row of the parse has for them. ``shorter`` are the spans of a window of ``passage``
    bytes, where those are known.
    """
    _check(window)
    long = texts.where(F.octet_length("text") >= window)
    if shorter is not None:
        long = long.join(shorter, "key", "left").where("many = 1 or spans is not null").select("key", "text", "many", "spans")
    parsed = materialise(long.mapInArrow(_parse_rows(window, None if shorter is None else passage), ROW), "parse")
    again = parsed.where("z is not null").groupBy("z").agg(F.sum(1 + F.col("at") % 2).alias("n")).where("n > 1").select("z")
    rows = materialise(parsed.join(again.hint("shuffle_hash"), "z", "left_semi"), "parse-again")
    sure = [materialise(parsed.where("z is null").select("key", *_span(F.col("at"))), "within-segments")]
    discard(parsed)
    for size in PARTS:
        found, open_ = _classed(rows, "classes")
        sure.append(found)
        discard(rows)
        listed = open_.groupBy("key").agg(F.collect_list(F.struct("z", "at")).alias("rows"))
        rows = materialise(texts.select("key", "text").join(listed, "key").mapInArrow(_part_rows(window, size), ROW), "parts")
    sure.append(_classed(rows, "windows")[0])
    discard(rows)
    spans = sure[0]
    for more in sure[1:]:
        spans = spans.unionByName(more)
    return spans.groupBy("key").agg(F.collect_list(F.struct("first", "last")).alias("spans"))


OUTPUT = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]
PASSAGE_OUTPUT = ["passage_removed", "passage_spans", "passage_text"]
TEXTS = {"kept_sha256", "kept_text", "passage_text"}


def without_repeats(docs: DataFrame, keep: list[str], text: str = "text", window: int = WINDOW, passage: int | None = None) -> DataFrame:
    """``keep`` columns, n_bytes, n_removed, n_spans, kept_sha256 and kept_text of each document.

    With ``passage``, a shorter window, also what it removes: passage_removed, passage_spans and passage_text.
    """
    _check(window)
    if passage is not None:
        _check(passage)
        if passage >= window:
            raise ValueError(f"a passage of {passage} bytes; it has to be shorter than the window of {window}")
    names = OUTPUT + (PASSAGE_OUTPUT if passage else [])
    texts, seed = distinct_texts(docs, text)
    try:
        shorter = materialise(repeated_spans(texts, passage), "passages") if passage else None
        spans = repeated_spans(texts, window, shorter, passage)
        joined = texts.join(spans, "key", "left").select("key", "text", "many", "spans")
        if passage:
            joined = joined.join(shorter.withColumnRenamed("spans", "passages"), "key", "left")
        schema = ", ".join(f"{c} {'string' if c in TEXTS else 'long'}" for c in ["key", *names])
        found = joined.mapInArrow(_cut_rows(window, passage), schema)
        found = materialise(found.select(F.col("key").alias("__key"), F.struct(*names).alias("__out")), "kept")
    finally:
        _forget(docs.sparkSession, texts.name, texts.stored_at)
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep if c not in names] or [F.lit(0).alias("__none")]).alias("__doc"), _key(text, seed).alias("__own"))
    out = own.join(found, F.col("__own") == F.col("__key")).select("__doc.*", "__out.*").drop("__none")
    return out.withColumn("passage_text", F.coalesce("passage_text", "kept_text")) if passage else out


def cut_documents(docs: DataFrame, window: int = PASSAGE) -> DataFrame:
    """The pipeline's stage: all documents, each with what is left of its text (and n_chars, where there is one)."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("__whole"), "text")
    out = without_repeats(whole, ["__whole"], window=window)
    cols = {c: F.col(f"__whole.`{c}`") for c in docs.columns if c != "text"} | {"text": F.col("kept_text")}
    if "n_chars" in cols:
        cols["n_chars"] = F.length("kept_text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[cols[c].alias(c) for c in docs.columns])


def op4_repeats(spark, sf_dir):
    """By the contract's window; passages of over 50 words are often shorter than that, and are cut out beside it."""
    return without_repeats(table(spark, sf_dir, "documents"), ["doc_id"], passage=PASSAGE)
