"""Best-fit packing of token pieces by exact complements.

Whole texts become ids once; a piece is a row of numbers from then on. The plan needs only how
many pieces there are of each length (2,048 counts at most, whatever the corpus): the longest
open length is taken, gaps are filled exactly by a single, pair or triple of lengths under the
counts left, else by the best-fitting length, and each such pattern is used as often as counts
allow. Pieces are then numbered within their length on the cluster and looked up in the plan.

Defined cases: a null text is empty and packs as its end id alone; repeated rows are packed each;
an empty table gives an empty result; other input columns are not read.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, table

CAPACITY = 2048
END_ID = 0
#: Rows that one numbering task sorts at most, about.
SLICE_ROWS = 200_000


# token ids ------------------------------------------------------------------------------------
#: Fixed value: how the byte-level scheme of public vocabularies cuts a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _letters() -> dict[str, int]:
    """Bytes by the letters that stand for them in a byte-level vocabulary: printable Latin-1 as it is, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of whole texts as little-endian uint32 bytes, as the tokenizers library gives them for its file.

    A plain byte-level BPE file whose merges stand in id order is handed to tiktoken as ranks: the
    same ids in a quarter of the time. Any other file, and a text that tiktoken's pattern cannot take
    (white space without end), goes through tokenizers itself.
    """

    def __init__(self, path: str):
        self.path, self.slow, self.fast = path, None, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, cut = spec["model"], spec.get("pre_tokenizer") or {}
        plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        plain = plain and cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex") and not spec.get("normalizer")
        if plain:
            vocab, letters = model["vocab"], _letters()
            made = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
            if all(len(t) == 1 or c == t for t, c in zip(sorted(vocab, key=vocab.get), [""] * 256 + made)) and len(vocab) == 256 + len(made):
                import tiktoken

                ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items()}
                self.fast = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> bytes:
        if self.fast is not None:
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
            except ValueError:
                pass
        if self.slow is None:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
            self.slow.encode_special_tokens = True  # their strings in a text are ordinary text
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    """One for all tasks of a Python worker."""
    return Encoder(path)


def pieces_of(ids: bytes, capacity: int = CAPACITY) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a document's id bytes; only documents over the capacity are cut."""
    n = len(ids) // 4
    first = n % capacity or capacity
    at = [0, *range(first, n, capacity), n] if n > capacity else [0, n]
    return [(k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(at, at[1:]))]


def token_pieces(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """A row a piece: doc_id, piece, start, length, ids_crc32."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = _encoder(path), np.array([END_ID], "<u4").tobytes()
        for b in batches:
            rows, own = [], []
            for i, x in enumerate(b.column("text")):
                got = pieces_of(enc.ids(x.as_py() or "") + end, capacity)
                rows += got
                own += [i] * len(got)
            k, a, n, c = (np.array(v, np.int64) for v in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 4
            yield pa.RecordBatch.from_pydict({doc_id: b.column(doc_id).take(pa.array(own, pa.int64())), "piece": pa.array(k.astype(np.int32)), "start": pa.array(a), "length": pa.array(n), "ids_crc32": pa.array(c)})

    src = docs.select(doc_id, F.col(text).cast("string").alias("text"))
    schema = T.StructType([src.schema[doc_id], T.StructField("piece", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32"))])
    return src.mapInArrow(cut, schema)


# the plan -------------------------------------------------------------------------------------
def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """(lengths of one sequence, how many such sequences) that use all counts."""
    left = np.zeros(capacity + 1, np.int64)
    for n, k in counts.items():
        left[n] = k
    out = []
    while left.any():
        pattern = [int(np.flatnonzero(left)[-1])]
        left[pattern[0]] -= 1
        gap = capacity - pattern[0]
        while gap and (fill := exact_fill(left, gap) or best_fit(left, gap)):
            for n in fill:
                left[n] -= 1
            pattern += fill
            gap -= sum(fill)
        kinds, need = np.unique(pattern, return_counts=True)
        more = int((left[kinds] // need).min())
        left[kinds] -= more * need
        out.append((pattern, more + 1))
    return out


def exact_fill(left: np.ndarray, gap: int) -> list[int]:
    """A single, pair or triple of open lengths that sums to ``gap``, the longest first."""
    if left[gap]:
        return [gap]
    if pair := _pair(left, gap):
        return pair
    for a in np.flatnonzero(left[:gap])[::-1].tolist():
        if 3 * a < gap:
            break
        left[a] -= 1
        pair = _pair(left, gap - a)
        left[a] += 1
        if pair:
            return [a, *pair]
    return []


def _pair(left: np.ndarray, total: int) -> list[int]:
    a = np.arange((total + 1) // 2, total)
    ok = (left[a] > 0) & (left[total - a] > (a == total - a))
    return [int(a[k := int(ok.argmax())]), int(total - a[k])] if ok.any() else []


def best_fit(left: np.ndarray, gap: int) -> list[int]:
    open_ = np.flatnonzero(left[: gap + 1])
    return [int(open_[-1])] if len(open_) else []


def slots(patterns: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, ranks, per sequence, first sequence, offset): where the pieces of a length go, by rank.

    The ranks of one row go ``per`` at a time into successive sequences, side by side from ``offset``.
    """
    out, rank, base = [], {}, 0
    for pattern, times in patterns:
        at = 0
        for n, per in sorted({n: pattern.count(n) for n in pattern}.items(), reverse=True):
            first = rank.get(n, 0)
            out.append((n, first, times * per, per, base, at))
            rank[n] = first + times * per
            at += n * per
        base += times
    return out


def numbered(df: DataFrame, key: str, order: list[str], out: str, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``out``: gapless numbers from 0 within ``key``, hot keys included.

    A key's rows are dealt over slices by the hash of their order columns; a slice is numbered on
    its own and starts after the slices before it. Slices grow in number with the rows.
    """
    spread = max(64, -(-df.count() // slice_rows))
    df = df.withColumn("__s", F.pmod(F.xxhash64(*order), F.lit(spread)))
    sizes = df.groupBy(key, "__s").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(key).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(key, "__s", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    own = Window.partitionBy(key, "__s").orderBy(*order)
    ranked = df.withColumn("__r", F.row_number().over(own) - 1)
    return ranked.join(starts, [key, "__s"]).withColumn(out, (F.col("__first") + F.col("__r")).cast("long")).drop("__s", "__first", "__r")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (doc_id, piece, start, length, ids_crc32) with sequence_id and offset."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # capacity rows at most
    where = slots(plan(counts, capacity))
    lookup = spark.createDataFrame(where or [(0, 0, 0, 1, 0, 0)], "length long, first long, ranks long, per long, base long, at long")
    ranked = numbered(pieces, "length", ["doc_id", "piece", "ids_crc32"], "rank")
    # the plan has as many rows as patterns have lengths: bounded by the capacity, not by the corpus
    by_length = lookup.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("first", "ranks", "per", "base", "at"))).alias("ways"))
    hit = F.element_at(F.filter("ways", lambda w: (F.col("rank") >= w["first"]) & (F.col("rank") < w["first"] + w["ranks"])), 1)
    found = ranked.join(F.broadcast(by_length), "length").withColumn("w", hit)
    k = F.col("rank") - F.col("w.first")
    out = found.withColumn("sequence_id", F.col("w.base") + F.floor(k / F.col("w.per")).cast("long"))
    return out.withColumn("offset", F.col("w.at") + F.pmod(k, F.col("w.per")) * F.col("length")).drop("ways", "w", "rank")


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with their place; ``path`` is the tokenizer's file."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    pieces = materialise(token_pieces(docs, path, capacity=capacity), "pieces")
    return pack(pieces, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_packing(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"))
