"""Alignment of two tokenizers' tokens over the same bytes, and corpus-wide counts of linked ids.

A is a byte-level BPE file of the tokenizers library, read over a space and the text; B is a
sentencepiece file, read over the text (it adds the space itself). In each text:

1. An A token and a B token whose byte ranges overlap are linked: between two neighbouring token
   ends, of either side, lies exactly one such pair.
2. Union-find over this bipartite graph: links hook the later root under the earlier one and paths
   are compressed, for all tokens of the text at once. The components are exactly the smallest
   groups of tokens that span the same bytes.
3. Members of a component, in order, spell its group; its links give pairs of ids.

Pairs are summed within each text, then within blocks of a task, then by a grouping over the
corpus. Scores of a text need the corpus-wide count of each pair it holds: the commonest pairs
(``HOT_PAIRS`` at most, a bound that does not grow with the corpus) are looked up in place, the
others go through a join, so neither a common pair nor the number of rare ones meets in one task.

Defined cases: null and empty texts, and texts whose tokens do not spell a space and the text on
either side, have no tokens; the strings of special tokens are ordinary text; ties for the highest
count all count; repeated rows are counted each; an empty table gives an empty result; very long
texts take memory in proportion to their length; a column of the input that has the name of an
output column is replaced by it, other columns are not read unless they are named in ``keep``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialise, table
from .packing import Encoder, _letters

#: Pairs whose counts each task holds: 16 bytes each.
HOT_PAIRS = 1 << 19
#: Entries that a task gathers before it hands on their sums (or finished rows).
BLOCK = 1 << 20


# two tokenizers -------------------------------------------------------------------------------
def byte_level_pieces(path: str) -> list[bytes]:
    """Bytes of each id of a byte-level BPE file of the tokenizers library."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters = _letters()
    out = {i: bytes(letters[c] for c in entry) if all(c in letters for c in entry) else entry.encode() for entry, i in spec["model"]["vocab"].items()}
    out |= {t["id"]: t["content"].encode() for t in spec.get("added_tokens", [])}
    return [out.get(i, b"") for i in range(max(out) + 1)]


def sentencepiece_pieces(sp) -> list[bytes]:
    """Bytes of each id of a sentencepiece model: the mark of a space is a space, a byte piece its byte."""
    return [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(sp.id_to_piece, range(sp.vocab_size())))]


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        from sentencepiece import SentencePieceProcessor

        self.a, self.b = Encoder(path_a), SentencePieceProcessor(model_file=path_b)
        self.bytes_a, self.bytes_b = byte_level_pieces(path_a), sentencepiece_pieces(self.b)
        self.size_a, self.size_b = (np.fromiter(map(len, p), np.int64, len(p)) for p in (self.bytes_a, self.bytes_b))
        # each id with what follows it in a spelled group
        self.spelled = [f"{i}{end}" for n, ends in ((len(self.bytes_a), ",|"), (len(self.bytes_b), ",;")) for i in range(n) for end in ends]

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """A and B ids, or None where they do not spell a space and the text."""
        if not text:
            return None
        whole = " " + text
        data = whole.encode("utf-8", "surrogatepass")
        ids_a = np.frombuffer(self.a.ids(whole), "<u4").astype(np.int64)
        ids_b = self.b.encode(text)
        if b"".join(map(self.bytes_b.__getitem__, ids_b)) != data or b"".join(map(self.bytes_a.__getitem__, ids_a.tolist())) != data:
            return None
        return ids_a, np.array(ids_b, np.int64)

    def spell(self, ids_a: np.ndarray, ids_b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray) -> str:
        """``a1,a2|b1;a3|b2,b3``: the groups in order, A ids and B ids of each."""
        codes = np.empty(len(ids_a) + len(ids_b), np.int64)
        last_a, last_b = (np.append(g[1:] != g[:-1], True) for g in (group_a, group_b))
        codes[np.arange(len(ids_a)) + np.searchsorted(group_b, group_a, "left")] = 2 * ids_a + last_a
        codes[np.arange(len(ids_b)) + np.searchsorted(group_a, group_b, "right")] = 2 * (len(self.bytes_a) + ids_b) + last_b
        return "".join(map(self.spelled.__getitem__, codes.tolist()))[:-1]


@lru_cache(maxsize=1)
def _aligner(path_a: str, path_b: str) -> Aligner:
    """One for all tasks of a Python worker."""
    return Aligner(path_a, path_b)


# links and groups -----------------------------------------------------------------------------
def links_of(size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (A, B) of all pairs of tokens whose byte ranges overlap, in order; both sides span the same bytes."""
    ends_a, ends_b = np.cumsum(size_a), np.cumsum(size_b)
    ends = np.sort(np.concatenate((ends_a, ends_b)), kind="stable")  # two sorted runs
    starts = np.concatenate(([0], ends[:-1][ends[1:] != ends[:-1]]))
    return np.searchsorted(ends_a, starts, "right"), np.searchsorted(ends_b, starts, "right")


def united(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Union-find over nodes 0 to n - 1: each node's root, the smallest node of its component."""
    parent = np.arange(n)
    while True:
        a, b = parent[u], parent[v]
        if np.array_equal(a, b):
            return parent
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(shorter := parent[parent], parent):
            parent = shorter


def groups_of(n_a: int, n_b: int, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Group numbers, from 0 in order, of the A and of the B tokens, and how many groups there are."""
    roots = united(n_a + n_b, u, n_a + v)
    distinct, group = np.unique(roots, return_inverse=True)
    return group[:n_a], group[n_a:], len(distinct)


# Spark ----------------------------------------------------------------------------------------
OUTPUT = ["n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"]
_LONGS = T.ArrayType(T.LongType())


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)))


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns, n_a, n_b, n_groups, n_links, groups (as ``Aligner.spell`` writes them), and the distinct ``pairs`` of linked ids (A id * 2**32 + B id) with their ``times`` in the text."""
    import public_tokenizers

    path_a = path_a or public_tokenizers.path("byte_bpe_50k.json")
    path_b = path_b or public_tokenizers.path("piece_bpe_32k.model")
    none = np.zeros(0, np.int64)

    def one(al: Aligner, x: str) -> tuple:
        if (got := al.tokens(x)) is None:
            return 0, 0, 0, 0, "", none, none
        ids_a, ids_b = got
        u, v = links_of(al.size_a[ids_a], al.size_b[ids_b])
        group_a, group_b, many = groups_of(len(ids_a), len(ids_b), u, v)
        pairs, times = np.unique((ids_a[u] << 32) | ids_b[v], return_counts=True)
        return len(ids_a), len(ids_b), many, len(u), al.spell(ids_a, ids_b, group_a, group_b), pairs, times

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al = _aligner(path_a, path_b)

        def made(doc: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
            *counts, groups, pairs, times = zip(*rows)
            return pa.RecordBatch.from_arrays([doc, *(pa.array(c, pa.int64()) for c in counts), pa.array(groups, pa.string()), _lists(pairs), _lists(times)], ["doc", *OUTPUT])

        for b in batches:
            rows, at, held = [], 0, 0
            for i, x in enumerate(b.column("text")):
                rows.append(one(al, x.as_py()))
                held += rows[-1][3] + 1
                if held >= BLOCK or i + 1 == b.num_rows:
                    yield made(b.column("doc").slice(at, len(rows)), rows)
                    rows, at, held = [], i + 1, 0

    own = [F.col(f"`{c}`") for c in keep if c not in OUTPUT] or [F.lit(0).alias("__none")]
    src = docs.select(F.struct(*own).alias("doc"), F.col(f"`{text}`").cast("string").alias("text"))
    longs = [T.StructField(c, T.LongType()) for c in OUTPUT[:4]]
    schema = T.StructType([src.schema["doc"], *longs, T.StructField("groups", T.StringType()), T.StructField("pairs", _LONGS), T.StructField("times", _LONGS)])
    return src.mapInArrow(run, schema).select("doc.*", *OUTPUT).drop("__none")


def _flat(col: pa.ListArray) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums by pair over blocks of a task's rows."""
    held, many = [], 0

    def block() -> pa.RecordBatch:
        pairs, times = (np.concatenate(c) for c in zip(*held))
        distinct, inverse = np.unique(pairs, return_inverse=True)
        sums = np.zeros(len(distinct), np.int64)
        np.add.at(sums, inverse, times)
        return pa.RecordBatch.from_pydict({"pair": pa.array(distinct), "n": pa.array(sums)})

    for b in batches:
        held.append((_flat(b.column("pairs")), _flat(b.column("times"))))
        many += len(held[-1][0])
        if many >= BLOCK:
            yield block()
            held, many = [], 0
    if many:
        yield block()


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, its number of links in the corpus n, and best: no other pair of its B id has more."""
    counts = aligned.select("pairs", "times").mapInArrow(_summed, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = materialise(counts.withColumn("b", F.col("pair").bitwiseAND(0xFFFFFFFF)), "pair-counts")
    # a row an id of B's vocabulary: its size is the bound of what is broadcast
    top = counts.groupBy("b").agg(F.max("n").alias("top"))
    out = counts.join(F.broadcast(top), "b").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))
    out.stored_at = counts.stored_at
    return out


def hot_threshold(counts: DataFrame, hot_pairs: int = HOT_PAIRS) -> int:
    """The smallest power of two such that at most ``hot_pairs`` pairs have as many links or more."""
    sizes = dict(counts.groupBy((F.length(F.bin("n")) - 1).alias("k")).count().collect())  # a row a power of two
    k, held = max(sizes, default=0) + 1, 0
    while k and held + sizes.get(k - 1, 0) <= hot_pairs:
        k -= 1
        held += sizes.get(k, 0)
    return 1 << k


def link_scores(aligned: DataFrame, counts: DataFrame, row_id: str, keep: list[str], hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """``row_id`` (unique), ``keep``, n_best (links whose count is their B id's highest) and count_sum (counts over all links)."""
    least = hot_threshold(counts, hot_pairs)
    hot = counts.where(F.col("n") >= least).orderBy("pair").toPandas()  # hot_pairs rows at most
    known = aligned.sparkSession.sparkContext.broadcast((hot["pair"].to_numpy(np.int64), hot["n"].to_numpy(np.int64), hot["best"].to_numpy(bool)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = known.value
        for b in batches:
            offsets = b.column("pairs").offsets.to_numpy()
            offsets = offsets - offsets[0]
            pairs, times = _flat(b.column("pairs")), _flat(b.column("times"))
            at = np.searchsorted(pair, pairs)
            hit = at < len(pair)
            hit[hit] = pair[at[hit]] == pairs[hit]
            mine, of = at[hit], times[hit]
            good, total = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
            good[hit], total[hit] = of * best[mine], of * n[mine]
            sums = [np.diff(np.concatenate(([0], np.cumsum(c)))[offsets]) for c in (good, total)]
            left = np.concatenate(([0], np.cumsum(~hit)))[offsets].astype(np.int32)
            rare = [pa.ListArray.from_arrays(pa.array(left), pa.array(c[~hit])) for c in (pairs, times)]
            yield pa.RecordBatch.from_arrays([b.column("doc"), *(pa.array(c) for c in sums), *rare], ["doc", "n_best", "count_sum", "rare", "times"])

    src = aligned.select(F.struct(*dict.fromkeys([row_id, *keep])).alias("doc"), "pairs", "times")
    schema = T.StructType([src.schema["doc"], T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType()), T.StructField("rare", _LONGS), T.StructField("times", _LONGS)])
    scored = materialise(src.mapInArrow(run, schema), "scored")
    rare = scored.where(F.size("rare") > 0).select(F.col(f"doc.{row_id}").alias("__row"), F.explode(F.arrays_zip("rare", "times")).alias("r"))
    rare = rare.select("__row", F.col("r.rare").alias("pair"), F.col("r.times").alias("times")).join(counts.where(F.col("n") < least), "pair")
    more = rare.groupBy("__row").agg(F.sum(F.col("times") * F.col("n")).alias("__sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("__best"))
    out = scored.join(more, scored[f"doc.{row_id}"] == more["__row"], "left")
    return out.select("doc.*", (F.col("n_best") + F.coalesce("__best", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("__sum", F.lit(0))).alias("count_sum"))


def alignment_digests(docs: DataFrame, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """The contract's columns over ``docs`` (doc_id, text)."""
    spelled = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("")
    found = align(docs).select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", spelled.alias("groups_sha256"), "pairs", "times")
    found = materialise(found, "aligned")
    counts = pair_counts(found)
    out = link_scores(found, counts, "row", ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"], hot_pairs)
    discard(found)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op11_alignment(spark, sf_dir):
    return alignment_digests(table(spark, sf_dir, "documents"))
