"""Exact similarity join of documents on their sets of five-word shingles, by several global orders.

Two sets link when their Jaccard similarity is 0.8 or more. Then each shares at least ceil(0.8 n) of
its n shingles with the other, so under any order of all shingles that both follow, their first
n // 5 + 1 shingles have one in common; and with t more shingles in these prefixes, t more.

1. Equal sets collapse to one row, so copies cost nothing further.
2. First filter: shingles in the order of their hash, prefixes with a tenth of the set more. A set
   stays if enough of its prefix occurs in other sets' prefixes. Only prefixes are shuffled, and
   most texts end here.
3. For the sets that stay, shingles are counted. All further orders put rarer shingles first (by
   powers of two of the count) and differ inside a class of the same rarity. A shingle that no
   other set holds comes first in each order and leaves the prefix that much shorter; many sets
   have no prefix left and end here.
4. Linked sets share a prefix shingle under every order, so they lie in the same component of each
   order's graph of sets and prefix shingles. The components of one order are refined by the next;
   what is left are blocks.
5. In a block a set's candidates are the sets that share prefix shingles with it under the first
   order and under the second and under the third, as bit masks that are joined by AND. Candidates
   that are known to be in one component already are passed over; the others are verified by
   intersecting the whole sets.
6. A block beyond ``BLOCK_SETS`` sets or ``BLOCK_SHINGLES`` shingles is cut into cells. A few of its
   sets are compared with all others first; sets of the largest component that this gives need
   not be compared with each other any more, so only the rest meets all sets, cell by cell. A
   group of near copies, however large, takes work in proportion to its size.

Shingles are 64-bit XXH64 hashes, sets are named by the XXH3 of their hashes; two different
shingles of a pair of documents, or two sets of the corpus, would have to agree by chance to give
a wrong link.

Defined cases: a null or blank text has an empty set, is linked with nothing and keeps its own id;
fewer than five words are one shingle; a null doc_id never becomes a component's id unless all its
ids are null; repeated rows stay repeated; ties do not matter, as links are exact; an empty table
gives an empty result; very long texts are hashed in chunks and hold memory in proportion to their
shingles; other input columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialise, small, table, text_key, text_or_empty, without
from .graph import components

SHINGLE = 5
#: Multipliers that give each order its own order inside a class of equally rare shingles.
ORDERS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
BLOCK_SETS = 2048
BLOCK_SHINGLES = 1 << 21
#: Sets that are compared first with all others of a block that is cut.
LEADERS = 64
CHUNK = 1 << 16


# sets -----------------------------------------------------------------------------------------
def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes (uint64) of a whole text's shingles."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    flat = b" ".join(words)
    if len(words) < SHINGLE:
        return np.array([xxh64_intdigest(flat)], np.uint64)
    n = len(words) - SHINGLE + 1
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts, stops = np.concatenate(([0], ends[: n - 1])).tolist(), (ends[SHINGLE - 1 :] - 1).tolist()
    view = memoryview(flat)
    parts = [np.fromiter((xxh64_intdigest(view[s:e]) for s, e in zip(starts[at : at + CHUNK], stops[at : at + CHUNK])), np.uint64) for at in range(0, n, CHUNK)]
    return np.unique(np.concatenate(parts))


def extra(n: int) -> int:
    """How many common shingles the first filter asks for, by the size of the smaller set: a tenth."""
    return -(-n // 10)


def needed(n: int) -> int:
    """Common shingles in the first filter's prefixes that a set of n must have with any set it links to."""
    return extra(-(-4 * n // 5))


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size, name and first prefix of each text's set; the prefix in 48 bits, which is enough for a filter."""
    from xxhash import xxh3_64_intdigest

    for b in batches:
        n, names, heads = [], [], []
        for x in b.column("text"):
            s = shingles(x.as_py())
            n.append(len(s))
            names.append(xxh3_64_intdigest(s.tobytes()) if len(s) else 0)
            heads.append(s[: len(s) // 5 + extra(len(s))] >> np.uint64(16))
        n = np.array(n, np.int64)
        offsets = np.cumsum([0, *map(len, heads)]).astype(np.int32)
        flat = np.concatenate(heads).view(np.int64) if heads else np.zeros(0, np.int64)
        cols = {c: b.column(c) for c in b.schema.names if c != "text"}
        cols |= {"n": pa.array(n), "name": pa.array(np.array(names, np.uint64).view(np.int64), mask=n == 0), "head": pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))}
        yield pa.RecordBatch.from_pydict(cols)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, shingle) of whole texts."""
    for b in batches:
        for row, x in zip(b.column("row").to_pylist(), b.column("text")):
            s = shingles(x.as_py()).view(np.int64)
            yield pa.RecordBatch.from_pydict({"row": pa.array(np.full(len(s), row, np.int64)), "shingle": pa.array(s)})


def marked(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, key (of the text), n, name, head and a number for each row, written."""
    src = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), text_key(f"`{text}`").alias("key"), text_or_empty(f"`{text}`").alias("text"))
    schema = T.StructType([src.schema["doc_id"], src.schema["key"], T.StructField("n", T.LongType()), T.StructField("name", T.LongType()), T.StructField("head", T.ArrayType(T.LongType()))])
    return materialise(src.mapInArrow(_marks, schema).withColumn("row", F.monotonically_increasing_id()), "sets")


def plausible(marks: DataFrame, named: DataFrame) -> DataFrame:
    """The first filter: row, doc_id, key and n of the distinct sets that may link to another."""
    copies = marks.where("name is not null").join(named.where("many > 1"), "name").where(F.col("row") != F.col("first")).select("row")
    single = without(marks.where("n > 1"), copies, {"row": F.col("row")})
    # both uses need both columns and no nulls, so the shuffle is done once
    heads = single.select("row", F.explode("head").alias("shingle")).where("row is not null and shingle is not null").repartition("shingle")
    again = heads.groupBy("shingle").agg(F.min("row").alias("a"), F.max("row").alias("b")).where("a <> b").select("shingle")
    hits = heads.join(again, "shingle").groupBy("row").agg(F.count(F.lit(1)).alias("hits"))
    need = F.ceil(F.ceil(4 * F.col("n") / 5) / 10)  # needed(n)
    return marks.select("row", "doc_id", "key", "n").join(hits, "row").where(F.col("hits") >= need).drop("hits")


def rare_first(docs: DataFrame, active: DataFrame, doc_id: str, text: str) -> DataFrame:
    """row, n and shingles (class of rarity, hash) that another active set holds too."""
    src = docs.select(F.col(f"`{doc_id}`").alias("own"), text_key(f"`{text}`").alias("own_key"), text_or_empty(f"`{text}`").alias("text"))
    found = src.join(small(active), F.col("own").eqNullSafe(F.col("doc_id")) & (F.col("own_key") == F.col("key"))).select("row", "text")
    rows = found.mapInArrow(_members, "row long, shingle long").where("row is not null and shingle is not null").repartition("shingle")
    # a row that the input repeats is counted twice; any count makes an order, and a <> b tells sets apart
    counts = rows.groupBy("shingle").agg(F.min("row").alias("a"), F.max("row").alias("b"), F.count(F.lit(1)).alias("df"))
    rarity = counts.where("a <> b").select("shingle", F.length(F.bin("df")).alias("rarity"))
    sets = rows.join(rarity, "shingle").groupBy("row").agg(F.collect_set(F.struct("rarity", "shingle")).alias("shared"))
    return sets.join(active.select("row", "n"), "row").where(F.size("shared") >= F.col("n") - F.floor(F.col("n") / 5))


# orders ---------------------------------------------------------------------------------------
def prefixes(n: int, rarity: np.ndarray, shared: np.ndarray) -> list[np.ndarray]:
    """The prefix under each order of a set of ``n`` shingles, of which ``shared`` are not its own alone."""
    left = n // 5 + 1 - (n - len(shared))
    if left <= 0:
        return [shared[:0]] * len(ORDERS)
    out = []
    for c in ORDERS:
        key = shared * np.uint64(c)
        out.append(shared[np.lexsort((key ^ (key >> np.uint64(31)), rarity))[:left]])
    return out


def _unpacked(b: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """row, n, rarity and hashes (sorted by hash) of each set."""
    shared = b.column("shared")
    ends = shared.offsets.to_numpy()
    flat = shared.flatten()
    rarity, hashes = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("rarity", "shingle"))
    ends = ends - ends[0]
    for i, (row, n) in enumerate(zip(b.column("row").to_pylist(), b.column("n").to_pylist())):
        r, s = rarity[ends[i] : ends[i + 1]], hashes[ends[i] : ends[i + 1]].view(np.uint64)
        order = np.argsort(s)
        yield row, n, r[order], s[order]


def _prefix_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for row, n, rarity, shared in _unpacked(b):
            found = prefixes(n, rarity, shared)
            ways = np.repeat(np.arange(len(found)), [len(p) for p in found])
            yield pa.RecordBatch.from_pydict({"row": pa.array(np.full(len(ways), row, np.int64)), "way": pa.array(ways), "shingle": pa.array(np.concatenate(found).view(np.int64))})


def blocks_of(sets: DataFrame) -> DataFrame:
    """row and block of the sets that share a block with another: components of the first order's prefixes, refined by each further order."""
    rows = materialise(sets.mapInArrow(_prefix_rows, "row long, way long, shingle long"), "prefixes")
    blocks = None
    for way in range(len(ORDERS)):
        mine = rows.where(F.col("way") == way).select("row", "shingle")
        mine = mine.withColumn("block", F.lit(0)) if blocks is None else mine.join(blocks, "row")
        least = mine.groupBy("block", "shingle").agg(F.min("row").alias("least"))
        links = mine.join(least, ["block", "shingle"]).where(F.col("row") != F.col("least")).select(F.col("row").alias("a"), F.col("least").alias("b"))
        joined = materialise(components(links).select(F.col("node").alias("row"), F.col("root").alias("block")), "blocks")
        if blocks is not None:
            discard(blocks)
        blocks = joined
    discard(rows)
    return blocks


# inside a block -------------------------------------------------------------------------------
def linked(n: int, s: np.ndarray, m: int, t: np.ndarray) -> bool:
    """Whether two sets (sizes, and sorted hashes that hold all they share) have a similarity of 0.8 or more."""
    if 5 * min(n, m) < 4 * max(n, m):
        return False
    both = np.sort(np.concatenate((s, t)), kind="stable")  # two sorted runs
    return 9 * int((both[1:] == both[:-1]).sum()) >= 4 * (n + m)


def forest(leaders: Sequence[tuple], others: Sequence[tuple]) -> list[tuple[int, int]]:
    """Links (row, row) that span all links among ``leaders`` and between them and ``others``; members are (row, n, rarity, hashes)."""
    masks: list[dict[int, int]] = [{} for _ in ORDERS]
    parent: dict[int, int] = {}
    known: dict[int, int] = {}  # by root: mask of its leaders

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for i, (row, n, rarity, hashes) in enumerate([*leaders, *others]):
        if row in parent:  # a leader among the others
            continue
        heads = [p.tolist() for p in prefixes(n, rarity, hashes)]
        found = -1
        for mask, head in zip(masks, heads):
            some = 0
            for t in head:
                some |= mask.get(t, 0)
            found &= some
        parent[row], known[row] = row, 0
        while found:
            v = (found & -found).bit_length() - 1
            to, m, _, other = leaders[v]
            if linked(n, hashes, m, other):
                out.append((row, to))
                a, b = root(row), root(to)
                parent[a] = b
                known[b] |= known.pop(a)
                found &= ~known[b]
            else:
                found &= found - 1
        if i < len(leaders):
            known[root(row)] |= 1 << i
            for mask, head in zip(masks, heads):
                for t in head:
                    mask[t] = mask.get(t, 0) | 1 << i
    return out


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells arrive sorted, leaders first; one is held at a time."""
    at, leaders, others = None, [], []

    def flush() -> pa.RecordBatch:
        rows = np.array(forest(leaders, others), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_pydict({"a": pa.array(rows[:, 0]), "b": pa.array(rows[:, 1])})

    for b in batches:
        keys = zip(*(b.column(c).to_pylist() for c in ("block", "cell", "leads")))
        for (block, cell, leads), member in zip(keys, _unpacked(b)):
            if (block, cell) != at:
                if leaders:
                    yield flush()
                at, leaders, others = (block, cell), [], []
            (leaders if leads else others).append(member)
    if leaders:
        yield flush()


def _cell_links(cells: DataFrame) -> DataFrame:
    parts = cells.repartition("block", "cell").sortWithinPartitions("block", "cell", F.col("leads").desc())
    return parts.select("block", "cell", "leads", "row", "n", "shared").mapInArrow(_forests, "a long, b long")


def _number(seed: int) -> Column:
    return F.xxhash64("row", F.lit(seed))


def _cut_links(sets: DataFrame, block_sets: int, block_shingles: int, leaders: int) -> DataFrame:
    """Links that span those inside each block of ``sets``, of any size."""
    size = sets.groupBy("block").agg(F.count(F.lit(1)).alias("c"), F.sum(F.size("shared")).alias("s"))
    size = size.select("block", F.greatest(F.ceil(2 * F.col("c") / block_sets), F.ceil(2 * F.col("s") / block_shingles)).alias("parts"))
    links = None
    for step in range(3):
        if links is None:
            rest = sets
        else:  # all but the largest component of each block
            roots = sets.select("block", "row").join(components(links), F.col("row") == F.col("node"), "left").select("block", "row", F.coalesce("root", "row").alias("root"))
            roots = materialise(roots, "block-roots")
            top = roots.groupBy("block", "root").count().groupBy("block").agg(F.max_by("root", F.struct("count", "root")).alias("root"))
            rest = sets.join(roots.join(top, ["block", "root"], "left_anti").select("row"), "row", "left_semi")
        many = rest.groupBy("block").agg(F.count(F.lit(1)).alias("open"), F.sum(F.size("shared")).alias("open_s"))
        lead = rest.join(many, "block").join(size, "block")
        if step < 2:
            lead = lead.where(F.pmod(_number(step), "open") < leaders).withColumn("groups", F.lit(1))
        else:
            lead = lead.withColumn("groups", F.greatest(F.ceil(2 * F.col("open") / block_sets), F.ceil(2 * F.col("open_s") / block_shingles)))
        lead = lead.withColumn("group", F.pmod(_number(3), "groups"))
        used = lead.select("block", "group").distinct()
        as_leader = lead.select("block", F.explode(F.sequence(F.col("group") * F.col("parts"), (F.col("group") + 1) * F.col("parts") - 1)).alias("cell"), F.lit(True).alias("leads"), "row", "n", "shared")
        as_other = sets.join(size, "block").join(used, "block").select("block", (F.pmod(_number(4), "parts") + F.col("group") * F.col("parts")).alias("cell"), F.lit(False).alias("leads"), "row", "n", "shared")
        found = _cell_links(as_leader.unionByName(as_other))
        links = materialise(found if links is None else found.unionByName(links), "cut-links")
    return links


def set_links(sets: DataFrame, block_sets: int = BLOCK_SETS, block_shingles: int = BLOCK_SHINGLES, leaders: int = LEADERS) -> DataFrame:
    """Links (a, b) between rows of ``sets`` (``rare_first``) that span all pairs with a similarity of 0.8 or more."""
    placed = materialise(sets.join(blocks_of(sets), "row"), "placed")
    size = placed.groupBy("block").agg(F.count(F.lit(1)).alias("c"), F.sum(F.size("shared")).alias("s"))
    big = materialise(size.where((F.col("c") > block_sets) | (F.col("s") > block_shingles)).select("block"), "big-blocks")
    links = _cell_links(without(placed, big, {"block": F.col("block")}).withColumn("cell", F.lit(0)).withColumn("leads", F.lit(True)))
    if big.isEmpty():
        return links
    return links.unionByName(_cut_links(materialise(placed.join(big, "block"), "big"), block_sets, block_shingles, leaders))


def set_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **limits: int) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links, its own included) of each document."""
    marks = marked(docs, doc_id, text)
    named = marks.where("name is not null").groupBy("name").agg(F.min("row").alias("first"), F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("many"))
    named = materialise(named, "named-sets")
    active = materialise(plausible(marks, named), "plausible")
    sets = materialise(rare_first(docs, active, doc_id, text), "rare-first")
    roots = components(set_links(sets, **limits))
    joined = named.join(roots, F.col("first") == F.col("node"), "left").where("many > 1 or root is not null")
    joined = materialise(joined.select("name", "least_id", F.coalesce("root", "first").alias("root")), "joined-sets")
    least = joined.groupBy("root").agg(F.min("least_id").alias("component_id"))
    found = joined.join(least, "root").select("name", F.lit(True).alias("found"), "component_id")
    out = marks.join(found, "name", "left")
    return out.select(F.col("doc_id").alias(doc_id), F.col("n").alias("n_shingles"), F.when(F.col("found"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op12_jaccard(spark, sf_dir):
    return set_components(table(spark, sf_dir, "documents"))
