"""Benchmark decontamination: size-partitioned MinHash containment search, on DataFrame functions alone.

An item with m distinct shingles is contained in a document if the document has at least
0.8 m of them. Then it also has one of the item's floor(0.2 m) + 1 shingles of least hash: those
form the item's MinHash sketch, whose size grows with the item (items are partitioned by m). A
document that meets no sketch is done after one look-up a shingle, and no contained item is
missed. Candidates are verified by counting the exact shingles (strings, not hashes) they share.

Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z in lower case; a shingle is five words.
Shorter items count as one shingle of their own width, and documents get shingles of each width
that some item has (five at most).

Defined cases: null and blank items match nothing; null and blank documents contain nothing;
repeated items each give their row; a repeated document gives a row each time; equal texts are
searched once each; empty tables give an empty result; other input columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialise, small, table, text_key, text_or_empty, without, words

WIDTH = 5
CONTAINED = 0.8
#: Sketch rows and item shingles that are broadcast; beyond them the joins shuffle.
INDEX_ROWS = 500_000


def _shingles(ws: Column, width: Column | int) -> Column:
    """Distinct shingles of ``width`` words, joined by one space."""
    width = F.lit(width) if isinstance(width, int) else width
    starts = F.sequence(F.lit(1), F.size(ws) - width + 1)
    made = F.transform(starts, lambda i: F.array_join(F.slice(ws, i, width), " "))
    return F.when(F.size(ws) >= width, F.array_distinct(made)).otherwise(F.array().cast("array<string>"))


def _by_words(ws: Column, width: int) -> Column:
    """As _shingles for one known width, without slices."""
    made = F.transform(ws, lambda x, i: F.concat_ws(" ", x, *[F.get(ws, i + k) for k in range(1, width)]))
    return F.when(F.size(ws) >= width, F.array_distinct(F.slice(made, F.lit(1), F.size(ws) - width + 1))).otherwise(F.array().cast("array<string>"))


def item_shingles(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item (a row number of distinct texts' key), width, m, shingle, sketch: whether it is of the item's MinHash sketch."""
    ws = items.select(text_key(text).alias("item"), words(ascii_lower(text_or_empty(text))).alias("ws")).dropDuplicates(["item"])
    width = F.least(F.size("ws"), F.lit(WIDTH))
    made = ws.where(F.size("ws") > 0).select("item", width.alias("width"), _shingles(F.col("ws"), width).alias("sh"))
    order = F.sort_array(F.transform("sh", lambda s: F.struct(F.xxhash64(s).alias("h"), s.alias("s"))))
    need = F.size("sh") - F.ceil(F.size("sh") * F.lit(CONTAINED)).cast("int") + 1
    made = made.select("item", "width", F.size("sh").alias("m"), F.posexplode(order).alias("rank", "x"), need.alias("need"))
    return made.select("item", "width", "m", F.col("x.h").alias("h"), F.col("x.s").alias("shingle"), (F.col("rank") < F.col("need")).alias("sketch"))


def _document_shingles(docs: DataFrame, widths: list[int]) -> DataFrame:
    """key, shingle for every width in use; ``docs`` has key and text."""
    ws = docs.select("key", words(ascii_lower(F.col("text"))).alias("ws"))
    all_ = [_by_words(F.col("ws"), w) for w in widths]
    return ws.select("key", F.explode(all_[0] if len(all_) == 1 else F.concat(*all_)).alias("shingle"))


def contained_items(docs: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text") -> DataFrame:
    """key (of a text), item (key of an item's text), n_item, n_shared, containment for each contained pair of texts."""
    index = materialise(item_shingles(items, text=item_text), "items")
    widths = sorted(r["width"] for r in index.select("width").distinct().collect())  # five at most
    texts = docs.select(text_key(text).alias("key"), text_or_empty(text).alias("text"))
    if not widths:
        return texts.select("key", F.col("key").alias("item"), F.lit(0).alias("n_item"), F.lit(0).alias("n_shared"), F.lit(0.0).alias("containment")).limit(0)
    sketch = index.where("sketch").select("item", "h").distinct()
    hashed = _document_shingles(texts, widths).select("key", F.xxhash64("shingle").alias("h"))
    candidates = materialise(hashed.join(small(sketch, INDEX_ROWS), "h").select("key", "item").distinct(), "candidates")
    # only texts with a candidate are cut into shingles again
    keys = small(candidates.select("key").distinct())
    again = _document_shingles(texts.join(keys, "key", "left_semi").dropDuplicates(["key"]), widths)
    shared = again.join(small(index.select("item", "m", "shingle"), INDEX_ROWS), "shingle").groupBy("key", "item", "m").agg(F.count(F.lit(1)).alias("n_shared"))
    shared = shared.join(candidates, ["key", "item"], "left_semi").where(F.col("n_shared") >= F.ceil(F.col("m") * F.lit(CONTAINED)))
    return shared.select("key", "item", F.col("m").alias("n_item"), F.col("n_shared").cast("int").alias("n_shared"), (F.col("n_shared") / F.col("m")).alias("containment"))


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, n_item, n_shared, containment: a row for each document and item it contains."""
    found = materialise(contained_items(docs, items), "contained")
    names = found.join(items.select("item_id", text_key().alias("item")), "item").drop("item")
    own = docs.select("doc_id", text_key().alias("key"))
    return own.join(names, "key").select("doc_id", "item_id", "n_item", "n_shared", F.round("containment", 6).alias("containment"))


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The pipeline's stage: documents that contain an item go, the others keep their columns."""
    found = materialise(contained_items(docs, items).select("key").distinct(), "contained")
    return without(docs, found, {"key": text_key()})


def op9_decontamination(spark, sf_dir):
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP9_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
i AS (SELECT row_number() OVER () AS iid, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM benchmark),
iw AS (SELECT *, least(len(ws), 5) AS w FROM i WHERE len(ws) > 0),
ish AS (SELECT DISTINCT iid, item_id, w, array_to_string(list_slice(ws, k, k + w - 1), ' ') AS s
        FROM (SELECT *, unnest(range(1, len(ws) - w + 2)) AS k FROM iw)),
m AS (SELECT iid, item_id, count(*) AS n_item FROM ish GROUP BY iid, item_id),
dsh AS (SELECT DISTINCT rid, doc_id, w, array_to_string(list_slice(ws, k, k + w - 1), ' ') AS s
        FROM (SELECT *, unnest(range(1, greatest(len(ws) - w + 2, 1))) AS k FROM d, (SELECT DISTINCT w FROM iw))),
hit AS (SELECT rid, doc_id, iid, count(*) AS n_shared FROM dsh JOIN ish ON dsh.s = ish.s AND dsh.w = ish.w GROUP BY rid, doc_id, iid)
SELECT doc_id, item_id, CAST(n_item AS INTEGER) AS n_item, CAST(n_shared AS INTEGER) AS n_shared, round(n_shared / n_item, 6) AS containment
FROM hit JOIN m ON hit.iid = m.iid WHERE n_shared >= ceil(n_item * 0.8)
"""
