"""Host-level quality rules on DataFrame functions alone.

Every document gets rule figures from its whole text. Rule failures are summed by host, the
failure rates are shrunk with an empirical beta prior (fitted to all hosts by moments), and a
host whose shrunk rate passes ``max_rate`` for any rule is rejected with all its documents.

Defined cases: a null text counts as empty; an empty text has zero words and fails the base
rule; a document without a host takes no host verdict; repeated rows stay repeated; an empty
table gives an empty result; other columns of the input are carried along untouched unless
they have the name of an output column, which replaces them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, materialise, small, table, text_or_empty, words

#: Rules counted by host; each is a boolean over the figures of one document.
RULES = {
    "short": "n_words < 50",
    "repeats": "100 * n_repeat_words > 50 * n_words",
    "symbols": "n_symbols > 0.5 * n_words",
    "dup_lines": "n_dup_lines > 0.5 * n_lines",
}
FIGURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _repeated(order: Column) -> Column:
    """Start positions whose neighbour in (hash, position) order has the same window."""

    def same(s: Column, i: Column) -> Column:
        before, after = F.get(order, i - 1)["h"], F.get(order, i + 1)["h"]
        return F.coalesce(s["h"] == before, F.lit(False)) | F.coalesce(s["h"] == after, F.lit(False))

    return F.sort_array(F.transform(F.filter(order, same), lambda s: s["i"]))


def _covered(starts: Column) -> Column:
    """Words that windows of three cover, from their sorted start positions."""
    zero = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
    step = lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"))
    return F.aggregate(starts, zero, step, lambda a: a["n"])


def _free(docs: DataFrame) -> str:
    """A beginning that no column of ``docs`` has, for working columns."""
    p = "__"
    while any(c.lower().startswith(p) for c in docs.columns):
        p += "_"
    return p


def rule_figures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the figures and ``base_failed`` added; columns of those names are replaced."""
    own = [F.col(f"`{c}`") for c in docs.columns if c not in {*FIGURES, "n_lines", "base_failed"}]
    p = _free(docs)
    t, w, ls, h, o, at = (f"{p}{c}" for c in "twlhop")
    step = docs.select(*own, text_or_empty(f"`{text}`").alias(t))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACE))) > 0)
    step = step.select(*own, words(F.col(t)).alias(w), F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"), lines.alias(ls))
    window = F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    step = step.select(
        *own,
        "n_symbols",
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.size(ls).cast("long").alias("n_lines"),
        (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
        F.slice(window, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))).alias(h),
    )
    # most texts repeat no window: only the others are sorted
    order = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    step = step.withColumn(o, F.when(F.size(F.array_distinct(h)) < F.size(h), order)).drop(h)
    step = step.withColumn(at, _repeated(F.col(o))).drop(o)
    step = step.withColumn("n_repeat_words", F.coalesce(_covered(F.col(at)), F.lit(0)).cast("long")).drop(at)
    return step.withColumn("base_failed", F.expr(f"{RULES['short']} or {RULES['repeats']}"))


def host_verdicts(figures: DataFrame, host: str = "source") -> DataFrame:
    """One row a host: documents, failures by rule and rates shrunk with the fitted beta prior."""
    sums = [F.sum(F.expr(f"case when {r} then 1 else 0 end")).alias(f"k_{k}") for k, r in RULES.items()]
    hosts = figures.where(F.col(host).isNotNull()).groupBy(host).agg(F.count(F.lit(1)).alias("n_docs"), *sums)
    hosts = materialise(hosts, "hosts")
    # one row of moments, whatever the number of hosts
    moments = hosts.agg(*[f(F.col(f"k_{k}") / F.col("n_docs")).alias(f"{n}_{k}") for k in RULES for n, f in (("m", F.avg), ("v", F.var_pop))]).first()
    for k in RULES:
        m, v = moments[f"m_{k}"], moments[f"v_{k}"]
        weight = 1.0
        if m is not None and 0 < m < 1 and v:
            weight = min(max(m * (1 - m) / v - 1, 1.0), 1e4)
        a = (0.0 if m is None else m) * weight
        hosts = hosts.withColumn(f"rate_{k}", (F.col(f"k_{k}") + F.lit(a)) / (F.col("n_docs") + F.lit(weight)))
    return hosts


def bad_hosts(rates: DataFrame, max_rate: float, host: str, flag: str) -> DataFrame:
    """Hosts with a shrunk rate above ``max_rate`` for any rule, marked by ``flag``."""
    bad = rates.where(F.greatest(*[F.col(f"rate_{k}") for k in RULES]) > max_rate)
    return small(bad.select(host, F.lit(True).alias(flag)))


def quality_rules(docs: DataFrame, text: str = "text", host: str = "source", max_rate: float = 0.7, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``docs`` (all by default) with rule figures, ``base_failed``, ``host_rejected`` and ``kept``.

    Figures are made once and written beside the columns kept; host sums and verdicts read them
    back. Bad hosts are broadcast where they are few, and no text is shuffled to its host then, so a
    host with a third of all rows costs no more than any other.
    """
    p = _free(docs)
    own, flag = f"{p}host", f"{p}bad"
    figures = rule_figures(docs.withColumn(own, F.col(f"`{host}`")), text)
    keep = [c for c in figures.columns if c != own and (keep is None or c in {*keep, *FIGURES, "n_lines", "base_failed"})]
    figures = materialise(figures.select(*[F.col(f"`{c}`") for c in keep if c not in ("host_rejected", "kept")], own), "figures")
    rates = host_verdicts(figures, own)
    out = figures.join(bad_hosts(rates, max_rate, own, flag), own, "left")
    out = out.withColumn("host_rejected", F.coalesce(flag, F.lit(False))).drop(own, flag)
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))


def keep_good(docs: DataFrame, max_rate: float = 0.7) -> DataFrame:
    """The pipeline's stage: rejected documents go, the others keep their columns.

    No text is written on the way: hosts are judged in one pass, documents in a second one.
    """
    tagged = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__whole"), "text", F.col("source").alias("__host"))
    flags = materialise(rule_figures(tagged.drop("__whole")).drop("text"), "figures")
    bad = bad_hosts(host_verdicts(flags, "__host"), max_rate, "__host", "__bad")
    # the row number keeps the filter above the figures; pushed below, it would copy their expressions
    out = rule_figures(tagged).select("__whole", "__host", "base_failed", F.monotonically_increasing_id().alias("__row"))
    out = out.where(~F.col("base_failed") & (F.col("__row") >= 0)).join(bad, "__host", "left")
    return out.where(F.col("__bad").isNull()).select("__whole.*")


def op2_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return quality_rules(docs, keep=["doc_id"]).select("doc_id", *FIGURES, "base_failed", "kept")


OP2_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS win
      FROM (SELECT rid, ws, unnest(range(1, greatest(len(ws) - 1, 1))) AS i FROM w)),
r AS (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, win) > 1),
c AS (SELECT rid, count(DISTINCT i + o) AS n FROM r, (SELECT unnest([0, 1, 2]) AS o) GROUP BY rid),
f AS (SELECT w.rid, doc_id, source, len(ws) AS n_words,
        length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
        length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
      FROM w LEFT JOIN c ON w.rid = c.rid),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
h AS (SELECT source, count(*) AS n_docs,
        sum(CASE WHEN n_words < 50 THEN 1 ELSE 0 END) AS k1,
        sum(CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 1 ELSE 0 END) AS k2,
        sum(CASE WHEN n_symbols > 0.5 * n_words THEN 1 ELSE 0 END) AS k3,
        sum(CASE WHEN n_dup_lines > 0.5 * n_lines THEN 1 ELSE 0 END) AS k4
      FROM b WHERE source IS NOT NULL GROUP BY source),
l AS (SELECT source, n_docs, unnest([k1, k2, k3, k4]) AS k, unnest([1, 2, 3, 4]) AS rule FROM h),
m AS (SELECT rule, avg(k / n_docs) AS m, var_pop(k / n_docs) AS v FROM l GROUP BY rule),
p AS (SELECT rule, m, CASE WHEN m > 0 AND m < 1 AND v > 0 THEN least(greatest(m * (1 - m) / v - 1, 1), 10000) ELSE 1 END AS wt FROM m),
x AS (SELECT source FROM l JOIN p ON l.rule = p.rule GROUP BY source HAVING max((k + m * wt) / (n_docs + wt)) > 0.7)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND x.source IS NULL AS kept
FROM b LEFT JOIN x ON b.source = x.source
"""
