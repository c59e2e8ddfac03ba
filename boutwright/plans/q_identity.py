"""Queries of identity keys, labels, organisations and methods."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import identity as I
from ..functions import names as N
from ..functions import scalars as S
from ..operators import name_matching as M
from .fixtures import run_sql, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(r"""SELECT doc_id, md5(trim(regexp_replace(lower(strip_accents(replace(replace(replace(replace(text, 'ß', 'ss'), 'ø', 'o'), 'ł', 'l'), 'æ', 'ae'))), '[^\p{L}\p{N}_]+', ' ', 'g'))) folded FROM documents""")
def folded_texts(spark, d):
    """Name folding over whole accented texts."""
    return table(spark, d, "documents").select("doc_id", F.md5(N.normalise(F.col("text")).cast("binary")).alias("folded"))


_IDS = "SELECT o_orderkey k, concat(CASE WHEN o_orderkey % 5 = 0 THEN 'http://www.stats.example/fighter-details/' WHEN o_orderkey % 5 = 1 THEN '/fighter-details/' ELSE '' END, upper(substr(md5(CAST(o_orderkey AS VARCHAR(19))), 1, 16)), CASE WHEN o_orderkey % 3 = 0 THEN '/' WHEN o_orderkey % 7 = 1 THEN 'zz' ELSE '' END) link, concat('Ann ', CAST(o_custkey % 40 AS VARCHAR(9))) who, o_custkey % 4 = 0 shared FROM orders"


@query(f"WITH x AS (SELECT *, CASE WHEN k % 3 = 0 OR k % 7 <> 1 THEN substr(md5(CAST(k AS VARCHAR)), 1, 16) END ref FROM ({_IDS}) z) SELECT k, ref, CASE WHEN shared THEN 'id:' || ref ELSE 'name:' || lower(who) END key FROM x")
def identity_keys(spark, d):
    return run_sql(spark, d, _IDS).select("k", I.stable_id(F.col("link")).alias("ref"), I.identity_key(F.col("who"), F.col("link"), F.col("shared")).alias("key"))


_PAIRS = "SELECT o_orderkey k, concat('Zoe ', CAST(o_custkey % 30 AS VARCHAR(9))) a, concat('bob-', CAST(o_orderkey % 20 AS VARCHAR(9))) b, CASE WHEN o_orderkey % 9 > 0 THEN CAST(o_orderdate AS DATE) END dd, CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_custkey AS VARCHAR(19)) WHEN o_orderkey % 4 = 1 THEN 'nan' END ev FROM orders"


@query(f"""WITH x AS (SELECT *, 'bob ' || o || '__' || 'zoe ' || c pk FROM (SELECT *, replace(b, 'bob-', '') o, replace(a, 'Zoe ', '') c FROM ({_PAIRS}) z) y)
SELECT k, CASE WHEN dd IS NULL THEN '' ELSE pk || '__' || strftime(dd, '%Y-%m-%d') END fight, CASE WHEN dd IS NULL THEN '' ELSE pk || '__' || strftime(dd - 1, '%Y-%m-%d') END before, CASE WHEN ev IS NOT NULL AND ev <> 'nan' THEN 'event::' || ev ELSE coalesce(strftime(dd, '%Y-%m-%dT00:00:00'), 'unknown') || '::' || pk END scope,
 sha256('{{"a":"' || a || '","n":' || coalesce(CAST(CASE WHEN k % 2 = 0 THEN k END AS VARCHAR), 'null') || '}}') change_id FROM x""")
def fight_keys(spark, d):
    p = run_sql(spark, d, _PAIRS)
    key = I.fight_key(F.col("a"), F.col("b"), F.col("dd"))
    return p.select("k", key.alias("fight"), I.shifted_key(key, F.lit(-1)).alias("before"), I.event_or_pair_key(F.col("ev"), F.col("dd"), F.col("a"), F.col("b")).alias("scope"), I.change_id({"n": F.when(F.col("k") % 2 == 0, F.col("k")), "a": F.col("a")}).alias("change_id"))


_LABELS = ("Ann Bo wins by TKO/KO", "Ann Bo by submission", "not Ann Bo wins by decision", "Cy Do wins in round 2 or by decision", "Cy Do wins by decision", "Bo by KO stoppage", "Do wins on points", "nobody knows")
_LABEL_SQL = "CASE l_partkey % 8 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_LABELS)) + " END"


@query("""WITH x AS (SELECT l_partkey % 8 i FROM lineitem) SELECT i::INTEGER i, CASE WHEN i = 0 THEN 'ko' WHEN i = 1 THEN 'sub' WHEN i = 4 THEN 'dec' END strict, CASE WHEN i IN (0, 5) THEN 'ko' WHEN i = 1 THEN 'sub' WHEN i IN (2, 3, 4, 6) THEN 'dec' END loose, CASE WHEN i IN (0, 1, 2, 5) THEN 'a' WHEN i IN (3, 4, 6) THEN 'b' END side, count(*) n FROM x GROUP BY 1, 2, 3, 4""")
def price_labels(spark, d):
    x = run_sql(spark, d, f"SELECT CAST(l_partkey % 8 AS INT) i, {_LABEL_SQL} label FROM lineitem")
    c = F.col("label")
    return x.groupBy("i", I.method_label(c, strict=True).alias("strict"), I.method_label(c).alias("loose"), I.named_side(c, F.lit("Ann Bo"), F.lit("Cy Do")).alias("side")).agg(F.count(F.lit(1)).alias("n"))


_METHODS = ("TKO (Punches)", "K.O.", "Submission (Armbar)", "Triangle Choke", "Decision (Split)", "Technical Decision", "NC (Overturned)", "Draw", "DQ (Kicks)", "Retired", "Decision - Majority", "Punches")
_EVENTS = ("RX 12 - Bo vs Cy", "WUFC: Night", "Dana  White’s Contender Series", "Road to UFC 3b", "Pride 30", "WEC 5", "wecky", " Ultimate Fighting  Championship ", "", "One", "Cage Rage 9: End", "UFC 7")
_CASE = lambda v: "CASE o_orderkey % 12 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(v)) + " END"


@query("""WITH x AS (SELECT o_orderkey % 12 i, year(o_orderdate) y FROM orders)
SELECT (['KO/TKO', 'KO/TKO', 'SUB', 'SUB', 'S-DEC', 'U-DEC', 'Overturned', 'Draw', 'DQ', 'Retired', 'M-DEC', 'Punches'])[i + 1] AS "method", (['RX', 'WUFC', 'Dana White’s Contender Series', 'Road to UFC', 'Pride', 'WEC', 'wecky', 'Ultimate Fighting Championship', '', 'One', 'Cage Rage', 'UFC'])[i + 1] org,
 i IN (2, 7) tracked, i IN (4, 5, 10) other, CASE WHEN i = 8 THEN NULL WHEN i IN (9, 11) AND (i = 9 OR y BETWEEN 1995 AND 1996) THEN 1.0 WHEN i = 6 THEN 2.0 ELSE 3.0 END tier, count(*) n FROM x GROUP BY ALL""")
def organisations(spark, d):
    x = run_sql(spark, d, f"SELECT {_CASE(_METHODS)} m, {_CASE(_EVENTS)} e, CAST(o_orderdate AS DATE) dd FROM orders")
    e = F.col("e")
    tier = I.organisation_tier(e, F.col("dd"), ("one",), ("wecky",), {"ufc 7": ("1995-01-01", "1996-12-31", 1.0)})
    return x.groupBy(I.canonical_method(F.col("m")).alias("method"), I.organisation(e).alias("org"), I.is_tracked(e).alias("tracked"), I.is_other_event(e).alias("other"), tier.alias("tier")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH x AS (SELECT o_orderpriority p, o_orderkey % 3 i FROM orders) SELECT CASE WHEN p IN ('1-URGENT', '2-HIGH') THEN 'top' WHEN p LIKE '4-%' THEN 'none' ELSE lower(p) END AS "class", i IN (0, 2) AS a_missed, (CASE WHEN i = 0 THEN 2 WHEN i = 1 THEN 0 ELSE 1 END)::INTEGER a_num, (CASE WHEN i = 1 THEN 1 ELSE 0 END)::INTEGER b_num, count(*) n FROM x GROUP BY 1, 2, 3, 4""")
def classes_and_signals(spark, d):
    x = table(spark, d, "orders").withColumn("i", F.col("o_orderkey") % 3)
    flags = F.when(F.col("i") == 0, F.array(F.lit("Ann missed weight by 2"), F.lit("ANN short notice"))).when(F.col("i") == 1, F.array(F.lit("Bob pulled out"))).otherwise(F.array(F.lit("Ann missed weight")))
    f = I.signal_features(flags, F.lit("Ann"), F.lit("Bob"))
    return x.groupBy(I.class_key(F.col("o_orderpriority"), {"1-urgent": "top", "2 high": "top", "not": "none"}).alias("class"), (f["a_missed_weight"] == 1).alias("a_missed"), f["a_num_flags"].alias("a_num"), f["b_num_flags"].alias("b_num")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH x AS (SELECT l_suppkey % 5 fa, l_partkey % 5 fb, l_orderkey % 4 ta, l_linenumber % 4 tb, 1.1 + l_discount * 20 odds FROM lineitem),
y AS (SELECT *, CASE WHEN fa >= 3 THEN 0 WHEN ta = 1 THEN 0.02 WHEN ta = 2 THEN 0.03 ELSE 0.04 END xa, CASE WHEN fb >= 3 THEN 0 WHEN tb = 1 THEN 0.02 WHEN tb = 2 THEN 0.03 ELSE 0.04 END xb, NOT (fa = 0 AND ta NOT IN (1, 2)) AND NOT (fb = 0 AND tb NOT IN (1, 2)) allowed,
 CASE WHEN (fa < 3 AND NOT (fa = 0 AND ta NOT IN (1, 2))) OR (fb < 3 AND NOT (fb = 0 AND tb NOT IN (1, 2))) THEN 0.5 ELSE 1.0 END size FROM x)
SELECT fa, fb, allowed, size::DOUBLE size, count(*) n, round(sum(CASE WHEN odds <= 2 THEN 0.02 ELSE 0.02 + 0.02 * (odds - 2) END + greatest(xa, xb)), 4) need FROM y GROUP BY 1, 2, 3, 4""")
def newcomer_rule(spark, d):
    x = table(spark, d, "lineitem").select((F.col("l_suppkey") % 5).alias("fa"), (F.col("l_partkey") % 5).alias("fb"), (F.col("l_orderkey") % 4).alias("ta"), (F.col("l_linenumber") % 4).alias("tb"), (1.1 + F.col("l_discount") * 20).alias("odds"))
    x = x.withColumn("r", S.newcomer_rule(F.col("fa"), F.col("fb"), F.col("ta"), F.col("tb")))
    return x.groupBy("fa", "fb", F.col("r.allowed").alias("allowed"), F.col("r.size").alias("size")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(S.required_edge(F.col("odds")) + F.col("r.extra")), 4).alias("need"))


@query()
def fuzzy_names(spark, d):
    """Names of two sources with typing errors, turned tokens and dropped letters; no SQL knows the ratio: tested against all pairs."""
    w = F.split(N.normalise(F.substring("text", 1, 200)), " ")
    left = table(spark, d, "documents").select("doc_id", F.concat_ws(" ", F.slice(w, 1, 3)).alias("name"))
    n, k = F.length("name"), F.col("doc_id") % 7
    edited = (
        F.when(k == 0, F.col("name")).when(k == 1, F.array_join(F.reverse(F.split("name", " ")), " ")).when(k == 2, F.concat(F.substring("name", 1, 4), F.expr("substring(name, 6)")))
        .when(k == 3, F.concat(F.substring("name", 1, 5), F.expr("substring(name, 5)"))).when(k == 4, F.concat(F.expr("left(name, length(name) - 1)"), F.lit("x"))).when(k == 5, F.concat(F.lit("zz"), F.expr("substring(name, 3)"))).otherwise(F.upper("name"))
    )
    right = left.where(n > 0).select(edited.alias("name"))
    return M.matches(left, right)


#: Names with suffixes, nicknames, accents and other spellings, and the canonical form of each.
_SPELLED = {"Mike Jones Jr.": "michael jones", "Bobby Grén III": "king green", "Zack Buzukia 2nd": "zachary buzukja", "  José  Łukasz-Núñez ": "jose lukasz nunez", "O'Brien": "o brien", "Chuck Junior": "charles", "Robert Green": "king green", "Anna V": "anna"}
_TOKENS, _NAMES = {"buzukia": "buzukja"}, {"robert green": "king green", "robert gren": "king green"}
_quoted = lambda t: "'" + t.replace("'", "''") + "'"
_PICK = "CASE o_orderkey % 8 " + " ".join(f"WHEN {i} THEN {_quoted(n)}" for i, n in enumerate(_SPELLED)) + " END"
_PICKED = "CASE o_orderkey % 8 " + " ".join(f"WHEN {i} THEN {_quoted(c)}" for i, c in enumerate(_SPELLED.values())) + " END"


@query(f"SELECT o_orderkey k, {_PICKED} || ' ' || o_custkey || 'x' canonical FROM orders")
def canonical_names(spark, d):
    """Suffixes out, long first names, other spellings of tokens and of whole names; the number that follows keeps names apart."""
    names = F.array(*[F.lit(n) for n in _SPELLED])
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.get(names, (F.col("o_orderkey") % 8).cast("int")).alias("name"), "o_custkey")
    return o.select("k", F.concat_ws(" ", N.canonical(F.col("name"), _TOKENS, _NAMES), F.concat("o_custkey", F.lit("x"))).alias("canonical"))


@query("""WITH x AS (SELECT o_orderkey k, o_orderkey % 6 i, o_custkey % 3 j FROM orders) SELECT k, CASE i WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN true WHEN 3 THEN false WHEN 4 THEN j = 0 ELSE false END same FROM x""")
def same_people(spark, d):
    """Equal names, wholly reversed ones, and ones that are equal only in canonical form."""
    o = table(spark, d, "orders")
    i, j = F.col("o_orderkey") % 6, F.col("o_custkey") % 3
    a = F.when(i == 2, "Mike Day Jr").otherwise("Ánn Bo  Cy")
    b = F.when(i == 0, "ann bo cy").when(i == 1, "Cy Bo Ann").when(i == 2, "Day Michael").when(i == 3, "Bo Ann Cy").when(i == 4, F.when(j == 0, "Cy, Bo Ann").otherwise("Cy Ann")).otherwise("")
    return o.select(F.col("o_orderkey").alias("k"), N.same_person(a, b).alias("same"))
