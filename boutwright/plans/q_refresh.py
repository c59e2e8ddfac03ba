"""Queries of accepted tables and their refresh: preservation, duplicates, exact matches, card changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import refresh as R
from .fixtures import r6, run_sql

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Accepted rows hold inherited duplicates and invalid identities; the candidate changes, drops and adds some.
_ACC = "SELECT CASE WHEN o_orderkey % 50 = 0 THEN NULL WHEN o_orderkey % 30 = 1 THEN o_orderkey - 1 ELSE o_orderkey END k, o_orderstatus s, CASE WHEN o_orderkey % 8 > 0 THEN o_custkey END c FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01 00:00:00'"
_CAND = "SELECT CASE WHEN o_orderkey % 50 = 0 THEN NULL WHEN o_orderkey % 30 = 1 THEN o_orderkey - 1 WHEN o_orderkey % 77 = 5 THEN o_orderkey + 1 ELSE o_orderkey END k, CASE WHEN o_orderkey % 90 = 30 THEN 'X' ELSE o_orderstatus END s, CASE WHEN o_orderkey % 16 > 0 THEN o_custkey END c FROM orders WHERE o_orderkey % 101 > 0"


def _versions(spark, d):
    return run_sql(spark, d, _ACC), run_sql(spark, d, _CAND)


@query(f"""WITH a AS ({_ACC}), dl AS (SELECT o_orderkey k, o_orderstatus s, NULL::BIGINT c FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01 00:00:00'), u AS (SELECT * FROM a UNION ALL SELECT * FROM dl)
SELECT s, count(*) n, count(k) n_keys, count(c) n_c, (SELECT count(*) FROM (SELECT k, s, c FROM a EXCEPT ALL SELECT k, s, c FROM u)) lost FROM u GROUP BY 1""")
def prefix_append(spark, d):
    acc = run_sql(spark, d, _ACC)
    delta = run_sql(spark, d, "SELECT o_orderkey k, o_orderstatus s, o_totalprice other FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01 00:00:00'")
    out = R.appended(acc, delta)
    lost = R.lost_occurrences(acc, out).agg(F.coalesce(F.sum("n_lost"), F.lit(0)).alias("lost"))
    return out.groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.count("k").alias("n_keys"), F.count("c").alias("n_c")).crossJoin(F.broadcast(lost))  # one row beside each


@query(f"""WITH a AS ({_ACC}), c AS ({_CAND}), p AS (SELECT k, s, c, sum(x) a, sum(y) n FROM (SELECT k, s, c, 1 x, 0 y FROM a UNION ALL SELECT k, s, c, 0, 1 FROM c) z GROUP BY 1, 2, 3),
g AS (SELECT k, sum(a) a, sum(n) c, sum(greatest(n - a, 0)) more, sum(greatest(a - n, 0)) less, sum(least(a, n)) kept FROM p GROUP BY 1), u AS (SELECT *, greatest(a - 1, 0) au, greatest(c - 1, 0) cu FROM g), v AS (SELECT *, au > 0 AND (cu < au OR less > 0) broken FROM u),
r AS (SELECT coalesce(sum(more) FILTER (WHERE k IS NULL), 0)::BIGINT new_invalid, coalesce(sum(less) FILTER (WHERE k IS NULL), 0)::BIGINT lost_invalid, coalesce(sum(kept) FILTER (WHERE k IS NULL), 0)::BIGINT inherited_invalid, coalesce(sum(greatest(cu - au, 0)) FILTER (WHERE k IS NOT NULL), 0)::BIGINT new_duplicates,
 coalesce(sum(greatest(au - cu, less, 1)) FILTER (WHERE k IS NOT NULL AND broken), 0)::BIGINT changed_duplicates, count(*) FILTER (WHERE k IS NOT NULL AND au > 0 AND NOT broken) inherited_duplicates FROM v)
SELECT *, new_invalid + lost_invalid + new_duplicates + changed_duplicates = 0 passed FROM r""")
def baseline_duplicates(spark, d):
    return R.duplicate_report(*_versions(spark, d), F.col("k"))


_UNIQ = "SELECT o_orderkey k, o_orderstatus s, CASE WHEN o_orderkey % 8 > 0 THEN o_custkey END c FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01 00:00:00'"
_UNIQ2 = "SELECT o_orderkey k, CASE WHEN o_orderkey % 90 = 30 THEN 'X' ELSE o_orderstatus END s, CASE WHEN o_orderkey % 24 > 0 AND o_orderkey % 31 > 0 THEN o_custkey END c FROM orders WHERE o_orderkey % 101 > 0"


@query(f"""WITH a AS ({_UNIQ}), n AS ({_UNIQ2}) SELECT a.k, NULL AS field, 'removed' change FROM a LEFT JOIN n ON a.k = n.k WHERE n.k IS NULL UNION ALL SELECT n.k, NULL, 'new' FROM n LEFT JOIN a ON a.k = n.k WHERE a.k IS NULL
UNION ALL SELECT a.k, 's', 'changed' FROM a JOIN n ON a.k = n.k WHERE a.s <> n.s UNION ALL SELECT a.k, 'c', 'changed' FROM a JOIN n ON a.k = n.k WHERE a.c IS NOT NULL AND a.c IS DISTINCT FROM n.c""")
def accepted_changes(spark, d):
    return R.accepted_changes(run_sql(spark, d, _UNIQ), run_sql(spark, d, _UNIQ2), "k", ["s", "c"], fill_ok=True)


_ID1 = "SELECT CAST(o_orderdate AS DATE) dd, o_custkey % 10 a, o_orderkey % 7 b FROM orders WHERE o_orderstatus = 'F'"
_ID2 = "SELECT CAST(o_orderdate AS DATE) dd, o_orderkey % 7 a, o_custkey % 10 b FROM orders WHERE o_orderstatus <> 'F'"


@query(f"WITH a AS ({_ID1}), n AS ({_ID2}) SELECT dd AS \"day\", least(a, b) lo, greatest(a, b) hi FROM a INTERSECT SELECT dd, least(a, b), greatest(a, b) FROM n")
def shared_identities(spark, d):
    return R.shared_identities(run_sql(spark, d, _ID1), run_sql(spark, d, _ID2), "dd", "a", "b")


#: Every order's lines are fills; activity agrees, is missing, doubled, or off by a little.
_FILLS = "SELECT l_orderkey order_id, CAST(l_partkey % 40 AS VARCHAR(9)) token, CASE WHEN l_orderkey % 23 = 0 THEN 'same' ELSE concat('0xA', CAST(l_orderkey AS VARCHAR(19)), '-', CAST(l_linenumber AS VARCHAR(9))) END tx, CAST(l_quantity AS DECIMAL(20, 6)) shares, CAST(0.05 + l_discount AS DECIMAL(20, 6)) price, l_linenumber n FROM lineitem"
_ACT = f"""SELECT lower(tx) tx, token asset, CASE WHEN order_id % 29 = 3 THEN 'REDEEM' ELSE 'TRADE' END type, 'BUY' side, CASE WHEN order_id % 31 = 4 THEN shares + 1 ELSE shares END size, price, CASE WHEN order_id % 37 = 5 THEN CAST(0 AS DECIMAL(20, 6)) ELSE CAST(shares * price + 0.01 AS DECIMAL(20, 6)) END cash, CASE WHEN order_id % 41 = 6 THEN NULL ELSE order_id END AS stamp FROM ({_FILLS}) f
UNION ALL SELECT tx, token, 'TRADE', 'BUY', shares, price, CAST(shares * price AS DECIMAL(20, 6)), order_id FROM ({_FILLS}) f WHERE order_id % 43 = 7"""
_ORD = f"SELECT o_orderkey order_id, CAST(q + CASE WHEN o_orderkey % 47 = 8 THEN 1 ELSE 0 END AS DECIMAL(20, 6)) filled, CAST(g + CASE WHEN o_orderkey % 53 = 9 THEN 0.25 ELSE 0 END AS DECIMAL(20, 6)) amount FROM orders LEFT JOIN (SELECT order_id, sum(shares) q, sum(shares * price) g FROM ({_FILLS}) f GROUP BY order_id) s ON s.order_id = o_orderkey"


@query(f"""WITH fi AS ({_FILLS}), ac AS ({_ACT}), od AS ({_ORD}), aa AS (SELECT lower(tx) tx, asset, count(*) n, any_value(size) size, any_value(price) price, any_value(cash) cash, any_value(stamp) at_ FROM ac WHERE type = 'TRADE' AND side = 'BUY' GROUP BY 1, 2),
st AS (SELECT order_id, lower(tx) tx, count(*) n FROM fi GROUP BY 1, 2),
x AS (SELECT fi.*, CASE WHEN st.n > 1 THEN 0 WHEN NOT (shares > 0 AND fi.price > 0 AND fi.price < 1) THEN 1 WHEN coalesce(aa.n, 0) <> 1 THEN 2 WHEN NOT coalesce(aa.size = shares AND aa.price = fi.price, false) THEN 3 WHEN NOT coalesce(cash >= shares * fi.price, false) THEN 4 WHEN at_ IS NULL OR at_ < 0 THEN 5 END bad, cash
 FROM fi JOIN st ON st.order_id = fi.order_id AND st.tx = lower(fi.tx) LEFT JOIN aa ON aa.tx = lower(fi.tx) AND aa.asset = fi.token),
p AS (SELECT order_id, min(bad) bad, sum(shares) shares, sum(shares * price) gross, sum(cash) debit, count(*) n FROM x GROUP BY 1),
r AS (SELECT od.order_id, shares, gross, debit, CASE WHEN n IS NULL THEN 'no_fills' WHEN bad IS NOT NULL THEN (['shared_transaction', 'invalid_fill', 'missing_or_duplicate_activity', 'activity_mismatch', 'debit_below_gross', 'no_timestamp'])[bad + 1]
 WHEN NOT coalesce(abs(shares - filled) <= 0.005, false) THEN 'quantity_mismatch' WHEN NOT coalesce(abs(gross - amount) <= 0.005, false) THEN 'gross_mismatch' ELSE 'confirmed' END status FROM od LEFT JOIN p ON p.order_id = od.order_id)
SELECT order_id, status, CASE WHEN status = 'confirmed' THEN shares::DOUBLE END shares, CASE WHEN status = 'confirmed' THEN round(gross::DOUBLE, 4) END gross, CASE WHEN status = 'confirmed' THEN round(debit::DOUBLE, 4) END debit FROM r""")
def cash_debits(spark, d):
    out = R.cash_debits(run_sql(spark, d, _FILLS), run_sql(spark, d, _ACT), run_sql(spark, d, _ORD))
    return out.select("order_id", "status", "shares", F.round("gross", 4).alias("gross"), F.round("debit", 4).alias("debit"))


_SAVED = "SELECT CAST(o_orderdate AS DATE) AS dd, concat('n', CAST(o_custkey % 300 AS VARCHAR(9))) a_name, concat('m', CAST(o_orderkey % 50 AS VARCHAR(9))) b_name, CASE WHEN o_orderkey % 9 > 0 THEN o_custkey % 300 END a_ref, o_orderkey % 50 b_ref, CAST(o_orderkey % 101 AS DOUBLE) / 128 prob_a FROM orders"
_NOW = "SELECT o_orderkey quote_id, CAST(o_orderdate AS DATE) AS dd, CASE WHEN o_orderkey % 2 = 0 THEN concat('n', CAST(o_custkey % 300 AS VARCHAR(9))) ELSE concat('m', CAST(o_orderkey % 50 AS VARCHAR(9))) END a_name, CASE WHEN o_orderkey % 2 = 1 THEN concat('n', CAST((o_custkey + CASE WHEN o_orderkey % 13 = 1 THEN 1 ELSE 0 END) % 300 AS VARCHAR(9))) ELSE concat('m', CAST(o_orderkey % 50 AS VARCHAR(9))) END b_name, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 > 0 THEN o_custkey % 300 END a_ref, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 5 = 0 THEN o_orderkey % 50 + o_custkey % 2 END b_ref FROM orders"


@query(f"""WITH s AS (SELECT *, least(a_name, b_name) lo, greatest(a_name, b_name) hi FROM ({_SAVED}) z), g AS (SELECT dd, lo, hi, count(*) n, any_value(a_name) sn, any_value(a_ref) sar, any_value(b_ref) sbr, any_value(prob_a) p FROM s GROUP BY 1, 2, 3), q AS ({_NOW}),
j AS (SELECT q.*, n, p, q.a_name <> sn turned, CASE WHEN q.a_name <> sn THEN sbr ELSE sar END ra, CASE WHEN q.a_name <> sn THEN sar ELSE sbr END rb FROM q LEFT JOIN g ON g.dd = q.dd AND lo = least(q.a_name, q.b_name) AND hi = greatest(q.a_name, q.b_name)),
t AS (SELECT *, CASE WHEN n IS NULL THEN 'absent' WHEN n > 1 THEN 'ambiguous' WHEN (a_ref IS NOT NULL AND a_ref IS DISTINCT FROM ra) OR (b_ref IS NOT NULL AND b_ref IS DISTINCT FROM rb) THEN 'id_conflict' ELSE 'matched' END status FROM j)
SELECT quote_id, status, CASE WHEN status = 'matched' THEN turned END turned, CASE WHEN status = 'matched' THEN CASE WHEN turned THEN 1 - p ELSE p END END prob_a FROM t""")
def matched_quotes(spark, d):
    return R.matched_quotes(run_sql(spark, d, _NOW).withColumnRenamed("dd", "day"), run_sql(spark, d, _SAVED).withColumnRenamed("dd", "day"))


#: Two scans of each day's card: sides are turned, days move, keys change, partners are replaced, bouts come and go.
_CARD1 = "SELECT o_orderkey AS key, o_custkey % 97 event, CAST(o_orderdate AS DATE) dd, o_custkey * 2 a_id, o_orderkey * 2 + 1 b_id FROM orders WHERE o_orderkey % 11 > 0"
_CARD2 = """SELECT CASE WHEN o_orderkey % 13 = 2 OR o_orderkey % 17 = 3 THEN o_orderkey + 100000000 ELSE o_orderkey END AS key, o_custkey % 97 event, CASE WHEN o_orderkey % 19 = 4 THEN CAST(o_orderdate AS DATE) + INTERVAL 3 DAY ELSE CAST(o_orderdate AS DATE) END dd,
 CASE WHEN o_orderkey % 23 = 5 THEN o_orderkey * 2 + 1 WHEN o_orderkey % 17 = 3 THEN o_orderkey * 2 + 900000001 ELSE o_custkey * 2 END a_id, CASE WHEN o_orderkey % 23 = 5 THEN o_custkey * 2 ELSE o_orderkey * 2 + 1 END b_id FROM orders WHERE o_orderkey % 29 > 0"""


def _cards(spark, d):
    fix = lambda q: run_sql(spark, d, q).withColumn("day", F.to_date("dd")).drop("dd")
    return fix(_CARD1), fix(_CARD2)


@query(f"""WITH o AS (SELECT *, concat(least(a_id, b_id), '|', greatest(a_id, b_id)) pr FROM ({_CARD1}) z), n AS (SELECT *, concat(least(a_id, b_id), '|', greatest(a_id, b_id)) pr FROM ({_CARD2}) z),
sm AS (SELECT o.key, o.a_id oa, o.b_id ob, n.a_id na, n.b_id nb, CAST(o.dd AS DATE) od, CAST(n.dd AS DATE) nd FROM o JOIN n ON o.key = n.key), go AS (SELECT o.* FROM o LEFT JOIN n ON o.key = n.key WHERE n.key IS NULL), co AS (SELECT n.* FROM n LEFT JOIN o ON o.key = n.key WHERE o.key IS NULL),
ag AS (SELECT g.k old_key, c.k new_key FROM (SELECT pr, min(key) k FROM go GROUP BY 1 HAVING count(*) = 1) g JOIN (SELECT pr, min(key) k FROM co GROUP BY 1 HAVING count(*) = 1) c ON g.pr = c.pr),
g2 AS (SELECT * FROM go WHERE key NOT IN (SELECT old_key FROM ag)), c2 AS (SELECT * FROM co WHERE key NOT IN (SELECT new_key FROM ag)),
gw AS (SELECT DISTINCT key, event, unnest([a_id, b_id]) who FROM g2), cw AS (SELECT DISTINCT key, event, unnest([a_id, b_id]) who FROM c2), mt AS (SELECT gw.key ok, cw.key nk FROM gw JOIN cw ON gw.event = cw.event AND gw.who = cw.who GROUP BY 1, 2 HAVING count(*) = 1),
sw AS (SELECT ok, nk FROM mt QUALIFY count(*) OVER (PARTITION BY ok) = 1 AND count(*) OVER (PARTITION BY nk) = 1)
SELECT key old_key, key new_key, 'reversed' change FROM sm WHERE oa = nb AND ob = na UNION ALL SELECT key, key, 'rescheduled' FROM sm WHERE od <> nd UNION ALL SELECT old_key, new_key, 'rescheduled' FROM ag UNION ALL SELECT ok, nk, 'replaced' FROM sw
UNION ALL SELECT NULL, key, 'added' FROM c2 WHERE key NOT IN (SELECT nk FROM sw) UNION ALL SELECT key, NULL, 'removed' FROM g2 WHERE key NOT IN (SELECT ok FROM sw)""")
def card_changes(spark, d):
    return R.card_changes(*_cards(spark, d))


@query(f"""WITH o AS (SELECT event, a_id me, b_id you FROM ({_CARD1}) z UNION ALL SELECT event, b_id, a_id FROM ({_CARD1}) z), n AS (SELECT event, CAST(event % 20 AS INTEGER) days_to_event, a_id me, b_id you FROM ({_CARD2}) z UNION ALL SELECT event, CAST(event % 20 AS INTEGER), b_id, a_id FROM ({_CARD2}) z)
SELECT DISTINCT o.event, o.me stayed, o.you "left", n.you replacement, n.days_to_event FROM o JOIN n ON o.event = n.event AND o.me = n.me WHERE n.days_to_event <= 14 AND o.you <> n.you AND NOT EXISTS (SELECT 1 FROM n x WHERE x.event = o.event AND x.me = o.you) AND NOT EXISTS (SELECT 1 FROM o x WHERE x.event = o.event AND x.me = n.you)""")
def short_notice(spark, d):
    old, new = _cards(spark, d)
    return R.short_notice(old, new.withColumn("days_to_event", (F.col("event") % 20).cast("int")))


@query("""WITH h AS (SELECT user_id u, CAST(ts AS DATE) dd, CASE WHEN event_id % 9 > 0 THEN ts END cap, CASE WHEN event_id % 5 = 0 THEN 'loss' ELSE 'win' END res, event_id row_id FROM events), x AS (SELECT *, count(DISTINCT res) OVER (PARTITION BY u, dd) > 1 conflict FROM h)
SELECT u, dd, row_id, res, conflict FROM x QUALIFY row_number() OVER (PARTITION BY u, dd ORDER BY cap NULLS LAST, row_id) = 1""")
def earliest_evidence(spark, d):
    h = run_sql(spark, d, "SELECT user_id u, CAST(ts AS DATE) dd, CASE WHEN event_id % 9 > 0 THEN ts END cap, CASE WHEN event_id % 5 = 0 THEN 'loss' ELSE 'win' END res, event_id row_id FROM events")
    return R.earliest_evidence(h, ["u", "dd"], "cap", "res").select("u", "dd", "row_id", "res", "conflict")


_ARCH = "SELECT user_id u, CAST(ts AS DATE) saved, event_id % 3 level, CASE WHEN event_id % 4 > 0 THEN value END v, CASE WHEN event_id % 7 > 0 THEN event_type END t, event_id row_id FROM events"


@query(f"SELECT u, row_id, v, t FROM ({_ARCH}) a QUALIFY row_number() OVER (PARTITION BY u ORDER BY saved DESC, level DESC, (v IS NOT NULL)::INT + (t IS NOT NULL)::INT DESC, row_id DESC) = 1")
def archive_merge(spark, d):
    return R.richest(run_sql(spark, d, _ARCH), "u", "saved", "level", ["v", "t"]).select("u", "row_id", "v", "t")


_MK = """SELECT event_id, CAST(event_id AS VARCHAR(19)) mid, CASE WHEN event_id % 6 = 0 THEN 'Yes' ELSE concat(' P', CAST(user_id AS VARCHAR(9))) END pa, concat('Q', CAST(event_id % 17 AS VARCHAR(9))) pb, CASE WHEN event_id % 10 = 0 THEN '1.5' WHEN event_id % 10 = 1 THEN 'n/a' ELSE '0.25' END ca, concat('t', CAST(event_id % 4000 AS VARCHAR(9))) ta, concat('t', CAST(event_id + 100000 AS VARCHAR(9))) tb FROM events"""


def _markets(spark, d):
    m = run_sql(spark, d, _MK)
    lists = [F.to_json(F.array("pa", "pb")).alias("outcomes"), F.to_json(F.array("ca", F.lit("0.75"))).alias("outcomePrices"), F.to_json(F.array("ta", "tb")).alias("clobTokenIds")]
    return R.winner_markets(m.select(F.to_json(F.struct(F.col("mid").alias("id"), *lists)).alias("payload")), "payload")


_OK = f"wk AS (SELECT mid market_id, trim(pa) a_name, pb b_name, ta token_a, tb token_b, 0.25 price_a, 0.75 price_b FROM ({_MK}) z WHERE pa <> 'Yes' AND ca = '0.25')"


@query(f"WITH {_OK} SELECT * FROM wk")
def winner_markets(spark, d):
    return _markets(spark, d)


@query(f"WITH {_OK}, ts AS (SELECT token_a token, 'a' side, a_name AS name, b_name opponent, market_id FROM wk UNION SELECT token_b, 'b', b_name, a_name, market_id FROM wk) SELECT * FROM ts QUALIFY count(*) OVER (PARTITION BY token) = 1")
def token_sides(spark, d):
    return R.token_sides(_markets(spark, d))
