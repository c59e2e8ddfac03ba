"""Queries of the history family, each beside the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as X
from ..operators import history as H
from ..operators import visible as V
from .fixtures import BOUTS, LONG, bouts, r6, table

QUERIES, SQL = {}, {}
_W = "OVER (PARTITION BY entity ORDER BY event_date, fight_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_E = "OVER (PARTITION BY entity ORDER BY event_date, fight_id)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _long(spark, d):
    return H.long_rows(bouts(spark, d))


_EWM = f"""n AS (SELECT *, row_number() {_E} i, CASE WHEN result = 'win' THEN 1.0 ELSE 0.0 END won FROM long),
e AS (SELECT x.fight_id, x.side, sum(y.won * pow(2, (y.i - x.i) / 3.0)) / sum(pow(2, (y.i - x.i) / 3.0)) ewm_won,
  sum(y.landed * pow(2, (y.i - x.i) / 3.0)) / sum(pow(2, (y.i - x.i) / 3.0)) ewm_landed
  FROM n x LEFT JOIN n y ON x.entity = y.entity AND y.i < x.i AND y.i >= x.i - 192 GROUP BY 1, 2)"""


@query(f"""WITH {LONG}, {_EWM}
SELECT b.fight_id, round(ea.ewm_won, 6) a_ewm_won, round(eb.ewm_won, 6) b_ewm_won, round(ea.ewm_won - eb.ewm_won, 6) diff_ewm_won,
  round(ea.ewm_landed, 6) a_ewm_landed, round(eb.ewm_landed, 6) b_ewm_landed, round(ea.ewm_landed - eb.ewm_landed, 6) diff_ewm_landed
FROM bouts b LEFT JOIN e ea ON ea.fight_id = b.fight_id AND ea.side = 'a' LEFT JOIN e eb ON eb.fight_id = b.fight_id AND eb.side = 'b'""")
def ewm_diff(spark, d):
    b = bouts(spark, d)
    rows = H.long_rows(b).withColumn("won", F.when(F.col("result") == "win", 1.0).otherwise(0.0))
    rows = X.rolled(rows, ("won", "landed")).withColumnsRenamed({"roll_won": "ewm_won", "roll_landed": "ewm_landed"})
    names = ["ewm_won", "ewm_landed"]
    out = H.differences(H.both_sides(b.select("fight_id"), rows, names), names)
    return out.select("fight_id", *[r6(f"{p}_{n}").alias(f"{p}_{n}") for n in names for p in ("a", "b", "diff")])


@query(f"""WITH {LONG} SELECT fight_id, side, row_number() {_E} - 1 num_fights,
 CAST(coalesce(sum(CASE WHEN result = 'win' THEN 1 ELSE 0 END) {_W}, 0) AS BIGINT) wins, CAST(coalesce(sum(CASE WHEN result = 'loss' THEN 1 ELSE 0 END) {_W}, 0) AS BIGINT) losses,
 CAST(coalesce(sum(CASE WHEN result = 'draw' THEN 1 ELSE 0 END) {_W}, 0) AS BIGINT) draws, CAST(coalesce(sum(CASE WHEN result = 'win' AND method LIKE '%KO%' THEN 1 ELSE 0 END) {_W}, 0) AS BIGINT) wins_ko,
 CAST(coalesce(sum(CASE WHEN result = 'win' AND method LIKE '%Sub%' THEN 1 ELSE 0 END) {_W}, 0) AS BIGINT) wins_sub, CAST(coalesce(sum(CASE WHEN result = 'win' AND method LIKE '%Dec%' THEN 1 ELSE 0 END) {_W}, 0) AS BIGINT) wins_dec,
 CAST(coalesce(sum(n_rounds) {_W}, 0) AS BIGINT) total_rounds, date_diff('day', lag(event_date) {_E}, event_date) days_since FROM long""")
def career_counters(spark, d):
    return H.prior_counts(_long(spark, d)).select("fight_id", "side", "num_fights", "wins", "losses", "draws", "wins_ko", "wins_sub", "wins_dec", "total_rounds", "days_since")


@query(f"""WITH {LONG},
g AS (SELECT *, sum(CASE WHEN result <> 'win' THEN 1 ELSE 0 END) {_E} gw, sum(CASE WHEN result <> 'loss' THEN 1 ELSE 0 END) {_E} gl FROM long),
r AS (SELECT *, sum(CASE WHEN result = 'win' THEN 1 ELSE 0 END) OVER (PARTITION BY entity, gw ORDER BY event_date, fight_id) rw,
  sum(CASE WHEN result = 'loss' THEN 1 ELSE 0 END) OVER (PARTITION BY entity, gl ORDER BY event_date, fight_id) rl FROM g)
SELECT fight_id, side, CAST(coalesce(lag(rw) {_E}, 0) AS BIGINT) win_streak, CAST(coalesce(lag(rl) {_E}, 0) AS BIGINT) lose_streak, CAST(coalesce(max(rw) {_W}, 0) AS BIGINT) longest_win_streak FROM r""")
def streaks(spark, d):
    return H.streaks(_long(spark, d)).select("fight_id", "side", "win_streak", "lose_streak", "longest_win_streak")


@query(f"""WITH {LONG}, k AS (SELECT *, CASE WHEN result = 'loss' AND method LIKE '%KO%' THEN 1 ELSE 0 END ko, CASE WHEN result = 'loss' AND method LIKE '%Sub%' THEN 1 ELSE 0 END sb,
 CASE WHEN result = 'loss' AND method LIKE '%Dec%' THEN 1 ELSE 0 END dc FROM long)
SELECT fight_id, side, CAST(coalesce(sum(ko) {_W}, 0) AS BIGINT) losses_ko, CAST(coalesce(sum(sb) {_W}, 0) AS BIGINT) losses_sub, CAST(coalesce(sum(dc) {_W}, 0) AS BIGINT) losses_dec,
 CAST(coalesce(max(ko) OVER (PARTITION BY entity ORDER BY event_date, fight_id ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), 0) AS BIGINT) recent_ko_loss FROM k""")
def recent_loss(spark, d):
    return H.loss_methods(_long(spark, d)).select("fight_id", "side", "losses_ko", "losses_sub", "losses_dec", "recent_ko_loss")


_P = "OVER (PARTITION BY least(a_id, b_id), greatest(a_id, b_id) ORDER BY event_date, fight_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query(f"""WITH {BOUTS} SELECT fight_id, CASE WHEN count(*) {_P} > 0 THEN 1 ELSE 0 END::BIGINT is_rematch,
 CAST(coalesce(sum(CASE WHEN winner = least(a_id, b_id) THEN 1 WHEN winner = greatest(a_id, b_id) THEN -1 ELSE 0 END) {_P}, 0) * CASE WHEN a_id < b_id THEN 1 ELSE -1 END AS BIGINT) h2h_diff FROM bouts""")
def head_to_head(spark, d):
    return H.head_to_head(bouts(spark, d)).select("fight_id", "is_rematch", "h2h_diff")


@query(f"""WITH {LONG}, {_EWM}, w AS (SELECT n.*, e.ewm_won rate FROM n JOIN e ON n.fight_id = e.fight_id AND n.side = e.side),
o AS (SELECT w.*, v.rate orate FROM w JOIN w v ON v.fight_id = w.fight_id AND v.entity = w.opponent),
p AS (SELECT x.fight_id, x.side, y.orate, y.i - greatest(x.i - 6, 0) k FROM o x LEFT JOIN o y ON x.entity = y.entity AND y.i < x.i AND y.i >= x.i - 5)
SELECT fight_id, side, round(sum(k * orate) / sum(CASE WHEN orate IS NOT NULL THEN k END), 6) opp_strength FROM p GROUP BY 1, 2""")
def sos_last5(spark, d):
    rows = X.rolled(_long(spark, d).withColumn("won", F.when(F.col("result") == "win", 1.0).otherwise(0.0)), ("won",)).withColumnRenamed("roll_won", "rate")
    return H.schedule_strength(rows, "rate").select("fight_id", "side", r6("opp_strength").alias("opp_strength"))


@query(f"""WITH {LONG}, n AS (SELECT *, row_number() {_E} i FROM long),
c AS (SELECT x.fight_id, x.side, x.weight_class, y.weight_class yc, count(*) k, min(y.i) f FROM n x JOIN n y ON x.entity = y.entity AND y.i < x.i GROUP BY 1, 2, 3, 4),
m AS (SELECT fight_id, side, weight_class, yc FROM c QUALIFY row_number() OVER (PARTITION BY fight_id, side ORDER BY k DESC, f) = 1)
SELECT n.fight_id, n.side, CAST(CASE WHEN m.yc IS NULL THEN NULL WHEN m.yc <> n.weight_class THEN 1 ELSE 0 END AS BIGINT) class_move FROM n LEFT JOIN m ON m.fight_id = n.fight_id AND m.side = n.side""")
def class_move_mode(spark, d):
    return H.class_moves(_long(spark, d)).select("fight_id", "side", "class_move")


_L5 = "OVER (PARTITION BY entity ORDER BY event_date, fight_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)"


@query(f"""WITH {LONG}, n AS (SELECT *, CAST(row_number() {_E} AS DOUBLE) i FROM long)
SELECT fight_id, side, round(CASE WHEN count(landed) {_L5} < 2 THEN 0 ELSE regr_slope(landed, i) {_L5} END, 6) momentum, round(coalesce(avg(opp_landed) {_L5}, 1500), 6) opponents_mean FROM n""")
def rating_momentum(spark, d):
    out = H.opponents_mean(H.momentum(_long(spark, d), "landed"), "opp_landed")
    return out.select("fight_id", "side", r6("momentum").alias("momentum"), r6("opponents_mean").alias("opponents_mean"))


@query(f"""WITH {LONG}, s AS (SELECT entity, min(event_date) f FROM long GROUP BY 1)
SELECT b.fight_id, CAST(CASE WHEN x.f < b.event_date AND y.f < b.event_date THEN 1 ELSE 0 END AS BIGINT) established FROM bouts b JOIN s x ON x.entity = a_id JOIN s y ON y.entity = b_id""")
def established_mask(spark, d):
    return H.established(bouts(spark, d)).select("fight_id", "established")


@query(f"""WITH {LONG}, c AS (SELECT *, event_date + CAST(fight_id % 40 AS INTEGER) captured FROM long)
SELECT x.fight_id, x.entity, count(y.fight_id) n_visible, round(avg(y.landed), 6) mean_visible FROM c x LEFT JOIN c y ON x.entity = y.entity AND y.captured < x.event_date GROUP BY 1, 2""")
def available_history(spark, d):
    rows = _long(spark, d).withColumn("captured", F.date_add("event_date", (F.col("fight_id") % 40).cast("int")))
    return H.available_history(rows, "captured", "landed").select("fight_id", "entity", "n_visible", r6("mean_visible").alias("mean_visible"))


@query(f"""WITH {LONG}, c AS (SELECT *, row_number() {_E} i, CASE WHEN fight_id % 5 > 0 THEN event_date + CAST(fight_id % 900 AS INTEGER) END captured, CASE WHEN fight_id % 7 > 0 THEN opp_landed END opp FROM long),
p AS (SELECT x.fight_id, x.side, y.landed, y.opp, pow(2, -(row_number() OVER (PARTITION BY x.fight_id, x.side ORDER BY y.i DESC) - 1) / 3.0) w FROM c x JOIN c y ON x.entity = y.entity AND y.i < x.i AND (y.captured IS NULL OR y.captured < x.event_date)),
e AS (SELECT fight_id, side, count(*) n, avg(landed) ml, sum(w * landed) / sum(w) el, avg(opp) mo, sum(w * opp) / sum(CASE WHEN opp IS NOT NULL THEN w END) eo FROM p GROUP BY 1, 2)
SELECT c.fight_id, c.side, coalesce(n, 0) n_visible, round(ml, 6) mean_landed, round(el, 6) ewm_landed, round(mo, 6) mean_opp, round(eo, 6) ewm_opp FROM c LEFT JOIN e ON e.fight_id = c.fight_id AND e.side = c.side""")
def visible_rolling(spark, d):
    """Means and decayed means of what had been captured before each bout; captures come up to 900 days late, a fifth are undated."""
    captured = F.when(F.col("fight_id") % 5 > 0, F.date_add("event_date", (F.col("fight_id") % 900).cast("int")))
    rows = _long(spark, d).withColumns({"captured": captured, "opp": F.when(F.col("fight_id") % 7 > 0, F.col("opp_landed"))})
    rows = rows.select("fight_id", "side", "entity", "event_date", "captured", "landed", "opp")
    out = V.visible_rolling(rows, "captured", ("landed", "opp"))
    return out.select("fight_id", "side", "n_visible", *[r6(c).alias(c) for c in ("mean_landed", "ewm_landed", "mean_opp", "ewm_opp")])


_RANKS = """ranks AS (SELECT DISTINCT l_suppkey entity, CAST(date_trunc('month', l_shipdate) AS DATE) as_of,
  CAST(1 + (l_suppkey * 7 + month(l_shipdate) * 3) % 15 AS INTEGER) rank FROM lineitem)"""


def _ranks(spark, d):
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_suppkey").alias("entity"), F.trunc("l_shipdate", "month").alias("as_of"), (1 + (F.col("l_suppkey") * 7 + F.month("l_shipdate") * 3) % 15).cast("int").alias("rank")).distinct()


@query(f"""WITH {LONG}, {_RANKS} SELECT l.fight_id, l.side, r.rank, r.as_of as_of_used FROM long l ASOF LEFT JOIN ranks r ON l.entity = r.entity AND l.event_date >= r.as_of""")
def asof_backward(spark, d):
    return H.as_of(_long(spark, d).select("fight_id", "side", "entity", "event_date"), _ranks(spark, d), ["entity"], "event_date", "as_of", ["rank"]).select("fight_id", "side", "rank", "as_of_used")


@query(f"""WITH {LONG}, {_RANKS}, p AS (SELECT entity, as_of, rank, rank % 3 precedence FROM ranks),
q AS (SELECT entity, as_of, min(precedence) precedence, arg_min(rank, precedence) rank FROM p GROUP BY 1, 2)
SELECT l.fight_id, l.side, r.rank, r.as_of as_of_used FROM long l ASOF LEFT JOIN q r ON l.entity = r.entity AND l.event_date > r.as_of""")
def asof_strict_precedence(spark, d):
    best = _ranks(spark, d).withColumn("precedence", F.col("rank") % 3).groupBy("entity", "as_of").agg(F.min_by("rank", "precedence").alias("rank"))
    rows = _long(spark, d).select("fight_id", "side", "entity", "event_date")
    return H.as_of(rows, best, ["entity"], "event_date", "as_of", ["rank"], strict=True).select("fight_id", "side", "rank", "as_of_used")


@query()
def elo_ratings(spark, d):
    """Sequential two-sided state: no SQL; tested against a plain loop."""
    return H.elo(bouts(spark, d)).select("fight_id", *[r6(c).alias(c) for c in ("elo_a", "elo_b", "after_a", "after_b")])


@query()
def elo_momentum(spark, d):
    """Slope of the last five ratings and mean rating of the last five opponents, from Elo: no SQL; tested against a plain loop."""
    rows = H.rating_rows(H.elo(bouts(spark, d)))
    out = H.opponents_mean(H.momentum(rows, "after"), "opp_rating")
    return out.select("fight_id", "side", r6("momentum").alias("momentum"), r6("opponents_mean").alias("opponents_mean"))
