"""Which side to back: blended probabilities, edges, filters with reasons, and the finders that use them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


#: Columns that the newcomer tiers and the line gates read.
GATED = ("tier_a", "tier_b", "line_movement", "line_is_sharp", "line_steam_move")


def sides(predictions: DataFrame) -> DataFrame:
    """A row a side with its blended probability (normalised over both), odds and edge."""
    wa = S.blend_weight(F.col("prob_a"), F.col("second_a"), F.col("market_a"))
    wb = S.blend_weight(F.col("prob_b"), F.col("second_b"), F.col("market_b"))
    p = predictions.withColumn("__ba", S.blended(F.col("prob_a"), F.col("market_a"), wa)).withColumn("__bb", S.blended(F.col("prob_b"), F.col("market_b"), wb))
    total = F.col("__ba") + F.col("__bb")
    side = lambda s: F.struct(F.lit(s).alias("side"), F.col(f"prob_{s}").alias("prob"), F.col(f"second_{s}").alias("second"), F.col(f"market_{s}").alias("market"), F.try_divide(F.col(f"__b{s}"), total).alias("blended"))
    more = [c for c in GATED if c in predictions.columns]
    out = p.select("bout_id", "event_id", "event_date", "fights_a", "fights_b", "target", *more, F.explode(F.array(side("a"), side("b"))).alias("x")).select("bout_id", "event_id", "event_date", "fights_a", "fights_b", "target", *more, "x.*")
    return out.withColumn("odds", S.prob_to_decimal(F.col("market"))).withColumn("edge", F.col("blended") - F.col("market"))


def line_gates(base_edge: float = S.BASE_EDGE, extra: float = 0.02, newcomer: Column | None = None) -> list[tuple[str, Column]]:
    """Gates for a line that moves against the side (movement over 0.02 the other way): more edge than is needed anyway (``newcomer`` adds to that), and never a sharp or steam move."""
    move = F.col("line_movement")
    need = S.required_edge(F.col("odds"), base_edge) + (F.lit(0.0) if newcomer is None else newcomer)
    against = F.coalesce(F.when(F.col("side") == "a", move < -0.02).otherwise(move > 0.02), F.lit(False))
    quick = F.coalesce((F.col("line_is_sharp") == 1) | (F.col("line_steam_move") == 1), F.lit(False))
    return [("line_against", ~against | (F.col("edge") >= need + extra)), ("sharp_against", ~(against & quick))]


def gates(base_edge: float = S.BASE_EDGE, tiers: bool = False, lines: bool = False) -> list[tuple[str, Column]]:
    """Ordered gates; the first that fails is the reason.

    With ``tiers`` the newcomer rule of both sides' tiers decides who may be backed and adds to the
    edge that is needed; without, both sides need two bouts. With ``lines`` a line that moves against
    the side is judged before the edge.
    """
    rule = S.newcomer_rule(F.col("fights_a"), F.col("fights_b"), F.col("tier_a"), F.col("tier_b")) if tiers else None
    extra = rule["extra"] if tiers else F.lit(0.0)
    return [
        ("newcomer", rule["allowed"] if tiers else (F.col("fights_a") >= 2) & (F.col("fights_b") >= 2)),
        ("low_probability", F.col("blended") >= S.MIN_BLEND),
        ("long_odds", F.col("odds") <= S.MAX_ODDS),
        ("second_model", F.col("second") - F.col("market") >= 0.01),
        *(line_gates(base_edge, newcomer=extra) if lines else []),
        ("edge", F.col("edge") >= S.required_edge(F.col("odds"), base_edge) + extra),
    ]


def rejection_reason(base_edge: float = S.BASE_EDGE, more: list[tuple[str, Column]] = (), tiers: bool = False, lines: bool = False) -> Column:
    out = None
    for name, ok in [*gates(base_edge, tiers, lines), *more]:
        fails = ~F.coalesce(ok, F.lit(False))
        out = F.when(fails, name) if out is None else out.when(fails, name)
    return out.otherwise("accepted")


def value_bets(predictions: DataFrame, base_edge: float = S.BASE_EDGE, tiers: bool = False, lines: bool = False) -> DataFrame:
    """The passing side of the larger edge of each bout (side a where equal), with the size that the newcomer rule leaves."""
    size = S.newcomer_rule(F.col("fights_a"), F.col("fights_b"), F.col("tier_a"), F.col("tier_b"))["size"] if tiers else F.lit(1.0)
    ok = sides(predictions).where(rejection_reason(base_edge, tiers=tiers, lines=lines) == "accepted").withColumn("size", size)
    return ok.withColumn("__n", F.row_number().over(Window.partitionBy("bout_id").orderBy(F.desc("edge"), "side", F.desc("size")))).where("__n = 1").drop("__n")


def near_misses(predictions: DataFrame, low: float = 0.0, base_edge: float = S.BASE_EDGE, tiers: bool = False, lines: bool = False) -> DataFrame:
    """Sides that fail only by their edge, which is still at least ``low``."""
    return sides(predictions).where((rejection_reason(base_edge, tiers=tiers, lines=lines) == "edge") & (F.col("edge") >= low))


def backtest_candidates(predictions: DataFrame, base_edge: float = S.BASE_EDGE) -> DataFrame:
    """Side a is tried where its edge is no smaller than side b's; b only where a was not taken, even with the smaller edge."""
    s = sides(predictions).withColumn("ok", rejection_reason(base_edge) == "accepted")
    pick = lambda x, c: F.max(F.when(F.col("side") == x, F.col(c)))
    g = s.groupBy("bout_id").agg(pick("a", "edge").alias("edge_a"), pick("b", "edge").alias("edge_b"), F.max(F.when(F.col("side") == "a", F.col("ok"))).alias("ok_a"), F.max(F.when(F.col("side") == "b", F.col("ok"))).alias("ok_b"))
    taken = F.when((F.col("edge_a") >= F.col("edge_b")) & F.col("ok_a"), "a").when(F.col("ok_b"), "b")
    return g.withColumn("side", taken).where("side is not null").select("bout_id", "side", F.when(F.col("side") == "a", F.col("edge_a")).otherwise(F.col("edge_b")).alias("edge"))


def conviction_bets(predictions: DataFrame, bankroll: float = 1000.0) -> DataFrame:
    """Sides of high probability in both models and positive expected value, with their stake."""
    s = sides(predictions)
    ev = S.expected_value(F.col("prob"), F.col("odds"))
    return s.withColumn("ev", ev).where((F.col("prob") >= 0.65) & (F.col("second") >= 0.50) & (F.col("ev") > 0)).withColumn("stake", S.conviction_stake(F.col("prob"), F.lit(bankroll)))


def funnel(predictions: DataFrame, tiers: bool = False, lines: bool = False) -> DataFrame:
    """How many sides survive each gate in turn, in one pass."""
    s = sides(predictions)
    passed, aggs = F.lit(True), [F.count(F.lit(1)).alias("all")]
    for name, ok in gates(tiers=tiers, lines=lines):
        passed = passed & F.coalesce(ok, F.lit(False))
        aggs.append(F.sum(passed.cast("long")).alias(name))
    return s.agg(*aggs)


def flat_picks(predictions: DataFrame) -> DataFrame:
    """The likelier side of each bout, with the first reason to skip it."""
    a = F.col("prob_a") >= F.col("prob_b")
    p = F.greatest("prob_a", "prob_b")
    market = F.when(a, F.col("market_a")).otherwise(F.col("market_b"))
    reason = F.when(p.isNull(), "no_prediction").when((F.col("fights_a") < 1) | (F.col("fights_b") < 1), "newcomer").when(market.isNull() | (market <= 0), "no_price").when(S.prob_to_decimal(market) > 6, "long_odds").otherwise("taken")
    return predictions.select("bout_id", F.when(a, "a").otherwise("b").alias("side"), p.alias("prob"), reason.alias("reason"))


def verified_entry(rows: DataFrame, least_hours: float) -> DataFrame:
    """Only prices with a kind, a file, a time, enough hours before the start and a probability inside (0, 1)."""
    return rows.where((F.col("kind") == "verified") & F.col("file").isNotNull() & F.col("observed_at").isNotNull() & (F.col("hours") >= least_hours) & (F.col("prob") > 0) & (F.col("prob") < 1))
