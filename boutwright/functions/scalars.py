"""Scalar maths of odds, prices, stakes and clocks, as Column expressions. Unknown stays null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASE_EDGE, MAX_ODDS, MIN_BLEND = 0.02, 3.0, 0.40


def american_to_prob(o: Column) -> Column:
    return F.when(o > 0, 100 / (o + 100)).when(o < 0, -o / (-o + 100))


def decimal_to_american(d: Column) -> Column:
    return F.when(d >= 2, (d - 1) * 100).when(d > 1, F.lit(-100) / (d - 1))


def decimal_to_prob(d: Column) -> Column:
    return F.when(d <= 0, 0.0).otherwise(1 / F.nullif(d, F.lit(0.0)))


def prob_to_decimal(p: Column) -> Column:
    return F.when(p <= 0, F.lit(float("inf"))).otherwise(F.try_divide(F.lit(1.0), p))


def no_vig(a: Column, b: Column) -> Column:
    """Side a's share where both prices are positive."""
    return F.when((a > 0) & (b > 0), F.try_divide(a, a + b))


def remove_vig(a: Column, b: Column) -> Column:
    """As no_vig, but a half where the total is nothing."""
    return F.when(a + b == 0, 0.5).otherwise(F.try_divide(a, a + b))


def expected_value(p: Column, odds: Column, stake: Column | float = 1.0) -> Column:
    stake = stake if isinstance(stake, Column) else F.lit(stake)
    return p * (odds - 1) * stake - (1 - p) * stake


def closing_line_value(fill: Column, close: Column) -> Column:
    return F.when(close <= 0, 0.0).otherwise(F.try_divide(F.try_divide(F.lit(1.0), fill), F.try_divide(F.lit(1.0), close)) - 1)


def blend_weight(p: Column, second: Column | None = None, market: Column | None = None, base: float = 0.30, low: float = 0.15, high: float = 0.50, bar: float = 0.30) -> Column:
    """Weight of the model against the market, by its confidence and a second model's agreement."""
    c = 2 * F.abs(p - 0.5)
    w = F.when(c >= bar, base + F.least(F.lit(1.0), (c - bar) / (1 - bar)) * (high - base)).otherwise(low + c / max(0.01, bar) * (base - low))
    if second is not None:
        agree = ((p > market) & (second - market > 0.05)) | ((p < market) & (market - second > 0.05))
        w = w + F.when(agree, 0.10).otherwise(0.0)
    return F.greatest(F.lit(low), F.least(F.lit(high), w))


def blended(p: Column, market: Column, weight: Column) -> Column:
    return weight * p + (1 - weight) * market


def required_edge(odds: Column, base: float = BASE_EDGE) -> Column:
    return F.when(odds <= 2, base).otherwise(base + 0.02 * (odds - 2))


def newcomer(fights: Column, tier: Column, least: int = 3) -> Column:
    """Struct of extra edge and whether a bet is allowed, for one side: fewer than ``least`` bouts ask more edge by tier; a debut needs tier 1 or 2."""
    new = F.coalesce(fights, F.lit(0)) < least
    extra = F.when(~new, 0.0).when(tier == 1, 0.02).when(tier == 2, 0.03).otherwise(0.04)
    debut = (F.coalesce(fights, F.lit(0)) <= 0) & ~F.coalesce(tier.isin(1, 2), F.lit(False))
    return F.struct(extra.alias("extra"), (~debut).alias("allowed"), F.when(new & ~debut, 0.5).otherwise(1.0).alias("size"))


def newcomer_rule(fights_a: Column, fights_b: Column, tier_a: Column, tier_b: Column, least: int = 3) -> Column:
    """The stricter side governs: both must be allowed, the larger extra edge and the smaller size hold."""
    a, b = newcomer(fights_a, tier_a, least), newcomer(fights_b, tier_b, least)
    return F.struct(F.greatest(a["extra"], b["extra"]).alias("extra"), (a["allowed"] & b["allowed"]).alias("allowed"), F.least(a["size"], b["size"]).alias("size"))


def kelly_fraction(p: Column, odds: Column, share: float = 0.25, cap: float = 0.04) -> Column:
    b = odds - 1
    f = F.try_divide(b * p - (1 - p), b)
    return F.greatest(F.lit(0.0), F.least(share * f, F.lit(cap)))


def kelly_stake(p: Column, odds: Column, equity: Column) -> Column:
    s = equity * kelly_fraction(p, odds)
    return F.when(s < 1, 0.0).otherwise(F.round(s, 2))


def conviction_stake(p: Column, bankroll: Column) -> Column:
    return F.round(F.least(0.05 + 0.01 * (p - 0.65) / 0.05, F.lit(0.08)) * bankroll, 2)


def movement_direction(m: Column, bar: float = 0.02) -> Column:
    return F.when(m > bar, "toward_a").when(m < -bar, "toward_b").otherwise("stable")


def implausible_favourites(a: Column, b: Column, most: float = 1.20) -> Column:
    """Two equal odds whose overround no book would quote."""
    return F.coalesce((a == b) & (1 / a + 1 / b > most), F.lit(False))


def landed(s: Column) -> Column:
    return F.regexp_extract(s, r"^\s*(\d+)\s+of\s+(\d+)\s*$", 1).try_cast("double")


def attempted(s: Column) -> Column:
    return F.regexp_extract(s, r"^\s*(\d+)\s+of\s+(\d+)\s*$", 2).try_cast("double")


def clock_seconds(s: Column) -> Column:
    return F.when(s.rlike(r"^\d+:\d{1,2}$"), F.split_part(s, F.lit(":"), F.lit(1)).try_cast("int") * 60 + F.split_part(s, F.lit(":"), F.lit(2)).try_cast("int"))


def total_seconds(round_: Column, clock: Column) -> Column:
    return (round_ - 1) * 300 + clock_seconds(clock)


def height_cm(s: Column) -> Column:
    feet, inches = F.regexp_extract(s, r"(\d+)'\s*(\d+)", 1), F.regexp_extract(s, r"(\d+)'\s*(\d+)", 2)
    return F.when(s.rlike(r"\d+'\s*\d+"), F.round((feet.try_cast("int") * 12 + inches.try_cast("int")) * 2.54, 2)).when(s.rlike(r"^[\d.]+\s*cm$"), F.regexp_extract(s, r"^([\d.]+)", 1).try_cast("double"))


def reach_cm(s: Column) -> Column:
    n = F.regexp_extract(s, r"^([\d.]+)", 1).try_cast("double")
    return F.when(s.rlike(r"^[\d.]+\s*cm$"), n).when(s.rlike(r'^[\d.]+\s*("|in)'), F.round(n * 2.54, 2))


def percent(s: Column) -> Column:
    p = F.regexp_replace(s, r"[%\s]", "").try_cast("double")
    return F.when(p <= 1, p * 100).otherwise(p)


def nullable_binary(s: Column) -> Column:
    v = F.lower(F.trim(s))
    return F.when(v.isin("1", "1.0", "true", "yes", "y", "t"), 1.0).when(v.isin("0", "0.0", "false", "no", "n", "f"), 0.0)


def method_group(s: Column) -> Column:
    """Exclusive bucket by substring: decision, then submission, then knockout."""
    v = F.lower(s)
    return F.when(v.contains("dec"), "dec").when(v.contains("sub"), "sub").when(v.contains("ko"), "ko")


def official_result(outcome: Column, method: Column) -> Column:
    """Struct of kind, winning side, fitness as a target and quarantine of a 'W/L'-style pair of statuses.

    A disqualification keeps its winner but is no target. Anything but two known statuses is
    unknown; two known ones that cannot stand together are contradictory.
    """
    v = F.transform(F.split(F.upper(F.trim(outcome)), "/"), lambda t: F.trim(t))
    known = (F.size(v) == 2) & F.forall(v, lambda t: t.isin("W", "L", "D", "NC"))
    pair = F.array_join(v, "/")
    won = F.when(pair == "W/L", "a").when(pair == "L/W", "b")
    out = method.rlike(r"(?i)\b(?:DQ|DISQUALIFICATION)\b")
    kind = F.when(~F.coalesce(known, F.lit(False)), "unknown").when(won.isNotNull() & F.coalesce(out, F.lit(False)), "disqualification").when(won.isNotNull(), "normal").when(pair == "D/D", "draw").when(pair == "NC/NC", "no_contest").otherwise("contradictory")
    return F.struct(kind.alias("kind"), won.alias("winner_side"), (kind == "normal").alias("is_target"), kind.isin("unknown", "contradictory").alias("quarantined"))


def entry_window(event: Column, now: Column, opens_h: float = 48, closes_h: float = 1) -> Column:
    hours = (F.unix_micros(event.cast("timestamp")) - F.unix_micros(now.cast("timestamp"))) / 3.6e9
    return F.when(hours.isNull(), "unknown").when(hours > opens_h, "not_open").when(hours <= closes_h, "closed").otherwise("open")


def window_start(ts: Column, seconds: int = 300) -> Column:
    return F.timestamp_seconds(F.floor(F.unix_timestamp(ts.cast("timestamp")) / seconds) * seconds)


def sample_weight(days: Column, half_life: float = 730.0) -> Column:
    return F.pow(F.lit(2.0), -days / half_life)
