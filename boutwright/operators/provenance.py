"""Where features come from: families by name, the share of rows each source supplies, and the gate that live rows must pass."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts of names that mark a feature as made from market prices.
MARKET = ("betsapi_", "implied_prob", "market_prob", "fair_prob", "closing_prob", "line_move", "line_movement", "line_abs_movement", "line_direction_", "line_is_sharp", "steam_move", "_odds", "odds_")

#: Families in order, each with a pattern; the first that matches a name is its family. ``core`` is the name without a_, b_ or diff_.
FAMILIES = (
    ("market_odds", "name", r"implied_prob|_odds_prob$"),
    ("rankings", "name", r"rank"),
    ("physical_profile", "core", r"^(height|reach|weight|age|stance_enc|same_stance)$"),
    ("event_context", "core", r"^(weight_class_enc|is_title_bout|num_rounds_feat|is_empty_arena|wc_move)$"),
    ("historical_performance", "core", r"^roll_|^(current_win_streak|num_fights|days_since_last_fight|strike_diff|cage_rust|layoff_log)$"),
    ("career_record", "core", r"^(ko_rate|sub_rate|dec_rate|win_pct|lose_streak|longest_win_streak|total_rounds|title_bouts|wins|losses|draws)$"),
    ("amateur_history", "core", r"^amateur_"),
    ("pre_ufc_history", "core", r"^pre_ufc_"),
    ("experimental", "core", r"^(fight_pace|ctrl_efficiency|age_over_35|age_under_25|age_squared|ko_absorption|strikes_avoided_pct|opp_strength|pace_mismatch)$"),
    ("style_matchup", "core", r"^(striker_edge|grappler_edge)$"),
    ("rematch_h2h", "core", r"^(is_rematch|h2h_record_diff)$"),
)

#: What an experienced participant's row may lack four of at most, bouts from which that counts, and sources that are known.
CRITICAL = ("roll_slpm", "roll_sapm", "roll_str_acc", "roll_str_def", "roll_td_avg", "roll_td_acc", "roll_td_def", "roll_sub_avg", "win_pct", "height", "reach", "age", "stance_enc")
MAX_MISSING, MIN_BOUTS, SOURCES = 4, 2, ("processed", "ufcstats", "fallback")


def from_market(feature: str) -> bool:
    return any(part in feature.lower() for part in MARKET)


def without_market(features: list[str]) -> list[str]:
    """The features that no market price goes into, in their order."""
    return [f for f in features if not from_market(f)]


def family(feature: str) -> str:
    core = re.sub(r"^(diff|a|b)_", "", feature, count=1)
    return next((name for name, of, pattern in FAMILIES if re.search(pattern, core if of == "core" else feature)), "misc")


def selected(columns: list[str], base: list[str], additions: dict[str, list[str]], wanted: str) -> list[str]:
    """Columns of a named selection: ``production``, ``no_odds`` (production without market features), or production with one or more ``additions`` (names joined by +); only those that ``columns`` has, each once."""
    have = set(columns)
    out = [c for c in base if c in have]
    if wanted == "no_odds":
        return without_market(out)
    for name in [] if wanted == "production" else wanted.split("+"):
        if name not in additions:
            raise ValueError(f"unknown selection: {wanted!r}")
        out += [c for c in additions[name] if c in have]
    return list(dict.fromkeys(out))


def source_buckets(df: DataFrame, features: list[str], own: dict[str, Column], legacy: dict[str, Column]) -> DataFrame:
    """feature, family, rows whose value is own only, legacy only, mixed, from neither (a default) or unknown, and the sources seen; one pass over the rows."""
    count = lambda c: F.coalesce(F.sum(F.when(c, 1)), F.lit(0)).cast("long")
    no, parts = F.lit(False), []
    for f in features:
        known, o, g = F.col(f"`{f}`").isNotNull(), F.coalesce(own.get(f, no), no), F.coalesce(legacy.get(f, no), no)
        parts.append(F.struct(F.lit(f).alias("feature"), F.lit(family(f)).alias("family"), count(known & o & ~g).alias("own_only"), count(known & ~o & g).alias("legacy_only"), count(known & o & g).alias("mixed"), count(known & ~o & ~g).alias("defaults"), count(~known).alias("unknown")))
    out = df.agg(F.array(*parts).alias("x")).select(F.explode("x").alias("x")).select("x.*")
    seen = F.array_compact(F.array(F.when(F.col("own_only") + F.col("mixed") > 0, "own"), F.when(F.col("legacy_only") + F.col("mixed") > 0, "legacy"), F.when(F.col("defaults") > 0, "default")))
    return out.withColumn("sources", F.array_join(seen, ","))


def family_summary(df: DataFrame, features: list[str], own: dict[str, Column], legacy: dict[str, Column]) -> DataFrame:
    """family, n_features and rows in which any feature of it is known, any depends on legacy values, what is known is own alone, or comes from defaults alone; and the share of rows in which all are known."""
    no, groups, parts = F.lit(False), {}, []
    for f in features:
        groups.setdefault(family(f), []).append(f)
    count = lambda c: F.coalesce(F.sum(F.when(c, 1)), F.lit(0)).cast("long")
    for name, members in sorted(groups.items()):
        known = {f: F.col(f"`{f}`").isNotNull() for f in members}
        any_ = lambda of: F.greatest(*[of(f) for f in members], no)  # noqa: B023, E731
        o, g = (lambda f: F.coalesce(own.get(f, no), no)), (lambda f: F.coalesce(legacy.get(f, no), no))
        some, old, new = any_(lambda f: known[f]), any_(lambda f: known[f] & g(f)), any_(lambda f: known[f] & o(f))  # noqa: B023
        default = any_(lambda f: known[f] & ~o(f) & ~g(f))  # noqa: B023
        all_ = F.least(*known.values(), F.lit(True))
        parts.append(F.struct(F.lit(name).alias("family"), F.lit(len(members)).cast("long").alias("n_features"), count(some).alias("any_known"), count(old).alias("any_legacy"), count(some & new & ~old).alias("own_alone"), count(some & default & ~old & ~new).alias("defaults_alone"), F.coalesce(F.avg(all_.cast("double")), F.lit(0.0)).alias("complete")))
    return df.agg(F.array(*parts).alias("x")).select(F.explode("x").alias("x")).select("x.*") if parts else df.sparkSession.createDataFrame([], "family string, n_features long, any_known long, any_legacy long, own_alone long, defaults_alone long, complete double")


def live_gate(rows: DataFrame, critical: tuple[str, ...] = CRITICAL, max_missing: int = MAX_MISSING, least_bouts: int = MIN_BOUTS, refuse_fallback: bool = True) -> DataFrame:
    """``rows`` with a_missing and b_missing (critical features without a value), reasons and blocked.

    Rows have, for each side, source, history (its status), bouts, confirmed (identity) and the
    critical features as a_* and b_*. Reasons, side by side and in this order: identity_unconfirmed;
    no_source, or unsupported_source, and then nothing further; history_unavailable (of the
    statistics site); fallback_source; missing_features (only of the experienced).
    """
    missing = {f"{s}_missing": sum((F.when(F.col(f"{s}_{c}").isNull() | F.isnan(F.col(f"{s}_{c}").cast("double")), 1).otherwise(0) for c in critical), F.lit(0)) for s in "ab"}
    out = rows.withColumns(missing)
    found = []
    for s in "ab":
        source = F.lower(F.trim(F.coalesce(f"{s}_source", F.lit(""))))
        known = source.isin(*SOURCES)
        checks = [
            ("identity_unconfirmed", ~F.coalesce(f"{s}_confirmed", F.lit(False))), ("no_source", source == ""), ("unsupported_source", (source != "") & ~known),
            ("history_unavailable", (source == "ufcstats") & (F.lower(F.trim(F.coalesce(f"{s}_history", F.lit("")))) == "unavailable")), ("fallback_source", (source == "fallback") & F.lit(refuse_fallback)),
            ("missing_features", known & (F.coalesce(f"{s}_bouts", F.lit(0)) >= least_bouts) & (F.col(f"{s}_missing") > max_missing)),
        ]
        found += [F.when(c, f"{s}:{n}") for n, c in checks]
    return out.withColumn("reasons", F.array_compact(F.array(*found))).withColumn("blocked", F.size("reasons") > 0)
