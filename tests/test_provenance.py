"""Feature selections by name, and counts of sources on an empty frame."""

import pytest
from pyspark.sql import functions as F

from boutwright.operators import provenance as P


def test_families_and_selections():
    names = {"a_implied_prob": "market_odds", "b_rank": "rankings", "diff_reach": "physical_profile", "b_wc_move": "event_context", "a_roll_slpm": "historical_performance", "diff_num_fights": "historical_performance", "win_pct": "career_record", "amateur_wins": "amateur_history", "b_pre_ufc_wins": "pre_ufc_history", "age_squared": "experimental", "grappler_edge": "style_matchup", "is_rematch": "rematch_h2h", "line_movement": "misc"}
    assert {n: P.family(n) for n in names} == names
    base = ["x", "a_implied_prob", "line_movement", "gone"]
    cols = ["x", "a_implied_prob", "line_movement", "r1", "h1", "y"]
    more = {"refreshed": ["r1", "r2"], "history": ["h1", "x"]}
    assert P.selected(cols, base, more, "production") == ["x", "a_implied_prob", "line_movement"]
    assert P.selected(cols, base, more, "no_odds") == ["x"]
    assert P.selected(cols, base, more, "refreshed+history") == ["x", "a_implied_prob", "line_movement", "r1", "h1"]
    with pytest.raises(ValueError):
        P.selected(cols, base, more, "other")


def test_sources_of_an_empty_frame(spark):
    df = spark.createDataFrame([], "a_roll_x double, b double")
    got = P.source_buckets(df, ["a_roll_x", "b"], {"b": F.lit(True)}, {}).collect()
    assert [tuple(r)[2:] for r in got] == [(0, 0, 0, 0, 0, "")] * 2
    assert [(r.any_known, r.complete) for r in P.family_summary(df, ["a_roll_x", "b"], {}, {}).collect()] == [(0, 0.0)] * 2
    assert P.family_summary(df, [], {}, {}).collect() == []
