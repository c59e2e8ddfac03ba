"""Bout statistics to rates, rolled rates to matchup features. Unknown stays null; nothing divides by less than its floor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .history import before, differences, entity, whole_keys

#: Statistics of a bout that are rolled, in the contract's order.
BASE = ("slpm", "sapm", "str_acc", "str_def", "td_avg", "td_acc", "td_def", "sub_avg", "sig_str_landed", "sig_str_attempted", "td_landed", "td_attempted", "kd", "sub_att", "rev", "ctrl_seconds")
EXTENDED = ("head_str_share", "body_str_share", "leg_str_share", "distance_str_share", "clinch_str_share", "ground_str_share", "control_share", "control_per_td", "distance_acc", "clinch_acc", "ground_acc")
ROLLED = (*BASE, *EXTENDED, *[f"opp_{s}" for s in (*BASE, *EXTENDED)], "won")
#: Stances and their codes.
STANCES = {"orthodox": 0.0, "southpaw": 1.0, "switch": 2.0, "open stance": 3.0, "sideways": 4.0}


def per_minute(value: Column, minutes: Column, scale: float = 1.0) -> Column:
    return F.when(minutes > 0, value / minutes * scale)


def share(part: Column, whole: Column, scale: float = 1.0) -> Column:
    return F.when(whole > 0, part / whole * scale)


def defence(landed: Column, attempted: Column) -> Column:
    """Share of the opponent's attempts that missed, in percent."""
    return F.when(attempted > 0, (1 - landed / attempted) * 100)


def side_rates(own: str, opp: str, minutes: Column) -> dict[str, Column]:
    """Rates of one side of a bout whose raw counts carry the prefixes ``own`` and ``opp``."""
    me, you = (lambda p: lambda n: F.col(f"{p}{n}"))(own), (lambda p: lambda n: F.col(f"{p}{n}"))(opp)
    out = {
        "slpm": per_minute(me("sig_str_landed"), minutes),
        "sapm": per_minute(you("sig_str_landed"), minutes),
        "str_acc": share(me("sig_str_landed"), me("sig_str_attempted"), 100.0),
        "str_def": defence(you("sig_str_landed"), you("sig_str_attempted")),
        "td_avg": per_minute(me("td_landed"), minutes, 15.0),
        "td_acc": share(me("td_landed"), me("td_attempted"), 100.0),
        "td_def": defence(you("td_landed"), you("td_attempted")),
        "sub_avg": per_minute(me("sub_att"), minutes, 15.0),
        "total_str_pm": per_minute(me("total_str_landed"), minutes),
        "sig_str_share": share(me("sig_str_landed"), me("total_str_landed")),
        "control_share": share(me("ctrl_seconds"), minutes * 60),
        "control_per_td": share(me("ctrl_seconds"), me("td_landed")),
        "finish_threat": per_minute(F.coalesce(me("kd"), F.lit(0.0)) + F.coalesce(me("sub_att"), F.lit(0.0)), minutes),
    }
    out |= {f"{place}_str_share": share(me(f"{place}_landed"), me("sig_str_landed")) for place in ("head", "body", "leg", "distance", "clinch", "ground")}
    out |= {f"{place}_acc": share(me(f"{place}_landed"), me(f"{place}_attempted")) for place in ("distance", "clinch", "ground")}
    return out | {c: me(c) for c in BASE if c not in out}


def participant_rows(bouts: DataFrame, minutes: Column, carried: tuple[str, ...] = ("weight_class", "method", "n_rounds")) -> DataFrame:
    """Two rows a bout: own rates, the opponent's as opp_*, result and won."""

    def side(s: str, o: str) -> Column:
        own, opp = side_rates(f"{s}_", f"{o}_", minutes), side_rates(f"{o}_", f"{s}_", minutes)
        me, you = F.col(f"{s}_id"), F.col(f"{o}_id")
        result = F.when(F.col("winner") == me, "win").when(F.col("winner") == you, "loss").otherwise("draw")
        cols = [F.lit(s).alias("side"), me.alias("entity"), you.alias("opponent"), result.alias("result"), (result == "win").cast("double").alias("won")]
        return F.struct(*cols, *[own[c].cast("double").alias(c) for c in own], *[opp[c].cast("double").alias(f"opp_{c}") for c in (*BASE, *EXTENDED)])

    both = F.explode(F.array(side("a", "b"), side("b", "a"))).alias("x")
    return bouts.select("fight_id", "event_date", *carried, both).select("fight_id", "event_date", *carried, "x.*")


def rolled(rows: DataFrame, stats: tuple[str, ...] = ROLLED, half_life: float = 3.0, block: int = 240, keep: tuple[str, ...] | None = None) -> DataFrame:
    """roll_* of every statistic: exponentially weighted means of strictly earlier rows; positions of unknown values count.

    Powers of two of a position would overflow along a career, so positions are cut into blocks.
    A row adds up its own block's earlier rows and the block before; what is older weighs less
    than the last bit of a double. One sort and one shuffle serve all statistics. More than ``WIDE``
    statistics, which would be hundreds of windows, go through one pass over the sorted rows instead.
    ``keep`` names the columns of ``rows`` that are returned (all, if it is not given).
    """
    keep = tuple(rows.columns) if keep is None else keep
    if len(stats) > WIDE:
        return _rolled_wide(rows, stats, half_life, keep)
    at = rows.withColumn("__i", F.row_number().over(entity()) - 1)
    at = at.withColumn("__b", F.floor(F.col("__i") / block)).withColumn("__p", F.pow(F.lit(2.0), (F.col("__i") % block) / half_life))
    own = Window.partitionBy("entity", "__b").orderBy("__i").rowsBetween(Window.unboundedPreceding, -1)
    older = Window.partitionBy("entity").orderBy("__b").rangeBetween(-1, -1)
    fade, none = 2.0 ** (-block / half_life), F.lit(0.0)

    def total(x: Column) -> Column:
        return F.coalesce(F.sum(x).over(own), none) + F.coalesce(F.sum(x).over(older), none) * fade

    means = []
    for s in stats:
        weight = total(F.when(F.col(s).isNotNull(), F.col("__p")))
        means.append(F.when(weight > 0, total(F.col(s) * F.col("__p")) / weight).alias(f"__m_{s}"))
    out = at.select(*rows.columns, *means)
    # between unknown values the mean stands still: a whole block of them takes the last known one
    still = [F.coalesce(F.col(f"__m_{s}"), F.last(f"__m_{s}", ignorenulls=True).over(before())).alias(f"roll_{s}") for s in stats]
    return out.select(*keep, *still)


#: From how many statistics on sums are carried along the sorted rows instead of by windows.
WIDE = 8


#: Rows of one participant whose sums are made by one product of matrices.
STEP = 64


def _faded_means(values, half_life: float):
    """Decayed means of the rows before each row of one participant; where nothing is new the mean stands still, however far its sums have faded."""
    import numpy as np

    (n, k), fade = values.shape, 0.5 ** (1 / half_life)
    known = ~np.isnan(values)
    both, sums, carried = np.concatenate((np.where(known, values, 0.0), known), axis=1), np.empty((n, 2 * k)), np.zeros(2 * k)
    ahead = np.arange(STEP + 1)[:, None] - np.arange(STEP)
    weight, left = np.where(ahead > 0, fade ** np.maximum(ahead, 0), 0.0), fade ** np.arange(STEP + 1)[:, None]
    for a in range(0, n, STEP):
        m = min(STEP, n - a)
        out = weight[: m + 1, :m] @ both[a : a + m] + left[: m + 1] * carried
        sums[a : a + m], carried = out[:m], out[m]
    fresh = np.zeros((n, k), bool)
    fresh[1:] = known[:-1]
    mean = np.full((n, k), np.nan)
    np.divide(sums[:, :k], sums[:, k:], out=mean, where=fresh)
    return np.take_along_axis(mean, np.maximum.accumulate(np.where(fresh, np.arange(n)[:, None], 0), axis=0), axis=0)


def _rolled_wide(rows: DataFrame, stats: tuple[str, ...], half_life: float, keep: tuple[str, ...]) -> DataFrame:
    """As ``rolled``, by sums that are carried along the sorted rows; a task keeps the rows of some participants."""
    import numpy as np
    import pyarrow as pa
    from pyspark.sql import types as T

    k = len(stats)

    def run(batches):
        for t, starts in whole_keys(batches):
            values = np.stack([t.column(f"v{j}").to_numpy() for j in range(k)], axis=1)
            means = np.concatenate([_faded_means(values[a:b], half_life).T for a, b in zip(starts, starts[1:])], axis=1)
            yield pa.RecordBatch.from_arrays([t.column("row").combine_chunks(), *(pa.array(m, from_pandas=True) for m in means)], ["row", *names])

    names = [f"roll_{s}" for s in stats]
    # what the pass reads is made after the sort, so only the kept columns and the statistics are shuffled
    ordered = rows.repartition("entity").sortWithinPartitions("entity", "event_date", "fight_id")
    src = ordered.select(F.struct(*keep).alias("row"), F.to_json(F.struct("entity")).alias("key"), *[F.col(s).cast("double").alias(f"v{j}") for j, s in enumerate(stats)])
    schema = T.StructType([src.schema["row"], *[T.StructField(n, T.DoubleType()) for n in names]])
    return src.mapInArrow(run, schema).select("row.*", *names)


def stance_code(s: Column) -> Column:
    """Code of a stance label; white space and case do not matter, unknown labels have none."""
    plain = F.trim(F.regexp_replace(F.lower(s), r"\s+", " "))
    return F.element_at(F.create_map(*[F.lit(x) for kv in STANCES.items() for x in kv]), plain)


def context(df: DataFrame) -> DataFrame:
    """Title bout, rounds, arena and ranks as numbers; unknown is never rewritten as a default."""
    from ..functions.scalars import nullable_binary

    def number(c: str) -> Column:
        return F.col(c).cast("string").try_cast("double")

    ranks = {f"{s}_{k}_rank_feat": number(f"{s}_{k}_rank") for s in "ab" for k in ("wc", "pfp")}
    out = df.withColumns({"is_title_bout": nullable_binary(F.col("title_bout").cast("string")), "num_rounds_feat": number("num_rounds"), "is_empty_arena": nullable_binary(F.col("empty_arena").cast("string")), **ranks})
    return out.withColumns({f"diff_{k}_rank": F.col(f"a_{k}_rank_feat") - F.col(f"b_{k}_rank_feat") for k in ("wc", "pfp")})


def matchup(df: DataFrame) -> DataFrame:
    """Derived features of a bout from a_* and b_* rolled statistics, counters and ages.

    Finish rates over wins, win share, layoff flags, style edges, pace, control efficiency, age
    curve, knockdowns taken and strikes avoided, each with its difference.
    """
    c = F.col
    own: dict[str, Column] = {}
    for s, o in (("a", "b"), ("b", "a")):
        wins, days, age = c(f"{s}_wins"), c(f"{s}_days_since"), c(f"{s}_age")
        attempts, control = c(f"{s}_roll_opp_sig_str_attempted"), c(f"{s}_roll_ctrl_seconds")
        own |= {f"{s}_{m}_rate": F.when(wins != 0, c(f"{s}_wins_{m}") / wins) for m in ("ko", "sub", "dec")}
        own |= {
            f"{s}_win_pct": F.when(wins + c(f"{s}_losses") != 0, wins / (wins + c(f"{s}_losses"))),
            f"{s}_cage_rust": (days > 365).cast("double"),
            f"{s}_layoff_log": F.log1p(days),
            f"{s}_striker_edge": own[f"{s}_ko_rate"] * (1 - c(f"{o}_roll_str_def") / 100),
            f"{s}_grappler_edge": own[f"{s}_sub_rate"] * (1 - c(f"{o}_roll_td_def") / 100),
            f"{s}_fight_pace": c(f"{s}_roll_slpm") + c(f"{s}_roll_sapm"),
            # greatest() would turn an unknown control time into its floor
            f"{s}_ctrl_efficiency": c(f"{s}_roll_sig_str_landed") / F.when(control.isNotNull(), F.greatest(control, F.lit(1.0))),
            f"{s}_age_over_35": (age > 35).cast("double"),
            f"{s}_age_under_25": (age < 25).cast("double"),
            f"{s}_age_squared": age * age,
            f"{s}_ko_absorption": c(f"{s}_roll_opp_kd"),
            f"{s}_strikes_avoided_pct": F.when(attempts != 0, 1 - c(f"{s}_roll_opp_sig_str_landed") / attempts),
        }
    out = differences(df.withColumns(own), [k[2:] for k in own if k.startswith("a_")])
    return out.withColumn("pace_mismatch", F.abs(c("a_fight_pace") - c("b_fight_pace")))


#: Derived features that matchup() adds for each side, in order.
DERIVED = ("ko_rate", "sub_rate", "dec_rate", "win_pct", "cage_rust", "layoff_log", "striker_edge", "grappler_edge", "fight_pace", "ctrl_efficiency", "age_over_35", "age_under_25", "age_squared", "ko_absorption", "strikes_avoided_pct")
