"""Whether a candidate may replace the control: the selection gate of models and the trading bar of strategies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .evaluation import calibration_bins, calibration_error, losses

#: Worst relative change of a core metric, of a year's metric, least rows of the fresh window, least share of a slice, worst drawdown as a multiple, slack of the closing-line value, weakest bootstrap evidence.
CORE, YEARLY, FRESH_ROWS, SLICE, DRAWDOWN, CLV_SLACK, ALPHA = 0.05, 0.10, 20, 0.10, 2.0, 0.01, 0.25


def arm_metrics(scores: DataFrame, keys: list[str], y: str = "target", p: str = "prob", weight: str | None = None) -> DataFrame:
    """n, brier, log_loss, accuracy and ece by ``keys``; a row stands for ``weight`` rows."""
    return losses(scores, keys, y, p, weight).join(calibration_error(calibration_bins(scores, keys, y, p, weight=weight), keys), keys)


def _relative(new: Column, old: Column) -> Column:
    return F.try_divide(new - old, old)


def selection_gate(scores: DataFrame, control: str, bucket: str, fresh_days: int = 180, date: str = "event_date") -> DataFrame:
    """candidate, one verdict for each gate, passed and score, for every arm but ``control``.

    ``scores`` has a row an arm and bout: arm, date, target, prob and the slice column ``bucket``.
    calibration_improvement: Brier or calibration error fell. no_material_degradation: no core metric
    is worse by more than a twentieth. fresh_data_credibility: the last ``fresh_days`` of the data
    have enough rows and no worse Brier. year_by_year_stability: no year's Brier or calibration error
    is worse by more than a tenth. not_slice_driven: the arm beats the control's Brier in a slice
    that holds a tenth of its rows, if it beats it in any. not_accuracy_only: accuracy does not rise
    alone. The score is the sum of the relative falls of Brier and calibration error less the rise of
    the log loss.
    """
    core = arm_metrics(scores, ["arm"])
    c = core.where(F.col("arm") == control).select(*[F.col(m).alias(f"c_{m}") for m in ("brier", "log_loss", "accuracy", "ece")])
    x = core.where(F.col("arm") != control).join(F.broadcast(c))  # one row beside one row an arm
    end = scores.agg(F.max(F.to_date(date)).alias("end"))
    fresh = losses(scores.join(F.broadcast(end)).where(F.to_date(date) > F.date_sub("end", fresh_days)), ["arm"], "target", "prob").select("arm", F.col("n").alias("fresh_n"), F.col("brier").alias("fresh_brier"))
    own = fresh.where(F.col("arm") == control).select(F.col("fresh_brier").alias("c_fresh"))
    years = arm_metrics(scores.withColumn("year", F.year(date)), ["arm", "year"])
    before = years.where(F.col("arm") == control).select("year", F.col("brier").alias("cb"), F.col("ece").alias("ce"))
    worst = years.where(F.col("arm") != control).join(before, "year").groupBy("arm").agg(F.max(F.greatest(_relative(F.col("brier"), F.col("cb")), _relative(F.col("ece"), F.col("ce")))).alias("worst_year"))
    parts = losses(scores, ["arm", bucket], "target", "prob").join(F.broadcast(c.select("c_brier")))
    total = losses(scores, ["arm"], "target", "prob").select("arm", F.col("n").alias("total"))
    slices = parts.where("brier < c_brier").join(total, "arm").groupBy("arm").agg(F.max(F.col("n") / F.col("total")).alias("widest"))
    x = x.join(fresh, "arm", "left").join(F.broadcast(own), how="left").join(worst, "arm", "left").join(slices, "arm", "left")
    rel = {m: _relative(F.col(m), F.col(f"c_{m}")) for m in ("brier", "log_loss", "ece", "accuracy")}
    better = (rel["brier"] < 0) | (rel["ece"] < 0)
    bad = F.greatest(rel["brier"], rel["log_loss"], rel["ece"], -rel["accuracy"])
    gates = {
        "calibration_improvement": better,
        "no_material_degradation": bad <= CORE,
        "fresh_data_credibility": (F.coalesce("fresh_n", F.lit(0)) >= FRESH_ROWS) & F.coalesce(F.col("fresh_brier") <= F.col("c_fresh"), F.lit(True)),
        "year_by_year_stability": F.coalesce(F.col("worst_year") <= YEARLY, F.lit(True)),
        "not_slice_driven": F.coalesce(F.col("widest") >= SLICE, F.lit(True)),
        "not_accuracy_only": ~((F.col("accuracy") > F.col("c_accuracy")) & ~better),
    }
    out = x.select(F.col("arm").alias("candidate"), *[F.coalesce(g, F.lit(False)).alias(n) for n, g in gates.items()], (-rel["brier"] - rel["ece"] - F.greatest(F.lit(0.0), rel["log_loss"])).alias("score"))
    passed = None
    for n in gates:
        passed = F.col(n) if passed is None else passed & F.col(n)
    return out.withColumn("passed", passed)


def trading_bar(arms: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """``arms`` with failures (array) and trading_bar.

    Rows have new_* and old_* roi, profit, drawdown and clv, and p_value of the paired bootstrap by
    events (null: not known, and no obstacle). Fails: no_gain (neither return nor profit rose),
    indistinct (the bootstrap cannot tell the arms apart; asked only where there is a gain),
    drawdown (over twice the old one, where there was one), closing_line (over a point worse).
    """
    gain = F.coalesce((F.col("new_roi") > F.col("old_roi")) | (F.col("new_profit") > F.col("old_profit")), F.lit(False))
    found = {
        "no_gain": ~gain,
        "indistinct": gain & (F.col("p_value") > alpha),
        "drawdown": (F.col("old_drawdown") > 0) & (F.col("new_drawdown") > DRAWDOWN * F.col("old_drawdown")),
        "closing_line": F.col("new_clv") < F.col("old_clv") - CLV_SLACK,
    }
    failures = F.array_compact(F.array(*[F.when(c, n) for n, c in found.items()]))
    return arms.withColumn("failures", failures).withColumn("trading_bar", F.size("failures") == 0)
