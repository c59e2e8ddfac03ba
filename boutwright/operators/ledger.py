"""Bet ledgers and their audits: summaries that admit unknown costs, positions, edge and volume checks, staleness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ledger_summary(bets: DataFrame, keys: list[str]) -> DataFrame:
    """Counts, wagered, realised and unrealised profit and closing-line value.

    Bets have status (won, lost, open, pending), cost, shares, price (current), pnl, clv. A total that
    needs an unknown cost is null, not smaller; pending bets are not funded and hold no exposure.
    """
    c, settled, open_ = F.col, F.col("status").isin("won", "lost"), F.col("status") == "open"
    count = lambda x: F.count(F.when(x, 1))
    out = bets.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), count(open_ | (c("status") == "pending")).alias("n_open"), count(settled).alias("n_settled"), count(c("status") == "won").alias("wins"),
        count(settled & c("cost").isNull()).alias("settled_unknown"), count(open_ & c("cost").isNull()).alias("open_unknown"),
        F.coalesce(F.sum(F.when(settled, c("cost"))), F.lit(0.0)).alias("__w"), F.coalesce(F.sum(F.when(settled & c("cost").isNotNull(), c("pnl"))), F.lit(0.0)).alias("__r"),
        F.coalesce(F.sum(F.when(open_, c("shares") * c("price") - c("cost"))), F.lit(0.0)).alias("__u"), F.coalesce(F.sum(F.when(open_, c("cost"))), F.lit(0.0)).alias("__o"),
        F.avg("clv").alias("avg_clv"), F.count("clv").alias("n_clv"), F.avg((c("clv") > 0).cast("double")).alias("positive_clv"),
    )
    sure, open_sure = c("settled_unknown") == 0, c("open_unknown") == 0
    return out.select(
        *keys, "n", "n_open", "n_settled", "wins", F.when(c("n_settled") > 0, c("wins") / c("n_settled")).otherwise(0.0).alias("win_rate"),
        F.when(sure, c("__w")).alias("wagered"), F.when(sure, c("__r")).alias("realised"), F.when(open_sure, c("__u")).alias("unrealised"), F.when(sure & open_sure, c("__r") + c("__u")).alias("total"),
        F.when(sure, F.when(c("__w") > 0, c("__r") / c("__w")).otherwise(0.0)).alias("roi"), F.when(open_sure, c("__o")).alias("open_invested"), "settled_unknown", "open_unknown", "avg_clv", "n_clv", "positive_clv",
    )


def positions(bets: DataFrame, token: str) -> DataFrame:
    """One position a token: shares, cost, average price, value and profit at the current price; null cost where any part's is unknown."""
    known = F.every(F.col("cost").isNotNull())
    out = bets.groupBy(token).agg(F.count(F.lit(1)).alias("n_bets"), F.sum("shares").alias("shares"), F.when(known, F.sum("cost")).alias("cost"), F.max("price").alias("price"))
    value = F.col("shares") * F.col("price")
    return out.withColumns({"avg_price": F.when(F.col("shares") > 0, F.col("cost") / F.col("shares")), "value": value, "profit": value - F.col("cost"), "profit_share": F.when(F.col("cost") > 0, (value - F.col("cost")) / F.col("cost"))})


def hold_or_exit(paths: DataFrame, keys: list[str]) -> DataFrame:
    """Profit of selling each position at its exit price against holding it to settlement; paths have shares, cost, exit_price (null: never), payout."""
    held = F.col("payout") * F.col("shares") - F.col("cost")
    sold = F.when(F.col("exit_price").isNotNull(), F.col("exit_price") * F.col("shares") - F.col("cost")).otherwise(held)
    return paths.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count("exit_price").alias("n_exits"), F.sum(sold).alias("exit_pnl"), F.sum(held).alias("hold_pnl"), F.sum(sold - held).alias("gain"), F.avg((sold > held).cast("double")).alias("better_share"))


def edge_check(bets: DataFrame, keys: list[str], least: int = 30) -> DataFrame:
    """Claimed against realised edge: z of the gap over per-bet returns from ``least`` bets on, else a gap of 0.05."""
    rate = F.col("pnl") / F.col("stake")
    out = bets.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("edge").alias("claimed"), F.when(F.sum("stake") > 0, F.sum("pnl") / F.sum("stake")).otherwise(0.0).alias("realised"), F.stddev_samp(rate).alias("__sd"))
    gap = F.col("realised") - F.col("claimed")
    z = F.when((F.col("n") >= least) & (F.col("__sd") > 0), gap / (F.col("__sd") / F.sqrt("n")))
    high, low = F.coalesce(z > 3, gap > 0.05), F.coalesce(z < -3, gap < -0.05)
    return out.withColumns({"gap": gap, "z": z, "verdict": F.when(high, "suspiciously_high").when(low, "execution_drag").otherwise("consistent")}).drop("__sd")


def volume_check(candidate: DataFrame, baseline: DataFrame, trader: str = "C") -> DataFrame:
    """Bets and stakes of a candidate against a baseline: flags half as many bets again, and one trader over 40 % of the volume."""
    a = candidate.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("stake"), F.lit(0.0)).alias("staked"), F.coalesce(F.sum(F.when(F.col("trader") == trader, F.col("stake"))), F.lit(0.0)).alias("__t"), F.count(F.when(F.col("trader") == trader, 1)).alias("trader_bets"))
    b = baseline.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("base_n"), F.coalesce(F.sum("stake"), F.lit(0.0)).alias("base_staked"))
    out = a.crossJoin(b)  # one row each
    share, ratio = F.when(F.col("staked") > 0, F.col("__t") / F.col("staked")).otherwise(0.0), F.col("n") / F.col("base_n")
    return out.withColumns({"ratio": ratio, "trader_share": share, "excess_bets": ratio > 1.5, "overexposed": share > 0.4}).drop("__t")


def trader_audit(bets: DataFrame, trader: str = "C", other: str = "S") -> DataFrame:
    """One trader's share of underdogs, marginal long odds and win rate beside the other's, with flags."""
    own = F.col("trader") == trader
    rate = lambda t: F.avg(F.when(F.col("trader") == t, F.col("won")))
    out = bets.agg(F.count(F.when(own, 1)).alias("n"), F.avg(F.when(own, (F.col("market") < 0.4).cast("double"))).alias("underdog_share"), F.count(F.when(own & (F.col("odds") > 3) & (F.col("prob") < 0.7), 1)).alias("n_marginal"), rate(trader).alias("win_rate"), rate(other).alias("other_rate"))
    return out.withColumns({"marginal": F.col("n_marginal") > 0, "low_win_rate": F.coalesce(F.col("win_rate") < F.col("other_rate") - 0.1, F.lit(False)), "underdog_heavy": F.coalesce(F.col("underdog_share") > 0.5, F.lit(False))})


def stale_predictions(saved: DataFrame, now: DataFrame, key: str, moved: float = 0.03, hours: float = 12.0) -> DataFrame:
    """key, stale and why: the first of no prediction, another contract, too old, or prices moved by more than ``moved``.

    Saved rows have made_at, contract, a_market; current rows asked_at, contract, a_market.
    """
    s = saved.select(key, F.col("made_at"), F.col("contract").alias("__c"), F.col("a_market").alias("__m"))
    out = now.join(s, key, "left")
    age = (F.unix_micros(F.col("asked_at").cast("timestamp")) - F.unix_micros(F.col("made_at").cast("timestamp"))) / 3.6e9
    why = F.when(F.col("made_at").isNull(), "missing").when(~F.col("__c").eqNullSafe(F.col("contract")), "contract").when(age > hours, "age").when(F.abs(F.col("a_market") - F.col("__m")) > moved, "odds")
    return out.select(key, why.isNotNull().alias("stale"), why.alias("reason"))


def closing_capture(bets: DataFrame, prices: DataFrame, token: str, minutes: float = 10.0) -> DataFrame:
    """The last price of each bet's token within ``minutes`` before its start, and the closing-line value it gives.

    Bets have bet_id, starts_at, fill; prices at, price. Prices and bets of a token meet on a time line.
    """
    m = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    p = prices.select(token, m("at").alias("t"), F.lit(0).alias("kind"), F.struct(m("at").alias("t"), "price").alias("p"), F.lit(None).cast("long").alias("bet_id"), F.lit(None).cast("double").alias("fill"))
    b = bets.select(token, m("starts_at").alias("t"), F.lit(1).alias("kind"), F.lit(None).cast(p.schema["p"].dataType).alias("p"), "bet_id", "fill")
    w = Window.partitionBy(token).orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, -1)
    last = p.unionByName(b).withColumn("last", F.last("p", ignorenulls=True).over(w)).where("kind = 1")
    near = F.when(F.col("t") - F.col("last.t") <= minutes * 6e7, F.col("last.price"))
    return last.select("bet_id", near.alias("closing"), F.when(near > 0, near / F.col("fill") - 1).alias("clv"))


def activity_key(df: DataFrame) -> Column:
    """Identity of an activity row: its transaction with token, side and sizes, else its time."""
    return F.concat_ws("|", F.coalesce(F.lower("tx"), F.col("at").cast("string")), "token", "side", F.col("size").cast("string"), F.col("price").cast("string"))
