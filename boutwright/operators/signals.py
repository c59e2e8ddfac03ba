"""Signals of short market windows: which side to take, or the first reason to stay out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Profile:
    """What a strategy asks for. ``style``: momentum, cheap_side or probability_capture; prices and spreads in the market's units, notionals in money, hours in ``timezone`` (empty: any hour unless weekdays alone count)."""

    style: str = "momentum"
    maker: bool = False
    entry_seconds: float = 60
    entry_tolerance: float = 30
    timezone: str = ""
    weekdays_only: bool = False
    start_hour: float = 0
    end_hour: float = 24
    min_move: float = 20
    min_support: float = 0.55
    min_price: float = 0.05
    max_price: float = 0.95
    max_gap: float = 0.0
    max_spread: float = 0.05
    max_spread_share: float = 0.0
    min_top: float = 10
    min_total: float = 50


def _first(gates: list[tuple[str, Column]]) -> Column:
    """The name of the first gate whose condition is true; ``trade`` if none is."""
    out = None
    for name, stops in gates:
        out = F.when(stops, name) if out is None else out.when(stops, name)
    return out.otherwise("trade")


def signals(rows: DataFrame, p: Profile) -> DataFrame:
    """``rows`` with direction, support, entry_price, spread and reason (``trade``, or why not).

    Rows have at, window_end, active, closed, accepting, move, and for up and down the quote
    (price_*), best bid and ask (*_bid, *_ask) and the notional of the top ask and of all asks
    (*_top, *_total). The support of a side is the middle of its book, else its quote. Momentum
    follows the move; cheap_side takes the lower ask; probability_capture the better supported side
    that has an ask (up, of equal ones).
    """
    c = F.col
    left = (F.unix_micros(c("window_end").cast("timestamp")) - F.unix_micros(c("at").cast("timestamp"))) / 1e6
    side = lambda s: F.struct(F.lit(s).alias("direction"), c(f"{s}_bid").alias("bid"), c(f"{s}_ask").alias("ask"), F.coalesce((c(f"{s}_bid") + c(f"{s}_ask")) / 2, c(f"price_{s}")).alias("support"), (c(f"{s}_ask") - c(f"{s}_bid")).alias("spread"), c(f"{s}_top").alias("top"), c(f"{s}_total").alias("total"))
    up, down = side("up"), side("down")
    if p.style == "momentum":
        taken = F.when(c("move") > 0, up).otherwise(down)
    else:
        key = (lambda x: -x["ask"]) if p.style == "cheap_side" else (lambda x: x["support"])
        usable = (lambda x: x["ask"] > 0) if p.style == "cheap_side" else (lambda x: x["ask"].isNotNull() & x["support"].isNotNull())
        ok_up, ok_down = F.coalesce(usable(up), F.lit(False)), F.coalesce(usable(down), F.lit(False))
        taken = F.when(ok_up & (~ok_down | (key(up) >= key(down))), up).when(ok_down, down)
    out = rows.withColumn("__x", taken)
    x = {n: c(f"__x.{n}") for n in ("direction", "bid", "ask", "support", "spread", "top", "total")}
    price = x["bid"] if p.maker else x["ask"]
    local = F.from_utc_timestamp(c("at").cast("timestamp"), p.timezone or "UTC")
    hour = F.hour(local) + F.minute(local) / 60 + F.second(local) / 3600
    gates = [("market_closed", left <= 0), ("market_not_tradeable", ~c("active") | c("closed") | ~c("accepting")), ("outside_entry_window", F.abs(left - p.entry_seconds) > p.entry_tolerance)]
    if p.timezone or p.weekdays_only:
        weekend = F.weekday(local) >= 5 if p.weekdays_only else F.lit(False)
        gates.append(("outside_trading_hours", weekend | (hour < p.start_hour) | (hour >= p.end_hour)))
    supported = [("missing_market_price", x["support"].isNull()), ("skew_not_supportive", x["support"] < p.min_support)]
    range_ = [("entry_price_too_low", price < p.min_price), ("entry_price_too_high", price > p.max_price)]
    if p.style == "momentum":
        gates += [("insufficient_impulse", F.abs("move") < p.min_move), ("flat_impulse", F.abs("move") <= 1e-9), *supported, ("no_ask", x["ask"].isNull())]
    elif p.style == "cheap_side":
        gates.append(("no_ask", x["direction"].isNull()))
        range_ = [("cheap_side_out_of_range", (price < p.min_price) | (price > p.max_price))]
    else:
        gates += supported
    gates += [("no_entry_price", price.isNull()), ("invalid_entry_price", price <= 0), *range_]
    if p.style == "probability_capture" and p.max_gap > 0:
        gates.append(("entry_support_gap_too_wide", price - x["support"] > p.max_gap))
    gates += [("missing_spread", x["spread"].isNull()), ("spread_too_wide", x["spread"] > p.max_spread)]
    if p.max_spread_share > 0:
        gates.append(("relative_spread_too_wide", x["spread"] > price * p.max_spread_share))
    gates += [("thin_top_ask", x["top"] < p.min_top), ("thin_book", x["total"] < p.min_total)]
    return out.withColumns({"reason": _first(gates), "direction": x["direction"], "support": x["support"], "entry_price": price, "spread": x["spread"]}).drop("__x")
