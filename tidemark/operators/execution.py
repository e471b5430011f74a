"""Order, fill, cost and entitlement tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators.asof import asof_backward, tier_on

# Execution defaults.
LOT, COMMISSION, MIN_COMMISSION, SLIPPAGE_BPS = 100, 0.00025, 5.0, 5.0
IMPACT_COEFFICIENT, VOLATILITY_FLOOR, MAX_IMPACT_BPS, PARTICIPATION = 0.50, 0.10, 50.0, 0.05
LIMIT_BAND = 0.005


def impact_bps(
    volatility: Column, participation: Column, coefficient: float = IMPACT_COEFFICIENT,
    floor: float = VOLATILITY_FLOOR, cap: float = MAX_IMPACT_BPS,
) -> Column:
    """Square-root market impact in basis points; missing volatility takes the floor."""
    sigma = F.greatest(F.coalesce(volatility, F.lit(floor)), F.lit(floor)) / F.lit(math.sqrt(252.0))
    raw = F.lit(coefficient) * sigma * F.sqrt(F.greatest(participation, F.lit(0.0))) * 10000.0
    return F.greatest(F.lit(0.0), F.least(F.lit(cap), raw))


def classify_orders(orders: DataFrame, bars: DataFrame, securities: DataFrame, reject_st: bool = True) -> DataFrame:
    """Why an order cannot execute that day (empty text: it can), first reason wins."""
    b = bars.select("date", "symbol", "open", "volume", "is_st", "up_limit", "down_limit")
    s = securities.select("symbol", "list_date", "delist_date")
    df = orders.join(b, ["symbol", "date"], "left").join(s, "symbol", "left")
    buy, sell = F.col("side") == "BUY", F.col("side") == "SELL"
    reason = (
        F.when(F.col("date") < F.col("list_date"), "not_listed")
        .when(F.col("date") > F.col("delist_date"), "delisted")
        .when(F.col("volume").isNull() | (F.col("volume") <= 0), "suspended_or_no_bar")
        .when(buy & F.lit(reject_st) & F.col("is_st"), "st_on_execution")
        .when(buy & (F.col("open") >= F.col("up_limit") - LIMIT_BAND), "open_at_up_limit")
        .when(sell & (F.col("open") <= F.col("down_limit") + LIMIT_BAND), "open_at_down_limit")
        .otherwise("")
    )
    return df.withColumn("reason", reason)


def target_shares(selection: DataFrame, lot: int = LOT) -> DataFrame:
    """Whole-lot shares that a weight buys at the signal close."""
    return selection.withColumn(
        "target_shares",
        S.floor_lot(F.col("target_weight") * F.col("equity") / F.nullif(F.col("signal_close"), F.lit(0.0)), lot),
    )


def quote(orders: DataFrame, slippage_bps: float = SLIPPAGE_BPS) -> DataFrame:
    """Reference open -> modelled price inside the day's limits, and realised slippage.

    Needs side, shares, open, up_limit, down_limit, lagged_adv20, signal_volatility.
    """
    adv = F.col("lagged_adv20")
    part = F.when(adv > 0, F.greatest(F.col("shares") * F.col("open") / adv, F.lit(0.0))).otherwise(0.0)
    buy = F.col("side") == "BUY"
    df = orders.withColumn("participation_rate", part)
    df = df.withColumn("market_impact_bps", impact_bps(F.col("signal_volatility"), F.col("participation_rate")))
    df = df.withColumn("fixed_slippage_bps", F.lit(float(slippage_bps)))
    df = df.withColumn("modeled_slippage_bps", F.col("fixed_slippage_bps") + F.col("market_impact_bps"))
    move = F.when(buy, 1.0).otherwise(-1.0) * F.col("modeled_slippage_bps") / 10000.0
    free = F.col("open") * (1 + move)
    df = df.withColumn(
        "price", F.when(buy, F.least(F.col("up_limit"), free)).otherwise(F.greatest(F.col("down_limit"), free))
    )
    ratio = F.col("price") / F.col("open")
    gap = F.when(buy, ratio - 1).otherwise(1 - ratio)
    return df.withColumn("realized_slippage_bps", F.greatest(gap * 10000.0, F.lit(0.0)))


def affordable_shares(cash: Column, price: Column, transfer_rate: Column) -> Column:
    """Shares that cash pays for, commission (with its minimum) and transfer fee included."""
    each = price * (1 + transfer_rate)
    return F.greatest(F.lit(0.0), F.least(cash / (each + price * COMMISSION), (cash - MIN_COMMISSION) / each))


def fill_once(orders: DataFrame, rate: float = PARTICIPATION, lot: int = LOT, reject_missing: bool = True) -> DataFrame:
    """One fill attempt: capped by participation and, for purchases, by cash, in whole lots.

    A sale that closes the position or clears its odd lot may leave whole lots when the
    cap allows it.  Needs side, desired, price, lagged_adv20, held, target; where there are
    ``cash`` and ``transfer_fee_rate``, a purchase is cut to what they pay for.  Without a
    known liquidity an order is rejected, unless ``reject_missing`` is off: then it is uncapped.
    """
    known = F.coalesce(~F.isnan("lagged_adv20") & (F.col("lagged_adv20") > 0), F.lit(False))
    cap = F.when((F.lit(rate) > 0) & known, F.col("lagged_adv20") * rate)
    df = orders.withColumn("participation_cap", cap)
    price = F.greatest(F.col("price"), F.lit(1e-12))
    room = F.when(F.col("participation_cap").isNull(), F.col("desired")).otherwise(F.col("participation_cap") / price)
    fits = F.col("participation_cap").isNull() | (F.col("desired") * price <= F.col("participation_cap") + 1e-8)
    whole = S.floor_lot(F.least(F.col("desired"), room), lot)
    odd = F.col("held") % F.lit(float(lot))
    closes = (F.col("side") == "SELL") & fits & (
        ((F.col("target") <= 1e-8) & (F.col("desired") >= F.col("held") - 1e-8))
        | ((F.col("desired") > 1e-8) & (F.col("desired") <= odd + 1e-8))
    )
    unknown = F.lit(reject_missing and rate > 0) & ~known
    df = df.withColumn("_capped", F.when(unknown, 0.0).when(closes, F.col("desired")).otherwise(whole))
    paid = F.col("_capped")
    if "cash" in orders.columns:
        able = S.floor_lot(affordable_shares(F.greatest("cash", F.lit(0.0)), price, F.col("transfer_fee_rate")), lot)
        paid = F.when(F.col("side") == "BUY", F.least("_capped", able)).otherwise(F.col("_capped"))
    df = df.withColumn("filled", paid)
    left = F.col("desired") - F.col("filled")
    status = (
        F.when(F.col("filled") <= 0, "REJECTED")
        .when(left >= lot - 1e-8, "PARTIAL")
        .otherwise("FILLED")
    )
    why = F.when(F.col("filled") > 0, "").when(unknown, "missing_signal_liquidity").when(F.col("_capped") > 0, "insufficient_cash").when(
        F.col("desired") < lot, "below_lot"
    ).otherwise("participation_cap")
    return df.withColumns({"status": status, "reason": why, "remaining": left}).drop("_capped")


def fee_columns(trades: DataFrame, tiers: DataFrame, date: str = "date") -> DataFrame:
    """Commission (with minimum), stamp duty on sales and transfer fee by dated tier."""
    df = tier_on(trades, tiers, date)
    some = F.col("notional") > 0
    df = df.withColumns(
        {
            "commission": F.when(some, F.greatest(F.lit(MIN_COMMISSION), F.col("notional") * COMMISSION)).otherwise(0.0),
            "stamp_duty": F.when(some & (F.col("side") == "SELL"), F.col("notional") * F.col("stamp_duty_sell")).otherwise(0.0),
            "transfer_fee": F.when(some, F.col("notional") * F.col("transfer_fee_rate")).otherwise(0.0),
        }
    )
    return df.withColumn("fees", F.col("commission") + F.col("stamp_duty") + F.col("transfer_fee"))


def sellable_part(buys: DataFrame, sells: DataFrame) -> DataFrame:
    """Sells with ``matched``: what of each sale is sellable, given the sales before it.

    With S shares asked for and A sellable up to a date, the shares sold up to it are the
    least of S and, over all dates until then, A + (what was asked for since).
    """
    events = buys.select("symbol", F.col("sellable_date").alias("date"), F.lit(0).alias("_sale"), "shares").unionByName(
        sells.select("symbol", "date", F.lit(1).alias("_sale"), "shares")
    )
    w = Window.partitionBy("symbol").orderBy("date", "_sale").rowsBetween(Window.unboundedPreceding, 0)
    asked, there = F.sum(F.when(F.col("_sale") == 1, F.col("shares")).otherwise(0.0)), F.sum(F.when(F.col("_sale") == 0, F.col("shares")).otherwise(0.0))
    events = events.select("*", asked.over(w).alias("_asked"), there.over(w).alias("_there")).where("_sale = 1")
    sold = F.col("_asked") + F.least(F.lit(0.0), F.min(F.col("_there") - F.col("_asked")).over(w))
    before = F.lag("_sold").over(Window.partitionBy("symbol").orderBy("date", "_sale"))
    return events.withColumn("_sold", sold).select("symbol", "date", "shares", (F.col("_sold") - F.coalesce(before, F.lit(0.0))).alias("matched"))


def oversold(buys: DataFrame, sells: DataFrame) -> DataFrame:
    """The part of each sale that no sellable share covers."""
    rest = F.col("shares") - F.col("matched")
    return sellable_part(buys, sells).where(rest > 1e-9).select("symbol", "date", rest.alias("shares"))


def fifo_match(buys: DataFrame, sells: DataFrame) -> DataFrame:
    """Match sells to buys first-in-first-out; a buy can be sold from its ``sellable_date``.

    Buys are laid end to end on a share axis in (sellable, acquired) order and sells on
    the same axis in date order; two ranges that overlap are a match.  Both axes are cut
    at the union of their end points, so every slice has one buy and one sell, found by
    carrying the next owner backward: no pair join.  A sale counts as far as shares are
    sellable on its date; ``oversold`` lists the rest.
    Inputs are one row per (symbol, date): symbol, date, shares (+ sellable_date).
    """
    wb = Window.partitionBy("symbol").orderBy("sellable_date", "date").rowsBetween(Window.unboundedPreceding, 0)
    ws = Window.partitionBy("symbol").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    b = buys.withColumn("_end", F.sum("shares").over(wb))
    able = sellable_part(buys, sells).where("matched > 0").select("symbol", "date", F.col("matched").alias("shares"))
    s = able.withColumn("_end", F.sum("shares").over(ws))
    axis = b.select(
        "symbol", "_end", F.struct(F.col("date").alias("buy_date"), "sellable_date").alias("_b"),
        F.lit(None).cast("struct<sell_date:date>").alias("_s"),
    ).unionByName(
        s.select(
            "symbol", "_end",
            F.lit(None).cast("struct<buy_date:date,sellable_date:date>").alias("_b"),
            F.struct(F.col("date").alias("sell_date")).alias("_s"),
        )
    )
    cuts = axis.groupBy("symbol", "_end").agg(F.max("_b").alias("_b"), F.max("_s").alias("_s"))
    w = Window.partitionBy("symbol").orderBy("_end")
    # the owner of a slice is the next end point at or after it: read the axis backward
    ahead = Window.partitionBy("symbol").orderBy(F.col("_end").desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = cuts.select(
        "symbol",
        (F.col("_end") - F.coalesce(F.lag("_end").over(w), F.lit(0.0))).alias("shares"),
        F.last("_b", ignorenulls=True).over(ahead).alias("_b"),
        F.last("_s", ignorenulls=True).over(ahead).alias("_s"),
    )
    return out.where(
        F.col("_b").isNotNull() & F.col("_s").isNotNull() & (F.col("_b.sellable_date") <= F.col("_s.sell_date"))
    ).select("symbol", "_b.buy_date", "_b.sellable_date", "_s.sell_date", "shares")


def entitlements(positions: DataFrame, actions: DataFrame) -> DataFrame:
    """Cash and shares due on the position held going into each ex-date."""
    held = asof_backward(
        actions, positions.select("symbol", F.col("date").alias("position_date"), "shares"),
        ["symbol"], "ex_date", "position_date", ["shares"], strict=True,
    ).where(F.col("shares") > 0)
    return held.select(
        "symbol", "ex_date", "shares",
        F.coalesce("pay_date", "ex_date").alias("pay_date"),
        F.coalesce("stock_list_date", "ex_date").alias("sellable_date"),
        (F.col("shares") * F.col("cash_dividend")).alias("cash_amount"),
        (F.col("shares") * F.col("stock_dividend")).alias("new_shares"),
    )


def stale_flags(grid: DataFrame, limit: int = 20, price: str = "close") -> DataFrame:
    """Trading days since the symbol's last bar on a dense grid, and whether that is too many."""
    w = Window.partitionBy("symbol").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col(price).isNotNull(), F.col("ord")), ignorenulls=True).over(w)
    return grid.withColumn("days_since_bar", F.col("ord") - last).withColumn(
        "is_stale", F.coalesce(F.col("days_since_bar") > limit, F.lit(True))
    )


def delist_values(positions: DataFrame, securities: DataFrame, policy: str = "zero") -> DataFrame:
    """Settlement and write-off of positions valued after the delisting date."""
    if policy not in ("zero", "last_close"):
        raise ValueError("policy must be zero or last_close")
    df = positions.join(securities.select("symbol", "delist_date"), "symbol", "left")
    value = F.col("shares") * F.col("mark")
    gone = F.coalesce(F.col("date") > F.col("delist_date"), F.lit(False))
    keep = F.lit(policy == "last_close")
    return df.select(
        "*",
        gone.alias("delisted"),
        F.when(gone & keep, value).when(gone, 0.0).alias("settlement"),
        F.when(gone & ~keep, value).when(gone, 0.0).alias("writeoff"),
    )


def order_costs(orders: DataFrame) -> DataFrame:
    """Ledger columns derived from a fill: notionals, fill ratio and cost estimates."""
    ref = F.col("open") * F.col("filled")
    return orders.select(
        "*",
        ref.alias("reference_notional"),
        (F.col("price") * F.col("filled")).alias("notional"),
        F.when(F.col("desired") > 0, F.col("filled") / F.col("desired")).otherwise(0.0).alias("fill_ratio"),
        (ref * F.col("fixed_slippage_bps") / 10000).alias("estimated_fixed_slippage_cost"),
        (ref * F.col("market_impact_bps") / 10000).alias("estimated_market_impact_cost"),
        (ref * F.col("realized_slippage_bps") / 10000).alias("realized_slippage_cost"),
    )


def book_weights(positions: DataFrame, closes: DataFrame, equity: DataFrame) -> DataFrame:
    """Weight of each held position at a close; only positive, present prices count."""
    df = positions.join(closes, ["symbol", "date"]).join(equity, "date")
    ok = (F.col("equity") > 0) & (F.col("close") > 0) & (F.col("shares") > 0)
    return df.where(ok).withColumn("weight", F.col("shares") * F.col("close") / F.col("equity"))
