"""Assembling daily bars and the reference tables around them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators.asof import latest_by


def assemble_bars(
    daily: DataFrame, factors: DataFrame, basics: DataFrame, limits: DataFrame,
    keys: Sequence[str] = ("symbol", "date"),
) -> DataFrame:
    """daily + adjustment factor + daily basics + limits, all symbols in one pass.

    Volume arrives in lots of 100 and amount in thousands.  Rows whose factor or market
    value is missing are flagged rather than dropped; callers refuse to publish them.
    """
    keys = list(keys)
    df = daily
    for side in (factors, limits, basics):
        df = df.join(side, keys, "left")
    return df.select(
        *[c for c in df.columns if c not in ("vol", "amount")],
        (F.coalesce("vol", F.lit(0.0)) * 100).alias("volume"),
        (F.coalesce("amount", F.lit(0.0)) * 1000).alias("amount"),
        (F.col("adj_factor").isNull() | F.col("total_mv").isNull()).alias("missing_inputs"),
    )


def fill_limits(bars: DataFrame) -> DataFrame:
    """Missing price limits from the previous close and the board's rate, to the cent."""
    rate = S.limit_rate(F.col("symbol"), F.col("is_st"))
    return bars.withColumns(
        {
            "up_limit": F.coalesce("up_limit", F.bround(F.col("prev_close") * (1 + rate), 2)),
            "down_limit": F.coalesce("down_limit", F.bround(F.col("prev_close") * (1 - rate), 2)),
        }
    )


def corporate_actions(raw: DataFrame, start: str, stop: str, members: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Implemented distributions with an ex-date in range, one per (symbol, ex_date), last wins."""
    df = raw.where(F.col("div_proc") == "实施").where(
        F.col("ex_date").between(F.lit(start).cast("date"), F.lit(stop).cast("date"))
    )
    df = df.join(members.select("symbol").distinct(), "symbol", "left_semi")
    df = latest_by(df, ["symbol", "ex_date"], order)
    return df.select(
        "symbol", "record_date", "ex_date", "pay_date", F.col("div_listdate").alias("stock_list_date"),
        F.coalesce(S.finite(F.col("cash_div")), F.lit(0.0)).alias("cash_dividend"),
        F.coalesce(S.finite(F.col("stk_div")), F.lit(0.0)).alias("stock_dividend"),
    )


SECURITY_COLUMNS = ["symbol", "name", "industry", "market", "list_status", "list_date", "delist_date"]


def security_master(raw: DataFrame, order: Sequence[str]) -> DataFrame:
    """``ts_code`` becomes the symbol, absent columns are null, last row per symbol wins."""
    df = raw.drop("symbol").withColumnRenamed("ts_code", "symbol")
    for c in SECURITY_COLUMNS:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    return latest_by(df, ["symbol"], [F.col(c) for c in order]).select(*SECURITY_COLUMNS)


def index_frame(raw: DataFrame, code: str, order: Sequence[str]) -> DataFrame:
    """One row per date of one index; the last row of a date wins."""
    df = raw.where(F.col("index_code") == code).drop("index_code")
    return latest_by(df, ["date"], [F.col(c) for c in order])


def back_adjust(bars: DataFrame, factors: DataFrame) -> DataFrame:
    """Prices times the latest factor on or before the day, with change columns."""
    from tidemark.operators.asof import asof_backward

    df = asof_backward(bars, factors, ["symbol"], "date", "date", ["factor"], bounded_left=True).drop("matched_date")
    f = F.coalesce("factor", F.lit(1.0))
    cols = {c: F.col(c) * f for c in ("open", "high", "low", "close")}
    df = df.withColumns(cols)
    prev = F.lag("close").over(Window.partitionBy("symbol").orderBy("date"))
    return df.select(
        "*",
        (F.col("close") - prev).alias("change"),
        ((F.try_divide(F.col("close"), prev) - 1) * 100).alias("pct_chg"),
    )


def month_end_membership(weights: DataFrame, month_ends: DataFrame, index_code: str) -> DataFrame:
    """Index members at month ends only, one row per (date, symbol)."""
    ends = month_ends.select(F.col("signal_date").alias("date"))
    return (
        weights.where(F.col("index_code") == index_code)
        .join(F.broadcast(ends), "date", "left_semi")
        .groupBy("date", F.col("con_code").alias("symbol"))
        .agg(F.min("weight").alias("index_weight"))
    )


def eligible(
    features: DataFrame, min_history: int = 252, min_amount: float = 0.0, min_price: float = 3.0,
    trend_filter: bool = True, required: Sequence[str] = (), need_industry: bool = False,
) -> DataFrame:
    """Candidates for selection: one conjunction, so it reaches the scan as far as it can."""
    cond = (
        ~F.col("is_st")
        & (F.col("history_days") >= min_history)
        & (F.col("avg_amount_20") >= min_amount)
        & (F.col("close") >= min_price)
    )
    if trend_filter:
        cond = cond & (F.col("trend") > 0)
    for c in required:
        cond = cond & F.col(c).isNotNull()
    if need_industry:
        cond = cond & (F.col("industry_code") != "UNKNOWN")
    return features.where(cond)


def enough_candidates(df: DataFrame, minimum: int, date: str = "signal_date") -> DataFrame:
    """Drop whole dates with fewer than ``minimum`` rows (counts combine map-side)."""
    kept = df.groupBy(date).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= minimum).select(date)
    return df.join(F.broadcast(kept), date, "left_semi")
