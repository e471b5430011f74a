"""Rolling price and liquidity features per symbol.

Input bars hold one row per (symbol, date), so a symbol's window is bounded by the
number of trading days however large the table grows.  Every feature shares one
partitioning by symbol, which costs a single shuffle.  Look-backs are put together from
short frames, so their cost hardly grows with their length.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Look-back lengths in trading rows.
SKIP, HALF_YEAR, YEAR = 21, 126, 252
TREND_ROWS, DRAWDOWN_ROWS, ADV_ROWS, ADV_MINIMUM = 200, 126, 20, 15
ANNUAL = 252.0
# Rows of the frames that are slid; longer look-backs are put together from them.
BLOCK = 20


def _guarded(value: Column, seen: Column, minimum: int) -> Column:
    return F.when(seen >= minimum, value)


def _blocks(width: int) -> list[tuple[int, int]]:
    """(rows, rows to go back) of the frames that make up the last ``width`` rows, each row in one of them."""
    whole, rest = width - width % BLOCK, width % BLOCK
    return [(BLOCK, back) for back in range(0, whole, BLOCK)] + ([(rest, whole)] if rest else [])


def _sum(parts: list[Column]) -> Column:
    return reduce(lambda x, y: x + y, [F.coalesce(part, F.lit(0)) for part in parts])


def price_features(
    bars: DataFrame,
    price: str = "total_close",
    vol_lookback: int = 60,
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """Momentum, trend, volatility, information-discreteness and drawdown columns.

    ``start``/``end`` limit the dates returned.  Look-backs count rows, not days, so a thinly
    traded symbol may need bars of any age: the windows see the whole history before ``start``.
    """
    if vol_lookback < 20:
        raise ValueError("vol_lookback must be at least 20")
    missing = {"symbol", "date", price} - set(bars.columns)
    if missing:
        raise ValueError(f"price features need columns {sorted(missing)}")
    df = bars
    if end:
        df = df.where(F.col("date") <= F.lit(end).cast("date"))
    w = Window.partitionBy("symbol").orderBy("date")
    p = F.col(price)

    def rows(first: int, last: int = 0):
        return w.rowsBetween(first, last)

    run = rows(Window.unboundedPreceding)

    # A sliding frame is evaluated anew for every row.  Frames of at most BLOCK rows are slid, and the
    # look-backs add those that lie BLOCK rows apart: the same rows in other groups, nothing is subtracted.
    def at(c: str, back: int) -> Column:
        return F.lag(c, back).over(w) if back else F.col(c)

    trend, vol = _blocks(TREND_ROWS), _blocks(vol_lookback)
    df = df.select(
        "*",
        (F.try_divide(p, F.lag(p, 1).over(w)) - 1).alias("return_1d"),
        (F.try_divide(F.lag(p, SKIP).over(w), F.lag(p, YEAR).over(w)) - 1).alias("mom_12_1"),
        (F.try_divide(F.lag(p, SKIP).over(w), F.lag(p, HALF_YEAR).over(w)) - 1).alias("mom_6_1"),
        *[F.sum(p).over(rows(1 - n)).alias(f"_p{n}") for n in sorted({n for n, _ in trend})],
        F.max(p).over(rows(1 - BLOCK)).alias("_high"),
        F.count(p).over(run).alias("_np"),
    )
    r = F.col("return_1d")
    loss = F.when(r.isNotNull(), F.pow(F.least(r, F.lit(0.0)), F.lit(2.0)))
    peak = [*range(0, DRAWDOWN_ROWS - BLOCK, BLOCK), DRAWDOWN_ROWS - BLOCK]  # these may overlap
    df = df.select(
        "*",
        _sum([at(f"_p{n}", back) for n, back in trend]).alias("_total"),
        F.greatest(*[at("_high", back) for back in peak]).alias("_peak"),
        *[
            f.over(rows(1 - n)).alias(f"{name}{n}") for n in sorted({n for n, _ in vol})
            for name, f in (("_n", F.count(r)), ("_r", F.avg(r)), ("_v", F.var_pop(r)), ("_l", F.sum(loss)))
        ],
        F.count(r).over(run).alias("_nr"),
        F.sum(F.coalesce((r > 0).cast("int"), F.lit(0))).over(run).alias("_up"),
        F.sum(F.coalesce((r < 0).cast("int"), F.lit(0))).over(run).alias("_down"),
    )

    # Counts over a frame are differences of running counts: exact, and a wide frame
    # costs no more than a narrow one (sliding frames are re-evaluated row by row).
    def window_count(c: str, width: int, skip: int = 0) -> Column:
        newest = F.col(c) if skip == 0 else F.coalesce(F.lag(c, skip).over(w), F.lit(0))
        return newest - F.coalesce(F.lag(c, skip + width).over(w), F.lit(0))

    formation = YEAR - SKIP
    df = df.select(
        "*",
        window_count("_np", TREND_ROWS).alias("_np_trend"),
        window_count("_np", DRAWDOWN_ROWS).alias("_np_peak"),
        window_count("_nr", formation, SKIP).alias("_nr_form"),
        window_count("_up", formation, SKIP).alias("_up_form"),
        window_count("_down", formation, SKIP).alias("_down_form"),
        *[at(f"{name}{n}", back).alias(f"{name}_{back}") for n, back in vol for name in ("_n", "_r", "_v", "_l")],
    )
    # mean and variance of a look-back from those of its blocks, about the mean of the whole
    part = lambda name: [F.col(f"{name}_{back}") for _, back in vol]
    seen = _sum(part("_n"))
    mean = F.try_divide(_sum([n * m for n, m in zip(part("_n"), part("_r"))]), seen)
    spread = _sum([n * (v + (m - mean) * (m - mean)) for n, m, v in zip(part("_n"), part("_r"), part("_v"))])
    least_vol = max(20, vol_lookback - 10)
    annual = F.sqrt(F.lit(ANNUAL))
    tilt = (F.col("_down_form") - F.col("_up_form")) / F.lit(float(formation))
    ma = _guarded(F.try_divide(F.col("_total"), F.col("_np_trend")), F.col("_np_trend"), TREND_ROWS)
    discreteness = F.signum("mom_12_1") * _guarded(tilt, F.col("_nr_form"), formation)
    df = df.select(
        *bars.columns, "return_1d", "mom_12_1", "mom_6_1",
        ma.alias("ma_200"),
        (_guarded(F.sqrt(F.try_divide(spread, seen)), seen, least_vol) * annual).alias("volatility"),
        (_guarded(F.sqrt(F.try_divide(_sum(part("_l")), seen)), seen, least_vol) * annual).alias("downside_volatility"),
        discreteness.alias("information_discreteness"),
        (F.try_divide(p, _guarded(F.col("_peak"), F.col("_np_peak"), DRAWDOWN_ROWS)) - 1).alias("drawdown_quality"),
        (F.try_divide(p, ma) - 1).alias("trend"),
        (F.col("mom_12_1") * (1 - discreteness)).alias("fip_momentum"),
    )
    return df.where(F.col("date") >= F.lit(start).cast("date")) if start else df


def liquidity_features(bars: DataFrame) -> DataFrame:
    """20-row average amount and volume (15 needed) and the running observation count."""
    w = Window.partitionBy("symbol").orderBy("date")
    adv = w.rowsBetween(1 - ADV_ROWS, 0)
    return bars.select(
        "*",
        *[
            _guarded(F.avg(col).over(adv), F.count(col).over(adv), ADV_MINIMUM).alias(name)
            for col, name in (("amount", "avg_amount_20"), ("volume", "avg_volume_20"))
        ],
        F.row_number().over(w).cast("long").alias("history_days"),
    )


def regime(index: DataFrame, ma_days: int = 200, on: float = 0.95, off: float = 0.30) -> DataFrame:
    """Risk label per index date: close at or above its full moving average is risk-on."""
    w = Window.orderBy("date").rowsBetween(1 - ma_days, 0)  # one index: at most one row per day
    ma = F.when(F.count("close").over(w) >= ma_days, F.avg("close").over(w))
    risk_on = F.coalesce(F.col("close") >= F.col("ma"), F.lit(False))
    return index.select("date", "close", ma.alias("ma")).select(
        "*",
        F.when(risk_on, "RISK_ON").otherwise("RISK_OFF").alias("regime"),
        F.when(risk_on, F.lit(on)).otherwise(F.lit(off)).alias("exposure"),
    )


def ffill(grid: DataFrame, col: str, limit: int | None = None, out: str | None = None) -> DataFrame:
    """Carry the last value forward over at most ``limit`` grid rows (None: without end)."""
    w = Window.partitionBy("symbol").orderBy("date")
    if limit == 0:
        return grid.withColumn(out or col, F.col(col))
    w = w.rowsBetween(Window.unboundedPreceding if limit is None else -limit, 0)
    return grid.withColumn(out or col, F.last(col, ignorenulls=True).over(w))
