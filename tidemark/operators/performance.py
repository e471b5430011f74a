"""Value curves, drawdowns, performance metrics and exposure tables.

A curve has one row per (arm, date), so its windows are bounded by the calendar.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ANNUAL = 252.0


def _over(by: Sequence[str], order: str = "date"):
    return Window.partitionBy(*by).orderBy(order)


def nav_curve(returns: DataFrame, by: Sequence[str], ret: str = "ret", out: str = "nav") -> DataFrame:
    w = _over(by).rowsBetween(Window.unboundedPreceding, 0)
    return returns.withColumn(out, F.product(1 + F.coalesce(F.col(ret), F.lit(0.0))).over(w))


def drawdown(curve: DataFrame, by: Sequence[str], nav: str = "nav", out: str = "drawdown") -> DataFrame:
    w = _over(by).rowsBetween(Window.unboundedPreceding, 0)
    return curve.withColumn(out, F.col(nav) / F.max(nav).over(w) - 1)


def daily_rate(annual: float) -> float:
    return (1.0 + annual) ** (1.0 / ANNUAL) - 1.0


def matched_benchmark(curve: DataFrame, by: Sequence[str], cash_rate: float = 0.0) -> DataFrame:
    """Benchmark scaled to yesterday's exposure, the rest earning cash; starts at the curve's nav."""
    w = _over(by)
    rb = F.coalesce(F.try_divide(F.col("benchmark_nav"), F.lag("benchmark_nav").over(w)) - 1, F.lit(0.0))
    e = F.least(F.greatest(F.coalesce(F.lag("gross_exposure").over(w), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    r = F.when(F.row_number().over(w) == 1, 0.0).otherwise(e * rb + (1 - e) * F.lit(daily_rate(cash_rate)))
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    return (
        curve.withColumn("_mr", r)
        .withColumn("benchmark_matched_nav", F.first("nav").over(run) * F.product(1 + F.col("_mr")).over(run))
        .drop("_mr")
    )


def difference_of_cumulative(df: DataFrame, by: Sequence[str], col: str, out: str) -> DataFrame:
    """Daily amounts from a running total; the first row keeps its own value."""
    return df.withColumn(out, F.coalesce(F.col(col) - F.lag(col).over(_over(by)), F.col(col)))


def _stat(nav: str, ret: str, years: Column, rf: float) -> dict[str, Column]:
    first, last = F.min_by(nav, "date"), F.max_by(nav, "date")
    sd = F.stddev_pop(ret)
    return {
        "total_return": last / first - 1,
        "cagr": F.when(first > 0, F.pow(last / first, F.try_divide(F.lit(1.0), years)) - 1),
        "volatility": sd * F.lit(ANNUAL**0.5),
        "sharpe": F.when(sd > 0, F.avg(F.col(ret) - F.lit(rf)) / sd * F.lit(ANNUAL**0.5)),
    }


def performance_metrics(
    curve: DataFrame, by: Sequence[str], risk_free: float = 0.0, cash_rate: float = 0.0
) -> DataFrame:
    """Strategy, benchmark and exposure-matched statistics of each curve, in one aggregate.

    Years are periods / 252.  Undefined ratios are null.
    """
    by = list(by)
    rf = daily_rate(risk_free)
    w, run = _over(by), _over(by).rowsBetween(Window.unboundedPreceding, 0)
    navs = {"": "nav", "benchmark_": "benchmark_nav", "matched_benchmark_": "benchmark_matched_nav"}
    df = matched_benchmark(curve, by, cash_rate)
    for p, nav in navs.items():
        df = df.withColumns(
            {
                f"_r{p}": F.try_divide(F.col(nav), F.lag(nav).over(w)) - 1,
                f"_d{p}": F.col(nav) / F.max(nav).over(run) - 1,
            }
        )
    periods = F.greatest(F.count("_r"), F.lit(1))
    years = periods / F.lit(ANNUAL)
    aggs: dict[str, Column] = {
        "start_date": F.min("date"),
        "end_date": F.max("date"),
        "trading_days": F.count(F.lit(1)),
        "_years": years,
    }
    for p, nav in navs.items():
        for k, c in _stat(nav, f"_r{p}", years, rf).items():
            aggs[f"{p}{k}"] = c
        aggs[f"{p}max_drawdown"] = F.min(f"_d{p}")
    r, rb, rm = F.col("_r"), F.col("_rbenchmark_"), F.col("_rmatched_benchmark_")
    down, active = F.when(r < 0, r), r - rm
    excess = F.avg(r - F.lit(rf))
    root = F.lit(ANNUAL**0.5)
    beta = F.when(F.var_pop(rb) > 0, F.try_divide(F.covar_pop(r, rb), F.var_pop(rb)))
    aggs |= {
        "sortino": F.when(F.stddev_pop(down) > 0, excess / F.stddev_pop(down) * root),
        "tracking_error": F.stddev_pop(active) * root,
        "information_ratio": F.when(F.stddev_pop(active) > 0, F.avg(active) / F.stddev_pop(active) * root),
        "beta": beta,
        "annual_alpha": (F.avg(r) - beta * F.avg(rb)) * F.lit(ANNUAL),
        "positive_day_ratio": F.avg((r > 0).cast("double")),
        "worst_day": F.min(r),
        "best_day": F.max(r),
        "average_exposure": F.avg("gross_exposure"),
        "maximum_exposure": F.max("gross_exposure"),
        "annual_turnover": 0.5 * F.max_by("cumulative_notional", "date") / F.greatest(F.avg("nav"), F.lit(1e-12)) / years,
        "total_fees": F.max_by("cumulative_fees", "date"),
    }
    out = df.groupBy(*by).agg(*[c.alias(k) for k, c in aggs.items()])
    return out.withColumns(
        {
            "calmar": F.when(F.col("max_drawdown") < 0, F.col("cagr") / F.abs("max_drawdown")),
            "excess_cagr": F.col("cagr") - F.col("matched_benchmark_cagr"),
        }
    ).drop("_years")


def period_metrics(curve: DataFrame, periods: DataFrame, by: Sequence[str]) -> DataFrame:
    """Metrics of each curve inside each named date range; years are days / 365.2425.

    Ranges may overlap.  Fewer than two points give null metrics.
    """
    by = [*by, "period"]
    # the list of ranges is a parameter table of a few rows
    df = curve.join(
        F.broadcast(periods), (F.col("date") >= F.col("period_start")) & (F.col("date") <= F.col("period_end"))
    )
    w, run = _over(by), _over(by).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns(
        {
            "_r": F.try_divide(F.col("nav"), F.lag("nav").over(w)) - 1,
            "_d": F.col("nav") / F.max("nav").over(run) - 1,
        }
    )
    years = F.greatest(F.datediff(F.max("date"), F.min("date")) / F.lit(365.2425), F.lit(1 / ANNUAL))
    growth = F.max_by("nav", "date") / F.min_by("nav", "date")
    sd, root = F.stddev_pop("_r"), F.lit(ANNUAL**0.5)
    enough = lambda c: F.when(F.count(F.lit(1)) >= 2, c)
    out = df.groupBy(*by).agg(
        F.min("date").alias("start"),
        F.max("date").alias("end"),
        F.count(F.lit(1)).alias("trading_days"),
        enough(growth - 1).alias("total_return"),
        enough(F.pow(growth, 1 / years) - 1).alias("cagr"),
        enough(sd * root).alias("annual_volatility"),
        enough(F.when(sd > 0, F.avg("_r") / sd * root)).alias("sharpe"),
        enough(F.min("_d")).alias("max_drawdown"),
    )
    return out.withColumn("calmar", F.when(F.col("max_drawdown") < 0, F.col("cagr") / F.abs("max_drawdown")))


def annual_metrics(curves: DataFrame, arm: str = "arm") -> DataFrame:
    """Per arm and year: return, Sharpe, drawdown against a base of 1, turnover and fees."""
    df = curves.withColumn("_r", F.try_divide(F.col("nav"), F.lag("nav").over(_over([arm]))) - 1)
    df = difference_of_cumulative(df, [arm], "cumulative_notional", "_n")
    df = difference_of_cumulative(df, [arm], "cumulative_fees", "_f").withColumn("year", F.year("date"))
    run = _over([arm, "year"]).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_g", F.product(1 + F.coalesce("_r", F.lit(0.0))).over(run))
    df = df.withColumn("_dd", F.when(F.col("_r").isNotNull(), F.col("_g") / F.greatest(F.max("_g").over(run), F.lit(1.0)) - 1))
    sd = F.stddev_pop("_r")
    return (
        df.groupBy(arm, "year")
        .agg(
            F.count("_r").alias("trading_days"),
            (F.max_by("_g", "date") - 1).alias("return"),
            F.when(sd > 0, F.avg("_r") / sd * F.lit(ANNUAL**0.5)).alias("sharpe"),
            F.min("_dd").alias("maximum_drawdown"),
            F.when(F.avg("nav") > 0, 0.5 * F.sum("_n") / F.avg("nav")).alias("one_sided_turnover"),
            F.sum("_f").alias("fees"),
        )
        .where(F.col("trading_days") > 0)
    )


def monthly_returns(curve: DataFrame, by: Sequence[str]) -> DataFrame:
    """Return of each month's last nav over the previous month's, one column per month.

    The first month is measured from the curve's first value.
    """
    by = list(by)
    m = curve.groupBy(*by, F.trunc("date", "MM").alias("m")).agg(
        F.max_by("nav", "date").alias("_last"), F.min_by("nav", "date").alias("_first")
    )
    w = _over(by, "m")
    m = m.withColumn("_ret", F.col("_last") / F.coalesce(F.lag("_last").over(w), F.col("_first")) - 1)
    return m.groupBy(*by, F.year("m").alias("year")).agg(
        *[F.max(F.when(F.month("m") == k, F.col("_ret"))).alias(f"m{k:02d}") for k in range(1, 13)]
    )


def compound_metrics(df: DataFrame, by: Sequence[str], col: str, prefix: str, date: str = "signal_date") -> DataFrame:
    """Cumulative and 12/n-annualised return and worst drawdown of periodic returns.

    Nulls are skipped; a return of -100% or worse leaves every metric null.
    """
    by = list(by)
    run = Window.partitionBy(*by).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    x = df.where(F.col(col).isNotNull()).withColumn("_g", F.product(1 + F.col(col)).over(run))
    x = x.withColumn("_dd", F.try_divide(F.col("_g"), F.max("_g").over(run)) - 1)
    ok = F.min(col) > -1
    last, n = F.max_by("_g", date), F.count(F.lit(1))
    return x.groupBy(*by).agg(
        F.when(ok, last - 1).alias(f"{prefix}_cumulative_return"),
        F.when(ok, F.pow(last, 12.0 / n) - 1).alias(f"{prefix}_annualized_return"),
        F.when(ok, F.min("_dd")).alias(f"{prefix}_maximum_drawdown"),
    )


def industry_exposure(sel: DataFrame) -> DataFrame:
    """Holdings and weight per industry and date, and the share of the stock book."""
    g = sel.groupBy("signal_date", "industry_code", "industry_name").agg(
        F.countDistinct("symbol").alias("holding_count"),
        F.sum(F.coalesce("target_weight", F.lit(0.0))).alias("target_weight"),
    )
    # one row per industry and date by now
    total = F.sum("target_weight").over(Window.partitionBy("signal_date"))
    return g.withColumn("stock_book_weight", F.when(total > 0, F.col("target_weight") / total).otherwise(0.0))


def style_exposure(sel: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Weighted mean of each style column over rows with a value and a positive weight."""
    w = F.coalesce("target_weight", F.lit(0.0))

    def mean(c: str) -> Column:
        ok = F.col(c).isNotNull() & (w > 0)
        return F.try_divide(F.sum(F.when(ok, F.col(c) * w)), F.nullif(F.sum(F.when(ok, w)), F.lit(0.0))).alias(c)

    held = (F.coalesce("selection_reason", F.lit("")) == "HOLD_BUFFER").cast("double")
    return sel.groupBy("signal_date").agg(
        F.countDistinct("symbol").alias("selected_count"),
        F.sum(w).alias("target_exposure"),
        F.sum(held).cast("long").alias("buffered_count"),
        F.avg(held).alias("buffered_selection_ratio"),
        *[mean(c) for c in columns],
    )


def arm_comparison(metrics: DataFrame, fields: Sequence[str], baselines: dict[str, str]) -> DataFrame:
    """Every arm's metrics with differences from named baseline arms (one row per arm)."""
    out = metrics
    for label, arm in baselines.items():
        # one row; a repeated baseline arm is an error
        once = F.assert_true(F.count(F.lit(1)) <= 1, F.lit(f"baseline arm {arm} is repeated"))
        base = metrics.where(F.col("arm") == arm).agg(*[F.max(f).alias(f"_{f}") for f in fields], once.alias("_once")).where("_once IS NULL")
        out = out.join(F.broadcast(base), how="cross")
        out = out.select(
            *[c for c in out.columns if not c.startswith("_")],
            *[(F.col(f) - F.col(f"_{f}")).alias(f"{f}_delta_vs_{label}") for f in fields],
        )
    return out
