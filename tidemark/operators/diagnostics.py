"""Factor diagnostics over long scores: coverage, rank correlation, spreads, exposures, costs.

Input rows carry signal_date, symbol, factor, raw, z, universe_size, industry_code,
log_total_market_value and forward_return_* columns.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import xsec
from tidemark.operators.aggregates import summarise
from tidemark.operators.performance import compound_metrics
from tidemark.session import stage

_DF = ["signal_date", "factor"]


def horizons_long(df: DataFrame, horizons: Sequence[int], keep: Sequence[str]) -> DataFrame:
    """One row per horizon with its forward return in ``ret``."""
    each = F.array(
        *[F.struct(F.lit(int(h)).alias("horizon_days"), F.col(f"forward_return_{h}d").alias("ret")) for h in horizons]
    )
    return df.select(*keep, F.explode(each).alias("x")).select(*keep, "x.*")


def coverage(df: DataFrame) -> DataFrame:
    """Share of the universe with a raw value and with a score, per date and factor."""
    return df.groupBy(*_DF).agg(
        F.max("universe_size").alias("universe_size"),
        F.count("raw").alias("raw_valid_observations"),
        F.count("z").alias("valid_observations"),
    ).select(
        "*",
        F.try_divide(F.col("raw_valid_observations"), F.col("universe_size")).alias("raw_coverage"),
        F.try_divide(F.col("valid_observations"), F.col("universe_size")).alias("coverage"),
    )


def rank_ic(df: DataFrame, horizons: Sequence[int], minimum: int = 20) -> DataFrame:
    """Spearman correlation of score and forward return per date, factor and horizon."""
    if minimum < 3:
        raise ValueError("minimum must be at least 3")
    long = horizons_long(df, horizons, ["signal_date", "symbol", "factor", "z"])
    return xsec.spearman(long, [*_DF, "horizon_days"], "z", "ret", minimum, "spearman_ic", "symbol")


def summarise_ic(ic: DataFrame) -> DataFrame:
    """Mean, median, deviation, IR, t statistic and share of positive periods."""
    by = ["factor", "horizon_days"]
    s = summarise(ic, by, "spearman_ic")
    ok = (F.col("n") > 1) & (F.col("deviation") > 0)
    every = ic.select(*by).distinct()
    return every.join(s, by, "left").select(
        *by,
        F.coalesce("n", F.lit(0)).alias("valid_periods"),
        F.col("mean").alias("mean_ic"),
        F.col("median").alias("median_ic"),
        F.when(F.col("n") > 1, F.col("deviation")).alias("ic_std"),
        F.when(ok, F.col("mean") / F.col("deviation")).alias("ic_ir"),
        F.when(ok, F.col("mean") / (F.col("deviation") / F.sqrt("n"))).alias("ic_t_stat"),
        F.col("positive_ratio").alias("positive_ic_ratio"),
    )


def score_quantiles(df: DataFrame, q: int) -> DataFrame:
    """``df`` with the score bucket of each row (``quantile``), which ``quantile_returns`` and ``cost_stress`` then take as it is."""
    return xsec.quantile_label(df, _DF, "z", "symbol", q)


def quantile_returns(df: DataFrame, horizons: Sequence[int], q: int = 5) -> DataFrame:
    """Mean and median forward return per score bucket; buckets are cut on all scored rows."""
    if q < 2:
        raise ValueError("q must be at least 2")
    labelled = (df if "quantile" in df.columns else score_quantiles(df, q)).where(F.col("quantile").isNotNull())
    returns = [f"forward_return_{h}d" for h in horizons]
    labelled = labelled.select("signal_date", "symbol", "factor", "quantile", *returns)
    if "quantile" not in df.columns:
        labelled = stage(labelled)  # moments and medians read it
    long = horizons_long(labelled, horizons, ["signal_date", "symbol", "factor", "quantile"])
    by = ["signal_date", "factor", "horizon_days", "quantile"]
    s = summarise(long, by, "ret")
    return s.select(
        *by, F.col("n").alias("observations"), F.col("mean").alias("mean_forward_return"),
        F.col("median").alias("median_forward_return"),
    )


def summarise_quantiles(qr: DataFrame, q: int) -> DataFrame:
    """Average return of the end buckets and of their spread over dates that have both."""
    at = lambda k: F.max(F.when(F.col("quantile") == k, F.col("mean_forward_return")))
    per = qr.groupBy("factor", "horizon_days", "signal_date").agg(at(1).alias("_b"), at(q).alias("_t"))
    spread = F.col("_t") - F.col("_b")
    return per.groupBy("factor", "horizon_days").agg(
        F.count(spread).alias("valid_spread_periods"),
        F.avg("_b").alias("bottom_quantile_mean_return"),
        F.avg("_t").alias("top_quantile_mean_return"),
        F.avg(spread).alias("top_minus_bottom_mean_return"),
        F.avg(F.when(spread.isNotNull(), (spread > 0).cast("double"))).alias("positive_spread_ratio"),
    )


def exposures(df: DataFrame) -> DataFrame:
    """Size correlation, variance explained by industry and the largest industry mean."""
    size = xsec.spearman(df, _DF, "z", "log_total_market_value", 3, "size_spearman", "symbol").drop("observations")
    cells = df.where(F.col("z").isNotNull() & (F.col("industry_code") != "UNKNOWN")).groupBy(*_DF, "industry_code").agg(
        F.count("z").alias("_n"), F.avg("z").alias("_m"), F.sum(F.col("z") * F.col("z")).alias("_s2")
    )
    n, mean = F.sum("_n"), F.sum(F.col("_n") * F.col("_m")) / F.sum("_n")
    centre = n * mean * mean
    total = F.sum("_s2") - centre
    fitted = F.sum(F.col("_n") * F.col("_m") * F.col("_m")) - centre
    ind = cells.groupBy(*_DF).agg(
        F.count(F.lit(1)).alias("industries"),
        F.when(
            (n >= 3) & (F.count(F.lit(1)) >= 2) & (total >= 1e-12),
            F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(fitted, total))),
        ).alias("industry_r_squared"),
        F.max(F.abs("_m")).alias("maximum_absolute_industry_mean_z"),
    )
    base = df.groupBy(*_DF).agg(F.count("z").alias("observations"))
    # both sides have one row per (date, factor)
    return base.join(size, _DF, "left").join(ind, _DF, "left").withColumn(
        "industries", F.coalesce("industries", F.lit(0))
    )


def summarise_exposures(ex: DataFrame) -> DataFrame:
    size, r2 = F.col("size_spearman"), F.col("industry_r_squared")
    # a factor has one row per signal date here
    return ex.groupBy("factor").agg(
        F.count(F.lit(1)).alias("periods"),
        F.median(size).alias("median_size_spearman"),
        F.median(F.abs(size)).alias("median_absolute_size_spearman"),
        F.max(F.abs(size)).alias("maximum_absolute_size_spearman"),
        F.median(r2).alias("median_industry_r_squared"),
        F.max(r2).alias("maximum_industry_r_squared"),
    )


def score_evidence(df: DataFrame, by: Sequence[str], q: int, minimum: int) -> DataFrame:
    """Rank correlation and end-bucket spread of any score, summarised over dates.

    ``df``: by..., signal_date, symbol, score, ret.  Buckets are cut inside the rows
    that have both a score and a return.
    """
    by = list(by)
    per = [*by, "signal_date"]
    sample = df.where(F.col("score").isNotNull() & F.col("ret").isNotNull())
    dated = xsec.spearman(sample, per, "score", "ret", minimum, "ic", "symbol", q).withColumn("spread", F.col("top") - F.col("bottom"))
    summed = dated.groupBy(*by).agg(
        F.count("ic").alias("valid_ic_periods"), F.avg("ic").alias("mean_ic"),
        F.avg(F.when(F.col("ic").isNotNull(), (F.col("ic") > 0).cast("double"))).alias("positive_ic_ratio"),
        F.count("spread").alias("valid_spread_periods"), F.avg("spread").alias("top_minus_bottom_mean_return"),
    )
    every = df.select(*by).distinct()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return every.join(summed, by, "left").select(
        *by, zero("valid_ic_periods"), "mean_ic", "positive_ic_ratio", zero("valid_spread_periods"),
        "top_minus_bottom_mean_return",
    )


def ablation(
    scores: DataFrame, rows: DataFrame, names: Sequence[str], horizons: Sequence[int], q: int, minimum: int,
) -> DataFrame:
    """Evidence of the composite with each factor left out in turn.

    Variants are built by aggregation: the sum and count over all factors minus those of
    the removed one, so every variant reads each score once.
    """
    key = ["signal_date", "symbol"]
    cases = [("full", "", len(names))] + [(f"without_{n}", n, len(names) - 1) for n in names]
    aggs = []
    for i, (_, removed, size) in enumerate(cases):
        z = F.when(F.col("factor") != removed, F.col("z"))
        need = max(2, math.ceil(size / 2))
        aggs.append(F.when(F.count(z) >= need, F.avg(z)).alias(f"_{i}"))
    # counts, ranks and groups read it, so it is staged while it still has one row a name
    returns = rows.select(*key, *[f"forward_return_{h}d" for h in horizons])
    wide = stage(scores.where(F.col("factor").isin(*names)).groupBy(*key).agg(*aggs).join(returns, key))
    each = F.array(
        *[
            F.struct(
                F.lit(v).alias("variant"), F.lit(r).alias("removed_factor"), F.lit(n).alias("included_factor_count"),
                F.lit(max(2, math.ceil(n / 2))).alias("minimum_available_factor_count"), F.col(f"_{i}").alias("score"),
            )
            for i, (v, r, n) in enumerate(cases)
        ]
    )
    labelled = wide.select(*key, *returns.columns[2:], F.explode(each).alias("x")).select(*key, *returns.columns[2:], "x.*")
    meta = ["variant", "removed_factor", "included_factor_count", "minimum_available_factor_count"]
    return score_evidence(horizons_long(labelled, horizons, [*key, *meta, "score"]), [*meta, "horizon_days"], q, minimum)


def rolling_windows(dates: DataFrame, train_years: int, test_years: int) -> DataFrame:
    """Expanding training and consecutive test windows over the span of the dates (one row a window)."""
    if train_years < 1 or test_years < 1:
        raise ValueError("years must be at least 1")
    span = dates.agg(F.min("signal_date").alias("_a"), F.max("signal_date").alias("_b"))
    first = F.add_months("_a", 12 * train_years)
    count = F.floor(F.months_between("_b", first) / (12 * test_years)).cast("int")
    w = span.where(first <= F.col("_b")).withColumn("window", F.explode(F.sequence(F.lit(0), count)))
    start = F.add_months("_a", F.lit(12 * train_years) + F.col("window") * (12 * test_years))
    stop = F.least(F.date_sub(F.add_months(start, 12 * test_years), 1), F.col("_b"))
    return w.select(
        (F.col("window") + 1).alias("window"), F.col("_a").alias("train_start"), F.date_sub(start, 1).alias("train_end"),
        start.alias("test_start"), stop.alias("test_end"),
    )


def rolling_validation(
    df: DataFrame, horizons: Sequence[int], train_years: int, test_years: int, q: int, minimum: int,
) -> DataFrame:
    """Evidence of a fixed score in each test window; nothing is fitted on the training span."""
    win = rolling_windows(df, train_years, test_years)
    inside = df.withColumnRenamed("z", "score").join(
        F.broadcast(win), F.col("signal_date").between(F.col("test_start"), F.col("test_end"))
    )
    meta = ["window", "train_start", "train_end", "test_start", "test_end"]
    dates = inside.groupBy(*meta).agg(F.countDistinct("signal_date").alias("signal_dates"))
    ev = score_evidence(
        horizons_long(inside, horizons, ["signal_date", "symbol", *meta, "score"]), [*meta, "horizon_days"], q, minimum
    )
    return ev.join(F.broadcast(dates), meta).withColumn("parameters_fitted", F.lit(False))


def cost_stress(
    df: DataFrame, q: int, costs: Sequence[float], ret: str = "forward_return_next_signal"
) -> DataFrame:
    """Top-bucket equal-weight book: turnover against the previous date and net returns per cost.

    Each holding is entered with +w on its date and -w on the next signal date; summing
    by (date, symbol) gives the weight change without joining a book to its predecessor.
    """
    costs = sorted({float(c) for c in costs})
    if not costs or costs[0] < 0:
        raise ValueError("costs must be non-negative")
    labelled = df if "quantile" in df.columns else score_quantiles(df, q)
    top = stage(labelled.where(F.col("quantile") == q).select(*_DF, "symbol", ret))  # its size and its book read it
    size = top.groupBy(*_DF).agg(
        F.count(F.lit(1)).alias("holdings"), F.count(ret).alias("realized_outcomes"), F.avg(ret).alias("gross_return")
    )
    book = top.join(F.broadcast(size.select(*_DF, "holdings")), _DF).select(
        *_DF, "symbol", (1 / F.col("holdings")).alias("_w")
    )
    order = Window.orderBy("signal_date")  # one row per signal date
    nxt = df.select("signal_date").distinct().select("signal_date", F.lead("signal_date").over(order).alias("_next"))
    moves = book.join(F.broadcast(nxt), "signal_date").select(
        "factor", "symbol",
        F.explode(F.array(
            F.struct(F.col("signal_date").alias("signal_date"), F.col("_w").alias("w")),
            F.struct(F.col("_next").alias("signal_date"), (-F.col("_w")).alias("w")),
        )).alias("x"),
    ).select("factor", "symbol", "x.*").where(F.col("signal_date").isNotNull())
    turn = (
        moves.groupBy(*_DF, "symbol").agg(F.sum("w").alias("_d"))
        .groupBy(*_DF).agg(F.sum(F.abs("_d")).alias("two_sided_weight_turnover"))
    )
    every = df.select(*_DF).distinct()
    base = every.join(size, _DF, "left").join(turn, _DF, "left").select(
        *_DF, F.coalesce("holdings", F.lit(0)).alias("holdings"),
        F.coalesce("realized_outcomes", F.lit(0)).alias("realized_outcomes"),
        F.coalesce(F.try_divide(F.col("realized_outcomes"), F.col("holdings")), F.lit(0.0)).alias("outcome_coverage"),
        F.coalesce("two_sided_weight_turnover", F.lit(0.0)).alias("two_sided_weight_turnover"), "gross_return",
    )
    cost = F.explode(F.array(*[F.lit(c) for c in costs]))
    return base.withColumn("cost_bps_per_traded_side", cost).withColumn(
        "estimated_cost", F.col("two_sided_weight_turnover") * F.col("cost_bps_per_traded_side") / 10000
    ).withColumn("net_return", F.col("gross_return") - F.col("estimated_cost"))


def summarise_costs(cs: DataFrame) -> DataFrame:
    by = ["factor", "cost_bps_per_traded_side"]
    base = cs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("periods"),
        F.avg("outcome_coverage").alias("average_outcome_coverage"),
        F.min("outcome_coverage").alias("minimum_outcome_coverage"),
        F.avg("two_sided_weight_turnover").alias("average_two_sided_weight_turnover"),
    )
    gross = compound_metrics(cs, by, "gross_return", "gross").drop("gross_maximum_drawdown")
    net = compound_metrics(cs, by, "net_return", "net")
    return base.join(gross, by, "left").join(net, by, "left")
