"""Selections with weights, and score-overlay arms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import asof, portfolio, select, xsec
from tidemark.session import stage

_KEY = ["signal_date", "symbol"]

# Research arms and the weight of the fundamental score in each.
ARMS = {"coverage_matched_price": 0.0, "pit_only": 1.0, "hybrid": 0.25}


def overlay_arms(price: DataFrame, pit: DataFrame, minimum: int, arms: dict[str, float] = ARMS, q: float = 0.05) -> DataFrame:
    """Blend the price score with the fundamental composite over the rows that have both.

    Every arm ranks the same covered set, so differences come from the score alone.
    ``price``: signal_date, symbol, score.  ``pit``: + pit_score, available_factor_count.
    """
    covered = price.join(pit, _KEY).where(
        F.col("pit_score").isNotNull() & (F.col("available_factor_count") >= minimum)
    )
    covered = stage(covered)
    z = xsec.winsorised_z(covered, ["signal_date"], "score", "z_price_shadow", q, 2, "zero")
    z = xsec.winsorised_z(z, ["signal_date"], "pit_score", "z_pit_shadow", q, 2, "zero")
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), F.lit(w).alias("shadow_pit_weight")) for a, w in arms.items()]))
    out = z.withColumn("_a", each).select("*", "_a.*").drop("_a")
    w = F.col("shadow_pit_weight")
    return out.withColumn("score_pre_neutral", (1 - w) * F.col("z_price_shadow") + w * F.col("z_pit_shadow"))


def monthly_selection(
    scored: DataFrame, features: DataFrame, regime: DataFrame, cal: DataFrame, top_n: int = 20, exit_rank: int = 35,
    stock_cap: float = portfolio.STOCK_CAP, group_cap: float = portfolio.GROUP_CAP,
) -> DataFrame:
    """Ranked, buffered, weighted selection of every signal date with its weight change.

    ``current_weight`` is the previous date's target: the holdings a monthly book would
    carry into the signal without price drift.
    """
    ranked = xsec.ordinal_rank(scored, ["signal_date"], "score", "symbol", "rank", descending=True)
    picks = select.chained_selection(ranked.withColumn("arm", F.lit("all")), top_n, exit_rank).drop("arm")
    keep = ["signal_date", "symbol", "volatility", F.col("close").alias("signal_close"), "total_mv"]
    s = picks.join(scored, _KEY).join(features.select(*keep), _KEY)
    dates = s.select("signal_date").distinct()
    # the regime index has one row per day, and so has the list of signal dates
    risk = asof.asof_backward(
        dates.withColumn("_k", F.lit(1)), regime.withColumn("_k", F.lit(1)), ["_k"], "signal_date", "date", ["regime", "exposure"]
    ).select("signal_date", F.coalesce("regime", F.lit("RISK_OFF")).alias("regime"), F.coalesce("exposure", F.lit(0.30)).alias("exposure"))
    s = s.join(F.broadcast(risk), "signal_date")
    s = portfolio.feasible_exposure(portfolio.risk_preference(s), ["signal_date"], F.col("exposure"), stock_cap, group_cap)
    s = stage(portfolio.capped_weights(s, ["signal_date"], stock_cap=stock_cap, group_cap=group_cap))
    order = Window.orderBy("signal_date")
    nxt = dates.select("signal_date", F.lead("signal_date").over(order).alias("_next"))
    before = s.join(F.broadcast(nxt), "signal_date").select(
        F.col("_next").alias("signal_date"), "symbol", F.col("target_weight").alias("current_weight")
    ).where(F.col("signal_date").isNotNull())
    total = s.groupBy("signal_date").agg(F.sum("target_weight").alias("target_exposure"))
    return (
        s.join(before, _KEY, "left")
        .join(F.broadcast(total), "signal_date")
        .withColumn("current_weight", F.coalesce("current_weight", F.lit(0.0)))
        .withColumn("target_weight_change", F.col("target_weight") - F.col("current_weight"))
    )
