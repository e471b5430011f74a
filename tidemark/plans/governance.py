"""Evidence gates: summary tables in, one row per check and a decision out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.factors import COMPOSITE

# Fixed values: (check, evidence column, comparison, threshold) of the factor review.
FACTOR_CHECKS = [
    ("signal_dates", "signal_dates", "ge", 24.0),
    ("median_coverage", "median_coverage", "ge", 0.60),
    ("mean_ic", "mean_ic", "ge", 0.02),
    ("positive_ic_ratio", "positive_ic_ratio", "ge", 0.55),
    ("top_minus_bottom_mean_return", "top_minus_bottom_mean_return", "gt", 0.0),
    ("positive_rolling_window_ratio", "positive_rolling_window_ratio", "ge", 0.60),
    ("median_absolute_size_spearman_max", "median_absolute_size_spearman", "le", 0.30),
    ("median_industry_r_squared_max", "median_industry_r_squared", "le", 0.30),
    ("maximum_cost_net_annualized_return", "maximum_cost_net_annualized_return", "gt", 0.0),
    ("minimum_cost_outcome_coverage", "minimum_cost_outcome_coverage", "ge", 0.90),
]
# The same for the shadow comparison.
SHADOW_CHECKS = [
    ("signal_dates", "signal_dates", "ge", 24.0),
    ("median_score_coverage", "median_score_coverage", "ge", 0.60),
    ("minimum_score_coverage", "minimum_score_coverage", "ge", 0.40),
    ("hybrid_cagr_increment", "cagr_delta", "gt", 0.0),
    ("hybrid_sharpe_increment", "sharpe_delta", "gt", 0.0),
    ("hybrid_drawdown_not_materially_worse", "drawdown_delta", "ge", -0.03),
    ("hybrid_turnover_bounded", "turnover_ratio", "le", 1.50),
    ("positive_annual_increment_ratio", "positive_annual_increment_ratio", "ge", 0.60),
    ("maximum_cost_hybrid_cagr", "maximum_cost_cagr", "gt", 0.0),
]


def _compare(value: Column, op: str, threshold: float) -> Column:
    """False when the evidence is missing."""
    test = {"ge": value >= threshold, "gt": value > threshold, "le": value <= threshold}[op]
    return F.coalesce(test, F.lit(False))


def check_table(evidence: DataFrame, checks, decision: Column) -> DataFrame:
    """Explode a one-row evidence table into its checks; ``_all`` may be used in ``decision``."""
    items = [
        F.struct(
            F.lit(n).alias("check_name"), F.col(c).cast("double").alias("value"), F.lit(t).alias("threshold"),
            _compare(F.col(c), op, t).alias("passed"),
        )
        for n, c, op, t in checks
    ]
    every = F.lit(True)
    for n, c, op, t in checks:
        every = every & _compare(F.col(c), op, t)
    return (
        evidence.withColumn("_all", every)
        .withColumn("decision", decision)
        .select(F.explode(F.array(*items)).alias("x"), F.col("_all").alias("all_passed"), "decision")
        .select("x.*", "all_passed", "decision")
    )


def factor_evidence(
    coverage: DataFrame, ic: DataFrame, quantiles: DataFrame, exposure: DataFrame, rolling: DataFrame,
    costs: DataFrame, horizon: int, max_cost: float,
) -> DataFrame:
    """The numbers the review looks at, all for the composite: one row."""
    comp = F.col("factor") == COMPOSITE
    at_h = F.col("horizon_days") == horizon
    # coverage has one row per signal date here, so an exact percentile stays small
    one = lambda df, *aggs: df.agg(*aggs)
    parts = [
        one(coverage.where(comp), F.count(F.lit(1)).alias("signal_dates"), F.median("coverage").alias("median_coverage")),
        one(ic.where(comp & at_h), F.max("mean_ic").alias("mean_ic"), F.max("positive_ic_ratio").alias("positive_ic_ratio")),
        one(quantiles.where(comp & at_h), F.max("top_minus_bottom_mean_return").alias("top_minus_bottom_mean_return")),
        one(
            rolling.where(at_h),
            F.avg(F.coalesce((F.col("mean_ic") > 0).cast("double"), F.lit(0.0))).alias("positive_rolling_window_ratio"),
        ),
        one(
            exposure.where(comp), F.max("median_absolute_size_spearman").alias("median_absolute_size_spearman"),
            F.max("median_industry_r_squared").alias("median_industry_r_squared"),
        ),
        one(
            costs.where(comp & (F.col("cost_bps_per_traded_side") == max_cost)),
            F.max("net_annualized_return").alias("maximum_cost_net_annualized_return"),
            F.max("minimum_outcome_coverage").alias("minimum_cost_outcome_coverage"),
        ),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one row each
    return out


def factor_governance(evidence: DataFrame, verified_provider: bool) -> DataFrame:
    decision = (
        F.when(F.lit(not verified_provider), "nonproduction_data_only")
        .when(F.col("_all"), "eligible_for_manual_candidate_review")
        .otherwise("insufficient_consistent_evidence")
    )
    return check_table(evidence, FACTOR_CHECKS, decision)


def shadow_evidence(
    coverage: DataFrame, comparison: DataFrame, annual: DataFrame, costs: DataFrame, hybrid: str, control: str
) -> DataFrame:
    """Hybrid arm against its coverage-matched control: one row."""
    arm = F.col("arm")
    pick = lambda a, c: F.max(F.when(arm == a, F.col(c)))
    delta = lambda c: pick(hybrid, c) - pick(control, c)
    comp = comparison.agg(
        delta("cagr").alias("cagr_delta"), delta("sharpe").alias("sharpe_delta"),
        delta("max_drawdown").alias("drawdown_delta"),
        F.when(
            pick(control, "annual_turnover") > 0,
            F.try_divide(pick(hybrid, "annual_turnover"), pick(control, "annual_turnover")),
        ).alias("turnover_ratio"),
    )
    years = annual.groupBy("year").agg((pick(hybrid, "return") - pick(control, "return")).alias("_d"))
    years = years.agg(
        F.avg(F.when(F.col("_d").isNotNull(), (F.col("_d") > 0).cast("double"))).alias("positive_annual_increment_ratio")
    )
    cov = coverage.agg(
        F.countDistinct("signal_date").alias("signal_dates"), F.median("eligible_coverage").alias("median_score_coverage"),
        F.min("eligible_coverage").alias("minimum_score_coverage"),
    )
    cost = costs.agg(
        F.max("fixed_slippage_bps").alias("maximum_cost_bps"), F.max_by("cagr", "fixed_slippage_bps").alias("maximum_cost_cagr")
    )
    return cov.crossJoin(comp).crossJoin(years).crossJoin(cost)


def shadow_governance(evidence: DataFrame, factor_decision: str, verified_provider: bool) -> DataFrame:
    """The nine measured checks plus the upstream review's own decision."""
    upstream = factor_decision == "eligible_for_manual_candidate_review"
    ev = evidence.withColumn("upstream_review", F.lit(1.0 if upstream else 0.0))
    decision = (
        F.when(F.lit(not verified_provider), "nonproduction_data_only")
        .when(F.lit(not upstream), "blocked_by_upstream_evidence")
        .when(F.col("_all"), "eligible_for_forward_paper_tracking")
        .otherwise("insufficient_strict_ledger_evidence")
    )
    return check_table(ev, [("upstream_manual_review_gate", "upstream_review", "ge", 1.0), *SHADOW_CHECKS], decision)
