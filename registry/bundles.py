"""Whole research and report bundles: the tables of other queries written together, and their manifests."""

from __future__ import annotations

from registry import QUERIES, allocation, execution_tables, query, research  # noqa: F401
from registry.tables import Tables
from tidemark.plans import price_scores
from tidemark.session import scratch_path, stage
from tidemark.sources import sinks

# table of a bundle -> (the query that fills it, its date column)
RESEARCH = {
    "factor_panel": ("R17_factor_panel", "signal_date"), "score_panel": ("R18_score_only_panel", "signal_date"),
    "coverage": ("R20_factor_coverage", "signal_date"), "rank_ic": ("R21_rank_ic", "signal_date"), "ic_summary": ("R22_ic_summary", ""),
    "quantile_returns": ("R23_quantile_returns", "signal_date"), "quantile_summary": ("R24_quantile_summary", ""),
    "exposures": ("R25_factor_exposures", "signal_date"), "exposure_summary": ("R25_exposure_summary", ""),
    "ablation": ("R27_leave_one_out_ablation", ""), "rolling_validation": ("R28_rolling_validation", "test_start"),
    "cost_stress": ("R29_cost_stress", "signal_date"), "cost_summary": ("R30_cost_summary", ""), "governance": ("R31_factor_governance", ""),
}
REPORT = {
    "equity": ("X11_weight_nav", "date"), "trades": ("X3_single_fill_attempt", "date"), "orders": ("X1_order_eligibility", "date"),
    "selections": ("flagship_monthly_top20", "signal_date"), "exposures": ("R15_preference_and_feasible_exposure", "signal_date"),
    "events": ("X7_corporate_action_entitlements", "ex_date"), "metrics": ("R36_performance_metrics", ""),
}


def shared(t) -> Tables:
    """The tables with what several parts of a report read staged once: the bars and the features at month ends."""
    once = Tables(t.spark, t.sf_dir)
    once.bars = stage(once.bars)
    once.month_features = stage(once.month_features.select(*price_scores.INPUTS, "amount", "volume"))
    return once


def whole(t) -> Tables:
    """The tables of a research bundle: every diagnostic is made once, for its own table, its summary and the governance."""
    once = Tables(t.spark, t.sf_dir)
    once.parts = {}
    return once


def _bundle(t, tables):
    out = {name: QUERIES[q].build(t).select(*[c for c, _ in QUERIES[q].columns]) for name, (q, _) in tables.items()}
    return sinks.write_bundle(out, scratch_path(t.spark, "bundle"), {name: day for name, (_, day) in tables.items() if day})


def _bundle_sql(tables) -> str:
    day = lambda f, c: f"CAST({f}({c}) AS DATE)" if c else "CAST(NULL AS DATE)"
    return " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, count(*) AS rows, {day('min', d)} AS first_day, {day('max', d)} AS last_day FROM ({QUERIES[q].sql}) AS {name}_rows"
        for name, (q, d) in tables.items()
    )


_COLUMNS = "table_name:s rows:i first_day:d last_day:d"


@query("K7_research_bundle", _COLUMNS, _bundle_sql(RESEARCH))
def _(t):
    return _bundle(whole(t), RESEARCH)


@query("K9_report_bundle", _COLUMNS, _bundle_sql(REPORT))
def _(t):
    return _bundle(shared(t), REPORT)
