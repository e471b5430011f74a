"""Bitemporal facts: normalisation, revision order and what was visible when."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators.asof import on_dates
from tidemark.operators.calendar import with_availability

FACT_COLUMNS = [
    "symbol", "source", "metric", "unit", "period_end", "announcement_date", "available_date",
    "revision_sequence", "report_type", "company_type", "source_update_flag", "source_row_sha256",
    "value",
]
REPORT_KEY = ["symbol", "source", "period_end", "report_type", "company_type"]

# Provider field -> (metric, unit) per statement source.
METRICS: dict[str, dict[str, tuple[str, str]]] = {
    "income": {
        "basic_eps": ("basic_eps", "CNY_per_share"),
        "total_revenue": ("total_revenue", "CNY"),
        "revenue": ("revenue", "CNY"),
        "operate_profit": ("operating_profit", "CNY"),
        "total_profit": ("total_profit", "CNY"),
        "n_income": ("net_income", "CNY"),
        "n_income_attr_p": ("net_income_parent", "CNY"),
    },
    "balancesheet": {
        "money_cap": ("cash", "CNY"),
        "accounts_receiv": ("accounts_receivable", "CNY"),
        "inventories": ("inventory", "CNY"),
        "total_cur_assets": ("current_assets", "CNY"),
        "fix_assets": ("fixed_assets", "CNY"),
        "total_assets": ("total_assets", "CNY"),
        "total_cur_liab": ("current_liabilities", "CNY"),
        "total_liab": ("total_liabilities", "CNY"),
        "total_hldr_eqy_exc_min_int": ("equity_parent", "CNY"),
    },
    "cashflow": {
        "n_cashflow_act": ("operating_cash_flow", "CNY"),
        "n_cashflow_inv_act": ("investing_cash_flow", "CNY"),
        "n_cash_flows_fnc_act": ("financing_cash_flow", "CNY"),
        "c_pay_acq_const_fiolta": ("capital_expenditure", "CNY"),
    },
    "fina_indicator": {
        "roe": ("roe_pct", "percent"),
        "roa": ("roa_pct", "percent"),
        "grossprofit_margin": ("gross_margin_pct", "percent"),
        "netprofit_margin": ("net_margin_pct", "percent"),
        "debt_to_assets": ("debt_to_assets_pct", "percent"),
        "current_ratio": ("current_ratio", "ratio"),
        "quick_ratio": ("quick_ratio", "ratio"),
        "assets_turn": ("asset_turnover", "ratio"),
        "ocf_to_or": ("operating_cash_to_revenue_pct", "percent"),
        "ocf_to_opincome": ("operating_cash_to_operating_profit_pct", "percent"),
        "profit_dedt": ("deducted_net_income", "CNY"),
        "or_yoy": ("revenue_yoy_pct", "percent"),
        "netprofit_yoy": ("net_income_yoy_pct", "percent"),
    },
}
# Daily valuation field -> column.
VALUATION_FIELDS = {
    "turnover_rate": "turnover_rate_pct",
    "pe_ttm": "pe_ttm",
    "pb": "pb",
    "ps_ttm": "ps_ttm",
    "dv_ttm": "dividend_yield_ttm_pct",
    "total_mv": "total_market_value_10k_cny",
    "circ_mv": "float_market_value_10k_cny",
}
# The row-identity metadata fields of a statement row.
IDENTITY_FIELDS = ["ts_code", "ann_date", "f_ann_date", "end_date", "report_type", "comp_type", "update_flag"]


def metric_dictionary(spark) -> DataFrame:
    rows = [
        (source, field, metric, unit)
        for source, fields in METRICS.items()
        for field, (metric, unit) in fields.items()
    ]
    return spark.createDataFrame(rows, "source string, provider_field string, metric string, unit string")


def _text(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in df.columns else F.lit("")


def normalise_statements(raw: DataFrame, source: str, cal: DataFrame, lag: int = 1) -> DataFrame:
    """Wide statement rows -> long metric rows with availability and revision order."""
    fields = METRICS[source]
    absent = {"ts_code", "end_date"} - set(raw.columns)
    if absent:
        raise ValueError(f"{source} rows need columns {sorted(absent)}")
    dates = [S.provider_date(F.col(c)) for c in ("ann_date", "f_ann_date") if c in raw.columns]
    announced = F.greatest(*dates) if len(dates) > 1 else dates[0]
    present = [f for f in fields if f in raw.columns]
    df = raw.select(
        F.col("ts_code").cast("string").alias("symbol"),
        F.lit(source).alias("source"),
        S.provider_date(F.col("end_date")).alias("period_end"),
        announced.alias("announcement_date"),
        _text(raw, "report_type").alias("report_type"),
        _text(raw, "comp_type").alias("company_type"),
        _text(raw, "update_flag").alias("source_update_flag"),
        S.row_sha(
            {"source": F.lit(source)}
            | {c: (F.col(c) if c in raw.columns else F.lit(None)) for c in [*IDENTITY_FIELDS, *fields]}
        ).alias("source_row_sha256"),
        *[S.finite(F.col(f)).alias(f) for f in present],
    )
    df = df.where(F.col("period_end").isNotNull() & F.col("announcement_date").isNotNull())
    df = df.where(F.coalesce(*[F.col(f) for f in present]).isNotNull())
    # identical source rows carry identical values, so one per hash is enough
    first = [c for c in df.columns if c != "source_row_sha256"]
    df = df.groupBy("source_row_sha256").agg(*[F.first(c).alias(c) for c in first])
    df = with_availability(df, cal, "announcement_date", lag).where(F.col("available_date").isNotNull())
    df = revision_sequence(df)
    long = df.unpivot(
        [c for c in df.columns if c not in present], present, "provider_field", "value"
    ).where(F.col("value").isNotNull())
    spark = raw.sparkSession
    names = metric_dictionary(spark).where(F.col("source") == source).drop("source")
    return long.join(F.broadcast(names), "provider_field").select(*FACT_COLUMNS)


def normalise_valuations(raw: DataFrame, cal: DataFrame, lag: int = 0, order: Sequence[Column] = ()) -> DataFrame:
    """Daily valuations: renamed, numeric or null, one row per (symbol, date), last wins."""
    df = raw.select(
        S.provider_date(F.col("trade_date")).alias("date"),
        F.col("ts_code").cast("string").alias("symbol"),
        *[
            (S.finite(F.col(f)) if f in raw.columns else F.lit(None).cast("double")).alias(c)
            for f, c in VALUATION_FIELDS.items()
        ],
        F.struct(*(order or [F.col(c) for c in raw.columns])).alias("_o"),
    ).where(F.col("date").isNotNull())
    cols = list(VALUATION_FIELDS.values())
    df = df.groupBy("symbol", "date").agg(F.max_by(F.struct(*cols), "_o").alias("_row"))
    df = df.select("symbol", "date", "_row.*")
    df = with_availability(df, cal, "date", lag).where(F.col("available_date").isNotNull())
    return df.select("date", "available_date", "symbol", *cols)


def revision_sequence(rows: DataFrame, keys: Sequence[str] = tuple(REPORT_KEY)) -> DataFrame:
    """Dense 1..n per report in (announcement, update flag, row hash) order.

    A report's rows are split by (announcement date, flag, first hash byte), which
    follows the sort order, and numbered inside each part; the sizes of earlier parts
    are then added.  A report with very many revisions so never sorts in one task.
    """
    keys = list(keys)
    part = ["announcement_date", "source_update_flag", "_h"]
    df = rows.withColumn("_h", F.substring("source_row_sha256", 1, 2))
    sizes = df.groupBy(*keys, *part).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*keys).orderBy(*part).rowsBetween(Window.unboundedPreceding, 0)
    sizes = sizes.withColumn("_before", F.sum("_c").over(w) - F.col("_c")).drop("_c")
    inner = Window.partitionBy(*keys, *part).orderBy("source_row_sha256")
    return (
        df.join(sizes, [*keys, *part])
        .withColumn(
            "revision_sequence", (F.col("_before") + F.row_number().over(inner)).cast("long")
        )
        .drop("_h", "_before")
    )


# The order in which a later fact replaces an earlier one for a (symbol, metric).
_REVISION = ["available_date", "revision_sequence", "source_row_sha256"]
_FRONTIER = [
    "period_end", "available_date", "revision_sequence", "source", "report_type", "company_type",
    "source_row_sha256",
]
_FACT_KEY = ["symbol", "source", "metric", "period_end", "report_type", "company_type"]


def visible_facts(facts: DataFrame, when: str, max_age_days: int | None = None) -> DataFrame:
    """Latest revision of every (symbol, source, metric, period, type) visible on one date."""
    day = F.lit(when).cast("date")
    seen = facts.where(F.col("available_date") <= day)
    if max_age_days is not None:
        seen = seen.where(F.datediff(day, "period_end") <= max_age_days)
    rest = [c for c in facts.columns if c not in _FACT_KEY]
    best = seen.groupBy(*_FACT_KEY).agg(
        F.max_by(F.struct(*rest), F.struct(*_REVISION)).alias("_row")
    )
    return best.select(*_FACT_KEY, "_row.*").select(*facts.columns)


def fact_snapshot(
    facts: DataFrame, when: str, metrics: Sequence[str], max_age_days: int | None = None
) -> DataFrame:
    """One row per symbol with the newest visible period of each metric as a column."""
    seen = visible_facts(facts, when, max_age_days)
    order = F.struct(*_FRONTIER)
    # conditional max_by per metric: same as a pivot with a known list, one shuffle on symbol
    return seen.groupBy("symbol").agg(
        F.lit(when).cast("date").alias("as_of_date"),
        *[
            F.max_by(F.when(F.col("metric") == m, F.col("value")), F.when(F.col("metric") == m, order)).alias(m)
            for m in metrics
        ],
    )


def valuation_snapshot(vals: DataFrame, when: str, max_age_days: int | None = None) -> DataFrame:
    day = F.lit(when).cast("date")
    seen = vals.where(F.col("available_date") <= day)
    if max_age_days is not None:
        seen = seen.where(F.datediff(day, "date") <= max_age_days)
    rest = [c for c in vals.columns if c != "symbol"]
    best = seen.groupBy("symbol").agg(
        F.max_by(F.struct(*rest), F.struct("date", "available_date")).alias("_row")
    )
    return best.select("symbol", "_row.*")


def combined_snapshot(
    facts: DataFrame, vals: DataFrame, when: str, metrics: Sequence[str],
    fact_age: int | None = None, valuation_age: int | None = None,
) -> DataFrame:
    """Fundamentals and valuations of one date side by side (full outer on symbol)."""
    left = fact_snapshot(facts, when, metrics, fact_age)
    right = (
        valuation_snapshot(vals, when, valuation_age)
        .withColumnRenamed("date", "valuation_date")
        .withColumnRenamed("available_date", "valuation_available_date")
    )
    return left.join(right, "symbol", "outer").withColumn(
        "as_of_date", F.coalesce("as_of_date", F.lit(when).cast("date"))
    )


def visibility_runs(facts: DataFrame, max_age_days: int | None = None, metrics: Sequence[str] | None = None) -> DataFrame:
    """The frontier table: which fact of a (symbol, metric) is the visible one, over [valid_from, valid_until).

    A later period always beats an earlier one and a late revision of an old period never wins, so the visible
    fact is the running maximum of (period, availability, revision, ...) over availability; a run begins where
    that maximum changes and ends where it changes next.  An age limit ends a run early: what the frontier
    replaced is older still.  ``valid_until`` is null for a run without end.  A (symbol, metric) has at most one
    row per availability date.
    """
    hit = F.struct(*_FRONTIER, "announcement_date", "value")
    if metrics is not None:
        facts = facts.where(F.col("metric").isin(list(metrics)))
    daily = facts.groupBy("symbol", "metric", F.col("available_date").alias("valid_from")).agg(F.max(hit).alias("_hit"))
    order = Window.partitionBy("symbol", "metric").orderBy("valid_from")
    before = F.max("_hit").over(order.rowsBetween(Window.unboundedPreceding, -1))
    leads = daily.where("valid_from IS NOT NULL").withColumn("_before", before).where("_before IS NULL OR _hit > _before")
    runs = leads.withColumn("valid_until", F.lead("valid_from").over(order))
    if max_age_days is not None:
        runs = runs.withColumn("valid_until", F.least("valid_until", F.date_add("_hit.period_end", max_age_days + 1)))
        runs = runs.where("_hit.period_end IS NOT NULL AND valid_from < valid_until")
    return runs.select("symbol", "metric", "valid_from", "valid_until", "_hit.*")


def facts_on_dates(
    facts: DataFrame, dates: DataFrame, max_age_days: int | None = None, date: str = "signal_date", metrics: Sequence[str] | None = None,
) -> DataFrame:
    """Newest visible fact per (symbol, metric) on every date of a list, for all symbols that have one."""
    seen = on_dates(visibility_runs(facts, max_age_days, metrics), dates, date)
    return seen.select("symbol", "metric", date, *_FRONTIER, "announcement_date", "value")


def facts_as_of(
    facts: DataFrame, probes: DataFrame, max_age_days: int | None = None, date: str = "signal_date",
    metrics: Sequence[str] | None = None,
) -> DataFrame:
    """Newest visible fact per (symbol, metric) on every probe (symbol, date), in one pass.

    Runs of the frontier table expand onto the dates that probes have and meet the probes by equality.
    """
    asked = probes.select("symbol", date).distinct()
    return facts_on_dates(facts, asked, max_age_days, date, metrics).join(asked, ["symbol", date], "left_semi")


def valuations_as_of(
    vals: DataFrame, probes: DataFrame, max_age_days: int | None = None, date: str = "signal_date"
) -> DataFrame:
    """Newest visible valuation row per symbol on every probe date."""
    cols = [c for c in vals.columns if c not in ("symbol", "date", "available_date")]
    hit = F.struct(
        F.col("date").alias("valuation_date"), F.col("available_date").alias("valuation_available_date"), *cols
    )
    daily = vals.groupBy("symbol", F.col("available_date").alias("_t")).agg(F.max(hit).alias("_hit"))
    kind = daily.schema["_hit"].dataType
    asked = probes.select("symbol", F.col(date).alias("_t")).distinct().select(
        "symbol", "_t", F.lit(1).alias("_side"), F.lit(None).cast(kind).alias("_hit")
    )
    axis = daily.select("symbol", "_t", F.lit(0).alias("_side"), "_hit").unionByName(asked)
    w = Window.partitionBy("symbol").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    seen = axis.withColumn("_hit", F.max("_hit").over(w)).where(
        (F.col("_side") == 1) & F.col("_hit").isNotNull()
    )
    out = seen.select("symbol", F.col("_t").alias(date), "_hit.*")
    if max_age_days is not None:
        out = out.where(F.datediff(date, "valuation_date") <= max_age_days)
    return out


def fact_lineage(as_of: DataFrame, date: str = "signal_date") -> DataFrame:
    """Newest period, newest availability and number of metrics visible per (symbol, date)."""
    return as_of.groupBy("symbol", date).agg(
        F.max("period_end").alias("latest_fundamental_period_end"),
        F.max("available_date").alias("latest_fundamental_available_date"),
        F.countDistinct("metric").alias("visible_fundamental_metric_count"),
    )


def pit_audit(facts: DataFrame, vals: DataFrame, expected: DataFrame) -> DataFrame:
    """Row counts, symbol coverage against an expected list, and the date span."""
    want = expected.select("symbol").distinct()
    fs, vs = facts.select("symbol").distinct(), vals.select("symbol").distinct()
    marks = (
        want.withColumn("_e", F.lit(1))
        .join(fs.withColumn("_f", F.lit(1)), "symbol", "outer")
        .join(vs.withColumn("_v", F.lit(1)), "symbol", "outer")
        .agg(
            F.count("_e").alias("expected_symbols"),
            F.count("_f").alias("fundamental_symbols"),
            F.count("_v").alias("valuation_symbols"),
            F.count(F.when(F.col("_e").isNotNull(), F.col("_f"))).alias("_fe"),
            F.count(F.when(F.col("_e").isNotNull(), F.col("_v"))).alias("_ve"),
        )
    )
    f = facts.agg(
        F.count(F.lit(1)).alias("fundamental_rows"),
        F.min("period_end").alias("first_period_end"),
        F.max("available_date").alias("_fa"),
        F.countDistinct("metric").alias("metrics"),
    )
    v = vals.agg(F.count(F.lit(1)).alias("valuation_rows"), F.max("available_date").alias("_va"))
    ratio = lambda c: F.when(F.col("expected_symbols") > 0, F.col(c) / F.col("expected_symbols")).otherwise(1.0)
    return (
        f.crossJoin(v).crossJoin(marks)
        .withColumn("fundamental_symbol_coverage", ratio("_fe"))
        .withColumn("valuation_symbol_coverage", ratio("_ve"))
        .withColumn("last_available_date", F.greatest("_fa", "_va"))
        .drop("_fe", "_ve", "_fa", "_va")
    )
