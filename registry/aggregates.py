"""Aggregations, coverage and exposure tables."""

from pyspark.sql import functions as F

from registry import query
from registry.tables import FACT_METRICS
from tidemark.operators import performance as perf
from tidemark.operators import aggregates as agg
from tidemark.operators import pit, xsec
from tidemark.operators.asof import industry_at
from tidemark.session import stage

_SEL = """(SELECT m.date AS signal_date, m.symbol, m.index_weight AS target_weight, i.industry_code, i.industry_name,
   f.mom_12_1, f.volatility, f.trend, CASE WHEN m.symbol % 3 = 0 THEN 'HOLD_BUFFER' ELSE 'NEW_ENTRY' END AS selection_reason
   FROM membership m JOIN industries i ON i.symbol = m.symbol AND i.in_date <= m.date AND (i.out_date IS NULL OR i.out_date >= m.date)
   LEFT JOIN month_features f ON f.signal_date = m.date AND f.symbol = m.symbol)"""


def selection(t):
    m = t.membership.select(F.col("date").alias("signal_date"), "symbol", F.col("index_weight").alias("target_weight"))
    m = industry_at(m, t.industries)
    f = t.month_features.select("signal_date", "symbol", "mom_12_1", "volatility", "trend")
    reason = F.when(F.col("symbol") % 3 == 0, "HOLD_BUFFER").otherwise("NEW_ENTRY")
    return m.join(f, ["signal_date", "symbol"], "left").withColumn("selection_reason", reason)


@query(
    "A1_industry_exposure",
    "signal_date:d industry_code:s industry_name:s holding_count:i target_weight:f stock_book_weight:f",
    f"""SELECT *, target_weight / sum(target_weight) OVER (PARTITION BY signal_date) AS stock_book_weight FROM (
        SELECT signal_date, industry_code, industry_name, count(DISTINCT symbol) AS holding_count,
        sum(target_weight) AS target_weight FROM {_SEL} GROUP BY ALL)""",
)
def _(t):
    return perf.industry_exposure(selection(t))


@query(
    "A2_style_exposure",
    "signal_date:d selected_count:i target_exposure:f buffered_count:i buffered_selection_ratio:f mom_12_1:f volatility:f trend:f",
    f"""SELECT signal_date, count(DISTINCT symbol) AS selected_count, sum(target_weight) AS target_exposure,
        sum((selection_reason = 'HOLD_BUFFER')::INT) AS buffered_count, avg((selection_reason = 'HOLD_BUFFER')::INT) AS buffered_selection_ratio,
        sum(mom_12_1 * target_weight) / sum(CASE WHEN mom_12_1 IS NOT NULL THEN target_weight END) AS mom_12_1,
        sum(volatility * target_weight) / sum(CASE WHEN volatility IS NOT NULL THEN target_weight END) AS volatility,
        sum(trend * target_weight) / sum(CASE WHEN trend IS NOT NULL THEN target_weight END) AS trend
        FROM {_SEL} GROUP BY signal_date""",
)
def _(t):
    return perf.style_exposure(selection(t), ["mom_12_1", "volatility", "trend"])


@query(
    "A3_bundle_audit",
    "fundamental_rows:i valuation_rows:i expected_symbols:i fundamental_symbols:i valuation_symbols:i "
    "fundamental_symbol_coverage:f valuation_symbol_coverage:f metrics:i first_period_end:d last_available_date:d",
    """WITH e AS (SELECT s_suppkey AS symbol FROM supplier UNION SELECT c_custkey FROM customer)
       SELECT (SELECT count(*) FROM facts) AS fundamental_rows, (SELECT count(*) FROM valuations) AS valuation_rows,
       (SELECT count(*) FROM e) AS expected_symbols, (SELECT count(DISTINCT symbol) FROM facts) AS fundamental_symbols,
       (SELECT count(DISTINCT symbol) FROM valuations) AS valuation_symbols,
       (SELECT count(*) FROM e WHERE symbol IN (SELECT symbol FROM facts)) / (SELECT count(*) FROM e) AS fundamental_symbol_coverage,
       (SELECT count(*) FROM e WHERE symbol IN (SELECT symbol FROM valuations)) / (SELECT count(*) FROM e) AS valuation_symbol_coverage,
       (SELECT count(DISTINCT metric) FROM facts) AS metrics, (SELECT min(period_end) FROM facts) AS first_period_end,
       greatest((SELECT max(available_date) FROM facts), (SELECT max(available_date) FROM valuations)) AS last_available_date""",
)
def _(t):
    expected = t.raw("supplier").select(F.col("s_suppkey").alias("symbol")).union(
        t.raw("customer").select("c_custkey")
    )
    return pit.pit_audit(t.facts, t.valuations, expected)


@query(
    "A3_missing_symbols",
    "kind:s symbol:i",
    """WITH e AS (SELECT s_suppkey AS symbol FROM supplier UNION SELECT c_custkey FROM customer)
       SELECT 'fundamental' AS kind, symbol FROM e WHERE symbol NOT IN (SELECT symbol FROM facts)
       UNION ALL SELECT 'valuation', symbol FROM e WHERE symbol NOT IN (SELECT symbol FROM valuations)""",
)
def _(t):
    expected = t.raw("supplier").select(F.col("s_suppkey").alias("symbol")).union(
        t.raw("customer").select("c_custkey")
    ).distinct()
    # kept as rows: a list column would gather an unbounded set in one place
    return agg.missing_keys({"fundamental": t.facts, "valuation": t.valuations}, expected, ["symbol"])


@query(
    "A4_latest_fact_lineage",
    "symbol:i signal_date:d latest_fundamental_period_end:d latest_fundamental_available_date:d visible_fundamental_metric_count:i",
    """WITH v AS (SELECT e.signal_date, f.* FROM month_ends e JOIN facts f ON f.available_date <= e.signal_date
         AND date_diff('day', f.period_end, e.signal_date) <= 550
         QUALIFY row_number() OVER (PARTITION BY e.signal_date, f.symbol, f.metric ORDER BY f.period_end DESC,
           f.available_date DESC, f.revision_sequence DESC, f.source_row_sha256 DESC) = 1)
       SELECT symbol, signal_date, max(period_end) AS latest_fundamental_period_end, max(available_date) AS latest_fundamental_available_date,
       count(DISTINCT metric) AS visible_fundamental_metric_count FROM v GROUP BY 1, 2""",
)
def _(t):
    return pit.fact_lineage(pit.facts_on_dates(t.facts, t.month_ends, 550, metrics=FACT_METRICS))


@query(
    "A5_status_counts",
    "api_name:s status:s tasks:i row_count:i",
    """SELECT o_orderpriority AS api_name, o_orderstatus AS status, count(*) AS tasks, sum(o_orderkey % 1000) AS row_count
       FROM orders GROUP BY 1, 2""",
)
def _(t):
    from tidemark.operators.catalog import status_counts

    o = t.raw("orders").select(
        F.col("o_orderpriority").alias("api_name"), F.col("o_orderstatus").alias("status"), (F.col("o_orderkey") % 1000).alias("row_count")
    )
    return status_counts(o, ["api_name"])


@query(
    "A6_decision_gates",
    "api_name:s total:i all_terminal:b no_suspect_truncated:b success_ratio:f success_enough:b accepted:b",
    """SELECT *, all_terminal AND no_suspect_truncated AND success_enough AS accepted FROM (
       SELECT o_orderpriority AS api_name, count(*) AS total,
       count(*) FILTER ((o_orderstatus = 'O' AND o_orderkey % 50 = 0) OR (o_orderstatus = 'P' AND o_orderkey % 997 = 0)) = 0 AS all_terminal,
       count(*) FILTER (o_orderstatus = 'P' AND o_orderkey % 997 = 0) = 0 AS no_suspect_truncated,
       count(*) FILTER (NOT (o_orderstatus = 'O' AND o_orderkey % 50 = 0) AND NOT (o_orderstatus = 'P' AND o_orderkey % 997 = 0)) / count(*) AS success_ratio,
       success_ratio >= 0.995 AS success_enough FROM orders GROUP BY 1)""",
)
def _(t):
    from tidemark.operators.catalog import batch_gates

    status = (
        F.when((F.col("o_orderstatus") == "O") & (F.col("o_orderkey") % 50 == 0), "pending")
        .when((F.col("o_orderstatus") == "P") & (F.col("o_orderkey") % 997 == 0), "suspect_truncated")
        .otherwise("success")
    )
    return batch_gates(t.raw("orders").select(F.col("o_orderpriority").alias("api_name"), status.alias("status")), ["api_name"])


@query(
    "A7_coverage_summary",
    "minimum:f p05:f median:f latest:f",
    """SELECT min(n) AS minimum, quantile_cont(n, 0.05) AS p05, quantile_cont(n, 0.5) AS median, arg_max(n, date) AS latest
       FROM (SELECT date, count(*)::DOUBLE AS n FROM bars GROUP BY 1)""",
)
def _(t):
    daily = t.bars.groupBy("date").agg(F.count(F.lit(1)).cast("double").alias("n"))
    return agg.coverage_summary(daily, "n", "date")


@query(
    "A8_linear_quantiles",
    "signal_date:d n:i p05:f p50:f p95:f",
    """SELECT signal_date, count(volatility) AS n, quantile_cont(volatility, 0.05) AS p05, quantile_cont(volatility, 0.5) AS p50,
       quantile_cont(volatility, 0.95) AS p95 FROM month_features WHERE volatility IS NOT NULL GROUP BY 1""",
)
def _(t):
    return xsec.exact_quantiles(stage(t.month_features.select("signal_date", "volatility")), ["signal_date"], "volatility", [0.05, 0.5, 0.95], ["p05", "p50", "p95"])


@query(
    "A9_nearest_rank_percentiles",
    "event_type:s n:i p50:f p95:f p99:f",
    """SELECT event_type, count(*) AS n, list_sort(list(value))[(round_even(0.5 * (count(*) - 1), 0) + 1)::BIGINT] AS p50,
       list_sort(list(value))[(round_even(0.95 * (count(*) - 1), 0) + 1)::BIGINT] AS p95,
       list_sort(list(value))[(round_even(0.99 * (count(*) - 1), 0) + 1)::BIGINT] AS p99 FROM events GROUP BY 1""",
)
def _(t):
    return agg.nearest_rank(t.raw("events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@query(
    "A10_distribution_summary",
    "symbol:i n:i mean:f median:f deviation:f positive_ratio:f maximum:f",
    """SELECT symbol, count(mom_6_1) AS n, avg(mom_6_1) AS mean, median(mom_6_1) AS median, stddev_samp(mom_6_1) AS deviation,
       avg((mom_6_1 > 0)::INT) AS positive_ratio, max(mom_6_1) AS maximum FROM month_features WHERE mom_6_1 IS NOT NULL GROUP BY 1""",
)
def _(t):
    return agg.summarise(stage(t.month_features.select("symbol", "mom_6_1")), ["symbol"], "mom_6_1")


@query(
    "A11_pairwise_covariance",
    "s1:s s2:s observations:i covariance:f",
    """WITH r AS (SELECT arm, date, nav / lag(nav) OVER (PARTITION BY arm ORDER BY date) - 1 AS r FROM curves)
       SELECT a.arm AS s1, b.arm AS s2, count(*) AS observations, covar_samp(a.r, b.r) * 10000 AS covariance FROM r a JOIN r b USING (date)
       WHERE a.r IS NOT NULL AND b.r IS NOT NULL AND a.arm <= b.arm GROUP BY 1, 2 HAVING count(*) >= 60""",
)
def _(t):
    from pyspark.sql import Window

    w = Window.partitionBy("arm").orderBy("date")
    r = t.curves.select("arm", "date", (F.col("nav") / F.lag("nav").over(w) - 1).alias("r"))
    return agg.pairwise_cov(r, "arm", "date", "r", 60).withColumn("covariance", F.col("covariance") * 10000)


@query(
    "A12_partial_and_final_stats",
    "metric:s rows:i symbols:i first_period:d last_available:d",
    """SELECT metric, count(*) AS rows, count(DISTINCT symbol) AS symbols, min(period_end) AS first_period, max(available_date) AS last_available
       FROM fact_rows GROUP BY 1""",
)
def _(t):
    return t.fact_rows.groupBy("metric").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("symbol").alias("symbols"),
        F.min("period_end").alias("first_period"), F.max("available_date").alias("last_available"),
    )


@query("A13_distinct", "symbol:i month:d", "SELECT DISTINCT symbol, date_trunc('month', date)::DATE AS month FROM bars")
def _(t):
    return t.bars.select("symbol", F.trunc("date", "MM").alias("month")).distinct()


@query(
    "A14_dates_per_symbol",
    "symbol:i dates:i joined:s",
    """SELECT symbol, count(DISTINCT available_date) AS dates, string_agg(DISTINCT strftime(available_date, '%Y%m%d'), ',' ORDER BY
       strftime(available_date, '%Y%m%d')) AS joined FROM valuations GROUP BY 1""",
)
def _(t):
    out = agg.collect_by(t.valuations, ["symbol"], "available_date", "dates_list")
    return out.select(
        "symbol", F.size("dates_list").alias("dates"),
        F.concat_ws(",", F.transform("dates_list", lambda d: F.date_format(d, "yyyyMMdd"))).alias("joined"),
    )
