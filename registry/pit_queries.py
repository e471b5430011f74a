"""Normalisation and point-in-time visibility queries."""

from pyspark.sql import functions as F

from registry import query
from registry.tables import FACT_METRICS
from tidemark.functions import factors, scalars as S
from tidemark.operators import asof, calendar as cal_ops, market, pit

_DAY = "DATE '1998-06-30'"


@query(
    "P1_provider_dates",
    "row_id:i parsed:d",
    """SELECT o_orderkey AS row_id, CASE WHEN o_orderkey % 5 = 3 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS parsed FROM orders""",
)
def _(t):
    d = F.col("o_orderdate")
    k = F.col("o_orderkey") % 5
    text = (
        F.when(k == 0, F.date_format(d, "yyyyMMdd"))
        .when(k == 1, F.concat(F.date_format(d, "yyyyMMdd"), F.lit(".0")))
        .when(k == 2, F.concat(F.lit("  "), F.date_format(d, "yyyy-MM-dd"), F.lit(" ")))
        .when(k == 3, F.lit("not a date"))
        .otherwise(F.date_format(d, "yyyy-MM-dd HH:mm:ss"))
    )
    return t.raw("orders").select(F.col("o_orderkey").alias("row_id"), S.provider_date(text).alias("parsed"))


def statements(t):
    """Orders as wide vendor statement rows: text dates, three figures, some not finite."""
    o = t.raw("orders")
    d = F.col("o_orderdate")
    k = F.col("o_orderkey")
    return o.select(
        F.floor(F.col("o_custkey") / 15).cast("string").alias("ts_code"),
        F.date_format(d, "yyyyMMdd").alias("ann_date"),
        F.when(k % 4 == 0, F.date_format(F.date_add(d.cast("date"), (k % 9).cast("int")), "yyyyMMdd")).alias("f_ann_date"),
        F.date_format(F.date_sub(F.date_trunc("quarter", d).cast("date"), 1), "yyyyMMdd").alias("end_date"),
        F.lit("1").alias("report_type"),
        F.lit("2").alias("comp_type"),
        F.when(F.col("o_orderstatus") == "F", "1").otherwise("0").alias("update_flag"),
        F.when(k % 7 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice")).alias("revenue"),
        F.when(k % 3 == 0, F.col("o_totalprice") * 0.25).alias("n_income_attr_p"),
        F.when(k % 11 == 0, F.lit("n/a")).otherwise((k % 100).cast("string")).alias("basic_eps"),
    )


_STATEMENT = """(SELECT DISTINCT o_custkey // 15 AS symbol, (date_trunc('quarter', o_orderdate)::DATE - 1) AS period_end,
    greatest(CAST(o_orderdate AS DATE), CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderdate AS DATE) + (o_orderkey % 9)::INT END) AS announcement_date,
    CASE WHEN o_orderstatus = 'F' THEN '1' ELSE '0' END AS flag, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS revenue,
    CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice * 0.25 END AS income, CASE WHEN o_orderkey % 11 <> 0 THEN (o_orderkey % 100)::DOUBLE END AS eps,
    o_orderdate AS od, o_orderkey % 4 = 0 AS late, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 9 END AS shift FROM orders)"""


@query(
    "P2_statement_to_metric_rows",
    "symbol:i metric:s unit:s period_end:d announcement_date:d available_date:d source_update_flag:s value:g",
    f"""WITH s AS (SELECT *, (SELECT min(c.date) FROM calendar c WHERE c.date > announcement_date) AS available_date FROM {_STATEMENT})
       SELECT symbol, metric, unit, period_end, announcement_date, available_date, flag AS source_update_flag, value FROM (
       SELECT s.*, 'revenue' AS metric, 'CNY' AS unit, revenue AS value FROM s UNION ALL
       SELECT s.*, 'net_income_parent', 'CNY', income FROM s UNION ALL SELECT s.*, 'basic_eps', 'CNY_per_share', eps FROM s)
       WHERE value IS NOT NULL AND available_date IS NOT NULL""",
)
def _(t):
    return pit.normalise_statements(statements(t), "income", t.calendar, 1)


@query(
    "P2_statement_revision_totals",
    "symbol:i period_end:d revisions:i metric_rows:i total:g",
    f"""WITH s AS (SELECT *, (SELECT min(c.date) FROM calendar c WHERE c.date > announcement_date) AS available_date FROM {_STATEMENT}),
       k AS (SELECT * FROM s WHERE available_date IS NOT NULL AND (revenue IS NOT NULL OR income IS NOT NULL OR eps IS NOT NULL))
       SELECT symbol, period_end, count(*) AS revisions, sum((revenue IS NOT NULL)::INT + (income IS NOT NULL)::INT + (eps IS NOT NULL)::INT) AS metric_rows,
       sum(coalesce(revenue, 0) + coalesce(income, 0) + coalesce(eps, 0)) AS total FROM k GROUP BY 1, 2""",
)
def _(t):
    f = pit.normalise_statements(statements(t), "income", t.calendar, 1)
    return f.groupBy("symbol", "period_end").agg(
        F.max("revision_sequence").alias("revisions"), F.count(F.lit(1)).alias("metric_rows"), F.sum("value").alias("total")
    )


@query(
    "P3_valuation_normaliser",
    "symbol:i date:d available_date:d pe_ttm:f pb:f total_market_value_10k_cny:g",
    """SELECT symbol, date, date AS available_date, CASE WHEN symbol % 6 = 1 THEN NULL ELSE close / 100 END AS pe_ttm, close / 1000 AS pb,
       CASE WHEN dup THEN amount * 2 ELSE amount END AS total_market_value_10k_cny
       FROM (SELECT *, symbol % 5 = 0 AS dup FROM bars)""",
)
def _(t):
    b = t.bars.select(
        F.col("symbol").cast("string").alias("ts_code"), F.date_format("date", "yyyyMMdd").alias("trade_date"),
        F.when(F.col("symbol") % 6 == 1, F.lit("-")).otherwise((F.col("close") / 100).cast("string")).alias("pe_ttm"),
        (F.col("close") / 1000).alias("pb"), F.col("amount").alias("total_mv"), F.lit(1).alias("load"),
    )
    again = b.where(F.col("ts_code").cast("long") % 5 == 0).withColumns({"total_mv": F.col("total_mv") * 2, "load": F.lit(2)})
    return pit.normalise_valuations(b.unionByName(again), t.calendar, 0, [F.col("load")])


@query(
    "P10_report_type_filter",
    "row_id:i report_type:s",
    "SELECT o_orderkey AS row_id, '1' AS report_type FROM orders WHERE o_orderkey % 4 IN (0, 1)",
)
def _(t):
    k = F.col("o_orderkey") % 4
    raw = F.when(k == 0, "1").when(k == 1, " 1.0").when(k == 2, "4")
    o = t.raw("orders").select(F.col("o_orderkey").alias("row_id"), S.report_type(raw).alias("report_type"))
    return o.where(F.col("report_type") == "1")


_VIS = f"""(SELECT * FROM facts WHERE available_date <= {_DAY} AND date_diff('day', period_end, {_DAY}) <= 550
   QUALIFY row_number() OVER (PARTITION BY symbol, source, metric, period_end, report_type, company_type
     ORDER BY available_date DESC, revision_sequence DESC, source_row_sha256 DESC) = 1)"""


@query(
    "R1_visible_facts",
    "symbol:i metric:s period_end:d available_date:d revision_sequence:i value:g",
    f"SELECT * FROM {_VIS}",
)
def _(t):
    return pit.visible_facts(t.facts, "1998-06-30", 550)


_LATEST = f"""(SELECT * FROM {_VIS} QUALIFY row_number() OVER (PARTITION BY symbol, metric ORDER BY period_end DESC, available_date DESC,
   revision_sequence DESC, source_row_sha256 DESC) = 1)"""
_PIVOT = ", ".join(f"max(CASE WHEN metric = '{m}' THEN value END) AS {m}" for m in FACT_METRICS)
_COLS = " ".join(f"{m}:g" for m in FACT_METRICS)


@query("R2_fundamental_snapshot", f"symbol:i as_of_date:d {_COLS}", f"SELECT symbol, {_DAY} AS as_of_date, {_PIVOT} FROM {_LATEST} GROUP BY symbol")
def _(t):
    return pit.fact_snapshot(t.facts, "1998-06-30", FACT_METRICS, 550)


@query(
    "R3_valuation_snapshot",
    "symbol:i date:d available_date:d pe_ttm:f pb:f total_market_value_10k_cny:g",
    f"""SELECT * FROM valuations WHERE available_date <= {_DAY} AND date_diff('day', date, {_DAY}) <= 10
        QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1""",
)
def _(t):
    return pit.valuation_snapshot(t.valuations, "1998-06-30", 10)


@query(
    "R4_combined_snapshot",
    f"symbol:i as_of_date:d {_COLS} pe_ttm:f pb:f valuation_date:d",
    f"""SELECT coalesce(f.symbol, v.symbol) AS symbol, {_DAY} AS as_of_date, f.* EXCLUDE (symbol), v.pe_ttm, v.pb, v.date AS valuation_date
        FROM (SELECT symbol, {_PIVOT} FROM {_LATEST} GROUP BY symbol) f FULL JOIN
        (SELECT * FROM valuations WHERE available_date <= {_DAY} AND date_diff('day', date, {_DAY}) <= 45
        QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1) v ON f.symbol = v.symbol""",
)
def _(t):
    return pit.combined_snapshot(t.facts, t.valuations, "1998-06-30", FACT_METRICS, 550, 45)


@query(
    "R5_snapshots_at_every_month_end",
    "signal_date:d symbol:i metric:s period_end:d available_date:d revision_sequence:i value:g",
    """SELECT e.signal_date, f.* FROM month_ends e JOIN facts f ON f.available_date <= e.signal_date AND date_diff('day', f.period_end, e.signal_date) <= 550
       QUALIFY row_number() OVER (PARTITION BY e.signal_date, f.symbol, f.metric ORDER BY f.period_end DESC, f.available_date DESC,
         f.revision_sequence DESC, f.source_row_sha256 DESC) = 1""",
)
def _(t):
    return pit.facts_on_dates(t.facts, t.month_ends, 550, metrics=FACT_METRICS)


@query(
    "R6_month_end_signal_dates",
    "variant:s signal_date:d",
    """SELECT 'plain' AS variant, signal_date FROM month_ends UNION ALL
       SELECT 'room_63', signal_date FROM month_ends WHERE ord + 63 <= (SELECT max(ord) FROM calendar) UNION ALL
       SELECT 'tradable', signal_date FROM month_ends WHERE ord + 1 <= (SELECT max(ord) FROM calendar)""",
)
def _(t):
    c = t.calendar
    tag = lambda v, df: df.select(F.lit(v).alias("variant"), "signal_date")
    return (
        tag("plain", cal_ops.month_ends(c))
        .unionByName(tag("room_63", cal_ops.month_ends(c, room=63)))
        .unionByName(tag("tradable", cal_ops.schedule(c)))
    )


@query(
    "P13_factor_transforms",
    "symbol:i date:d earnings_yield:f book_to_price:f sales_yield:f dividend_yield:f",
    """SELECT symbol, date, CASE WHEN pe_ttm > 0 THEN 1 / pe_ttm END AS earnings_yield, CASE WHEN pb > 0 THEN 1 / pb END AS book_to_price,
       CASE WHEN ps_ttm > 0 THEN 1 / ps_ttm END AS sales_yield, dividend_yield_ttm_pct AS dividend_yield FROM valuations""",
)
def _(t):
    cols = factors.factor_values(t.valuations, ["earnings_yield", "book_to_price", "sales_yield", "dividend_yield"])
    return t.valuations.select("symbol", "date", *[c.alias(n) for n, c in cols.items()])


@query(
    "P14_factor_registry_use",
    "factor:s source_kind:s observations:i",
    """SELECT 'earnings_yield' AS factor, 'valuation' AS source_kind, count(CASE WHEN pe_ttm > 0 THEN 1 END) AS observations FROM valuations
       UNION ALL SELECT 'book_to_price', 'valuation', count(pb) FROM valuations
       UNION ALL SELECT 'sales_yield', 'valuation', count(ps_ttm) FROM valuations
       UNION ALL SELECT 'pit_composite', 'derived', NULL""",
)
def _(t):
    names = ["earnings_yield", "book_to_price", "sales_yield"]
    cols = factors.factor_values(t.valuations, names)
    counts = t.valuations.agg(*[F.count(c).alias(n) for n, c in cols.items()])
    long = counts.unpivot([], names, "factor", "observations")
    return factors.registry_table(t.spark, names).join(F.broadcast(long), "factor", "left")
