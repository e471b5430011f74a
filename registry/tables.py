"""The test tables seen as market data: one DataFrame and one SQL text per view.

Suppliers act as securities, line items as trades, orders as reported figures.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import row_sha
from tidemark.operators import calendar as cal_ops
from tidemark.operators import features, pit
from tidemark.session import stage

# Which reported metric an order priority stands for.
PRIORITY_METRIC = {
    "1-URGENT": "roe_pct",
    "2-HIGH": "gross_margin_pct",
    "3-MEDIUM": "debt_to_assets_pct",
    "4-NOT SPECIFIED": "revenue_yoy_pct",
    "5-LOW": "net_income_yoy_pct",
}
FACT_METRICS = list(PRIORITY_METRIC.values())


_CALENDARS: dict[tuple[str, str], DataFrame] = {}


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")
        self.parts: dict[str, DataFrame] | None = None  # a bundle keeps here what several of its tables read

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def calendar(self) -> DataFrame:
        """A base table in practice: derived once per session and folder, at most a row per day."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir)
        if key not in _CALENDARS:
            _CALENDARS[key] = stage(cal_ops.calendar(self.raw("lineitem"), "l_shipdate"))
        return _CALENDARS[key]

    @cached_property
    def month_ends(self) -> DataFrame:
        return cal_ops.month_ends(self.calendar)

    @cached_property
    def bars(self) -> DataFrame:
        unit = F.col("l_extendedprice") / F.col("l_quantity")
        return (
            self.raw("lineitem")
            .groupBy(F.col("l_shipdate").cast("date").alias("date"), F.col("l_suppkey").alias("symbol"))
            .agg(
                F.avg(unit).alias("open"),
                F.max(unit).alias("high"),
                F.min(unit).alias("low"),
                (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("close"),
                F.sum("l_quantity").alias("volume"),
                F.sum("l_extendedprice").alias("amount"),
            )
        )

    @cached_property
    def market(self) -> DataFrame:
        """Bars with adjustment factor, previous close, limits, flags and market value."""
        q = (F.year("date") - 1995) * 4 + F.quarter("date")
        w = Window.partitionBy("symbol").orderBy("date")
        m = self.bars.select(
            "*",
            (1 + q * 0.01).alias("adj_factor"),
            F.lag("close").over(w).alias("prev_close"),
            (F.col("symbol") % 17 == 3).alias("is_st"),
            (F.col("close") * (1000 + F.col("symbol"))).alias("total_mv"),
        )
        return m.select(
            "*",
            (F.col("close") * F.col("adj_factor")).alias("total_close"),
            (F.col("prev_close") * 1.1).alias("up_limit"),
            (F.col("prev_close") * 0.9).alias("down_limit"),
        )

    @cached_property
    def price_features(self) -> DataFrame:
        return features.liquidity_features(features.price_features(self.market))

    @cached_property
    def month_features(self) -> DataFrame:
        """Features of each symbol's last bar in a month, dated at the month's last trading day."""
        f = self.price_features.withColumn("month", F.trunc("date", "MM"))
        # only the last bar of a month survives, so rank down from the month's end
        last = Window.partitionBy("symbol").orderBy("date")
        f = f.withColumn("_next", F.lead("month").over(last)).where(
            F.col("_next").isNull() | (F.col("_next") != F.col("month"))
        )
        ends = self.month_ends.select("month", "signal_date")
        return f.join(F.broadcast(ends), "month").drop("_next", "month")

    @cached_property
    def adj_factors(self) -> DataFrame:
        first = self.bars.groupBy("symbol", F.date_trunc("quarter", "date").cast("date").alias("q")).agg(
            F.min("date").alias("date")
        )
        q = (F.year("q") - 1995) * 4 + F.quarter("q")
        return first.select("symbol", "date", (1 + q * 0.01).alias("factor"))

    @cached_property
    def months(self) -> DataFrame:
        """A symbol's month: its last bar, mean close and amount."""
        return self.bars.groupBy("symbol", F.trunc("date", "MM").alias("month")).agg(
            F.max("date").alias("date"),
            F.max_by("close", "date").alias("close"),
            F.avg("close").alias("avg_close"),
            F.sum("amount").alias("amount"),
        )

    @cached_property
    def membership(self) -> DataFrame:
        """Month-end members: symbols that traded at least the month's average amount."""
        m = self.months.select("month", "symbol", "amount")
        avg = m.groupBy("month").agg(F.avg("amount").alias("_avg"), F.sum("amount").alias("_all"))
        ends = self.month_ends.select("month", "signal_date")
        return (
            m.join(F.broadcast(avg), "month")
            .where(F.col("amount") >= F.col("_avg"))
            .join(F.broadcast(ends), "month")
            .select(
                F.col("signal_date").alias("date"), "symbol", (F.col("amount") / F.col("_all")).alias("index_weight")
            )
        )

    @cached_property
    def member_intervals(self) -> DataFrame:
        """Runs of consecutive member months as half-open intervals."""
        w = Window.partitionBy("symbol").orderBy("m")
        m = self.membership.select("symbol", F.trunc("date", "MM").alias("m"))
        idx = F.year("m") * 12 + F.month("m")
        run = m.withColumn("_g", idx - F.row_number().over(w))
        return run.groupBy("symbol", "_g").agg(
            F.min("m").alias("opt_in"), F.add_months(F.max("m"), 1).alias("opt_out")
        ).select("symbol", "opt_in", "opt_out")

    @cached_property
    def industries(self) -> DataFrame:
        s = self.raw("supplier").join(
            F.broadcast(self.raw("nation")), F.col("s_nationkey") == F.col("n_nationkey")
        )
        old = s.select(
            F.col("s_suppkey").alias("symbol"),
            F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("industry_code"),
            F.concat(F.lit("region "), F.col("n_regionkey").cast("string")).alias("industry_name"),
            F.lit("1990-01-01").cast("date").alias("in_date"),
            F.lit("1998-06-30").cast("date").alias("out_date"),
        )
        new = s.select(
            F.col("s_suppkey").alias("symbol"),
            F.concat(F.lit("N"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("industry_code"),
            F.col("n_name").alias("industry_name"),
            F.lit("1998-07-01").cast("date").alias("in_date"),
            F.lit(None).cast("date").alias("out_date"),
        )
        return old.unionByName(new)

    @cached_property
    def securities(self) -> DataFrame:
        return self.raw("supplier").select(
            F.col("s_suppkey").alias("symbol"),
            F.col("s_name").alias("name"),
            F.date_add(F.lit("1995-01-01").cast("date"), (F.col("s_suppkey") % 50).cast("int")).alias("list_date"),
            F.when(
                F.col("s_suppkey") % 23 == 5,
                F.date_add(F.lit("1999-01-01").cast("date"), (F.col("s_suppkey") % 400).cast("int")),
            ).alias("delist_date"),
        )

    @cached_property
    def fact_rows(self) -> DataFrame:
        """Orders as reported figures before revision numbering."""
        metric = F.create_map(*[F.lit(x) for kv in PRIORITY_METRIC.items() for x in kv])
        o = self.raw("orders").select(
            F.floor(F.col("o_custkey") / 15).cast("long").alias("symbol"),
            F.lit("fina_indicator").alias("source"),
            metric[F.col("o_orderpriority")].alias("metric"),
            F.lit("percent").alias("unit"),
            F.date_sub(F.date_trunc("quarter", "o_orderdate").cast("date"), 1).alias("period_end"),
            F.col("o_orderdate").cast("date").alias("announcement_date"),
            F.lit("1").alias("report_type"),
            F.lit("1").alias("company_type"),
            F.col("o_orderstatus").alias("source_update_flag"),
            F.sha2(F.col("o_orderkey").cast("string"), 256).alias("source_row_sha256"),
            F.col("o_totalprice").alias("value"),
        )
        return cal_ops.with_availability(o, self.calendar, "announcement_date", 1).where(
            F.col("available_date").isNotNull()
        )

    @cached_property
    def facts(self) -> DataFrame:
        return pit.revision_sequence(self.fact_rows, pit.REPORT_KEY).select(*pit.FACT_COLUMNS)

    @cached_property
    def valuations(self) -> DataFrame:
        """One valuation per symbol and month, at its last bar."""
        return self.months.select(
            "date",
            F.col("date").alias("available_date"),
            "symbol",
            (F.col("symbol") % 9 + 0.5).alias("turnover_rate_pct"),
            (F.col("close") / F.col("avg_close") * 20 - 10).alias("pe_ttm"),
            (F.col("close") / 1000).alias("pb"),
            (F.col("avg_close") / 500).alias("ps_ttm"),
            (F.col("symbol") % 7 * 0.5).alias("dividend_yield_ttm_pct"),
            F.col("amount").alias("total_market_value_10k_cny"),
            (F.col("amount") * 0.6).alias("float_market_value_10k_cny"),
        )

    @cached_property
    def benchmark(self) -> DataFrame:
        li = self.raw("lineitem")
        return li.groupBy(F.col("l_shipdate").cast("date").alias("date")).agg(
            (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("close")
        )

    @cached_property
    def curves(self) -> DataFrame:
        """Daily value series of four arms (symbol groups), starting near 1."""
        arm = F.concat(F.lit("arm"), (F.col("symbol") % 4).cast("string")).alias("arm")
        day = self.price_features.groupBy(arm, "date").agg(
            F.avg("return_1d").alias("r"), F.sum("amount").alias("amount")
        )
        bw = Window.orderBy("date")
        bench = self.benchmark.select(
            "date", F.least(F.greatest((F.col("close") / F.lag("close").over(bw) - 1) * 0.01, F.lit(-0.05)), F.lit(0.05)).alias("rb")
        )
        bench = bench.select(
            "date", F.product(1 + F.coalesce("rb", F.lit(0.0))).over(bw.rowsBetween(Window.unboundedPreceding, 0)).alias("benchmark_nav")
        )
        w = Window.partitionBy("arm").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
        ret = F.coalesce(F.least(F.greatest((F.col("r") - 1.7) * 0.01, F.lit(-0.05)), F.lit(0.05)), F.lit(0.0))
        return day.join(F.broadcast(bench), "date").select(
            "arm", "date", F.product(1 + ret).over(w).alias("nav"), "benchmark_nav",
            (F.dayofyear("date") % 10 / 10).alias("gross_exposure"),
            F.sum(F.col("amount") * 1e-9).over(w).alias("cumulative_notional"),
            F.sum(F.col("amount") * 1e-12).over(w).alias("cumulative_fees"),
        )

    @cached_property
    def tiers(self) -> DataFrame:
        """Fee tiers moved into the years the test tables cover."""
        return self.spark.sql(
            """SELECT * FROM VALUES
            (DATE'1900-01-01', DATE'1997-04-28', 0.0010D, 0.00002D),
            (DATE'1997-04-29', DATE'1999-08-27', 0.0010D, 0.00001D),
            (DATE'1999-08-28', CAST(NULL AS DATE), 0.0005D, 0.00001D)
            AS t(start_date, end_date, stamp_duty_sell, transfer_fee_rate)"""
        )


ORACLE_VIEWS: dict[str, str] = {
    "calendar": """SELECT date, row_number() OVER (ORDER BY date) AS ord
        FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem)""",
    "month_ends": """SELECT date_trunc('month', date)::DATE AS month, max(date) AS signal_date, max(ord) AS ord
        FROM calendar GROUP BY 1""",
    "bars": """SELECT CAST(l_shipdate AS DATE) AS date, l_suppkey AS symbol,
        avg(l_extendedprice / l_quantity) AS open, max(l_extendedprice / l_quantity) AS high,
        min(l_extendedprice / l_quantity) AS low, sum(l_extendedprice) / sum(l_quantity) AS close,
        sum(l_quantity) AS volume, sum(l_extendedprice) AS amount FROM lineitem GROUP BY 1, 2""",
    "market": """SELECT *, close * adj_factor AS total_close, prev_close * 1.1 AS up_limit,
        prev_close * 0.9 AS down_limit FROM (
        SELECT *, 1 + ((year(date) - 1995) * 4 + quarter(date)) * 0.01::DOUBLE AS adj_factor,
        lag(close) OVER (PARTITION BY symbol ORDER BY date) AS prev_close,
        symbol % 17 = 3 AS is_st, close * (1000 + symbol) AS total_mv FROM bars)""",
    "price_features": """SELECT * EXCLUDE (peak, whole, up, down, sd, dsd, seen),
        total_close / ma_200 - 1 AS trend,
        CASE WHEN seen >= 50 THEN sd * sqrt(252) END AS volatility,
        CASE WHEN seen >= 50 THEN sqrt(dsd) * sqrt(252) END AS downside_volatility,
        sign(mom_12_1) * CASE WHEN whole >= 231 THEN down - up END AS information_discreteness,
        mom_12_1 * (1 - sign(mom_12_1) * CASE WHEN whole >= 231 THEN down - up END) AS fip_momentum,
        total_close / peak - 1 AS drawdown_quality
        FROM (SELECT *,
          stddev_pop(return_1d) OVER v AS sd, avg(CASE WHEN return_1d IS NOT NULL THEN least(return_1d, 0) ** 2 END) OVER v AS dsd,
          count(return_1d) OVER v AS seen, count(return_1d) OVER f AS whole,
          avg(CASE WHEN return_1d IS NULL THEN NULL WHEN return_1d > 0 THEN 1.0::DOUBLE ELSE 0.0 END) OVER f AS up,
          avg(CASE WHEN return_1d IS NULL THEN NULL WHEN return_1d < 0 THEN 1.0::DOUBLE ELSE 0.0 END) OVER f AS down
          FROM (SELECT *, total_close / lag(total_close) OVER w - 1 AS return_1d,
            lag(total_close, 21) OVER w / lag(total_close, 252) OVER w - 1 AS mom_12_1,
            lag(total_close, 21) OVER w / lag(total_close, 126) OVER w - 1 AS mom_6_1,
            CASE WHEN count(*) OVER m >= 200 THEN avg(total_close) OVER m END AS ma_200,
            CASE WHEN count(*) OVER k >= 126 THEN max(total_close) OVER k END AS peak,
            CASE WHEN count(*) OVER a >= 15 THEN avg(amount) OVER a END AS avg_amount_20,
            CASE WHEN count(*) OVER a >= 15 THEN avg(volume) OVER a END AS avg_volume_20,
            row_number() OVER w AS history_days FROM market
            WINDOW w AS (PARTITION BY symbol ORDER BY date),
              m AS (PARTITION BY symbol ORDER BY date ROWS 199 PRECEDING),
              k AS (PARTITION BY symbol ORDER BY date ROWS 125 PRECEDING),
              a AS (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING))
          WINDOW v AS (PARTITION BY symbol ORDER BY date ROWS 59 PRECEDING),
            f AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 251 PRECEDING AND 21 PRECEDING))""",
    "month_features": """SELECT f.*, e.signal_date FROM price_features f
        JOIN month_ends e ON date_trunc('month', f.date) = e.month
        QUALIFY row_number() OVER (PARTITION BY f.symbol, e.month ORDER BY f.date DESC) = 1""",
    "adj_factors": """SELECT symbol, min(date) AS date,
        1 + ((year(min(date)) - 1995) * 4 + quarter(min(date))) * 0.01::DOUBLE AS factor
        FROM bars GROUP BY symbol, date_trunc('quarter', date)""",
    "membership": """SELECT e.signal_date AS date, symbol, amount / total AS index_weight FROM (
        SELECT *, avg(amount) OVER (PARTITION BY month) AS mean, sum(amount) OVER (PARTITION BY month) AS total
        FROM (SELECT date_trunc('month', date)::DATE AS month, symbol, sum(amount) AS amount FROM bars GROUP BY 1, 2)
        ) t JOIN month_ends e USING (month) WHERE amount >= mean""",
    "member_intervals": """SELECT symbol, min(m) AS opt_in, (max(m) + INTERVAL 1 MONTH)::DATE AS opt_out FROM (
        SELECT symbol, m, year(m) * 12 + month(m) - row_number() OVER (PARTITION BY symbol ORDER BY m) AS g
        FROM (SELECT symbol, date_trunc('month', date)::DATE AS m FROM membership)) GROUP BY symbol, g""",
    "industries": """SELECT s_suppkey AS symbol, 'R' || n_regionkey AS industry_code,
        'region ' || n_regionkey AS industry_name, DATE '1990-01-01' AS in_date, DATE '1998-06-30' AS out_date
        FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL
        SELECT s_suppkey, 'N' || lpad(n_nationkey::VARCHAR, 2, '0'), n_name, DATE '1998-07-01', NULL
        FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "securities": """SELECT s_suppkey AS symbol, s_name AS name,
        (DATE '1995-01-01' + (s_suppkey % 50)::INT) AS list_date,
        CASE WHEN s_suppkey % 23 = 5 THEN (DATE '1999-01-01' + (s_suppkey % 400)::INT) END AS delist_date
        FROM supplier""",
    "fact_rows": """SELECT * FROM (SELECT o_custkey // 15 AS symbol, 'fina_indicator' AS source,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'roe_pct' WHEN '2-HIGH' THEN 'gross_margin_pct'
          WHEN '3-MEDIUM' THEN 'debt_to_assets_pct' WHEN '4-NOT SPECIFIED' THEN 'revenue_yoy_pct'
          WHEN '5-LOW' THEN 'net_income_yoy_pct' END AS metric, 'percent' AS unit,
        (date_trunc('quarter', o_orderdate)::DATE - 1) AS period_end,
        CAST(o_orderdate AS DATE) AS announcement_date,
        (SELECT min(c.date) FROM calendar c WHERE c.date > CAST(o_orderdate AS DATE)) AS available_date,
        '1' AS report_type, '1' AS company_type, o_orderstatus AS source_update_flag,
        sha256(o_orderkey::VARCHAR) AS source_row_sha256, o_totalprice AS value FROM orders)
        WHERE available_date IS NOT NULL""",
    "facts": """SELECT *, row_number() OVER (PARTITION BY symbol, source, period_end, report_type, company_type
        ORDER BY announcement_date, source_update_flag, source_row_sha256) AS revision_sequence FROM fact_rows""",
    "valuations": """SELECT date, date AS available_date, symbol, symbol % 9 + 0.5::DOUBLE AS turnover_rate_pct,
        close / avg_close * 20 - 10 AS pe_ttm, close / 1000 AS pb, avg_close / 500 AS ps_ttm,
        symbol % 7 * 0.5::DOUBLE AS dividend_yield_ttm_pct, amount AS total_market_value_10k_cny,
        amount * 0.6 AS float_market_value_10k_cny FROM (
        SELECT symbol, max(date) AS date, max_by(close, date) AS close, avg(close) AS avg_close, sum(amount) AS amount
        FROM bars GROUP BY symbol, date_trunc('month', date))""",
    "bench": """SELECT CAST(l_shipdate AS DATE) AS date, sum(l_extendedprice) / sum(l_quantity) AS close
        FROM lineitem GROUP BY 1""",
    "curves": """SELECT arm, date, product(1 + ret) OVER w AS nav, benchmark_nav,
        (dayofyear(date) % 10) / 10 AS gross_exposure, sum(amount * 1e-9::DOUBLE) OVER w AS cumulative_notional,
        sum(amount * 1e-12::DOUBLE) OVER w AS cumulative_fees FROM (
        SELECT 'arm' || symbol % 4 AS arm, date, coalesce(least(greatest((avg(return_1d) - 1.7) * 0.01, -0.05), 0.05), 0) AS ret,
          sum(amount) AS amount FROM price_features GROUP BY 1, 2) JOIN (
        SELECT date, product(1 + rb) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS benchmark_nav FROM (
          SELECT date, CASE WHEN lag(close) OVER (ORDER BY date) IS NULL THEN 0
            ELSE least(greatest((close / lag(close) OVER (ORDER BY date) - 1) * 0.01, -0.05), 0.05) END AS rb FROM bench)) USING (date)
        WINDOW w AS (PARTITION BY arm ORDER BY date ROWS UNBOUNDED PRECEDING)""",
    "tiers": """SELECT * FROM (VALUES (DATE '1900-01-01', DATE '1997-04-28', 0.0010::DOUBLE, 0.00002::DOUBLE),
        (DATE '1997-04-29', DATE '1999-08-27', 0.0010::DOUBLE, 0.00001::DOUBLE),
        (DATE '1999-08-28', NULL, 0.0005::DOUBLE, 0.00001::DOUBLE))
        AS t(start_date, end_date, stamp_duty_sell, transfer_fee_rate)""",
}
