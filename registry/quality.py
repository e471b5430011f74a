"""Data-quality rules over the tables, with faults derived from the rows themselves."""

from pyspark.sql import functions as F

from registry import query
from registry.tables import ORACLE_VIEWS
import registry.research  # noqa: F401  (panel views)
from tidemark.operators import calendar as cal_ops
from tidemark.operators import catalog, pit, quality as dq, recon
from tidemark.plans.factor_panel import build_score_panel
from tidemark.session import stage

_RULE = "rule:s violations:i"


def rules_sql(**counts):
    return " UNION ALL ".join(f"SELECT '{k}' AS rule, ({v}) AS violations" for k, v in counts.items())


# rows with planted faults, chosen by keys so both engines plant the same ones
ORACLE_VIEWS["dirty_bars"] = """SELECT date, symbol, open, CASE WHEN symbol % 31 = 4 AND day(date) = 9 THEN low * 0.5 ELSE high END AS high, low,
    CASE WHEN symbol % 19 = 2 AND day(date) = 5 THEN NULL WHEN symbol % 29 = 3 AND day(date) = 6 THEN -close ELSE close END AS close, prev_close,
    CASE WHEN symbol % 37 = 1 AND day(date) = 7 THEN -1 ELSE volume END AS volume, amount, adj_factor,
    CASE WHEN symbol % 23 = 2 THEN down_limit * 0.5 ELSE up_limit END AS up_limit, down_limit FROM market"""


def dirty_bars(t):
    s, d = F.col("symbol"), F.dayofmonth("date")
    m = t.market
    return m.select(
        "date", "symbol", "open", F.when((s % 31 == 4) & (d == 9), F.col("low") * 0.5).otherwise(F.col("high")).alias("high"), "low",
        F.when((s % 19 == 2) & (d == 5), None).when((s % 29 == 3) & (d == 6), -F.col("close")).otherwise(F.col("close")).alias("close"), "prev_close",
        F.when((s % 37 == 1) & (d == 7), -1.0).otherwise(F.col("volume")).alias("volume"), "amount", "adj_factor",
        F.when(s % 23 == 2, F.col("down_limit") * 0.5).otherwise(F.col("up_limit")).alias("up_limit"), "down_limit",
    )


_N = "SELECT count(*) FROM dirty_bars WHERE "


@query(
    "D2_D5_bar_rules", _RULE,
    rules_sql(
        bars_numeric_finite=_N + "close IS NULL OR prev_close IS NULL", bars_positive=_N + "close <= 0",
        bars_ohlc=_N + "(high + 1e-8 < greatest(open, close, low)) OR (low - 1e-8 > least(open, close, high))",
        bars_volume_amount=_N + "volume < 0 OR amount < 0", bars_limits=_N + "up_limit < down_limit",
    ),
)
def _(t):
    return dq.check_bars(dirty_bars(t))


@query(
    "D1_required_columns", "table_name:s column_name:s present:b rows:i",
    """SELECT 'market' AS table_name, c AS column_name, c <> 'circ_mv' AS present, (SELECT count(*) FROM bars) AS rows
       FROM (VALUES ('date'), ('symbol'), ('close'), ('adj_factor'), ('circ_mv')) v(c)""",
)
def _(t):
    need = ["date", "symbol", "close", "adj_factor", "circ_mv"]
    absent = set(dq.missing_columns(t.market, need))
    n = t.bars.agg(F.count(F.lit(1)).alias("rows"))
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(c not in absent).alias("present")) for c in need]))
    return n.select(F.lit("market").alias("table_name"), "rows", each.alias("x")).select("table_name", "x.*", "rows")


@query("D6_index_close", _RULE, rules_sql(benchmark_close="SELECT count(*) FROM bench WHERE day(date) = 13 OR close <= 0"))
def _(t):
    c = F.when(F.dayofmonth("date") == 13, None).otherwise(F.col("close"))
    return dq.check_index(t.benchmark.withColumn("close", c), "benchmark")


@query(
    "D7_action_rules", _RULE,
    rules_sql(actions_ex_date="SELECT count(*) FROM bars WHERE symbol % 13 = 0 AND day(date) = 1",
              actions_ratios="SELECT count(*) FROM bars WHERE symbol % 17 = 0 AND NOT (symbol % 13 = 0 AND day(date) = 1)"),
)
def _(t):
    gone = (F.col("symbol") % 13 == 0) & (F.dayofmonth("date") == 1)
    a = t.bars.select(
        F.when(~gone, F.col("date")).alias("ex_date"),
        F.when((F.col("symbol") % 17 == 0) & ~gone, -0.1).otherwise(0.1).alias("cash_dividend"), F.lit(0.0).alias("stock_dividend"),
    )
    return dq.check_actions(a)


@query(
    "D8_industry_rules", _RULE,
    rules_sql(industry_in_date="SELECT count(*) FROM industries WHERE symbol % 20 = 1", industry_labels="SELECT count(*) FROM industries WHERE symbol % 15 = 2",
              industry_order="SELECT count(*) FROM industries WHERE symbol % 10 = 3 AND out_date IS NOT NULL"),
)
def _(t):
    s = F.col("symbol")
    i = t.industries.withColumns(
        {
            "in_date": F.when(s % 20 == 1, None).otherwise(F.col("in_date")),
            "industry_name": F.when(s % 15 == 2, "  ").otherwise(F.col("industry_name")),
            "out_date": F.when((s % 10 == 3) & F.col("out_date").isNotNull(), F.lit("1980-01-01").cast("date")).otherwise(F.col("out_date")),
        }
    )
    return dq.check_industries(i)


@query(
    "D9_member_references", _RULE,
    rules_sql(
        members_in_bars="SELECT count(DISTINCT symbol) FROM membership WHERE symbol NOT IN (SELECT symbol FROM bars WHERE year(date) = 1996 AND month(date) = 2 AND day(date) <= 5)",
        members_in_securities="SELECT count(DISTINCT symbol) FROM membership WHERE symbol % 9 = 4",
    ),
)
def _(t):
    few = t.bars.where((F.year("date") == 1996) & (F.month("date") == 2) & (F.dayofmonth("date") <= 5))
    return dq.check_references(t.membership, {"bars": few, "securities": t.securities.where(F.col("symbol") % 9 != 4)})


@query(
    "D10_interval_coverage", "symbol:i date:d",
    "SELECT symbol, date FROM membership WHERE symbol % 4 = 2 AND date > DATE '1998-06-30'",
)
def _(t):
    return dq.uncovered_members(t.membership, t.industries.where(~((F.col("symbol") % 4 == 2) & F.col("out_date").isNull())))


@query("D11_snapshot_size", "date:d n:i", "SELECT date, count(DISTINCT symbol) AS n FROM membership GROUP BY 1 HAVING n < 45")
def _(t):
    return dq.small_snapshots(t.membership, 45)


@query(
    "D11_snapshot_gaps", "previous_date:d date:d gap_days:i",
    """SELECT * FROM (SELECT lag(date) OVER (ORDER BY date) AS previous_date, date, date_diff('day', lag(date) OVER (ORDER BY date), date) AS gap_days
       FROM (SELECT DISTINCT date FROM membership WHERE month(date) NOT IN (4, 5, 11))) WHERE gap_days > 62""",
)
def _(t):
    return cal_ops.date_gaps(t.membership.where(~F.month("date").isin(4, 5, 11)), 62)


@query(
    "D12_calendar_containment", _RULE,
    rules_sql(
        benchmark_off_calendar="SELECT count(*) FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders) WHERE d NOT IN (SELECT date FROM calendar)",
        benchmark_missing_days="SELECT count(*) FROM calendar WHERE date NOT IN (SELECT CAST(o_orderdate AS DATE) FROM orders)",
    ),
)
def _(t):
    o = t.raw("orders").select(F.col("o_orderdate").cast("date").alias("date"))
    return dq.calendar_containment(o, t.calendar, "benchmark")


ORACLE_VIEWS["dirty_facts"] = """SELECT * REPLACE (CASE WHEN symbol % 25 = 1 THEN '' ELSE metric END AS metric, CASE WHEN symbol % 25 = 2 THEN NULL ELSE value END AS value,
    CASE WHEN symbol % 25 = 3 THEN announcement_date + 400 ELSE period_end END AS period_end, CASE WHEN symbol % 25 = 4 THEN 'xyz' ELSE source_row_sha256 END AS source_row_sha256,
    CASE WHEN symbol % 25 = 5 THEN 'CNY' ELSE unit END AS unit, CASE WHEN symbol % 25 = 6 THEN 0 ELSE revision_sequence END AS revision_sequence) FROM facts"""


def dirty_facts(t):
    k = F.col("symbol") % 25
    put = lambda i, v, c: F.when(k == i, v).otherwise(F.col(c))
    return t.facts.withColumns(
        {
            "metric": put(1, F.lit(""), "metric"), "value": put(2, F.lit(None), "value"),
            "period_end": put(3, F.date_add("announcement_date", 400), "period_end"),
            "source_row_sha256": put(4, F.lit("xyz"), "source_row_sha256"), "unit": put(5, F.lit("CNY"), "unit"),
            "revision_sequence": put(6, F.lit(0), "revision_sequence"),
        }
    )


_FACTS = "SELECT count(*) FROM dirty_facts WHERE "


@query(
    "D13_D14_fact_rules", _RULE,
    rules_sql(
        facts_dates=_FACTS + "period_end IS NULL", facts_labels=_FACTS + "metric = ''", facts_period_after_announcement=_FACTS + "period_end > announcement_date",
        facts_value_finite=_FACTS + "value IS NULL", facts_revision=_FACTS + "revision_sequence < 1", facts_hash=_FACTS + "source_row_sha256 = 'xyz'",
        facts_symbol=_FACTS + "symbol % 7 = 3", facts_dictionary="SELECT count(*) FROM (SELECT DISTINCT metric, unit FROM dirty_facts WHERE metric = '' OR unit = 'CNY')",
    ),
)
def _(t):
    from tidemark.functions.scalars import valid_symbol

    code = F.concat(F.lpad(F.col("symbol").cast("string"), 6, "0"), F.when(F.col("symbol") % 7 == 3, ".XX").otherwise(".SH"))
    return dq.check_facts(dirty_facts(t), pit.metric_dictionary(t.spark), valid_symbol(code))


@query(
    "D15_unique_keys", _RULE,
    rules_sql(
        facts_duplicate_key="SELECT count(*) FROM facts WHERE symbol % 11 = 5",
        valuations_duplicate_day="SELECT count(*) FROM valuations WHERE symbol % 6 = 1", valuations_conflicting_copies="SELECT count(*) FROM valuations WHERE symbol % 12 = 1",
    ),
)
def _(t):
    f = t.facts.unionByName(t.facts.where(F.col("symbol") % 11 == 5))
    vals = stage(t.valuations)  # read twice: both copies must carry identical sums
    again = vals.where(F.col("symbol") % 6 == 1).withColumn("pb", F.when(F.col("symbol") % 12 == 1, F.col("pb") + 1).otherwise(F.col("pb")))
    return dq.check_unique(f, vals.unionByName(again))


@query(
    "D16_stored_availability", "symbol:i metric:s announcement_date:d available_date:d",
    "SELECT symbol, metric, announcement_date, announcement_date AS available_date FROM fact_rows WHERE symbol % 14 = 2",
)
def _(t):
    f = t.fact_rows.withColumn("available_date", F.when(F.col("symbol") % 14 == 2, F.col("announcement_date")).otherwise(F.col("available_date")))
    return dq.wrong_availability(f, t.calendar, "announcement_date", 1)


@query(
    "D17_valuation_rules", _RULE,
    rules_sql(valuations_all_null="SELECT count(*) FROM valuations WHERE symbol % 18 = 7", valuations_market_value="SELECT count(*) FROM valuations WHERE symbol % 18 = 8"),
)
def _(t):
    k = F.col("symbol") % 18
    cols = [c for c in t.valuations.columns if c not in ("symbol", "date", "available_date")]
    v = t.valuations.withColumns({c: F.when(k == 7, None).otherwise(F.col(c)) for c in cols})
    return dq.check_valuations(v.withColumn("total_market_value_10k_cny", F.when(k == 8, 0.0).otherwise(F.col("total_market_value_10k_cny"))))


@query(
    "D18_contiguous_revisions", "symbol:i period_end:d lo:i hi:i n:i",
    """SELECT symbol, period_end, min(revision_sequence) AS lo, max(revision_sequence) AS hi, count(*) AS n FROM facts WHERE NOT (symbol % 8 = 1 AND revision_sequence = 2)
       GROUP BY 1, 2 HAVING min(revision_sequence) <> 1 OR max(revision_sequence) <> count(*)""",
)
def _(t):
    return dq.broken_revisions(t.facts.where(~((F.col("symbol") % 8 == 1) & (F.col("revision_sequence") == 2))))


@query(
    "D19_score_panel_contract", _RULE,
    rules_sql(panel_signal_date="0", panel_factor_count="0", panel_score_finite="0", panel_future_dates="SELECT count(*) FROM (SELECT m.symbol FROM panel_signals e JOIN membership m ON m.date = e.signal_date WHERE e.next_ord IS NOT NULL OR e.ord < (SELECT max(ord) FROM calendar)) WHERE symbol % 10 = 1",
              panel_as_of="0", panel_forward_labels="0", panel_duplicate_rows="0",
              panel_universe_size="SELECT count(DISTINCT e.signal_date) FROM panel_signals e WHERE day(e.signal_date) = 31 AND e.ord < (SELECT max(ord) FROM calendar)"),
)
def _(t):
    p = build_score_panel(
        calendar=t.calendar, membership=t.membership, facts=t.facts, valuations=t.valuations,
        names=["roe_quality", "earnings_yield", "book_to_price"], minimum_factors=2, valuation_age=45,
    )
    p = p.withColumns(
        {
            "valuation_date": F.when(F.col("symbol") % 10 == 1, F.date_add("signal_date", 3)).otherwise(F.col("valuation_date")),
            "universe_size": F.when(F.dayofmonth("signal_date") == 31, F.col("universe_size") + 1).otherwise(F.col("universe_size")),
        }
    )
    return dq.check_score_panel(p, "z_pit_composite", 3)


@query(
    "D20_snapshot_anomalies", "date:d constituents:f median:f",
    """WITH s AS (SELECT date, count(DISTINCT symbol)::DOUBLE AS constituents FROM membership WHERE NOT (month(date) = 6 AND symbol % 2 = 0) GROUP BY 1)
       SELECT *, (SELECT median(constituents) FROM s) AS median FROM s WHERE constituents < 10 OR constituents < (SELECT median(constituents) FROM s) * 0.95""",
)
def _(t):
    return dq.snapshot_anomalies(t.membership.where(~((F.month("date") == 6) & (F.col("symbol") % 2 == 0))), 10)


@query(
    "D21_acceptance_gates", "gate:s ok:b detail:i",
    """SELECT 'calendar_span' AS gate, min(date) <= DATE '1995-06-01' AND max(date) >= DATE '2001-06-01' AS ok, count(*) AS detail FROM calendar UNION ALL
       SELECT 'member_master', count(*) = 0, count(*) FROM (SELECT DISTINCT symbol FROM membership WHERE symbol NOT IN (SELECT symbol FROM securities)) UNION ALL
       SELECT 'month_coverage', count(*) = 0, count(*) FROM month_ends WHERE signal_date NOT IN (SELECT date FROM membership) UNION ALL
       SELECT 'day_coverage', count(*) = 0, count(*) FROM calendar WHERE date NOT IN (SELECT date FROM bars WHERE symbol % 2 = 0) UNION ALL
       SELECT 'renames_complete', count(*) = 0, count(*) FROM securities WHERE symbol % 9 = 1 AND delist_date IS NULL""",
)
def _(t):
    count_ok = lambda df: df.agg((F.count(F.lit(1)) == 0).alias("ok"), F.count(F.lit(1)).alias("detail"))
    span = t.calendar.agg(
        ((F.min("date") <= F.lit("1995-06-01").cast("date")) & (F.max("date") >= F.lit("2001-06-01").cast("date"))).alias("ok"),
        F.count(F.lit(1)).alias("detail"),
    )
    members = t.membership.select("symbol").distinct().join(t.securities, "symbol", "left_anti")
    months = t.month_ends.select(F.col("signal_date").alias("date")).join(t.membership, "date", "left_anti")
    days = t.calendar.join(t.bars.where(F.col("symbol") % 2 == 0).select("date").distinct(), "date", "left_anti")
    # a delisted security needs no later name; the rest must appear in the rename list
    unnamed = t.securities.where((F.col("symbol") % 9 == 1) & F.col("delist_date").isNull())
    return dq.gate_table(
        {"calendar_span": span, "member_master": count_ok(members), "month_coverage": count_ok(months),
         "day_coverage": count_ok(days), "renames_complete": count_ok(unnamed)}
    )


@query(
    "D22_fee_tiers", _RULE,
    rules_sql(tiers_order="SELECT count(*) FROM (SELECT year(date) AS y, min(date) AS a, max(date) AS b FROM calendar GROUP BY 1) WHERE b < a",
              tiers_contiguous="SELECT count(DISTINCT year(date)) - 1 FROM calendar", tiers_open_end_last="0", tiers_rates="SELECT count(DISTINCT year(date)) FROM calendar WHERE year(date) % 3 = 0"),
)
def _(t):
    yearly = t.calendar.groupBy(F.year("date").alias("y")).agg(F.min("date").alias("start_date"), F.max("date").alias("_b"))
    tiers = yearly.select(
        "start_date", F.date_sub("_b", 40).alias("end_date"), F.when(F.col("y") % 3 == 0, -0.001).otherwise(0.001).alias("stamp_duty_sell"),
        F.lit(0.00001).alias("transfer_fee_rate"),
    )
    return dq.check_tiers(tiers)


@query(
    "D23_truncation_suspects", "api_name:s task_id:i row_count:i suspicion:s",
    """SELECT * FROM (SELECT o_orderpriority AS api_name, o_orderkey AS task_id, o_orderkey % 5001 AS row_count, CASE WHEN o_orderkey % 5001 = CASE WHEN o_orderpriority < '3' THEN 4500 END THEN 'equals_cap'
       WHEN o_orderkey % 5001 = 4879 THEN 'known_cap' WHEN o_orderkey % 5001 > 0 AND o_orderkey % 5001 % 1000 = 0 THEN 'round_thousand' END AS suspicion FROM orders) WHERE suspicion IS NOT NULL""",
)
def _(t):
    c = t.raw("orders").select(F.col("o_orderpriority").alias("api_name"), F.col("o_orderkey").alias("task_id"), (F.col("o_orderkey") % 5001).alias("row_count"))
    caps = c.select("api_name").distinct().select("api_name", F.when(F.col("api_name") < "3", 4500).alias("cap"))
    return catalog.truncation_suspects(c, caps, [4879])


@query(
    "D24_quote_coverage", "signal_date:d active_members:i quoted_active_members:i coverage:f below_minimum:b",
    """SELECT e.signal_date, count(*) AS active_members, count(b.symbol) AS quoted_active_members, count(b.symbol) / count(*) AS coverage, count(b.symbol) / count(*) < 0.3 AS below_minimum
       FROM month_ends e JOIN (SELECT DISTINCT e2.signal_date, i.symbol FROM month_ends e2 JOIN member_intervals i ON i.opt_in <= e2.signal_date AND i.opt_out > e2.signal_date) m USING (signal_date)
       LEFT JOIN bars b ON b.symbol = m.symbol AND b.date = e.signal_date GROUP BY 1""",
)
def _(t):
    return dq.quote_coverage(t.bars, t.member_intervals, t.month_ends, 0.3)


@query(
    "D25_time_slice_coverage", "signal_date:d active_symbols:i fundamental_symbols:i valuation_symbols:i fundamental_coverage:f valuation_coverage:f below_minimum:b",
    """WITH a AS (SELECT e.signal_date, m.symbol FROM month_ends e JOIN membership m ON m.date = e.signal_date),
       f AS (SELECT a.signal_date, a.symbol, max(f.available_date) AS fa FROM a LEFT JOIN facts f ON f.symbol = a.symbol AND f.available_date <= a.signal_date GROUP BY 1, 2),
       v AS (SELECT a.signal_date, a.symbol, max(v.available_date) AS va FROM a LEFT JOIN valuations v ON v.symbol = a.symbol AND v.available_date <= a.signal_date GROUP BY 1, 2)
       SELECT signal_date, count(*) AS active_symbols, count(*) FILTER (date_diff('day', fa, signal_date) <= 40) AS fundamental_symbols, count(*) FILTER (date_diff('day', va, signal_date) <= 10) AS valuation_symbols,
       fundamental_symbols / active_symbols AS fundamental_coverage, valuation_symbols / active_symbols AS valuation_coverage, least(fundamental_symbols, valuation_symbols) / active_symbols < 0.9 AS below_minimum
       FROM f JOIN v USING (signal_date, symbol) GROUP BY 1""",
)
def _(t):
    return dq.time_slice_coverage(t.facts, t.valuations, t.membership, t.month_ends, 40, 10, 0.9)


@query(
    "D26_cached_range_usable", "symbol:i first_needed:d last_needed:d first_bar:d last_bar:d usable:b",
    """WITH h AS (SELECT symbol, min(date) AS first_bar, max(date) AS last_bar FROM bars WHERE NOT (symbol % 5 = 0 AND year(date) >= 2001) GROUP BY 1),
       n AS (SELECT symbol, greatest(DATE '1996-01-01', (min(date) - 400)::DATE) AS first_needed, least(DATE '2001-06-30', (max(date) + 10)::DATE) AS last_needed FROM membership GROUP BY 1)
       SELECT n.*, first_bar, last_bar, coalesce(first_bar <= first_needed + 10 AND last_bar >= last_needed - 10, false) AS usable FROM n LEFT JOIN h USING (symbol)""",
)
def _(t):
    b = t.market.where(~((F.col("symbol") % 5 == 0) & (F.year("date") >= 2001))).select("symbol", "date", "total_mv")
    return dq.range_usable(b, t.membership, "1996-01-01", "2001-06-30")


@query(
    "R38_market_reconciliation", "field:s compared:i match_rate:f passed:b",
    """WITH a AS (SELECT date, symbol, open, close, volume, prev_close FROM market WHERE symbol % 11 <> 1), b AS (SELECT date, symbol, open + CASE WHEN symbol % 50 = 3 THEN 0.02 ELSE 0.001 END AS open,
         CASE WHEN symbol % 20 = 4 THEN close * 1.01 ELSE close END AS close, volume * 1.0005 AS volume, CASE WHEN day(date) < 8 THEN prev_close * 1.02 ELSE prev_close END AS prev_close FROM market WHERE symbol % 13 <> 2),
       ch AS (SELECT symbol, date FROM (SELECT *, lag(adj_factor) OVER (PARTITION BY symbol ORDER BY date) AS p FROM market) WHERE p IS NULL OR p <> adj_factor),
       j AS (SELECT a.*, b.open AS bo, b.close AS bc, b.volume AS bv, b.prev_close AS bp, ch.date IS NOT NULL AS moved FROM a JOIN b USING (date, symbol) LEFT JOIN ch USING (date, symbol)),
       r AS (SELECT 'open' AS field, abs(open - bo) <= 0.01 AS ok FROM j UNION ALL SELECT 'close', abs(close - bc) <= 0.01 FROM j UNION ALL
         SELECT 'volume', abs(volume - bv) <= greatest(0.01, 0.001 * greatest(abs(volume), abs(bv))) FROM j UNION ALL
         SELECT 'prev_close', CASE WHEN moved AND NOT abs(prev_close - bp) <= 0.01 THEN NULL ELSE abs(prev_close - bp) <= 0.01 END FROM j)
       SELECT field, count(ok) AS compared, avg(ok::INT) AS match_rate, avg(ok::INT) >= 0.97 AS passed FROM r GROUP BY 1""",
)
def _(t):
    s = F.col("symbol")
    cols = ["date", "symbol", "open", "close", "volume", "prev_close"]
    a = t.market.where(s % 11 != 1).select(*cols)
    b = t.market.where(s % 13 != 2).select(
        "date", "symbol", (F.col("open") + F.when(s % 50 == 3, 0.02).otherwise(0.001)).alias("open"),
        F.when(s % 20 == 4, F.col("close") * 1.01).otherwise(F.col("close")).alias("close"), (F.col("volume") * 1.0005).alias("volume"),
        F.when(F.dayofmonth("date") < 8, F.col("prev_close") * 1.02).otherwise(F.col("prev_close")).alias("prev_close"),
    )
    tol = {"open": (0.01, 0.0), "close": (0.01, 0.0), "volume": (0.01, 0.001), "prev_close": (0.01, 0.0)}
    m = recon.match_sources(a, b, ["date", "symbol"])
    m = recon.exclude_explained(m, recon.factor_change_dates(t.market), "prev_close", tol["prev_close"])
    return recon.match_rates(m, tol, 0.97)


@query(
    "R39_financial_reconciliation", "symbol:i period_end:d versions:i latest_value:g independent_value:g matches_any:b announced_known:b",
    """WITH v AS (SELECT o_custkey // 15 AS symbol, (date_trunc('quarter', o_orderdate)::DATE - 1) AS period_end, o_totalprice AS value, o_orderstatus = 'F' AS flag, CAST(o_orderdate AS DATE) AS ann, o_orderkey AS k FROM orders),
       i AS (SELECT symbol, period_end, arg_min(value, k) * CASE WHEN symbol % 9 = 2 THEN 1.05 ELSE 1 END AS iv, max(ann) + CASE WHEN symbol % 8 = 3 THEN 1000 ELSE 0 END AS ia FROM v GROUP BY 1, 2),
       l AS (SELECT symbol, period_end, value FROM v QUALIFY row_number() OVER (PARTITION BY symbol, period_end ORDER BY flag DESC, ann DESC, k DESC) = 1)
       SELECT v.symbol, v.period_end, count(*) AS versions, any_value(l.value) AS latest_value, any_value(i.iv) AS independent_value,
       bool_or(abs(v.value - i.iv) <= greatest(1, 0.001 * greatest(abs(v.value), abs(i.iv)))) AS matches_any, bool_or(v.ann = i.ia) AS announced_known
       FROM v JOIN i USING (symbol, period_end) JOIN l USING (symbol, period_end) GROUP BY 1, 2""",
)
def _(t):
    v = t.raw("orders").select(
        F.floor(F.col("o_custkey") / 15).cast("long").alias("symbol"), F.date_sub(F.date_trunc("quarter", "o_orderdate").cast("date"), 1).alias("period_end"),
        F.col("o_totalprice").alias("value"), (F.col("o_orderstatus") == "F").alias("current"), F.col("o_orderdate").cast("date").alias("announced"), F.col("o_orderkey").alias("k"),
    )
    i = v.groupBy("symbol", "period_end").agg(F.min_by("value", "k").alias("_v"), F.max("announced").alias("_a")).select(
        "symbol", "period_end", (F.col("_v") * F.when(F.col("symbol") % 9 == 2, 1.05).otherwise(1.0)).alias("independent_value"),
        F.date_add("_a", F.when(F.col("symbol") % 8 == 3, 1000).otherwise(0)).alias("independent_announced"),
    )
    return recon.reconcile_versions(v, i, ["symbol", "period_end"], ["current", "announced", "k"], 1.0, 0.001)
