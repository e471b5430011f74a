"""Normalisers of reference tables and the scalar families."""

from pyspark.sql import functions as F

from registry import query
from registry.ranking import _COPY, copies
from registry.tables import ORACLE_VIEWS
from tidemark.functions import scalars as S
from tidemark.operators import market, recon
from tidemark.operators.asof import latest_by


def _codes(t):
    s = F.col("symbol")
    lead = F.element_at(F.array(*[F.lit(x) for x in ("600", "300", "688", "000", "920", "430")]), (s % 6 + 1).cast("int"))
    venue = F.element_at(F.array(*[F.lit(x) for x in ("SH", "SZ", "SH", "SZ", "BJ", "BJ")]), (s % 6 + 1).cast("int"))
    return F.concat(lead, F.lpad(s.cast("string"), 3, "0"), F.lit("."), venue)


ORACLE_VIEWS["coded"] = """SELECT *, ['600', '300', '688', '000', '920', '430'][symbol % 6 + 1] || lpad((symbol % 1000)::VARCHAR, 3, '0') || '.' ||
    ['SH', 'SZ', 'SH', 'SZ', 'BJ', 'BJ'][symbol % 6 + 1] AS code, ['0.1', '0.2', '0.2', '0.1', '0.3', '0.3'][symbol % 6 + 1]::DOUBLE AS base_rate FROM market"""


@query(
    "P4_P5_bars_with_limit_fallback", "date:d code:s up_limit:f down_limit:f volume:f is_st:b",
    """SELECT date, code, CASE WHEN day(date) % 2 = 0 THEN up_limit ELSE round_even((prev_close + 0.00037) * (1 + CASE WHEN base_rate = 0.1 AND is_st THEN 0.05 ELSE base_rate END), 2) END AS up_limit,
       CASE WHEN day(date) % 3 = 0 THEN down_limit ELSE round_even((prev_close + 0.00037) * (1 - CASE WHEN base_rate = 0.1 AND is_st THEN 0.05 ELSE base_rate END), 2) END AS down_limit, volume * 100 AS volume, is_st FROM coded""",
)
def _(t):
    d = F.dayofmonth("date")
    m = t.market.withColumn("symbol3", F.col("symbol") % 1000)
    m = m.withColumn("code", F.regexp_replace(_codes(t), r"^(\d{3})\d+", F.concat(F.lit("$1"), F.lpad(F.col("symbol3").cast("string"), 3, "0"))))
    m = m.select(
        "date", F.col("code").alias("symbol"), (F.col("prev_close") + 0.00037).alias("prev_close"), "is_st", (F.col("volume") * 100).alias("volume"),
        F.when(d % 2 == 0, F.col("up_limit")).alias("up_limit"), F.when(d % 3 == 0, F.col("down_limit")).alias("down_limit"),
    )
    return market.fill_limits(m).withColumnRenamed("symbol", "code")


@query("P6_special_treatment_flag", "symbol:i flag:b", "SELECT symbol, symbol % 4 IN (0, 1, 2) AS flag FROM securities")
def _(t):
    k = F.col("symbol") % 4
    name = F.when(k == 0, "*st alpha").when(k == 1, "ST beta").when(k == 2, "gamma退").when(k == 3, "plain name")
    return t.securities.select("symbol", S.st_flag(name).alias("flag"))


@query(
    "P7_corporate_actions", "symbol:i ex_date:d cash_dividend:f stock_dividend:f pay_date:d",
    """WITH r AS (SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS ex_date, l_discount AS cash, CASE WHEN l_linenumber % 2 = 0 THEN l_tax END AS stock, l_orderkey AS k, l_linenumber AS n, l_returnflag AS f, l_partkey AS p, l_extendedprice AS e
         FROM lineitem WHERE l_returnflag = 'R' AND l_shipdate BETWEEN DATE '1996-01-01' AND DATE '1997-12-31' AND l_suppkey IN (SELECT symbol FROM membership))
       SELECT symbol, ex_date, cash AS cash_dividend, coalesce(stock, 0) AS stock_dividend, ex_date + 3 AS pay_date FROM r
       QUALIFY row_number() OVER (PARTITION BY symbol, ex_date ORDER BY k DESC, n DESC, p DESC, e DESC) = 1""",
)
def _(t):
    day = F.col("l_shipdate").cast("date")
    raw = t.raw("lineitem").select(
        F.col("l_suppkey").alias("symbol"), F.when(F.col("l_returnflag") == "R", "实施").otherwise("预案").alias("div_proc"), day.alias("ex_date"), day.alias("record_date"),
        F.date_add(day, 3).alias("pay_date"), day.alias("div_listdate"), F.col("l_discount").alias("cash_div"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_tax")).alias("stk_div"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice",
    )
    order = [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")]
    return market.corporate_actions(raw, "1996-01-01", "1997-12-31", t.membership, order)


@query(
    "P8_security_master", "symbol:s name:s industry:s market:s",
    "SELECT 'C' || c_custkey % 300 AS symbol, c_name AS name, c_mktsegment AS industry, NULL AS market FROM customer QUALIFY row_number() OVER (PARTITION BY c_custkey % 300 ORDER BY c_custkey DESC) = 1",
)
def _(t):
    c = t.raw("customer").select(
        F.concat(F.lit("C"), (F.col("c_custkey") % 300).cast("string")).alias("ts_code"), (F.col("c_custkey") % 300).cast("string").alias("symbol"),
        F.col("c_name").alias("name"), F.col("c_mktsegment").alias("industry"), "c_custkey",
    )
    return market.security_master(c, ["c_custkey"])


@query(
    "P9_index_frame", "date:d close:g volume:i",
    "SELECT CAST(o_orderdate AS DATE) AS date, o_totalprice AS close, o_orderkey AS volume FROM orders WHERE o_orderpriority = '2-HIGH' QUALIFY row_number() OVER (PARTITION BY CAST(o_orderdate AS DATE) ORDER BY o_orderkey DESC) = 1",
)
def _(t):
    o = t.raw("orders").select(
        F.col("o_orderpriority").alias("index_code"), F.col("o_orderdate").cast("date").alias("date"), F.col("o_totalprice").alias("close"), F.col("o_orderkey").alias("volume")
    )
    return market.index_frame(o, "2-HIGH", ["volume"])


@query(
    "P15_symbol_format_and_vendor_code", "symbol:i valid:b vendor:s",
    """SELECT symbol, symbol % 7 <> 6 AS valid, CASE WHEN symbol % 7 = 6 THEN NULL WHEN symbol % 3 = 0 THEN '1.' || lpad(symbol::VARCHAR, 6, '0') ELSE '0.' || lpad(symbol::VARCHAR, 6, '0') END AS vendor FROM securities""",
)
def _(t):
    s = F.col("symbol")
    venue = F.when(s % 7 == 6, "HK").when(s % 3 == 0, "SH").when(s % 3 == 1, "SZ").otherwise("BJ")
    code = F.concat(F.lpad(s.cast("string"), 6, "0"), F.lit("."), venue)
    return t.securities.select("symbol", S.valid_symbol(code).alias("valid"), S.vendor_code(code).alias("vendor"))


@query("P16_total_return_columns", "date:d symbol:i total_close:f log_total_mv:f", "SELECT date, symbol, total_close, ln(greatest(total_mv, 1e-12)) AS log_total_mv FROM market")
def _(t):
    return t.market.withColumn("log_total_mv", F.log(F.greatest("total_mv", F.lit(1e-12))))


@query(
    "P17_back_adjusted_bars", "date:d symbol:i open:f close:f change:f pct_chg:f",
    """SELECT *, close - lag(close) OVER w AS change, (close / lag(close) OVER w - 1) * 100 AS pct_chg FROM (SELECT b.date, b.symbol, b.open * coalesce(a.factor, 1) AS open, b.close * coalesce(a.factor, 1) AS close
       FROM bars b ASOF LEFT JOIN adj_factors a ON a.symbol = b.symbol AND a.date <= b.date) WINDOW w AS (PARTITION BY symbol ORDER BY date)""",
)
def _(t):
    return market.back_adjust(t.bars, t.adj_factors)


@query(
    "P17_month_end_membership", "date:d symbol:i index_weight:f",
    "SELECT b.date, b.symbol, min(b.amount) * 1e-6 AS index_weight FROM bars b JOIN month_ends e ON e.signal_date = b.date WHERE b.symbol % 3 <> 1 GROUP BY 1, 2",
)
def _(t):
    w = t.bars.select("date", F.col("symbol").alias("con_code"), (F.col("amount") * 1e-6).alias("weight"), F.when(F.col("symbol") % 3 == 1, "other").otherwise("main").alias("index_code"))
    return market.month_end_membership(w.unionByName(w), t.month_ends, "main")


@query(
    "F1_math_and_safe_arithmetic", "row_id:i log_price:f root:f lots:f ratio:f inverse:f half_even:f",
    """SELECT o_orderkey AS row_id, ln(o_totalprice) AS log_price, sqrt(o_totalprice) AS root, floor(o_totalprice / 100 + 1e-12) * 100 AS lots,
       CASE WHEN o_orderkey % 10 <> 0 THEN o_totalprice / (o_orderkey % 10) END AS ratio, CASE WHEN o_orderkey % 7 - 3 > 0 THEN 1.0 / (o_orderkey % 7 - 3) END AS inverse, round_even((o_orderkey % 1000) / 8, 1) AS half_even FROM orders""",
)
def _(t):
    p, k = F.col("o_totalprice"), F.col("o_orderkey")
    return t.raw("orders").select(
        k.alias("row_id"), F.log(p).alias("log_price"), F.sqrt(p).alias("root"), S.floor_lot(p).alias("lots"), S.safe_divide(p, (k % 10).cast("double")).alias("ratio"),
        S.positive_inverse((k % 7 - 3).cast("double")).alias("inverse"), F.bround((k % 1000) / 8, 1).alias("half_even"),
    )


@query(
    "F2_title_match_with_exclusions", "doc_id:i hit:b",
    "SELECT doc_id, contains(lower(text), 'report') AND NOT regexp_matches(lower(text), 'summary|draft|english|notice') AS hit FROM documents",
)
def _(t):
    x = F.lower("text")
    return t.raw("documents").select("doc_id", (F.contains(x, F.lit("report")) & ~x.rlike("summary|draft|english|notice")).alias("hit"))


@query(
    "F3_date_functions", "row_id:i month_start:d month_end:d quarter_end:d next_year:d day_gap:i",
    """SELECT o_orderkey AS row_id, date_trunc('month', o_orderdate)::DATE AS month_start, last_day(o_orderdate::DATE) AS month_end, (date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH)::DATE - 1 AS quarter_end,
       (o_orderdate::DATE + INTERVAL 1 YEAR)::DATE AS next_year, date_diff('day', DATE '1995-01-01', o_orderdate::DATE) AS day_gap FROM orders""",
)
def _(t):
    d = F.col("o_orderdate").cast("date")
    return t.raw("orders").select(
        F.col("o_orderkey").alias("row_id"), F.trunc(d, "MM").alias("month_start"), F.last_day(d).alias("month_end"),
        F.date_sub(F.add_months(F.date_trunc("quarter", d).cast("date"), 3), 1).alias("quarter_end"), F.add_months(d, 12).alias("next_year"),
        F.datediff(d, F.lit("1995-01-01").cast("date")).alias("day_gap"),
    )


@query(
    "F4_json_and_hash", "event_id:i k:i canonical:s digest:s",
    """SELECT event_id, (props::JSON ->> 'k')::BIGINT AS k, '{"event":"' || event_type || '","user":"' || user_id || '"}' AS canonical, sha1(event_type) AS digest FROM events""",
)
def _(t):
    return t.raw("events").select(
        "event_id", F.from_json("props", "k long")["k"].alias("k"), S.canonical_json({"user": F.col("user_id"), "event": F.col("event_type")}).alias("canonical"), F.sha1("event_type").alias("digest")
    )


@query(
    "F5_array_set_difference", "symbol:i missing:s",
    """SELECT symbol, coalesce(string_agg(q::VARCHAR, ',' ORDER BY q) FILTER (NOT has), '') AS missing FROM (SELECT s.symbol, q, EXISTS (SELECT 1 FROM bars b WHERE b.symbol = s.symbol AND (year(b.date) * 12 + month(b.date)) = q) AS has
       FROM (SELECT DISTINCT symbol FROM bars) s, (SELECT DISTINCT year(date) * 12 + month(date) AS q FROM calendar)) GROUP BY 1""",
)
def _(t):
    month = F.year("date") * 12 + F.month("date")
    # months are bounded by the calendar, so both arrays are short
    every = t.calendar.agg(F.array_sort(F.collect_set(month)).alias("all_months"))
    have = t.bars.groupBy("symbol").agg(F.collect_set(month).alias("have"))
    return have.crossJoin(F.broadcast(every)).select("symbol", F.concat_ws(",", F.array_sort(F.array_except("all_months", "have"))).alias("missing"))


@query(
    "F6_type_names", "table_name:s column_name:s kind:s rows:i",
    """SELECT 'lineitem' AS table_name, c AS column_name, k AS kind, (SELECT count(*) FROM lineitem) AS rows FROM (VALUES ('l_orderkey', 'integer'), ('l_quantity', 'float'), ('l_shipdate', 'datetime'), ('l_returnflag', 'string')) v(c, k)""",
)
def _(t):
    from tidemark.operators.catalog import normal_kind

    li = t.raw("lineitem").select("l_orderkey", "l_quantity", "l_shipdate", "l_returnflag")
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(normal_kind(k)).alias("kind")) for c, k in li.dtypes]))
    return li.agg(F.count(F.lit(1)).alias("rows")).select(F.lit("lineitem").alias("table_name"), "rows", each.alias("x")).select("table_name", "x.*", "rows")


@query(
    "U4_cross_copy_field_rates", "field:s compared:i match_rate:f passed:b",
    f"""SELECT 'close' AS field, count(*) AS compared, avg((abs(a.close - b.close) <= 0.01)::INT) AS match_rate, avg((abs(a.close - b.close) <= 0.01)::INT) >= 0.99 AS passed
        FROM {_COPY.format(changed='false')} a JOIN {_COPY.format(changed='l_orderkey % 100 = 7')} b USING (date, symbol)""",
)
def _(t):
    a, b = copies(t)
    return recon.match_rates(recon.match_sources(a, b, ["date", "symbol"]), {"close": (0.01, 0.0)}, 0.99)
