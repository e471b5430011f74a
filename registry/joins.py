"""As-of, snapshot, interval, calendar and set-membership joins."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from registry import query
from registry.tables import FACT_METRICS
from tidemark.operators import asof, calendar as cal_ops, features, pit
from tidemark.operators.execution import fee_columns
from tidemark.operators.market import assemble_bars
from tidemark.operators.quality import duplicate_keys


@query(
    "J1_bars_left_join_chain",
    "date:d symbol:i close:f adj_factor:f total_mv:g prev_close:f volume:g amount:g missing_inputs:b",
    """SELECT b.date, b.symbol, b.close, m.adj_factor, m.total_mv, m.prev_close, b.volume * 100 AS volume,
       b.amount * 1000 AS amount, m.adj_factor IS NULL OR m.total_mv IS NULL AS missing_inputs
       FROM bars b LEFT JOIN (SELECT * FROM market WHERE symbol % 10 <> 4) m USING (symbol, date)""",
)
def _(t):
    m = t.market.where(F.col("symbol") % 10 != 4)
    daily = t.bars.select("symbol", "date", "close", F.col("volume").alias("vol"), "amount")
    return assemble_bars(
        daily,
        m.select("symbol", "date", "adj_factor"),
        m.select("symbol", "date", "total_mv"),
        m.select("symbol", "date", "prev_close"),
    )


@query(
    "J2_fundamentals_outer_valuations",
    "symbol:i as_of_date:d roe_pct:f debt_to_assets_pct:f pe_ttm:f valuation_date:d",
    """WITH f AS (SELECT symbol, metric, value FROM facts WHERE available_date <= DATE '1998-06-30'
         AND date_diff('day', period_end, DATE '1998-06-30') <= 550
         QUALIFY row_number() OVER (PARTITION BY symbol, metric ORDER BY period_end DESC, available_date DESC,
           revision_sequence DESC, source_row_sha256 DESC) = 1),
       v AS (SELECT * FROM valuations WHERE available_date <= DATE '1998-06-30' AND date >= DATE '1998-06-20'
         QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1)
       SELECT coalesce(p.symbol, v.symbol) AS symbol, DATE '1998-06-30' AS as_of_date, roe_pct,
         debt_to_assets_pct, pe_ttm, v.date AS valuation_date
       FROM (SELECT symbol, max(CASE WHEN metric = 'roe_pct' THEN value END) AS roe_pct,
         max(CASE WHEN metric = 'debt_to_assets_pct' THEN value END) AS debt_to_assets_pct FROM f GROUP BY symbol) p
       FULL JOIN v ON p.symbol = v.symbol""",
)
def _(t):
    return pit.combined_snapshot(t.facts, t.valuations, "1998-06-30", FACT_METRICS, 550, 10)


@query(
    "J3_many_to_one_join",
    "symbol:i date:d name:s close:f right_duplicates:i",
    """SELECT b.symbol, b.date, s.name, b.close, (SELECT count(*) FROM
       (SELECT symbol FROM securities GROUP BY symbol HAVING count(*) > 1)) AS right_duplicates
       FROM bars b LEFT JOIN securities s USING (symbol)""",
)
def _(t):
    dup = duplicate_keys(t.securities, ["symbol"]).agg(F.count(F.lit(1)).alias("right_duplicates"))
    return t.bars.join(t.securities, "symbol", "left").crossJoin(F.broadcast(dup))


_SNAP = """SELECT e.signal_date, m.symbol, m.index_weight, p.snapshot_date FROM month_ends e
  JOIN (SELECT e2.signal_date, max(x.date) AS snapshot_date FROM month_ends e2
    JOIN (SELECT DISTINCT date FROM membership WHERE month(date) % 3 = 0) x ON x.date <= e2.signal_date
    GROUP BY 1) p USING (signal_date)
  JOIN membership m ON m.date = p.snapshot_date"""


@query("J5_latest_snapshot_members", "signal_date:d symbol:i index_weight:f snapshot_date:d", _SNAP)
def _(t):
    quarterly = t.membership.where(F.month("date") % 3 == 0)
    return asof.latest_snapshot(t.month_ends, quarterly)


@query(
    "J4_members_keep_rows_without_data",
    "signal_date:d symbol:i close:f",
    f"""SELECT s.signal_date, s.symbol, b.close FROM ({_SNAP}) s
        LEFT JOIN bars b ON b.symbol = s.symbol AND b.date = s.signal_date""",
)
def _(t):
    members = asof.latest_snapshot(t.month_ends, t.membership.where(F.month("date") % 3 == 0))
    return members.join(t.bars.withColumnRenamed("date", "signal_date"), ["symbol", "signal_date"], "left")


@query(
    "J6_asof_backward",
    "date:d symbol:i close:f factor:f matched_date:d",
    """SELECT b.date, b.symbol, b.close, a.factor, a.date AS matched_date FROM bars b
       ASOF LEFT JOIN adj_factors a ON b.symbol = a.symbol AND b.date >= a.date""",
)
def _(t):
    return asof.asof_backward(t.bars, t.adj_factors, ["symbol"], "date", "date", ["factor"], bounded_left=True)


_IND = """SELECT m.date AS signal_date, m.symbol, coalesce(i.industry_code, 'UNKNOWN') AS industry_code,
  coalesce(i.industry_name, 'UNKNOWN') AS industry_name FROM membership m LEFT JOIN {src} i
  ON i.symbol = m.symbol AND i.in_date <= m.date AND (i.out_date IS NULL OR i.out_date >= m.date)
  QUALIFY row_number() OVER (PARTITION BY m.symbol, m.date ORDER BY i.in_date DESC, {tie} i.industry_code DESC) = 1"""


@query(
    "J7_interval_join_closed",
    "signal_date:d symbol:i industry_code:s industry_name:s",
    _IND.format(src="industries", tie=""),
)
def _(t):
    m = t.membership.select(F.col("date").alias("signal_date"), "symbol")
    return asof.industry_at(m, t.industries, policy="strategy")


_OVER = """(SELECT * FROM industries UNION ALL SELECT symbol, 'Z' || symbol % 3, 'extra', in_date, DATE '2000-06-30'
  FROM industries WHERE out_date IS NULL AND symbol % 4 = 1)"""


@query(
    "J7_interval_tie_break",
    "signal_date:d symbol:i industry_code:s industry_name:s",
    _IND.format(src=_OVER, tie="coalesce(i.out_date, DATE '9999-12-31') DESC,"),
)
def _(t):
    extra = t.industries.where(F.col("out_date").isNull() & (F.col("symbol") % 4 == 1)).select(
        "symbol",
        F.concat(F.lit("Z"), (F.col("symbol") % 3).cast("string")).alias("industry_code"),
        F.lit("extra").alias("industry_name"),
        "in_date",
        F.lit("2000-06-30").cast("date").alias("out_date"),
    )
    m = t.membership.select(F.col("date").alias("signal_date"), "symbol")
    return asof.industry_at(m, t.industries.unionByName(extra), policy="research")


@query(
    "J8_interval_join_half_open",
    "signal_date:d symbol:i opt_in:d",
    """SELECT e.signal_date, i.symbol, max(i.opt_in) AS opt_in FROM month_ends e JOIN member_intervals i
       ON i.opt_in <= e.signal_date AND (i.opt_out IS NULL OR i.opt_out > e.signal_date) GROUP BY 1, 2""",
)
def _(t):
    return asof.members_on(t.month_ends, t.member_intervals)


@query(
    "J9_interval_overlap_filter",
    "symbol:i opt_in:d opt_out:d",
    """SELECT * FROM member_intervals WHERE opt_in <= DATE '1997-12-31'
       AND (opt_out IS NULL OR opt_out > DATE '1997-01-01')""",
)
def _(t):
    return asof.overlapping(t.member_intervals, "1997-01-01", "1997-12-31")


@query(
    "J10_historical_names",
    "symbol:i date:d name:s",
    """WITH names AS (SELECT symbol, name AS name, NULL::DATE AS start_date, DATE '1997-03-31' AS end_date, 1 AS ord FROM securities
       UNION ALL SELECT symbol, 'ST ' || name, DATE '1997-01-01', DATE '1998-12-31', 2 FROM securities WHERE symbol % 5 = 2
       UNION ALL SELECT symbol, name || ' new', DATE '1998-07-01', NULL, 3 FROM securities)
       SELECT b.symbol, b.date, arg_max(n.name, n.ord) AS name FROM bars b LEFT JOIN names n ON n.symbol = b.symbol
       AND (n.start_date IS NULL OR n.start_date <= b.date) AND (n.end_date IS NULL OR n.end_date >= b.date)
       GROUP BY 1, 2""",
)
def _(t):
    s = t.securities
    day = lambda x: F.lit(x).cast("date")
    names = (
        s.select("symbol", "name", day(None).alias("start_date"), day("1997-03-31").alias("end_date"), F.lit(1).alias("input_ord"))
        .unionByName(
            s.where(F.col("symbol") % 5 == 2).select(
                "symbol", F.concat(F.lit("ST "), "name").alias("name"), day("1997-01-01").alias("start_date"),
                day("1998-12-31").alias("end_date"), F.lit(2).alias("input_ord"))
        )
        .unionByName(
            s.select("symbol", F.concat("name", F.lit(" new")).alias("name"), day("1998-07-01").alias("start_date"),
                day(None).alias("end_date"), F.lit(3).alias("input_ord"))
        )
    )
    return asof.name_at(t.bars, names)


_AVAIL = """SELECT o_orderkey AS row_id, CAST(o_orderdate AS DATE) AS announcement_date,
  (SELECT min(c.date) FROM calendar c WHERE c.date >= CAST(o_orderdate AS DATE)) AS lag0,
  (SELECT min(c.date) FROM calendar c WHERE c.date > CAST(o_orderdate AS DATE)) AS lag1,
  d.date AS lag3 FROM orders o LEFT JOIN calendar d ON d.ord = (SELECT min(c.ord) FROM calendar c
    WHERE c.date > CAST(o_orderdate AS DATE)) + 2"""


@query("J11_availability_dates", "row_id:i announcement_date:d lag0:d lag1:d lag3:d", _AVAIL)
def _(t):
    o = t.raw("orders").select(
        F.col("o_orderkey").alias("row_id"), F.col("o_orderdate").cast("date").alias("announcement_date")
    )
    for lag in (0, 1, 3):
        o = cal_ops.with_availability(o, t.calendar, "announcement_date", lag, f"lag{lag}")
    return o


@query(
    "J12_fee_tier_on_date",
    "date:d symbol:i amount:g stamp_duty_sell:f transfer_fee_rate:f",
    """SELECT b.date, b.symbol, b.amount, t.stamp_duty_sell, t.transfer_fee_rate FROM bars b JOIN tiers t
       ON b.date >= t.start_date AND (t.end_date IS NULL OR b.date <= t.end_date)""",
)
def _(t):
    return asof.tier_on(t.bars, t.tiers, "date")


@query(
    "J13_semi_join_members",
    "date:d symbol:i close:f",
    "SELECT date, symbol, close FROM bars WHERE symbol IN (SELECT symbol FROM membership WHERE date >= DATE '2000-01-01')",
)
def _(t):
    keep = t.membership.where(F.col("date") >= "2000-01-01").select("symbol").distinct()
    return t.bars.join(keep, "symbol", "left_semi")


@query(
    "J14_anti_join_missing",
    "kind:s symbol:i",
    """SELECT 'no_bars' AS kind, s_suppkey AS symbol FROM supplier WHERE s_suppkey NOT IN
         (SELECT symbol FROM bars WHERE date = DATE '1998-03-02') UNION ALL
       SELECT 'no_membership', symbol FROM securities WHERE symbol NOT IN (SELECT symbol FROM membership WHERE year(date) = 1997)
       UNION ALL SELECT 'no_industry', symbol FROM membership WHERE year(date) = 1999 AND symbol NOT IN
         (SELECT symbol FROM industries WHERE industry_code LIKE 'N1%') GROUP BY symbol""",
)
def _(t):
    s = t.securities.select("symbol")
    part = lambda kind, left, right: left.join(right, "symbol", "left_anti").select(F.lit(kind).alias("kind"), "symbol")
    return (
        part("no_bars", s, t.bars.where(F.col("date") == "1998-03-02"))
        .unionByName(part("no_membership", s, t.membership.where(F.year("date") == 1997)))
        .unionByName(
            part(
                "no_industry",
                t.membership.where(F.year("date") == 1999).select("symbol").distinct(),
                t.industries.where(F.col("industry_code").startswith("N1")),
            )
        )
    )


_GRID = """SELECT g.symbol, g.date, g.ord, b.close FROM (SELECT s.symbol, c.date, c.ord FROM calendar c JOIN
   (SELECT symbol, min(ord) AS a, max(ord) AS b FROM bars JOIN calendar USING (date) GROUP BY symbol) s
   ON c.ord BETWEEN s.a AND s.b + 5) g LEFT JOIN bars b USING (symbol, date)"""


@query("J15_calendar_grid", "symbol:i date:d ord:i close:f", _GRID)
def _(t):
    return asof.dense_grid(t.bars, t.calendar, tail=5)


@query(
    "J16_interval_containment",
    "row_id:i symbol:i start:d stop:d covered:b",
    """WITH r AS (SELECT o_orderkey AS row_id, o_custkey // 15 AS symbol, CAST(o_orderdate AS DATE) AS start,
         (CAST(o_orderdate AS DATE) + (o_orderkey % 60)::INT) AS stop, o_orderstatus AS st FROM orders)
       SELECT row_id, symbol, start, stop, EXISTS (SELECT 1 FROM r d WHERE d.st = 'F' AND d.symbol = z.symbol
         AND d.start <= z.start AND d.stop >= z.stop) AS covered FROM r z WHERE st <> 'F'""",
)
def _(t):
    r = t.raw("orders").select(
        F.col("o_orderkey").alias("row_id"),
        F.floor(F.col("o_custkey") / 15).cast("long").alias("symbol"),
        F.col("o_orderdate").cast("date").alias("start"),
        F.date_add(F.col("o_orderdate").cast("date"), (F.col("o_orderkey") % 60).cast("int")).alias("stop"),
        "o_orderstatus",
    )
    done = r.where(F.col("o_orderstatus") == "F")
    return asof.covering_successor(r.where(F.col("o_orderstatus") != "F"), done, ["symbol"])


@query(
    "J17_cross_source_match",
    "date:d symbol:i status:s a_close:f b_close:f",
    """WITH a AS (SELECT date, symbol, close AS a_close FROM bars WHERE symbol % 11 <> 1),
       b AS (SELECT date, symbol, close AS b_close FROM bars WHERE symbol % 13 <> 2)
       SELECT coalesce(a.date, b.date) AS date, coalesce(a.symbol, b.symbol) AS symbol,
       CASE WHEN a.symbol IS NULL THEN 'missing_left' WHEN b.symbol IS NULL THEN 'missing_right' ELSE 'compared' END AS status,
       a_close, b_close FROM a FULL JOIN b ON a.date = b.date AND a.symbol = b.symbol""",
)
def _(t):
    from tidemark.operators.recon import match_sources

    a = t.bars.where(F.col("symbol") % 11 != 1).select("date", "symbol", "close")
    b = t.bars.where(F.col("symbol") % 13 != 2).select("date", "symbol", "close")
    return match_sources(a, b, ["date", "symbol"])


@query(
    "J18_scenario_fan_out",
    "scenario:s date:d symbol:i cost:f",
    """SELECT s.scenario, b.date, b.symbol, b.amount * s.bps / 10000 AS cost FROM
       (SELECT date_trunc('month', date)::DATE AS date, symbol, sum(amount) AS amount FROM bars GROUP BY 1, 2) b,
       (VALUES ('low', 5.0::DOUBLE), ('base', 10.0), ('high', 20.0)) s(scenario, bps)""",
)
def _(t):
    m = t.bars.groupBy(F.trunc("date", "MM").alias("date"), "symbol").agg(F.sum("amount").alias("amount"))
    # a fixed list of scenarios expands each row in place; nothing is joined or shuffled
    cases = F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(b).alias("bps")) for n, b in (("low", 5.0), ("base", 10.0), ("high", 20.0))])
    return m.withColumn("s", F.explode(cases)).select(
        "s.scenario", "date", "symbol", (F.col("amount") * F.col("s.bps") / 10000).alias("cost")
    )


@query(
    "J19_latest_value_on_or_before",
    "signal_date:d symbol:i avg_amount_20:f matched_date:d",
    """SELECT e.signal_date, s.symbol, f.avg_amount_20, f.date AS matched_date FROM month_ends e CROSS JOIN
       (SELECT DISTINCT symbol FROM bars) s ASOF LEFT JOIN price_features f ON f.symbol = s.symbol AND f.date <= e.signal_date""",
)
def _(t):
    runs = asof.value_runs(features.liquidity_features(t.bars), ["symbol"], "date", ["avg_amount_20"], missing=True)
    return asof.on_dates(runs, t.month_ends).select("signal_date", "symbol", "avg_amount_20", "matched_date")
