"""Fills, forward returns, curves, revision order and gap queries."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from registry import query
from tidemark.operators import asof, calendar as cal_ops, catalog, features, panel
from tidemark.operators import performance as perf
from tidemark.operators import pit, recon

_G = """(SELECT g.symbol, g.date, g.ord, m.total_close AS price FROM (SELECT s.symbol, c.date, c.ord FROM calendar c JOIN
   (SELECT symbol, min(ord) AS a, max(ord) AS b FROM bars JOIN calendar USING (date) GROUP BY symbol) s
   ON c.ord BETWEEN s.a AND s.b + {tail}) g LEFT JOIN market m USING (symbol, date))"""


def grid(t, tail):
    bars = t.market.select("symbol", "date", F.col("total_close").alias("price"))
    return asof.dense_grid(bars, t.calendar, tail)


@query(
    "W12_forward_fill_limited",
    "symbol:i date:d price:f filled:f",
    f"""SELECT symbol, date, price, CASE WHEN ord - max(CASE WHEN price IS NOT NULL THEN ord END) OVER w <= 3 THEN
        last_value(price IGNORE NULLS) OVER w END AS filled FROM {_G.format(tail=5)}
        WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)""",
)
def _(t):
    return features.ffill(grid(t, 5), "price", 3, "filled")


@query(
    "W13_forward_fill_unlimited",
    "symbol:i date:d filled:f",
    f"""SELECT symbol, date, last_value(price IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS filled
        FROM {_G.format(tail=5)}""",
)
def _(t):
    return features.ffill(grid(t, 5), "price", None, "filled")


_P = f"""(SELECT symbol, date, ord, CASE WHEN ord - max(CASE WHEN price IS NOT NULL THEN ord END) OVER w <= 20 THEN
        last_value(price IGNORE NULLS) OVER w END AS p FROM {_G.format(tail=20)}
        WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING))"""


@query(
    "W14_forward_returns",
    "signal_date:d symbol:i forward_return_21d:f outcome_date_21d:d forward_return_63d:f outcome_date_63d:d",
    f"""WITH pr AS {_P}, e AS (SELECT * FROM month_ends WHERE ord + 63 <= (SELECT max(ord) FROM calendar))
        SELECT e.signal_date, m.symbol, b.p / a.p - 1 AS forward_return_21d, c21.date AS outcome_date_21d,
        c.p / a.p - 1 AS forward_return_63d, c63.date AS outcome_date_63d
        FROM e JOIN membership m ON m.date = e.signal_date
        JOIN calendar c21 ON c21.ord = e.ord + 21 JOIN calendar c63 ON c63.ord = e.ord + 63
        LEFT JOIN pr a ON a.symbol = m.symbol AND a.ord = e.ord LEFT JOIN pr b ON b.symbol = m.symbol AND b.ord = e.ord + 21
        LEFT JOIN pr c ON c.symbol = m.symbol AND c.ord = e.ord + 63""",
)
def _(t):
    signals = cal_ops.month_ends(t.calendar, room=63)
    members = asof.latest_snapshot(signals, t.membership).where(F.col("snapshot_date") == F.col("signal_date"))
    return panel.forward_returns(members.select("signal_date", "symbol"), t.market, t.calendar, [21, 63], 20)


@query(
    "W15_return_to_next_signal",
    "signal_date:d symbol:i next_signal_date:d forward_return_next_signal:f",
    f"""WITH pr AS {_P}, e AS (SELECT signal_date, ord, lead(signal_date) OVER (ORDER BY signal_date) AS nx, lead(ord) OVER (ORDER BY signal_date) AS no FROM month_ends)
        SELECT e.signal_date, m.symbol, e.nx AS next_signal_date, b.p / a.p - 1 AS forward_return_next_signal
        FROM e JOIN membership m ON m.date = e.signal_date LEFT JOIN pr a ON a.symbol = m.symbol AND a.ord = e.ord
        LEFT JOIN pr b ON b.symbol = m.symbol AND b.ord = e.no""",
)
def _(t):
    members = t.membership.select(F.col("date").alias("signal_date"), "symbol")
    return panel.next_signal_return(members, t.market, t.calendar, t.month_ends, 20)


@query(
    "W16_W17_nav_and_drawdown",
    "arm:s date:d nav:f drawdown:f",
    """SELECT arm, date, nav, nav / max(nav) OVER (PARTITION BY arm ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS drawdown FROM curves""",
)
def _(t):
    w = Window.partitionBy("arm").orderBy("date")
    r = t.curves.select("arm", "date", (F.col("nav") / F.lag("nav").over(w) - 1).alias("ret"), F.first("nav").over(w).alias("_base"))
    c = perf.nav_curve(r, ["arm"]).withColumn("nav", F.col("nav") * F.col("_base"))
    return perf.drawdown(c, ["arm"])


@query(
    "W18_annual_metrics",
    "arm:s year:i trading_days:i return:f sharpe:f maximum_drawdown:f one_sided_turnover:f fees:f",
    """WITH r AS (SELECT *, nav / lag(nav) OVER w - 1 AS r, coalesce(cumulative_notional - lag(cumulative_notional) OVER w, cumulative_notional) AS dn,
         coalesce(cumulative_fees - lag(cumulative_fees) OVER w, cumulative_fees) AS df, year(date) AS year FROM curves
         WINDOW w AS (PARTITION BY arm ORDER BY date)),
       g AS (SELECT *, product(1 + coalesce(r, 0)) OVER y AS g FROM r WINDOW y AS (PARTITION BY arm, year ORDER BY date ROWS UNBOUNDED PRECEDING)),
       d AS (SELECT *, CASE WHEN r IS NOT NULL THEN g / greatest(max(g) OVER y, 1) - 1 END AS dd FROM g
         WINDOW y AS (PARTITION BY arm, year ORDER BY date ROWS UNBOUNDED PRECEDING))
       SELECT arm, year, count(r) AS trading_days, arg_max(g, date) - 1 AS return,
       CASE WHEN stddev_pop(r) > 0 THEN avg(r) / stddev_pop(r) * sqrt(252) END AS sharpe, min(dd) AS maximum_drawdown,
       0.5 * sum(dn) / avg(nav) AS one_sided_turnover, sum(df) AS fees FROM d GROUP BY 1, 2""",
)
def _(t):
    return perf.annual_metrics(t.curves)


@query(
    "W19_revision_sequence",
    "symbol:i metric:s period_end:d announcement_date:d available_date:d source_row_sha256:s revision_sequence:i",
    "SELECT * FROM facts",
)
def _(t):
    return t.facts


@query(
    "W20_keep_last_per_key",
    "symbol:i month:d date:d close:f",
    """SELECT symbol, date_trunc('month', date)::DATE AS month, date, close FROM bars
       QUALIFY row_number() OVER (PARTITION BY symbol, date_trunc('month', date) ORDER BY date DESC) = 1""",
)
def _(t):
    b = t.bars.select("symbol", F.trunc("date", "MM").alias("month"), "date", "close")
    return asof.latest_by(b, ["symbol", "month"], [F.col("date")])


@query(
    "W24_snapshot_gaps",
    "symbol:i previous_date:d date:d gap_days:i",
    """SELECT * FROM (SELECT symbol, lag(date) OVER w AS previous_date, date, date_diff('day', lag(date) OVER w, date) AS gap_days
       FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)) WHERE gap_days > 10""",
)
def _(t):
    return cal_ops.date_gaps(t.bars, 10, by=["symbol"])


@query(
    "W25_factor_change_dates",
    "symbol:i date:d adj_factor:f",
    """SELECT symbol, date, adj_factor FROM (SELECT *, lag(adj_factor) OVER (PARTITION BY symbol ORDER BY date) AS p FROM market)
       WHERE p IS NULL OR p <> adj_factor""",
)
def _(t):
    return recon.factor_change_dates(t.market)


@query(
    "W26_monthly_return_matrix",
    "arm:s year:i " + " ".join(f"m{k:02d}:f" for k in range(1, 13)),
    """WITH m AS (SELECT arm, date_trunc('month', date) AS m, arg_max(nav, date) AS l, arg_min(nav, date) AS f FROM curves GROUP BY 1, 2),
       r AS (SELECT *, l / coalesce(lag(l) OVER (PARTITION BY arm ORDER BY m), f) - 1 AS r FROM m)
       SELECT arm, year(m) AS year, """
    + ", ".join(f"max(r) FILTER (month(m) = {k}) AS m{k:02d}" for k in range(1, 13))
    + " FROM r GROUP BY 1, 2",
)
def _(t):
    return perf.monthly_returns(t.curves, ["arm"])


@query(
    "W27_exposure_matched_benchmark",
    "arm:s date:d benchmark_matched_nav:f",
    """WITH r AS (SELECT *, coalesce(benchmark_nav / lag(benchmark_nav) OVER w - 1, 0) AS rb,
         coalesce(lag(gross_exposure) OVER w, 0) AS e, row_number() OVER w AS n, first_value(nav) OVER w AS base FROM curves
         WINDOW w AS (PARTITION BY arm ORDER BY date))
       SELECT arm, date, base * product(1 + CASE WHEN n = 1 THEN 0 ELSE e * rb + (1 - e) * (power(1.02, 1 / 252.0::DOUBLE) - 1) END)
         OVER (PARTITION BY arm ORDER BY date ROWS UNBOUNDED PRECEDING) AS benchmark_matched_nav FROM r""",
)
def _(t):
    return perf.matched_benchmark(t.curves, ["arm"], 0.02)


@query(
    "W28_generation_pick",
    "api_name:s params:i task_id:i snapshot:s chosen:b kept_snapshot:s kept_task_id:i",
    """WITH c AS (SELECT o_orderpriority AS api_name, o_custkey AS params, o_orderkey AS task_id,
         CASE o_orderstatus WHEN 'F' THEN 'repair-' WHEN 'O' THEN 'main-' ELSE 'probe-' END || year(o_orderdate) AS snapshot FROM orders)
       SELECT *, row_number() OVER w = 1 AS chosen, first_value(snapshot) OVER w AS kept_snapshot, first_value(task_id) OVER w AS kept_task_id FROM c
       WINDOW w AS (PARTITION BY api_name, params ORDER BY CASE WHEN snapshot LIKE 'repair%' THEN 0 WHEN snapshot LIKE 'main%' THEN 1 ELSE 5 END,
         snapshot DESC, task_id)""",
)
def _(t):
    prefix = F.when(F.col("o_orderstatus") == "F", "repair-").when(F.col("o_orderstatus") == "O", "main-").otherwise("probe-")
    c = t.raw("orders").select(
        F.col("o_orderpriority").alias("api_name"), F.col("o_custkey").alias("params"), F.col("o_orderkey").alias("task_id"),
        F.concat(prefix, F.year("o_orderdate").cast("string")).alias("snapshot"),
    )
    return catalog.pick_generation(c, [("repair", 0), ("main", 1)])
