"""Order, fill, cost, lot-matching and book queries."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from registry import query
from registry.ranking import _ARMS, arms
from registry.tables import ORACLE_VIEWS
from tidemark.operators import calendar as cal_ops
from tidemark.operators import execution as ex
from tidemark.operators import portfolio
from tidemark.operators.asof import dense_grid, tier_on
from tidemark.session import stage

ORACLE_VIEWS["order_rows"] = """SELECT symbol, (date + CASE WHEN day(date) % 2 = 0 THEN 1 ELSE 0 END)::DATE AS date, CASE WHEN (symbol + day(date)) % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side FROM bars"""


def orders(t):
    day = F.dayofmonth("date")
    return t.bars.select(
        "symbol", F.when(day % 2 == 0, F.date_add("date", 1)).otherwise(F.col("date")).alias("date"),
        F.when((F.col("symbol") + day) % 2 == 0, "BUY").otherwise("SELL").alias("side"),
    )


@query(
    "X1_order_eligibility",
    "symbol:i date:d side:s reason:s",
    """SELECT o.symbol, o.date, o.side, CASE WHEN o.date < s.list_date THEN 'not_listed' WHEN o.date > s.delist_date THEN 'delisted'
       WHEN m.volume IS NULL OR m.volume <= 0 THEN 'suspended_or_no_bar' WHEN side = 'BUY' AND m.is_st THEN 'st_on_execution'
       WHEN side = 'BUY' AND m.open >= m.up_limit - 0.005 THEN 'open_at_up_limit' WHEN side = 'SELL' AND m.open <= m.down_limit + 0.005 THEN 'open_at_down_limit' ELSE '' END AS reason
       FROM order_rows o LEFT JOIN market m USING (symbol, date) LEFT JOIN securities s ON s.symbol = o.symbol""",
)
def _(t):
    return ex.classify_orders(orders(t), t.market, t.securities)


@query(
    "X2_target_shares",
    "signal_date:d symbol:i target_shares:f",
    """SELECT signal_date, symbol, floor(greatest(0, (symbol % 8) * 0.01::DOUBLE * 1e8 / close) / 100 + 1e-12) * 100 AS target_shares FROM month_features""",
)
def _(t):
    s = t.month_features.select(
        "signal_date", "symbol", ((F.col("symbol") % 8) * 0.01).alias("target_weight"), F.lit(1e8).alias("equity"), F.col("close").alias("signal_close")
    )
    return ex.target_shares(s)


ORACLE_VIEWS["quote_rows"] = """SELECT *, CASE WHEN side = 'BUY' THEN least(up_limit, open * (1 + modeled_slippage_bps / 10000)) ELSE greatest(down_limit, open * (1 - modeled_slippage_bps / 10000)) END AS price
    FROM (SELECT *, 5.0 + market_impact_bps AS modeled_slippage_bps FROM (
    SELECT *, greatest(0, least(50, 0.5 * (greatest(coalesce(volatility, 0.1), 0.1) / sqrt(252)) * sqrt(participation_rate) * 10000)) AS market_impact_bps FROM (
    SELECT date, symbol, CASE WHEN (symbol + day(date)) % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side, open, up_limit, down_limit, avg_amount_20, volatility,
    (symbol % 10) * 150 + volume AS desired, CASE WHEN avg_amount_20 > 0 THEN ((symbol % 10) * 150 + volume) * open / avg_amount_20 ELSE 0 END AS participation_rate FROM price_features)))"""


def quotes(t):
    f = t.price_features
    o = f.select(
        "date", "symbol", F.when((F.col("symbol") + F.dayofmonth("date")) % 2 == 0, "BUY").otherwise("SELL").alias("side"),
        "open", "up_limit", "down_limit", F.col("avg_amount_20").alias("lagged_adv20"), F.col("volatility").alias("signal_volatility"),
        ((F.col("symbol") % 10) * 150 + F.col("volume")).alias("desired"),
    )
    return ex.quote(o.withColumn("shares", F.col("desired")))


@query(
    "X4_impact_and_quote",
    "date:d symbol:i side:s participation_rate:f market_impact_bps:f modeled_slippage_bps:f price:f realized_slippage_bps:f",
    """SELECT *, greatest(0, CASE WHEN side = 'BUY' THEN price / open - 1 ELSE 1 - price / open END * 10000) AS realized_slippage_bps FROM quote_rows""",
)
def _(t):
    return quotes(t)


ORACLE_VIEWS["fill_rows"] = """SELECT *, desired - filled AS remaining, CASE WHEN filled <= 0 THEN 'REJECTED' WHEN desired - filled >= 100 - 1e-8 THEN 'PARTIAL' ELSE 'FILLED' END AS status,
    CASE WHEN filled > 0 THEN '' WHEN cap IS NULL THEN 'missing_signal_liquidity' WHEN capped > 0 THEN 'insufficient_cash' WHEN desired < 100 THEN 'below_lot' ELSE 'participation_cap' END AS reason FROM (
    SELECT *, CASE WHEN side = 'BUY' THEN least(capped, floor(greatest(0, least(cash / (price * 1.00002 + price * 0.00025), (cash - 5) / (price * 1.00002))) / 100 + 1e-12) * 100) ELSE capped END AS filled FROM (
    SELECT *, CASE WHEN cap IS NULL THEN 0 WHEN side = 'SELL' AND fits AND ((target <= 1e-8 AND desired >= held - 1e-8) OR (desired > 1e-8 AND desired <= held % 100 + 1e-8)) THEN desired
      ELSE floor(greatest(0, least(desired, room)) / 100 + 1e-12) * 100 END AS capped, (symbol % 5) * 20000::DOUBLE AS cash FROM (
    SELECT *, CASE WHEN avg_amount_20 > 0 THEN avg_amount_20 * 0.05 END AS cap, coalesce(CASE WHEN avg_amount_20 > 0 THEN avg_amount_20 * 0.05 END / greatest(price, 1e-12), desired) AS room,
      coalesce(desired * price <= CASE WHEN avg_amount_20 > 0 THEN avg_amount_20 * 0.05 END + 1e-8, true) AS fits, CASE WHEN symbol % 2 = 0 THEN desired ELSE desired * 2 END AS held,
      CASE WHEN symbol % 2 = 0 THEN 0 ELSE desired END AS target FROM (SELECT * REPLACE (CASE WHEN symbol % 3 = 0 THEN avg_amount_20 * 50 ELSE avg_amount_20 END AS avg_amount_20) FROM quote_rows))))"""


def fills(t):
    q = quotes(t).withColumn("lagged_adv20", F.when(F.col("symbol") % 3 == 0, F.col("lagged_adv20") * 50).otherwise(F.col("lagged_adv20")))
    even = F.col("symbol") % 2 == 0
    q = q.withColumn("held", F.when(even, F.col("desired")).otherwise(F.col("desired") * 2)).withColumn(
        "target", F.when(even, F.lit(0.0)).otherwise(F.col("desired"))
    )
    return ex.fill_once(q.withColumn("cash", (F.col("symbol") % 5) * F.lit(20000.0)).withColumn("transfer_fee_rate", F.lit(0.00002)))


@query("X3_single_fill_attempt", "date:d symbol:i side:s desired:f filled:f remaining:f status:s reason:s", "SELECT * FROM fill_rows")
def _(t):
    return fills(t)


@query(
    "X5_fee_components",
    "date:d symbol:i side:s commission:f stamp_duty:f transfer_fee:f fees:f",
    """SELECT *, commission + stamp_duty + transfer_fee AS fees FROM (SELECT b.date, b.symbol, CASE WHEN symbol % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side,
       greatest(5, amount * 0.00025) AS commission, CASE WHEN symbol % 2 = 1 THEN amount * t.stamp_duty_sell ELSE 0 END AS stamp_duty, amount * t.transfer_fee_rate AS transfer_fee
       FROM bars b JOIN tiers t ON b.date >= t.start_date AND (t.end_date IS NULL OR b.date <= t.end_date))""",
)
def _(t):
    b = t.bars.select("date", "symbol", F.when(F.col("symbol") % 2 == 0, "BUY").otherwise("SELL").alias("side"), F.col("amount").alias("notional"))
    return ex.fee_columns(b, t.tiers)


_LOTS = """buys AS (SELECT b.symbol, b.date, n.date AS sellable_date, b.volume AS shares FROM bars b JOIN calendar c USING (date) LEFT JOIN calendar n ON n.ord = c.ord + 1 WHERE n.date IS NOT NULL),
  sells AS (SELECT symbol, date, shares FROM (SELECT symbol, date, 0.5 * lag(volume) OVER (PARTITION BY symbol ORDER BY date) AS shares FROM bars) WHERE shares IS NOT NULL)"""


@query(
    "X6_fifo_lot_matching",
    "symbol:i buy_date:d sell_date:d shares:f",
    f"""WITH {_LOTS}, b AS (SELECT *, sum(shares) OVER (PARTITION BY symbol ORDER BY sellable_date, date ROWS UNBOUNDED PRECEDING) AS hi FROM buys),
       s AS (SELECT *, sum(shares) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS hi FROM sells)
       SELECT b.symbol, b.date AS buy_date, s.date AS sell_date, least(b.hi, s.hi) - greatest(b.hi - b.shares, s.hi - s.shares) AS shares FROM b JOIN s
       ON b.symbol = s.symbol AND b.hi - b.shares < s.hi AND s.hi - s.shares < b.hi""",
)
def _(t):
    nxt = t.calendar.select(F.col("date").alias("sellable_date"), (F.col("ord") - 1).alias("ord"))
    b = t.bars.join(F.broadcast(t.calendar), "date").join(F.broadcast(nxt), "ord").select("symbol", "date", "sellable_date", F.col("volume").alias("shares"))
    w = Window.partitionBy("symbol").orderBy("date")
    s = t.bars.select("symbol", "date", (0.5 * F.lag("volume").over(w)).alias("shares")).where(F.col("shares").isNotNull())
    return ex.fifo_match(b, s)


@query(
    "X7_corporate_action_entitlements",
    "symbol:i ex_date:d pay_date:d shares:f cash_amount:f new_shares:f",
    """WITH a AS (SELECT symbol, min(date) AS ex_date, CASE WHEN symbol % 2 = 0 THEN (min(date) + 10)::DATE END AS pay_date, 0.1::DOUBLE * (symbol % 5) AS cash, 0.05::DOUBLE * (symbol % 4) AS stock
         FROM bars WHERE symbol % 3 = 0 GROUP BY symbol, year(date)),
       p AS (SELECT symbol, date, sum(volume) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS shares FROM bars)
       SELECT a.symbol, a.ex_date, coalesce(a.pay_date, a.ex_date) AS pay_date, p.shares, p.shares * cash AS cash_amount, p.shares * stock AS new_shares
       FROM a ASOF JOIN p ON a.symbol = p.symbol AND p.date < a.ex_date""",
)
def _(t):
    a = t.bars.where(F.col("symbol") % 3 == 0).groupBy("symbol", F.year("date").alias("y")).agg(F.min("date").alias("ex_date"))
    a = a.select(
        "symbol", "ex_date", F.when(F.col("symbol") % 2 == 0, F.date_add("ex_date", 10)).alias("pay_date"), F.lit(None).cast("date").alias("stock_list_date"),
        (F.lit(0.1) * (F.col("symbol") % 5)).alias("cash_dividend"), (F.lit(0.05) * (F.col("symbol") % 4)).alias("stock_dividend"),
    )
    w = Window.partitionBy("symbol").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return ex.entitlements(t.bars.select("symbol", "date", F.sum("volume").over(w).alias("shares")), a)


@query(
    "X8_stale_price_flags",
    "symbol:i date:d days_since_bar:i is_stale:b",
    """SELECT symbol, date, ord - last AS days_since_bar, coalesce(ord - last > 5, true) AS is_stale FROM (SELECT g.symbol, g.date, g.ord,
       max(CASE WHEN b.close IS NOT NULL THEN g.ord END) OVER (PARTITION BY g.symbol ORDER BY g.date ROWS UNBOUNDED PRECEDING) AS last
       FROM (SELECT s.symbol, c.date, c.ord FROM calendar c JOIN (SELECT symbol, min(ord) AS a, max(ord) AS b FROM bars JOIN calendar USING (date) GROUP BY symbol) s
       ON c.ord BETWEEN s.a AND s.b + 10) g LEFT JOIN bars b USING (symbol, date))""",
)
def _(t):
    return ex.stale_flags(dense_grid(t.bars, t.calendar, 10), 5)


@query(
    "X9_delisting_values",
    "symbol:i date:d delisted:b settlement:f writeoff:f",
    """SELECT b.symbol, b.date, coalesce(b.date > s.delist_date, false) AS delisted, CASE WHEN b.date > s.delist_date THEN 0 END AS settlement,
       CASE WHEN b.date > s.delist_date THEN b.volume * b.close END AS writeoff FROM bars b LEFT JOIN securities s USING (symbol)""",
)
def _(t):
    p = t.bars.select("symbol", "date", F.col("volume").alias("shares"), F.col("close").alias("mark"))
    return ex.delist_values(p, t.securities)


_BOOKS = f"""cur AS (SELECT x.arm, n.nx AS signal_date, x.symbol, 0.06::DOUBLE AS weight, x.symbol % 7 <> 0 AS tradable FROM {_ARMS} x
    JOIN (SELECT signal_date, lead(signal_date) OVER (ORDER BY signal_date) AS nx FROM month_ends) n USING (signal_date) WHERE n.nx IS NOT NULL),
  tgt AS (SELECT arm, signal_date, symbol, 0.06::DOUBLE AS weight FROM {_ARMS} WHERE signal_date > (SELECT min(signal_date) FROM month_ends)),
  bk AS (SELECT coalesce(c.arm, t.arm) AS arm, coalesce(c.signal_date, t.signal_date) AS signal_date, coalesce(c.symbol, t.symbol) AS symbol, coalesce(c.weight, 0) AS cw,
    CASE WHEN coalesce(c.tradable, true) THEN coalesce(t.weight, 0) ELSE coalesce(c.weight, 0) END AS tw, NOT coalesce(c.tradable, true) AS locked
    FROM cur c FULL JOIN tgt t ON c.arm = t.arm AND c.signal_date = t.signal_date AND c.symbol = t.symbol)"""


def books(t):
    a = stage(arms(t))
    w = Window.orderBy("signal_date")
    steps = t.month_ends.select("signal_date", F.lead("signal_date").over(w).alias("_nx"))
    current = a.join(F.broadcast(steps), "signal_date").where(F.col("_nx").isNotNull()).select(
        "arm", F.col("_nx").alias("signal_date"), "symbol", F.lit(0.06).alias("weight"), (F.col("symbol") % 7 != 0).alias("tradable")
    )
    first = t.month_ends.agg(F.min("signal_date").alias("_m"))
    target = a.crossJoin(F.broadcast(first)).where(F.col("signal_date") > F.col("_m")).select("arm", "signal_date", "symbol", F.lit(0.06).alias("weight"))
    stamp = tier_on(a.select("arm", "signal_date").distinct(), t.tiers, "signal_date")
    return target, current, stamp


@query(
    "X10_rebalance_turnover_and_cost",
    "arm:s signal_date:d buys:f sells:f one_way_turnover:f locked_value:f buy_rate:f sell_rate:f cost:f cash:f",
    f"""WITH {_BOOKS}, g AS (SELECT arm, signal_date, sum(greatest(tw - cw, 0)) AS buys, sum(greatest(cw - tw, 0)) AS sells, sum(tw) AS invested,
         sum(CASE WHEN locked THEN cw ELSE 0 END) AS locked_value FROM bk GROUP BY 1, 2)
       SELECT arm, signal_date, buys, sells, greatest(buys, sells) AS one_way_turnover, locked_value, 0.00075 + transfer_fee_rate AS buy_rate, 0.00075 + transfer_fee_rate + stamp_duty_sell AS sell_rate,
       buys * (0.00075 + transfer_fee_rate) + sells * (0.00075 + transfer_fee_rate + stamp_duty_sell) AS cost,
       1 - invested - (buys * (0.00075 + transfer_fee_rate) + sells * (0.00075 + transfer_fee_rate + stamp_duty_sell)) AS cash
       FROM g JOIN tiers ON signal_date >= start_date AND (end_date IS NULL OR signal_date <= end_date)""",
)
def _(t):
    target, current, stamp = books(t)
    return portfolio.rebalance_moves(target, current, stamp, ["arm", "signal_date"])


@query(
    "X10_overdrawn_book_scale",
    "arm:s signal_date:d executable_scale:f cash:f",
    f"""WITH {_BOOKS.replace("0.06::DOUBLE AS weight FROM", "1 / 15::DOUBLE AS weight FROM")}, r AS (SELECT bk.*, 0.00075 + transfer_fee_rate AS buy, 0.00075 + transfer_fee_rate + stamp_duty_sell AS sell
         FROM bk JOIN tiers ON signal_date >= start_date AND (end_date IS NULL OR signal_date <= end_date)),
       k AS (SELECT DISTINCT arm, signal_date, s FROM (SELECT arm, signal_date, unnest([0::DOUBLE, 1::DOUBLE, CASE WHEN NOT locked AND tw > 0 AND cw / tw < 1 THEN cw / tw END]) AS s FROM r) WHERE s IS NOT NULL),
       c AS (SELECT arm, signal_date, s, 1 - sum(h) - sum(buy * greatest(h - cw, 0)) - sum(sell * greatest(cw - h, 0)) AS cash
         FROM (SELECT k.s, r.*, CASE WHEN locked THEN cw ELSE tw * k.s END AS h FROM r JOIN k USING (arm, signal_date)) GROUP BY 1, 2, 3),
       n AS (SELECT *, lead(s) OVER w AS s2, lead(cash) OVER w AS cash2 FROM c WINDOW w AS (PARTITION BY arm, signal_date ORDER BY s)),
       z AS (SELECT arm, signal_date, max(CASE WHEN cash >= -1e-12 AND s2 IS NULL THEN 1 WHEN cash >= 0 AND cash2 < 0 THEN s + (s2 - s) * cash / (cash - cash2) END) AS z, max(CASE WHEN s = 1 THEN cash END) AS c1,
         max(CASE WHEN s = 0 THEN cash END) AS c0 FROM n GROUP BY 1, 2)
       SELECT arm, signal_date, CASE WHEN c1 >= -1e-12 THEN 1 ELSE coalesce(z, 0) END AS executable_scale, CASE WHEN c1 >= -1e-12 THEN greatest(c1, 0) WHEN z IS NULL THEN greatest(c0, 0) ELSE 0 END AS cash FROM z""",
)
def _(t):
    target, current, stamp = books(t)
    target = target.withColumn("weight", F.lit(1.0) / 15)  # a full book cannot pay its own costs
    key = ["arm", "signal_date"]
    can = F.coalesce("tradable", F.lit(True))
    both = target.withColumnRenamed("weight", "_t").join(current.withColumnRenamed("weight", "_c"), [*key, "symbol"], "outer")
    book = both.select(
        *key, "symbol", F.coalesce("_c", F.lit(0.0)).alias("current_weight"), F.coalesce("_t", F.lit(0.0)).alias("target_weight"), (~can).alias("locked")
    )
    rate = F.lit(0.00075) + F.col("transfer_fee_rate")
    rates = stamp.select(*key, rate.alias("buy_rate"), (rate + F.col("stamp_duty_sell")).alias("sell_rate"))
    return portfolio.affordable_scale(book, rates, key)


@query(
    "X11_weight_nav",
    "arm:s signal_date:d date:d period_growth:f nav:f",
    f"""WITH wt AS (SELECT arm, signal_date, symbol, 0.05::DOUBLE AS weight FROM {_ARMS}),
       pd AS (SELECT s.signal_date, c.date, c.ord - s.ord AS k FROM calendar c JOIN (SELECT signal_date, ord, coalesce(lead(ord) OVER (ORDER BY ord), ord) AS nx FROM month_ends) s
         ON c.ord > s.ord AND c.ord <= s.nx),
       rt AS (SELECT symbol, date, greatest(least(return_1d * 0.01, 0.05), -0.05) AS ret FROM price_features),
       gr AS (SELECT w.arm, w.signal_date, p.date, p.k, w.weight, product(1 + coalesce(r.ret, 0)) OVER (PARTITION BY w.arm, w.signal_date, w.symbol ORDER BY p.date ROWS UNBOUNDED PRECEDING) AS g
         FROM wt w JOIN pd p USING (signal_date) LEFT JOIN rt r ON r.symbol = w.symbol AND r.date = p.date),
       dy AS (SELECT arm, signal_date, date, sum(weight * g) + greatest(1 - sum(weight), 0) * power(1.02::DOUBLE, any_value(k) / 252) AS period_growth FROM gr GROUP BY 1, 2, 3),
       en AS (SELECT arm, signal_date, coalesce(product(arg_max) OVER (PARTITION BY arm ORDER BY signal_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS base
         FROM (SELECT arm, signal_date, arg_max(period_growth, date) AS arg_max FROM dy GROUP BY 1, 2))
       SELECT dy.*, en.base * period_growth AS nav FROM dy JOIN en USING (arm, signal_date)""",
)
def _(t):
    a = stage(arms(t)).withColumn("weight", F.lit(0.05))
    w = Window.orderBy("signal_date")
    spans = t.month_ends.select("signal_date", "ord", F.lead("ord").over(w).alias("_nx")).where(F.col("_nx").isNotNull())
    periods = spans.select("signal_date", "ord", F.explode(F.sequence(F.col("ord") + 1, F.col("_nx"))).alias("_o")).join(
        t.calendar.select("date", F.col("ord").alias("_o")), "_o"
    ).select("signal_date", "date", (F.col("_o") - F.col("ord")).alias("k"))
    ret = t.price_features.select("symbol", "date", F.greatest(F.least(F.col("return_1d") * 0.01, F.lit(0.05)), F.lit(-0.05)).alias("ret"))
    return portfolio.weight_nav(a, ret, periods, 0.02)


@query(
    "X12_order_cost_columns",
    "date:d symbol:i side:s reference_notional:g notional:g fill_ratio:f estimated_fixed_slippage_cost:f estimated_market_impact_cost:f realized_slippage_cost:f",
    """SELECT *, open * filled AS reference_notional, price * filled AS notional, CASE WHEN desired > 0 THEN filled / desired ELSE 0 END AS fill_ratio,
       open * filled * 5 / 10000 AS estimated_fixed_slippage_cost, open * filled * market_impact_bps / 10000 AS estimated_market_impact_cost,
       open * filled * greatest(0, CASE WHEN side = 'BUY' THEN price / open - 1 ELSE 1 - price / open END * 10000) / 10000 AS realized_slippage_cost FROM fill_rows""",
)
def _(t):
    return ex.order_costs(fills(t))


@query(
    "X13_signal_schedule",
    "signal_date:d execution_date:d",
    """SELECT e.signal_date, c.date AS execution_date FROM month_ends e JOIN calendar c ON c.ord = e.ord + 1""",
)
def _(t):
    return cal_ops.schedule(t.calendar)


@query(
    "X14_book_weights",
    "symbol:i date:d weight:f",
    """SELECT b.symbol, b.date, (10 + b.symbol % 7) * b.close / e.equity AS weight FROM bars b JOIN (SELECT date, sum((10 + symbol % 7) * close) * 1.25 AS equity FROM bars GROUP BY date) e USING (date)
       WHERE b.symbol % 7 <> 6""",
)
def _(t):
    held = F.when(F.col("symbol") % 7 != 6, 10 + F.col("symbol") % 7).otherwise(0).cast("double")
    p = t.bars.select("symbol", "date", held.alias("shares"))
    c = t.bars.select("symbol", "date", "close")
    e = t.bars.groupBy("date").agg((F.sum((10 + F.col("symbol") % 7) * F.col("close")) * 1.25).alias("equity"))
    return ex.book_weights(p, c, e)
