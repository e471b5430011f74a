"""Selections, weights, arms and performance tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from registry import query
from registry.ranking import _ARMS, arms
from registry.research import factor_panel, z_sql
from registry.tables import ORACLE_VIEWS
from tidemark.functions import factors
from tidemark.operators import performance as perf
from tidemark.operators import portfolio, recon, select, xsec
from tidemark.operators.asof import tier_on
from tidemark.operators.features import regime
from tidemark.plans import governance, price_scores, strategy
from tidemark.session import stage


def scored(t):
    return stage(price_scores.scored_candidates(t.month_features, t.industries, min_amount=1000.0))


@query(
    "R12_chained_hold_buffer", "arm:s signal_date:d symbol:i rank:i was_held:b selection_reason:s",
    """WITH RECURSIVE rk AS (SELECT arm, signal_date, symbol, row_number() OVER (PARTITION BY arm, signal_date ORDER BY v DESC, symbol) AS rank FROM (
         SELECT 'neutral' AS arm, signal_date, symbol, score AS v FROM neutral_score UNION ALL SELECT 'raw', signal_date, symbol, score_pre_neutral FROM neutral_score)),
       d AS (SELECT arm, signal_date, row_number() OVER (PARTITION BY arm ORDER BY signal_date) AS i, list(symbol ORDER BY rank) AS l FROM rk WHERE rank <= 35 GROUP BY 1, 2),
       f AS (SELECT arm, 0::BIGINT AS i, []::BIGINT[] AS prev, []::BIGINT[] AS kept, []::BIGINT[] AS held FROM d GROUP BY arm UNION ALL
         SELECT arm, i, prev, kept, list_concat(kept, list_slice(list_filter(l, lambda x: NOT list_contains(kept, x)), 1, 20 - len(kept))) FROM (
           SELECT d.arm, d.i, d.l, f.held AS prev, list_slice(list_filter(d.l, lambda x: list_contains(f.held, x)), 1, 20) AS kept FROM f JOIN d ON d.arm = f.arm AND d.i = f.i + 1))
       SELECT rk.arm, rk.signal_date, rk.symbol, rk.rank, list_contains(f.prev, rk.symbol) AS was_held, CASE WHEN list_contains(f.kept, rk.symbol) THEN 'HOLD_BUFFER' ELSE 'NEW_ENTRY' END AS selection_reason
       FROM f JOIN d USING (arm, i) JOIN rk ON rk.arm = d.arm AND rk.signal_date = d.signal_date WHERE list_contains(f.held, rk.symbol)""",
)
def _(t):
    s = scored(t).select("signal_date", "symbol", "score", "score_pre_neutral")
    both = s.select(
        "signal_date", "symbol",
        F.explode(F.array(F.struct(F.lit("neutral").alias("arm"), F.col("score").alias("v")),
                          F.struct(F.lit("raw").alias("arm"), F.col("score_pre_neutral").alias("v")))).alias("x"),
    ).select("signal_date", "symbol", "x.*")
    ranked = xsec.ordinal_rank(both, ["arm", "signal_date"], "v", "symbol", "rank", True)
    return select.chained_selection(ranked, 20, 35)


def selected(t, n=20):
    # the rolling features are computed once: scores and the selected rows read the same table of month ends
    f = stage(t.month_features.select(*price_scores.INPUTS))
    s = price_scores.monthly_top(f, t.industries, n=n, min_amount=1000.0)
    return s.join(f.select("signal_date", "symbol", "volatility", F.col("close").alias("signal_close")), ["signal_date", "symbol"])


_TOP = """(SELECT s.*, f.volatility, f.close AS signal_close, row_number() OVER (PARTITION BY signal_date ORDER BY score DESC, symbol) AS rank
   FROM neutral_score s JOIN month_features f USING (signal_date, symbol) QUALIFY rank <= 20)"""


@query(
    "R15_preference_and_feasible_exposure",
    "signal_date:d symbol:i preference:f feasible_exposure:f",
    f"""SELECT signal_date, symbol, 1 / greatest(volatility, 1e-6) AS preference, least(0.95, count(*) OVER d * 0.08, (SELECT count(DISTINCT industry_code)
        FROM {_TOP} x WHERE x.signal_date = t.signal_date) * 0.25) AS feasible_exposure FROM {_TOP} t WINDOW d AS (PARTITION BY signal_date)""",
)
def _(t):
    s = portfolio.risk_preference(stage(selected(t)))
    return portfolio.feasible_exposure(s, ["signal_date"], F.lit(0.95))


_FEASIBLE = f"""(SELECT signal_date, symbol, industry_code, 1 / greatest(volatility, 1e-6) AS p, least(0.95, count(*) OVER d * 0.08, (SELECT count(DISTINCT industry_code)
   FROM {_TOP} x WHERE x.signal_date = t.signal_date) * 0.25) AS goal FROM {_TOP} t WINDOW d AS (PARTITION BY signal_date))"""


@query(
    "R14_capped_water_filling",
    "signal_date:d symbol:i target_weight:f feasible_exposure:f",
    f"""WITH s AS {_FEASIBLE},
       l AS (SELECT *, (0.25 - coalesce(0.08 * count(*) OVER (PARTITION BY signal_date, industry_code ORDER BY p DESC, symbol ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           / sum(p) OVER (PARTITION BY signal_date, industry_code ORDER BY p DESC, symbol ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS line,
           0.08 * count(*) OVER (PARTITION BY signal_date, industry_code) AS most FROM s),
       r AS (SELECT *, CASE WHEN most >= 0.25 THEN least(0.08, p * max(line) OVER (PARTITION BY signal_date, industry_code)) ELSE 0.08::DOUBLE END AS room FROM l),
       m AS (SELECT *, (goal - coalesce(sum(room) OVER (PARTITION BY signal_date ORDER BY room / p, symbol ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           / sum(p) OVER (PARTITION BY signal_date ORDER BY room / p, symbol ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS line2, sum(room) OVER (PARTITION BY signal_date) AS most2 FROM r)
       SELECT signal_date, symbol, CASE WHEN most2 >= goal - 1e-12 THEN least(room, p * greatest(max(line2) OVER (PARTITION BY signal_date), 0)) ELSE room END AS target_weight,
         goal AS feasible_exposure FROM m""",
)
def _(t):
    s = portfolio.feasible_exposure(portfolio.risk_preference(stage(selected(t))), ["signal_date"], F.lit(0.95))
    return portfolio.capped_weights(s, ["signal_date"])


@query("R13_minimum_variance_weights", "signal_date:d symbol:i raw_target_weight:f target_weight:f covariance_observations:i portfolio_status:s")
def _(t):
    s = portfolio.feasible_exposure(portfolio.risk_preference(stage(selected(t))), ["signal_date"], F.lit(0.95))
    s = s.withColumn("current_weight", F.when(F.col("symbol") % 2 == 0, 0.04).otherwise(0.0))
    s = portfolio.trailing_returns(s, t.price_features)
    return portfolio.minimum_variance_weights(s, ["signal_date"])


@query(
    "R16_selection_output",
    "signal_date:d symbol:i industry_code:s rank:i selection_reason:s was_held:b score:f target_weight:f current_weight:f target_weight_change:f target_exposure:f regime:s signal_close:f",
)
def _(t):
    return strategy.monthly_selection(
        scored(t), t.month_features, regime(t.benchmark), t.calendar, top_n=20, exit_rank=35
    )


_OV = """(SELECT c.signal_date, c.symbol, c.score AS price_score, s.z AS pit, m.available_factor_count FROM price_score c JOIN panel_scores s USING (signal_date, symbol)
   JOIN panel_mean m USING (signal_date, symbol) JOIN panel_rows r USING (signal_date, symbol) WHERE s.factor = 'pit_composite' AND s.z IS NOT NULL AND m.available_factor_count >= 4)"""
ORACLE_VIEWS["overlay_base"] = _OV[1:-1]
_ZP = z_sql("(SELECT signal_date, symbol, price_score AS raw FROM overlay_base)", "signal_date, symbol", "signal_date", 2)
_ZQ = z_sql("(SELECT signal_date, symbol, pit AS raw FROM overlay_base)", "signal_date, symbol", "signal_date", 2)


@query(
    "R19_score_overlay_arms",
    "arm:s signal_date:d symbol:i shadow_pit_weight:f score_pre_neutral:f",
    f"""SELECT a.arm, p.signal_date, p.symbol, a.w AS shadow_pit_weight, (1 - a.w) * coalesce(p.z, 0) + a.w * coalesce(q.z, 0) AS score_pre_neutral
        FROM ({_ZP}) p JOIN ({_ZQ}) q USING (signal_date, symbol), (VALUES ('coverage_matched_price', 0.0::DOUBLE), ('pit_only', 1.0), ('hybrid', 0.25)) a(arm, w)""",
)
def _(t):
    c = stage(price_scores.candidates(t.month_features, t.industries, min_amount=1000.0))
    _, price = price_scores.price_score(c, factors.profile_weights("legacy_v1_4"))
    p = factor_panel(t)
    pit = p.scores.where(F.col("factor") == factors.COMPOSITE).join(
        p.rows.select("signal_date", "symbol", "available_factor_count"), ["signal_date", "symbol"]
    ).select("signal_date", "symbol", F.col("z").alias("pit_score"), "available_factor_count")
    return strategy.overlay_arms(price, pit, minimum=4)


_CURVE_STATS = """SELECT arm, min(date) AS start_date, max(date) AS end_date, count(*) AS trading_days, {one} sum(0) AS zero FROM r GROUP BY arm"""
ORACLE_VIEWS["perf"] = """WITH m AS (SELECT *, base * product(1 + CASE WHEN n = 1 THEN 0 ELSE e * rb END) OVER (PARTITION BY arm ORDER BY date ROWS UNBOUNDED PRECEDING) AS mnav FROM (
      SELECT *, coalesce(benchmark_nav / lag(benchmark_nav) OVER w - 1, 0) AS rb, coalesce(lag(gross_exposure) OVER w, 0) AS e, row_number() OVER w AS n,
      first_value(nav) OVER w AS base FROM curves WINDOW w AS (PARTITION BY arm ORDER BY date))),
    r AS (SELECT *, nav / lag(nav) OVER w - 1 AS a, benchmark_nav / lag(benchmark_nav) OVER w - 1 AS b, mnav / lag(mnav) OVER w - 1 AS c,
      nav / max(nav) OVER w - 1 AS da, mnav / max(mnav) OVER w - 1 AS dc FROM m WINDOW w AS (PARTITION BY arm ORDER BY date)),
    x AS (SELECT arm, min(date) AS start_date, max(date) AS end_date, count(*) AS trading_days, arg_max(nav, date) / arg_min(nav, date) AS g, arg_max(mnav, date) / arg_min(mnav, date) AS gm,
      count(a) / 252.0::DOUBLE AS years, stddev_pop(a) AS sd, avg(a) AS mu, min(da) AS max_drawdown, min(dc) AS matched_benchmark_max_drawdown,
      stddev_pop(CASE WHEN a < 0 THEN a END) AS dsd, stddev_pop(a - c) AS te, avg(a - c) AS act, covar_pop(a, b) / var_pop(b) AS beta, avg(b) FILTER (b IS NOT NULL) AS mub,
      avg((a > 0)::INT) AS positive_day_ratio, min(a) AS worst_day, max(a) AS best_day, avg(gross_exposure) AS average_exposure, avg(nav) AS mean_nav,
      arg_max(cumulative_notional, date) AS notional, arg_max(cumulative_fees, date) AS total_fees FROM r GROUP BY arm)
    SELECT *, g - 1 AS total_return, g ** (1 / years) - 1 AS cagr, sd * sqrt(252) AS volatility, mu / sd * sqrt(252) AS sharpe, mu / dsd * sqrt(252) AS sortino,
      CASE WHEN max_drawdown < 0 THEN (g ** (1 / years) - 1) / abs(max_drawdown) END AS calmar, gm ** (1 / years) - 1 AS matched_benchmark_cagr, te * sqrt(252) AS tracking_error,
      act / te * sqrt(252) AS information_ratio, (mu - beta * mub) * 252 AS annual_alpha, 0.5 * notional / mean_nav / years AS annual_turnover,
      (g ** (1 / years) - 1) - (gm ** (1 / years) - 1) AS excess_cagr FROM x"""


@query(
    "R36_performance_metrics",
    "arm:s start_date:d end_date:d trading_days:i total_return:f cagr:f volatility:f sharpe:f sortino:f max_drawdown:f calmar:f matched_benchmark_cagr:f "
    "matched_benchmark_max_drawdown:f tracking_error:f information_ratio:f beta:f annual_alpha:f positive_day_ratio:f worst_day:f best_day:f average_exposure:f annual_turnover:f total_fees:f excess_cagr:f",
    "SELECT * FROM perf",
)
def _(t):
    return perf.performance_metrics(t.curves, ["arm"])


_PERIODS = "(VALUES ('full', DATE '1990-01-01', DATE '2010-01-01'), ('early', DATE '1995-01-01', DATE '1997-12-31'), ('late', DATE '1998-01-01', DATE '2001-12-31')) p(period, period_start, period_end)"


@query(
    "R37_period_metrics",
    "arm:s period:s start:d end_day:d trading_days:i total_return:f cagr:f annual_volatility:f sharpe:f max_drawdown:f calmar:f",
    f"""WITH d AS (SELECT c.arm, c.date, c.nav, p.period FROM curves c JOIN {_PERIODS} ON c.date BETWEEN p.period_start AND p.period_end),
        r AS (SELECT *, nav / lag(nav) OVER w - 1 AS r, nav / max(nav) OVER w - 1 AS dd FROM d WINDOW w AS (PARTITION BY arm, period ORDER BY date)),
        x AS (SELECT arm, period, min(date) AS start, max(date) AS end_day, count(*) AS trading_days, arg_max(nav, date) / arg_min(nav, date) AS g,
          greatest(date_diff('day', min(date), max(date)) / 365.2425::DOUBLE, 1 / 252) AS years, stddev_pop(r) AS sd, avg(r) AS mu, min(dd) AS max_drawdown FROM r GROUP BY 1, 2)
        SELECT *, g - 1 AS total_return, g ** (1 / years) - 1 AS cagr, sd * sqrt(252) AS annual_volatility, mu / sd * sqrt(252) AS sharpe,
        (g ** (1 / years) - 1) / abs(max_drawdown) AS calmar FROM x""",
)
def _(t):
    p = t.spark.sql(
        "SELECT * FROM VALUES ('full', DATE'1990-01-01', DATE'2010-01-01'), ('early', DATE'1995-01-01', DATE'1997-12-31'), "
        "('late', DATE'1998-01-01', DATE'2001-12-31') AS p(period, period_start, period_end)"
    )
    return perf.period_metrics(t.curves, p, ["arm"]).withColumnRenamed("end", "end_day")


@query(
    "R33_arm_comparison",
    "arm:s cagr:f sharpe:f max_drawdown:f cagr_delta_vs_production:f sharpe_delta_vs_production:f cagr_delta_vs_control:f max_drawdown_delta_vs_control:f",
    """SELECT p.arm, p.cagr, p.sharpe, p.max_drawdown, p.cagr - a.cagr AS cagr_delta_vs_production, p.sharpe - a.sharpe AS sharpe_delta_vs_production,
       p.cagr - b.cagr AS cagr_delta_vs_control, p.max_drawdown - b.max_drawdown AS max_drawdown_delta_vs_control
       FROM perf p, (SELECT * FROM perf WHERE arm = 'arm0') a, (SELECT * FROM perf WHERE arm = 'arm1') b""",
)
def _(t):
    m = stage(perf.performance_metrics(t.curves, ["arm"]))
    return perf.arm_comparison(m, ["cagr", "sharpe", "max_drawdown"], {"production": "arm0", "control": "arm1"})


@query(
    "R34_annual_metrics_with_rank",
    "year:i arm:s return:f rank:i",
    """WITH r AS (SELECT arm, date, year(date) AS year, nav / lag(nav) OVER (PARTITION BY arm ORDER BY date) - 1 AS r FROM curves),
       y AS (SELECT arm, year, product(1 + coalesce(r, 0)) - 1 AS return FROM r GROUP BY 1, 2)
       SELECT *, row_number() OVER (PARTITION BY year ORDER BY return DESC, arm) AS rank FROM y""",
)
def _(t):
    place = F.row_number().over(Window.partitionBy("year").orderBy(F.col("return").desc(), "arm"))
    return perf.annual_metrics(t.curves).withColumn("rank", place)


@query(
    "R35_selection_attribution",
    "signal_date:d arm:s selected_count:i overlap_with_production:i jaccard_with_production:f overlap_with_control:i jaccard_with_control:f average_score:f",
    f"""WITH s AS (SELECT a.*, f.mom_6_1 AS score FROM {_ARMS} a LEFT JOIN month_features f USING (signal_date, symbol)), n AS (SELECT signal_date, arm, count(*) AS k, avg(score) AS average_score FROM s GROUP BY 1, 2),
        o AS (SELECT x.signal_date, x.arm, y.arm AS base, count(*) AS k FROM s x JOIN s y USING (signal_date, symbol) GROUP BY 1, 2, 3)
        SELECT n.signal_date, n.arm, n.k AS selected_count, coalesce(p.k, 0) AS overlap_with_production, coalesce(p.k, 0) / (n.k + b.k - coalesce(p.k, 0)) AS jaccard_with_production,
        coalesce(c.k, 0) AS overlap_with_control, coalesce(c.k, 0) / (n.k + v.k - coalesce(c.k, 0)) AS jaccard_with_control, n.average_score
        FROM n JOIN n b ON b.signal_date = n.signal_date AND b.arm = 'base' JOIN n v ON v.signal_date = n.signal_date AND v.arm = 'volume'
        LEFT JOIN o p ON p.signal_date = n.signal_date AND p.arm = n.arm AND p.base = 'base' LEFT JOIN o c ON c.signal_date = n.signal_date AND c.arm = n.arm AND c.base = 'volume'""",
)
def _(t):
    s = stage(arms(t))
    names = ["base", "volume", "price"]
    prod = recon.selection_overlap(s, "base", names).withColumnsRenamed({"overlap": "overlap_with_production", "jaccard": "jaccard_with_production"})
    ctrl = recon.selection_overlap(s, "volume", names).withColumnsRenamed({"overlap": "overlap_with_control", "jaccard": "jaccard_with_control"})
    score = s.join(t.month_features.select("signal_date", "symbol", "mom_6_1"), ["signal_date", "symbol"], "left").groupBy("signal_date", "arm").agg(
        F.avg("mom_6_1").alias("average_score")
    )
    return prod.join(ctrl.drop("selected_count"), ["signal_date", "arm"]).join(score, ["signal_date", "arm"])


_SHADOW = {
    "signal_dates": "(SELECT count(DISTINCT signal_date) FROM panel_rows)",
    "median_score_coverage": "(SELECT median(c) FROM cov)",
    "minimum_score_coverage": "(SELECT min(c) FROM cov)",
    "cagr_delta": "h.cagr - k.cagr", "sharpe_delta": "h.sharpe - k.sharpe", "drawdown_delta": "h.max_drawdown - k.max_drawdown",
    "turnover_ratio": "h.annual_turnover / k.annual_turnover",
    "positive_annual_increment_ratio": "(SELECT avg((a.g - b.g > 0)::INT) FROM yr a JOIN yr b USING (year) WHERE a.arm = 'arm3' AND b.arm = 'arm1')",
    "maximum_cost_cagr": "h.cagr - 0.002",
}
_OPS = {"ge": ">=", "gt": ">", "le": "<="}


@query(
    "R32_shadow_governance",
    "check_name:s value:f threshold:f passed:b all_passed:b decision:s",
    "WITH cov AS (SELECT signal_date, count(z) / max(universe_size) AS c FROM panel_long WHERE factor = 'pit_composite' GROUP BY 1), "
    "yr AS (SELECT arm, year, product(1 + coalesce(r, 0)) AS g FROM (SELECT arm, year(date) AS year, nav / lag(nav) OVER (PARTITION BY arm ORDER BY date) - 1 AS r FROM curves) GROUP BY 1, 2), "
    "v AS (SELECT 1.0 AS upstream_review, " + ", ".join(f"{e} AS {k}" for k, e in _SHADOW.items())
    + " FROM perf h, perf k WHERE h.arm = 'arm3' AND k.arm = 'arm1'), c AS ("
    + " UNION ALL ".join(
        f"SELECT '{n}' AS check_name, {col}::DOUBLE AS value, {th} AS threshold, coalesce({col} {_OPS[op]} {th}, false) AS passed FROM v"
        for n, col, op, th in [("upstream_manual_review_gate", "upstream_review", "ge", 1.0), *governance.SHADOW_CHECKS]
    )
    + ") SELECT *, bool_and(passed) OVER () AS all_passed, CASE WHEN bool_and(passed) OVER () THEN 'eligible_for_forward_paper_tracking' ELSE 'insufficient_strict_ledger_evidence' END AS decision FROM c",
)
def _(t):
    p = factor_panel(t)
    comp = p.with_scores().where(F.col("factor") == factors.COMPOSITE)
    cov = comp.groupBy("signal_date").agg((F.count("z") / F.max("universe_size")).alias("eligible_coverage"))
    m = stage(perf.performance_metrics(t.curves, ["arm"]))
    costs = m.where(F.col("arm") == "arm3").select(
        F.explode(F.array(F.lit(5.0), F.lit(20.0))).alias("fixed_slippage_bps"), F.col("cagr").alias("_c")
    ).select("fixed_slippage_bps", (F.col("_c") - F.col("fixed_slippage_bps") / 10000).alias("cagr"))
    ev = governance.shadow_evidence(cov, m, perf.annual_metrics(t.curves), costs, "arm3", "arm1")
    return governance.shadow_governance(ev, "eligible_for_manual_candidate_review", True)
