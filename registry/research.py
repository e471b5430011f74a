"""Cross-sectional scores, the factor panel and its diagnostics."""

import re
from dataclasses import replace
from functools import cache

from pyspark.sql import functions as F

from registry import query
from registry.tables import ORACLE_VIEWS, Tables
from tidemark.functions import factors
from tidemark.operators import diagnostics as dx
from tidemark.operators import asof, select, xsec
from tidemark.plans import governance, price_scores
from tidemark.session import stage
from tidemark.operators.calendar import month_ends
from tidemark.plans.factor_panel import build_factor_panel, build_score_panel, score_members

NAMES = [
    "roe_quality", "gross_margin_quality", "low_leverage_quality", "revenue_growth", "earnings_growth",
    "earnings_yield", "book_to_price", "sales_yield", "dividend_yield",
]
MIN_OBS = 10
_Z = """SELECT {key}, CASE WHEN n >= {m} AND sd >= 1e-12 THEN (c - mu) / sd END AS z FROM (SELECT *, avg(c) OVER p AS mu, stddev_pop(c) OVER p AS sd
   FROM (SELECT *, CASE WHEN raw IS NOT NULL THEN greatest(least(raw, hi), lo) END AS c FROM {src} r LEFT JOIN (SELECT {by}, count(raw) AS n,
   quantile_cont(raw, {q}) AS lo, quantile_cont(raw, 1 - {q}) AS hi FROM {src} WHERE raw IS NOT NULL GROUP BY {by}) b USING ({by})) WINDOW p AS (PARTITION BY {by}))"""


def z_sql(src, key, by, m=3, q=0.05):
    return _Z.format(src=src, key=key, by=by, m=m, q=q)


ORACLE_VIEWS.update(
    {
        "prices_20": """SELECT symbol, date, ord, CASE WHEN ord - max(CASE WHEN price IS NOT NULL THEN ord END) OVER w <= 20 THEN
            last_value(price IGNORE NULLS) OVER w END AS p FROM (SELECT g.symbol, g.date, g.ord, m.total_close AS price FROM (
            SELECT s.symbol, c.date, c.ord FROM calendar c JOIN (SELECT symbol, min(ord) AS a, max(ord) AS b FROM bars JOIN calendar USING (date) GROUP BY symbol) s
            ON c.ord BETWEEN s.a AND s.b + 20) g LEFT JOIN market m USING (symbol, date)) WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)""",
        "panel_signals": """SELECT *, lead(signal_date) OVER (ORDER BY signal_date) AS next_signal_date, lead(ord) OVER (ORDER BY signal_date) AS next_ord FROM month_ends""",
        "panel_members": """SELECT e.signal_date, e.ord, e.next_signal_date, e.next_ord, m.symbol, count(*) OVER (PARTITION BY e.signal_date) AS universe_size,
            e.ord + 63 <= (SELECT max(ord) FROM calendar) AS room FROM panel_signals e JOIN membership m ON m.date = e.signal_date WHERE e.ord + 1 <= (SELECT max(ord) FROM calendar)""",
        "panel_facts": """SELECT e.signal_date, f.* FROM panel_members e JOIN facts f ON f.symbol = e.symbol AND f.available_date <= e.signal_date
            AND date_diff('day', f.period_end, e.signal_date) <= 550 QUALIFY row_number() OVER (PARTITION BY e.signal_date, f.symbol, f.metric
            ORDER BY f.period_end DESC, f.available_date DESC, f.revision_sequence DESC, f.source_row_sha256 DESC) = 1""",
        "panel_vals": """SELECT e.signal_date, v.* FROM panel_members e JOIN valuations v ON v.symbol = e.symbol AND v.available_date <= e.signal_date
            AND date_diff('day', v.date, e.signal_date) <= 45 QUALIFY row_number() OVER (PARTITION BY e.signal_date, v.symbol ORDER BY v.date DESC) = 1""",
        "panel_raw": """SELECT m.signal_date, m.symbol, d.factor, CASE d.kind WHEN 'f' THEN d.sign * f.value ELSE
            CASE d.factor WHEN 'earnings_yield' THEN CASE WHEN v.pe_ttm > 0 THEN 1 / v.pe_ttm END WHEN 'book_to_price' THEN CASE WHEN v.pb > 0 THEN 1 / v.pb END
            WHEN 'sales_yield' THEN CASE WHEN v.ps_ttm > 0 THEN 1 / v.ps_ttm END WHEN 'dividend_yield' THEN v.dividend_yield_ttm_pct END END AS raw
            FROM panel_members m CROSS JOIN (VALUES ('roe_quality', 'f', 'roe_pct', 1), ('gross_margin_quality', 'f', 'gross_margin_pct', 1),
            ('low_leverage_quality', 'f', 'debt_to_assets_pct', -1), ('revenue_growth', 'f', 'revenue_yoy_pct', 1), ('earnings_growth', 'f', 'net_income_yoy_pct', 1),
            ('earnings_yield', 'v', '', 1), ('book_to_price', 'v', '', 1), ('sales_yield', 'v', '', 1), ('dividend_yield', 'v', '', 1)) d(factor, kind, metric, sign)
            LEFT JOIN panel_facts f ON f.signal_date = m.signal_date AND f.symbol = m.symbol AND f.metric = d.metric
            LEFT JOIN panel_vals v ON v.signal_date = m.signal_date AND v.symbol = m.symbol""",
        "panel_z": z_sql("panel_raw", "signal_date, symbol, factor, raw", "signal_date, factor"),
        "panel_mean": """SELECT signal_date, symbol, 'pit_composite' AS factor, count(z) AS available_factor_count, CASE WHEN count(z) >= 4 THEN avg(z) END AS raw
            FROM panel_z GROUP BY 1, 2""",
        "panel_scores": "SELECT * FROM panel_z UNION ALL BY NAME " + z_sql("panel_mean", "signal_date, symbol, factor, raw", "signal_date, factor"),
        "panel_rows": """SELECT m.signal_date, m.symbol, m.universe_size, c.available_factor_count, m.next_signal_date,
            coalesce(i.industry_code, 'UNKNOWN') AS industry_code, ln(CASE WHEN v.total_market_value_10k_cny > 0 THEN v.total_market_value_10k_cny END) AS log_total_market_value,
            b.p / a.p - 1 AS forward_return_21d, d.p / a.p - 1 AS forward_return_63d, x.p / a.p - 1 AS forward_return_next_signal
            FROM panel_members m JOIN panel_mean c USING (signal_date, symbol) LEFT JOIN panel_vals v USING (signal_date, symbol)
            LEFT JOIN industries i ON i.symbol = m.symbol AND i.in_date <= m.signal_date AND (i.out_date IS NULL OR i.out_date >= m.signal_date)
            LEFT JOIN prices_20 a ON a.symbol = m.symbol AND a.ord = m.ord LEFT JOIN prices_20 b ON b.symbol = m.symbol AND b.ord = m.ord + 21
            LEFT JOIN prices_20 d ON d.symbol = m.symbol AND d.ord = m.ord + 63 LEFT JOIN prices_20 x ON x.symbol = m.symbol AND x.ord = m.next_ord WHERE m.room""",
        "panel_long": """SELECT s.*, r.* EXCLUDE (signal_date, symbol) FROM panel_scores s JOIN panel_rows r USING (signal_date, symbol)""",
        "panel_h": """SELECT signal_date, symbol, factor, raw, z, 21 AS horizon_days, forward_return_21d AS ret FROM panel_long UNION ALL
            SELECT signal_date, symbol, factor, raw, z, 63, forward_return_63d FROM panel_long""",
        "ic_rows": """SELECT signal_date, factor, horizon_days, count(r1) AS observations, CASE WHEN count(r1) >= 10 AND stddev_pop(r1) > 0 AND stddev_pop(r2) > 0 THEN corr(r1, r2) END AS spearman_ic
            FROM (SELECT *, CASE WHEN ok THEN rank() OVER (PARTITION BY signal_date, factor, horizon_days, ok ORDER BY z) + (count(*) OVER (PARTITION BY signal_date, factor, horizon_days, ok, z) - 1) / 2 END AS r1,
            CASE WHEN ok THEN rank() OVER (PARTITION BY signal_date, factor, horizon_days, ok ORDER BY ret) + (count(*) OVER (PARTITION BY signal_date, factor, horizon_days, ok, ret) - 1) / 2 END AS r2
            FROM (SELECT *, z IS NOT NULL AND ret IS NOT NULL AS ok FROM panel_h)) GROUP BY 1, 2, 3""",
        "ic_summary": """SELECT factor, horizon_days, count(spearman_ic) AS valid_periods, avg(spearman_ic) AS mean_ic, median(spearman_ic) AS median_ic,
            CASE WHEN count(spearman_ic) > 1 THEN stddev_samp(spearman_ic) END AS ic_std, CASE WHEN stddev_samp(spearman_ic) > 0 THEN avg(spearman_ic) / stddev_samp(spearman_ic) END AS ic_ir,
            CASE WHEN stddev_samp(spearman_ic) > 0 THEN avg(spearman_ic) / (stddev_samp(spearman_ic) / sqrt(count(spearman_ic))) END AS ic_t_stat,
            avg((spearman_ic > 0)::INT) AS positive_ic_ratio FROM ic_rows GROUP BY 1, 2""",
        "labelled": """SELECT *, CASE WHEN z IS NOT NULL AND n >= 10 AND lo < hi THEN greatest(1, ceil((r - 1) * 5 / (n - 1)))::INT END AS quantile FROM (
            SELECT *, row_number() OVER (PARTITION BY signal_date, factor, z IS NULL ORDER BY z, symbol) AS r, count(z) OVER p AS n, min(z) OVER p AS lo, max(z) OVER p AS hi
            FROM panel_long WINDOW p AS (PARTITION BY signal_date, factor))""",
        "quantile_rows": """SELECT signal_date, factor, horizon_days, quantile, count(*) AS observations, avg(ret) AS mean_forward_return, median(ret) AS median_forward_return
            FROM (SELECT signal_date, factor, quantile, 21 AS horizon_days, forward_return_21d AS ret FROM labelled UNION ALL
            SELECT signal_date, factor, quantile, 63, forward_return_63d FROM labelled) WHERE quantile IS NOT NULL AND ret IS NOT NULL GROUP BY 1, 2, 3, 4""",
        "quantile_summary": """SELECT factor, horizon_days, count(t - b) AS valid_spread_periods, avg(b) AS bottom_quantile_mean_return, avg(t) AS top_quantile_mean_return,
            avg(t - b) AS top_minus_bottom_mean_return, avg((t - b > 0)::INT) AS positive_spread_ratio FROM (SELECT factor, horizon_days, signal_date,
            max(mean_forward_return) FILTER (quantile = 1) AS b, max(mean_forward_return) FILTER (quantile = 5) AS t FROM quantile_rows GROUP BY 1, 2, 3) GROUP BY 1, 2""",
        "exposure_rows": """WITH s AS (SELECT signal_date, factor, CASE WHEN count(*) >= 3 AND stddev_pop(r1) > 0 AND stddev_pop(r2) > 0 THEN corr(r1, r2) END AS size_spearman FROM (
              SELECT *, rank() OVER (PARTITION BY signal_date, factor ORDER BY z) + (count(*) OVER (PARTITION BY signal_date, factor, z) - 1) / 2 AS r1,
              rank() OVER (PARTITION BY signal_date, factor ORDER BY log_total_market_value) + (count(*) OVER (PARTITION BY signal_date, factor, log_total_market_value) - 1) / 2 AS r2
              FROM panel_long WHERE z IS NOT NULL AND log_total_market_value IS NOT NULL) GROUP BY 1, 2),
            k AS (SELECT signal_date, factor, industry_code, z, avg(z) OVER (PARTITION BY signal_date, factor) AS mu, avg(z) OVER (PARTITION BY signal_date, factor, industry_code) AS fit
              FROM panel_long WHERE z IS NOT NULL AND industry_code <> 'UNKNOWN'),
            i AS (SELECT signal_date, factor, count(DISTINCT industry_code) AS industries, max(abs(fit)) AS maximum_absolute_industry_mean_z,
              CASE WHEN count(*) >= 3 AND count(DISTINCT industry_code) >= 2 AND sum((z - mu) ** 2) >= 1e-12 THEN greatest(0, least(1, 1 - sum((z - fit) ** 2) / sum((z - mu) ** 2))) END AS industry_r_squared
              FROM k GROUP BY 1, 2)
            SELECT b.*, s.size_spearman, coalesce(i.industries, 0) AS industries, i.industry_r_squared, i.maximum_absolute_industry_mean_z FROM
            (SELECT signal_date, factor, count(z) AS observations FROM panel_long GROUP BY 1, 2) b LEFT JOIN s USING (signal_date, factor) LEFT JOIN i USING (signal_date, factor)""",
        "exposure_summary": """SELECT factor, count(*) AS periods, median(size_spearman) AS median_size_spearman, median(abs(size_spearman)) AS median_absolute_size_spearman,
            max(abs(size_spearman)) AS maximum_absolute_size_spearman, median(industry_r_squared) AS median_industry_r_squared, max(industry_r_squared) AS maximum_industry_r_squared
            FROM exposure_rows GROUP BY 1""",
        "cost_rows": """WITH b AS (SELECT signal_date, factor, symbol, 1 / count(*) OVER (PARTITION BY signal_date, factor)::DOUBLE AS w FROM labelled WHERE quantile = 5),
            d AS (SELECT DISTINCT signal_date FROM panel_long), n AS (SELECT signal_date, lead(signal_date) OVER (ORDER BY signal_date) AS nx FROM d),
            m AS (SELECT factor, signal_date, symbol, w FROM b UNION ALL SELECT b.factor, n.nx, b.symbol, -b.w FROM b JOIN n USING (signal_date) WHERE n.nx IS NOT NULL),
            t AS (SELECT factor, signal_date, sum(abs(x)) AS turn FROM (SELECT factor, signal_date, symbol, sum(w) AS x FROM m GROUP BY 1, 2, 3) GROUP BY 1, 2),
            h AS (SELECT signal_date, factor, count(*) FILTER (quantile = 5) AS holdings, count(forward_return_next_signal) FILTER (quantile = 5) AS realized_outcomes,
              avg(forward_return_next_signal) FILTER (quantile = 5) AS gross_return FROM labelled GROUP BY 1, 2)
            SELECT h.signal_date, h.factor, c.bps AS cost_bps_per_traded_side, holdings, realized_outcomes, coalesce(realized_outcomes / nullif(holdings, 0), 0) AS outcome_coverage,
            coalesce(turn, 0) AS two_sided_weight_turnover, gross_return, coalesce(turn, 0) * bps / 10000 AS estimated_cost, gross_return - coalesce(turn, 0) * bps / 10000 AS net_return
            FROM h LEFT JOIN t USING (signal_date, factor), (VALUES (5.0::DOUBLE), (10.0), (20.0)) c(bps)""",
        "cost_summary": """WITH g AS (SELECT *, product(1 + gross_return) OVER w AS gc, product(1 + net_return) OVER w AS nc FROM cost_rows WHERE gross_return IS NOT NULL
              WINDOW w AS (PARTITION BY factor, cost_bps_per_traded_side ORDER BY signal_date ROWS UNBOUNDED PRECEDING)),
            x AS (SELECT *, nc / max(nc) OVER (PARTITION BY factor, cost_bps_per_traded_side ORDER BY signal_date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM g),
            a AS (SELECT factor, cost_bps_per_traded_side, CASE WHEN min(gross_return) > -1 THEN arg_max(gc, signal_date) - 1 END AS gross_cumulative_return,
              CASE WHEN min(gross_return) > -1 THEN arg_max(gc, signal_date) ** (12.0 / count(*)) - 1 END AS gross_annualized_return,
              CASE WHEN min(net_return) > -1 THEN arg_max(nc, signal_date) ** (12.0 / count(*)) - 1 END AS net_annualized_return,
              CASE WHEN min(net_return) > -1 THEN min(dd) END AS net_maximum_drawdown FROM x GROUP BY 1, 2)
            SELECT * FROM (SELECT factor, cost_bps_per_traded_side, count(*) AS periods, avg(outcome_coverage) AS average_outcome_coverage, min(outcome_coverage) AS minimum_outcome_coverage,
            avg(two_sided_weight_turnover) AS average_two_sided_weight_turnover FROM cost_rows GROUP BY 1, 2) LEFT JOIN a USING (factor, cost_bps_per_traded_side)""",
    }
)


def evidence_sql(src, by, q=5, minimum=MIN_OBS):
    """Evidence over rows (by..., signal_date, symbol, score, ret)."""
    per = f"{by}, signal_date"
    return f"""WITH s AS (SELECT * FROM ({src}) WHERE score IS NOT NULL AND ret IS NOT NULL),
      k AS (SELECT *, rank() OVER (PARTITION BY {per} ORDER BY score) + (count(*) OVER (PARTITION BY {per}, score) - 1) / 2 AS r1,
        rank() OVER (PARTITION BY {per} ORDER BY ret) + (count(*) OVER (PARTITION BY {per}, ret) - 1) / 2 AS r2,
        row_number() OVER (PARTITION BY {per} ORDER BY score, symbol) AS rn, count(*) OVER (PARTITION BY {per}) AS n,
        min(score) OVER (PARTITION BY {per}) AS lo, max(score) OVER (PARTITION BY {per}) AS hi FROM s),
      d AS (SELECT {per}, CASE WHEN count(*) >= {minimum} AND stddev_pop(r1) > 0 AND stddev_pop(r2) > 0 THEN corr(r1, r2) END AS ic,
        avg(ret) FILTER (n >= {2 * q} AND lo < hi AND greatest(1, ceil((rn - 1) * {q} / (n - 1))) = {q}) -
        avg(ret) FILTER (n >= {2 * q} AND lo < hi AND greatest(1, ceil((rn - 1) * {q} / (n - 1))) = 1) AS spread FROM k GROUP BY {per})
      SELECT {by}, count(ic) AS valid_ic_periods, avg(ic) AS mean_ic, avg((ic > 0)::INT) AS positive_ic_ratio,
        count(spread) AS valid_spread_periods, avg(spread) AS top_minus_bottom_mean_return FROM d GROUP BY {by}"""


ROLLING_SRC = """SELECT w.window_no, w.train_start, w.train_end, w.test_start, w.test_end, p.horizon_days, p.signal_date, p.symbol, p.z AS score, p.ret FROM panel_h p JOIN (
    SELECT k + 1 AS window_no, a AS train_start, ((a + to_years(2 + k))::DATE - 1) AS train_end, (a + to_years(2 + k))::DATE AS test_start,
    least(((a + to_years(3 + k))::DATE - 1), b) AS test_end FROM (SELECT min(signal_date) AS a, max(signal_date) AS b FROM panel_rows), generate_series(0, 20) s(k)
    WHERE (a + to_years(2 + k))::DATE <= b) w ON p.signal_date BETWEEN w.test_start AND w.test_end WHERE p.factor = 'pit_composite'"""
ORACLE_VIEWS["rolling_rows"] = evidence_sql(ROLLING_SRC, "window_no, train_start, train_end, test_start, test_end, horizon_days")

_PANELS: dict = {}


def panels(t):
    """(panel, scored members of all month ends): materialised once per session and table folder; every diagnostic reads the panel."""
    key = (t.spark.sparkContext.applicationId, t.sf_dir)
    if key not in _PANELS:
        b = Tables(t.spark, t.sf_dir)
        # months and labels read two columns of the bars, members and valuations the months
        b.bars = stage(b.bars.select("date", "symbol", "close", "amount"))
        b.months = stage(b.months)
        # row hashes travel as 32 bytes, which sort as their hex digits do
        b.fact_rows = b.fact_rows.withColumn("source_row_sha256", F.unhex("source_row_sha256"))
        scored = score_members(month_ends(b.calendar), b.membership, b.facts, b.valuations, NAMES, 4, valuation_age=45)
        built = build_factor_panel(
            calendar=b.calendar, membership=b.membership, industries=b.industries, market=b.market, facts=b.facts,
            valuations=b.valuations, names=NAMES, horizons=(21, 63), minimum_factors=4, valuation_age=45, scored=scored,
        )
        text = built.lineage.withColumn("source_row_sha256", F.lower(F.hex("source_row_sha256")))
        _PANELS[key] = replace(built, lineage=text), scored
    return _PANELS[key]


def factor_panel(t):
    return panels(t)[0]


def long_panel(t):
    return factor_panel(t).with_scores()


def labelled_panel(t):
    """The panel; in a bundle with the fifth of each score, which buckets and books read."""
    if t.parts is None:
        return long_panel(t)
    returns = [c for c in long_panel(t).columns if c.startswith("forward_return_")]
    return kept(t, "labelled", lambda: dx.score_quantiles(long_panel(t), 5).select("signal_date", "symbol", "factor", "quantile", *returns))


def kept(t, name, make):
    """A table that several queries of a bundle read: staged once in ``t.parts``, or just made for a query by itself."""
    if t.parts is None:
        return make()
    if name not in t.parts:
        t.parts[name] = stage(make())
    return t.parts[name]


def diagnostic(t, name):
    make = {
        "coverage": lambda: dx.coverage(long_panel(t)),
        "rank_ic": lambda: dx.rank_ic(long_panel(t), [21, 63], MIN_OBS),
        "quantile_returns": lambda: dx.quantile_returns(labelled_panel(t), [21, 63], 5),
        "exposures": lambda: dx.exposures(long_panel(t)),
        "rolling": lambda: dx.rolling_validation(long_panel(t).where(F.col("factor") == factors.COMPOSITE), [21, 63], 2, 1, 5, MIN_OBS),
        "cost_stress": lambda: dx.cost_stress(labelled_panel(t), 5, [5.0, 10.0, 20.0]),
    }
    return kept(t, name, make[name])


@query(
    "R7_zscore_zero_policy",
    "signal_date:d symbol:i z:f",
    "SELECT signal_date, symbol, coalesce(z, 0) AS z FROM ("
    + z_sql("(SELECT signal_date, symbol, mom_6_1 AS raw FROM month_features)", "signal_date, symbol", "signal_date", 2) + ")",
)
def _(t):
    f = stage(t.month_features.select("signal_date", "symbol", "mom_6_1"))
    return xsec.winsorised_z(f, ["signal_date"], "mom_6_1", "z", 0.05, 2, "zero")


@query(
    "R8_zscore_null_policy",
    "signal_date:d symbol:i z:f",
    z_sql("(SELECT signal_date, symbol, mom_6_1 AS raw FROM month_features)", "signal_date, symbol", "signal_date", 3),
)
def _(t):
    f = stage(t.month_features.select("signal_date", "symbol", "mom_6_1"))
    return xsec.winsorised_z(f, ["signal_date"], "mom_6_1", "z")


ORACLE_VIEWS["candidates"] = """SELECT f.*, ln(greatest(total_mv, 1e-12)) AS log_total_mv, i.industry_code, i.industry_name FROM month_features f
    JOIN industries i ON i.symbol = f.symbol AND i.in_date <= f.signal_date AND (i.out_date IS NULL OR i.out_date >= f.signal_date)
    WHERE NOT is_st AND history_days >= 252 AND avg_amount_20 >= 1000 AND close >= 3 AND mom_12_1 IS NOT NULL AND mom_6_1 IS NOT NULL
    AND fip_momentum IS NOT NULL AND trend IS NOT NULL AND volatility IS NOT NULL AND downside_volatility IS NOT NULL AND drawdown_quality IS NOT NULL"""
ORACLE_VIEWS["price_z"] = "SELECT signal_date, symbol, factor, coalesce(z, 0) AS z FROM (" + z_sql(
    """(SELECT signal_date, symbol, 'mom_12_1' AS factor, mom_12_1 AS raw FROM candidates UNION ALL SELECT signal_date, symbol, 'mom_6_1', mom_6_1 FROM candidates UNION ALL
    SELECT signal_date, symbol, 'fip_momentum', fip_momentum FROM candidates UNION ALL SELECT signal_date, symbol, 'trend', trend FROM candidates UNION ALL
    SELECT signal_date, symbol, 'low_vol', -volatility FROM candidates UNION ALL SELECT signal_date, symbol, 'low_downside_vol', -downside_volatility FROM candidates UNION ALL
    SELECT signal_date, symbol, 'drawdown_quality', drawdown_quality FROM candidates UNION ALL SELECT signal_date, symbol, 'liquidity', ln(1 + avg_amount_20) FROM candidates)""",
    "signal_date, symbol, factor", "signal_date, factor", 2) + ")"
ORACLE_VIEWS["price_score"] = """SELECT signal_date, symbol, sum(z * CASE factor WHEN 'mom_12_1' THEN 0.35::DOUBLE WHEN 'mom_6_1' THEN 0.20 WHEN 'trend' THEN 0.15
    WHEN 'low_vol' THEN 0.20 WHEN 'liquidity' THEN 0.10 ELSE 0 END) AS score FROM price_z GROUP BY 1, 2"""
ORACLE_VIEWS["size_z"] = "SELECT signal_date, symbol, coalesce(z, 0) AS z_size FROM (" + z_sql(
    "(SELECT signal_date, symbol, log_total_mv AS raw FROM candidates)", "signal_date, symbol", "signal_date", 2) + ")"
ORACLE_VIEWS["neutral_score"] = """WITH x AS (SELECT c.signal_date, c.symbol, c.industry_code, c.industry_name, s.score AS y, z.z_size AS z FROM candidates c
      JOIN price_score s USING (signal_date, symbol) JOIN size_z z USING (signal_date, symbol)),
    g AS (SELECT *, avg(y) OVER k AS yb, avg(z) OVER k AS zb FROM x WINDOW k AS (PARTITION BY signal_date, industry_code)),
    b AS (SELECT signal_date, CASE WHEN sum((z - zb) ** 2) > 1e-18 THEN sum((z - zb) * (y - yb)) / sum((z - zb) ** 2) ELSE 0 END AS beta FROM g GROUP BY 1),
    r AS (SELECT g.*, y - (yb - beta * zb + beta * z) AS res FROM g JOIN b USING (signal_date)),
    m AS (SELECT *, avg(res) OVER d AS mu, stddev_pop(res) OVER d AS sd, count(*) OVER d AS n FROM r WINDOW d AS (PARTITION BY signal_date))
    SELECT signal_date, symbol, industry_code, industry_name, y AS score_pre_neutral, z AS z_size, CASE WHEN n >= 2 AND sd >= 1e-12 THEN (res - mu) / sd ELSE 0 END AS score FROM m"""


@query(
    "P11_eligibility_filter",
    "signal_date:d symbol:i close:f avg_amount_20:f industry_code:s",
    "SELECT * FROM candidates",
)
def _(t):
    return price_scores.candidates(t.month_features, t.industries, min_amount=1000.0)


@query(
    "P12_minimum_candidate_count",
    "signal_date:d symbol:i",
    "SELECT signal_date, symbol FROM candidates QUALIFY count(*) OVER (PARTITION BY signal_date) >= 60",
)
def _(t):
    from tidemark.operators.market import enough_candidates

    c = price_scores.candidates(t.month_features, t.industries, min_amount=1000.0)
    return enough_candidates(stage(c.select("signal_date", "symbol")), 60)  # counted, then met again


@query("R9_weighted_price_score", "signal_date:d symbol:i score:f", "SELECT * FROM price_score")
def _(t):
    c = stage(price_scores.candidates(t.month_features, t.industries, min_amount=1000.0))
    return price_scores.price_score(c, factors.profile_weights("legacy_v1_4"))[1]


@query(
    "R11_neutralised_score",
    "signal_date:d symbol:i score_pre_neutral:f z_size:f score:f",
    "SELECT * FROM neutral_score",
)
def _(t):
    return price_scores.scored_candidates(t.month_features, t.industries, min_amount=1000.0)


@query(
    "flagship_monthly_top20",
    "signal_date:d symbol:i industry_code:s score:f rank:i",
    "SELECT *, row_number() OVER (PARTITION BY signal_date ORDER BY score DESC, symbol) AS rank FROM neutral_score QUALIFY rank <= 20",
)
def _(t):
    return price_scores.monthly_top(t.month_features, t.industries, n=20, min_amount=1000.0)


_MEMBER_VIEWS = ("candidates", "price_z", "price_score", "size_z", "neutral_score")
for _name in _MEMBER_VIEWS:
    # the same statements over the candidates that are members and have a bar of the last ten days
    ORACLE_VIEWS[f"member_{_name}"] = re.sub(rf"\b({'|'.join(_MEMBER_VIEWS)})\b", r"member_\1", ORACLE_VIEWS[_name]).replace(
        "FROM month_features f", "FROM (SELECT * FROM month_features m WHERE signal_date - date <= 10 AND EXISTS (SELECT 1 FROM membership k WHERE k.symbol = m.symbol AND k.date = m.signal_date)) f"
    )


def member_filters(t):
    """Index members as of each signal date with a recent bar."""
    return {"min_amount": 1000.0, "members": asof.latest_snapshot(t.month_ends, t.membership), "max_age_days": 10}


@query("P11_member_candidates", "signal_date:d symbol:i close:f avg_amount_20:f industry_code:s", "SELECT * FROM member_candidates")
def _(t):
    return price_scores.candidates(t.month_features, t.industries, **member_filters(t))


@query(
    "P12_minimum_member_count", "signal_date:d symbol:i",
    "SELECT signal_date, symbol FROM member_candidates QUALIFY count(*) OVER (PARTITION BY signal_date) >= 15",
)
def _(t):
    from tidemark.operators.market import enough_candidates

    return enough_candidates(price_scores.candidates(t.month_features, t.industries, **member_filters(t)), 15)


@query("R9_member_price_score", "signal_date:d symbol:i score:f", "SELECT * FROM member_price_score")
def _(t):
    c = stage(price_scores.candidates(t.month_features, t.industries, **member_filters(t)))
    return price_scores.price_score(c, factors.profile_weights("legacy_v1_4"))[1]


@query("R11_neutralised_member_score", "signal_date:d symbol:i score_pre_neutral:f z_size:f score:f", "SELECT * FROM member_neutral_score")
def _(t):
    return price_scores.scored_candidates(t.month_features, t.industries, **member_filters(t))


@query(
    "flagship_member_top20", "signal_date:d symbol:i industry_code:s score:f rank:i",
    "SELECT *, row_number() OVER (PARTITION BY signal_date ORDER BY round(score, 9) + 0.0 DESC, symbol) AS rank FROM member_neutral_score QUALIFY rank <= 20",
)
def _(t):
    return price_scores.monthly_top(t.month_features, t.industries, n=20, digits=9, **member_filters(t))


@query(
    "R10_equal_weight_composite",
    "signal_date:d symbol:i available_factor_count:i composite:f z:f",
    """SELECT m.signal_date, m.symbol, m.available_factor_count, m.raw AS composite, s.z FROM panel_mean m JOIN panel_scores s USING (signal_date, symbol)
       JOIN panel_rows r USING (signal_date, symbol) WHERE s.factor = 'pit_composite'""",
)
def _(t):
    p = factor_panel(t)
    return p.scores.where(F.col("factor") == factors.COMPOSITE).join(
        p.rows.select("signal_date", "symbol", "available_factor_count"), ["signal_date", "symbol"]
    ).withColumnRenamed("raw", "composite")


_WIDE = " ".join(f"{n}:f z_{n}:f" for n in [*NAMES, "pit_composite"])


@query(
    "R17_factor_panel",
    f"signal_date:d symbol:i industry_code:s universe_size:i available_factor_count:i log_total_market_value:f {_WIDE} "
    "roe_quality_period_end:d roe_quality_available_date:d roe_quality_revision_sequence:i forward_return_21d:f forward_return_63d:f "
    "next_signal_date:d forward_return_next_signal:f",
    "SELECT r.*, s.* EXCLUDE (signal_date, symbol), f.period_end AS roe_quality_period_end, f.available_date AS roe_quality_available_date, "
    "f.revision_sequence AS roe_quality_revision_sequence FROM panel_rows r JOIN (SELECT signal_date, symbol, "
    + ", ".join(f"max(raw) FILTER (factor = '{n}') AS {n}, max(z) FILTER (factor = '{n}') AS z_{n}" for n in [*NAMES, "pit_composite"])
    + " FROM panel_scores GROUP BY 1, 2) s USING (signal_date, symbol) LEFT JOIN panel_facts f ON f.signal_date = r.signal_date AND f.symbol = r.symbol AND f.metric = 'roe_pct'",
)
def _(t):
    return factor_panel(t).wide()


@query(
    "R18_score_only_panel",
    "signal_date:d as_of_date:d symbol:i universe_size:i available_factor_count:i pit_composite:f z_pit_composite:f "
    "latest_fundamental_period_end:d latest_fundamental_available_date:d visible_fundamental_metric_count:i valuation_date:d",
    """SELECT s.signal_date, s.signal_date AS as_of_date, s.symbol, m.universe_size, c.available_factor_count, s.raw AS pit_composite, s.z AS z_pit_composite,
       l.pe AS latest_fundamental_period_end, l.ad AS latest_fundamental_available_date, l.n AS visible_fundamental_metric_count, v.date AS valuation_date
       FROM panel_scores s JOIN panel_members m USING (signal_date, symbol) JOIN panel_mean c USING (signal_date, symbol)
       LEFT JOIN (SELECT signal_date, symbol, max(period_end) AS pe, max(available_date) AS ad, count(DISTINCT metric) AS n FROM panel_facts GROUP BY 1, 2) l USING (signal_date, symbol)
       LEFT JOIN panel_vals v USING (signal_date, symbol) WHERE s.factor = 'pit_composite'""",
)
def _(t):
    # a bundle has scored these dates for its factor panel
    return build_score_panel(
        scored=None if t.parts is None else panels(t)[1], calendar=t.calendar, membership=t.membership, facts=t.facts, valuations=t.valuations, names=NAMES, minimum_factors=4, valuation_age=45
    )


@query(
    "R20_factor_coverage",
    "signal_date:d factor:s universe_size:i raw_valid_observations:i raw_coverage:f valid_observations:i coverage:f",
    """SELECT signal_date, factor, max(universe_size) AS universe_size, count(raw) AS raw_valid_observations, count(raw) / max(universe_size) AS raw_coverage,
       count(z) AS valid_observations, count(z) / max(universe_size) AS coverage FROM panel_long GROUP BY 1, 2""",
)
def _(t):
    return diagnostic(t, "coverage")


@query("R21_rank_ic", "signal_date:d factor:s horizon_days:i observations:i spearman_ic:f", "SELECT * FROM ic_rows")
def _(t):
    return diagnostic(t, "rank_ic")


@query(
    "R22_ic_summary",
    "factor:s horizon_days:i valid_periods:i mean_ic:f median_ic:f ic_std:f ic_ir:f ic_t_stat:f positive_ic_ratio:f",
    "SELECT * FROM ic_summary",
)
def _(t):
    return dx.summarise_ic(diagnostic(t, "rank_ic"))


@query(
    "R23_quantile_returns",
    "signal_date:d factor:s horizon_days:i quantile:i observations:i mean_forward_return:f median_forward_return:f",
    "SELECT * FROM quantile_rows",
)
def _(t):
    return diagnostic(t, "quantile_returns")


@query(
    "R24_quantile_summary",
    "factor:s horizon_days:i valid_spread_periods:i bottom_quantile_mean_return:f top_quantile_mean_return:f top_minus_bottom_mean_return:f positive_spread_ratio:f",
    "SELECT * FROM quantile_summary",
)
def _(t):
    return dx.summarise_quantiles(diagnostic(t, "quantile_returns"), 5)


@query(
    "R25_factor_exposures",
    "signal_date:d factor:s observations:i industries:i size_spearman:f industry_r_squared:f maximum_absolute_industry_mean_z:f",
    "SELECT * FROM exposure_rows",
)
def _(t):
    return diagnostic(t, "exposures")


@query(
    "R25_exposure_summary",
    "factor:s periods:i median_size_spearman:f median_absolute_size_spearman:f maximum_absolute_size_spearman:f median_industry_r_squared:f maximum_industry_r_squared:f",
    "SELECT * FROM exposure_summary",
)
def _(t):
    return dx.summarise_exposures(diagnostic(t, "exposures"))


_EV = "valid_ic_periods:i mean_ic:f positive_ic_ratio:f valid_spread_periods:i top_minus_bottom_mean_return:f"


@query(
    "R26_score_evidence",
    f"factor:s horizon_days:i {_EV}",
    evidence_sql("SELECT *, z AS score FROM panel_h", "factor, horizon_days"),
)
def _(t):
    long = dx.horizons_long(long_panel(t), [21, 63], ["signal_date", "symbol", "factor", "z"]).withColumnRenamed("z", "score")
    return dx.score_evidence(long, ["factor", "horizon_days"], 5, MIN_OBS)


_CASES = ", ".join(["('full', '', 9, 5)"] + [f"('without_{n}', '{n}', 8, 4)" for n in NAMES])


@query(
    "R27_leave_one_out_ablation",
    f"variant:s removed_factor:s included_factor_count:i minimum_available_factor_count:i horizon_days:i {_EV}",
    evidence_sql(
        f"""SELECT a.* EXCLUDE (n, mean), h.h AS horizon_days, CASE WHEN n >= minimum_available_factor_count THEN mean END AS score,
        CASE h.h WHEN 21 THEN r.forward_return_21d ELSE r.forward_return_63d END AS ret FROM (
        SELECT v.variant, v.removed_factor, v.included_factor_count, v.minimum_available_factor_count, s.signal_date, s.symbol,
        count(s.z) FILTER (s.factor <> v.removed_factor) AS n, avg(s.z) FILTER (s.factor <> v.removed_factor) AS mean
        FROM panel_z s, (VALUES {_CASES}) v(variant, removed_factor, included_factor_count, minimum_available_factor_count) GROUP BY 1, 2, 3, 4, 5, 6) a
        JOIN panel_rows r USING (signal_date, symbol), (VALUES (21), (63)) h(h)""",
        "variant, removed_factor, included_factor_count, minimum_available_factor_count, horizon_days",
    ),
)
def _(t):
    p = factor_panel(t)
    return dx.ablation(p.scores, p.rows, NAMES, [21, 63], 5, MIN_OBS)


@query(
    "R28_rolling_validation",
    f"window_no:i train_start:d train_end:d test_start:d test_end:d horizon_days:i {_EV}",
    "SELECT * FROM rolling_rows",
)
def _(t):
    return diagnostic(t, "rolling").withColumnRenamed("window", "window_no")


@query(
    "R29_cost_stress",
    "signal_date:d factor:s cost_bps_per_traded_side:f holdings:i realized_outcomes:i outcome_coverage:f two_sided_weight_turnover:f gross_return:f estimated_cost:f net_return:f",
    "SELECT * FROM cost_rows",
)
def _(t):
    return diagnostic(t, "cost_stress")


@query(
    "R30_cost_summary",
    "factor:s cost_bps_per_traded_side:f periods:i average_outcome_coverage:f minimum_outcome_coverage:f average_two_sided_weight_turnover:f "
    "gross_annualized_return:g net_annualized_return:g net_maximum_drawdown:f",
    "SELECT * FROM cost_summary",
)
def _(t):
    return dx.summarise_costs(diagnostic(t, "cost_stress"))


_GATE_VALUES = """SELECT (SELECT count(DISTINCT signal_date) FROM panel_rows) AS signal_dates,
    (SELECT median(c) FROM (SELECT count(z) / max(universe_size) AS c FROM panel_long WHERE factor = 'pit_composite' GROUP BY signal_date)) AS median_coverage,
    i.mean_ic, i.positive_ic_ratio, q.top_minus_bottom_mean_return, (SELECT avg((mean_ic > 0)::INT) FROM rolling_rows WHERE horizon_days = 21) AS positive_rolling_window_ratio,
    e.median_absolute_size_spearman, e.median_industry_r_squared, c.net_annualized_return AS maximum_cost_net_annualized_return, c.minimum_outcome_coverage AS minimum_cost_outcome_coverage
    FROM ic_summary i, quantile_summary q, exposure_summary e, cost_summary c WHERE i.factor = 'pit_composite' AND i.horizon_days = 21 AND q.factor = 'pit_composite'
    AND q.horizon_days = 21 AND e.factor = 'pit_composite' AND c.factor = 'pit_composite' AND c.cost_bps_per_traded_side = 20"""
_OPS = {"ge": ">=", "gt": ">", "le": "<="}


@query(
    "R31_factor_governance",
    "check_name:s value:g threshold:f passed:b all_passed:b decision:s",
    f"WITH v AS ({_GATE_VALUES}), c AS ("
    + " UNION ALL ".join(
        f"SELECT '{n}' AS check_name, {col}::DOUBLE AS value, {th} AS threshold, coalesce({col} {_OPS[op]} {th}, false) AS passed FROM v"
        for n, col, op, th in governance.FACTOR_CHECKS
    )
    + ") SELECT *, bool_and(passed) OVER () AS all_passed, CASE WHEN bool_and(passed) OVER () THEN 'eligible_for_manual_candidate_review' ELSE 'insufficient_consistent_evidence' END AS decision FROM c",
)
def _(t):
    if t.parts is not None:
        comp = lambda name: diagnostic(t, name).where(F.col("factor") == factors.COMPOSITE)
        ev = governance.factor_evidence(
            comp("coverage"), dx.summarise_ic(comp("rank_ic").where("horizon_days = 21")), dx.summarise_quantiles(comp("quantile_returns").where("horizon_days = 21"), 5),
            dx.summarise_exposures(comp("exposures")), diagnostic(t, "rolling"), dx.summarise_costs(comp("cost_stress").where("cost_bps_per_traded_side = 20")), 21, 20.0,
        )
        return governance.factor_governance(ev, True)
    comp = long_panel(t).where(F.col("factor") == factors.COMPOSITE)
    ev = governance.factor_evidence(
        dx.coverage(comp), dx.summarise_ic(dx.rank_ic(comp, [21], MIN_OBS)),
        dx.summarise_quantiles(dx.quantile_returns(comp, [21], 5), 5), dx.summarise_exposures(dx.exposures(comp)),
        dx.rolling_validation(comp, [21], 2, 1, 5, MIN_OBS), dx.summarise_costs(dx.cost_stress(comp, 5, [20.0])), 21, 20.0,
    )
    return governance.factor_governance(ev, True)
