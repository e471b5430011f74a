"""From price features to ranked, neutralised monthly candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.factors import price_inputs, profile_weights
from tidemark.operators import asof, market, select, xsec

REQUIRED = [
    "mom_12_1", "mom_6_1", "fip_momentum", "trend", "volatility", "downside_volatility", "drawdown_quality",
    "avg_amount_20", "log_total_mv",
]
_KEY = ["signal_date", "symbol"]
# what candidates and scores read of a table of features
INPUTS = [*_KEY, "date", "close", "is_st", "history_days", "total_mv", *[c for c in REQUIRED if c != "log_total_mv"]]


def candidates(
    features: DataFrame, industries: DataFrame, min_history: int = 252, min_amount: float = 1e8,
    min_price: float = 3.0, trend_filter: bool = False, members: DataFrame | None = None, max_age_days: int | None = None,
) -> DataFrame:
    """Eligible rows of each signal date with their industry (strategy tie-break).

    ``members`` (signal_date, symbol; see ``asof.latest_snapshot``) keeps the index members of each date,
    ``max_age_days`` rows whose bar (``date``) is at most so many days older than their signal date; 0 asks for a bar
    on that very day.  Both come before everything that is ranked, so who is not a candidate moves no score.
    """
    f = features
    if max_age_days is not None:
        f = f.where(F.date_diff("signal_date", "date") <= max_age_days)
    if members is not None:
        f = f.join(members.select(*_KEY), _KEY, "left_semi")
    f = f.withColumn("log_total_mv", F.log(F.greatest("total_mv", F.lit(1e-12))))
    f = market.eligible(f, min_history, min_amount, min_price, trend_filter, REQUIRED)
    f = asof.industry_at(f, industries, policy="strategy")
    return f.where(F.col("industry_code") != "UNKNOWN")


def price_score(
    cands: DataFrame, weights: dict[str, float], q: float = 0.05
) -> tuple[DataFrame, DataFrame]:
    """(long z scores of every price input, weighted score per row)."""
    cols = price_inputs()
    long = cands.select(*_KEY, *[c.alias(n) for n, c in cols.items()]).unpivot(_KEY, list(cols), "factor", "raw")
    z = xsec.winsorised_z(long, ["signal_date", "factor"], "raw", "z", q, 2, "zero")
    return z, select.weighted_score(z, weights, _KEY, "score")


def scored_candidates(
    features: DataFrame, industries: DataFrame, profile: str = "legacy_v1_4", q: float = 0.05,
    strength: float = 1.0, **filters,
) -> DataFrame:
    """Candidates with the weighted score before and after neutralisation."""
    from tidemark.session import stage

    # windows below carry no column that nobody reads: rows of many columns make generated methods the JVM does not compile
    cands = stage(candidates(features.select(*INPUTS), industries, **filters))
    _, score = price_score(cands, profile_weights(profile), q)
    sized = xsec.winsorised_z(
        cands.select(*_KEY, "industry_code", "log_total_mv"), ["signal_date"], "log_total_mv", "z_size", q, 2, "zero"
    )
    joined = stage(sized.join(score.withColumnRenamed("score", "score_pre_neutral"), _KEY))
    return xsec.neutralise(joined, ["signal_date"], "score_pre_neutral", "industry_code", "z_size", strength, "score")


def monthly_top(features: DataFrame, industries: DataFrame, n: int = 20, digits: int | None = None, **options) -> DataFrame:
    """The n best neutralised scores of every signal date.

    With ``digits`` scores that agree to so many places rank as equal, by symbol.  Sole members of an industry all
    have a score of zero up to a last bit that depends on the order of sums; rounded, their ranks are the same in
    every run.
    """
    s = scored_candidates(features, industries, **options)
    best = F.col("score") if digits is None else F.round("score", digits) + F.lit(0.0)
    return select.top_n(s, ["signal_date"], [best.desc(), F.col("symbol")], n)
