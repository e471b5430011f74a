"""The monthly factor panel: members, visible inputs, scores and forward labels."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.factors import COMPOSITE, FACTORS, VALUATION_INPUTS, factor_values, resolve
from tidemark.operators import asof, panel as labels, pit, select, xsec
from tidemark.operators.calendar import month_ends, schedule
from tidemark.session import stage


@dataclass(frozen=True)
class FactorPanel:
    """``rows`` has one row per (signal_date, symbol); ``scores`` one per factor as well.

    Scores stay long: every cross-sectional operator works per (signal_date, factor), so
    adding a factor adds rows rather than another pass.
    """

    rows: DataFrame
    scores: DataFrame
    lineage: DataFrame
    names: list[str]
    horizons: list[int]

    def with_scores(self) -> DataFrame:
        """Scores beside universe, industry, size and forward returns; joined and staged once for all diagnostics."""
        return self._joined

    @cached_property
    def _joined(self) -> DataFrame:
        keep = [c for c in self.rows.columns if c.startswith("forward_return_")]
        labels = self.rows.select("signal_date", "symbol", "universe_size", "industry_code", "log_total_market_value", *keep)
        return stage(self.scores.join(labels, ["signal_date", "symbol"]))

    def wide(self) -> DataFrame:
        """Raw and z columns per factor, with the revision each fundamental factor used."""
        pick = lambda f, c: F.max(F.when(F.col("factor") == f, F.col(c)))
        s = self.scores.groupBy("signal_date", "symbol").agg(
            *[pick(f, "raw").alias(f) for f in [*self.names, COMPOSITE]],
            *[pick(f, "z").alias(f"z_{f}") for f in [*self.names, COMPOSITE]],
        )
        funds = [n for n in self.names if FACTORS[n][1] not in VALUATION_INPUTS]
        lin = self.lineage.groupBy("signal_date", "symbol").agg(
            *[
                F.max(F.when(F.col("metric") == FACTORS[n][1], F.col(c))).alias(f"{n}_{c}")
                for n in funds
                for c in ("period_end", "available_date", "revision_sequence", "source_row_sha256")
            ]
        )
        return self.rows.join(s, ["signal_date", "symbol"], "left").join(lin, ["signal_date", "symbol"], "left")


def member_rows(signals: DataFrame, membership: DataFrame) -> DataFrame:
    """Members of each signal date with the size of their universe."""
    m = asof.latest_snapshot(signals, membership).select("signal_date", "symbol").distinct()
    size = m.groupBy("signal_date").agg(F.count(F.lit(1)).alias("universe_size"))
    return m.join(F.broadcast(size), "signal_date")  # one row per signal date


def visible_inputs(members: DataFrame, facts: DataFrame, vals: DataFrame, metrics: Sequence[str], fact_age: int | None, val_age: int | None) -> tuple[DataFrame, DataFrame]:
    """(members with their visible metrics and valuation as columns, the facts used)."""
    # read twice: as columns here and as lineage by the callers
    seen = stage(pit.facts_as_of(facts, members, fact_age, metrics=metrics))
    wide = seen.groupBy("signal_date", "symbol").agg(
        *[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in metrics]
    )
    v = pit.valuations_as_of(vals, members, val_age)
    key = ["signal_date", "symbol"]
    return members.join(wide, key, "left").join(v, key, "left"), seen


def score_rows(inputs: DataFrame, names: Sequence[str], minimum: int, q: float) -> DataFrame:
    """Long raw and z scores of every factor and of their equal-weight composite, both staged.

    Rows of the composite carry ``available_factor_count``; it is null on the others, which saves a join of the long table.
    """
    key = ["signal_date", "symbol"]
    cols = factor_values(inputs, names)
    long = inputs.select(*key, *[c.alias(n) for n, c in cols.items()]).unpivot(key, list(cols), "factor", "raw")
    z = xsec.winsorised_z(long, ["signal_date", "factor"], "raw", "z", q=q, minimum=3)
    z = stage(z)
    comp = select.mean_score(z, key, minimum, "raw").withColumn("factor", F.lit(COMPOSITE))
    comp = xsec.winsorised_z(comp, ["signal_date", "factor"], "raw", "z", q=q, minimum=3)
    return z.unionByName(stage(comp.select(*z.columns, "available_factor_count")), allowMissingColumns=True)


@dataclass(frozen=True)
class ScoredMembers:
    """Members of signal dates with their visible inputs and scores; dates do not touch each other, so any of them may be taken."""

    inputs: DataFrame
    scores: DataFrame
    used: DataFrame
    names: list[str]

    def at(self, signals: DataFrame) -> ScoredMembers:
        """What belongs to the given signal dates, at most one a month."""
        dates = F.broadcast(signals.select("signal_date"))
        only = lambda df: df.join(dates, "signal_date", "left_semi")
        return ScoredMembers(only(self.inputs), only(self.scores), only(self.used), self.names)


def score_members(
    signals: DataFrame, membership: DataFrame, facts: DataFrame, valuations: DataFrame, names: Sequence[str] | None = None,
    minimum_factors: int = 4, q: float = 0.05, fact_age: int | None = 550, valuation_age: int | None = 10,
) -> ScoredMembers:
    """Inputs and scores of the members of all signal dates, staged."""
    names = resolve(names)
    if not 1 <= minimum_factors <= len(names):
        raise ValueError("minimum_factors is out of range")
    if not 0 <= q < 0.5:
        raise ValueError("q must be in [0, 0.5)")
    members = stage(member_rows(signals, membership))
    metrics = sorted({FACTORS[n][1] for n in names if FACTORS[n][1] not in VALUATION_INPUTS})
    inputs, used = visible_inputs(members, facts, valuations, metrics, fact_age, valuation_age)
    inputs = stage(inputs)
    return ScoredMembers(inputs, score_rows(inputs, names, minimum_factors, q), used, names)


def build_factor_panel(
    *, calendar: DataFrame, membership: DataFrame, industries: DataFrame, market: DataFrame,
    facts: DataFrame, valuations: DataFrame, names: Sequence[str] | None = None,
    horizons: Sequence[int] = (21, 63), minimum_factors: int = 4, q: float = 0.05,
    fact_age: int | None = 550, valuation_age: int | None = 10, stale_days: int = 20,
    start: str | None = None, end: str | None = None, scored: ScoredMembers | None = None,
) -> FactorPanel:
    """All signal dates in one plan; nothing loops over months.

    The two result tables are materialised because every diagnostic reads them.  ``scored`` has been built with
    the same parameters for at least these signal dates.
    """
    horizons = sorted({int(h) for h in horizons})
    if not horizons or horizons[0] < 1:
        raise ValueError("horizons must be positive integers")
    if stale_days < 0:
        raise ValueError("stale_days must not be negative")
    every = month_ends(calendar, start, end)
    signals = month_ends(calendar, start, end, room=max(horizons))
    mine = scored.at(signals) if scored else score_members(signals, membership, facts, valuations, names, minimum_factors, q, fact_age, valuation_age)
    inputs, scores = mine.inputs, mine.scores
    key = ["signal_date", "symbol"]
    mv = F.col("total_market_value_10k_cny")
    base = asof.industry_at(
        inputs.select(*key, "universe_size", F.log(F.when(mv > 0, mv)).alias("log_total_market_value")), industries
    )
    counts = scores.where(F.col("factor") == COMPOSITE).select(*key, "available_factor_count")
    only = inputs.select(*key)
    # the probes were the members themselves, so the facts used need no further filter
    rows = base.join(counts, key, "left").join(labels.forward_labels(only, market, calendar, horizons, every, stale_days), key, "left")
    return FactorPanel(stage(rows), scores.drop("available_factor_count"), mine.used, mine.names, horizons)


def build_score_panel(
    *, calendar: DataFrame, membership: DataFrame, facts: DataFrame, valuations: DataFrame,
    names: Sequence[str] | None = None, minimum_factors: int = 4, q: float = 0.05,
    fact_age: int | None = 550, valuation_age: int | None = 10, start: str | None = None, end: str | None = None,
    scored: ScoredMembers | None = None,
) -> DataFrame:
    """Composite scores with lineage and no forward label anywhere in the plan; ``scored`` as in ``build_factor_panel``."""
    signals = schedule(calendar, start, end)
    mine = scored.at(signals) if scored else score_members(signals, membership, facts, valuations, names, minimum_factors, q, fact_age, valuation_age)
    inputs, used = mine.inputs, mine.used
    key = ["signal_date", "symbol"]
    scores = mine.scores.where(F.col("factor") == COMPOSITE)
    scores = scores.select(
        *key, "available_factor_count", F.col("raw").alias(COMPOSITE), F.col("z").alias(f"z_{COMPOSITE}")
    )
    lin = pit.fact_lineage(used)
    return (
        inputs.select(*key, "universe_size", "valuation_date", "valuation_available_date")
        .join(scores, key, "left")
        .join(lin, key, "left")
        .withColumn("as_of_date", F.col("signal_date"))
    )
