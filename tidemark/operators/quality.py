"""Data-quality rules: each yields a violation count, evaluated in as few passes as possible."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rule_counts(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Violations per rule in one pass; each rule is a predicate that is true when broken."""
    names = list(rules)
    agg = df.agg(*[F.count_if(F.coalesce(rules[n], F.lit(False))).alias(f"r{i}") for i, n in enumerate(names)])
    each = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"r{i}").alias("violations")) for i, n in enumerate(names)])
    return agg.select(F.explode(each).alias("x")).select("x.rule", "x.violations")


def count_rule(name: str, broken: DataFrame) -> DataFrame:
    """A rule whose violations are the rows of a DataFrame (anti joins, group checks)."""
    return broken.agg(F.lit(name).alias("rule"), F.count(F.lit(1)).alias("violations"))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)


def require(report: DataFrame) -> None:
    """Strict mode: raise with the broken rules (the report has one row per rule)."""
    broken = report.where(F.col("violations") > 0).collect()
    if broken:
        raise ValueError("; ".join(f"{r['rule']}: {r['violations']}" for r in broken))


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    return sorted(set(required) - set(df.columns))


def _text_blank(c: str) -> Column:
    return F.col(c).isNull() | F.trim(F.col(c).cast("string")).isin("", "nan", "None")


def check_bars(bars: DataFrame, tolerance: float = 1e-8) -> DataFrame:
    """Numbers present and positive, OHLC consistent, volumes and limits sane: one pass."""
    num = ["open", "high", "low", "close", "prev_close", "volume", "amount", "adj_factor", "up_limit", "down_limit"]
    num = [c for c in num if c in bars.columns]
    pos = [c for c in num if c not in ("volume", "amount")]
    any_of = lambda cs: cs[0] if len(cs) == 1 else cs[0] | any_of(cs[1:])
    rules = {
        "bars_numeric_finite": any_of([F.col(c).isNull() | F.isnan(c) for c in num]),
        "bars_positive": any_of([F.coalesce(F.col(c) <= 0, F.lit(False)) for c in pos]),
        "bars_ohlc": (F.col("high") + tolerance < F.greatest("open", "close", "low"))
        | (F.col("low") - tolerance > F.least("open", "close", "high")),
        "bars_volume_amount": (F.col("volume") < 0) | (F.col("amount") < 0),
    }
    if "up_limit" in bars.columns:
        rules["bars_limits"] = F.col("up_limit") < F.col("down_limit")
    return rule_counts(bars, rules)


def check_index(index: DataFrame, name: str) -> DataFrame:
    c = F.col("close")
    return rule_counts(index, {f"{name}_close": c.isNull() | F.isnan(c) | (c <= 0)})


def check_actions(actions: DataFrame) -> DataFrame:
    return rule_counts(
        actions,
        {
            "actions_ex_date": F.col("ex_date").isNull(),
            "actions_ratios": (F.col("cash_dividend") < 0) | (F.col("stock_dividend") < 0),
        },
    )


def check_industries(intervals: DataFrame) -> DataFrame:
    return rule_counts(
        intervals,
        {
            "industry_in_date": F.col("in_date").isNull(),
            "industry_labels": _text_blank("industry_code") | _text_blank("industry_name"),
            "industry_order": F.col("out_date") < F.col("in_date"),
        },
    )


def check_references(members: DataFrame, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Members absent from each reference table."""
    m = members.select("symbol").distinct()
    out = None
    for name, df in tables.items():
        part = count_rule(f"members_in_{name}", m.join(df.select("symbol").distinct(), "symbol", "left_anti"))
        out = part if out is None else out.unionByName(part)
    return out


def uncovered_members(membership: DataFrame, intervals: DataFrame) -> DataFrame:
    """Membership dates of a symbol that no industry interval covers."""
    cond = (
        (F.col("m.symbol") == F.col("i.symbol"))
        & (F.col("i.in_date") <= F.col("m.date"))
        & (F.col("i.out_date").isNull() | (F.col("i.out_date") >= F.col("m.date")))
    )
    return membership.alias("m").join(intervals.alias("i"), cond, "left_anti").select("symbol", "date")


def small_snapshots(membership: DataFrame, minimum: int = 2) -> DataFrame:
    return membership.groupBy("date").agg(F.countDistinct("symbol").alias("n")).where(F.col("n") < minimum)


def calendar_containment(table: DataFrame, cal: DataFrame, name: str) -> DataFrame:
    """Rows off the calendar, and calendar days without a row."""
    have, want = table.select("date").distinct(), cal.select("date")
    return count_rule(f"{name}_off_calendar", have.join(F.broadcast(want), "date", "left_anti")).unionByName(
        count_rule(f"{name}_missing_days", want.join(have, "date", "left_anti"))
    )


def check_facts(facts: DataFrame, dictionary: DataFrame | None = None, symbol_rule: Column | None = None) -> DataFrame:
    """Dates, labels, values, revisions and hashes of bitemporal facts."""
    rules = {
        "facts_dates": F.col("period_end").isNull() | F.col("announcement_date").isNull() | F.col("available_date").isNull(),
        "facts_labels": _text_blank("symbol") | _text_blank("source") | _text_blank("metric") | _text_blank("unit"),
        "facts_period_after_announcement": F.col("period_end") > F.col("announcement_date"),
        "facts_value_finite": F.col("value").isNull() | F.isnan("value") | (F.abs("value") == float("inf")),
        "facts_revision": F.col("revision_sequence").isNull() | (F.col("revision_sequence") < 1),
        "facts_hash": ~F.col("source_row_sha256").rlike("^[0-9a-f]{64}$"),
    }
    if symbol_rule is not None:
        rules["facts_symbol"] = ~symbol_rule
    out = rule_counts(facts, rules)
    if dictionary is not None:
        known = dictionary.select("source", "metric", "unit").distinct()
        used = facts.select("source", "metric", "unit").distinct()
        out = out.unionByName(count_rule("facts_dictionary", used.join(F.broadcast(known), ["source", "metric", "unit"], "left_anti")))
    return out


FACT_KEY = ["symbol", "source", "metric", "period_end", "report_type", "company_type", "source_row_sha256"]


def check_unique(facts: DataFrame, vals: DataFrame) -> DataFrame:
    """Duplicate fact keys, duplicate valuations, and valuations that disagree with their copies."""
    cols = [c for c in vals.columns if c not in ("symbol", "date")]
    clash = vals.groupBy("symbol", "date").agg(F.countDistinct(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])).alias("v"))
    return (
        count_rule("facts_duplicate_key", duplicate_keys(facts, FACT_KEY))
        .unionByName(count_rule("valuations_duplicate_day", duplicate_keys(vals, ["symbol", "date"])))
        .unionByName(count_rule("valuations_conflicting_copies", clash.where(F.col("v") > 1)))
    )


def wrong_availability(df: DataFrame, cal: DataFrame, source: str, lag: int) -> DataFrame:
    """Rows whose stored availability differs from the one the calendar and lag give."""
    from tidemark.operators.calendar import with_availability

    again = with_availability(df, cal, source, lag, "_expected")
    return again.where(~F.col("available_date").eqNullSafe(F.col("_expected"))).drop("_expected")


def check_valuations(vals: DataFrame) -> DataFrame:
    cols = [c for c in vals.columns if c not in ("symbol", "date", "available_date")]
    mv = [c for c in cols if "market_value" in c]
    return rule_counts(
        vals,
        {
            "valuations_all_null": F.coalesce(*[F.col(c) for c in cols]).isNull(),
            "valuations_market_value": F.least(*[F.col(c) for c in mv]) <= 0,
        },
    )


def broken_revisions(facts: DataFrame) -> DataFrame:
    """Reports whose revision numbers are not exactly 1..n."""
    key = ["symbol", "source", "period_end", "report_type", "company_type"]
    rows = facts.select(*key, "source_row_sha256", "revision_sequence").distinct()
    return (
        rows.groupBy(*key)
        .agg(
            F.min("revision_sequence").alias("lo"), F.max("revision_sequence").alias("hi"),
            F.countDistinct("revision_sequence").alias("n"),
        )
        .where((F.col("lo") != 1) | (F.col("hi") != F.col("n")))
    )


FORBIDDEN_PREFIXES = ("forward_return", "outcome_date", "next_signal_date")


def check_score_panel(panel: DataFrame, score: str, maximum_factors: int) -> DataFrame:
    """A score panel may not carry labels, repeat a row, or hold anything later than its date."""
    labels = [c for c in panel.columns if c.startswith(FORBIDDEN_PREFIXES)]
    n, d = F.col("available_factor_count"), F.col("signal_date")
    dated = [c for c in panel.columns if c in (
        "as_of_date", "latest_fundamental_period_end", "latest_fundamental_available_date", "valuation_date", "valuation_available_date")]
    late = F.lit(False)
    for c in dated:
        late = late | F.coalesce(F.col(c) > d, F.lit(False))
    rules = {
        "panel_signal_date": d.isNull(),
        "panel_factor_count": n.isNull() | (n < 0) | (n > maximum_factors),
        "panel_score_finite": F.isnan(score) | (F.abs(score) == float("inf")),
        "panel_future_dates": late,
        "panel_as_of": ~F.col("as_of_date").eqNullSafe(d),
        "panel_forward_labels": F.lit(bool(labels)),
    }
    size = panel.groupBy("signal_date").agg(
        F.count(F.lit(1)).alias("n"), F.min("universe_size").alias("lo"), F.max("universe_size").alias("hi")
    )
    return (
        rule_counts(panel, rules)
        .unionByName(count_rule("panel_duplicate_rows", duplicate_keys(panel, ["signal_date", "symbol"])))
        .unionByName(count_rule("panel_universe_size", size.where((F.col("lo") != F.col("hi")) | (F.col("hi") != F.col("n")))))
    )


def snapshot_anomalies(membership: DataFrame, minimum: int = 250, share: float = 0.95) -> DataFrame:
    """Snapshots smaller than ``minimum`` or than a share of the median size."""
    from tidemark.operators.xsec import exact_quantiles

    sizes = membership.groupBy("date").agg(F.countDistinct("symbol").cast("double").alias("constituents")).withColumn("_k", F.lit(1))
    med = exact_quantiles(sizes, ["_k"], "constituents", [0.5], ["median"]).drop("n")
    return sizes.join(F.broadcast(med), "_k").drop("_k").where(
        (F.col("constituents") < minimum) | (F.col("constituents") < F.col("median") * share)
    )


def gate_table(gates: Mapping[str, DataFrame]) -> DataFrame:
    """Union of named gates; each input is a one-row (ok, detail)."""
    out = None
    for name, df in gates.items():
        part = df.select(F.lit(name).alias("gate"), "ok", "detail")
        out = part if out is None else out.unionByName(part)
    return out


def check_tiers(tiers: DataFrame) -> DataFrame:
    """Dated rate tiers must follow on from each other, ordered, with only the last open."""
    from pyspark.sql import Window

    w = Window.orderBy("start_date")  # a handful of tiers
    prev, nxt = F.lag("end_date").over(w), F.lead("start_date").over(w)
    first = F.row_number().over(w) == 1
    t = tiers.select(
        "*",
        (~first & ~F.coalesce(F.date_add(prev, 1) == F.col("start_date"), F.lit(False))).alias("_gap"),
        (nxt.isNotNull() & F.col("end_date").isNull()).alias("_open"),
    )
    return rule_counts(
        t,
        {
            "tiers_order": F.col("end_date") < F.col("start_date"),
            "tiers_contiguous": F.col("_gap"),
            "tiers_open_end_last": F.col("_open"),
            "tiers_rates": F.least("stamp_duty_sell", "transfer_fee_rate") < 0,
        },
    )


def quote_coverage(bars: DataFrame, intervals: DataFrame, signals: DataFrame, minimum: float) -> DataFrame:
    """Share of the members of each signal date that have a bar on it."""
    from tidemark.operators.asof import members_on

    m = members_on(signals, intervals).drop("opt_in")
    b = bars.select(F.col("date").alias("signal_date"), "symbol", F.lit(1).alias("_q"))
    return m.join(b, ["signal_date", "symbol"], "left").groupBy("signal_date").agg(
        F.count(F.lit(1)).alias("active_members"), F.count("_q").alias("quoted_active_members"),
        (F.count("_q") / F.count(F.lit(1))).alias("coverage"),
    ).withColumn("below_minimum", F.col("coverage") < minimum)


def time_slice_coverage(
    facts: DataFrame, vals: DataFrame, membership: DataFrame, signals: DataFrame, fact_age: int, val_age: int, minimum: float
) -> DataFrame:
    """Share of active members with a fact and a valuation visible recently enough, per audit date.

    Age counts from availability here, not from the period's end.
    """
    from tidemark.operators.asof import asof_backward, latest_snapshot

    active = latest_snapshot(signals, membership).select("signal_date", "symbol").distinct()
    latest = lambda df, out: df.select("symbol", F.col("available_date").alias(out)).distinct().withColumn("_x", F.lit(1))
    f = asof_backward(active, latest(facts, "fa"), ["symbol"], "signal_date", "fa", ["_x"], bounded_left=True).drop("_x")
    both = asof_backward(f, latest(vals, "va"), ["symbol"], "signal_date", "va", ["_x"], bounded_left=True)
    seen = lambda c, age: F.coalesce(F.datediff("signal_date", c) <= age, F.lit(False)).cast("long")
    n = F.count(F.lit(1))
    return both.groupBy("signal_date").agg(
        n.alias("active_symbols"),
        F.sum(seen("matched_fa", fact_age)).alias("fundamental_symbols"),
        F.sum(seen("matched_va", val_age)).alias("valuation_symbols"),
    ).select(
        "*",
        (F.col("fundamental_symbols") / F.col("active_symbols")).alias("fundamental_coverage"),
        (F.col("valuation_symbols") / F.col("active_symbols")).alias("valuation_coverage"),
    ).withColumn("below_minimum", F.least("fundamental_coverage", "valuation_coverage") < minimum)


def range_usable(bars: DataFrame, membership: DataFrame, start: str, stop: str, lead_days: int = 400, tail_days: int = 10, slack: int = 10) -> DataFrame:
    """Does each symbol's cached range reach what its membership dates need?"""
    have = bars.groupBy("symbol").agg(
        F.min("date").alias("first_bar"), F.max("date").alias("last_bar"), F.count_if(F.col("total_mv").isNull()).alias("_gaps")
    )
    need = membership.groupBy("symbol").agg(F.min("date").alias("_a"), F.max("date").alias("_b")).select(
        "symbol",
        F.greatest(F.lit(start).cast("date"), F.date_sub("_a", lead_days)).alias("first_needed"),
        F.least(F.lit(stop).cast("date"), F.date_add("_b", tail_days)).alias("last_needed"),
    )
    ok = (
        (F.col("_gaps") == 0)
        & (F.col("first_bar") <= F.date_add("first_needed", slack))
        & (F.col("last_bar") >= F.date_sub("last_needed", slack))
    )
    return need.join(have, "symbol", "left").withColumn("usable", F.coalesce(ok, F.lit(False))).drop("_gaps")
