"""As-of, snapshot and interval joins built from equi joins and windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_backward(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    left_date: str,
    right_date: str,
    values: Sequence[str],
    strict: bool = False,
    bounded_left: bool = False,
    bounded_right: bool = False,
) -> DataFrame:
    """Each left row takes the latest right row of its key dated on or before it.

    Both sides are laid on one time axis and the last right row is carried forward, so
    the join is one shuffle and one sort.  The right side is first reduced to one row
    per (key, date) and the left side to its distinct (key, date) pairs: a key's window
    then holds at most two rows per calendar day, whatever share of the data it has.
    ``bounded_left`` says the left side already has a bounded number of rows per
    (key, date), like bars do; its rows then ride along in the one shuffle.  ``bounded_right``
    says the same of the right side: it is not reduced in a shuffle of its own, the largest of equal dates is last on the axis.
    """
    on = list(on)
    hit = F.struct(F.col(right_date).alias("_matched"), *values)
    if bounded_right:
        facts = right.select(*on, F.col(right_date).alias("_t"), hit.alias("_hit"))
    else:
        facts = right.groupBy(*on, F.col(right_date).alias("_t")).agg(F.max(hit).alias("_hit"))
    facts = facts.select(*on, "_t", F.lit(1 if strict else 0).alias("_side"), "_hit")
    hit_type = facts.schema["_hit"].dataType
    matched = F.col("_hit._matched").alias(f"matched_{right_date}")
    taken = [F.col(f"_hit.{v}").alias(v) for v in values]
    order = ["_t", "_side", "_hit"] if bounded_right else ["_t", "_side"]
    if bounded_left:
        rows = left.select(
            *on, F.col(left_date).alias("_t"), F.lit(0 if strict else 1).alias("_side"),
            F.lit(None).cast(hit_type).alias("_hit"), F.struct(*left.columns).alias("_row"),
        )
        row_type = rows.schema["_row"].dataType
        axis = facts.withColumn("_row", F.lit(None).cast(row_type)).unionByName(rows)
        w = Window.partitionBy(*on).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        carried = axis.withColumn("_hit", F.last("_hit", ignorenulls=True).over(w)).where(F.col("_row").isNotNull())
        return carried.select("_row.*", matched, *taken)
    probes = left.select(*on, F.col(left_date).alias("_t")).distinct()
    probes = probes.select(
        *on, "_t", F.lit(0 if strict else 1).alias("_side"), F.lit(None).cast(hit_type).alias("_hit")
    )
    w = (
        Window.partitionBy(*on)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    carried = facts.unionByName(probes).withColumn("_hit", F.last("_hit", ignorenulls=True).over(w))
    found = carried.where(F.col("_side") == (0 if strict else 1)).select(
        *on, F.col("_t").alias(left_date), "_hit"
    )
    return left.join(found, [*on, left_date], "left").select(
        *[F.col(c) for c in left.columns],
        matched,
        *taken,
    )


def value_runs(df: DataFrame, on: Sequence[str], date: str, values: Sequence[str], missing: bool = False) -> DataFrame:
    """Runs [valid_from, valid_until) of the latest row of a key: (on, matched_<date>, values).

    ``valid_until`` is null while nothing follows.  With ``missing`` a key also has the run of nulls
    before its first row, from null on.  A key has at most one row per date, so its window is bounded.
    """
    on = list(on)
    daily = df.groupBy(*on, F.col(date).alias("valid_from")).agg(F.max(F.struct(*values)).alias("_v"))
    order = Window.partitionBy(*on).orderBy("valid_from")
    runs = daily.withColumn("valid_until", F.lead("valid_from").over(order)).withColumn("_first", F.lag("valid_from").over(order).isNull())
    run = lambda begin, end, matched, value: F.struct(
        begin.alias("valid_from"), end.alias("valid_until"), matched.alias("matched"), value.alias("_v")
    )
    begin, end, value = F.col("valid_from"), F.col("valid_until"), F.col("_v")
    seen = F.array(run(begin, end, begin, value))
    if missing:
        none = lambda c: F.when(F.lit(False), c)
        seen = F.when(F.col("_first"), F.array(run(none(begin), begin, none(begin), none(value)), run(begin, end, begin, value))).otherwise(seen)
    return runs.select(*on, F.explode(seen).alias("_r")).select(
        *on, "_r.valid_from", "_r.valid_until", F.col("_r.matched").alias(f"matched_{date}"), *[F.col(f"_r._v.{v}").alias(v) for v in values]
    )


def on_dates(runs: DataFrame, dates: DataFrame, date: str = "signal_date") -> DataFrame:
    """One row per run [valid_from, valid_until) and date in it; open ends are null.

    The dates (at most one per calendar day) are numbered; a table of one row per calendar day says
    which number comes next and which came last, so a run finds its first and last number by equality
    and expands in place.  Nothing is paired that is not in the result.
    """
    asked = dates.select(F.col(date).cast("date").alias("_d")).where("_d IS NOT NULL").distinct()
    first, last = asked.agg(F.min("_d"), F.max("_d")).first()
    if first is None:
        return runs.where(F.lit(False)).withColumn(date, F.lit(None).cast("date")).drop("valid_from", "valid_until")
    order = Window.orderBy("_d")  # one row per signal date
    numbered = asked.select("_d", F.row_number().over(order).alias("_k"), F.lag("_d").over(order).alias("_p"))
    days = numbered.select("_k", "_d", F.explode(F.sequence(F.coalesce(F.date_add("_p", 1), F.col("_d")), F.col("_d"))).alias("_day"))
    next_of = F.broadcast(days.select(F.col("_day").alias("_a"), F.col("_k").alias("_from")))
    last_of = F.broadcast(days.select(F.col("_day").alias("_b"), F.when(F.col("_day") == F.col("_d"), F.col("_k")).otherwise(F.col("_k") - 1).alias("_to")))
    bounded = runs.withColumns({
        "_a": F.greatest(F.col("valid_from"), F.lit(first)), "_b": F.least(F.date_sub("valid_until", 1), F.lit(last)),
    }).where("_a <= _b")
    numbers = bounded.join(next_of, "_a").join(last_of, "_b").where("_from <= _to").withColumn("_k", F.explode(F.sequence("_from", "_to")))
    found = numbers.join(F.broadcast(numbered.select("_k", F.col("_d").alias(date))), "_k")
    return found.drop("_k", "_a", "_b", "_from", "_to", "valid_from", "valid_until")


def latest_snapshot(signals: DataFrame, membership: DataFrame, date: str = "signal_date") -> DataFrame:
    """All members of the latest snapshot on or before each signal date.

    Only the two date lists are matched, by carrying the last snapshot date forward (at
    most two rows per calendar day in that one window); members then join by equality.
    """
    snaps = membership.select(F.col("date").alias("_t")).distinct().withColumn("snapshot_date", F.col("_t"))
    asked = signals.select(F.col(date).alias("_t")).distinct().withColumn("snapshot_date", F.lit(None).cast("date"))
    axis = snaps.withColumn("_side", F.lit(0)).unionByName(asked.withColumn("_side", F.lit(1)))
    w = Window.orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    pick = axis.withColumn("snapshot_date", F.last("snapshot_date", ignorenulls=True).over(w)).where(F.col("_side") == 1)
    pick = pick.select(F.col("_t").alias(date), "snapshot_date")
    members = membership.withColumnRenamed("date", "snapshot_date")
    return members.join(F.broadcast(pick), "snapshot_date")


def interval_lookup(
    left: DataFrame,
    intervals: DataFrame,
    on: Sequence[str],
    date: str,
    start: str,
    stop: str,
    values: Sequence[str],
    order: Sequence[Column],
    keys: Sequence[str],
    closed: bool = True,
    default: dict[str, object] | None = None,
) -> DataFrame:
    """The interval of the same key that covers the date; the last in ``order`` wins.

    Null ``stop`` is open-ended.  ``closed`` includes the stop date.  ``order`` sorts
    ascending and must be total over overlapping intervals.  ``keys`` identifies a left
    row.  The winner is a max over a struct, so overlapping intervals are combined
    before the shuffle.
    """
    end = F.col(f"_i.{stop}")
    upper = (F.col(f"_l.{date}") <= end) if closed else (F.col(f"_l.{date}") < end)
    covers = (F.col(f"_i.{start}") <= F.col(f"_l.{date}")) & (end.isNull() | upper)
    same = [F.col(f"_l.{k}") == F.col(f"_i.{k}") for k in on]
    cond = covers
    for s in same:
        cond = cond & s
    ranked = intervals.withColumn("_order", F.struct(*order)).alias("_i")
    joined = left.alias("_l").join(ranked, cond, "left")
    rest = [c for c in left.columns if c not in keys]
    picked = joined.groupBy(*[F.col(f"_l.{k}").alias(k) for k in keys]).agg(
        F.first(F.struct(*[F.col(f"_l.{c}").alias(c) for c in rest], F.lit(1).alias("_one"))).alias("_left"),
        F.max_by(F.struct(*[F.col(f"_i.{v}").alias(v) for v in values]), F.col("_i._order")).alias("_hit"),
    )
    default = default or {}
    return picked.select(
        *[F.col(c) if c in keys else F.col(f"_left.{c}").alias(c) for c in left.columns],
        *[
            (F.coalesce(F.col(f"_hit.{v}"), F.lit(default[v])) if v in default else F.col(f"_hit.{v}")).alias(v)
            for v in values
        ],
    )


def industry_at(left: DataFrame, industries: DataFrame, date: str = "signal_date", policy: str = "research") -> DataFrame:
    """Industry of a symbol on a date; UNKNOWN when no interval covers it.

    ``strategy`` breaks ties by (in_date, industry_code); ``research`` by (in_date,
    out_date with open intervals last, industry_code).
    """
    order = [F.col("in_date"), F.col("industry_code")]
    if policy == "research":
        # 9999-12-31 stands for "still open", which sorts after every real out_date
        order = [
            F.col("in_date"),
            F.coalesce(F.col("out_date"), F.lit("9999-12-31").cast("date")),
            F.col("industry_code"),
        ]
    return interval_lookup(
        left, industries, ["symbol"], date, "in_date", "out_date", ["industry_code", "industry_name"],
        order, ["symbol", date], default={"industry_code": "UNKNOWN", "industry_name": "UNKNOWN"},
    )


def members_on(signals: DataFrame, intervals: DataFrame, date: str = "signal_date") -> DataFrame:
    """Members of half-open [opt_in, opt_out) intervals on each date, one row per symbol.

    Each end of an interval is looked up in a natural-day -> signal-number map (bounded
    by the calendar); the signals between the two are then generated, so the work is
    the size of the answer and no range join is needed.
    """
    from tidemark.operators.calendar import availability_map, calendar

    sig = calendar(signals, date)
    day = availability_map(sig, 0).join(F.broadcast(sig.withColumnRenamed("date", "available_date")), "available_date")
    at = lambda c, out: day.select(F.col("_day").alias(c), F.col("ord").alias(out))
    ends = sig.agg(F.max("ord").alias("_m"), F.min("date").alias("_f"))
    # an end before the first signal counts as on it
    clip = lambda c: F.when(F.col(c).isNotNull(), F.greatest(F.col(c), F.col("_f")))
    span = intervals.crossJoin(F.broadcast(ends)).withColumns({"_in": clip("opt_in"), "_out": clip("opt_out")})  # one row
    span = span.join(at("_in", "_a"), "_in").join(at("_out", "_b"), "_out", "left")
    # open, or ending after the last signal: every later signal is covered
    span = span.withColumn("_b", F.coalesce(F.col("_b") - 1, F.col("_m")))
    rows = span.where(F.col("_a") <= F.col("_b")).select(
        "symbol", "opt_in", F.explode(F.sequence("_a", "_b")).alias("ord")
    )
    return (
        rows.join(F.broadcast(sig.withColumnRenamed("date", date)), "ord")
        .groupBy(date, "symbol")
        .agg(F.max("opt_in").alias("opt_in"))
    )


def overlapping(intervals: DataFrame, start: str, stop: str, inclusive: bool = False) -> DataFrame:
    """Intervals that touch [start, stop]; ``inclusive`` keeps those ending on ``start``."""
    s, e = F.lit(start).cast("date"), F.lit(stop).cast("date")
    tail = (F.col("opt_out") >= s) if inclusive else (F.col("opt_out") > s)
    return intervals.where((F.col("opt_in") <= e) & (F.col("opt_out").isNull() | tail))


def name_at(days: DataFrame, names: DataFrame) -> DataFrame:
    """Historical name per (symbol, date); a later input row overrides an earlier one.

    Null bounds are open on that side.
    """
    cond = (
        (F.col("d.symbol") == F.col("n.symbol"))
        & (F.col("n.start_date").isNull() | (F.col("n.start_date") <= F.col("d.date")))
        & (F.col("n.end_date").isNull() | (F.col("n.end_date") >= F.col("d.date")))
    )
    return (
        days.select("symbol", "date").distinct().alias("d")
        .join(names.alias("n"), cond, "left")
        .groupBy(F.col("d.symbol").alias("symbol"), F.col("d.date").alias("date"))
        .agg(F.max_by("n.name", "n.input_ord").alias("name"))
    )


def tier_on(df: DataFrame, tiers: DataFrame, date: str) -> DataFrame:
    """Attach the fee tier whose [start_date, end_date] covers the date.

    The tier table is a handful of dated rates.  It is resolved once per distinct date,
    which a calendar bounds, and then joined by equality.
    """
    days = df.select(date).distinct()
    hit = days.join(
        F.broadcast(tiers),
        (F.col(date) >= F.col("start_date"))
        & (F.col("end_date").isNull() | (F.col(date) <= F.col("end_date"))),
    ).drop("start_date", "end_date")
    return df.join(F.broadcast(hit), date, "left")


def covering_successor(stale: DataFrame, done: DataFrame, on: Sequence[str]) -> DataFrame:
    """For each stale range, whether a finished range of the same key contains it.

    A finished range qualifies when it starts no later and ends no earlier, so for a
    given start only the furthest end matters: the running maximum of ``stop`` over
    ``start`` answers every stale row with an as-of lookup instead of a pair join.
    """
    reach = done.groupBy(*on, F.col("start").alias("_s")).agg(F.max("stop").alias("_e"))
    w = Window.partitionBy(*on).orderBy("_s").rowsBetween(Window.unboundedPreceding, 0)
    reach = reach.withColumn("reach", F.max("_e").over(w))
    found = asof_backward(stale, reach, on, "start", "_s", ["reach"])
    return found.withColumn("covered", F.coalesce(F.col("reach") >= F.col("stop"), F.lit(False))).drop(
        "matched__s"
    )


def dense_grid(bars: DataFrame, cal: DataFrame, tail: int = 0) -> DataFrame:
    """Calendar rows per symbol between its first bar and its last bar plus ``tail`` days.

    Each symbol expands its own ordinal range, so no calendar x symbol product is built.
    """
    seen = bars.join(F.broadcast(cal), "date").groupBy("symbol").agg(
        F.min("ord").alias("_a"), F.max("ord").alias("_b")
    )
    span = seen.select("symbol", F.explode(F.sequence(F.col("_a"), F.col("_b") + tail)).alias("ord"))
    grid = span.join(F.broadcast(cal), "ord").select("symbol", "date", "ord")
    return grid.join(bars, ["symbol", "date"], "left")


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Keep the last row of each key in ``order`` (ascending, total).

    A max over (order, row) combines on the map side, so a key with very many rows
    never meets in one task.
    """
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)
