"""Forward labels on a dense trading-day grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.asof import asof_backward


def _price_at(
    rows: DataFrame, market: DataFrame, cal: DataFrame, date: str, stale: int, out: str, price: str = "total_close"
) -> DataFrame:
    """Price of each (symbol, date) carried forward at most ``stale`` trading days.

    An as-of join plus an ordinal difference gives what a forward fill on the
    calendar x symbols grid would, without building the grid.
    """
    priced = market.where(F.col(price).isNotNull()).select(
        "symbol", F.col("date").alias("_bar"), F.col(price).alias(out)
    )
    # at most one row per symbol, day and horizon offset; bars have one row per symbol and day
    got = asof_backward(rows, priced, ["symbol"], date, "_bar", [out], bounded_left=True, bounded_right=True)
    # both ordinals come from the calendar, which holds at most one row per day
    at = cal.select(F.col("date").alias(date), F.col("ord").alias("_o1"))
    of = cal.select(F.col("date").alias("matched__bar"), F.col("ord").alias("_o2"))
    got = got.join(F.broadcast(at), date, "left").join(F.broadcast(of), "matched__bar", "left")
    fresh = F.col("_o1") - F.col("_o2") <= stale
    return got.withColumn(out, F.when(fresh, F.col(out))).drop("_o1", "_o2", "matched__bar")


def forward_returns(
    members: DataFrame, market: DataFrame, cal: DataFrame, horizons: Sequence[int], stale: int = 20
) -> DataFrame:
    """Return from each signal date to the h-th trading day after it, per horizon.

    All start and end prices are looked up in one as-of pass: the wanted
    (symbol, date) pairs of every horizon are exploded first.
    """
    if min(horizons) < 1:
        raise ValueError("horizons must be positive")
    offsets = [0, *horizons]
    days = cal.select(F.col("date").alias("signal_date"), F.col("ord").alias("_o"))
    later = cal.select(F.col("date").alias("_at"), F.col("ord").alias("_q"))
    wanted = (
        members.join(F.broadcast(days), "signal_date")
        .withColumn("_h", F.explode(F.array(*[F.lit(h) for h in offsets])))
        .withColumn("_q", F.col("_o") + F.col("_h"))
        .join(F.broadcast(later), "_q")
        .select("signal_date", "symbol", "_h", "_at")
    )
    got = _price_at(wanted, market, cal, "_at", stale, "_p")
    pick = lambda h, c: F.max(F.when(F.col("_h") == h, F.col(c)))
    wide = got.groupBy("signal_date", "symbol").agg(
        pick(0, "_p").alias("_p0"),
        *[pick(h, "_p").alias(f"_p{h}") for h in horizons],
        *[pick(h, "_at").alias(f"outcome_date_{h}d") for h in horizons],
    )
    return wide.select(
        "signal_date", "symbol",
        *[(F.try_divide(F.col(f"_p{h}"), F.col("_p0")) - 1).alias(f"forward_return_{h}d") for h in horizons],
        *[f"outcome_date_{h}d" for h in horizons],
    )


def next_signal_return(
    members: DataFrame, market: DataFrame, cal: DataFrame, signals: DataFrame, stale: int = 20
) -> DataFrame:
    """Return from each signal date to the following one; null on the last."""
    order = Window.orderBy("signal_date")  # one row per month
    steps = signals.select("signal_date", F.lead("signal_date").over(order).alias("next_signal_date"))
    m = members.join(F.broadcast(steps), "signal_date")
    both = m.select(
        "signal_date", "next_signal_date", "symbol",
        F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("signal_date").alias("_at")),
                          F.struct(F.lit(1).alias("k"), F.col("next_signal_date").alias("_at")))).alias("x"),
    ).select("signal_date", "next_signal_date", "symbol", "x.k", "x._at")
    got = _price_at(both, market, cal, "_at", stale, "_p")
    return got.groupBy("signal_date", "symbol").agg(
        F.max("next_signal_date").alias("next_signal_date"),
        (F.try_divide(F.max(F.when(F.col("k") == 1, F.col("_p"))), F.max(F.when(F.col("k") == 0, F.col("_p")))) - 1).alias(
            "forward_return_next_signal"
        ),
    )


def forward_labels(
    members: DataFrame, market: DataFrame, cal: DataFrame, horizons: Sequence[int], signals: DataFrame, stale: int = 20
) -> DataFrame:
    """``forward_returns`` and ``next_signal_return`` of the same rows, all prices looked up in one pass over the bars."""
    if min(horizons) < 1:
        raise ValueError("horizons must be positive")
    # one row per signal date and price wanted: a place in the calendar, or the next signal date (-1)
    days = cal.select(F.col("date").alias("signal_date"), F.col("ord").alias("_o"))
    later = cal.select(F.col("date").alias("_at"), F.col("ord").alias("_q"))
    order = Window.orderBy("signal_date")  # one row per month
    steps = signals.select("signal_date", F.lead("signal_date").over(order).alias("next_signal_date"))
    ahead = steps.join(F.broadcast(days), "signal_date").withColumn("_h", F.explode(F.array(*[F.lit(h) for h in [0, *horizons]])))
    ahead = ahead.withColumn("_q", F.col("_o") + F.col("_h")).join(F.broadcast(later), "_q").select("signal_date", "next_signal_date", "_h", "_at")
    asked = ahead.unionByName(steps.select("signal_date", "next_signal_date", F.lit(-1).alias("_h"), F.col("next_signal_date").alias("_at")))
    got = _price_at(members.join(F.broadcast(asked), "signal_date"), market, cal, "_at", stale, "_p")
    pick = lambda h, c: F.max(F.when(F.col("_h") == h, F.col(c)))
    wide = got.groupBy("signal_date", "symbol").agg(
        F.max("next_signal_date").alias("next_signal_date"), pick(0, "_p").alias("_p0"),
        *[pick(h, "_p").alias(f"_p{h}") for h in horizons], pick(-1, "_p").alias("_pn"),
        *[pick(h, "_at").alias(f"outcome_date_{h}d") for h in horizons],
    )
    ahead_of = lambda c: F.try_divide(F.col(c), F.col("_p0")) - 1
    return wide.select(
        "signal_date", "symbol", *[ahead_of(f"_p{h}").alias(f"forward_return_{h}d") for h in horizons],
        *[f"outcome_date_{h}d" for h in horizons], "next_signal_date", ahead_of("_pn").alias("forward_return_next_signal"),
    )
