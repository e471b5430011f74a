"""Trading calendar, availability dates and signal dates.

A calendar holds one row per trading day (a few hundred a year), which is what makes it
safe to sort in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _by_date():
    return Window.orderBy("date")


def calendar(dates: DataFrame, col: str = "date") -> DataFrame:
    """Distinct trading days with their 1-based ordinal."""
    days = dates.select(F.col(col).cast("date").alias("date")).where("date IS NOT NULL").distinct()
    return days.select("date", F.row_number().over(_by_date()).cast("long").alias("ord"))


def availability_map(cal: DataFrame, lag: int) -> DataFrame:
    """Every natural day from the first trading day on -> first usable trading day.

    Lag 0 is the first trading day on or after the date, lag k the k-th strictly after.
    Each trading day owns the run of natural days that resolve to it, so the lookup is an
    equi join rather than a range join.
    """
    if lag < 0:
        raise ValueError("lag must not be negative")
    if lag == 0:
        before = F.lag("date").over(_by_date())
        owners = cal.select("date", F.coalesce(F.date_add(before, 1), "date").alias("_first"), F.col("date").alias("_last"))
    else:
        owners = cal.select("date", F.lag("date", lag).over(_by_date()).alias("_first"), F.date_sub(F.lag("date", lag - 1).over(_by_date()) if lag > 1 else F.col("date"), 1).alias("_last"))
        owners = owners.where(F.col("_first").isNotNull())
    return owners.select(
        F.explode(F.sequence("_first", "_last")).alias("_day"), F.col("date").alias("available_date")
    )


def with_availability(
    df: DataFrame, cal: DataFrame, source: str, lag: int, out: str = "available_date"
) -> DataFrame:
    """Attach the first date a value known on ``source`` may be used; off the end is null.

    A source date of any age counts: before the calendar begins, the first trading day is
    the first that follows.
    """
    days = availability_map(cal, lag).withColumnRenamed("available_date", out)
    opening = cal.agg(F.min("date").alias("_opens"), F.min(F.when(F.col("ord") == max(lag, 1), F.col("date"))).alias("_early"))
    found = df.withColumn("_day", F.col(source)).join(days, "_day", "left").join(F.broadcast(opening), how="cross")  # one row
    early = F.when(F.col("_day") < F.col("_opens"), F.col("_early")).otherwise(F.col(out))
    return found.withColumn(out, early).drop("_day", "_opens", "_early")


def month_ends(
    cal: DataFrame, start: str | None = None, end: str | None = None, room: int = 0
) -> DataFrame:
    """Last trading day of each month in range, with at least ``room`` days left after it."""
    inside = cal
    if start:
        inside = inside.where(F.col("date") >= F.lit(start).cast("date"))
    if end:
        inside = inside.where(F.col("date") <= F.lit(end).cast("date"))
    ends = inside.groupBy(F.trunc("date", "MM").alias("month")).agg(
        F.max_by(F.struct("date", "ord"), "date").alias("_s")
    )
    ends = ends.select("month", F.col("_s.date").alias("signal_date"), F.col("_s.ord").alias("ord"))
    if room == 0:
        return ends
    reachable = cal.select((F.col("ord") - room).alias("ord"))
    return ends.join(F.broadcast(reachable), "ord", "left_semi").select("month", "signal_date", "ord")


def schedule(cal: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Month-end signal date -> next trading day, dropped when that day is past the range."""
    nxt = cal.select(F.col("date").alias("execution_date"), (F.col("ord") - 1).alias("ord"))
    out = month_ends(cal, start, end).join(F.broadcast(nxt), "ord")
    if end:
        out = out.where(F.col("execution_date") <= F.lit(end).cast("date"))
    return out.select("signal_date", "execution_date")


def period_spine(df: DataFrame, start: str, stop: str, unit: str) -> DataFrame:
    """Explode each row's [start, stop] into the months, quarters or years covering it, clipped."""
    months = {"month": 1, "quarter": 3, "year": 12}[unit]
    first = F.date_trunc(unit, F.col(start)).cast("date")
    return (
        df.withColumn("_p", F.explode(F.sequence(first, F.col(stop), F.expr(f"interval {months} month"))))
        .withColumn("period_start", F.greatest(F.col("_p"), F.col(start)))
        .withColumn("period_stop", F.least(F.date_sub(F.add_months("_p", months), 1), F.col(stop)))
        .drop("_p")
    )


def date_gaps(df: DataFrame, max_days: int, col: str = "date", by: Sequence[str] = ()) -> DataFrame:
    """Consecutive distinct dates (of each key) further apart than ``max_days``."""
    by = list(by)
    days = df.select(*by, F.col(col).alias("date")).distinct()
    prev = F.lag("date").over(Window.partitionBy(*by).orderBy("date"))
    return days.select(*by, prev.alias("previous_date"), "date").select(
        "*", F.datediff("date", "previous_date").alias("gap_days")
    ).where(F.col("gap_days") > max_days)
