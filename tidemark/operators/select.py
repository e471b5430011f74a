"""Ranking, top-n and selection with a holding buffer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.xsec import average_rank, ordinal_rank, quantile_label

__all__ = ["average_rank", "ordinal_rank", "quantile_label", "top_n", "buffered_top_n", "chained_selection",
           "trailing", "stratified_sample", "sample_without_replacement", "weighted_score", "mean_score"]


def top_n(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int, out: str = "rank") -> DataFrame:
    """First n rows per group in a total order.

    ``row_number() <= n`` lets the planner keep only n rows per group on the map side
    before the shuffle, so the group itself never travels.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= n)


def buffered_top_n(
    ranked: DataFrame, held: DataFrame, n: int, exit_rank: int, by: Sequence[str] = ("signal_date",)
) -> DataFrame:
    """Keep held names ranked within ``exit_rank`` (best n), fill up by rank.

    Only ranks up to max(n, exit_rank) can ever be chosen, so each group is cut to that
    many rows first.
    """
    by = list(by)
    pool = ranked.where(F.col("rank") <= max(n, exit_rank))
    pool = pool.join(held.select(*by, "symbol", F.lit(True).alias("was_held")), [*by, "symbol"], "left")
    pool = pool.withColumn("was_held", F.coalesce("was_held", F.lit(False)))
    keep = F.col("was_held") & (F.col("rank") <= exit_rank)
    w = Window.partitionBy(*by).orderBy("rank")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    pool = pool.withColumn("_k", F.when(keep, F.sum(keep.cast("int")).over(run)))
    pool = pool.withColumn("_kept", F.coalesce(F.col("_k") <= n, F.lit(False)))
    pool = pool.withColumn("_room", F.lit(n) - F.sum(F.col("_kept").cast("int")).over(Window.partitionBy(*by)))
    pool = pool.withColumn("_f", F.sum((~F.col("_kept")).cast("int")).over(run))
    out = pool.where(F.col("_kept") | (F.col("_f") <= F.col("_room")))
    reason = F.when(F.col("_kept"), "HOLD_BUFFER").otherwise("NEW_ENTRY")
    return out.withColumn("selection_reason", reason).drop("_k", "_kept", "_room", "_f")


def chained_selection(ranked: DataFrame, n: int, exit_rank: int, arm: str = "arm") -> DataFrame:
    """Buffered selection where each date's holdings are the previous date's picks.

    The chain is sequential in time, so it is one fold per arm over an array of dates, each
    with its names in rank order.  An arm's array has at most max(n, exit_rank) names per
    signal date, because ranks beyond that are cut before the shuffle.
    """
    limit = max(n, exit_rank)
    pool = ranked.where(F.col("rank") <= limit)
    kind = dict(pool.dtypes)["symbol"]
    days = pool.groupBy(arm, "signal_date").agg(F.array_sort(F.collect_list(F.struct("rank", "symbol"))).alias("names"))
    chain = days.groupBy(arm).agg(F.array_sort(F.collect_list(F.struct("signal_date", "names"))).alias("days"))
    fold = f"""aggregate(days,
        named_struct('held', cast(array() AS array<{kind}>), 'out', cast(array() AS array<struct<signal_date:date, before:array<{kind}>, kept:array<{kind}>, held:array<{kind}>>>)),
        (acc, day) -> transform(array(slice(filter(transform(day.names, x -> IF(x.rank <= {exit_rank}, x.symbol, NULL)), x -> array_contains(acc.held, x)), 1, {n})),
            kept -> named_struct('held', concat(kept, slice(array_except(transform(day.names, x -> x.symbol), kept), 1, {n} - size(kept))),
                'out', concat(acc.out, array(named_struct('signal_date', day.signal_date, 'before', acc.held, 'kept', kept,
                    'held', concat(kept, slice(array_except(transform(day.names, x -> x.symbol), kept), 1, {n} - size(kept))))))))[0],
        acc -> acc.out)"""
    picks = chain.select(arm, F.explode(F.expr(fold)).alias("d")).select(arm, "d.*")
    picks = picks.select(arm, "signal_date", "before", "kept", F.explode("held").alias("symbol"))
    return pool.select(arm, "signal_date", "symbol", "rank").join(picks, [arm, "signal_date", "symbol"]).select(
        arm, "signal_date", "symbol", "rank", F.array_contains("before", F.col("symbol")).alias("was_held"),
        F.when(F.array_contains("kept", F.col("symbol")), "HOLD_BUFFER").otherwise("NEW_ENTRY").alias("selection_reason"),
    )


def trailing(df: DataFrame, cal: DataFrame, signals: DataFrame, n: int) -> DataFrame:
    """Rows of the last ``n`` calendar days up to each signal date.

    Every signal date is expanded to the day numbers it looks back on: a table of
    signals x n rows, both bounded by the calendar, that rows then meet by equality.
    """
    at = cal.select(F.col("date").alias("signal_date"), F.col("ord").alias("_s"))
    days = signals.select("signal_date").distinct().join(F.broadcast(at), "signal_date").select(
        "signal_date", F.explode(F.sequence(F.greatest(F.col("_s") - n + 1, F.lit(1)), F.col("_s"))).alias("ord")
    )
    wanted = days.join(F.broadcast(cal), "ord").select("signal_date", "date")
    return df.join(F.broadcast(wanted), "date")


def stratified_sample(df: DataFrame, bucket: str, key: str, n: int, seed: int) -> DataFrame:
    """n keys per bucket in the order of a seeded hash: the same on any partitioning."""
    h = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256)
    return top_n(df, [bucket], [h, F.col(key)], n, "_rn").drop("_rn")


def sample_without_replacement(df: DataFrame, strata: Sequence[str], bucket: str, key: str, n: int, seed: int) -> DataFrame:
    """n keys for each of overlapping ``strata``, named in order of priority; a key is drawn once, by the first that takes it.

    Keys are ordered by a seeded hash, the same in all strata and on any partitioning.  The strata before the p-th draw
    at most n * (p - 1) keys, so the p-th finds its own among its first n * p: one shuffle cuts the table to that, and
    the draws, one round per stratum, see only these.  A key that repeats in a stratum counts once; null keys and
    strata that are not named are left out; a stratum that runs out of keys gives fewer.
    """
    place = F.element_at(F.create_map(*[x for i, s in enumerate(strata, 1) for x in (F.lit(s), F.lit(i))]), F.col(bucket))
    h = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256)
    rows = df.where(F.col(bucket).isin(*strata) & F.col(key).isNotNull()).select(bucket, key).distinct().withColumns({"_p": place, "_h": h})
    own = Window.partitionBy(bucket).orderBy("_h", key)
    rows = rows.withColumn("_i", F.row_number().over(own)).where(F.col("_i") <= n * len(strata)).where(F.col("_i") <= n * F.col("_p"))
    rows = rows.withColumns({"_free": F.lit(True), "_drawn": F.lit(False)})
    for p in range(1, len(strata) + 1):
        order = F.sum(F.col("_free").cast("int")).over(own.rowsBetween(Window.unboundedPreceding, 0))
        rows = rows.withColumn("_now", (F.col("_p") == p) & F.col("_free") & (order <= n))
        taken = F.max("_now").over(Window.partitionBy(key))
        rows = rows.withColumns({"_drawn": F.col("_drawn") | F.col("_now"), "_free": F.col("_free") & ~taken})
    return rows.where("_drawn").select(bucket, key)


def weighted_score(z: DataFrame, weights: dict[str, float], by: Sequence[str], out: str = "score") -> DataFrame:
    """Composite of long-form scores with weights scaled to sum to one; missing counts as zero."""
    total = sum(weights.values())
    w = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, v / total)])
    return z.where(F.col("factor").isin(*weights)).groupBy(*by).agg(
        F.sum(F.coalesce("z", F.lit(0.0)) * w[F.col("factor")]).alias(out)
    )


def mean_score(z: DataFrame, by: Sequence[str], minimum: int, out: str = "composite") -> DataFrame:
    """Equal-weight mean of the scores that exist, null below ``minimum`` of them."""
    return z.groupBy(*by).agg(
        F.count("z").alias("available_factor_count"),
        F.when(F.count("z") >= minimum, F.avg("z")).alias(out),
    )
