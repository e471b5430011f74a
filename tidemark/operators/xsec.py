"""Cross-sectional statistics that never gather a whole cross-section in one task.

A date's cross-section grows with the universe, so a window partitioned by date alone
would sort all of it in a single task.  Ranks and quantiles are built here in two
levels instead: values are first counted per distinct value (map-side combined), each
value falls into an order-preserving bucket, running counts are taken inside a bucket,
and the totals of the earlier buckets are added.  The bucket is a fixed function of
the value, so no sampling is involved and results are exact.

Groups are dates, or dates crossed with a fixed list of factors or horizons, so tables with
one row per group are bounded by the calendar and may be broadcast.

Average ranks and quantile labels shuffle the rows once by (group, bucket), number them inside
the bucket and add the rows of earlier buckets from a table of one row per group and bucket.
Quantiles move only the rows of the buckets that hold a wanted place.  Ordinal ranks, whose
ties may fill a whole table, split runs of equal values by their tie key as well.

There is one plan whatever the size of a cross-section.  Inputs are read twice and met again
by value or bucket, so they must be tables (or ``session.stage``), not expressions that could
differ in the last bit from one evaluation to the next.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_PER_OCTAVE = 256
_FINE = 256  # fine buckets in each coarse one, for values that lie close together
_BIAS = 1100 * _PER_OCTAVE
_END = 1 << 53  # the bucket of infinities; not-a-number sorts behind them
DEVIATION_FLOOR = 1e-12


def order_bucket(value: Column, fine: int = 1) -> Column:
    """A coarse long that never decreases as ``value`` grows (256 x ``fine`` steps per power of two)."""
    x = value.cast("double")
    finite = F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(1.0)).otherwise(x)
    step = F.floor(F.log2(F.abs(finite)) * (_PER_OCTAVE * fine)).cast("long") + F.lit(_BIAS * fine + 1)
    return (
        F.when(F.isnan(x), F.lit(_END + 1)).when(x == float("inf"), F.lit(_END)).when(x == float("-inf"), F.lit(-_END))
        .when(x > 0, step).when(x < 0, -step).otherwise(F.lit(0)).cast("long")
    )


def _tie_bucket(df: DataFrame, tie: str) -> Column:
    kind = dict(df.dtypes)[tie]
    if kind == "string":
        return F.substring(F.col(tie), 1, 4)
    return order_bucket(F.col(tie))


def positions(df: DataFrame, by: Sequence[str], value: str, tie: str | None = None) -> DataFrame:
    """Distinct values with their place in the sorted group.

    Returns ``by, value[, _tb]`` and ``_start`` (rows before it), ``_count`` (rows equal
    to it) and ``_n`` (rows in the group).  Null values take no place.  With ``tie`` a
    run of equal values is itself split by an order-preserving bucket of the tie key.
    """
    by = list(by)
    rows = df.where(F.col(value).isNotNull())
    keys = [*by, value]
    if tie is not None:
        rows = rows.withColumn("_tb", _tie_bucket(df, tie))
        keys.append("_tb")
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_count"))
    counted = counted.withColumns({"_vb": order_bucket(F.col(value)), "_vf": order_bucket(F.col(value), _FINE)})
    before = (Window.unboundedPreceding, -1)

    def earlier(rows: DataFrame, within: Sequence[str], order: Sequence[str], n: str, out: str) -> DataFrame:
        w = Window.partitionBy(*within).orderBy(*order).rowsBetween(*before)
        return rows.withColumn(out, F.coalesce(F.sum(n).over(w), F.lit(0)))

    counted = earlier(counted, [*by, "_vb", "_vf"], [k for k in keys if k not in by], "_count", "_in_fine")
    fine = counted.groupBy(*by, "_vb", "_vf").agg(F.sum("_count").alias("_fine_rows"))
    fine = earlier(fine, [*by, "_vb"], ["_vf"], "_fine_rows", "_in_coarse")
    # One row per (group, coarse bucket): bounded by the bucket function, not by the data.
    coarse = fine.groupBy(*by, "_vb").agg(F.sum("_fine_rows").alias("_rows"))
    coarse = earlier(coarse, by, ["_vb"], "_rows", "_before").withColumn("_n", F.sum("_rows").over(Window.partitionBy(*by)))
    places = fine.join(coarse, [*by, "_vb"]).select(*by, "_vb", "_vf", (F.col("_in_coarse") + F.col("_before")).alias("_offset"), "_n")
    return counted.join(places, [*by, "_vb", "_vf"]).select(*keys, (F.col("_offset") + F.col("_in_fine")).alias("_start"), "_count", "_n")


def _bucketed(df: DataFrame, value: str, spread: str | None = None) -> DataFrame:
    """Adds ``_vb``; rows without a value lie below all others, over 64 buckets of their key where one is given."""
    missing = F.pmod(F.xxhash64(spread), F.lit(64)) if spread else F.lit(0)
    return df.withColumn("_vb", F.when(F.col(value).isNotNull(), order_bucket(F.col(value))).otherwise(F.lit(-2 * _END) - missing))


def _buckets(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """One row per group and bucket that holds values: its rows, bounds, the rows before it and the group's totals."""
    per = rows.where(F.col(value).isNotNull()).groupBy(*by, "_vb").agg(
        F.count(F.lit(1)).alias("_rows"), F.min(value).alias("_lo"), F.max(value).alias("_hi")
    )
    group = Window.partitionBy(*by).orderBy("_vb")
    whole = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return per.withColumns({
        "_before": F.coalesce(F.sum("_rows").over(group.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "_n": F.sum("_rows").over(whole), "_min": F.min("_lo").over(whole), "_max": F.max("_hi").over(whole),
    })


def average_rank(
    df: DataFrame, by: Sequence[str], value: str, out: str, key: str | None = None, centred: bool = False,
    like: DataFrame | None = None, label: tuple[int, str, str] | None = None,
) -> DataFrame:
    """1-based rank where equal values share the mean of their places; null stays null.

    ``key`` spreads the rows without a value over several tasks.  ``centred`` gives the rank
    less the mean rank of its group, so that a constant side is exactly zero.  ``like`` has the same
    groups and values as ``df`` and is counted instead of it where ``df`` is dear to compute twice.
    ``label`` (q, tie, column) adds what ``quantile_label`` gives, from the same shuffle.
    """
    by = list(by)
    rows = _bucketed(df, value, key)
    buckets = _buckets(rows if like is None else _bucketed(like, value, key), by, value)
    inside = Window.partitionBy(*by, "_vb").orderBy(value)
    if label is not None:
        q, tie, named = label
        rows = rows.withColumn("_no", F.row_number().over(Window.partitionBy(*by, "_vb").orderBy(value, tie)))
    numbered = rows.withColumns({
        "_in": F.rank().over(inside), "_same": F.count(F.lit(1)).over(inside.rangeBetween(Window.currentRow, Window.currentRow)),
    })
    bounds = [] if label is None else ["_min", "_max"]
    placed = numbered.join(buckets.select(*by, "_vb", "_before", "_n", *bounds), [*by, "_vb"], "left")
    if label is not None:
        placed = placed.withColumn(named, F.when(F.col(value).isNotNull(), _label(F.col("_no"), q))).drop("_no", *bounds)
    # rows without a value find no bucket, so their rank stays null
    rank = F.col("_before") + F.col("_in") + (F.col("_same") - 1) / 2
    return placed.withColumn(out, rank - (F.col("_n") + 1) / 2 if centred else rank).drop("_vb", "_in", "_same", "_before", "_n")


def ordinal_rank(
    df: DataFrame, by: Sequence[str], value: str, tie: str, out: str, descending: bool = False,
    size: str | None = None,
) -> DataFrame:
    """1..n by ``value`` then ``tie`` ascending; rows with a null value get null."""
    by = list(by)
    keyed = df.withColumn("_v", -F.col(value) if descending else F.col(value).cast("double"))
    keyed = keyed.withColumn("_tb", _tie_bucket(df, tie))
    place = positions(keyed.select(*by, "_v", tie), by, "_v", tie)
    placed = keyed.join(place, [*by, "_v", "_tb"], "left")
    within = Window.partitionBy(*by, "_v", "_tb").orderBy(tie)
    placed = placed.withColumn(
        out,
        F.when(F.col("_v").isNotNull(), F.col("_start") + F.row_number().over(within)).cast("long"),
    )
    if size is not None:
        placed = placed.withColumn(size, F.col("_n").cast("long"))
    return placed.drop("_v", "_tb", "_start", "_count", "_n")


def exact_quantiles(
    df: DataFrame, by: Sequence[str], value: str, quantiles: Sequence[float], names: Sequence[str]
) -> DataFrame:
    """Linear-interpolated quantiles per group, exact, plus the number of values ``n``."""
    by = list(by)
    rows = _bucketed(df.where(F.col(value).isNotNull()).select(*by, value), value)
    places = {}
    for q, name in zip(quantiles, names, strict=True):
        at = (F.col("_n") - 1) * F.lit(float(q))
        places |= {f"_{name}_lo": F.floor(at), f"_{name}_hi": F.ceil(at)}
    end = F.col("_before") + F.col("_rows")
    wanted = F.lit(False)
    for k in places.values():
        wanted = wanted | ((F.col("_before") <= k) & (k < end))
    # Only rows of these buckets move, at most two buckets a quantile and group; equal values are counted first.
    hit = F.broadcast(_buckets(rows, by, value).where(wanted).select(*by, "_vb", "_before", "_n"))
    values = rows.join(hit, [*by, "_vb"]).groupBy(*by, "_vb", "_before", "_n", value).agg(F.count(F.lit(1)).alias("_count"))
    running = F.sum("_count").over(Window.partitionBy(*by, "_vb").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = values.withColumn("_end", F.col("_before") + running).select(
        *by, "_n", F.col(value).alias("_value"), (F.col("_end") - F.col("_count")).alias("_start"), "_end"
    )
    aggs, outs = [], []
    for name, k in places.items():
        aggs.append(F.max(F.when((F.col("_start") <= k) & (k < F.col("_end")), F.col("_value"))).alias(name))
    for q, name in zip(quantiles, names, strict=True):
        frac = (F.col("n") - 1) * F.lit(float(q))
        frac = frac - F.floor(frac)
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        outs.append((lo + (hi - lo) * frac).alias(name))
    return found.groupBy(*by).agg(F.max("_n").alias("n"), *aggs).select(*by, "n", *outs)


def winsorised_z(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    out: str,
    q: float = 0.05,
    minimum: int = 3,
    empty: str = "null",
) -> DataFrame:
    """Clip at the q and 1-q quantiles, then standardise with the population deviation.

    ``empty='null'`` leaves missing and degenerate scores null (research policy);
    ``empty='zero'`` returns 0.0 for them (strategy policy).  The two policies also use
    different minimum counts, so pass ``minimum`` explicitly with ``'zero'``.
    """
    by = list(by)
    x = F.col(value)
    policy = lambda z: F.coalesce(z, F.lit(0.0)) if empty == "zero" else z
    if q > 0:
        bounds = exact_quantiles(df, by, value, [q, 1 - q], ["_lo", "_hi"])
    else:
        bounds = df.where(F.col(value).isNotNull()).groupBy(*by).agg(
            F.count(value).alias("n"), F.min(value).alias("_lo"), F.max(value).alias("_hi")
        )
    # One row per group (dates x factors, at most one per calendar day and registry entry).
    clipped = df.join(F.broadcast(bounds), by, "left").withColumn(
        "_clip",
        F.when(F.col(value).isNotNull(), F.greatest(F.least(F.col(value), F.col("_hi")), F.col("_lo"))),
    )
    moments = clipped.groupBy(*by).agg(
        F.avg("_clip").alias("_mean"), F.stddev_pop("_clip").alias("_sd")
    )
    usable = (F.col("n") >= minimum) & (F.col("_sd") >= DEVIATION_FLOOR)
    z = F.when(usable, F.try_divide(F.col("_clip") - F.col("_mean"), F.col("_sd")))
    return (
        clipped.join(F.broadcast(moments), by, "left")
        .withColumn(out, policy(z))
        .drop("n", "_lo", "_hi", "_clip", "_mean", "_sd")
    )


def _label(number: Column, q: int) -> Column:
    """Bucket 1..q of the ``number``-th row of its bucket of values."""
    place = F.col("_before") + number - 1
    label = F.greatest(F.lit(1), F.ceil(place * F.lit(q) / F.nullif(F.col("_n") - 1, F.lit(0))))
    return F.when((F.col("_n") >= 2 * q) & (F.col("_min") < F.col("_max")), label).cast("int")


def quantile_label(
    df: DataFrame, by: Sequence[str], score: str, tie: str, q: int, out: str = "quantile"
) -> DataFrame:
    """Equal-count buckets 1..q by first-come rank; null below 2q scores or one distinct score."""
    by = list(by)
    rows = _bucketed(df, score, tie)
    inside = Window.partitionBy(*by, "_vb").orderBy(score, tie)
    placed = rows.withColumn("_in", F.row_number().over(inside)).join(
        _buckets(rows, by, score).select(*by, "_vb", "_before", "_n", "_min", "_max"), [*by, "_vb"], "left"
    )
    return placed.withColumn(out, _label(F.col("_in"), q)).drop("_vb", "_in", "_before", "_n", "_min", "_max")


def neutralise(
    df: DataFrame,
    by: Sequence[str],
    score: str,
    industry: str | None,
    size: str | None,
    strength: float = 1.0,
    out: str = "neutral_score",
) -> DataFrame:
    """Remove industry means and a share of the size slope from a score, then re-standardise.

    Closed form of least squares on industry dummies plus size: both variables are
    demeaned inside the industry, the slope is the ratio of their moments, and each
    industry keeps its own intercept.  When size does not vary inside any industry the
    slope is not identified and is taken as 0.  With neither control the score passes
    through unchanged.
    """
    by = list(by)
    if industry is None and size is None:
        return df.withColumn(out, F.col(score))
    cell = [*by, industry] if industry is not None else by
    y, z = F.col(score), F.col(size) if size is not None else None
    aggs = [F.avg(y).alias("_ybar")] + ([F.avg(z).alias("_zbar")] if size else [])
    centred = df.join(df.groupBy(*cell).agg(*aggs), cell, "left")
    adjust = F.col("_ybar")
    if size is not None:
        zt, yt = z - F.col("_zbar"), y - F.col("_ybar")
        slope = lambda zy, zz: F.when(zz > 1e-18, zy / zz).otherwise(0.0)
        slopes = centred.groupBy(*by).agg(slope(F.sum(zt * yt), F.sum(zt * zt)).alias("_beta"))
        centred = centred.join(F.broadcast(slopes), by, "left")  # one row per date
        # industry intercept = mean score - slope * mean size; size removed with `strength`
        adjust = F.col("_ybar") - F.col("_beta") * F.col("_zbar") + F.lit(float(strength)) * F.col("_beta") * z
    residual = centred.withColumn("_res", y - adjust)
    return winsorised_z(residual, by, "_res", out, q=0.0, minimum=2, empty="zero").drop(
        "_ybar", "_zbar", "_beta", "_res"
    )


def spearman(
    df: DataFrame, by: Sequence[str], first: str, second: str, minimum: int = 2, out: str = "spearman", key: str | None = None, q: int = 0,
) -> DataFrame:
    """Rank correlation per group over rows where both values are present.

    Every group of ``df`` is returned with its pair count; the correlation is null
    below ``minimum`` pairs or when either side is constant.  Both sides are ranked
    together as rows of one table and meet again by ``key``, which names a row within
    its group; without a key they are ranked one after the other.

    With ``q`` each pair carries its first rank along when it is ranked by the other side, so it moves
    twice and no more.  The pairs are then also cut into buckets 1..q of ``first`` (ties by ``key``), and ``bottom`` and ``top``
    are the means of ``second`` in the first and the last.
    """
    by = list(by)
    both = F.col(first).isNotNull() & F.col(second).isNotNull()
    ends = []
    if q or key is None:
        pairs = df.select(*by, F.when(both, F.col(first)).alias("_x1"), F.when(both, F.col(second)).alias("_x2"), *([F.col(key).alias("_tie")] if q else []))
        ranked = average_rank(pairs, by, "_x1", "_r1", "_tie" if q else None, centred=True, label=(q, "_tie", "_bucket") if q else None)
        ranked = average_rank(ranked, by, "_x2", "_r2", "_tie" if q else None, centred=True, like=pairs)
        end = lambda k: F.avg(F.when(F.col("_bucket") == k, F.col("_x2")))
        ends = [end(1).alias("bottom"), end(q).alias("top")] if q else []
    else:
        side = lambda k, c: F.struct(F.lit(k).alias("side"), F.col(c).cast("double").alias("x"))
        # a row without both values stays, so that its group does
        sides = F.when(both, F.array(side(1, first), side(2, second))).otherwise(F.array(F.struct(F.lit(1).alias("side"), F.lit(None).cast("double").alias("x"))))
        long = df.select(*by, F.col(key).alias("_key"), F.explode(sides).alias("_s")).select(*by, "_key", F.col("_s.side").alias("_side"), F.col("_s.x").alias("_x"))
        rank = average_rank(long, [*by, "_side"], "_x", "_r", "_key", centred=True)
        of = lambda k: F.max(F.when(F.col("_side") == k, F.col("_r")))
        ranked = rank.groupBy(*by, "_key").agg(of(1).alias("_r1"), of(2).alias("_r2"))
    r1, r2 = F.col("_r1"), F.col("_r2")
    moments = ranked.groupBy(*by).agg(
        F.count(r1).alias("observations"), F.sum(r1 * r2).alias("_xy"), F.sum(r1 * r1).alias("_xx"), F.sum(r2 * r2).alias("_yy"), *ends
    )
    value = F.when(
        (F.col("observations") >= F.lit(max(2, minimum))) & (F.col("_xx") > 0) & (F.col("_yy") > 0),
        F.try_divide(F.col("_xy"), F.sqrt(F.col("_xx") * F.col("_yy"))),
    )
    # both sides have one row per group; a group without pairs has no moments
    return moments.select(*by, "observations", value.alias(out), *(["bottom", "top"] if q else []))
