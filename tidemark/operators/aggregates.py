"""Summary aggregates whose state stays small per group or is spread over tasks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.xsec import exact_quantiles, positions


def missing_keys(have: Mapping[str, DataFrame], expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Expected keys absent from each named table, one row each."""
    out = None
    for kind, df in have.items():
        part = expected.join(df.select(*keys).distinct(), list(keys), "left_anti").select(F.lit(kind).alias("kind"), *keys)
        out = part if out is None else out.unionByName(part)
    return out


def coverage_summary(df: DataFrame, value: str, date: str) -> DataFrame:
    """Minimum, 5% quantile, median and the latest value of a dated series."""
    one = df.withColumn("_all", F.lit(1))
    q = exact_quantiles(one, ["_all"], value, [0.05, 0.5], ["p05", "median"])
    ends = one.groupBy("_all").agg(F.min(value).alias("minimum"), F.max_by(value, date).alias("latest"))
    return q.join(F.broadcast(ends), "_all").select("minimum", "p05", "median", "latest")


def nearest_rank(df: DataFrame, by: Sequence[str], value: str, quantiles: Mapping[str, float]) -> DataFrame:
    """Percentiles by nearest rank, round(q * (n - 1)) with half to even."""
    place = positions(df, by, value)
    end = F.col("_start") + F.col("_count")
    hits = []
    for name, q in quantiles.items():
        k = F.bround((F.col("_n") - 1) * F.lit(float(q)), 0)
        hits.append(F.max(F.when((F.col("_start") <= k) & (k < end), F.col(value))).alias(name))
    return place.groupBy(*by).agg(F.max("_n").alias("n"), *hits)


def summarise(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Count, mean, median, sample deviation, share above zero and maximum of the non-null values."""
    by = list(by)
    x = F.col(value)
    base = df.where(x.isNotNull())
    aggs = [
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("deviation"),
        F.avg((x > 0).cast("double")).alias("positive_ratio"), F.max(x).alias("maximum"),
    ]
    stats = base.groupBy(*by).agg(*aggs)
    med = exact_quantiles(base, by, value, [0.5], ["median"]).drop("n")
    return stats.join(med, by)


def pairwise_cov(
    returns: DataFrame, key: str, date: str, value: str, minimum: int, names: Sequence | None = None, most: int = 512, days: int = 32,
) -> DataFrame:
    """Pairwise-complete sample covariance of a selected set of series, as a blocked Gram matrix.

    The pairs are the result itself (a matrix), so the series must be a selected list: ``names``, or all keys,
    of which more than ``most`` are an error.  Each series is centred on its mean, a block holds the rows of
    ``days`` calendar days as arrays over the names (at most ``days`` x ``most`` numbers), and hands on one row
    per pair with its count and sums.  Series never meet in a join; a series has one value per date.
    """
    r = returns.where(F.col(value).isNotNull())
    if names is None:
        names = sorted(row[0] for row in r.where(F.col(key).isNotNull()).select(key).distinct().limit(most + 1).collect())
    if len(names) > most:
        raise ValueError(f"a covariance matrix of more than {most} series was asked for")
    kind = r.schema[key].dataType
    x = F.col(value).cast("double")
    r = r.where(F.col(key).isin(list(names)))
    mean = F.broadcast(r.groupBy(key).agg(F.avg(x).alias("_mean")))  # one row a name
    r = r.join(mean, key).select(F.floor(F.datediff(date, F.lit("1970-01-01")) / days).alias("_block"), date, key, (x - F.col("_mean")).alias("_x"))
    by_day = r.groupBy("_block", date).agg(F.map_from_entries(F.collect_list(F.struct(key, "_x"))).alias("_of"))
    listed = F.array(*[F.lit(n).cast(kind) for n in names]) if names else F.array().cast(f"array<{kind.simpleString()}>")
    blocks = by_day.select("_block", F.transform(listed, lambda n: F.try_element_at("_of", n)).alias("_row"))
    blocks = blocks.groupBy("_block").agg(F.collect_list("_row").alias("_rows"))
    start = F.struct(F.lit(0).cast("long").alias("n"), *[F.lit(0.0).alias(c) for c in ("x", "y", "xy")])

    def sums(i: Column, j: Column) -> Column:
        def add(s: Column, row: Column) -> Column:
            u, v = F.get(row, i), F.get(row, j)
            return F.when(u.isNotNull() & v.isNotNull(), F.struct(
                (s["n"] + 1).alias("n"), (s["x"] + u).alias("x"), (s["y"] + v).alias("y"), (s["xy"] + u * v).alias("xy")
            )).otherwise(s)

        return F.aggregate("_rows", start, add)

    pairs = blocks.select("_rows", F.explode(F.sequence(F.lit(0), F.lit(len(names) - 1))).alias("_i")) if names else blocks.select("_rows", F.lit(0).alias("_i")).where("false")
    line = F.transform(F.sequence("_i", F.lit(max(len(names) - 1, 0))), lambda j: F.struct(j.alias("j"), sums(F.col("_i"), j).alias("s")))
    each = pairs.select("_i", F.explode(line).alias("_p")).select("_i", F.col("_p.j").alias("_j"), "_p.s.*").where("n > 0")
    total = each.groupBy("_i", "_j").agg(F.sum("n").alias("observations"), *[F.sum(c).alias(c) for c in ("x", "y", "xy")])
    n = F.col("observations")
    covariance = F.when(n > 1, (F.col("xy") - F.col("x") * F.col("y") / n) / F.greatest(n - 1, F.lit(1)))
    name = lambda c: F.get(listed, F.col(c))
    return total.where(n >= minimum).select(name("_i").alias("s1"), name("_j").alias("s2"), "observations", covariance.alias("covariance"))


def collect_by(df: DataFrame, keys: Sequence[str], col: str, out: str) -> DataFrame:
    """Sorted distinct values per key; for dates, so at most one entry per calendar day."""
    return df.groupBy(*keys).agg(F.array_sort(F.collect_set(col)).alias(out))
