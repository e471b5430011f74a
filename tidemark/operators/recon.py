"""Comparing two copies or two sources of the same data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def match_sources(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer match with a status per key; values prefixed a_ and b_."""
    keys = list(keys)
    left = a.select(*keys, *[F.col(c).alias(f"a_{c}") for c in a.columns if c not in keys], F.lit(1).alias("_a"))
    right = b.select(*keys, *[F.col(c).alias(f"b_{c}") for c in b.columns if c not in keys], F.lit(1).alias("_b"))
    status = (
        F.when(F.col("_a").isNull(), "missing_left").when(F.col("_b").isNull(), "missing_right").otherwise("compared")
    )
    return left.join(right, keys, "outer").withColumn("status", status).drop("_a", "_b")


def close_enough(a: Column, b: Column, absolute: float, relative: float) -> Column:
    """Within the larger of an absolute and a relative tolerance; null if either is missing."""
    return F.abs(a - b) <= F.greatest(F.lit(absolute), F.lit(relative) * F.greatest(F.abs(a), F.abs(b)))


def field_matches(matched: DataFrame, tolerances: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Long form of the comparison: one row per key and field with its verdict."""
    out = matched
    for f, (ta, tr) in tolerances.items():
        out = out.withColumn(f"ok_{f}", close_enough(F.col(f"a_{f}"), F.col(f"b_{f}"), ta, tr))
    return out


def match_rates(matched: DataFrame, tolerances: Mapping[str, tuple[float, float]], gate: float) -> DataFrame:
    """Share of matching values per field over compared keys, and whether it passes."""
    checked = field_matches(matched.where(F.col("status") == "compared"), tolerances)
    fields = list(tolerances)
    agg = checked.agg(
        *[F.avg(F.col(f"ok_{f}").cast("double")).alias(f"r_{f}") for f in fields],
        *[F.count(f"ok_{f}").alias(f"n_{f}") for f in fields],
    )
    each = F.array(
        *[
            F.struct(F.lit(f).alias("field"), F.col(f"n_{f}").alias("compared"), F.col(f"r_{f}").alias("match_rate"))
            for f in fields
        ]
    )
    return agg.select(F.explode(each).alias("x")).select(
        "x.*", F.coalesce(F.col("x.match_rate") >= gate, F.lit(False)).alias("passed")
    )


def factor_change_dates(factors: DataFrame, factor: str = "adj_factor") -> DataFrame:
    """Dates on which a symbol's factor differs from its previous row (the first row counts)."""
    prev = F.lag(factor).over(Window.partitionBy("symbol").orderBy("date"))
    return factors.select("symbol", "date", factor, prev.alias("_p")).where(
        ~F.col(factor).eqNullSafe(F.col("_p"))
    ).drop("_p")


def row_digest(cols: Sequence[str]) -> Column:
    """60-bit number from a row's SHA-256, for order-independent sums."""
    body = F.to_json(F.struct(*[F.col(c) for c in cols]), {"ignoreNullFields": "false"}) if cols else F.lit("{}")
    return F.conv(F.substring(F.sha2(body, 256), 1, 15), 16, 10).cast("decimal(38,0)")


def table_fingerprint(df: DataFrame) -> DataFrame:
    """Row count and digest sum: equal for equal content in any order or file layout."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(row_digest(sorted(df.columns))), F.lit(0).cast("decimal(38,0)")).cast("string").alias("digest"),
    )


def reconcile_copies(
    a: DataFrame, b: DataFrame, pk: Sequence[str], group: Sequence[str], within: Mapping[str, float] | None = None
) -> DataFrame:
    """Per group: match when keys, counts and content agree; inconclusive when a side is absent.

    Columns in ``within`` agree when both sides are present and differ by less than their tolerance; all
    others must be equal.  Rows of both copies meet by key, so a tolerance never falls on the edge of a
    rounding step.  A key that a copy holds twice, or that has a null in it, matches nothing.
    """
    pk, group, within = list(pk), list(group), dict(within or {})
    exact = [c for c in a.columns if c not in (*pk, *group, *within)]
    shape = lambda df, p: df.select(
        *group, *pk, *within, row_digest(exact).alias("_body"),
        F.lit(int(p == "a")).alias("_a"), F.lit(int(p == "b")).alias("_b"),
    )
    spread = [F.max(c) - F.min(c) for c in within]
    same = (F.sum("_a") == 1) & (F.sum("_b") == 1) & (F.min("_body") == F.max("_body"))
    for (c, limit), gap in zip(within.items(), spread):
        # not-a-number and differences of infinities are above every limit
        same = same & (F.count(c) == 2) & (gap < F.lit(float(limit)))
    keyed = shape(a, "a").unionByName(shape(b, "b")).groupBy(*group, *pk).agg(
        F.sum("_a").alias("_a"), F.sum("_b").alias("_b"), same.alias("_same")
    )
    whole = F.lit(True)
    for c in [*group, *pk]:
        whole = whole & F.col(c).isNotNull()
    out = keyed.groupBy(*group).agg(
        F.sum("_a").alias("a_rows"), F.sum("_b").alias("b_rows"), F.bool_and(F.coalesce("_same", F.lit(False)) & whole).alias("_same")
    )
    verdict = (
        F.when((F.col("a_rows") == 0) | (F.col("b_rows") == 0), "inconclusive").when(F.col("_same"), "match").otherwise("mismatch")
    )
    return out.select(*group, "a_rows", "b_rows", verdict.alias("verdict"))


def page_overlap(pages: DataFrame, pk: Sequence[str], cap: int) -> DataFrame:
    """Are pages of one request disjoint, and does the union pass the single-page cap?"""
    per_key = pages.groupBy("request", *pk).agg(F.countDistinct("page").alias("_p"))
    return per_key.groupBy("request").agg(
        F.count(F.lit(1)).alias("union_rows"),
        F.sum((F.col("_p") > 1).cast("long")).alias("overlap_rows"),
    ).select("*", (F.col("union_rows") > cap).alias("cap_broken"), (F.col("overlap_rows") == 0).alias("disjoint"))


def selection_overlap(sel: DataFrame, base_arm: str, arms: Sequence[str]) -> DataFrame:
    """Overlap and Jaccard of every arm's picks with a base arm, per date.

    Each (date, symbol) is reduced to the set of arms that hold it, so arms are compared
    by counting flags rather than by joining the table to itself.
    """
    flags = sel.groupBy("signal_date", "symbol").agg(
        *[F.max((F.col("arm") == a).cast("long")).alias(f"_{i}") for i, a in enumerate(arms)]
    )
    b = list(arms).index(base_arm)
    per = flags.groupBy("signal_date").agg(
        *[F.sum(f"_{i}").alias(f"n_{i}") for i in range(len(arms))],
        *[F.sum(F.col(f"_{i}") * F.col(f"_{b}")).alias(f"x_{i}") for i in range(len(arms))],
    )
    each = F.array(
        *[
            F.struct(
                F.lit(a).alias("arm"), F.col(f"n_{i}").alias("selected_count"), F.col(f"x_{i}").alias("overlap"),
                F.try_divide(F.col(f"x_{i}"), F.col(f"n_{i}") + F.col(f"n_{b}") - F.col(f"x_{i}")).alias("jaccard"),
            )
            for i, a in enumerate(arms)
        ]
    )
    return per.select("signal_date", F.explode(each).alias("e")).select("signal_date", "e.*")


def exclude_explained(matched: DataFrame, explained: DataFrame, field: str, tolerance: tuple[float, float]) -> DataFrame:
    """Drop a field from the comparison where it differs for a known reason.

    ``explained`` holds (symbol, date), for example ex-dividend days on which one source
    shows the adjusted previous close.  The value becomes null, so it counts neither way.
    """
    known = explained.select("symbol", "date", F.lit(True).alias("_known")).distinct()
    ok = close_enough(F.col(f"a_{field}"), F.col(f"b_{field}"), *tolerance)
    skip = F.coalesce(F.col("_known"), F.lit(False)) & F.coalesce(~ok, F.lit(False))
    return matched.join(known, ["symbol", "date"], "left").withColumn(
        f"b_{field}", F.when(skip, None).otherwise(F.col(f"b_{field}"))
    ).drop("_known")


def reconcile_versions(
    versions: DataFrame, independent: DataFrame, keys: Sequence[str], order: Sequence[str], absolute: float, relative: float
) -> DataFrame:
    """Does an independent figure match any retained revision, and is its date among theirs?

    The latest revision is the largest in ``order``.  One pass: the independent value has
    one row per key, so it joins before the aggregate.
    """
    joined = versions.join(independent, list(keys))
    close = close_enough(F.col("value"), F.col("independent_value"), absolute, relative)
    return joined.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("versions"),
        F.max_by("value", F.struct(*order)).alias("latest_value"),
        F.max("independent_value").alias("independent_value"),
        F.bool_or(close).alias("matches_any"),
        F.bool_or(F.col("announced") == F.col("independent_announced")).alias("announced_known"),
    )


def retention(reconciled: DataFrame) -> DataFrame:
    """Match rates over compared keys and the share of keys with several revisions."""
    return reconciled.agg(
        F.count("matches_any").alias("compared"),
        F.avg(F.col("matches_any").cast("double")).alias("value_match_rate"),
        F.avg(F.col("announced_known").cast("double")).alias("date_match_rate"),
        F.avg((F.col("versions") > 1).cast("double")).alias("retention_rate"),
    )
