"""Ranks, quantiles, scores and neutralisation against pandas and NumPy, on both code paths."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import aggregates, select, xsec


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(5)
    n = 3000
    pdf = pd.DataFrame(
        {
            # one hot group holds most rows, and a third of all values are one tie
            "g": np.where(rng.random(n) < 0.7, 0, rng.integers(1, 5, n)),
            "s": np.arange(n),
            "x": np.where(rng.random(n) < 0.33, 0.0, np.round(rng.normal(0, 3, n), 2)),
            "y": rng.normal(18, 1, n),
            "ind": rng.choice(list("abcd"), n),
        }
    )
    pdf.loc[rng.random(n) < 0.05, "x"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x"))).cache()
    return pdf, df


def test_order_bucket_never_decreases(spark):
    xs = [-1e300, -7.5, -7.4, -1.0, -1e-9, -5e-324, 0.0, 5e-324, 1e-12, 0.999, 1.0, 1.001, 42.0, 1e300]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double")
    got = [r["b"] for r in df.withColumn("b", xsec.order_bucket(F.col("x"))).orderBy("i").collect()]
    assert got == sorted(got)


def test_average_rank(sample):
    pdf, df = sample
    got = xsec.average_rank(df, ["g"], "x", "r").toPandas().set_index("s")["r"].sort_index()
    want = pdf.groupby("g")["x"].rank().set_axis(pdf["s"])
    np.testing.assert_allclose(got.to_numpy(float), want.to_numpy(float), equal_nan=True)


@pytest.mark.parametrize("descending", [False, True])
def test_ordinal_rank(sample, descending):
    pdf, df = sample
    got = xsec.ordinal_rank(df, ["g"], "x", "s", "r", descending, "n").toPandas().set_index("s").sort_index()
    want = pdf.groupby("g")["x"].rank(method="first", ascending=not descending)
    np.testing.assert_allclose(got["r"].to_numpy(float), want.to_numpy(float), equal_nan=True)
    seen = pdf.groupby("g")["x"].transform("count")
    ok = pdf["x"].notna()
    assert (got["n"][ok.to_numpy()].to_numpy() == seen[ok].to_numpy()).all()


def test_quantiles(sample):
    pdf, df = sample
    qs = [0.05, 0.5, 0.731, 1.0]
    got = xsec.exact_quantiles(df, ["g"], "x", qs, ["a", "b", "c", "d"]).toPandas().set_index("g").sort_index()
    want = pdf.groupby("g")["x"].quantile(qs).unstack()
    np.testing.assert_allclose(got[["a", "b", "c", "d"]].to_numpy(), want.to_numpy(), atol=1e-12)


def z_pandas(x, q, minimum, zero):
    out = pd.Series(0.0 if zero else np.nan, index=x.index)
    if x.notna().sum() < minimum:
        return out
    c = x.clip(x.quantile(q), x.quantile(1 - q))
    if c.std(ddof=0) < 1e-12:
        return out
    z = (c - c.mean()) / c.std(ddof=0)
    return z.fillna(0.0) if zero else z


@pytest.mark.parametrize("zero", [False, True])
def test_winsorised_z(sample, zero):
    pdf, df = sample
    got = xsec.winsorised_z(df, ["g"], "x", "z", 0.05, 2 if zero else 3, "zero" if zero else "null")
    got = got.toPandas().set_index("s")["z"].sort_index()
    want = pdf.groupby("g")["x"].transform(lambda x: z_pandas(x, 0.05, 3, zero))
    np.testing.assert_allclose(got.to_numpy(float), want.to_numpy(float), atol=1e-10, equal_nan=True)


def test_degenerate_scores(spark):
    df = spark.createDataFrame([(1, 1, 5.0), (1, 2, 5.0), (1, 3, 5.0), (2, 4, 1.0), (2, 5, 2.0)], "g int, s int, x double")
    null = xsec.winsorised_z(df, ["g"], "x", "z").select("z").collect()
    assert all(r["z"] is None for r in null)
    zero = {r["s"]: r["z"] for r in xsec.winsorised_z(df, ["g"], "x", "z", 0.0, 2, "zero").collect()}
    assert [zero[i] for i in (1, 2, 3)] == [0.0, 0.0, 0.0] and zero[4] == pytest.approx(-1.0)


@pytest.mark.parametrize("strength", [1.0, 0.4])
def test_neutralise_equals_least_squares(sample, strength):
    pdf, df = sample
    full = df.where("x IS NOT NULL")
    got = xsec.neutralise(full, ["g"], "x", "ind", "y", strength, "res").toPandas().set_index("s")["res"]
    for _, part in pdf.dropna().groupby("g"):
        dummies = pd.get_dummies(part["ind"], dtype=float).to_numpy()
        beta = np.linalg.lstsq(np.column_stack([dummies, part["y"]]), part["x"].to_numpy(), rcond=None)[0]
        res = part["x"].to_numpy() - dummies @ beta[:-1] - strength * beta[-1] * part["y"].to_numpy()
        want = (res - res.mean()) / res.std()
        np.testing.assert_allclose(got.loc[part["s"]].to_numpy(), want, atol=1e-8)


def test_neutralise_without_controls_passes_score_through(sample):
    _, df = sample
    out = xsec.neutralise(df.where("x IS NOT NULL"), ["g"], "x", None, None, out="res")
    assert out.where("res <> x").count() == 0


def test_spearman(sample):
    pdf, df = sample
    got = xsec.spearman(df, ["g"], "x", "y", 3, "c").toPandas().set_index("g").sort_index()
    for g, part in pdf.groupby("g"):
        p = part[["x", "y"]].dropna()
        assert got.loc[g, "observations"] == len(p)
        assert got.loc[g, "c"] == pytest.approx(p["x"].rank().corr(p["y"].rank()), abs=1e-10)
    flat = df.withColumn("x", F.lit(1.0))
    assert all(r["c"] is None for r in xsec.spearman(flat, ["g"], "x", "y", 3, "c").collect())


def test_both_sides_ranked_together_equal_one_after_the_other(sample):
    pdf, df = sample
    split = F.when(F.col("s") % 7 > 0, F.col("y"))
    some = df.withColumn("y", F.when(F.col("g") != 3, split)).unionByName(df.limit(1).selectExpr("9L AS g", "-1L AS s", "x", "y", "ind"))
    want = {r["g"]: (r["observations"], r["c"]) for r in xsec.spearman(some, ["g"], "x", "y", 3, "c").collect()}
    got = {r["g"]: (r["observations"], r["c"]) for r in xsec.spearman(some, ["g"], "x", "y", 3, "c", "s").collect()}
    assert got.keys() == want.keys() and got[3] == want[3] == (0, None)
    for g, (n, c) in want.items():
        assert got[g][0] == n and (c is None) == (got[g][1] is None) and (c is None or abs(got[g][1] - c) < 1e-12)


def test_one_value_only_has_no_correlation_in_a_large_group(spark):
    df = spark.range(300_000).selectExpr("1 AS g", "id AS s", "7.0D AS x", "CAST(id AS DOUBLE) AS y")
    assert [tuple(r) for r in xsec.spearman(df, ["g"], "x", "y", 3, "c", "s").collect()] == [(1, 300_000, None)]


@pytest.mark.parametrize("q", [2, 4, 5])
def test_quantile_labels_equal_qcut(sample, q):
    pdf, df = sample
    got = xsec.quantile_label(df, ["g"], "x", "s", q, "k").toPandas().set_index("s")["k"].sort_index()
    for _, part in pdf.groupby("g"):
        v = part["x"].dropna()
        want = pd.qcut(v.rank(method="first"), q, labels=False) + 1
        assert (got.loc[part.loc[v.index, "s"]].to_numpy() == want.to_numpy()).all()
    few = df.where("g = 1").limit(2 * q - 1)
    assert xsec.quantile_label(few, ["g"], "x", "s", q, "k").where("k IS NOT NULL").count() == 0


def test_ranks_of_infinite_and_close_values(spark):
    values = [float("inf"), float("-inf"), float("nan"), 1.0, 1.0 + 1e-12, 1.0 + 2e-12, 0.0, -1.0, 5e-324, None, float("inf")]
    df = spark.createDataFrame([(1, k, v) for k, v in enumerate(values)], "g int, s int, x double")
    got = {r["s"]: r["r"] for r in xsec.average_rank(df, ["g"], "x", "r").collect()}
    assert got == {1: 1.0, 7: 2.0, 6: 3.0, 8: 4.0, 3: 5.0, 4: 6.0, 5: 7.0, 0: 8.5, 10: 8.5, 2: 10.0, 9: None}
    order = {r["s"]: r["r"] for r in xsec.ordinal_rank(df, ["g"], "x", "s", "r").collect()}
    assert [s for s, _ in sorted(((s, r) for s, r in order.items() if r), key=lambda x: x[1])] == [1, 7, 6, 8, 3, 4, 5, 0, 10, 2]


def test_nearest_rank(sample):
    pdf, df = sample
    got = aggregates.nearest_rank(df, ["g"], "y", {"p95": 0.95}).toPandas().set_index("g")["p95"]
    for g, part in pdf.groupby("g"):
        v = np.sort(part["y"].to_numpy())
        assert got[g] == v[round(0.95 * (len(v) - 1))]


def test_chained_selection_equals_loop(spark):
    rng = np.random.default_rng(3)
    rows = []
    for m in range(12):
        for r, s in enumerate(rng.permutation(60), 1):
            rows.append(("a", pd.Timestamp(2020, m + 1, 28).date(), int(s), r))
    df = spark.createDataFrame(rows, "arm string, signal_date date, symbol int, rank int")
    got = select.chained_selection(df, 10, 18).toPandas()
    held: set = set()
    for day, part in pd.DataFrame(rows, columns=["arm", "d", "symbol", "rank"]).groupby("d"):
        part = part.sort_values("rank")
        kept = [s for s, r in zip(part["symbol"], part["rank"]) if s in held and r <= 18][:10]
        fill = [s for s in part["symbol"] if s not in kept][: 10 - len(kept)]
        mine = got[got["signal_date"] == day]
        assert set(mine["symbol"]) == set(kept) | set(fill)
        assert set(mine.loc[mine["selection_reason"] == "HOLD_BUFFER", "symbol"]) == set(kept)
        held = set(kept) | set(fill)
    one = select.buffered_top_n(
        df.where("signal_date = DATE'2020-02-28'"),
        df.where("signal_date = DATE'2020-01-28' AND rank <= 10").select(F.lit("2020-02-28").cast("date").alias("signal_date"), "symbol"), 10, 18,
    ).toPandas()
    assert set(one["symbol"]) == set(got.loc[got["signal_date"] == pd.Timestamp(2020, 2, 28).date(), "symbol"])


def test_pairwise_covariance_equals_pandas(spark):
    rng = np.random.default_rng(9)
    days = pd.date_range("2020-01-01", periods=150)
    pdf = pd.DataFrame(rng.normal(5, 1, (150, 6)), index=days, columns=list("abcdef"))
    pdf[rng.random(pdf.shape) < 0.2] = np.nan
    pdf["e"] = np.where(np.arange(150) < 40, pdf["e"], np.nan)
    long = pdf.rename_axis("date").reset_index().melt("date", var_name="s", value_name="r").dropna()
    df = spark.createDataFrame(long).withColumn("date", F.to_date("date")).repartition(5)
    seen = pdf.notna().astype(int)
    for minimum, names in ((30, None), (2, list("adf"))):
        got = {(r["s1"], r["s2"]): (r["observations"], r["covariance"]) for r in aggregates.pairwise_cov(df, "s", "date", "r", minimum, names).collect()}
        part = pdf[names or list("abcdef")]
        cov, n = part.cov(), seen[part.columns].T @ seen[part.columns]
        want = {(a, b) for a in part for b in part if a <= b and n.loc[a, b] >= minimum}
        assert set(got) == want
        for (a, b), (count, value) in got.items():
            assert count == n.loc[a, b] and abs(value - cov.loc[a, b]) < 1e-12


def test_covariance_refuses_long_lists_and_takes_empty_tables(spark):
    df = spark.range(20).selectExpr("id AS s", "DATE'2020-01-01' AS date", "1.0D AS r")
    with pytest.raises(ValueError):
        aggregates.pairwise_cov(df, "s", "date", "r", 1, most=10)
    assert aggregates.pairwise_cov(df.where("false"), "s", "date", "r", 1).count() == 0
    p = aggregates.pairwise_cov(df, "s", "date", "r", 1)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in p and "Cartesian" not in p
