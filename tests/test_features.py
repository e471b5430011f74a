"""Rolling features against pandas, and the rule that the future changes nothing before it."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import features, panel, calendar


@pytest.fixture(scope="module")
def bars(spark):
    rng = np.random.default_rng(11)
    parts = []
    days = pd.bdate_range("2018-01-01", periods=330).date
    for symbol, missing in ((1, 0.0), (2, 0.02), (3, 0.0)):
        close = 10 * np.exp(np.cumsum(rng.normal(0, 0.02, len(days))))
        close[rng.random(len(days)) < missing] = np.nan
        parts.append(pd.DataFrame({"symbol": symbol, "date": days, "total_close": close, "amount": rng.random(len(days)) * 1e6, "volume": 1000.0}))
    pdf = pd.concat(parts, ignore_index=True)
    df = spark.createDataFrame(pdf).withColumn("total_close", F.when(~F.isnan("total_close"), F.col("total_close"))).cache()
    return pdf, df


def by_hand(pdf):
    out = []
    for _, g in pdf.groupby("symbol"):
        g, p = g.copy(), g["total_close"]
        r = p.pct_change(fill_method=None)
        g["return_1d"] = r
        g["mom_12_1"] = p.shift(21) / p.shift(252) - 1
        g["mom_6_1"] = p.shift(21) / p.shift(126) - 1
        g["ma_200"] = p.rolling(200, min_periods=200).mean()
        g["trend"] = p / g["ma_200"] - 1
        g["volatility"] = r.rolling(60, min_periods=50).std(ddof=0) * np.sqrt(252)
        g["downside_volatility"] = np.sqrt(r.clip(upper=0).pow(2).rolling(60, min_periods=50).mean()) * np.sqrt(252)
        frac = lambda m: m.astype(float).where(r.notna()).shift(21).rolling(231, min_periods=231).mean()
        g["information_discreteness"] = np.sign(g["mom_12_1"]) * (frac(r < 0) - frac(r > 0))
        g["fip_momentum"] = g["mom_12_1"] * (1 - g["information_discreteness"])
        g["drawdown_quality"] = p / p.rolling(126, min_periods=126).max() - 1
        out.append(g)
    return pd.concat(out).sort_values(["symbol", "date"]).reset_index(drop=True)


COLUMNS = ["return_1d", "mom_12_1", "mom_6_1", "ma_200", "trend", "volatility", "downside_volatility",
           "information_discreteness", "fip_momentum", "drawdown_quality"]


def test_price_features_equal_pandas(bars):
    pdf, df = bars
    got = features.price_features(df).toPandas().sort_values(["symbol", "date"]).reset_index(drop=True)
    want = by_hand(pdf)
    for c in COLUMNS:
        np.testing.assert_allclose(got[c].to_numpy(float), want[c].to_numpy(float), atol=1e-9, equal_nan=True, err_msg=c)
    assert got["information_discreteness"].notna().any()


def test_look_back_that_is_no_multiple_of_a_block(bars):
    pdf, df = bars
    got = features.price_features(df, vol_lookback=47).orderBy("symbol", "date").toPandas()
    r = pdf.sort_values(["symbol", "date"]).groupby("symbol")["total_close"].transform(lambda p: p.pct_change(fill_method=None))
    roll = lambda x, f: f(x.groupby(pdf["symbol"]).rolling(47, min_periods=37)).to_numpy(float) * np.sqrt(252)
    np.testing.assert_allclose(got["volatility"].to_numpy(float), roll(r, lambda x: x.std(ddof=0)), atol=1e-9, equal_nan=True)
    down = roll(r.clip(upper=0).pow(2), lambda x: np.sqrt(x.mean()))
    np.testing.assert_allclose(got["downside_volatility"].to_numpy(float), down, atol=1e-9, equal_nan=True)


def test_no_look_ahead(bars):
    _, df = bars
    cut = dt.date(2019, 3, 1)
    later = df.withColumn("total_close", F.when(F.col("date") > cut, F.col("total_close") * 50).otherwise(F.col("total_close")))
    before = lambda x: features.price_features(x).where(F.col("date") <= cut).orderBy("symbol", "date").select(*COLUMNS).toPandas()
    np.testing.assert_allclose(before(later).to_numpy(float), before(df).to_numpy(float), atol=1e-12, equal_nan=True)


def test_range_with_warmup_equals_full_run(bars):
    _, df = bars
    full = features.price_features(df).where("date >= DATE'2019-03-01'").orderBy("symbol", "date").toPandas()
    part = features.price_features(df, start="2019-03-01").orderBy("symbol", "date").toPandas()
    np.testing.assert_allclose(part[COLUMNS].to_numpy(float), full[COLUMNS].to_numpy(float), equal_nan=True)


def test_sparse_symbols_keep_their_history(spark):
    days = [dt.date(2015, 1, 1) + dt.timedelta(days=5 * k) for k in range(330)]
    df = spark.createDataFrame([(1, d, 10.0 + k % 7) for k, d in enumerate(days)], "symbol int, date date, total_close double")
    full = features.price_features(df).where(F.col("date") >= days[253])
    part = features.price_features(df, start=str(days[253]))
    count = lambda x: x.agg(F.count("mom_12_1"), F.count("ma_200")).first()
    assert count(part) == count(full) == (77, 77)


def test_availability_of_dates_before_the_calendar(spark, business_days):
    rows = [(dt.date(1850, 5, 1),), (dt.date(2019, 12, 31),), (dt.date(2020, 1, 1),), (dt.date(2020, 1, 4),), (dt.date(2021, 5, 1),)]
    df = spark.createDataFrame(rows, "d date")
    want = {0: [1, 1, 1, 6, None], 1: [1, 1, 2, 6, None], 2: [2, 2, 3, 7, None]}
    for lag, found in want.items():
        got = {r["d"]: r["a"] for r in calendar.with_availability(df, business_days, "d", lag, "a").collect()}
        assert [got[d] and got[d].day for (d,) in rows] == found
    old = calendar.calendar(spark.createDataFrame([(dt.date(1850, 5, 1),), (dt.date(2300, 1, 1),)], "date date"))
    assert old.count() == 2


def test_liquidity_and_regime(spark, bars):
    pdf, df = bars
    got = features.liquidity_features(df).where("symbol = 1").orderBy("date").toPandas()
    want = pdf[pdf.symbol == 1]["amount"].rolling(20, min_periods=15).mean()
    np.testing.assert_allclose(got["avg_amount_20"], want, equal_nan=True)
    index = df.where("symbol = 1").select("date", F.col("total_close").alias("close"))
    labels = features.regime(index, ma_days=50).orderBy("date").toPandas()
    assert (labels["regime"][:49] == "RISK_OFF").all() and set(labels["regime"]) == {"RISK_ON", "RISK_OFF"}


def test_fill_limits(spark):
    rows = [("A", dt.date(2020, 1, i + 1), v) for i, v in enumerate([1.0, None, None, None, 5.0])]
    g = spark.createDataFrame(rows, "symbol string, date date, p double")
    values = lambda k: [r["f"] for r in features.ffill(g, "p", k, "f").orderBy("date").collect()]
    assert values(2) == [1.0, 1.0, 1.0, None, 5.0]
    assert values(0) == [1.0, None, None, None, 5.0]
    assert values(None) == [1.0, 1.0, 1.0, 1.0, 5.0]


def test_forward_returns_with_stale_limit(spark):
    days = [d.date() for d in pd.bdate_range("2020-01-01", periods=60)]
    cal = calendar.calendar(spark.createDataFrame([(d,) for d in days], "date date"))
    bars = spark.createDataFrame([("A", days[i], 10.0 + i) for i in (0, 1, 5, 30)], "symbol string, date date, total_close double")
    m = spark.createDataFrame([(days[5], "A"), (days[8], "A")], "signal_date date, symbol string")
    got = {r["signal_date"]: r for r in panel.forward_returns(m, bars, cal, [3, 20, 25], 10).collect()}
    assert got[days[5]]["forward_return_3d"] == pytest.approx(0.0)  # carried 3 days
    assert got[days[5]]["forward_return_20d"] is None  # last bar 20 days old
    assert got[days[5]]["forward_return_25d"] == pytest.approx(40 / 15 - 1)
    assert got[days[8]]["outcome_date_20d"] == days[28]


def test_labels_in_one_pass_equal_the_two_lookups(spark):
    days = [d.date() for d in pd.bdate_range("2020-01-01", periods=60)]
    cal = calendar.calendar(spark.createDataFrame([(d,) for d in days], "date date"))
    # day 6 has two bars: the larger counts, as in any as-of join
    bars = [(s, days[i], 10.0 + i * k) for s, k in (("A", 1), ("B", 2)) for i in (0, 1, 5, 6, 30, 41)] + [("A", days[6], 99.0)]
    bars = spark.createDataFrame(bars, "symbol string, date date, total_close double")
    m = spark.createDataFrame([(days[i], s) for i in (5, 8, 28, 50) for s in "ABC"], "signal_date date, symbol string")
    signals = m.select("signal_date").distinct()
    one = panel.forward_labels(m, bars, cal, [3, 20], signals, 10)
    two = panel.forward_returns(m, bars, cal, [3, 20], 10).join(panel.next_signal_return(m, bars, cal, signals, 10), ["signal_date", "symbol"])
    rows = lambda df: sorted(map(tuple, df.select(*two.columns).collect()), key=str)
    assert rows(one) == rows(two) and len(rows(one)) == 12
    got = {(r["signal_date"], r["symbol"]): r for r in one.collect()}
    assert got[days[8], "A"]["forward_return_3d"] == 0.0 and got[days[5], "A"]["forward_return_next_signal"] == pytest.approx(99 / 15 - 1)
