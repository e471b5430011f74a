"""Allocation invariants and execution arithmetic."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import execution as ex
from tidemark.operators import performance, portfolio

D = dt.date


def root(f, goal):
    """Where a rising function reaches the goal, by halving; None if it does not."""
    lo, hi = 0.0, 1e9
    if f(hi) < goal - 1e-12:
        return None
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if f(mid) >= goal else (mid, hi)
    return hi


def slow_fill(pref, total, cap, group, gcap):
    """Weights by growing time: every name at its pace until it, its group or the total is full."""
    pref = np.clip(np.nan_to_num(np.asarray(pref, float)), 0, None)
    group = np.asarray(group)
    done = np.zeros(len(pref))
    goal = min(total, len(pref) * cap, len(set(group)) * gcap)
    for pace in (pref, (pref <= 0).astype(float)):
        if done.sum() >= goal - 1e-12:
            break
        room = np.where(pace > 0, cap, 0.0)
        for g in set(group):
            mine = group == g
            t = root(lambda x: np.minimum(room, pace * x)[mine].sum(), max(0.0, gcap - done[mine].sum()))
            if t is not None:
                room[mine] = np.minimum(room, pace * t)[mine]
        left = goal - done.sum()
        t = root(lambda x: np.minimum(room, pace * x).sum(), left)
        done = done + (room if t is None else np.minimum(room, pace * t))
    return done


def fill(spark, cases):
    rows = [(k, i, float(p), str(g), float(total), float(cap), float(gcap)) for k, (pref, total, cap, group, gcap) in enumerate(cases) for i, (p, g) in enumerate(zip(pref, group))]
    df = spark.createDataFrame(rows, "k int, symbol int, p double, g string, total double, cap double, gcap double")
    out = {}
    for cap, gcap in {(c[2], c[4]) for c in cases}:
        part = df.where((F.col("cap") == cap) & (F.col("gcap") == gcap))
        for r in portfolio.fill_weights(part, ["k"], F.col("p"), F.col("total"), "w", cap, "g", gcap).collect():
            out[r["k"], r["symbol"]] = r["w"]
    return [np.array([out[k, i] for i in range(len(c[0]))]) for k, c in enumerate(cases)]


def test_fill_literal(spark):
    (w,) = fill(spark, [([10, 3, 1, 0.5], 0.6, 0.2, "aaaa", 1.0)])
    assert w.sum() == pytest.approx(0.6) and w.max() <= 0.2 + 1e-12
    # names below the cap keep their proportions
    assert w[2] / w[3] == pytest.approx(2.0)


def test_fill_equals_growing_in_time(spark):
    rng = np.random.default_rng(3)
    caps = [(0.05, 0.15), (0.2, 0.3), (0.1, 1.0)]
    cases = [([0.0, float("nan")], 0.2, 0.5, "ab", 0.5), ([1.0], 0.0, 0.1, "a", 0.3), ([5.0, 1.0, 0.0, 0.0], 0.9, 0.2, "aabb", 0.3)]
    for k in range(45):
        n = int(rng.integers(1, 25))
        cases.append((rng.random(n) * rng.integers(0, 2, n), rng.random(), *caps[k % 3][:1], rng.choice(list("abcd"), n), caps[k % 3][1]))
    for (pref, total, cap, group, gcap), w in zip(cases, fill(spark, cases)):
        np.testing.assert_allclose(w, slow_fill(pref, total, cap, list(group), gcap), atol=1e-9)
        sums = pd.Series(w).groupby(list(group)).sum()
        assert w.min() >= 0 and w.max() <= cap + 1e-9 and sums.max() <= gcap + 1e-9


def test_variance_leaning():
    rng = np.random.default_rng(2026)
    a = rng.normal(0, 0.01, 160)
    h = np.stack((a, a + rng.normal(0, 0.001, 160), rng.normal(0, 0.01, 160)), axis=1)
    h[:20, 1] = np.nan
    cov, n = portfolio.pairwise_moments(h)
    np.testing.assert_allclose(cov, pd.DataFrame(h).cov().to_numpy())
    lean, seen, status = portfolio.variance_leaning(h, 60, 0.5, 1e-6)
    assert (seen, status) == (140, "applied") and lean[2] > lean[0] and lean[2] > lean[1]
    half = np.where(np.eye(3) > 0, cov, cov / 2)
    want = np.linalg.solve(half, np.ones(3))
    np.testing.assert_allclose(lean, want / want.sum(), atol=1e-9)
    assert portfolio.variance_leaning(h[:30], 60, 0.5, 1e-6)[2] == "fallback_insufficient_covariance"
    h[:, 2] = 0
    assert portfolio.variance_leaning(h, 60, 0.5, 1e-6)[0] is None


@pytest.fixture(scope="module")
def picks(spark):
    rng = np.random.default_rng(1)
    days = [d.date() for d in pd.bdate_range("2020-01-01", periods=140)]
    rows, sel = [], []
    for s in range(12):
        rows += [(s, d, float(r)) for d, r in zip(days, rng.normal(0, 0.01 * (1 + s % 3), len(days)))]
        sel.append((days[-1], s, "abc"[s % 3], 0.1 + 0.02 * s, 0.05 if s % 2 else 0.0))
    f = spark.createDataFrame(rows, "symbol int, date date, return_1d double")
    p = spark.createDataFrame(sel, "signal_date date, symbol int, industry_code string, volatility double, current_weight double")
    p = portfolio.feasible_exposure(portfolio.risk_preference(p), ["signal_date"], F.lit(0.95))
    return p, f, days


def test_minimum_variance_weights(picks):
    p, f, days = picks
    t = portfolio.trailing_returns(p, f, 120)
    assert all(len(r["returns"]) == 120 and r["returns"][-1]["date"] == days[-1] for r in t.collect())
    out = portfolio.minimum_variance_weights(t, ["signal_date"]).toPandas()
    assert (out["portfolio_status"] == "applied").all() and (out["covariance_observations"] == 120).all()
    assert out["target_weight"].max() <= 0.08 + 1e-9
    assert out.groupby("industry_code")["target_weight"].sum().max() <= 0.25 + 1e-9
    assert out["target_weight"].sum() == pytest.approx(min(0.95, 12 * 0.08, 3 * 0.25))
    short = portfolio.minimum_variance_weights(portfolio.trailing_returns(p, f, 40), ["signal_date"]).toPandas()
    assert (short["portfolio_status"] == "fallback_insufficient_covariance").all()
    plain = portfolio.capped_weights(p, ["signal_date"]).toPandas().set_index("symbol")["target_weight"]
    np.testing.assert_allclose(short.set_index("symbol")["target_weight"].sort_index(), plain.sort_index())


def test_future_returns_do_not_change_weights(spark, picks):
    p, f, days = picks
    extra = f.select("symbol", F.date_add("date", 400).alias("date"), (F.col("return_1d") * 50).alias("return_1d"))
    w = lambda x: portfolio.minimum_variance_weights(portfolio.trailing_returns(p, x), ["signal_date"]).toPandas().set_index("symbol")["target_weight"].sort_index()
    np.testing.assert_allclose(w(f.unionByName(extra)), w(f), atol=1e-12)


def test_overdrawn_book_is_scaled_to_zero_cash(spark):
    day = D(2020, 1, 31)
    book = spark.createDataFrame([(day, 0.60, 0.60, True), (day, 0.35, 0.0, False), (day, 0.0, 0.40, False)], "signal_date date, current_weight double, target_weight double, locked boolean")
    rates = spark.createDataFrame([(day, 0.001, 0.002)], "signal_date date, buy_rate double, sell_rate double")
    r = portfolio.affordable_scale(book, rates, ["signal_date"]).first()
    x = 0.40 * r["executable_scale"]
    assert 0.99 < r["executable_scale"] < 1 and abs(1 - 0.6 - x - 0.001 * x - 0.002 * 0.35) < 1e-12
    easy = portfolio.affordable_scale(book.withColumn("target_weight", F.when(F.col("locked"), 0.6).otherwise(0.1)), rates, ["signal_date"]).first()
    assert easy["executable_scale"] == 1.0


def test_scale_equals_halving(spark):
    rng = np.random.default_rng(4)
    books = []
    for k in range(40):
        n = int(rng.integers(1, 12))
        now, goal = rng.random(n) * rng.integers(0, 2, n), rng.random(n) * rng.integers(0, 2, n)
        now, goal = now / max(now.sum(), 1), goal / max(goal.sum(), 1) * (1 + 0.2 * (k % 3))
        books.append((now, goal, rng.random(n) < 0.2, 0.001 * k, 0.002 * k))
    rows = [(k, *map(float, x[:2]), bool(x[2])) for k, b in enumerate(books) for x in zip(*b[:3])]
    df = spark.createDataFrame(rows, "k int, current_weight double, target_weight double, locked boolean")
    rates = spark.createDataFrame([(k, float(b[3]), float(b[4])) for k, b in enumerate(books)], "k int, buy_rate double, sell_rate double")
    got = {r["k"]: r for r in portfolio.affordable_scale(df, rates, ["k"]).collect()}
    for k, (now, goal, locked, buy, sell) in enumerate(books):
        def cash(s):
            held = np.where(locked, now, goal * s)
            return 1 - held.sum() - buy * np.clip(held - now, 0, None).sum() - sell * np.clip(now - held, 0, None).sum()

        want = 1.0 if cash(1.0) >= -1e-12 else 1.0 - root(lambda x: cash(1.0 - x), 0.0) if cash(0.0) >= 0 else 0.0
        assert got[k]["executable_scale"] == pytest.approx(want, abs=1e-9) and got[k]["cash"] == pytest.approx(max(0.0, cash(want)), abs=1e-9)


def test_fifo_equals_a_ledger(spark):
    buys = [("A", D(2020, 1, 1), D(2020, 1, 2), 100.0), ("A", D(2020, 1, 3), D(2020, 1, 6), 50.0), ("A", D(2020, 1, 7), D(2020, 1, 8), 80.0)]
    sells = [("A", D(2020, 1, 4), 60.0), ("A", D(2020, 1, 6), 70.0), ("A", D(2020, 1, 9), 100.0)]
    got = ex.fifo_match(
        spark.createDataFrame(buys, "symbol string, date date, sellable_date date, shares double"),
        spark.createDataFrame(sells, "symbol string, date date, shares double"),
    ).orderBy("sell_date", "buy_date").collect()
    assert [(r["buy_date"].day, r["sell_date"].day, r["shares"]) for r in got] == [
        (1, 4, 60.0), (1, 6, 40.0), (3, 6, 30.0), (3, 9, 20.0), (7, 9, 80.0)
    ]


def test_fifo_after_an_oversold_day(spark):
    buys = spark.createDataFrame([("A", D(2020, 1, 1), D(2020, 1, 2), 100.0), ("A", D(2020, 1, 3), D(2020, 1, 6), 100.0)], "symbol string, date date, sellable_date date, shares double")
    sells = spark.createDataFrame([("A", D(2020, 1, 3), 150.0), ("A", D(2020, 1, 7), 100.0), ("A", D(2020, 1, 8), 10.0)], "symbol string, date date, shares double")
    got = ex.fifo_match(buys, sells).orderBy("sell_date").collect()
    assert [(r["buy_date"].day, r["sell_date"].day, r["shares"]) for r in got] == [(1, 3, 100.0), (3, 7, 100.0)]
    rest = ex.oversold(buys, sells).orderBy("date").collect()
    assert [(r["date"].day, r["shares"]) for r in rest] == [(3, 50.0), (8, 10.0)]


def test_fifo_equals_a_ledger_with_oversold_days(spark):
    rng = np.random.default_rng(9)
    day = lambda k: D(2020, 1, 1) + dt.timedelta(days=int(k))
    buys = [("A", day(k), day(k + 1 + k % 2), float(rng.integers(0, 30) * 10)) for k in range(40) if rng.random() < 0.6]
    buys = [b for b in buys if b[3]]
    sells = [("A", day(k), float(rng.integers(1, 35) * 10)) for k in range(45) if rng.random() < 0.6]
    lots = [[d, at, n] for _, d, at, n in sorted(buys, key=lambda b: (b[2], b[1]))]
    want = []
    for _, when, n in sells:
        for lot in lots:
            take = min(n, lot[2]) if lot[1] <= when else 0
            if take:
                want.append((lot[0], when, take))
                lot[2] -= take
                n -= take
    got = ex.fifo_match(
        spark.createDataFrame(buys, "symbol string, date date, sellable_date date, shares double"), spark.createDataFrame(sells, "symbol string, date date, shares double")
    ).collect()
    assert sorted((r["buy_date"], r["sell_date"], r["shares"]) for r in got) == sorted(want)


def test_fills_without_liquidity_or_cash(spark):
    rows = [(1, "BUY", 1000.0, 10.0, None, 1e9), (2, "BUY", 1000.0, 10.0, 1e9, 2010.0), (3, "BUY", 1000.0, 10.0, 1e9, 50.0), (4, "SELL", 100.0, 10.0, 1e9, 0.0), (5, "BUY", 1000.0, 10.0, 20000.0, 1e9)]
    df = spark.createDataFrame(rows, "k int, side string, desired double, price double, lagged_adv20 double, cash double").selectExpr("*", "desired AS held", "0D AS target", "0.0D AS transfer_fee_rate")
    got = {r["k"]: (r["filled"], r["status"], r["reason"]) for r in ex.fill_once(df).collect()}
    assert got == {
        1: (0.0, "REJECTED", "missing_signal_liquidity"), 2: (200.0, "PARTIAL", ""), 3: (0.0, "REJECTED", "insufficient_cash"), 4: (100.0, "FILLED", ""), 5: (100.0, "PARTIAL", ""),
    }


def test_order_reasons_keep_their_order(spark):
    day = D(2020, 1, 2)
    orders = spark.createDataFrame([(s, day, "BUY") for s in range(5)] + [(5, day, "SELL")], "symbol int, date date, side string")
    bars = spark.createDataFrame(
        [(day, 1, 10.0, 100.0, True, 10.0, 9.0), (day, 2, 10.0, 100.0, False, 10.004, 9.0), (day, 3, 10.0, 0.0, False, 11.0, 9.0),
         (day, 4, 10.0, 5.0, False, 11.0, 9.0), (day, 5, 9.0, 5.0, False, 11.0, 9.0)],
        "date date, symbol int, open double, volume double, is_st boolean, up_limit double, down_limit double",
    )
    sec = spark.createDataFrame([(0, D(2021, 1, 1), None), (4, None, D(2019, 1, 1))], "symbol int, list_date date, delist_date date")
    got = {r["symbol"]: r["reason"] for r in ex.classify_orders(orders, bars, sec).collect()}
    assert got == {0: "not_listed", 1: "st_on_execution", 2: "open_at_up_limit", 3: "suspended_or_no_bar", 4: "delisted", 5: "open_at_down_limit"}


def test_impact_floor_and_cap(spark):
    df = spark.createDataFrame([(None, 0.01), (0.32, 0.04), (5.0, 1.0)], "v double, p double")
    got = [r[0] for r in df.select(ex.impact_bps(F.col("v"), F.col("p"))).collect()]
    assert got[0] == pytest.approx(0.5 * 0.10 / 252**0.5 * 0.1 * 1e4)
    assert got[1] == pytest.approx(0.5 * 0.32 / 252**0.5 * 0.2 * 1e4) and got[2] == 50.0


def test_compound_metrics_and_drawdown(spark):
    df = spark.createDataFrame([("a", D(2020, i + 1, 1), r) for i, r in enumerate([0.1, -0.2, 0.05])] + [("b", D(2020, 1, 1), -1.0)], "f string, signal_date date, r double")
    got = {x["f"]: x for x in performance.compound_metrics(df, ["f"], "r", "n").collect()}
    total = 1.1 * 0.8 * 1.05
    assert got["a"]["n_cumulative_return"] == pytest.approx(total - 1)
    assert got["a"]["n_annualized_return"] == pytest.approx(total**4 - 1)
    assert got["a"]["n_maximum_drawdown"] == pytest.approx(0.8 - 1)
    assert got["b"]["n_cumulative_return"] is None
