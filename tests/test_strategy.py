"""The monthly selection: picks, weights, regime and weight changes against a plain loop."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from test_portfolio_and_execution import slow_fill
from tidemark.operators import asof
from tidemark.plans import price_scores, strategy


def test_monthly_selection_equals_a_loop(spark):
    rng = np.random.default_rng(8)
    months = [dt.date(2020, m, 28) for m in range(1, 7)]
    rows = [(d, s, float(rng.normal()), "abcd"[s % 4], float(0.1 + rng.random())) for d in months for s in range(40)]
    pdf = pd.DataFrame(rows, columns=["signal_date", "symbol", "score", "industry_code", "volatility"])
    scored = spark.createDataFrame(pdf[["signal_date", "symbol", "score", "industry_code"]], "signal_date date, symbol long, score double, industry_code string")
    feats = spark.createDataFrame(
        pdf[["signal_date", "symbol", "volatility"]].assign(close=10.0, total_mv=1.0),
        "signal_date date, symbol long, volatility double, close double, total_mv double",
    )
    # the index turns on from March; January and February predate it or are off
    regime = spark.createDataFrame([(dt.date(2020, 2, 3), "RISK_OFF", 0.30), (dt.date(2020, 3, 2), "RISK_ON", 0.95)], "date date, regime string, exposure double")
    got = strategy.monthly_selection(scored, feats, regime, None, top_n=12, exit_rank=18).toPandas()
    held, before = set(), {}
    for day in months:
        part = pdf[pdf["signal_date"] == day].sort_values(["score", "symbol"], ascending=[False, True]).reset_index(drop=True)
        part["rank"] = range(1, len(part) + 1)
        kept = part[part["symbol"].isin(held) & (part["rank"] <= 18)].head(12)
        fill = part[~part["symbol"].isin(kept["symbol"])].head(12 - len(kept))
        want = pd.concat([kept, fill]).sort_values("symbol")
        exposure = 0.95 if day.month >= 3 else 0.30
        total = min(exposure, 12 * 0.08, want["industry_code"].nunique() * 0.25)
        w = slow_fill(1 / want["volatility"].to_numpy(), total, 0.08, want["industry_code"].to_numpy(), 0.25)
        mine = got[got["signal_date"] == day].sort_values("symbol")
        assert list(mine["symbol"]) == list(want["symbol"]) and list(mine["rank"]) == list(want["rank"])
        assert set(mine.loc[mine["selection_reason"] == "HOLD_BUFFER", "symbol"]) == set(kept["symbol"])
        assert set(mine["regime"]) == {"RISK_ON" if day.month >= 3 else "RISK_OFF"}
        np.testing.assert_allclose(mine["target_weight"], w, atol=1e-12)
        assert mine["target_exposure"].iloc[0] == pytest.approx(w.sum())
        change = [x - before.get(s, 0.0) for s, x in zip(want["symbol"], w)]
        np.testing.assert_allclose(mine["target_weight_change"], change, atol=1e-12)
        held, before = set(want["symbol"]), dict(zip(want["symbol"], w))


def test_candidates_are_members_with_a_recent_bar(spark):
    day = dt.date
    first, second = day(2020, 1, 31), day(2020, 2, 28)
    rows = [(s, d, d - dt.timedelta(days=age)) for s, age in ((1, 0), (2, 3), (3, 10), (4, 11), (5, 0)) for d in (first, second)]
    values = {"total_mv": 5.0, "history_days": 300, "avg_amount_20": 1e9, "close": 10.0, "is_st": False, "extra": "kept"}
    features = spark.createDataFrame(rows, "symbol long, signal_date date, date date").withColumns(
        {k: F.lit(v) for k, v in values.items()} | {c: F.lit(0.1) for c in price_scores.REQUIRED if c not in values and c != "log_total_mv"}
    )
    industries = spark.createDataFrame([(s, "I", "one", day(2000, 1, 1), None) for s in range(1, 6)], "symbol long, industry_code string, industry_name string, in_date date, out_date date")
    seats = [(day(2020, 1, 15), s) for s in (1, 2, 3, 4)] + [(day(2020, 1, 15), 1), (second, 5), (second, 3)]
    members = asof.latest_snapshot(features.select("signal_date"), spark.createDataFrame(seats, "date date, symbol long"))
    pick = lambda **o: sorted((r["signal_date"], r["symbol"]) for r in price_scores.candidates(features, industries, **o).collect())
    assert len(pick()) == 10
    assert pick(members=members) == [(first, s) for s in (1, 2, 3, 4)] + [(second, 3), (second, 5)]
    assert pick(members=members, max_age_days=10) == [(first, s) for s in (1, 2, 3)] + [(second, 3), (second, 5)]
    assert pick(max_age_days=0) == [(d, s) for d in (first, second) for s in (1, 5)]
    assert pick(members=members.where("false")) == []
    top = lambda: [(r["signal_date"], r["symbol"], r["rank"]) for r in price_scores.monthly_top(features, industries, 2, digits=9, members=members).orderBy("signal_date", "rank").collect()]
    assert top() == [(first, 1, 1), (first, 2, 2), (second, 3, 1), (second, 5, 2)]
