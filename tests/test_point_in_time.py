"""Visibility rules on literal facts."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof, calendar, pit

D = dt.date


def available(spark, cal, day, lag):
    df = spark.createDataFrame([(day,)], "d date")
    return calendar.with_availability(df, cal, "d", lag).first()["available_date"]


def test_availability_lags(spark, business_days):
    assert available(spark, business_days, D(2020, 3, 31), 0) == D(2020, 3, 31)
    assert available(spark, business_days, D(2020, 3, 31), 1) == D(2020, 4, 1)
    assert available(spark, business_days, D(2020, 4, 4), 0) == D(2020, 4, 6)  # Saturday
    assert available(spark, business_days, D(2020, 4, 4), 1) == D(2020, 4, 6)
    assert available(spark, business_days, D(2020, 3, 31), 3) == D(2020, 4, 3)
    assert available(spark, business_days, D(2020, 12, 31), 1) is None
    assert available(spark, business_days, D(2019, 6, 1), 0) == D(2020, 1, 1)
    assert available(spark, business_days, D(2019, 6, 1), 2) == D(2020, 1, 2)
    assert available(spark, business_days, None, 1) is None
    with pytest.raises(ValueError):
        calendar.availability_map(business_days, -1)


@pytest.fixture(scope="module")
def facts(spark, business_days):
    rows = [
        ("600000.SH", "20200331", None, "20191231", "1", "1", "0", "100", "10"),
        ("600000.SH", "20200331", "20200415", "20191231", "1", "1", "1", "110", "11"),
        ("600000.SH", "20200331", "20200415", "20191231", "1", "1", "1", "110", "11"),  # same row again
        ("600000.SH", "20200430", None, "20200331", "1", "1", "0", "130", "13"),
        ("600000.SH", "20200601", None, "20191231", "1", "1", "1", "999", "99"),  # old period, revised late
        ("600000.SH", "20200601", None, "20191231", "1", "1", "1", "nan", "inf"),  # nothing usable
    ]
    raw = spark.createDataFrame(
        rows,
        "ts_code string, ann_date string, f_ann_date string, end_date string, report_type string, comp_type string, "
        "update_flag string, revenue string, n_income_attr_p string",
    )
    return pit.normalise_statements(raw, "income", business_days, 1).cache()


def value(facts, when, metric="revenue", age=None):
    row = pit.fact_snapshot(facts, when, ["revenue", "net_income_parent"], age).first()
    return row[metric] if row else None


def test_revisions_are_dense_and_duplicates_drop(facts):
    got = [
        (r["revision_sequence"], r["value"])
        for r in facts.where("metric = 'revenue' AND period_end = DATE'2019-12-31'").orderBy("revision_sequence").collect()
    ]
    assert got == [(1, 100.0), (2, 110.0), (3, 999.0)]
    assert facts.select("unit").distinct().collect()[0][0] == "CNY"


def test_same_day_announcement_is_invisible(facts):
    assert value(facts, "2020-03-31") is None
    assert value(facts, "2020-04-01") == 100.0


def test_later_of_two_announcement_dates_counts(facts):
    assert value(facts, "2020-04-15") == 100.0
    assert value(facts, "2020-04-16") == 110.0


def test_late_revision_of_old_period_does_not_replace_newer(facts):
    assert value(facts, "2020-05-04") == 130.0
    assert value(facts, "2020-07-01") == 130.0


def test_age_limit_counts_from_period_end(facts):
    assert value(facts, "2020-12-31", age=200) is None
    assert value(facts, "2020-12-31", age=300) == 130.0


def test_many_dates_equal_one_date_at_a_time(spark, facts, business_days):
    days = business_days.where("ord % 9 = 0").select(F.col("date").alias("signal_date"))
    probes = facts.select("symbol").distinct().crossJoin(days)
    for age in (None, 150):
        many = {
            (r["signal_date"], r["metric"]): r["value"] for r in pit.facts_as_of(facts, probes, age).collect()
        }
        for (day,) in days.collect():
            for metric in ("revenue", "net_income_parent"):
                assert many.get((day, metric)) == value(facts, str(day), metric, age)


def test_runs_of_the_frontier_table(facts):
    runs = pit.visibility_runs(facts, 150, ["revenue"]).orderBy("valid_from").collect()
    assert all(a["valid_until"] <= b["valid_from"] for a, b in zip(runs, runs[1:]))
    assert all(r["valid_from"] < r["valid_until"] and (r["valid_until"] - r["period_end"]).days <= 151 for r in runs)
    assert [r["value"] for r in runs] == [100.0, 110.0, 130.0]  # the late revision of the old period begins no run


def test_runs_on_dates_equal_a_loop(spark):
    day = lambda n: n if n is None else D(2020, 1, 1) + dt.timedelta(n)
    runs = [(1, None, 3), (1, 3, 8), (2, 5, None), (3, None, None), (4, 40, 50), (5, -9, -2), (6, 6, 6), (7, 0, 31), (8, 9, 10)]
    dates = [0, 2, 3, 7, 9, 30]
    frame = spark.createDataFrame([(k, day(a), day(b)) for k, a, b in runs], "k int, valid_from date, valid_until date")
    asked = spark.createDataFrame([(day(d),) for d in [*dates, *dates, None]], "signal_date date")
    got = {(r["k"], r["signal_date"]) for r in asof.on_dates(frame, asked).collect()}
    assert got == {(k, day(d)) for k, a, b in runs for d in dates if (a is None or a <= d) and (b is None or d < b)}
    assert asof.on_dates(frame, asked.where("signal_date IS NULL")).count() == 0


def test_value_runs_equal_an_as_of_join(spark):
    right = spark.createDataFrame([(k, D(2020, m, 5), float(m)) for k in (1, 2) for m in (2, 4, 9) if k + m != 4], "k int, d date, v double")
    dates = spark.createDataFrame([(D(2020, m, 1),) for m in range(1, 13)], "signal_date date")
    probes = right.select("k").distinct().crossJoin(dates)
    want = asof.asof_backward(probes, right, ["k"], "signal_date", "d", ["v"]).select("k", "signal_date", "matched_d", "v")
    got = asof.on_dates(asof.value_runs(right, ["k"], "d", ["v"], missing=True), dates).select("k", "signal_date", "matched_d", "v")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert asof.on_dates(asof.value_runs(right, ["k"], "d", ["v"]), dates).where("v IS NULL").count() == 0


def test_future_facts_change_nothing_before_them(spark, facts, business_days):
    probes = spark.createDataFrame([("600000.SH", D(2020, 5, 20))], "symbol string, signal_date date")
    before = pit.facts_as_of(facts, probes).select("metric", "value").orderBy("metric").collect()
    later = facts.withColumn("value", F.when(F.col("available_date") > "2020-05-20", F.lit(-1e9)).otherwise(F.col("value")))
    assert pit.facts_as_of(later, probes).select("metric", "value").orderBy("metric").collect() == before


def test_boundary_day_of_half_open_intervals(spark):
    i = spark.createDataFrame(
        [("A", D(2019, 1, 1), D(2020, 6, 15)), ("B", D(2020, 6, 15), None)], "symbol string, opt_in date, opt_out date"
    )
    s = spark.createDataFrame([(D(2020, 6, 15),)], "signal_date date")
    assert [r["symbol"] for r in asof.members_on(s, i).collect()] == ["B"]


def test_industry_tie_breaks_differ(spark):
    m = spark.createDataFrame([("A", D(2020, 6, 1))], "symbol string, signal_date date")
    i = spark.createDataFrame(
        [("A", "Z9", "closed", D(2020, 1, 1), D(2020, 12, 31)), ("A", "A1", "open", D(2020, 1, 1), None)],
        "symbol string, industry_code string, industry_name string, in_date date, out_date date",
    )
    assert asof.industry_at(m, i, policy="strategy").first()["industry_code"] == "Z9"
    assert asof.industry_at(m, i, policy="research").first()["industry_code"] == "A1"
    late = m.withColumn("signal_date", F.lit("2019-01-01").cast("date"))
    assert asof.industry_at(late, i).first()["industry_code"] == "UNKNOWN"


def test_open_ended_names_and_overrides(spark):
    days = spark.createDataFrame([("A", D(2020, m, 1)) for m in (1, 6, 12)], "symbol string, date date")
    names = spark.createDataFrame(
        [("A", "old", None, D(2020, 6, 30), 1), ("A", "ST mid", D(2020, 5, 1), D(2020, 7, 1), 2)],
        "symbol string, name string, start_date date, end_date date, input_ord int",
    )
    got = {r["date"].month: r["name"] for r in asof.name_at(days, names).collect()}
    assert got == {1: "old", 6: "ST mid", 12: None}


def test_asof_forms_agree(spark):
    left = spark.range(400).select((F.col("id") % 7).alias("k"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") * 13 % 365).cast("int")).alias("d")).distinct()
    right = spark.range(90).select((F.col("id") % 6).alias("k"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") * 29 % 365).cast("int")).alias("t"), F.col("id").alias("v"))
    right = asof.latest_by(right, ["k", "t"], [F.col("v")])
    for strict in (False, True):
        a = asof.asof_backward(left, right, ["k"], "d", "t", ["v"], strict)
        b = asof.asof_backward(left, right, ["k"], "d", "t", ["v"], strict, bounded_left=True)
        l, r = left.toPandas(), right.toPandas()
        want = set()
        for k, d in l.itertuples(index=False):
            ok = r[(r.k == k) & ((r.t < d) if strict else (r.t <= d))].sort_values("t")
            want.add((k, d, int(ok.v.iloc[-1]) if len(ok) else None))
        for got in (a, b):
            assert {(x["k"], x["d"], x["v"]) for x in got.collect()} == want
