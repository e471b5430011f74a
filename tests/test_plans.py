"""Physical plans: one shuffle per window family, pruned scans, no products, no Python in the hot path."""

import os
import re

import pytest
from pyspark.sql import functions as F

import registry
from tidemark.operators import asof, diagnostics, features, market, panel, pit, select, xsec
from tidemark.session import scratch_path, stage
from tidemark.sources import landing, sinks

SF = "/root/testdata/sf0.001"
registry.load()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark):
    path = scratch_path(spark, "plan-bars")
    df = spark.range(3000).select(
        (F.col("id") % 6).alias("symbol"), F.date_add(F.lit("2015-01-01").cast("date"), F.floor(F.col("id") / 6).cast("int")).alias("date"),
        (F.rand(1) + 5).alias("total_close"), F.rand(2).alias("amount"), F.rand(3).alias("volume"), F.rand(4).alias("unused"),
    )
    df.write.parquet(path)
    return spark.read.parquet(path)


def test_all_features_share_one_shuffle(stored):
    p = plan(features.liquidity_features(features.price_features(stored)))
    assert p.count("Exchange hashpartitioning") == 1 and "Python" not in p


def test_no_long_frame_is_slid(stored):
    p = plan(features.liquidity_features(features.price_features(stored)))
    slid = [int(n) for n in re.findall(r"specifiedwindowframe\(RowFrame, -(\d+), currentrow", p)]
    assert slid and max(slid) < features.BLOCK


def test_synthetic_grid_is_never_shuffled(spark, stored):
    days = stored.select("date").distinct().select("date", F.date_diff("date", F.lit("2015-01-01").cast("date")).alias("ord"))
    market = landing.synthetic_market(days, spark.range(4).coalesce(1).select(F.col("id").alias("symbol")), 7)
    p = plan(market)
    above_the_grid = p[:p.index("NestedLoopJoin")]
    assert "Exchange" not in above_the_grid and above_the_grid.count("Window [") == 1
    rows = market.orderBy("symbol", "date").collect()
    assert len(rows) == 2000 and all(b["prev_close"] == (a["close"] if a["symbol"] == b["symbol"] else b["close"]) for a, b in zip(rows, rows[1:]))


def test_range_limit_reaches_the_scan(stored):
    p = plan(features.price_features(stored.drop("unused"), end="2016-01-01"))
    scan = p[p.index("PushedFilters"):]
    assert "LessThanOrEqual(date" in scan and "unused" not in scan


def test_asof_on_bounded_rows_is_one_join_free_pass(stored):
    left = stored.select("symbol", "date")
    right = stored.select("symbol", F.col("date").alias("d"), "amount")
    p = plan(asof.asof_backward(left, right, ["symbol"], "date", "d", ["amount"], bounded_left=True))
    assert "Join" not in p


def test_labels_read_and_shuffle_the_bars_once(stored):
    cal = stored.select("date").distinct().withColumn("ord", F.date_diff("date", F.lit("2015-01-01").cast("date")) + 1)
    signals = stage(cal.where("ord % 30 = 0").select(F.col("date").alias("signal_date")))
    p = plan(panel.forward_labels(stage(signals.withColumn("symbol", F.lit(1).cast("long"))), stored, stage(cal), [21], signals))
    assert p.count("total_close#") and sum("ReadSchema" in part and "total_close" in part for part in p.split("FileScan")) == 1
    assert sum("Exchange hashpartitioning(symbol" in line for line in p.split("\n")) == 1


def test_top_n_limits_groups_before_the_shuffle(stored):
    p = plan(select.top_n(stored, ["date"], [F.col("amount").desc(), F.col("symbol")], 2))
    assert p.count("WindowGroupLimit") == 2


def test_cross_section_rank_needs_no_product(stored):
    p = plan(xsec.ordinal_rank(stored, ["date"], "amount", "symbol", "r"))
    assert "CartesianProduct" not in p and "NestedLoop" not in p
    # only the bucket totals are windowed by date alone; rows are shuffled on finer keys
    rows = [line for line in p.split("\n") if "Window [" in line and "row_number" in line]
    assert rows and all("_tb" in line for line in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
def test_values_on_dates_need_no_product(spark, stored):
    t = registry.tables.Tables(spark, SF)
    facts, ends = stage(t.facts), stage(t.month_ends)
    seen = pit.facts_on_dates(facts, ends, 550)
    runs = asof.value_runs(stored, ["symbol"], "date", ["amount"], missing=True)
    for df in (seen, pit.fact_lineage(seen), asof.on_dates(runs, ends), pit.facts_as_of(facts, seen.select("symbol", "signal_date"))):
        p = plan(df)
        assert "CartesianProduct" not in p and "NestedLoop" not in p and "Python" not in p
    # facts combined to days, the days by key; the tables of days and dates are broadcast
    assert plan(seen).count("Exchange hashpartitioning(symbol") == 2


def test_bucketed_tables_are_read_without_a_shuffle(spark, stored, tmp_path):
    names = [f"plan_{os.urandom(4).hex()}" for _ in range(4)]
    keys = ["symbol", "date"]
    rows = stored.withColumn("vol", F.col("volume")).drop("unused")
    by_symbol = sinks.write_bucketed_table(rows, names[0], ["symbol"], keys, 4, str(tmp_path / "a"))
    assert "Exchange" not in plan(features.liquidity_features(features.price_features(by_symbol)))
    daily = sinks.write_bucketed_table(rows.select(*keys, "vol", "amount"), names[1], keys, keys, 4, str(tmp_path / "b"))
    side = sinks.write_bucketed_table(rows.select(*keys, F.lit(1.0).alias("adj_factor"), F.lit(2.0).alias("total_mv")), names[2], keys, keys, 4, str(tmp_path / "c"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = market.assemble_bars(daily, side.drop("total_mv"), side.drop("adj_factor"), daily.select(*keys, F.col("vol").alias("limit")))
        p = plan(joined)
        assert "Exchange" not in p and p.count("SortMergeJoin") == 3 and joined.count() == stored.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    daily.write.mode("append").format("parquet").bucketBy(4, *keys).sortBy(*keys).saveAsTable(names[1])
    whole = sinks.compact_table(spark, names[1], names[3], keys, keys, 4, str(tmp_path / "d"))
    assert whole.count() == 2 * stored.count() and len(whole.inputFiles()) == 4 < len(spark.table(names[1]).inputFiles())
    with pytest.raises(Exception, match="already exists"):
        sinks.write_bucketed_table(rows, names[0], ["symbol"], keys, 4)
    for name in names:
        spark.sql(f"DROP TABLE {name}")


def exchanges(df):
    p = plan(df)
    assert "CartesianProduct" not in p and "NestedLoop" not in p and "Python" not in p
    return p.count("Exchange hashpartitioning") + p.count("BroadcastExchange")


def test_diagnostics_shuffle_each_row_once_a_rank(spark):
    path = scratch_path(spark, "plan-scores")
    spark.range(4000).selectExpr(
        "date_add(DATE'2020-01-31', int(id % 20) * 30) AS signal_date", "id AS symbol", "'f' AS factor", "rand(1) AS z", "rand(2) AS forward_return_21d",
        "rand(3) AS forward_return_63d", "rand(4) AS log_total_market_value", "'I' AS industry_code", "200L AS universe_size",
    ).write.parquet(path)
    scores = spark.read.parquet(path)
    assert exchanges(diagnostics.rank_ic(scores, [21, 63])) <= 6
    assert exchanges(diagnostics.quantile_returns(scores, [21, 63])) <= 8
    assert exchanges(xsec.quantile_label(scores, ["signal_date", "factor"], "z", "symbol", 5)) <= 4
    assert exchanges(xsec.average_rank(scores, ["signal_date"], "z", "r")) <= 4
    windows = [line for line in plan(xsec.average_rank(scores, ["signal_date"], "z", "r")).split("\n") if "Window [" in line and "rank(" in line]
    assert windows and all("_vb" in line for line in windows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
def test_bars_read_four_columns(spark):
    p = plan(registry.tables.Tables(spark, SF).bars)
    schema = p[p.index("ReadSchema: "):].split("\n")[0]
    assert sorted(c.split(":")[0] for c in schema.split("<", 1)[1].rstrip(">").split(",")) == [
        "l_extendedprice", "l_quantity", "l_shipdate", "l_suppkey"
    ]


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
def test_rolling_features_are_not_computed_again_for_what_follows_the_ranking(spark):
    from registry import allocation
    from registry.tables import Tables

    for df in (allocation.selected(Tables(spark, SF)), registry.spark_query(registry.QUERIES["P12_minimum_candidate_count"])(spark, SF)):
        assert "lineitem" not in plan(df)


def test_report_bundle_stages_what_its_tables_share(spark):
    from registry import bundles
    from registry.tables import Tables

    once = bundles.shared(Tables(spark, SF))
    assert all("Exchange" not in plan(df) and "Window" not in plan(df) for df in (once.bars, once.month_features))


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
def test_research_bundle_makes_every_diagnostic_once(spark, monkeypatch):
    from registry import QUERIES, bundles, research
    from registry.tables import Tables

    made = []
    for name in ("rank_ic", "quantile_returns", "exposures", "cost_stress", "rolling_validation", "coverage"):
        real = getattr(diagnostics, name)
        monkeypatch.setattr(diagnostics, name, lambda *a, _name=name, _real=real, **k: made.append(_name) or _real(*a, **k))
    scored = []
    monkeypatch.setattr("tidemark.plans.factor_panel.member_rows", lambda *a, _real=research.build_score_panel.__globals__["member_rows"]: scored.append(1) or _real(*a))
    monkeypatch.setattr(research, "_PANELS", {})
    once = bundles.whole(Tables(spark, SF))
    for query, _ in bundles.RESEARCH.values():
        QUERIES[query].build(once)
    assert sorted(made) == sorted(set(made)) and len(made) == 6
    assert len(scored) == 1


def test_rank_correlation_moves_its_pairs_twice(spark, stored):
    scores = stage(stored.select(F.col("symbol").alias("g"), "date", "amount", "volume"))
    windows = [line for line in plan(xsec.spearman(scores, ["g"], "amount", "volume", 3, "c", "date", 5)).split("\n") if "Window [" in line and "rank(" in line]
    assert len(windows) == 2


def test_rank_correlation_with_ends_equals_rank_and_label_by_themselves(spark):
    rows = [(i % 3, i, float(i * 7 % 11) if i % 13 else None, float(i * 5 % 17)) for i in range(120)]
    df = stage(spark.createDataFrame(rows, "g long, s long, x double, y double"))
    both = df.where("x IS NOT NULL")
    want = {r["g"]: (r["b"], r["t"]) for r in xsec.quantile_label(both, ["g"], "x", "s", 5).groupBy("g").agg(
        F.avg(F.when(F.col("quantile") == 1, F.col("y"))).alias("b"), F.avg(F.when(F.col("quantile") == 5, F.col("y"))).alias("t")).collect()}
    plain = {r["g"]: r["c"] for r in xsec.spearman(df, ["g"], "x", "y", 3, "c", "s").collect()}
    for r in xsec.spearman(df, ["g"], "x", "y", 3, "c", "s", 5).collect():
        assert r["c"] == plain[r["g"]] and (r["bottom"], r["top"]) == pytest.approx(want[r["g"]])
