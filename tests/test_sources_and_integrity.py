"""Files, sinks, tampering and quality rules."""

import gzip
import hashlib
import json
import random

import pytest
import zstandard
from pyspark.sql import functions as F

from tidemark.functions import factors, scalars
from tidemark.operators import catalog, hash_tree, lineage, quality, recon, select
from tidemark.session import scratch_path, stage
from tidemark.sources import landing, sinks


def test_refuse_to_overwrite_and_publish(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.write_new(spark.range(3), path)
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        sinks.write_new(spark.range(4), path)
    with pytest.raises(FileExistsError):
        sinks.publish(spark.range(5), path)
    backup = sinks.publish(spark.range(6), path, overwrite=True)
    assert spark.read.parquet(path).count() == 6 and spark.read.parquet(backup).count() == 3


def test_append_only_reports_conflicts(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2")], "k string, digest string")
    new = spark.createDataFrame([("a", "1"), ("b", "9"), ("c", "3")], "k string, digest string")
    add, bad = sinks.append_only(old, new, ["k"], "digest")
    assert [r["k"] for r in add.collect()] == ["c"] and [r["k"] for r in bad.collect()] == ["b"]


def test_copies_agree_within_a_tolerance_on_the_edge_of_a_rounding_step(spark):
    kind = "g string, k int, x double"
    a = spark.createDataFrame([("near", 1, 0.00005), ("near", 2, 7.0), ("far", 1, 1.0), ("null", 1, None), ("twice", 1, 1.0), ("twice", 1, 1.0), ("one", 1, 1.0)], kind)
    b = spark.createDataFrame([("near", 1, 0.00005 - 1e-12), ("near", 2, 7.0 + 4e-7), ("far", 1, 1.0 + 2e-6), ("null", 1, None), ("twice", 1, 1.0)], kind)
    found = {r["g"]: tuple(r)[1:] for r in recon.reconcile_copies(a, b, ["k"], ["g"], {"x": 1e-6}).collect()}
    assert found == {
        "near": (2, 2, "match"), "far": (1, 1, "mismatch"), "null": (1, 1, "mismatch"), "twice": (2, 1, "mismatch"), "one": (1, 0, "inconclusive"),
    }
    exact = {r["g"]: r["verdict"] for r in recon.reconcile_copies(a, b, ["k"], ["g"]).collect()}
    assert exact == {"near": "mismatch", "far": "mismatch", "null": "match", "twice": "mismatch", "one": "inconclusive"}


def test_fingerprint_ignores_order_and_sees_changes(spark):
    df = spark.range(500).withColumn("x", F.col("id") * 2)
    f = lambda d: tuple(recon.table_fingerprint(d).first())
    assert f(df) == f(df.repartition(7).orderBy(F.desc("id"))) != f(df.withColumn("x", F.when(F.col("id") == 3, 0).otherwise(F.col("x"))))


def test_inventory_detects_tampering_and_streams_large_files(spark, tmp_path):
    for i in range(4):
        (tmp_path / f"f{i}.bin").write_bytes(bytes([i]) * (1000 + i))
    inv = stage(lineage.file_inventory(spark, str(tmp_path), "*.bin"))
    streamed = lineage.file_inventory(spark, str(tmp_path), "*.bin", chunk=7)
    assert sorted(map(tuple, inv.collect())) == sorted(map(tuple, streamed.collect()))
    assert {r["path"]: r["sha256"] for r in inv.collect()} == {f"f{i}.bin": hashlib.sha256(bytes([i]) * (1000 + i)).hexdigest() for i in range(4)}
    assert lineage.inventory_digest(inv).first() == lineage.inventory_digest(inv.repartition(3)).first()
    (tmp_path / "f0.bin").write_bytes(b"\x09" * 1000)
    (tmp_path / "f1.bin").write_bytes(b"short")
    (tmp_path / "f2.bin").unlink()
    (tmp_path / "new.bin").write_bytes(b"x")
    got = {r["path"]: r["problem"] for r in lineage.verify_inventory(inv, lineage.file_inventory(spark, str(tmp_path), "*.bin")).collect()}
    assert got == {"f0.bin": "hash_mismatch", "f1.bin": "size_change", "f2.bin": "missing", "f3.bin": "", "new.bin": "unsealed_extra"}


@pytest.mark.parametrize("chunk", [64, lineage.CHUNK])
def test_stored_and_inflated_bytes_are_hashed_in_one_pass(spark, tmp_path, chunk):
    root = tmp_path / "a (b)+c%20d"
    (root / "deep").mkdir(parents=True)
    plain, sha = random.Random(1).randbytes(70_000) + b"0" * 3_000_000, lambda b: hashlib.sha256(b).hexdigest()
    pack, zst = gzip.compress(plain), zstandard.compress(plain)
    files = {
        "deep/a b.gz": (pack, sha(plain)), "two.gz": (pack + gzip.compress(b"more"), sha(plain + b"more")), "a.zst": (zst, sha(plain)),
        "two.zst": (zst + zstandard.compress(b"more"), sha(plain + b"more")), "none.gz": (gzip.compress(b""), sha(b"")),
        "cut.gz": (pack[:-9], None), "cut.zst": (zst[:-9], None), "broken.gz": (pack[:500] + b"?" * 50 + pack[550:], None),
        "tail.gz": (pack + b"tail", None), "text.txt": (b"plain", None), "empty": (b"", None),
    }
    for name, (data, _) in files.items():
        (root / name).write_bytes(data)
    for place in (str(root), f"file://{root}"):
        inv = lineage.file_inventory(spark, place, payload=True, chunk=chunk)
        got = {r["path"]: (r["size_bytes"], r["sha256"], r["payload_sha256"]) for r in inv.collect()}
        assert got == {name: (len(data), sha(data), inner) for name, (data, inner) in files.items() if data}
    assert "ReadSchema: struct<path:string,length:bigint>" in inv._jdf.queryExecution().executedPlan().toString()


def test_partition_files_are_compared_both_ways(spark, tmp_path):
    rows = [("a b", "a b", 3), ("c+d", "c+d", 2), ("e", "e", 1), ("e", "x", 1), ("late", "late", 1), ("null", None, 1)]
    for i, (part, own, n) in enumerate(rows):
        spark.range(n).select(F.lit(own).cast("string").alias("k"), "id").coalesce(1).write.mode("append").parquet(f"{tmp_path}/w{i}")
        (tmp_path / "t" / part).mkdir(parents=True, exist_ok=True)
        for j, f in enumerate((tmp_path / f"w{i}").glob("*.parquet")):
            f.rename(tmp_path / "t" / part / f"{i}-{j}.parquet")
    (tmp_path / "t" / "bare").mkdir()
    spark.range(0).select(F.lit("").alias("k"), "id").coalesce(1).write.parquet(f"{tmp_path}/none")
    next((tmp_path / "none").glob("*.parquet")).rename(tmp_path / "t" / "bare" / "0.parquet")
    expected = spark.createDataFrame([(k,) for k in ("a b", "c+d", "e", "gone", "null", "bare")], "key string")
    got = landing.verify_partition_files(spark, f"{tmp_path}/t", expected, "k string, id long", F.col("k"), name=r"/t/([^/]+)/")
    found = {r["key"]: (r["files"], r["rows"], r["foreign_rows"], r["problem"]) for r in got.collect()}
    assert found == {
        "a b": (1, 3, 0, ""), "c+d": (1, 2, 0, ""), "e": (2, 2, 1, "foreign"), "gone": (0, 0, 0, "missing"), "late": (1, 1, 0, "extra"),
        "null": (1, 1, 1, "foreign"), "bare": (1, 0, 0, ""),
    }


def test_receipt_binds_the_data_and_names_what_changed(spark):
    df = spark.range(4000).select((F.col("id") % 300).alias("p"), F.when(F.col("id") % 300 != 9, "q").alias("q"), "id")
    new = df.where("p <> 4").withColumn("id", F.when(F.col("id") == 1007, -1).otherwise(F.col("id"))).unionByName(
        spark.range(1).select(F.lit(900).cast("long").alias("p"), F.lit("q").alias("q"), "id")
    )
    a, b, c = (hash_tree.leaves(d, ["p", "q"]) for d in (df, new, df.repartition(5).orderBy(F.desc("id"))))
    for depth in (0, 1, 2, 4):
        ta, tb, tc = (hash_tree.fold(x, depth) for x in (a, b, c))
        assert hash_tree.changed_parts(a, ta, c, tc, depth).count() == 0 and sorted(ta.collect()) == sorted(tc.collect())
        got = sorted(map(tuple, hash_tree.changed_parts(a, ta, b, tb, depth).collect()))
        assert got == [("p=107/q=q", "changed"), ("p=4/q=q", "missing"), ("p=900/q=q", "extra")]
        assert {r["level"]: r["n"] for r in ta.groupBy("level").agg(F.sum("rows").alias("n")).collect()} == dict.fromkeys(range(depth + 1), 4000)
    assert a.where(r"part = 'p=9/q=\\N'").count() == 1
    stages = spark.createDataFrame([("one", "pass"), ("two", "pass")], "id string, status string")
    receipt = stage(lineage.acceptance(stages, False, {"config": "c"}, ta))
    root = lambda tree: tree.where("level = 0").select(F.col("digest").alias("data_fingerprint"))
    assert receipt.first()["stages"] == 2 and receipt.first()["data_fingerprint"] == root(ta).first()[0]
    assert [lineage.require_receipt(receipt, root(x)).first()["problem"] for x in (ta, tc, tb)] == ["", "", "other_data"]
    assert receipt.first()["receipt_sha256"] != lineage.acceptance(stages, False, {"config": "c"}, tb).first()["receipt_sha256"]
    none = hash_tree.leaves(df.where("false"), ["p"])
    assert [tuple(r)[:3] for r in hash_tree.fold(none, 3).collect()] == [(0, "", 0)]


def test_keys_of_overlapping_strata_are_drawn_once(spark):
    rows = [(s, k) for k in range(60) for s in ("a", "b", "c", "d") if (k * 7 + ord(s)) % 3 or k < 9] + [("a", None), ("z", 1), ("b", 3), ("b", 3)]
    df = spark.createDataFrame(rows, "s string, k long")
    mark = lambda k: (hashlib.sha256(f"5:{k}".encode()).hexdigest(), k)
    for order, n in ((["c", "a", "d", "b"], 11), (["a", "b"], 25), (["b", "nobody", "c"], 4), (["d", "c", "b", "a"], 40)):
        drawn, want = set(), []
        for s in order:
            keys = sorted({k for t, k in rows if t == s and k is not None and k not in drawn}, key=mark)[:n]
            drawn.update(keys)
            want += [(s, k) for k in keys]
        for data in (df, df.repartition(7)):
            assert sorted(map(tuple, select.sample_without_replacement(data, order, "s", "k", n, 5).collect())) == sorted(want)


def test_bundle_manifest_is_observed_in_the_write(spark, tmp_path):
    a = spark.range(1000).select("id", F.expr("DATE'2020-01-01' + CAST(id % 40 AS INT)").alias("day"), F.rand().alias("x"))
    tables = {"a": a.repartition(6), "empty": a.where("false"), "undated": spark.range(7)}
    path = str(tmp_path / "bundle")
    got = {r["table_name"]: r for r in sinks.write_bundle(tables, path, {"a": "day", "empty": "day"}).collect()}
    assert {k: (r["rows"], str(r["first_day"]), str(r["last_day"])) for k, r in got.items()} == {
        "a": (1000, "2020-01-01", "2020-02-09"), "empty": (0, "None", "None"), "undated": (7, "None", "None")
    }
    # x is drawn anew by every run of the plan, so only what was observed in the write can agree with the files
    assert all(recon.table_fingerprint(spark.read.parquet(f"{path}/{k}")).first()["digest"] == r["digest"] for k, r in got.items())
    check = lambda *names: {r["table_name"]: r["problem"] for r in sinks.verify_bundle(spark, path, names).collect()}
    assert check("a", "empty", "undated") == {"a": "", "empty": "", "undated": ""}
    assert check("a", "undated", "trades") == {"a": "", "empty": "unexpected", "undated": "", "trades": "unlisted"}
    spark.range(1, 8).write.mode("overwrite").parquet(f"{path}/undated")
    spark.range(1).select("id", F.lit(None).cast("date").alias("day"), F.lit(0.5).alias("x")).write.mode("append").parquet(f"{path}/empty")
    assert check("a", "empty", "undated") == {"a": "", "empty": "rows", "undated": "digest"}
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        sinks.write_bundle(tables, path)


def test_raw_responses_with_and_without_wrapper(spark, tmp_path):
    bare = {"fields": ["ts_code", "close"], "items": [["A", "1"], ["B", None]]}
    wrapped = {"data": {"fields": ["close", "ts_code", "extra"], "items": [["3", "C", "x"]]}}
    (tmp_path / "a.json").write_text(json.dumps(bare))
    (tmp_path / "b.json").write_text(json.dumps(wrapped))
    got = landing.read_raw_tables(spark, str(tmp_path), ["ts_code", "close", "extra"]).orderBy("ts_code")
    assert [tuple(r)[1:] for r in got.collect()] == [("A", "1", None), ("B", None, None), ("C", "3", "x")]
    assert got.first()["file_name"] == "a.json"


def test_checksum_lines(spark):
    a, b = "a" * 64, "B" * 64
    lines = spark.createDataFrame([(f"{a}  x/1",), (f"{b} *x/1",), ("",), ("broken line",), (f"{a}  x/2",)], "value string")
    sums = landing.parse_checksums(lines)
    assert [r["path"] for r in landing.conflicting_checksums(sums).collect()] == ["x/1"]
    assert sums.where("NOT valid").count() == 1


def test_synthetic_market_is_the_same_on_any_partitioning(spark, business_days):
    syms = spark.range(5).select(F.col("id").alias("symbol"))
    f = lambda d: tuple(recon.table_fingerprint(d.select("date", "symbol", F.round("close", 6).alias("c"), "volume")).first())
    one = landing.synthetic_market(business_days, syms, 7)
    assert f(one) == f(landing.synthetic_market(business_days.repartition(5), syms.repartition(3), 7))
    assert f(one) != f(landing.synthetic_market(business_days, syms, 8))


def test_dates_numbers_and_limits(spark):
    rows = [("20200131",), (" 20200131.0 ",), ("2020-01-31",), ("20201399",), ("nope",), (None,)]
    got = [str(r[0]) for r in spark.createDataFrame(rows, "x string").select(scalars.provider_date(F.col("x"))).collect()]
    assert got == ["2020-01-31"] * 3 + ["None"] * 3
    nums = spark.createDataFrame([("1.5",), ("nan",), ("inf",), ("abc",), (None,)], "x string").select(scalars.finite(F.col("x")))
    assert [r[0] for r in nums.collect()] == [1.5, None, None, None, None]
    codes = spark.createDataFrame([("830001.BJ", True), ("920001.SH", False), ("300001.SZ", True), ("600000.SH", True), ("600000.SH", False)], "s string, st boolean")
    assert [float(r[0]) for r in codes.select(scalars.limit_rate(F.col("s"), F.col("st"))).collect()] == [0.3, 0.3, 0.2, 0.05, 0.1]
    inv = spark.createDataFrame([(-5.0,), (0.0,), (4.0,)], "pe double").select(scalars.positive_inverse(F.col("pe")))
    assert [r[0] for r in inv.collect()] == [None, None, 0.25]


def test_factor_names_and_profiles():
    assert len(factors.resolve()) == 11 and factors.resolve(["all"]) == factors.resolve()
    with pytest.raises(ValueError):
        factors.resolve(["all", "pb"])
    with pytest.raises(ValueError):
        factors.resolve(["nope"])
    assert factors.identify_profile(factors.profile_weights("legacy_v1_4")) == "legacy_v1_4"
    assert factors.identify_profile({"mom_12_1": 1.0}) == factors.identify_profile({}) == "custom"
    for name in factors.PROFILES:
        weights = factors.profile_weights(name)
        first = next(iter(weights))
        assert factors.identify_profile(weights) == name and factors.profile_differences(weights)[name] == 0
        assert factors.profile_differences(weights | {first: weights[first] + 1e-6})[name] == 1
        assert factors.identify_profile(weights | {"unknown": 0.0}) == "custom"
        assert factors.identify_profile({k: v for k, v in weights.items() if k != first}) == "custom"


def test_run_registry_refuses_corrupt_lines(spark):
    old = spark.createDataFrame([("r1", 1, None), ("r2", 1, "{bad")], "experiment_id string, created_at int, _corrupt string")
    new = spark.createDataFrame([("r1", 2)], "experiment_id string, created_at int")
    with pytest.raises(Exception, match="unreadable"):
        lineage.upsert_runs(old, new).collect()
    ok = lineage.upsert_runs(old.where("_corrupt IS NULL"), new).collect()
    assert [tuple(r) for r in ok] == [("r1", 2)]


def test_broken_registry_lines_are_quarantined_and_nothing_is_written(spark, tmp_path):
    schema = "experiment_id string, created_at long"
    good = ['{"experiment_id": "r1", "created_at": 1}', "", "  ", '{"experiment_id": "r3", "created_at": 4}']
    bad = ['{"experiment_id": "r2", "crea', "[1, 2]", "7", '{"created_at": 3}', '[{"experiment_id": "r9", "created_at": 1}]', '{"experiment_id": "r2", "created_at": "late"}']
    new = spark.createDataFrame([("r1", 2), ("r4", 5)], schema)
    whole, broken = tmp_path / "whole.jsonl", tmp_path / "broken.jsonl"
    whole.write_text("\n".join(good))
    broken.write_text("\n".join(good + bad))
    out = lineage.upsert_registry(spark, str(whole), new, schema, str(tmp_path / "q0"), str(tmp_path / "new0"))
    assert sorted(map(tuple, out.collect())) == [("r1", 2), ("r3", 4), ("r4", 5)]
    with pytest.raises(ValueError, match="6 unreadable"):
        lineage.upsert_registry(spark, str(broken), new, schema, str(tmp_path / "q1"), str(tmp_path / "new1"))
    assert sorted(r.line for r in spark.read.parquet(str(tmp_path / "q1")).collect()) == sorted(bad)
    assert not (tmp_path / "new1").exists() and not (tmp_path / "q0").exists() and broken.read_text().endswith("late\"}")


def test_strict_mode_raises(spark):
    report = spark.createDataFrame([("a", 0), ("b", 3)], "rule string, violations long")
    with pytest.raises(ValueError, match="b: 3"):
        quality.require(report)
    quality.require(report.where("violations = 0"))


def test_chunks_of_text_symbols(spark):
    df = spark.range(450).select(F.lpad(F.col("id").cast("string"), 6, "0").alias("symbol"))
    got = catalog.symbol_chunks(df, 200).groupBy("chunk").agg(F.count("*").alias("n"), F.min("symbol").alias("a")).orderBy("chunk").collect()
    assert [(r["chunk"], r["n"], r["a"]) for r in got] == [(0, 200, "000000"), (1, 200, "000200"), (2, 50, "000400")]


def test_hot_report_is_numbered_without_gaps(spark):
    from tidemark.operators import pit

    # one report holds most rows
    df = spark.range(2000).select(
        F.when(F.col("id") < 1500, "A").otherwise(F.col("id").cast("string")).alias("symbol"), F.lit("s").alias("source"), F.lit("2020-03-31").cast("date").alias("period_end"),
        F.lit("1").alias("report_type"), F.lit("1").alias("company_type"), F.date_add(F.lit("2020-04-01").cast("date"), (F.col("id") % 5).cast("int")).alias("announcement_date"),
        (F.col("id") % 2).cast("string").alias("source_update_flag"), F.sha2(F.col("id").cast("string"), 256).alias("source_row_sha256"),
    )
    got = pit.revision_sequence(df).where("symbol = 'A'").orderBy("announcement_date", "source_update_flag", "source_row_sha256").select("revision_sequence").collect()
    assert [r[0] for r in got] == list(range(1, 1501))
    assert quality.broken_revisions(pit.revision_sequence(df)).count() == 0
