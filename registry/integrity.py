"""Files written and read back, inventories, hashes, lineage and receipts."""

import os

from pyspark.sql import functions as F

from registry import query
from registry.tables import ORACLE_VIEWS
from tidemark.functions.scalars import row_sha
from tidemark.operators import lineage as ln
from tidemark.operators import features, hash_tree, pit, recon, select
from tidemark.session import scratch_path, stage
from tidemark.sources import landing, sinks

ORACLE_VIEWS["year_bars"] = "SELECT year(date) AS y, * FROM bars"


def month_close(t):
    """Month-end closes: a table small enough to write to files in a query."""
    return t.bars.groupBy("symbol", F.trunc("date", "MM").alias("month")).agg(
        F.max_by("close", "date").alias("close"), F.sum("volume").alias("volume")
    )


_MC = "(SELECT symbol, date_trunc('month', date)::DATE AS month, arg_max(close, date) AS close, sum(volume) AS volume FROM bars GROUP BY 1, 2)"


@query("S1_S7_partitioned_bar_scan", "date:d symbol:i open:f close:f volume:f amount:g is_st:b", "SELECT * FROM market")
def _(t):
    path = scratch_path(t.spark, "bars-csv")
    m = t.market.select(
        "date", F.col("symbol").cast("string").alias("symbol"), F.concat(F.lit("S"), F.col("symbol").cast("string")).alias("name"), "open", "high", "low", "close",
        "prev_close", "volume", "amount", "adj_factor", "up_limit", "down_limit", F.when(F.col("is_st"), "Yes").otherwise("0").alias("is_st"), "total_mv",
        F.lit(None).cast("double").alias("circ_mv"),
    )
    sinks.write_new(m, path, "csv")
    return landing.read_bars(t.spark, path, ["date", "symbol", "open", "close", "volume", "amount", "is_st"])


@query(
    "S2_partition_identity", "part:i rows:i foreign_rows:i matches:b",
    """SELECT part, count(*) AS rows, count(*) FILTER (real_part <> part) AS foreign_rows, count(*) FILTER (real_part <> part) = 0 AS matches FROM (
       SELECT symbol % 8 AS real_part, CASE WHEN symbol % 50 = 7 THEN 0 ELSE symbol % 8 END AS part FROM bars) GROUP BY 1""",
)
def _(t):
    path = scratch_path(t.spark, "parts")
    k = F.col("symbol") % 8
    b = t.bars.select(k.alias("real_part"), F.when(F.col("symbol") % 50 == 7, 0).otherwise(k).alias("part"), "date")
    b.repartition("part").write.partitionBy("part").parquet(path)
    back = t.spark.read.parquet(path).select(F.concat(F.lit("part="), F.col("part").cast("string")).alias("file_name"), F.col("real_part").alias("symbol"))
    out = landing.partition_identity(back, F.regexp_extract("file_name", r"part=(\d+)", 1))
    return out.select(F.regexp_extract("file_name", r"part=(\d+)", 1).cast("long").alias("part"), "rows", "foreign_rows", "matches")


@query(
    "S2_two_way_partition_identity", "key:s rows:i foreign_rows:i problem:s",
    """WITH p AS (SELECT CASE WHEN symbol % 50 = 7 THEN 0 ELSE symbol % 16 END AS part, symbol % 16 AS own FROM bars WHERE symbol % 16 <> 5),
       f AS (SELECT part::VARCHAR AS key, count(*) AS rows, count(*) FILTER (own <> part) AS foreign_rows FROM p GROUP BY 1),
       e AS (SELECT DISTINCT (symbol % 16)::VARCHAR AS key FROM bars WHERE symbol % 16 <> 9)
       SELECT key, coalesce(rows, 0) AS rows, coalesce(foreign_rows, 0) AS foreign_rows, CASE WHEN f.key IS NULL THEN 'missing' WHEN e.key IS NULL THEN 'extra' WHEN foreign_rows > 0 THEN 'foreign' ELSE '' END AS problem
       FROM e FULL JOIN f USING (key)""",
)
def _(t):
    path = scratch_path(t.spark, "parts-both-ways")
    own = F.col("symbol") % 16
    b = t.bars.where(own != 5).select("symbol", "date", F.when(F.col("symbol") % 50 == 7, 0).otherwise(own).alias("part"))
    b.repartition("part").write.partitionBy("part").parquet(path)
    expected = t.bars.where(own != 9).select(own.cast("string").alias("key")).distinct()
    return landing.verify_partition_files(t.spark, path, expected, "symbol long, date date", own, name=r"part=([^/]+)/")


@query("S3_scan_with_empty_partitions", "symbol:i month:d close:f", f"SELECT * FROM {_MC}")
def _(t):
    path = scratch_path(t.spark, "sparse")
    m = month_close(t).select("symbol", "month", "close")
    sinks.write_new(m, f"{path}/a", "csv")
    sinks.write_new(m.where(F.lit(False)), f"{path}/b", "csv")
    return landing.read_partitions(t.spark, f"{path}/*", "symbol long, month date, close double")


@query("S4_projected_parquet_scan", "symbol:i amount:g", "SELECT symbol, sum(amount) AS amount FROM bars GROUP BY 1")
def _(t):
    li = landing.read_projected(t.spark, [f"{t.sf_dir}/lineitem.parquet"], ["l_suppkey", "l_extendedprice"])
    return li.groupBy(F.col("l_suppkey").alias("symbol")).agg(F.sum("l_extendedprice").alias("amount"))


@query(
    "S5_verified_partition_load", "part:i problem:s",
    "SELECT symbol % 10 AS part, CASE symbol % 10 WHEN 3 THEN 'hash_mismatch' WHEN 6 THEN 'row_count' WHEN 8 THEN 'missing' ELSE '' END AS problem FROM bars GROUP BY 1, 2",
)
def _(t):
    path = scratch_path(t.spark, "verified")
    m = month_close(t).withColumn("part", F.col("symbol") % 10)
    m.repartition("part").write.partitionBy("part").parquet(path)
    part = F.regexp_extract("path", r"part=(\d+)", 1).cast("long")
    files = stage(ln.file_inventory(t.spark, path, "*.parquet").withColumn("part", part))
    rows = t.spark.read.parquet(path).groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
    cat = files.join(rows, "part").select(
        "path", F.when(F.col("part") == 3, F.sha2(F.lit("other"), 256)).otherwise(F.col("sha256")).alias("sha256"),
        F.when(F.col("part") == 6, F.col("rows") + 1).otherwise(F.col("rows")).alias("row_count"),
    )
    counts = files.join(rows, "part").select("path", "rows")
    got = ln.verify_partitions(cat, files.where(F.col("part") != 8).select("path", "sha256"), counts)
    return got.select(part.alias("part"), "problem")


@query(
    "S6_raw_response_to_rows", "ts_code:s trade_date:s close:s extra:s",
    f"SELECT 'S' || symbol AS ts_code, strftime(month, '%Y%m%d') AS trade_date, round(volume)::BIGINT::VARCHAR AS close, CASE WHEN symbol % 2 = 0 THEN 'x' END AS extra FROM {_MC}",
)
def _(t):
    path = scratch_path(t.spark, "raw")
    m = month_close(t)
    code, day = F.concat(F.lit("S"), F.col("symbol").cast("string")), F.date_format("month", "yyyyMMdd")
    vol = F.round("volume").cast("long").cast("string")
    # one response per symbol and year; some wrap the table in "data" and order fields differently
    r = m.groupBy("symbol", F.year("month").alias("y")).agg(
        F.collect_list(F.array(code, day, vol)).alias("plain"), F.collect_list(F.array(vol, code, F.lit("x"), day)).alias("wrapped")
    )
    even = F.col("symbol") % 2 == 0
    names = lambda *xs: F.array(*[F.lit(x) for x in xs])
    r = r.select(
        F.when(even, None).otherwise(names("ts_code", "trade_date", "close")).alias("fields"), F.when(even, None).otherwise(F.col("plain")).alias("items"),
        F.when(even, F.struct(names("close", "ts_code", "extra", "trade_date").alias("fields"), F.col("wrapped").alias("items"))).alias("data"),
    )
    r.write.option("compression", "gzip").json(path)
    return landing.read_raw_tables(t.spark, path, ["ts_code", "trade_date", "close", "extra"])


@query(
    "S8_interval_file_scan", "symbol:i opt_in:d opt_out:d faulty:b",
    """SELECT symbol, opt_in, CASE WHEN symbol % 12 = 3 THEN opt_in ELSE opt_out END AS opt_out, symbol % 12 = 3 AS faulty FROM member_intervals""",
)
def _(t):
    path = scratch_path(t.spark, "intervals")
    i = t.member_intervals.select(
        F.col("symbol").cast("string").alias("symbol"), F.lit("n").alias("name"), F.date_format("opt_in", "yyyy-MM-dd").alias("opt-in"),
        F.date_format(F.when(F.col("symbol") % 12 == 3, F.col("opt_in")).otherwise(F.col("opt_out")), "yyyyMMdd").alias("opt-out"),
    )
    sinks.write_new(i, path, "csv")
    back = stage(landing.read_intervals(t.spark, path))
    bad = landing.interval_faults(back).select("symbol", "opt_in", F.lit(True).alias("faulty"))
    return back.join(bad, ["symbol", "opt_in"], "left").withColumn("faulty", F.coalesce("faulty", F.lit(False)))


@query(
    "S9_task_catalog_scan", "task_id:s api_name:s trade_date:s segment:s row_count:i",
    """SELECT o_orderkey AS task_id, o_orderpriority AS api_name, strftime(o_orderdate, '%Y%m%d') AS trade_date, 'c' || o_custkey % 10 AS segment, o_orderkey % 100 AS row_count
       FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH')""",
)
def _(t):
    path = scratch_path(t.spark, "catalog")
    o = t.raw("orders").select(
        F.col("o_orderkey").cast("string").alias("task_id"), F.col("o_orderpriority").alias("api_name"),
        F.to_json(F.struct(F.date_format("o_orderdate", "yyyyMMdd").alias("trade_date"), F.concat(F.lit("c"), (F.col("o_custkey") % 10).cast("string")).alias("segment"))).alias("params_json"),
        F.when(F.col("o_orderstatus") == "F", "success").otherwise("denied").alias("status"), (F.col("o_orderkey") % 100).alias("row_count"),
    )
    o.write.json(path)
    c = landing.successful(landing.read_catalog(t.spark, path), ["1-URGENT", "2-HIGH"])
    return c.select("task_id", "api_name", F.col("params")["trade_date"].alias("trade_date"), F.col("params")["segment"].alias("segment"), "row_count")


@query(
    "S10_checksum_list_scan", "path:s hashes:i",
    """SELECT 'doc/' || doc_id % 400 AS path, count(DISTINCT sha256(text)) AS hashes FROM documents GROUP BY 1 HAVING count(DISTINCT sha256(text)) > 1""",
)
def _(t):
    path = scratch_path(t.spark, "checksums")
    d = t.raw("documents").select(
        F.concat(F.upper(F.sha2("text", 256)), F.lit("  *doc/"), (F.col("doc_id") % 400).cast("string")).alias("value")
    )
    d.write.text(path)
    return landing.conflicting_checksums(landing.read_checksums(t.spark, path))


@query(
    "S11_last_manifest_record", "snapshot_id:s line_no:i task_id:i status:s",
    """WITH m AS (SELECT o_orderkey // 500 AS line_no, 'snap' || (o_orderkey // 500) % 3 AS snapshot_id, o_orderkey AS task_id, o_orderstatus AS status FROM orders)
       SELECT snapshot_id, line_no, task_id, status FROM m WHERE line_no = (SELECT max(x.line_no) FROM m x WHERE x.snapshot_id = m.snapshot_id)""",
)
def _(t):
    path = scratch_path(t.spark, "manifests")
    line = F.floor(F.col("o_orderkey") / 500).cast("long")
    m = t.raw("orders").groupBy(line.alias("line_no")).agg(
        F.collect_list(F.struct(F.col("o_orderkey").alias("task_id"), F.col("o_orderstatus").alias("status"))).alias("tasks")
    ).withColumn("snapshot_id", F.concat(F.lit("snap"), (F.col("line_no") % 3).cast("string")))
    m.write.json(path)
    back = t.spark.read.schema("line_no long, snapshot_id string, tasks array<struct<task_id:long,status:string>>").json(path)
    return landing.last_manifest(back)


@query(
    "S12_seeded_synthetic_market", "symbols:i rows:i distinct_days:i ohlc_violations:i",
    """SELECT (SELECT count(*) FROM supplier) AS symbols, (SELECT count(*) FROM supplier) * (SELECT count(*) FROM calendar) AS rows,
       (SELECT count(*) FROM calendar) AS distinct_days, 0 AS ohlc_violations""",
)
def _(t):
    b = landing.synthetic_market(t.calendar, t.raw("supplier").select(F.col("s_suppkey").alias("symbol")), 7)
    bad = (F.col("high") < F.greatest("open", "close")) | (F.col("low") > F.least("open", "close")) | (F.col("low") <= 0)
    return b.agg(
        F.countDistinct("symbol").alias("symbols"), F.count(F.lit(1)).alias("rows"), F.countDistinct("date").alias("distinct_days"),
        F.count_if(bad).alias("ohlc_violations"),
    )


@query("K1_K2_write_and_read_back", "rows:i same_content:b", f"SELECT count(*) AS rows, true AS same_content FROM {_MC}")
def _(t):
    path = scratch_path(t.spark, "sorted")
    m = stage(month_close(t))
    sinks.write_sorted(m, path, ["symbol", "month"])
    a = recon.table_fingerprint(m).select(F.col("rows"), F.col("digest").alias("_a"))
    b = recon.table_fingerprint(t.spark.read.parquet(path).select(*m.columns)).select(F.col("digest").alias("_b"))
    return a.crossJoin(b).select("rows", (F.col("_a") == F.col("_b")).alias("same_content"))


@query(
    "K3_K4_symbol_buckets", "bucket:i symbols:i rows:i",
    """SELECT (('0x' || substr(sha256(symbol::VARCHAR), 1, 16))::UBIGINT % 32)::BIGINT AS bucket, count(DISTINCT symbol) AS symbols, count(*) AS rows FROM facts GROUP BY 1""",
)
def _(t):
    path = scratch_path(t.spark, "buckets")
    sinks.write_bucketed(t.facts, path, 32, 2)
    return t.spark.read.parquet(path).groupBy("bucket").agg(F.countDistinct("symbol").alias("symbols"), F.count(F.lit(1)).alias("rows"))


@query(
    "K4_features_of_bucketed_bars", "date:d symbol:i return_1d:f mom_12_1:f volatility:f",
    "SELECT date, symbol, return_1d, mom_12_1, volatility FROM price_features",
)
def _(t):
    name = f"bars_{os.urandom(6).hex()}"
    bars = sinks.write_bucketed_table(t.market, name, ["symbol"], ["symbol", "date"], 32, scratch_path(t.spark, "bucketed-bars"))
    return features.price_features(bars).select("date", "symbol", "return_1d", "mom_12_1", "volatility")


@query(
    "K5_append_only_landing", "outcome:s rows:i",
    """SELECT 'added' AS outcome, count(*) AS rows FROM orders WHERE o_orderkey % 2 = 1 UNION ALL SELECT 'conflict', count(*) FROM orders WHERE o_orderkey % 20 = 4""",
)
def _(t):
    o = t.raw("orders").select("o_orderkey", F.sha2(F.col("o_custkey").cast("string"), 256).alias("digest"))
    old = o.where(F.col("o_orderkey") % 2 == 0)
    new = o.withColumn("digest", F.when(F.col("o_orderkey") % 20 == 4, F.sha2(F.lit("changed"), 256)).otherwise(F.col("digest")))
    added, conflicts = sinks.append_only(old, new, ["o_orderkey"], "digest")
    tag = lambda name, df: df.agg(F.lit(name).alias("outcome"), F.count(F.lit(1)).alias("rows"))
    return tag("added", added).unionByName(tag("conflict", conflicts))


@query("K6_staged_publish", "rows:i replaced:b", "SELECT count(*) AS rows, true AS replaced FROM (SELECT DISTINCT symbol, year(date) FROM bars)")
def _(t):
    path = scratch_path(t.spark, "published")
    first = t.bars.select("symbol").distinct()
    sinks.publish(first, path)
    backup = sinks.publish(t.bars.select("symbol", F.year("date").alias("y")).distinct(), path, overwrite=True)
    return t.spark.read.parquet(path).agg(F.count(F.lit(1)).alias("rows"), F.lit(bool(backup)).alias("replaced"))


@query(
    "K7_K9_bundle_manifest", "table_name:s rows:i",
    """SELECT 'month_close' AS table_name, count(*) AS rows FROM (SELECT DISTINCT symbol, date_trunc('month', date) FROM bars) UNION ALL
       SELECT 'industries', count(*) FROM industries UNION ALL SELECT 'intervals', count(*) FROM member_intervals""",
)
def _(t):
    path = scratch_path(t.spark, "bundle")
    return sinks.write_bundle({"month_close": month_close(t), "industries": t.industries, "intervals": t.member_intervals}, path)


@query("K8_snapshot_with_sidecar", "rows:i kind:s", "SELECT count(*) AS rows, 'valuations' AS kind FROM valuations")
def _(t):
    path = scratch_path(t.spark, "snapshot")
    return sinks.write_snapshot(t.valuations, path, {"kind": "valuations"})


@query("P18_secret_scan", "doc_id:i label:s", """SELECT doc_id, 'mail' AS label FROM documents WHERE contains(text, '@') UNION ALL SELECT doc_id, 'key' FROM documents WHERE contains(text, 'AKIA')""")
def _(t):
    return ln.secret_hits(t.raw("documents"), {"mail": "@", "key": "AKIA"}, "doc_id", "text")


@query(
    "L1_file_inventory", "files:i distinct_hashes:i some_bytes:b",
    "SELECT count(DISTINCT year(date)) AS files, count(DISTINCT year(date)) AS distinct_hashes, true AS some_bytes FROM bars",
)
def _(t):
    path = scratch_path(t.spark, "inventory")
    y = month_close(t).withColumn("y", F.year("month"))
    y.repartition("y").write.partitionBy("y").parquet(path)
    inv = ln.file_inventory(t.spark, path, "*.parquet")
    return inv.agg(F.count(F.lit(1)).alias("files"), F.countDistinct("sha256").alias("distinct_hashes"), (F.min("size_bytes") > 0).alias("some_bytes"))


@query(
    "L2_verify_inventory", "path:s problem:s",
    """SELECT * FROM (SELECT CASE WHEN doc_id % 97 = 6 THEN '../' || doc_id ELSE 'doc/' || doc_id END AS path, CASE WHEN doc_id % 97 = 6 THEN 'path_escape' WHEN doc_id % 5 = 1 THEN 'unsealed_extra'
       WHEN doc_id % 5 = 2 THEN 'missing' WHEN doc_id % 50 = 3 THEN 'size_change' WHEN doc_id % 50 = 4 THEN 'hash_mismatch' ELSE '' END AS problem FROM documents)""",
)
def _(t):
    i = F.col("doc_id")
    d = t.raw("documents").select(
        "doc_id", F.when(i % 97 == 6, F.concat(F.lit("../"), i.cast("string"))).otherwise(F.concat(F.lit("doc/"), i.cast("string"))).alias("path"),
        F.octet_length("text").cast("long").alias("size_bytes"), F.sha2("text", 256).alias("sha256"),
    )
    m = d.where((i % 5 != 1) | (i % 97 == 6)).select(
        "path", F.when(i % 50 == 3, F.col("size_bytes") + 1).otherwise(F.col("size_bytes")).alias("size_bytes"),
        F.when(i % 50 == 4, F.reverse("sha256")).otherwise(F.col("sha256")).alias("sha256"),
    )
    return ln.verify_inventory(m, d.where((i % 5 != 2) | (i % 97 == 6)))


@query(
    "L3_content_fingerprint", "rows:i digest:s",
    """SELECT count(*) AS rows, sum(('0x' || substr(sha256('{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}'), 1, 15))::UBIGINT::HUGEINT)::VARCHAR AS digest FROM orders""",
)
def _(t):
    return recon.table_fingerprint(t.raw("orders").select("o_orderkey", "o_custkey", "o_orderstatus"))


@query(
    "L4_row_hash", "row_id:i sha:s",
    """SELECT o_orderkey AS row_id, sha256('{"custkey":"' || o_custkey || '","note":' || CASE WHEN o_orderkey % 2 = 0 THEN 'null' ELSE '"n"' END || ',"status":"' || o_orderstatus || '"}') AS sha FROM orders""",
)
def _(t):
    note = F.when(F.col("o_orderkey") % 2 == 1, "n")
    return t.raw("orders").select(
        F.col("o_orderkey").alias("row_id"), row_sha({"status": F.col("o_orderstatus"), "custkey": F.col("o_custkey"), "note": note}).alias("sha")
    )


@query(
    "L5_raw_reverification", "verdict:s parts:i",
    "SELECT CASE p WHEN 1 THEN 'pass_legacy_payload' WHEN 2 THEN 'mismatch' WHEN 3 THEN 'missing' ELSE 'pass' END AS verdict, count(*) AS parts FROM (SELECT DISTINCT symbol % 6 AS p FROM bars) GROUP BY 1",
)
def _(t):
    path = scratch_path(t.spark, "reverify")
    m = month_close(t).select((F.col("symbol") % 6).alias("part"), F.concat_ws(",", "symbol", "month", "volume").alias("value"))
    m.repartition("part").sortWithinPartitions("part", "value").write.partitionBy("part").option("compression", "gzip").text(path)
    f = stage(ln.file_inventory(t.spark, path, "*.gz", payload=True).withColumn("part", F.regexp_extract("path", r"part=(\d+)", 1).cast("long")))
    cat = f.select(
        "path", F.when(F.col("part") == 1, F.col("payload_sha256")).when(F.col("part") == 2, F.reverse("sha256")).otherwise(F.col("sha256")).alias("raw_sha256")
    )
    out = ln.reverify(cat, f.where(F.col("part") != 3).drop("part"))
    return out.groupBy("verdict").agg(F.count(F.lit(1)).alias("parts"))


@query(
    "L6_run_registry_upsert", "experiment_id:s created_at:d note:i",
    """SELECT 'run' || o_custkey AS experiment_id, max(CAST(o_orderdate AS DATE)) AS created_at, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS note FROM orders GROUP BY 1""",
)
def _(t):
    r = t.raw("orders").select(
        F.concat(F.lit("run"), F.col("o_custkey").cast("string")).alias("experiment_id"),
        F.struct(F.col("o_orderdate").cast("date").alias("d"), F.col("o_orderkey").alias("k")).alias("created_at"), F.col("o_orderkey").alias("note"),
    )
    out = ln.upsert_runs(r.where(F.col("note") % 3 != 0), r.where(F.col("note") % 3 == 0))
    return out.withColumn("created_at", F.col("created_at.d"))


_RUN = "experiment_id string, created_at long, note long"


@query(
    "L6_registry_with_broken_lines", "registry:s outcome:s records:i newest:i quarantined:i",
    """WITH r AS (SELECT o_custkey, o_orderkey, o_orderkey % 97 = 5 AS cut FROM orders), one AS (SELECT o_custkey, max(o_orderkey) AS k FROM r GROUP BY 1)
       SELECT 'whole' AS registry, 'written' AS outcome, count(*) AS records, max(k) AS newest, CAST(0 AS BIGINT) AS quarantined FROM one
       UNION ALL SELECT 'broken', 'refused', NULL, NULL, count(*) FILTER (cut) FROM r""",
)
def _(t):
    r = t.raw("orders").select(
        F.concat(F.lit("run"), F.col("o_custkey").cast("string")).alias("experiment_id"), F.col("o_orderkey").alias("created_at"), F.col("o_orderkey").alias("note")
    )
    old, new = r.where("note % 3 <> 0"), r.where("note % 3 = 0")
    line = F.to_json(F.struct("experiment_id", "created_at", "note"))
    cut = F.when(F.col("note") % 97 == 5, F.substring(line, 1, 20)).otherwise(line)
    rows = []
    for name, lines in (("whole", old.select(line.alias("value"))), ("broken", r.select(cut.alias("value")))):
        path, bad, target = (scratch_path(t.spark, f"runs-{name}-{k}") for k in ("old", "bad", "new"))
        lines.write.text(path)
        try:
            out = ln.upsert_registry(t.spark, path, new, _RUN, bad, target)
            rows.append(out.agg(F.lit(name).alias("registry"), F.lit("written").alias("outcome"), F.count(F.lit(1)).alias("records"), F.max("created_at").alias("newest"), F.lit(0).cast("long").alias("quarantined")))
        except ValueError:
            nothing = F.lit(None).cast("long")
            rows.append(t.spark.read.parquet(bad).agg(F.count(F.lit(1)).alias("quarantined")).select(
                F.lit(name).alias("registry"), F.lit("refused").alias("outcome"), nothing.alias("records"), nothing.alias("newest"), "quarantined"
            ))
    return rows[0].unionByName(rows[1])


@query(
    "L7_run_record", "symbol:i run_fingerprint:s",
    """SELECT symbol, sha256('{"config":"c' || symbol % 3 || '","data":"' || count(*) || '"}') AS run_fingerprint FROM bars GROUP BY symbol""",
)
def _(t):
    p = t.bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("data")).withColumn("config", F.concat(F.lit("c"), (F.col("symbol") % 3).cast("string")))
    return ln.run_record(p, ["config", "data"])


@query(
    "L8_lineage_replay", "task_id:i problem:s",
    """SELECT o_orderkey AS task_id, CASE WHEN o_orderkey % 9 = 1 THEN 'missing' WHEN o_orderkey % 9 = 2 THEN 'extra' WHEN o_orderkey % 9 = 3 THEN 'changed:row_count'
       WHEN o_orderkey % 9 = 4 THEN 'changed:status,row_count' ELSE '' END AS problem FROM orders""",
)
def _(t):
    k = F.col("o_orderkey") % 9
    o = t.raw("orders").select(F.col("o_orderkey").alias("task_id"), "o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("row_count"))
    live = o.withColumns(
        {"row_count": F.when(k.isin(3, 4), F.col("row_count") + 1).otherwise(F.col("row_count")), "status": F.when(k == 4, "Z").otherwise(F.col("status"))}
    )
    rec = ln.lineage(o.where(k != 2), ["task_id", "status", "row_count"])
    return ln.replay(rec, live.where(k != 1), "task_id", ["status", "row_count"])


@query(
    "L9_acceptance_receipt", "failed:i skipped:i stages:i decision:s",
    """WITH s AS (SELECT 'gaps' AS id, CASE WHEN count(*) > 0 THEN 'fail' ELSE 'pass' END AS status FROM month_ends WHERE signal_date NOT IN (SELECT date FROM membership) UNION ALL
       SELECT 'members', CASE WHEN count(*) > 0 THEN 'fail' ELSE 'pass' END FROM membership WHERE symbol NOT IN (SELECT symbol FROM securities) UNION ALL
       SELECT 'delisted', CASE WHEN count(*) > 0 THEN 'fail' ELSE 'pass' END FROM securities WHERE delist_date IS NOT NULL)
       SELECT count(*) FILTER (status = 'fail') AS failed, count(*) FILTER (status = 'skipped') AS skipped, count(*) AS stages,
       CASE WHEN count(*) FILTER (status <> 'pass') > 0 THEN 'blocked' ELSE 'pass' END AS decision FROM s""",
)
def _(t):
    return ln.acceptance(_acceptance_stages(t), False, {"data_fingerprint": "bound elsewhere"})


def _acceptance_stages(t):
    status = lambda i, df: df.agg(F.lit(i).alias("id"), F.when(F.count(F.lit(1)) > 0, "fail").otherwise("pass").alias("status"))
    s = status("gaps", t.month_ends.select(F.col("signal_date").alias("date")).join(t.membership, "date", "left_anti"))
    s = s.unionByName(status("members", t.membership.join(t.securities, "symbol", "left_anti")))
    return s.unionByName(status("delisted", t.securities.where(F.col("delist_date").isNotNull())))


def _months(t):
    """Orders with the month they are partitioned by."""
    month = F.date_format(F.col("o_orderdate").cast("date"), "yyyy-MM")
    return t.raw("orders").select("o_orderkey", "o_custkey", "o_orderstatus", month.alias("month"))


ORACLE_VIEWS["acceptance_stages"] = """SELECT 'gaps' AS id, CASE WHEN count(*) > 0 THEN 'fail' ELSE 'pass' END AS status FROM month_ends WHERE signal_date NOT IN (SELECT date FROM membership) UNION ALL
   SELECT 'members', CASE WHEN count(*) > 0 THEN 'fail' ELSE 'pass' END FROM membership WHERE symbol NOT IN (SELECT symbol FROM securities) UNION ALL
   SELECT 'delisted', CASE WHEN count(*) > 0 THEN 'fail' ELSE 'pass' END FROM securities WHERE delist_date IS NOT NULL"""
ORACLE_VIEWS["order_leaves"] = """SELECT part, sha256(part || ':' || count(*) || ':' || sum(('0x' || substr(sha256('{"month":"' || part[7:] || '","o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey
   || ',"o_orderstatus":"' || o_orderstatus || '"}'), 1, 15))::UBIGINT::HUGEINT)) AS digest FROM (SELECT 'month=' || strftime(CAST(o_orderdate AS DATE), '%Y-%m') AS part, * FROM orders) GROUP BY part"""
ORACLE_VIEWS["order_buckets"] = """SELECT substr(sha256(part), 1, 2) AS node, sha256(string_agg(part || ':' || digest, chr(10) ORDER BY part || ':' || digest)) AS digest FROM order_leaves GROUP BY 1"""
ORACLE_VIEWS["order_branches"] = """SELECT substr(node, 1, 1) AS node, sha256(string_agg(node || ':' || digest, chr(10) ORDER BY node || ':' || digest)) AS digest FROM order_buckets GROUP BY 1"""
ORACLE_VIEWS["order_receipt"] = """SELECT count(*) FILTER (status = 'fail') AS failed, count(*) FILTER (status = 'skipped') AS skipped, count(*) AS stages,
   CASE WHEN count(*) FILTER (status <> 'pass') > 0 THEN 'blocked' ELSE 'pass' END AS decision, string_agg(id || '=' || status, ';' ORDER BY id || '=' || status) AS list,
   (SELECT sha256(string_agg(node || ':' || digest, chr(10) ORDER BY node || ':' || digest)) FROM order_branches) AS data_fingerprint FROM acceptance_stages"""


@query(
    "L9_bound_receipt", "failed:i skipped:i stages:i decision:s data_fingerprint:s receipt_sha256:s",
    """SELECT *, sha256('{"data_fingerprint":"' || data_fingerprint || '","decision":"' || decision || '","stages":"' || list || '"}') AS receipt_sha256 FROM order_receipt""",
)
def _(t):
    return ln.acceptance(_acceptance_stages(t), False, {}, hash_tree.fold(hash_tree.leaves(_months(t), ["month"]), 2))


@query(
    "L9_changed_partitions", "part:s problem:s",
    """WITH m AS (SELECT strftime(CAST(o_orderdate AS DATE), '%Y-%m') AS month, * FROM orders)
       SELECT 'month=' || month AS part, 'missing' AS problem FROM m WHERE month[6:] = '02' GROUP BY 1 UNION ALL
       SELECT 'month=' || month, 'changed' FROM m WHERE month[6:] <> '02' AND month[6:] <> '09' GROUP BY 1 HAVING bool_or(o_orderkey % 1000 = 7) UNION ALL
       SELECT 'month=' || month, 'missing' FROM m WHERE month[6:] = '09' GROUP BY 1 UNION ALL SELECT 'month=late ' || month, 'extra' FROM m WHERE month[6:] = '09' GROUP BY 1""",
)
def _(t):
    old, m = _months(t), F.substring("month", 6, 2)
    new = old.where(m != "02").withColumns({
        "o_orderstatus": F.when(F.col("o_orderkey") % 1000 == 7, "X").otherwise(F.col("o_orderstatus")),
        "month": F.when(m == "09", F.concat(F.lit("late "), "month")).otherwise(F.col("month")),
    })
    a, b = hash_tree.leaves(old, ["month"]), hash_tree.leaves(new, ["month"])
    return hash_tree.changed_parts(a, hash_tree.fold(a, 2), b, hash_tree.fold(b, 2), 2)


@query(
    "L10_identity_check", "key:s expected:s actual:s",
    "SELECT c_custkey::VARCHAR AS key, c_mktsegment AS expected, CASE WHEN c_custkey % 13 = 5 THEN 'other' END AS actual FROM customer WHERE c_custkey % 13 IN (5, 6)",
)
def _(t):
    c = t.raw("customer")
    k = F.col("c_custkey") % 13
    expected = c.select(F.col("c_custkey").cast("string").alias("key"), F.col("c_mktsegment").alias("value"))
    actual = c.where(k != 6).select(F.col("c_custkey").cast("string").alias("key"), F.when(k == 5, "other").otherwise(F.col("c_mktsegment")).alias("value"))
    return ln.check_identity(actual, expected)
