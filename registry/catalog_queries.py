"""Task catalogue, gates, partition names, schema checks and run metrics."""

from pyspark.sql import functions as F

from registry import query
from tidemark.operators import aggregates as agg
from tidemark.operators import catalog

_STATUS = """CASE WHEN o_orderkey % 11 = 0 THEN 'confirmed_empty' WHEN o_orderkey % 400 = 1 THEN 'bisected' WHEN o_orderkey % 1700 = 2 THEN 'quarantined'
    WHEN o_orderkey % 2900 = 3 THEN 'retryable_error' WHEN o_orderkey % 3100 = 4 THEN 'denied' WHEN o_orderkey % 700 = 5 THEN 'superseded_truncated_cap' ELSE 'success' END"""


def tasks(t):
    k = F.col("o_orderkey")
    status = (
        F.when(k % 11 == 0, "confirmed_empty").when(k % 400 == 1, "bisected").when(k % 1700 == 2, "quarantined").when(k % 2900 == 3, "retryable_error")
        .when(k % 3100 == 4, "denied").when(k % 700 == 5, "superseded_truncated_cap").otherwise("success")
    )
    return t.raw("orders").select(
        k.alias("task_id"), F.col("o_orderpriority").alias("api_name"), F.concat(F.lit("B"), (F.col("o_custkey") % 8).cast("string")).alias("batch"),
        status.alias("status"), (k % 1000).alias("row_count"), F.col("o_orderdate").cast("date").alias("day"), F.col("o_custkey").alias("custkey"),
    )


_T = f"""(SELECT o_orderkey AS task_id, o_orderpriority AS api_name, 'B' || o_custkey % 8 AS batch, {_STATUS} AS status, o_orderkey % 1000 AS row_count,
    CAST(o_orderdate AS DATE) AS day, o_custkey AS custkey FROM orders)"""


@query(
    "A6_batch_gates", "batch:s total:i all_terminal:b success_ratio:f success_enough:b no_quarantined:b no_retryable_left:b no_denied:b accepted:b",
    f"""SELECT *, all_terminal AND success_enough AND no_quarantined AND no_retryable_left AND no_denied AS accepted FROM (SELECT batch, count(*) AS total,
        count(*) FILTER (status IN ('retryable_error', 'denied')) = 0 AS all_terminal, count(*) FILTER (status IN ('success', 'bisected')) / greatest(count(*) - count(*) FILTER (status = 'confirmed_empty'), 1) AS success_ratio,
        success_ratio >= 0.995 AS success_enough, count(*) FILTER (status = 'quarantined') = 0 AS no_quarantined, count(*) FILTER (status = 'retryable_error') = 0 AS no_retryable_left,
        count(*) FILTER (status = 'denied') = 0 AS no_denied FROM {_T} GROUP BY 1)""",
)
def _(t):
    return catalog.batch_gates(tasks(t), ["batch"])


@query(
    "A5_endpoint_coverage", "api_name:s tasks:i finished:i finished_ratio:f row_count:i",
    f"""SELECT api_name, count(*) AS tasks, count(*) FILTER (status IN ('success', 'confirmed_empty', 'bisected')) AS finished, finished / count(*) AS finished_ratio, sum(row_count) AS row_count FROM {_T} GROUP BY 1""",
)
def _(t):
    return catalog.endpoint_coverage(tasks(t))


@query("A5_capacity", "lang:s source:s files:i size_bytes:i", "SELECT lang, source, count(*) AS files, sum(octet_length(encode(text))) AS size_bytes FROM documents GROUP BY 1, 2")
def _(t):
    d = t.raw("documents").select("lang", "source", F.octet_length("text").alias("size_bytes"))
    return catalog.capacity(d, ["lang", "source"])


@query(
    "C1_path_remap", "doc_id:i remapped:s",
    """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '/lake/bronze/' || doc_id || '.parquet' WHEN 1 THEN '/lake/raw/' || doc_id WHEN 2 THEN NULL WHEN 3 THEN NULL WHEN 4 THEN '/lake/x/' || doc_id ELSE NULL END AS remapped FROM documents""",
)
def _(t):
    i = F.col("doc_id").cast("string")
    k = F.col("doc_id") % 6
    p = (
        F.when(k == 0, F.concat(F.lit("/mnt/other/data_lake/bronze/"), i, F.lit(".parquet"))).when(k == 1, F.concat(F.lit("data_lake/raw/"), i))
        .when(k == 2, F.concat(F.lit("/mnt/data_lake/../etc/"), i)).when(k == 3, F.concat(F.lit("/no/anchor/"), i)).when(k == 4, F.concat(F.lit("x/"), i)).otherwise("")
    )
    return t.raw("documents").select("doc_id", catalog.remap(p, "/lake").alias("remapped"))


@query(
    "C2_strict_task_selection", "batch:s api_name:s task_id:i status:s problem:s selected:b",
    f"""SELECT batch, api_name, task_id, CASE WHEN task_id % 97 <> 1 THEN status END AS status, CASE WHEN task_id % 97 = 1 THEN 'not in catalogue' WHEN status = 'confirmed_empty' THEN ''
        WHEN status <> 'success' THEN 'blocking status' WHEN task_id % 89 = 2 THEN 'file of another snapshot' ELSE '' END AS problem,
        task_id % 97 <> 1 AND status = 'success' AND task_id % 89 <> 2 AS selected FROM {_T} WHERE batch || api_name IN ('B11-URGENT', 'B22-HIGH')""",
)
def _(t):
    c = tasks(t)
    name = F.concat(F.lit("lake/part@"), F.when(F.col("task_id") % 89 == 2, "old").otherwise("snapA"), F.lit(".parquet"))
    cat = c.where(F.col("task_id") % 97 != 1).withColumn("bronze_path", name)
    required = t.spark.createDataFrame([("B1", "1-URGENT"), ("B2", "2-HIGH")], "batch string, api_name string")
    return catalog.select_tasks(cat, c.select("batch", "api_name", "task_id", F.lit("snapA").alias("snapshot_id")), required)


@query(
    "C3_alias_fallback", "source:s api_name:s tasks:i",
    f"""WITH a AS (SELECT * FROM (VALUES ('income', '1-URGENT', 0), ('income', '2-HIGH', 1), ('cash', '3-MEDIUM', 0), ('cash', '5-LOW', 1)) v(source, api_name, alias_rank)),
        k AS (SELECT a.*, x.task_id FROM {_T} x JOIN a USING (api_name) WHERE status = 'success' AND api_name <> '1-URGENT')
        SELECT source, api_name, count(*) AS tasks FROM k WHERE alias_rank = (SELECT min(alias_rank) FROM k z WHERE z.source = k.source) GROUP BY 1, 2""",
)
def _(t):
    aliases = t.spark.createDataFrame(
        [("income", "1-URGENT", 0), ("income", "2-HIGH", 1), ("cash", "3-MEDIUM", 0), ("cash", "5-LOW", 1)], "source string, api_name string, alias_rank int"
    )
    s = catalog.select_alias(tasks(t).where(F.col("api_name") != "1-URGENT"), aliases)
    return s.groupBy("source", "api_name").agg(F.count(F.lit(1)).alias("tasks"))


@query(
    "C4_seal_chain", "batch:s snapshot_bound:b manifest_bound:b repair_unique:b repair_passed:b closed:b sealed:b",
    f"""SELECT batch, batch <> 'B1' AS snapshot_bound, batch <> 'B2' AS manifest_bound, batch <> 'B3' AS repair_unique, batch NOT IN ('B3', 'B4') AS repair_passed, open_tasks = 0 AS closed,
        batch NOT IN ('B1', 'B2', 'B3', 'B4') AND open_tasks = 0 AS sealed FROM (SELECT batch, count(*) FILTER (status IN ('retryable_error', 'denied')) AS open_tasks FROM {_T} GROUP BY 1)""",
)
def _(t):
    b = tasks(t).groupBy("batch").agg(
        F.count_if(F.col("status").isin("retryable_error", "denied")).alias("open_tasks"), F.sha2(F.max("task_id").cast("string"), 256).alias("sha")
    )
    is_ = lambda *names: F.col("batch").isin(*names)
    seals = b.select(
        "batch", F.when(is_("B1"), "other").otherwise("snapA").alias("snapshot_id"), F.when(is_("B2"), F.reverse("sha")).otherwise(F.col("sha")).alias("batch_manifest_sha256"),
        F.when(is_("B3"), F.lit("none")).otherwise(F.concat(F.lit("r"), "sha")).alias("repair_decision_sha256"), "open_tasks",
    )
    decisions = b.select("batch", F.lit("snapA").alias("snapshot_id"))
    repairs = b.select(F.concat(F.lit("r"), "sha").alias("sha256"), F.when(is_("B4"), "fail").otherwise("pass").alias("decision"), F.lit(True).alias("all_gates"), F.lit("snapA").alias("source_snapshot"))
    return catalog.seal_ok(seals, decisions, b.select("batch", F.col("sha").alias("sha256")), repairs)


@query(
    "C5_schema_gate", "api_name:s partition:i verdict:s removed:s added:s",
    """SELECT o_orderpriority AS api_name, o_orderkey AS partition, CASE o_orderkey % 5 WHEN 1 THEN 'nullable_variant' WHEN 2 THEN 'quarantine' WHEN 3 THEN 'quarantine' ELSE 'pass' END AS verdict,
       CASE o_orderkey % 5 WHEN 1 THEN 'open' WHEN 2 THEN 'ts_code' WHEN 3 THEN '' WHEN 4 THEN '' ELSE '' END AS removed, CASE o_orderkey % 5 WHEN 3 THEN 'surprise' ELSE '' END AS added FROM orders""",
)
def _(t):
    k = F.col("o_orderkey") % 5
    arr = lambda *xs: F.array(*[F.lit(x) for x in xs])
    full = ("ts_code", "trade_date", "open", "close")
    cols = (
        F.when(k == 1, arr("ts_code", "trade_date", "close")).when(k == 2, arr("trade_date", "open", "close")).when(k == 3, arr(*full, "surprise")).otherwise(arr(*full))
    )
    lay = t.raw("orders").select(F.col("o_orderpriority").alias("api_name"), F.col("o_orderkey").alias("partition"), cols.alias("columns"))
    apis = t.raw("orders").select(F.col("o_orderpriority").alias("api_name")).distinct()
    out = catalog.schema_gate(lay, apis.withColumn("columns", arr(*full)), apis.withColumn("primary_key", arr("ts_code", "trade_date")))
    return out.withColumns({"removed": F.concat_ws(",", "removed"), "added": F.concat_ws(",", "added")})


@query(
    "C6_status_migration", "task_id:i status_before:s status_after:s",
    f"SELECT task_id, status AS status_before, 'superseded_legacy_collision' AS status_after FROM {_T} WHERE status IN ('retryable_error', 'denied') OR (status = 'success' AND day < DATE '1995-02-01')",
)
def _(t):
    rule = F.col("status").isin("retryable_error", "denied") | ((F.col("status") == "success") & (F.col("day") < "1995-02-01"))
    return catalog.migrate_status(tasks(t), rule, "superseded_legacy_collision")[1]


@query(
    "C6_tampered_specs", "task_id:i api_name:s",
    "SELECT o_orderkey AS task_id, o_orderpriority AS api_name FROM orders WHERE o_orderkey % 300 = 7",
)
def _(t):
    s = t.raw("orders").select(
        F.col("o_orderkey").alias("task_id"), F.lit("vendor").alias("provider"), F.col("o_orderpriority").alias("api_name"), F.col("o_custkey").cast("string").alias("params"),
        F.lit("").alias("fields"), F.lit("snapA").alias("snapshot_id"),
    )
    ident = catalog.task_id(F.col("provider"), F.col("api_name"), F.col("params"), F.col("fields"), F.col("snapshot_id"))
    s = s.withColumn("recorded_id", ident).withColumn("params", F.when(F.col("task_id") % 300 == 7, F.concat("params", F.lit("x"))).otherwise(F.col("params")))
    return catalog.tampered(s)


@query(
    "C7_task_expansion", "api_name:s split_unit:s start_date:d end_date:d",
    """SELECT 'daily' AS api_name, 'trade_date' AS split_unit, date AS start_date, date AS end_date FROM calendar WHERE date BETWEEN DATE '1996-02-10' AND DATE '1998-05-20' UNION ALL
       SELECT 'share', 'month', greatest(m, DATE '1996-02-10'), least((m + INTERVAL 1 MONTH)::DATE - 1, DATE '1998-05-20') FROM (SELECT (DATE '1996-02-01' + to_months(k::INT))::DATE AS m FROM generate_series(0, 27) s(k)) UNION ALL
       SELECT 'report', 'quarter', greatest(m, DATE '1996-02-10'), least((m + INTERVAL 3 MONTH)::DATE - 1, DATE '1998-05-20') FROM (SELECT (DATE '1996-01-01' + to_months((3 * k)::INT))::DATE AS m FROM generate_series(0, 9) s(k)) UNION ALL
       SELECT 'ipo', 'year', greatest(m, DATE '1996-02-10'), least((m + INTERVAL 1 YEAR)::DATE - 1, DATE '1998-05-20') FROM (SELECT (DATE '1996-01-01' + to_years(k::INT))::DATE AS m FROM generate_series(0, 2) s(k)) UNION ALL
       SELECT 'master', 'snapshot', DATE '1996-02-10', DATE '1998-05-20'""",
)
def _(t):
    e = t.spark.createDataFrame(
        [("daily", "trade_date"), ("share", "month"), ("report", "quarter"), ("ipo", "year"), ("master", "snapshot")], "api_name string, split_unit string"
    ).withColumn("earliest", F.lit("1996-02-10").cast("date"))
    return catalog.expand_tasks(e, t.calendar, "1998-05-20")


@query(
    "C7_symbol_chunks", "symbol:i chunk:i",
    "SELECT c_custkey AS symbol, (row_number() OVER (ORDER BY c_custkey) - 1) // 200 AS chunk FROM customer",
)
def _(t):
    return catalog.symbol_chunks(t.raw("customer").select(F.col("c_custkey").alias("symbol")), 200)


@query(
    "C7_closed_report_period", "row_id:i period:d",
    """SELECT o_orderkey AS row_id, CASE WHEN month(o_orderdate) >= 11 THEN make_date(year(o_orderdate), 9, 30) WHEN month(o_orderdate) >= 9 THEN make_date(year(o_orderdate), 6, 30)
       WHEN month(o_orderdate) >= 5 THEN make_date(year(o_orderdate), 3, 31) ELSE make_date(year(o_orderdate) - 1, 9, 30) END AS period FROM orders""",
)
def _(t):
    return t.raw("orders").select(F.col("o_orderkey").alias("row_id"), catalog.closed_report_period(F.col("o_orderdate").cast("date")).alias("period"))


@query(
    "C8_endpoint_key_uniqueness", "dataset:s copies:i groups:i",
    """SELECT 'market_daily' AS dataset, copies, count(*) AS groups FROM (SELECT count(*) AS copies FROM lineitem GROUP BY l_suppkey, CAST(l_shipdate AS DATE)) GROUP BY 2""",
)
def _(t):
    li = t.raw("lineitem").select(F.col("l_suppkey").alias("ts_code"), F.col("l_shipdate").cast("date").alias("trade_date"))
    # the key comes from the endpoint table, not from the query
    row = catalog.endpoints(t.spark).where(F.col("api_name") == "daily").select("dataset", "primary_key")
    keys = next(k for a, _, _, _, k, _ in catalog.ENDPOINTS if a == "daily").split(",")
    c = li.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).groupBy("copies").agg(F.count(F.lit(1)).alias("groups"))
    return c.crossJoin(F.broadcast(row))


@query(
    "C9_partition_names", "row_id:i name:s",
    """SELECT o_orderkey AS row_id, CASE o_orderkey % 4 WHEN 0 THEN 'trade_date=' || strftime(o_orderdate, '%Y%m%d') WHEN 1 THEN 'ts_code=' || o_custkey || '_start_date=' || year(o_orderdate)
       WHEN 2 THEN 'ts_code=chunk_' || substr(sha1(repeat(o_custkey::VARCHAR || ',', 30)), 1, 12) ELSE 'exchange=SSE_is_open=' || o_orderkey % 2 END AS name FROM orders""",
)
def _(t):
    k = F.col("o_orderkey") % 4
    cust = F.col("o_custkey").cast("string")
    m = lambda **kv: F.create_map(*[x for n, v in kv.items() for x in (F.lit(n), v)])
    params = (
        F.when(k == 0, m(trade_date=F.date_format("o_orderdate", "yyyyMMdd"))).when(k == 1, m(ts_code=cust, start_date=F.year("o_orderdate").cast("string")))
        .when(k == 2, m(ts_code=F.repeat(F.concat(cust, F.lit(",")), 30))).otherwise(m(is_open=(F.col("o_orderkey") % 2).cast("string"), exchange=F.lit("SSE")))
    )
    o = t.raw("orders").select(F.col("o_orderkey").alias("row_id"), params.alias("params"))
    return o.select("row_id", catalog.partition_key(F.col("params"), F.lit("trade_date"), F.lit("ts_code")).alias("name"))


@query(
    "C10_run_metrics", "event_type:s requests:i first_try_success:f final_success:f retries:i row_mismatches:i p50:f p95:f p99:f accepted:b",
    """WITH a AS (SELECT event_type, user_id * 100 + day(ts) AS request_id, row_number() OVER (PARTITION BY event_type, user_id, day(ts) ORDER BY event_id) AS attempt, event_id % 7 <> 0 AS ok,
         value AS latency, event_id % 50 AS rows, CASE WHEN event_id % 997 = 3 THEN -1 ELSE event_id % 50 END AS expected FROM events),
       r AS (SELECT event_type, request_id, bool_or(ok) AS fin, arg_min(ok, attempt) AS f, max(attempt) AS tries, bool_or(ok AND rows <> expected) AS mm FROM a GROUP BY 1, 2),
       h AS (SELECT event_type, count(*) AS requests, avg(f::INT) AS first_try_success, avg(fin::INT) AS final_success, sum(tries - 1) AS retries, count(*) FILTER (mm) AS row_mismatches FROM r GROUP BY 1),
       l AS (SELECT event_type, list_sort(list(latency)) AS s FROM a GROUP BY 1)
       SELECT h.*, s[(round_even(0.5 * (len(s) - 1), 0) + 1)::BIGINT] AS p50, s[(round_even(0.95 * (len(s) - 1), 0) + 1)::BIGINT] AS p95, s[(round_even(0.99 * (len(s) - 1), 0) + 1)::BIGINT] AS p99,
       final_success >= 0.995 AND row_mismatches = 0 AS accepted FROM h JOIN l USING (event_type)""",
)
def _(t):
    from pyspark.sql import Window

    e = t.raw("events")
    # attempts of one user on one day
    w = Window.partitionBy("event_type", "user_id", F.dayofmonth("ts")).orderBy("event_id")
    a = e.select(
        "event_type", (F.col("user_id") * 100 + F.dayofmonth("ts")).alias("request_id"), F.row_number().over(w).alias("attempt"), (F.col("event_id") % 7 != 0).alias("ok"),
        F.col("value").alias("latency"), (F.col("event_id") % 50).alias("rows"), F.when(F.col("event_id") % 997 == 3, -1).otherwise(F.col("event_id") % 50).alias("expected_rows"),
    )
    return catalog.run_metrics(a, ["event_type"])


@query("C10_failure_queue", "task_id:i api_name:s status:s", f"SELECT task_id, api_name, status FROM {_T} WHERE status IN ('quarantined', 'retryable_error', 'denied')")
def _(t):
    return catalog.failure_queue(tasks(t))


@query(
    "C11_response_date_range", "symbol:i date_column:s first_date:s last_date:s",
    "SELECT symbol, 'ann_date' AS date_column, min(announcement_date)::VARCHAR AS first_date, max(announcement_date)::VARCHAR AS last_date FROM fact_rows GROUP BY 1",
)
def _(t):
    f = t.fact_rows.select("symbol", F.col("announcement_date").alias("ann_date"), F.col("period_end").alias("end_date"), "value")
    return catalog.date_range(f, ["symbol"])
