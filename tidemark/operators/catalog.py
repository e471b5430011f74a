"""Task catalogue, batch gates, partition keys and schema checks as table operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import canonical_json

# States in which a task needs no further work.
SUPERSEDED = ["superseded_invalid_partition", "superseded_truncated_cap", "superseded_legacy_collision"]
TERMINAL = ["success", "confirmed_empty", "bisected", *SUPERSEDED, "quarantined"]
BLOCKING = {
    "no_suspect_truncated": "suspect_truncated",
    "no_retryable_left": "retryable_error",
    "no_quarantined": "quarantined",
    "no_denied": "denied",
    "no_invalid_params": "invalid_params",
}

# The endpoints whose tables this library reads
# (api, dataset, batch, split unit, primary key, first day).  Larger inventories are
# passed to the operators as a table of the same shape.
ENDPOINTS = [
    ("trade_cal", "calendar", "B0_reference", "snapshot", "exchange,cal_date", "1990-12-19"),
    ("stock_basic", "security_master", "B0_reference", "snapshot", "ts_code", "1990-12-19"),
    ("namechange", "security_master", "B0_reference", "snapshot", "ts_code,start_date", "1990-12-19"),
    ("daily", "market_daily", "B1_market", "trade_date", "ts_code,trade_date", "1990-12-19"),
    ("adj_factor", "market_daily", "B1_market", "trade_date", "ts_code,trade_date", "1990-12-19"),
    ("daily_basic", "market_daily", "B1_market", "trade_date", "ts_code,trade_date", "2005-01-04"),
    ("stk_limit", "market_daily", "B1_market", "trade_date", "ts_code,trade_date", "2020-02-17"),
]


def endpoints(spark) -> DataFrame:
    return spark.createDataFrame(
        ENDPOINTS, "api_name string, dataset string, batch string, split_unit string, primary_key string, earliest string"
    ).withColumn("earliest", F.col("earliest").cast("date"))


def status_counts(catalog: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Tasks and rows per status (and endpoint)."""
    return catalog.groupBy(*by, "status").agg(F.count(F.lit(1)).alias("tasks"), F.sum("row_count").alias("row_count"))


def endpoint_coverage(catalog: DataFrame) -> DataFrame:
    """Per endpoint: tasks, finished share, rows."""
    done = F.col("status").isin("success", "confirmed_empty", "bisected")
    return catalog.groupBy("api_name").agg(
        F.count(F.lit(1)).alias("tasks"), F.count_if(done).alias("finished"),
        (F.count_if(done) / F.count(F.lit(1))).alias("finished_ratio"), F.sum("row_count").alias("row_count"),
    )


def capacity(files: DataFrame, by: Sequence[str]) -> DataFrame:
    return files.groupBy(*by).agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("size_bytes"))


def batch_gates(catalog: DataFrame, by: Sequence[str]) -> DataFrame:
    """May a batch be used?  Every condition is a conditional count of one aggregate."""
    s = F.col("status")
    n = F.count(F.lit(1))
    counts = catalog.groupBy(*by).agg(
        n.alias("total"),
        F.count_if(s.isin(*TERMINAL)).alias("_terminal"),
        F.count_if(s.isin("success", "bisected")).alias("_ok"),
        F.count_if(s == "confirmed_empty").alias("_empty"),
        *[F.count_if(s == v).alias(f"_{g}") for g, v in BLOCKING.items()],
    )
    ratio = F.col("_ok") / F.greatest(F.col("total") - F.col("_empty"), F.lit(1))
    out = counts.select(
        *by, "total",
        (F.col("_terminal") == F.col("total")).alias("all_terminal"),
        ratio.alias("success_ratio"),
        (ratio >= 0.995).alias("success_enough"),
        *[(F.col(f"_{g}") == 0).alias(g) for g in BLOCKING],
    )
    ok = F.lit(True)
    for g in ("all_terminal", "success_enough", *BLOCKING):
        ok = ok & F.col(g)
    return out.withColumn("accepted", ok)


def pick_generation(catalog: DataFrame, ranks: Sequence[tuple[str, int]], keys: Sequence[str] = ("api_name", "params")) -> DataFrame:
    """Mark the task to keep among copies of one logical partition.

    Snapshot-name prefix rank first, then the newest snapshot name, then the smallest
    task id.  Losers stay in the result with the winner they lost to.
    """
    rank = F.lit(5)
    for prefix, r in reversed(list(ranks)):
        rank = F.when(F.col("snapshot").startswith(prefix), F.lit(r)).otherwise(rank)
    df = catalog.withColumn("_rank", rank)
    # best = least rank, greatest snapshot, least id; combined map-side in three max steps
    best = df.groupBy(*keys, "_rank", "snapshot").agg(F.min("task_id").alias("task_id"))
    best = best.groupBy(*keys).agg(
        F.max_by(F.struct("snapshot", "task_id"), F.struct(-F.col("_rank"), F.col("snapshot"))).alias("_best")
    )
    return df.join(best, list(keys)).select(
        *[c for c in catalog.columns],
        (F.col("task_id") == F.col("_best.task_id")).alias("chosen"),
        F.col("_best.snapshot").alias("kept_snapshot"),
        F.col("_best.task_id").alias("kept_task_id"),
    )


def remap(path: Column, root: str) -> Column:
    """A path recorded elsewhere, moved under ``root``; null when it is unsafe or has no anchor."""
    anchored = F.regexp_extract(path, r"^(?:.*?/)?data_lake/(.+)$", 1)
    relative = F.when(anchored != "", anchored).when(
        ~path.startswith("/"), F.regexp_extract(path, r"^(.+)$", 1)
    )
    unsafe = relative.rlike(r"(^|/)(\.{1,2})?(/|$)")
    return F.when((F.trim(path) != "") & ~unsafe, F.concat(F.lit(root.rstrip("/") + "/"), relative))


def select_tasks(catalog: DataFrame, evidence: DataFrame, required: DataFrame) -> DataFrame:
    """Tasks of the required endpoints listed by their batch, with the state of each.

    ``problem`` names why the selection must stop: unknown task, another endpoint, a
    blocking state, or a file not bound to the batch's snapshot.
    """
    want = evidence.join(F.broadcast(required), ["batch", "api_name"], "left_semi")
    cat = catalog.select("task_id", F.col("api_name").alias("_api"), "status", "bronze_path", "row_count")
    df = want.join(cat, "task_id", "left")
    name = F.element_at(F.split(F.col("bronze_path"), "/"), -1)
    problem = (
        F.when(F.col("status").isNull(), "not in catalogue")
        .when(F.col("_api") != F.col("api_name"), "endpoint differs")
        .when(F.col("status") == "confirmed_empty", "")
        .when(F.col("status") != "success", "blocking status")
        .when(~F.contains(name, F.col("snapshot_id")), "file of another snapshot")
        .otherwise("")
    )
    return df.select(
        "batch", "api_name", "task_id", "status", "row_count", problem.alias("problem"),
        ((problem == "") & (F.col("status") == "success")).alias("selected"),
    )


def select_alias(catalog: DataFrame, aliases: DataFrame) -> DataFrame:
    """Per source, the successful tasks of its first alias that has any."""
    ok = catalog.where(F.col("status") == "success").join(F.broadcast(aliases), "api_name")
    first = ok.groupBy("source").agg(F.min("alias_rank").alias("alias_rank"))
    return ok.join(F.broadcast(first), ["source", "alias_rank"])


def seal_ok(seals: DataFrame, decisions: DataFrame, manifests: DataFrame, repairs: DataFrame) -> DataFrame:
    """Is a batch that failed its gates covered by a consistent acceptance chain?

    Snapshot agrees, the manifest hash is the sealed one, exactly one repair decision
    carries the sealed hash, it passed all its gates, and no task is left open.
    """
    r = repairs.groupBy(F.col("sha256").alias("repair_decision_sha256")).agg(
        F.count(F.lit(1)).alias("_copies"), F.bool_and(F.col("decision") == "pass").alias("_pass"),
        F.bool_and("all_gates").alias("_gates"), F.max("source_snapshot").alias("_src"),
    )
    df = (
        decisions.join(seals.withColumnRenamed("snapshot_id", "_seal_snapshot"), "batch", "left")
        .join(manifests.select("batch", F.col("sha256").alias("_manifest")), "batch", "left")
        .join(r, "repair_decision_sha256", "left")
    )
    same = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.lit(False))
    checks = {
        "snapshot_bound": same("snapshot_id", "_seal_snapshot"),
        "manifest_bound": same("batch_manifest_sha256", "_manifest"),
        "repair_unique": F.coalesce(F.col("_copies") == 1, F.lit(False)),
        "repair_passed": F.coalesce(F.col("_pass") & F.col("_gates") & (F.col("_src") == F.col("snapshot_id")), F.lit(False)),
        "closed": F.coalesce(F.col("open_tasks") == 0, F.lit(False)),
    }
    df = df.withColumns(checks)
    ok = F.lit(True)
    for c in checks:
        ok = ok & F.col(c)
    return df.select("batch", *checks, ok.alias("sealed"))


def schema_fingerprint(columns: Column, kinds: Column | None = None) -> Column:
    """SHA-256 over ordered column names (and normalised types)."""
    body = F.concat_ws(",", columns)
    return F.sha2(body if kinds is None else F.concat(body, F.lit("|"), F.concat_ws(",", kinds)), 256)


def normal_kind(spark_type: str) -> str:
    """Spark type name -> integer, float, boolean, datetime or string."""
    t = spark_type.lower()
    if t in ("tinyint", "smallint", "int", "bigint"):
        return "integer"
    if t in ("float", "double") or t.startswith("decimal"):
        return "float"
    if t == "boolean":
        return "boolean"
    if t in ("date", "timestamp", "timestamp_ntz"):
        return "datetime"
    return "string"


def schema_gate(layouts: DataFrame, registered: DataFrame, required: DataFrame) -> DataFrame:
    """Known layout passes; a strict subset that keeps the key is read with nulls; else quarantine.

    ``layouts``: api_name, partition, columns (array); ``registered``: api_name, columns;
    ``required``: api_name, primary_key (array).  An endpoint with no registration passes.
    """
    reg = registered.groupBy("api_name").agg(
        F.collect_set(schema_fingerprint(F.col("columns"))).alias("_known"),
        F.max_by("columns", F.struct(F.size("columns"), F.concat_ws(",", "columns"))).alias("_widest"),
    )
    df = layouts.join(reg, "api_name", "left").join(required, "api_name", "left")
    df = df.withColumn("fingerprint", schema_fingerprint(F.col("columns")))
    gone, added = F.array_except("_widest", "columns"), F.array_except("columns", "_widest")
    verdict = (
        F.when(F.col("_known").isNull() | F.array_contains("_known", F.col("fingerprint")), "pass")
        .when((F.size(added) == 0) & (F.size(F.array_except("primary_key", "columns")) == 0), "nullable_variant")
        .otherwise("quarantine")
    )
    return df.select(
        "api_name", "partition", "fingerprint", F.array_sort(added).alias("added"), F.array_sort(gone).alias("removed"),
        verdict.alias("verdict"),
    )


def task_id(provider: Column, api_name: Column, params: Column, fields: Column, snapshot: Column) -> Column:
    """Identity of a request: SHA-256 of its canonical JSON."""
    from tidemark.functions.scalars import row_sha

    return row_sha({"provider": provider, "api_name": api_name, "params": params, "fields": fields, "snapshot_id": snapshot})


def migrate_status(catalog: DataFrame, rule: Column, new: str) -> tuple[DataFrame, DataFrame]:
    """(catalogue with matching tasks moved to ``new``, audit of before and after)."""
    hit = F.coalesce(rule, F.lit(False)) & (F.col("status") != new)
    changed = catalog.where(hit).select("task_id", F.col("status").alias("status_before"), F.lit(new).alias("status_after"))
    return catalog.withColumn("status", F.when(hit, F.lit(new)).otherwise(F.col("status"))), changed


def tampered(specs: DataFrame, recorded: str = "recorded_id") -> DataFrame:
    """Frozen request specs whose recorded id no longer matches their content."""
    real = task_id(F.col("provider"), F.col("api_name"), F.col("params"), F.col("fields"), F.col("snapshot_id"))
    return specs.where(~F.col(recorded).eqNullSafe(real)).withColumn("recomputed_id", real)


def symbol_chunks(symbols: DataFrame, size: int = 200) -> DataFrame:
    """Chunk number of each symbol in sorted order, from exact distributed ranks."""
    from tidemark.operators.xsec import ordinal_rank

    one = symbols.select("symbol").distinct().withColumns({"_all": F.lit(1), "_same": F.lit(0.0)})
    # every value ties, so the order is that of the symbol itself
    ranked = ordinal_rank(one, ["_all"], "_same", "symbol", "_r")
    return ranked.select("symbol", F.floor((F.col("_r") - 1) / size).cast("long").alias("chunk"))


def expand_tasks(endpoints: DataFrame, cal: DataFrame, stop: str) -> DataFrame:
    """Requests of each endpoint by its split unit: trade_date, month, quarter, year or snapshot."""
    from tidemark.operators.calendar import period_spine

    e = endpoints.withColumn("_stop", F.lit(stop).cast("date"))
    out = e.where(F.col("split_unit") == "snapshot").select(
        "api_name", "split_unit", F.col("earliest").alias("start_date"), F.col("_stop").alias("end_date")
    )
    # the calendar has at most one row per day and the endpoint list is a short table
    daily = cal.crossJoin(F.broadcast(e.where(F.col("split_unit") == "trade_date"))).where(
        F.col("date").between(F.col("earliest"), F.col("_stop"))
    )
    out = out.unionByName(daily.select("api_name", "split_unit", F.col("date").alias("start_date"), F.col("date").alias("end_date")))
    for unit in ("month", "quarter", "year"):
        spine = period_spine(e.where(F.col("split_unit") == unit), "earliest", "_stop", unit)
        out = out.unionByName(
            spine.select("api_name", "split_unit", F.col("period_start").alias("start_date"), F.col("period_stop").alias("end_date"))
        )
    return out


def closed_report_period(day: Column) -> Column:
    """Last report period whose filing season is over on a date.

    Annual and first-quarter reports close at the end of April, half-year reports at the
    end of August, third-quarter reports at the end of October.
    """
    y, m = F.year(day), F.month(day)
    return (
        F.when(m >= 11, F.make_date(y, F.lit(9), F.lit(30)))
        .when(m >= 9, F.make_date(y, F.lit(6), F.lit(30)))
        .when(m >= 5, F.make_date(y, F.lit(3), F.lit(31)))
        .otherwise(F.make_date(y - 1, F.lit(9), F.lit(30)))
    )


# Request parameters that always take part in a partition name, in order.
DATE_KEYS = ["trade_date", "start_date", "end_date", "ann_date", "f_ann_date", "period", "float_date", "month", "surv_date", "report_date"]
LONGEST_PART = 48


def partition_key(params: Column, primary: Column, fallback: Column) -> Column:
    """Stable partition name from the split keys and date parameters of a request.

    Parts longer than 48 characters are replaced by a short hash; a request with none of
    these keys uses all its parameters, sorted; one without parameters is ``all``.
    """
    part = lambda k, v: F.when(
        F.length(F.concat(k, F.lit("="), v)) > LONGEST_PART,
        F.concat(k, F.lit("=chunk_"), F.substring(F.sha1(v), 1, 12)),
    ).otherwise(F.concat(k, F.lit("="), v))
    keys = F.array_distinct(F.filter(F.array(primary, fallback, *[F.lit(k) for k in DATE_KEYS]), lambda k: k.isNotNull()))
    used = F.filter(keys, lambda k: F.map_contains_key(params, k))
    chosen = F.when(F.size(used) > 0, used).otherwise(F.array_sort(F.map_keys(params)))
    name = F.concat_ws("_", F.transform(chosen, lambda k: part(k, params[k])))
    return F.when(F.size(chosen) > 0, name).otherwise(F.lit("all"))


def truncation_suspects(catalog: DataFrame, caps: DataFrame, known_caps: Sequence[int] = ()) -> DataFrame:
    """Responses whose row count equals a cap or a round thousand: probably cut off."""
    df = catalog.join(F.broadcast(caps), "api_name", "left")
    n = F.col("row_count")
    why = (
        F.when(n == F.col("cap"), "equals_cap")
        .when((n > 0) & n.isin(*(known_caps or [-1])), "known_cap")
        .when((n > 0) & (n % 1000 == 0), "round_thousand")
    )
    return df.withColumn("suspicion", why).where(F.col("suspicion").isNotNull())


def run_metrics(attempts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Success rates, retry counts and latency percentiles of request attempts.

    One row per attempt: request_id, attempt, ok, latency, rows, expected_rows.
    """
    from tidemark.operators.aggregates import nearest_rank

    by = list(by)
    per = attempts.groupBy(*by, "request_id").agg(
        F.bool_or("ok").alias("_ok"), F.max("attempt").alias("_tries"),
        F.max_by("ok", -F.col("attempt")).alias("_first_ok"),
        F.bool_or(F.col("ok") & (F.col("rows") != F.col("expected_rows"))).alias("_mismatch"),
    )
    head = per.groupBy(*by).agg(
        F.count(F.lit(1)).alias("requests"),
        F.avg(F.col("_first_ok").cast("double")).alias("first_try_success"),
        F.avg(F.col("_ok").cast("double")).alias("final_success"),
        F.sum(F.col("_tries") - 1).alias("retries"),
        F.count_if(F.coalesce("_mismatch", F.lit(False))).alias("row_mismatches"),
    )
    lat = nearest_rank(attempts, by, "latency", {"p50": 0.5, "p95": 0.95, "p99": 0.99}).drop("n")
    return head.join(lat, by).withColumn(
        "accepted", (F.col("final_success") >= 0.995) & (F.col("row_mismatches") == 0)
    )


def failure_queue(catalog: DataFrame) -> DataFrame:
    return catalog.where(~F.col("status").isin("success", "confirmed_empty", "bisected", *SUPERSEDED))


# Columns that may carry a response's date, in order of preference.
DATE_COLUMNS = [
    "trade_date", "cal_date", "ann_date", "end_date", "f_ann_date", "report_date", "surv_date", "nav_date",
    "float_date", "date", "month", "quarter",
]


def date_range(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """First and last value of the first date-like column present."""
    col = next((c for c in DATE_COLUMNS if c in df.columns), None)
    v = F.col(col).cast("string") if col else F.lit(None).cast("string")
    return df.groupBy(*by).agg(F.lit(col).alias("date_column"), F.min(v).alias("first_date"), F.max(v).alias("last_date"))
