"""Reading landed data: partitioned tables, raw responses, catalogues and checksum lists.

Every reader takes an explicit schema or a fixed line format; nothing infers types from
the data, and empty files read as no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import scalars as S

BARS_SCHEMA = T.StructType(
    [T.StructField("date", T.DateType()), T.StructField("symbol", T.StringType()), T.StructField("name", T.StringType())]
    + [
        T.StructField(c, T.DoubleType())
        for c in ("open", "high", "low", "close", "prev_close", "volume", "amount", "adj_factor", "up_limit", "down_limit")
    ]
    + [T.StructField("is_st", T.StringType()), T.StructField("total_mv", T.DoubleType()), T.StructField("circ_mv", T.DoubleType())]
)
CATALOG_SCHEMA = (
    "task_id string, api_name string, params_json string, status string, row_count long, bronze_path string, "
    "schema_fingerprint string, raw_sha256 string, raw_path string"
)
RAW_SCHEMA = "fields array<string>, items array<array<string>>, data struct<fields:array<string>,items:array<array<string>>>"


def read_bars(spark: SparkSession, path: str, columns: Sequence[str] | None = None, symbols: Sequence[str] | None = None, fmt: str = "csv") -> DataFrame:
    """Per-symbol CSV files (plain or gzip) or, by ``fmt``, Parquet in one scan."""
    reader = spark.read.schema(BARS_SCHEMA)
    df = reader.option("header", True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)
    df = df.withColumn("is_st", S.truthy(F.col("is_st")))
    if symbols is not None:
        df = df.where(F.col("symbol").isin(list(symbols)))
    return df.select(*columns) if columns else df


def read_partitions(spark: SparkSession, path: str, schema, fmt: str = "csv") -> DataFrame:
    """A folder of partition files; files without rows contribute none."""
    reader = spark.read.schema(schema)
    return reader.option("header", True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)


def with_file(df: DataFrame) -> DataFrame:
    """Add the name of the file each row came from."""
    return df.withColumn("file_name", F.col("_metadata.file_name"))


def partition_identity(df: DataFrame, expected: Column) -> DataFrame:
    """Files whose rows do not all belong to the key their name promises.

    ``df`` carries ``file_name``; ``expected`` derives the key from it.
    """
    per = df.withColumn("_want", expected).groupBy("file_name").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("symbol").cast("string").eqNullSafe(F.col("_want"))).alias("foreign_rows")
    )
    return per.withColumn("matches", F.col("foreign_rows") == 0)


def verify_partition_files(
    spark: SparkSession, path: str, expected: DataFrame, schema: str, key: Column, fmt: str = "parquet", pattern: str = "*.parquet",
    name: str = r"([^/=]+)\.[^/]*$",
) -> DataFrame:
    """Partition files against the keys that should be there, both ways, and against the keys their rows carry.

    ``expected``: key (text).  ``name`` finds a file's key in its path, ``key`` a row's in its columns.  Returns key,
    files, bytes, rows, foreign_rows and problem: ``missing`` (no file), ``extra`` (a file nobody expects), ``foreign``
    (rows of another key, null included) or empty; a file without rows is fine.  The listing reads no content, and
    rows are counted by the hidden path of their file, so a partition without rows is still seen.
    """
    named = lambda c: F.regexp_extract(c, name, 1)
    listed = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
        .groupBy(named(F.col("path")).alias("key")).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))
    )
    plain = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).format(fmt)
    rows = (rows.option("header", True) if fmt == "csv" else rows).load(path).select(named(plain).alias("key"), key.cast("string").alias("_own"))
    held = rows.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("_own").eqNullSafe(F.col("key"))).alias("foreign_rows"))
    both = expected.select("key", F.lit(True).alias("_wanted")).join(listed.join(held, "key", "left"), "key", "outer")
    problem = F.when(F.col("files").isNull(), "missing").when(F.col("_wanted").isNull(), "extra").when(F.col("foreign_rows") > 0, "foreign").otherwise("")
    numbers = [F.coalesce(c, F.lit(0)).alias(c) for c in ("files", "bytes", "rows", "foreign_rows")]
    return both.select("key", *numbers, problem.alias("problem"))


def read_projected(spark: SparkSession, paths: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Columnar partitions with only the named columns read."""
    return spark.read.parquet(*paths).select(*columns)


def read_raw_tables(spark: SparkSession, path: str, wanted: Sequence[str], pattern: str = "*.json*") -> DataFrame:
    """Raw responses ``{fields, items}`` (bare or under ``data``) -> one row per item.

    One response per line or file; columns are matched by field name, so responses whose
    fields are ordered differently or lack a column read alike.
    """
    raw = spark.read.schema(RAW_SCHEMA).option("pathGlobFilter", pattern).json(path)
    return explode_response(raw, wanted, [F.col("_metadata.file_name").alias("file_name")])


def explode_response(raw: DataFrame, wanted: Sequence[str], keep: Sequence[Column] = ()) -> DataFrame:
    rows = raw.select(
        *keep, F.coalesce("fields", "data.fields").alias("_f"), F.explode(F.coalesce("items", "data.items")).alias("_i")
    )
    pairs = rows.withColumn("_m", F.map_from_arrays("_f", "_i"))
    names = [c for c in rows.columns if c not in ("_f", "_i")]
    return pairs.select(*names, *[F.col("_m")[c].alias(c) for c in wanted])


def parse_response(text: Column) -> Column:
    """JSON text of one response -> struct, for responses held in a table column."""
    return F.from_json(text, RAW_SCHEMA)


def read_intervals(spark: SparkSession, path: str) -> DataFrame:
    """Membership interval file with columns symbol, name, opt-in, opt-out."""
    schema = "symbol string, name string, `opt-in` string, `opt-out` string"
    df = spark.read.schema(schema).option("header", True).csv(path)
    return df.select(
        "symbol", "name", S.provider_date(F.col("opt-in")).alias("opt_in"), S.provider_date(F.col("opt-out")).alias("opt_out")
    )


def interval_faults(intervals: DataFrame) -> DataFrame:
    """Intervals without a start, or that do not end after it."""
    return intervals.where(F.col("opt_in").isNull() | (F.col("opt_out") <= F.col("opt_in")))


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Exported task catalogue (JSON lines) with the request parameters as a map."""
    return with_params(spark.read.schema(CATALOG_SCHEMA).json(path))


def with_params(catalog: DataFrame) -> DataFrame:
    return catalog.withColumn("params", F.from_json(F.coalesce("params_json", F.lit("{}")), "map<string,string>"))


def successful(catalog: DataFrame, apis: Sequence[str]) -> DataFrame:
    return catalog.where((F.col("status") == "success") & F.col("api_name").isin(list(apis)))


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    return parse_checksums(spark.read.text(path))


def parse_checksums(lines: DataFrame) -> DataFrame:
    """``<sha256>  <path>`` lines -> (path, sha256, valid); blank lines are skipped."""
    pattern = r"^\s*([0-9A-Fa-f]{64})\s+\*?(.+?)\s*$"
    return lines.where(F.trim("value") != "").select(
        F.regexp_extract("value", pattern, 2).alias("path"),
        F.lower(F.regexp_extract("value", pattern, 1)).alias("sha256"),
        F.col("value").rlike(pattern).alias("valid"),
    )


def conflicting_checksums(sums: DataFrame) -> DataFrame:
    """Paths listed with more than one hash."""
    return sums.where("valid").groupBy("path").agg(F.countDistinct("sha256").alias("hashes")).where(F.col("hashes") > 1)


def last_manifest(manifests: DataFrame) -> DataFrame:
    """The last record of each snapshot in an append-only log, exploded to its tasks.

    ``manifests``: line_no, snapshot_id, tasks (array of struct).
    """
    last = manifests.groupBy("snapshot_id").agg(F.max("line_no").alias("line_no"))
    return (
        manifests.join(last, ["snapshot_id", "line_no"], "left_semi")
        .select("snapshot_id", "line_no", F.explode("tasks").alias("task"))
        .select("snapshot_id", "line_no", "task.*")
    )


def synthetic_market(cal: DataFrame, symbols: DataFrame, seed: int, daily_volatility: float = 0.02) -> DataFrame:
    """Seeded demo bars: correlated random-walk prices with OHLC, limits and volumes.

    Draws come from a hash of (seed, symbol, day), so a row is the same on any
    partitioning and any cluster size.  Normal draws use the Box-Muller transform.
    Symbols are dealt to tasks before their days are made: the grid itself is never
    shuffled, however few files or tasks the symbols come in.
    """
    def uniform(tag: str, *keys: str) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(F.lit(f"{seed}:{tag}"), *keys), 12)
        return (bits.cast("double") + 0.5) / float(2**52)

    def normal(tag: str, *keys: str) -> Column:
        return F.sqrt(-2 * F.ln(uniform(tag + "a", *keys))) * F.cos(2 * F.pi() * uniform(tag + "b", *keys))

    spark = symbols.sparkSession
    days = cal.withColumn("ord", F.col("ord").cast("long")).withColumn("_m", normal("market", "ord"))
    named = symbols.select("symbol", F.xxhash64(F.col("symbol").cast("string")).alias("_s"))
    # a count of partitions is asked for by name, or AQE would join the few bytes of the symbols into one task
    dealt = named.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "symbol")
    grid = dealt.crossJoin(F.broadcast(days))  # the calendar is bounded
    w = Window.partitionBy("symbol").orderBy("ord")
    step = daily_volatility * (0.6 * F.col("_m") + 0.8 * normal("own", "_s", "ord"))
    df = grid.withColumn("_step", step).select(
        "*",
        (10 * F.exp(F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0)))).alias("close"),
        (10 * F.exp(F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, -1)))).alias("_before"),
    )
    df = df.withColumn("prev_close", F.coalesce("_before", "close"))
    df = df.withColumn("open", F.col("prev_close") * (1 + 0.2 * daily_volatility * normal("open", "_s", "ord")))
    reach = 1 + daily_volatility * uniform("range", "_s", "ord")
    return df.select(
        "date", "symbol", "open",
        (F.greatest("open", "close") * reach).alias("high"), (F.least("open", "close") / reach).alias("low"), "close", "prev_close",
        F.floor(1e5 * (1 + uniform("volume", "_s", "ord"))).cast("double").alias("volume"),
        (F.col("prev_close") * 1.1).alias("up_limit"), (F.col("prev_close") * 0.9).alias("down_limit"),
    )
