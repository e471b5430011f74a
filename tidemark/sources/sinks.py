"""Writing results: fail-if-exists tables, bucketed layouts, append-only landing, staged publish."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.recon import row_digest, table_fingerprint


def write_new(df: DataFrame, path: str, fmt: str = "parquet", partition: Sequence[str] = ()) -> None:
    """Write a table that must not exist yet; the commit protocol leaves _SUCCESS when whole."""
    w = df.write.mode("errorifexists").format(fmt)
    if fmt == "csv":
        w = w.option("header", True).option("compression", "gzip")
    (w.partitionBy(*partition) if partition else w).save(path)


def write_sorted(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Range-partitioned and sorted files: the same rows land in the same order every time."""
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("errorifexists").parquet(path)


def symbol_bucket(symbol: Column, buckets: int) -> Column:
    """Stable bucket of a symbol: the first 8 bytes of its SHA-256, modulo the bucket count."""
    head = F.conv(F.substring(F.sha2(symbol.cast("string"), 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return F.pmod(head, F.lit(buckets).cast("decimal(20,0)")).cast("int")


def write_bucketed(df: DataFrame, path: str, buckets: int = 32, files_per_bucket: int = 1) -> None:
    """Partition folders per symbol bucket rather than per symbol, which would mean a file each.

    Rows of a bucket are spread over ``files_per_bucket`` writers by row hash, so one very
    large symbol does not end up in one task.
    """
    b = df.withColumn("bucket", symbol_bucket(F.col("symbol"), buckets))
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(files_per_bucket))
    b.repartition("bucket", salt).write.mode("errorifexists").partitionBy("bucket").parquet(path)


def write_bucketed_table(
    df: DataFrame, table: str, keys: Sequence[str], sort: Sequence[str], buckets: int = 32, path: str | None = None,
) -> DataFrame:
    """A catalogue table hashed to ``buckets`` by ``keys`` and sorted in each bucket, and its reader.

    Windows and joins on the keys then read it without a shuffle: the layout is paid for once, at writing.  Rows are
    brought to their bucket first, so a bucket is one file, not one file per writing task.  ``path`` puts the files in
    a folder that the table does not own; the table must not exist yet.
    """
    writer = df.repartition(buckets, *keys).write.mode("errorifexists").format("parquet").bucketBy(buckets, *keys).sortBy(*sort)
    (writer.option("path", path) if path else writer).saveAsTable(table)
    return df.sparkSession.table(table)


def compact_table(spark: SparkSession, table: str, into: str, keys: Sequence[str], sort: Sequence[str], buckets: int = 32, path: str | None = None) -> DataFrame:
    """The rows of a bucketed table that grew by appends, several files a bucket, written anew with one file a bucket.

    The files are read by their folder: read as a bucketed table the planner would leave the rows where they are.
    """
    folder = spark.sql(f"DESCRIBE FORMATTED {table}").where("col_name = 'Location'").first()["data_type"]
    return write_bucketed_table(spark.read.schema(spark.table(table).schema).parquet(folder), into, keys, sort, buckets, path)


def append_only(existing: DataFrame, incoming: DataFrame, key: Sequence[str], digest: str) -> tuple[DataFrame, DataFrame]:
    """(rows to add, conflicts): known keys with the same content are skipped, others refused."""
    known = existing.select(*key, F.col(digest).alias("existing_digest"))
    conflicts = incoming.join(known, list(key)).where(F.col(digest) != F.col("existing_digest"))
    return incoming.join(known.select(*key), list(key), "left_anti"), conflicts


def publish(df: DataFrame, path: str, overwrite: bool = False) -> str:
    """Stage beside the target, then swap by rename; an existing target is kept as a backup.

    Returns the path the previous table was moved to, or an empty string.
    """
    import os

    spark: SparkSession = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    if fs.exists(target) and not overwrite:
        raise FileExistsError(path)
    tag = os.urandom(4).hex()
    staging, backup = f"{path}.staging-{tag}", f"{path}.backup-{tag}"
    df.write.parquet(staging)
    moved = ""
    if fs.exists(target):
        fs.rename(target, jvm.org.apache.hadoop.fs.Path(backup))
        moved = backup
    if not fs.rename(jvm.org.apache.hadoop.fs.Path(staging), target):
        if moved:
            fs.rename(jvm.org.apache.hadoop.fs.Path(backup), target)
        raise OSError(f"could not publish {path}")
    return moved


def write_snapshot(df: DataFrame, path: str, metadata: dict[str, str]) -> DataFrame:
    """Write a snapshot and a one-row sidecar with its row count, content digest and metadata."""
    write_new(df, f"{path}/data")
    back = df.sparkSession.read.parquet(f"{path}/data")
    side = table_fingerprint(back).withColumns({k: F.lit(v) for k, v in metadata.items()})
    side.write.mode("errorifexists").json(f"{path}/metadata")
    return side


MANIFEST = "table_name string, rows long, digest string, first_day date, last_day date"


def write_bundle(tables: Mapping[str, DataFrame], path: str, days: Mapping[str, str] | None = None) -> DataFrame:
    """Write named tables under one folder and a manifest of what was written, one row a table.

    Rows, digest and, for the tables that ``days`` names a date column of, the first and last day are observed in the
    write itself: nothing is read again, and the manifest tells of the rows that reached the files even where a second
    run of the plan would give other last bits.  Observed above the write, in its own stage, a repeated task counts
    once.  The manifest is written last, so a bundle without one is not whole.
    """
    spark = next(iter(tables.values())).sparkSession
    rows = []
    for name, df in tables.items():
        day = F.col(days[name]).cast("date") if days and name in days else F.lit(None).cast("date")
        seen = Observation()
        digest = F.coalesce(F.sum(row_digest(sorted(df.columns))), F.lit(0).cast("decimal(38,0)")).cast("string")
        write_new(df.observe(seen, F.count(F.lit(1)).alias("rows"), digest.alias("digest"), F.min(day).alias("first_day"), F.max(day).alias("last_day")), f"{path}/{name}")
        rows.append({"table_name": name, **seen.get})
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("errorifexists").json(f"{path}/manifest")
    return spark.read.schema(MANIFEST).json(f"{path}/manifest")


def verify_bundle(spark: SparkSession, path: str, wanted: Sequence[str]) -> DataFrame:
    """(table_name, problem) of the tables in the manifest or ``wanted``: ``unlisted``, ``unexpected``, ``rows``, ``digest`` or empty."""
    listed = spark.read.schema(MANIFEST).json(f"{path}/manifest")
    names = [r["table_name"] for r in listed.select("table_name").collect()]
    found = None
    for name in names:
        one = table_fingerprint(spark.read.parquet(f"{path}/{name}")).select(F.lit(name).alias("table_name"), F.col("rows").alias("_rows"), F.col("digest").alias("_digest"))
        found = one if found is None else found.unionByName(one)
    asked = spark.createDataFrame([(n,) for n in wanted], "table_name string").withColumn("_asked", F.lit(True))
    problem = (
        F.when(F.col("rows").isNull(), "unlisted").when(F.col("_asked").isNull(), "unexpected")
        .when(F.col("rows") != F.col("_rows"), "rows").when(F.col("digest") != F.col("_digest"), "digest").otherwise("")
    )
    return asked.join(listed.join(found, "table_name", "left"), "table_name", "outer").select("table_name", problem.alias("problem"))
