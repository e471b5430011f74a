"""File inventories, content hashes, run records and replay checks."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Mapping, Sequence
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import canonical_json, row_sha

CHUNK = 1 << 20
# a kilobyte of zstandard inflates to 32 MB at most
ZSTD_PIECE = 1 << 10
HASHES = "uri string, size_bytes long, sha256 string, payload_sha256 string"


class _Payload:
    """The hash of what a gzip or zstandard stream holds, fed in pieces; none if it is neither, broken or cut off."""

    def __init__(self):
        self.found, self.opener, self.unpack, self.fine, self.gzip = hashlib.sha256(), None, None, True, False

    def feed(self, data: bytes) -> None:
        import zstandard

        if self.opener is None:
            self.gzip = data[:2] == b"\x1f\x8b"
            self.fine = self.gzip or data[:4] == b"\x28\xb5\x2f\xfd"
            self.opener = (lambda: zlib.decompressobj(31)) if self.gzip else zstandard.ZstdDecompressor().decompressobj
        try:
            while data and self.fine:
                if self.unpack is None or self.unpack.eof:
                    self.unpack = self.opener()
                data = self._step(data)
        except (zlib.error, zstandard.ZstdError):
            self.fine = False

    def _step(self, data: bytes) -> bytes:
        if self.gzip:  # it bounds what it gives out; zstandard's output is bounded only by what it is given
            self.found.update(self.unpack.decompress(data, CHUNK))
            return self.unpack.unconsumed_tail or self.unpack.unused_data
        self.found.update(self.unpack.decompress(data[:ZSTD_PIECE]))
        return (self.unpack.unused_data if self.unpack.eof else b"") + data[ZSTD_PIECE:]

    def digest(self) -> str | None:
        return self.found.hexdigest() if self.fine and self.unpack is not None and self.unpack.eof else None


def _hash_files(payload: bool, chunk: int):
    def run(batches):
        for batch in batches:
            found: tuple[list, list] = ([], [])
            for uri in batch.column("uri").to_pylist():
                store, place = fs.FileSystem.from_uri(quote(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri, safe="/:@"))
                stored, inner = hashlib.sha256(), _Payload() if payload else None
                with store.open_input_stream(place, compression=None) as stream:
                    while data := stream.read(chunk):
                        stored.update(data)
                        if inner:
                            inner.feed(data)
                found[0].append(stored.hexdigest())
                found[1].append(inner.digest() if inner else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.string()) for c in found)], [p.split()[0] for p in HASHES.split(", ")])

    return run


def file_inventory(spark: SparkSession, path: str, pattern: str = "*", payload: bool = False, chunk: int = CHUNK) -> DataFrame:
    """Relative path, size and SHA-256 of every file under a folder; by ``payload`` also that of what it inflates to.

    Files of any size are read once, as streams of ``chunk`` bytes: the listing reads no content, and the tasks it is
    dealt to by file size hash stored and inflated bytes in the same pass.  A payload is null for a file that is
    neither gzip nor zstandard, or that is broken or cut off; several members or frames count as one payload.
    Files of no bytes, and those whose names begin with ``_`` or ``.``, are not listed, as in any scan of Spark.
    """
    listed = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
        .select(F.col("path").alias("uri"), F.col("length").alias("size_bytes"))
    )
    hashed = listed.mapInArrow(_hash_files(payload, chunk), HASHES)
    root = F.lit("/" + path.rstrip("/").removeprefix("file:").lstrip("/") + "/" if path.startswith(("/", "file:")) else path.rstrip("/") + "/")
    at = F.position(root, F.col("uri"))
    name = F.when(at > 0, F.substring("uri", at + F.length(root), F.length("uri"))).otherwise(F.col("uri"))
    return hashed.select(name.alias("path"), "size_bytes", "sha256", *(["payload_sha256"] if payload else []))


def inventory_digest(files: DataFrame) -> DataFrame:
    """One hash for a set of files, independent of listing order.

    Each file contributes the hash of its canonical JSON; the set hash covers their
    exact sum and count, so no list of files is gathered anywhere.
    """
    one = row_sha({"path": F.col("path"), "size_bytes": F.col("size_bytes"), "sha256": F.col("sha256")})
    number = F.conv(F.substring(one, 1, 15), 16, 10).cast("decimal(38,0)")
    s = files.agg(F.count(F.lit(1)).alias("files"), F.sum(number).alias("_s"))
    return s.select("files", F.sha2(F.concat_ws(":", F.col("files").cast("string"), F.col("_s").cast("string")), 256).alias("digest"))


def verify_inventory(manifest: DataFrame, actual: DataFrame) -> DataFrame:
    """Compare a manifest with what is there; rows with an empty ``problem`` are fine."""
    m = manifest.select("path", F.col("size_bytes").alias("_ms"), F.col("sha256").alias("_mh"), F.lit(1).alias("_m"))
    a = actual.select("path", F.col("size_bytes").alias("_as"), F.col("sha256").alias("_ah"), F.lit(1).alias("_a"))
    problem = (
        F.when(F.col("path").rlike(r"(^/|(^|/)\.\.(/|$))"), "path_escape")
        .when(F.col("_m").isNull(), "unsealed_extra")
        .when(F.col("_a").isNull(), "missing")
        .when(F.col("_ms") != F.col("_as"), "size_change")
        .when(F.col("_mh") != F.col("_ah"), "hash_mismatch")
        .otherwise("")
    )
    return m.join(a, "path", "outer").select("path", problem.alias("problem"))


def verify_partitions(catalog: DataFrame, files: DataFrame, row_counts: DataFrame) -> DataFrame:
    """Checksum and row count of each catalogued partition against the stored file."""
    df = catalog.join(files.withColumnRenamed("sha256", "_sha"), "path", "left").join(
        row_counts.withColumnRenamed("rows", "_rows"), "path", "left"
    )
    problem = (
        F.when(F.col("_sha").isNull(), "missing")
        .when(F.col("_sha") != F.col("sha256"), "hash_mismatch")
        .when(F.coalesce("_rows", F.lit(0)) != F.col("row_count"), "row_count")
        .otherwise("")
    )
    return df.select("path", problem.alias("problem"))


def reverify(catalog: DataFrame, files: DataFrame) -> DataFrame:
    """Recorded hash against the stored bytes, then against the decompressed payload.

    ``files``: path, sha256, payload_sha256 (null when the payload could not be read).
    """
    df = catalog.join(files.withColumnRenamed("sha256", "_bytes"), "path", "left")
    verdict = (
        F.when(F.col("_bytes").isNull(), "missing")
        .when(F.col("_bytes") == F.col("raw_sha256"), "pass")
        .when(F.col("payload_sha256") == F.col("raw_sha256"), "pass_legacy_payload")
        .otherwise("mismatch")
    )
    return df.select("path", verdict.alias("verdict"))


def upsert_runs(registry: DataFrame, runs: DataFrame) -> DataFrame:
    """Registry with each run id once; the newest record replaces an older one.

    ``registry`` may carry ``_corrupt`` from a JSON read; a corrupt line stops the write.
    """
    base = registry
    if "_corrupt" in base.columns:
        bad = F.raise_error(F.lit("run registry has an unreadable line")).cast("boolean")
        base = base.where(F.when(F.col("_corrupt").isNotNull(), bad).otherwise(F.lit(True))).drop("_corrupt")
    both = base.unionByName(runs)
    rest = [c for c in both.columns if c != "experiment_id"]
    best = both.groupBy("experiment_id").agg(F.max_by(F.struct(*rest), F.struct("created_at")).alias("_r"))
    return best.select("experiment_id", "_r.*").select(*both.columns)


def read_run_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines of a run registry, one JSON object each, permissively: ``path``, ``line``, ``_corrupt``, and the fields of ``schema``.

    ``_corrupt`` holds a line that is no object, or whose fields do not have their types; blank lines are no record.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line")).where(F.trim("line") != "")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    parsed = lines.withColumn("_r", F.from_json("line", f"{schema}, _corrupt string", options))
    whole = F.ltrim("line").startswith("{") & F.col("_r").isNotNull() & F.col("_r._corrupt").isNull() & F.col("_r.experiment_id").isNotNull()
    fields = [f for f in parsed.schema["_r"].dataType.names if f != "_corrupt"]
    return parsed.select("path", "line", F.when(~whole, F.col("line")).alias("_corrupt"), *[F.col(f"_r.{f}").alias(f) for f in fields])


def upsert_registry(spark: SparkSession, path: str, runs: DataFrame, schema: str, quarantine: str, target: str) -> DataFrame:
    """Write the registry at ``path`` with ``runs`` added or replaced to ``target`` as JSON lines.

    A registry with unreadable lines is refused: they go to the table ``quarantine`` (path, line), nothing else is
    written, and the old registry stays as it was.
    """
    old = read_run_lines(spark, path, schema)
    bad = old.where("_corrupt IS NOT NULL").select("path", "line")
    broken = bad.count()
    if broken:
        bad.write.mode("append").parquet(quarantine)
        raise ValueError(f"the run registry has {broken} unreadable lines, now in {quarantine}; nothing was written")
    merged = upsert_runs(old.drop("path", "line", "_corrupt"), runs)
    merged.write.mode("errorifexists").json(target)
    return spark.read.schema(schema).json(target)


def run_record(parts: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Identity of a run: a hash of its configuration, source and data hashes."""
    return parts.withColumn("run_fingerprint", row_sha({f: F.col(f) for f in fields}))


def lineage(selected: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Source rows of a build with a hash per row."""
    return selected.select(*fields, row_sha({f: F.col(f) for f in fields}).alias("row_sha256"))


def replay(recorded: DataFrame, current: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Recorded sources against the live catalogue: missing, extra or changed fields."""
    a = recorded.select(key, *[F.col(f).alias(f"_a_{f}") for f in fields], F.lit(1).alias("_a"))
    b = current.select(key, *[F.col(f).alias(f"_b_{f}") for f in fields], F.lit(1).alias("_b"))
    changed = F.concat_ws(
        ",", *[F.when(~F.col(f"_a_{f}").eqNullSafe(F.col(f"_b_{f}")), F.lit(f)) for f in fields]
    )
    problem = F.when(F.col("_a").isNull(), "extra").when(F.col("_b").isNull(), "missing").when(
        changed != "", F.concat(F.lit("changed:"), changed)
    ).otherwise("")
    return a.join(b, key, "outer").select(key, problem.alias("problem"))


def acceptance(stages: DataFrame, engineering_only: bool, identity: Mapping[str, str], tree: DataFrame | None = None) -> DataFrame:
    """Decision over staged checks and a receipt hash bound to the data's fingerprint.

    ``stages``: id, status in pass, fail, skipped (one row per stage).  With the ``tree`` of ``hash_tree.fold`` the
    receipt carries and covers the digest of its root as ``data_fingerprint``.
    """
    nothing = F.lit(None).cast("string")
    rows = stages.select("id", "status", nothing.alias("_root"))
    if tree is not None:
        rows = rows.unionByName(tree.where("level = 0").select(nothing.alias("id"), nothing.alias("status"), F.col("digest").alias("_root")))
    named = F.when(F.col("id").isNotNull(), F.concat_ws("=", "id", "status"))
    s = rows.agg(
        F.count_if(F.col("status") == "fail").alias("failed"), F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.count("id").alias("stages"), F.concat_ws(";", F.array_sort(F.collect_list(named))).alias("_list"), F.max("_root").alias("data_fingerprint"),
    )
    decision = F.when((F.col("failed") > 0) | (F.col("skipped") > 0), "blocked").when(
        F.lit(engineering_only), "engineering_only"
    ).otherwise("pass")
    s = s.withColumn("decision", decision)
    parts = {"decision": F.col("decision"), "stages": F.col("_list")} | {k: F.lit(v) for k, v in identity.items()}
    if tree is None:
        s = s.drop("data_fingerprint")
    else:
        parts["data_fingerprint"] = F.col("data_fingerprint")
    return s.withColumn("receipt_sha256", row_sha(parts)).drop("_list")


def require_receipt(receipt: DataFrame, identity: DataFrame, key: str = "data_fingerprint") -> DataFrame:
    """May this data be used?  The receipt must be a pass bound to the same fingerprint."""
    once = F.assert_true(F.count(F.lit(1)) == 1, F.lit("exactly one receipt is needed"))
    r = receipt.agg(F.max(key).alias("_bound"), F.max("decision").alias("_decision"), once.alias("_once"))
    return identity.crossJoin(F.broadcast(r)).select(
        key, F.when(F.col("_once").isNotNull(), "").when(F.col("_decision") != "pass", "not_accepted").when(F.col("_bound") != F.col(key), "other_data").otherwise("").alias("problem")
    )


def check_identity(manifest: DataFrame, expected: DataFrame) -> DataFrame:
    """Key/value pairs of a manifest that differ from the expected configuration."""
    m = manifest.select("key", F.col("value").alias("actual"))
    return (
        expected.select("key", F.col("value").alias("expected")).join(m, "key", "left").where(~F.col("expected").eqNullSafe(F.col("actual")))
    )


def secret_hits(texts: DataFrame, secrets: Mapping[str, str], path: str = "path", text: str = "text") -> DataFrame:
    """Where a secret appears: path and label only, never the value."""
    hits = F.array(*[F.when(F.contains(F.col(text), F.lit(v)), F.lit(k)) for k, v in secrets.items()])
    return texts.select(F.col(path), F.explode(F.array_compact(hits)).alias("label"))
