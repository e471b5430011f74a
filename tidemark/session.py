"""Session defaults and the one way this library cuts lineage."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "tidemark", **conf: str) -> SparkSession:
    """A session with the settings every operator assumes: UTC dates, ANSI, AQE.

    The number of shuffle partitions is left to the cluster (AQE coalesces it);
    pass ``shuffle_partitions`` for local runs.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if "shuffle_partitions" in conf:
        settings["spark.sql.shuffle.partitions"] = str(conf.pop("shuffle_partitions"))
    settings.update({k.replace("__", "."): str(v) for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Where that setting is absent a folder is made only for a session on one machine (tests);
    on a cluster that would scatter tables over the executors' own disks, so it is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if configured:
        if not current:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    if not current:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(base)
        current = spark.sparkContext.getCheckpointDir()
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, for tables a job writes and reads back."""
    return f"{shared_dir(spark).rstrip('/')}/tables/{name}-{os.urandom(6).hex()}"


def stage(df: DataFrame) -> DataFrame:
    """Materialise a table several branches of one plan read: Parquet in the shared folder.

    It survives the loss of executors, later reads prune its columns, and its measured
    size lets the planner choose a broadcast by itself.  Every branch then also sees the
    same floating-point results (sums depend on arrival order, so two evaluations of one
    plan may differ in the last bit).
    """
    return stage_at(df)[0]


def stage_at(df: DataFrame) -> tuple[DataFrame, str]:
    """``stage``, with the folder of the table, so that loops can ``discard`` what they have read."""
    spark = df.sparkSession
    path = scratch_path(spark, "stage")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a staged table that no later plan reads."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
