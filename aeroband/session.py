"""Session settings and table access shared by jobs, tests and the bench."""

from __future__ import annotations

import ctypes
import os
import re
import sys
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

ADAPTIVE_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(app: str = "aeroband", cpus: int | str = "*", memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and the bench.  Clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in ADAPTIVE_SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_utc(spark: SparkSession) -> SparkSession:
    """All operators take UTC wall-clock times."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_directory(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's ``spark.checkpoint.dir``.

    Where the setting is absent, which is the case in single-machine tests, a folder of the
    session is used; a cluster without the setting is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    return os.path.join(tempfile.gettempdir(), f"aeroband-{spark.sparkContext.applicationId}")


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme of the default file system, so that no task takes it for its own disk."""
    if re.match(r"^[a-z][a-z0-9+.-]*:", path):
        return path
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()


def run_directory(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder for one run of one job."""
    return f"{qualified(spark, shared_directory(spark))}/{label}-{uuid.uuid4().hex}"


def release() -> None:
    """What this Python process has freed goes back to the system, where its allocators can do that.

    For the driver after work on arrays, whose freed memory would stay with it for the whole session."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None  # glibc's only
    if trim:
        trim(0)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage by writing to the shared folder, so lost executors cost a re-read only.

    The write's own shuffle files go when it ends, not when the driver next collects garbage."""
    spark = df.sparkSession
    path = run_directory(spark, label)
    before = spark.conf.get(SHUFFLE_CLEANUP)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def within_bytes(df: DataFrame, limit: int) -> bool:
    """True when the optimizer's size estimate, an upper bound for scans, is within limit."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(size)) <= limit


def small_side(df: DataFrame, limit: int = 32 << 20) -> DataFrame:
    """Broadcast hint when the optimizer's estimate proves the side small; otherwise unchanged.

    No job runs.  An unhinted side is left to the optimizer, which may still broadcast it
    by what it measures at run time, so nothing is lost when the table grows.
    """
    return F.broadcast(df) if within_bytes(df, limit) else df


def spread(scan: DataFrame, limit: int = 64 << 20) -> DataFrame:
    """Rows of a small scan over all cores, for compute-heavy row-local work.

    Only where the estimate is under ``limit`` bytes, so the shuffle is small on any
    cluster; a larger scan has splits of its own and passes through.
    """
    if scan.isStreaming or not within_bytes(scan, limit):
        return scan
    return scan.repartition(scan.sparkSession.sparkContext.defaultParallelism)
