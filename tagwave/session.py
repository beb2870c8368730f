"""Session helpers: a local session for tests and the shared scratch folder for sinks."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "tagwave") -> SparkSession:
    """Session for tests and the bench: UTC clock, AQE on, UI off, own scratch folder."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config(CHECKPOINT_CONF, tempfile.mkdtemp(prefix="tagwave-ckpt-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, choosing a private one only when none is configured.

    On a cluster the folder comes from ``spark.checkpoint.dir`` (a shared file system). Only a
    local-mode session without it (a test) gets a fresh temporary folder.
    """
    sc = spark.sparkContext
    path = spark.conf.get(CHECKPOINT_CONF, None) or sc.getCheckpointDir()
    if not path:
        if not re.match(r"local(\[|$)", sc.master or ""):
            raise RuntimeError(f"{CHECKPOINT_CONF} must name a shared folder on a cluster")
        path = tempfile.mkdtemp(prefix="tagwave-ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for one run of a sink or stream."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "tagwave", f"{name}-{uuid.uuid4().hex[:12]}")


def file_system(spark: SparkSession, path: str):
    """(file system, path) of a folder, resolved as Spark's own readers resolve it: the driver's
    disk need not hold it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, where = file_system(spark, path)
    return fs.exists(where)


def make_folder(spark: SparkSession, path: str) -> None:
    fs, where = file_system(spark, path)
    fs.mkdirs(where)


def file_sizes(spark: SparkSession, path: str) -> list[int]:
    """Sizes of the files in a folder (none if it does not exist)."""
    fs, where = file_system(spark, path)
    return [s.getLen() for s in fs.listStatus(where) if s.isFile()] if fs.exists(where) else []


def sub_folders(spark: SparkSession, path: str) -> list[str]:
    """Names of a folder's entries (none if it does not exist)."""
    fs, where = file_system(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
