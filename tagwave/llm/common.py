"""Helpers shared by the operators: written intermediate tables and connected components."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from contextlib import AbstractContextManager, contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import file_system, scratch_path

#: folders written inside the innermost ``passing``
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str, few: bool = False) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back: cuts the lineage, so a lost
    executor costs a re-read, and every later branch sees the same rows. The shuffles behind it go from the executors' disks
    at once, not when the driver happens to collect its garbage. ``few``: for narrow tables, at most a few files per core of
    the cluster."""
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{name}")
    if few:
        df = df.coalesce(4 * spark.sparkContext.defaultParallelism)
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.parquet(path)
    if (made := _made.get()) is not None:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[..., DataFrame]]:
    """The tables written inside go from the disk at the end, but for those that a DataFrame given to the yielded function reads;
    these go with the block around this one, if there is any."""
    made, kept = [], set()

    def keep(df: DataFrame) -> DataFrame:
        kept.update(file.rsplit("/", 2)[-2] for file in df.inputFiles())
        return df

    outer = _made.get()
    token = _made.set(made)
    try:
        yield keep
    finally:
        _made.reset(token)
        for path in made:
            if os.path.basename(path) not in kept:
                fs, where = file_system(spark, path)
                fs.delete(where, True)
            elif outer is not None:
                outer.append(path)


@contextmanager
def setting(spark: SparkSession, name: str, value: str | int) -> Iterator[None]:
    """Meanwhile the session has the setting, unless it sets it itself."""
    if spark.conf.get(name, None) is not None:
        yield
        return
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name)


def small_batches(spark: SparkSession, most: int = 4 << 20) -> AbstractContextManager[None]:
    """Meanwhile Arrow batches take about ``most`` bytes, unless the session sets their size: by default a batch of long texts or
    sets takes up to 64 MB, several times over, beside the executor's heap. For operators whose rows don't depend on batches."""
    return setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", most)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Distributed union-find: (``node``, ``component``) for every node of an edge list, the
    component being its smallest node.

    Each round hooks a node to the smallest label among its neighbours (an aggregation with
    partial sums, so a hub with a third of all edges reaches no task whole) and then follows
    one pointer (label of the label). The label and edge tables are written tables, so both sides of
    each join are plain shuffles that AQE can split on a hot label. It ends when no label changes.
    An empty edge list gives an empty table; self-loops and repeated edges change nothing.
    """
    with passing(edges.sparkSession) as keep:
        pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
        both = written(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges", True)
        labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                         .select("node", F.least("node", "m").alias("component"), F.lit(True).alias("moved")), "labels", True)
        while not labels.where("moved").isEmpty():
            near = (both.join(labels.select(F.col("node").alias("b"), "component"), "b")
                    .groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m")))
            hooked = labels.select("node", "component").join(near, "node").select(
                "node", "component", F.least("component", "m").alias("m"))
            roots = labels.select(F.col("node").alias("m"), F.col("component").alias("up"))
            jumped = hooked.join(roots, "m").select(
                "node", F.least("m", "up").alias("component"), (F.least("m", "up") < F.col("component")).alias("moved"))
            labels = written(jumped, "labels", True)
        return keep(labels.select("node", "component"))
