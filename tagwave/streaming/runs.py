"""Runs: the folders of data files that commits add to the stream's tables.

A run is written to a folder of its own (``<key>/attempt=<id>``) and described by a dict that a manifest can hold. Its files
carry the statistics by which readers choose the ones to open. Runs are merged by size tiers: a merge takes all
runs of tier 0 and every higher tier up to the first free one, so each tier above 0 has at most one run and a row
is rewritten at most once per tier.
"""

from __future__ import annotations

import base64
import os
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import file_system

BLOOM_BITS = 32_768  # one bitmap of Spark's bitmap functions: 4 KB a file

Keep = Callable[[dict], bool]


def bloom_position(hashtag: Column) -> Column:
    return F.pmod(F.xxhash64(hashtag), F.lit(BLOOM_BITS))


def bloom_holds(bloom: str | None, position: int) -> bool:
    """Whether a file with this bitmap may hold a value; without one it may."""
    return bloom is None or bool(base64.b64decode(bloom)[position // 8] >> position % 8 & 1)


def _plain(value):
    """A statistic as JSON can hold it."""
    if isinstance(value, (bytes, bytearray)):
        return base64.b64encode(bytes(value)).decode()
    return list(value) if isinstance(value, tuple) else value


def _listed(spark: SparkSession, folder: str) -> list[str]:
    """Data files of a run's folder, below it."""
    fs, where = file_system(spark, folder)
    mark, out, found = os.path.basename(folder) + "/", [], fs.listFiles(where, True)
    while found.hasNext():
        path = found.next().getPath()
        if path.getName().startswith("part-"):
            out.append(path.toString().rpartition(mark)[2])
    return sorted(out)


def write_run(df: DataFrame, root: str, key: str, stats: dict[str, Column] | None = None, tier: int = 0,
              options: dict[str, str] | None = None, partition_by: Sequence[str] = ()) -> dict:
    """Write a run of the table at ``root`` and describe it. ``stats`` are aggregates for each file, read back from the written
    columns they use; without them the files are only listed and ``rows`` is None."""
    spark = df.sparkSession
    path = f"{key}/attempt=a{uuid.uuid4().hex}"
    folder = os.path.join(root, path)
    df.write.options(**(options or {})).parquet(folder, partitionBy=list(partition_by) or None)
    if stats is None:
        return {"path": path, "rows": None, "tier": tier, "files": [{"name": n, "rows": None} for n in _listed(spark, folder)]}
    schema = T.StructType([f for f in df.schema.fields if f.name not in partition_by])
    held = (spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(folder)
            .groupBy(F.col("_metadata.file_path").alias("_name"))
            .agg(F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in stats.items()]).collect())
    files = [{k: _plain(v) for k, v in r.asDict().items() if k != "_name"}
             | {"name": r["_name"].rpartition(os.path.basename(path) + "/")[2]} for r in held]
    files.sort(key=lambda f: f["name"])
    return {"path": path, "rows": sum(f["rows"] for f in files), "tier": tier, "files": files}


def chosen_files(root: str, runs: Sequence[dict], keep: Keep | None = None) -> list[str]:
    """The files a reader opens."""
    return [os.path.join(root, r["path"], f["name"]) for r in runs for f in r["files"]
            if f["rows"] != 0 and (keep is None or keep(f))]


def read_runs(spark: SparkSession, root: str, schema: T.StructType, runs: Sequence[dict], keep: Keep | None = None) -> DataFrame:
    """The rows of the runs' files that ``keep`` accepts by their statistics."""
    files = chosen_files(root, runs, keep)
    if not files:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", root).parquet(*files).select(schema.fieldNames())


def overlaps(lo, hi) -> Keep:
    """Files whose ``lo`` to ``hi`` meets the closed range."""
    return lambda f: f["lo"] is None or (f["lo"] <= hi and f["hi"] >= lo)


def due(runs: Sequence[dict], every: int) -> tuple[list[dict], int] | None:
    """The runs to merge and the merged run's tier, once tier 0 has ``every`` runs."""
    merge = [r for r in runs if r["tier"] == 0]
    if len(merge) < every:
        return None
    tier = 1
    while held := [r for r in runs if r["tier"] == tier]:
        merge += held
        tier += 1
    return merge, tier
