"""The stored timeline (O-08, O-09, O-67): versions made of cells, so that a refresh rewrites the cells it changes.

A cell is a stretch of the timeline order with at most ``CELL_ROWS`` runs; a row knows its ``place`` in the cell, and its position
is the cell's offset plus that place. So the rows of an untouched cell stay as they are when runs come or go before them. A
version is a manifest that lists its cells in order, with their row counts; it appears whole or not at all, and unchanged cells
are shared between versions.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.timeline import timeline_order
from ..plans.scan import ordered_scan
from ..schema import TIMELINE
from ..session import file_system, path_exists, sub_folders
from .commits import CommitConflict, create_text, read_text

CELL_ROWS = 1 << 17
KEEP_VERSIONS = 3  # for readers that are under way

_RUN = [f for f in TIMELINE.fields if f.name != "position"]
_KEY = ["attempt", "group", "piece"]  # folders of a cell
_STORED = T.StructType([*_RUN, T.StructField("place", T.LongType()), T.StructField("attempt", T.StringType()),
                        T.StructField("group", T.LongType()), T.StructField("piece", T.LongType())])
_INDEX = T.StructType([T.StructField("attempt", T.StringType()), T.StructField("group", T.LongType()),
                       T.StructField("piece", T.LongType()), T.StructField("cell", T.LongType()),
                       T.StructField("offset", T.LongType())])


def _manifest_file(path: str, version: int) -> str:
    return os.path.join(path, f"version={version}", "_cells.json")


def versions(spark: SparkSession, path: str) -> list[int]:
    """Whole versions of the stored timeline: their write has committed."""
    numbers = [int(n.partition("=")[2]) for n in sub_folders(spark, path) if n.startswith("version=")]
    return sorted(v for v in numbers if path_exists(spark, os.path.join(path, f"version={v}", "_SUCCESS"))
                  or path_exists(spark, _manifest_file(path, v)))


def read_manifest(spark: SparkSession, path: str, version: int | None = None) -> dict | None:
    """Manifest of a version (default: the newest); None if there is no version, or it was written as one table."""
    if version is None:
        done = versions(spark, path)
        if not done:
            return None
        version = done[-1]
    name = _manifest_file(path, version)
    return json.loads(read_text(spark, name)) if path_exists(spark, name) else None


def read_cells(spark: SparkSession, path: str, cells: list[dict], only: set[int] | None = None) -> DataFrame:
    """Rows of the cells (``only`` those with these numbers): the runs, ``place``, ``cell`` and ``offset``."""
    index, offset = [], 0
    for number, cell in enumerate(cells):
        if only is None or number in only:
            index.append((*[cell[k] for k in _KEY], number, offset))
        offset += cell["rows"]
    root = os.path.join(path, "cells")
    if not index:
        return spark.createDataFrame([], T.StructType([*_STORED.fields, *_INDEX.fields[3:]]))
    folders = [os.path.join(root, *[f"{k}={v}" for k, v in zip(_KEY, row)]) for row in index]
    stored = spark.read.schema(_STORED).option("basePath", root).parquet(*folders)
    return stored.join(F.broadcast(spark.createDataFrame(index, _INDEX)), _KEY)  # a row per cell of 2^17 runs


def read_version(spark: SparkSession, path: str, cells: list[dict]) -> DataFrame:
    """The timeline of a version's cells, unordered."""
    return (read_cells(spark, path, cells).withColumn("position", F.col("offset") + F.col("place"))
            .select(TIMELINE.fieldNames()))


def with_cell(runs: DataFrame, firsts: DataFrame) -> DataFrame:
    """``runs`` with ``cell``: that of the last of the cells' first rows at or before the run, 0 before all of them."""
    cols = [f.name for f in _RUN]
    marked = runs.select(*cols, F.lit(0).alias("_first")).unionByName(firsts.select(*cols, F.lit(1).alias("_first")))
    scanned = ordered_scan(marked, [*timeline_order(), F.col("_first").desc()], sums={"_seen": F.col("_first")})
    return scanned.where("_first = 0").select(*cols, F.greatest(F.col("_seen") - 1, F.lit(0)).cast("bigint").alias("cell"))


def _touched(spark: SparkSession, path: str, cells: list[dict], fresh: DataFrame, changed: DataFrame, cell_rows: int) -> set[int]:
    """Numbers of the cells that lose or gain rows; all of them once there are many more than their rows need."""
    if len(cells) > 2 * -(-sum(c["rows"] for c in cells) // cell_rows) + 16:
        return set(range(len(cells)))
    losing = read_cells(spark, path, cells).join(changed, "hashtag", "left_semi").select("cell")
    return {r[0] for r in losing.union(fresh.select("cell")).distinct().collect()}  # at most one row per cell


def _stretches(touched: set[int]) -> dict[int, int]:
    """Cell -> the least cell of its stretch of neighbouring touched cells."""
    out: dict[int, int] = {}
    for c in sorted(touched):
        out[c] = out.get(c - 1, c)
    return out


def merge_timeline(runs: DataFrame, path: str, base: dict | None = None, changed: DataFrame | None = None,
                   facts: dict | None = None, cell_rows: int = CELL_ROWS, keep: int = KEEP_VERSIONS) -> dict:
    """Write the next version: ``base`` (a manifest) with the runs of the ``changed`` hashtags replaced by ``runs``; without
    ``changed``, ``runs`` are the whole timeline. Raises ``CommitConflict`` if another writer was faster.

    New runs find their cell by one ordered scan together with the cells' first rows. Each stretch of neighbouring touched cells is
    numbered anew and cut into cells; all other cells are listed as they are. Returns the new manifest."""
    spark = runs.sparkSession
    done = versions(spark, path)
    cells = base["cells"] if base is not None and changed is not None else []
    if cells:
        fresh = with_cell(runs, read_cells(spark, path, cells).where("place = 1")).checkpoint(eager=True)
        touched = _touched(spark, path, cells, fresh, changed, cell_rows)
        stays = read_cells(spark, path, cells, touched).join(changed, "hashtag", "left_anti").select(fresh.columns)
        rows = stays.unionByName(fresh)
    else:
        touched, rows = {0}, runs.select(*[f.name for f in _RUN], F.lit(0).cast("bigint").alias("cell"))
    start_of = _stretches(touched)
    pieces: dict[int, list[dict]] = {}
    if touched:
        pairs = spark.createDataFrame(list(start_of.items()), "cell bigint, `group` bigint")
        pieces = _write_cells(rows.join(F.broadcast(pairs), "cell").drop("cell"), path, cell_rows)
    listed = []
    for number, cell in enumerate(cells or [None]):
        if number not in start_of:
            listed.append(cell)
        elif start_of[number] == number:
            listed += pieces.get(number, [])
    version = base["version"] + 1 if cells else (done[-1] if done else 0) + 1
    manifest = {"version": version, "cells": listed, "rewritten": sum(map(len, pieces.values())), "facts": facts or {}}
    if version in done or not create_text(spark, _manifest_file(path, version), json.dumps(manifest)):
        raise CommitConflict(f"timeline version {version} exists")
    drop_versions(spark, path, keep)
    return manifest


def _write_cells(rows: DataFrame, path: str, cell_rows: int) -> dict[int, list[dict]]:
    """Number the rows of each group in timeline order and write them in cells of ``cell_rows``: group -> its cells in order."""
    attempt = f"a{uuid.uuid4().hex}"
    folder = os.path.join(path, "cells", f"attempt={attempt}")
    ranked = ordered_scan(rows, timeline_order(), by=["group"], rank="place")
    cut = (ranked.withColumn("piece", F.expr(f"(place - 1) div {int(cell_rows)}"))
           .withColumn("place", F.col("place") - F.col("piece") * cell_rows))
    (cut.repartition("group", "piece").sortWithinPartitions("group", "piece", "place")
     .write.parquet(folder, partitionBy=["group", "piece"]))
    held = (rows.sparkSession.read.schema(_STORED).parquet(folder).groupBy("group", "piece")
            .agg(F.count(F.lit(1)).alias("rows"), F.sum("count").alias("entries")).orderBy("group", "piece").collect())
    out: dict[int, list[dict]] = {}
    for r in held:
        out.setdefault(r["group"], []).append({"attempt": attempt, **r.asDict()})
    return out


def drop_versions(spark: SparkSession, path: str, keep: int = KEEP_VERSIONS) -> None:
    """Delete all but the newest ``keep`` versions, and the cells that no kept version lists."""
    done = versions(spark, path)
    old = done[:-keep]
    if not old:
        return
    listed = lambda vs: {tuple(c[k] for k in _KEY) for v in vs for c in (read_manifest(spark, path, v) or {"cells": []})["cells"]}
    unused = listed(old) - listed(done[-keep:])
    for key in unused:
        fs, where = file_system(spark, os.path.join(path, "cells", *[f"{k}={v}" for k, v in zip(_KEY, key)]))
        fs.delete(where, True)
    for version in old:
        fs, where = file_system(spark, os.path.join(path, f"version={version}"))
        fs.delete(where, True)
