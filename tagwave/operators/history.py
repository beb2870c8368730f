"""Membership index over slices of the history (O-36): which slices of the arrival clock hold a hashtag.

The newest entry of a hashtag before the window may lie anywhere in the history. Decoding slice after slice backwards costs the
whole history for a hashtag that has none, so the index stores each (hashtag, slice) pair once, sorted by hashtag. One join
then names the slices to decode: the newest older one of each hashtag, none for a new hashtag. The pairs are exact,
so no second look is needed, as it would be with bloom filters, and no hashtag is tested against every slice.

The arrival clock only grows, so a slice that has ended doesn't change. ``extend_index`` decodes the slices that ended since the last
call and adds them as one folder ``upto=<clock>``; a folder counts once its write has committed.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import epoch_seconds, ts_literal
from ..session import path_exists, sub_folders
from .timeline import union_edges
from .trending import WINDOW_SECONDS, _is_ntz

SLICE_SECONDS = WINDOW_SECONDS
MAX_RANGES = 64  # ranges of one decode's filter; the nearest ones are joined beyond it

INDEX = T.StructType([T.StructField("hashtag", T.StringType()), T.StructField("slice", T.LongType())])


def slice_of(ts: str = "ts", seconds: int = SLICE_SECONDS) -> Column:
    """Start (epoch s) of the slice that holds ``ts``."""
    return (F.floor(epoch_seconds(ts) / seconds) * seconds).cast("bigint")


def _folders(spark: SparkSession, path: str) -> list[int]:
    ends = [int(n.partition("=")[2]) for n in sub_folders(spark, path) if n.startswith("upto=")]
    return sorted(e for e in ends if path_exists(spark, os.path.join(path, f"upto={e}", "_SUCCESS")))


def indexed_upto(spark: SparkSession, path: str) -> int | None:
    """End (epoch s) of the indexed history, None before the first call."""
    done = _folders(spark, path)
    return done[-1] if done else None


def extend_index(hashtag_rows: DataFrame, path: str, upto: int, seconds: int = SLICE_SECONDS) -> int:
    """Index the slices that have ended by ``upto``; returns the end of the indexed history. Only rows after the
    indexed part are decoded; rows without a clock are in no slice."""
    spark = hashtag_rows.sparkSession
    since, end, ntz = indexed_upto(spark, path), upto // seconds * seconds, _is_ntz(hashtag_rows, "ts")
    if since is not None and end <= since:
        return since
    rows = hashtag_rows.where(F.col("ts") < ts_literal(end, ntz))
    if since is not None:
        rows = rows.where(F.col("ts") >= ts_literal(since, ntz))
    pairs = rows.select("hashtag", slice_of("ts", seconds).alias("slice")).distinct()
    (pairs.repartitionByRange("hashtag", "slice").sortWithinPartitions("hashtag", "slice")
     .write.mode("overwrite").parquet(os.path.join(path, f"upto={end}")))
    return end


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(hashtag, slice) pairs of the indexed history."""
    done = _folders(spark, path)
    if not done:
        return spark.createDataFrame([], INDEX)
    return spark.read.schema(INDEX).parquet(*[os.path.join(path, f"upto={e}") for e in done])


def slices_to_decode(index: DataFrame, tags: DataFrame, before: int, seconds: int = SLICE_SECONDS) -> DataFrame:
    """(hashtag, slice): for each hashtag of ``tags`` the newest slice that ended by ``before``, and the slice that holds ``before``
    if the hashtag is in it (its rows there may be later)."""
    at = before // seconds * seconds
    s = F.col("slice")
    held = (index.where((s < before)).join(tags.select("hashtag").distinct(), "hashtag").groupBy("hashtag")
            .agg(F.max(F.when(s < at, s)).alias("_older"), F.max(F.when(s >= at, s)).alias("_at")))
    return held.select("hashtag", F.explode(F.array_compact(F.array("_older", "_at"))).alias("slice"))


def _ranges(slices: list[int], seconds: int, most: int = MAX_RANGES) -> list[tuple[int, int]]:
    """Neighbouring slices as ranges, the nearest ones joined until at most ``most`` are left."""
    out: list[list[int]] = []
    for s in sorted(slices):
        if out and out[-1][1] == s:
            out[-1][1] = s + seconds
        else:
            out.append([s, s + seconds])
    if len(out) > most:
        gaps = sorted(range(1, len(out)), key=lambda i: out[i][0] - out[i - 1][1])
        joined, kept = set(gaps[:len(out) - most]), []
        for i, r in enumerate(out):
            if i in joined:
                kept[-1][1] = r[1]
            else:
                kept.append(r)
        out = kept
    return [(a, b) for a, b in out]


def newest_by_index(hashtag_rows: DataFrame, tags: DataFrame, lo: int, index_path: str, known: DataFrame | None = None,
                    known_lo: int | None = None, seconds: int = SLICE_SECONDS) -> DataFrame:
    """``timeline.newest_before`` through the index: each hashtag's newest row with ``ts < lo``.

    ``known`` is an already decoded slice covering ``[known_lo, lo)``. History between the index's end and that is decoded; of the
    indexed history only the slices the index names are, in one job with their ranges as literal bounds. The slices come to
    the driver as numbers, at most one per ``seconds`` of history. Returns candidate rows (a few per hashtag)."""
    spark, ntz = hashtag_rows.sparkSession, _is_ntz(hashtag_rows, "ts")
    cols = ["edit_id", "ts", "pos", "date", "feature"]
    upto, later = indexed_upto(spark, index_path), lo if known is None else min(known_lo, lo)
    newest = F.max_by(F.struct(*cols), F.struct("ts", "edit_id", "pos")).alias("r")
    opened = lambda rows: rows.select("hashtag", *[F.col(f"r.{c}").alias(c) for c in cols])

    decoded = []
    if known is not None:
        decoded.append(known.where((F.col("ts") >= ts_literal(known_lo, ntz)) & (F.col("ts") < ts_literal(lo, ntz))))
    if upto is None or upto < later:  # what has arrived since the index was extended
        tail = hashtag_rows.where(F.col("ts") < ts_literal(later, ntz))
        decoded.append(tail if upto is None else tail.where(F.col("ts") >= ts_literal(upto, ntz)))
    found, missing = [], tags.select("hashtag")
    if decoded:  # aggregated first: at most one row per task and hashtag meets the wanted ones
        rows = union_edges(*[d.select("hashtag", *cols) for d in decoded])
        found.append(opened(rows.groupBy("hashtag").agg(newest).join(missing, "hashtag", "left_semi")).checkpoint(eager=True))
        missing = missing.join(found[-1], "hashtag", "left_anti")
    if upto is not None:
        wanted = slices_to_decode(read_index(spark, index_path), missing, min(later, upto), seconds).checkpoint(eager=True)
        ranges = _ranges([r[0] for r in wanted.select("slice").distinct().collect()], seconds)
        if ranges:
            inside = F.lit(False)
            for a, b in ranges:
                inside = inside | ((F.col("ts") >= ts_literal(a, ntz)) & (F.col("ts") < ts_literal(min(b, lo), ntz)))
            rows = hashtag_rows.where(inside).groupBy("hashtag", slice_of("ts", seconds).alias("slice")).agg(newest)
            found.append(opened(rows.join(wanted, ["hashtag", "slice"], "left_semi")))
    return union_edges(*found) if found else hashtag_rows.select("hashtag", *cols).where(F.lit(False))
