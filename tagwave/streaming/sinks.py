"""Table sinks that replace the reference's key-value store (O-03..O-10, O-24).

The tables of the ingest stream are made of runs (``runs``) that a commit log lists (``commits``): a writer here writes one
run of its table and returns its description, and the run counts once a manifest names it. Readers open only files whose
statistics can match, and resolve "last write wins" and "newest first".

Tables outside the log (the stateful bucket counts, the feed's emissions) own one folder per batch and replace it whole, also
when it has no rows; a table that was never written reads as empty, any other failure raises.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import BUCKETS, HASHTAG_LOG, NEWEST, SCORES, TIMELINE
from ..session import path_exists
from .runs import bloom_holds, bloom_position, overlaps, read_runs, write_run
from .timeline_store import KEEP_VERSIONS, drop_versions, read_manifest, read_version
from .timeline_store import versions as _versions

RECENT_KEEP = 1001  # index 0..1000 of the capped feature list
LATEST_KEEP = 101   # index 0..100 of a hashtag's list
SLOTS = 4096        # hash ranges of the score store

_MICROS = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"


def _write_batch(df: DataFrame, batch_id: int, path: str, key: str = "batch_id") -> None:
    """Replace the folder ``key=batch_id`` of a table."""
    df.write.mode("overwrite").parquet(os.path.join(path, f"{key}={int(batch_id)}"))


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A table outside the commit log with its declared schema; empty if nothing was ever written."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).select(schema.fieldNames())


# --- recent features ------------------------------------------------------------------------

def write_recent_features(batch_df: DataFrame, batch_id: int, path: str) -> dict:
    """Feature records with their JSON text (O-03 write side): a segment with its row count and its
    least and greatest arrival sequence."""
    rec = F.to_json(F.struct("user", "id", "changeset", "date", "feature", "action", "comment", "hashtags"))
    rows = batch_df.select("edit_id", "ts", "user", "id", "changeset", "date", "feature", "action", "comment", "hashtags",
                           rec.alias("record"))
    place = F.struct(F.coalesce(F.expr(_MICROS), F.lit(0)), F.coalesce("edit_id", F.lit(0)))
    return write_run(rows, path, f"batch_id={int(batch_id)}", {"lo": F.min(place), "hi": F.max(place)})


def _bounds(run: dict) -> tuple[list, list]:
    return min(f["lo"] for f in run["files"]), max(f["hi"] for f in run["files"])


def newest_segments(runs: list[dict], n: int = RECENT_KEEP) -> list[dict]:
    """The segments that can hold one of the ``n`` newest rows: all but those below which ``n`` newer rows lie in segments
    that are newer as a whole."""
    full = [r for r in runs if r["rows"]]
    return [r for r in full if sum(o["rows"] for o in full if _bounds(o)[0] > _bounds(r)[1]) < n]


def recent_features(features: DataFrame, n: int = RECENT_KEEP) -> DataFrame:
    """The newest n features (O-03 read side): a top-k, not a sort of the table."""
    return features.orderBy(F.col("ts").desc(), F.col("edit_id").desc()).limit(n)


# --- hashtag log ----------------------------------------------------------------------------

def _write_log(rows: DataFrame, key: str, path: str, tier: int) -> dict:
    stats = {"lo": F.min("hashtag"), "hi": F.max("hashtag"), "bloom": F.bitmap_construct_agg(bloom_position(F.col("hashtag"))),
             "ts_lo": F.min(F.expr(_MICROS)), "ts_hi": F.max(F.expr(_MICROS))}
    return write_run(rows, path, key, stats, tier, options={"parquet.bloom.filter.enabled#hashtag": "true"})


def write_hashtag_log(batch_df: DataFrame, batch_id: int, path: str) -> dict:
    """(feature, hashtag) rows, never trimmed (O-04), by batch and not by hashtag: hashtag cardinality is unbounded, batches
    arrive in time order. Rows are sorted by hashtag inside a file; each file has its least and greatest hashtag and a bloom
    bitmap in the log's index, and a parquet bloom filter, so a one-hashtag lookup (O-28) opens few files."""
    rows = batch_df.select("edit_id", "ts", "pos", "date", "feature", "hashtag").sortWithinPartitions("hashtag", "ts")
    return _write_log(rows, f"batch_id={int(batch_id)}", path, 0)


def write_hashtag_newest(batch_df: DataFrame, batch_id: int, path: str) -> dict:
    """Per batch and hashtag: the newest log entry and the oldest entry time. A small index
    (one row per hashtag and batch) that lets a refresh find each hashtag's newest entry
    before a time without reading the whole log."""
    cols = ["ts", "edit_id", "pos", "date", "feature"]
    newest = (batch_df.groupBy("hashtag")
              .agg(F.max_by(F.struct(*cols), F.struct("ts", "edit_id", "pos")).alias("r"),
                   F.min("ts").alias("min_ts")))
    return write_run(newest.select("hashtag", *[F.col(f"r.{c}").alias(c) for c in cols], "min_ts"), path, f"batch_id={int(batch_id)}")


def _last_batch(runs: list[dict]) -> str:
    """Folder key of a merged run: its newest batch."""
    return max((r["path"].partition("/")[0] for r in runs), key=lambda k: int(k.partition("=")[2]))


def merge_hashtag_log(spark: SparkSession, runs: list[dict], tier: int, path: str) -> dict:
    """One run in the order of hashtags, cut into files by hashtag range."""
    rows = read_runs(spark, path, HASHTAG_LOG, runs).drop("batch_id")
    # ids as well, so that a hashtag with a third of all rows spans files
    ordered = rows.repartitionByRange("hashtag", "ts", "edit_id").sortWithinPartitions("hashtag", "ts")
    return _write_log(ordered, _last_batch(runs), path, tier)


def merge_hashtag_newest(spark: SparkSession, runs: list[dict], tier: int, path: str) -> dict:
    cols = ["ts", "edit_id", "pos", "date", "feature"]
    merged = (read_runs(spark, path, NEWEST, runs).groupBy("hashtag")
              .agg(F.max_by(F.struct(*cols), F.struct("ts", "edit_id", "pos")).alias("r"), F.min("min_ts").alias("min_ts"))
              .select("hashtag", *[F.col(f"r.{c}").alias(c) for c in cols], "min_ts"))
    return write_run(merged, path, _last_batch(runs), tier=tier)


def may_hold(spark: SparkSession, tag: str):
    """Chooses log files that may hold a hashtag: by range, then by the bloom bitmap."""
    position = spark.range(1).select(bloom_position(F.lit(tag))).first()[0]
    inside = overlaps(tag, tag)
    return lambda f: inside(f) and bloom_holds(f.get("bloom"), position)


def in_clock(lo: int, hi: int):
    """Chooses log files that may hold rows with a clock of ``lo`` to ``hi`` seconds (``hi`` exclusive)."""
    def keep(f: dict) -> bool:
        if "ts_lo" not in f:
            return True
        return f["ts_lo"] is not None and f["ts_lo"] < hi * 1_000_000 and f["ts_hi"] >= lo * 1_000_000
    return keep


def log_before(log: DataFrame, newest: DataFrame, lo) -> DataFrame:
    """Log rows that can be a hashtag's newest entry before ``lo`` (a timestamp Column).

    Runs whose newest entry of a hashtag is before ``lo`` contribute that entry (from the
    index). Runs straddling ``lo`` for a hashtag (oldest before, newest not) are read from
    the log; the semi-join on ``batch_id``, a partition column, lets dynamic partition pruning
    skip every other run's folder. Both tables are merged alike, so their ``batch_id`` agree.
    """
    cols = ["hashtag", "ts", "edit_id", "pos", "date", "feature"]
    whole = newest.where(F.col("ts") < lo).select(*cols)
    straddling = newest.where((F.col("min_ts") < lo) & (F.col("ts") >= lo)).select("batch_id", "hashtag")
    partial = log.join(straddling, ["batch_id", "hashtag"], "left_semi").where(F.col("ts") < lo).select(*cols)
    return whole.unionByName(partial)


def latest_for_hashtag(log: DataFrame, tag, n: int = LATEST_KEEP) -> DataFrame:
    """One hashtag's newest n entries (O-28): filter, then a top-k."""
    t = F.lit(tag) if isinstance(tag, str) else tag
    return (log.where(F.col("hashtag") == t)
            .orderBy(F.col("ts").desc(), F.col("edit_id").desc(), F.col("pos").desc()).limit(n))


# --- buckets --------------------------------------------------------------------------------

def write_buckets(batch_df: DataFrame, batch_id: int, path: str) -> None:
    """Bucket counts of one batch of the stateful stream: (hashtag, bucket_end, n)."""
    _write_batch(batch_df.select("hashtag", "bucket_end", "n"), batch_id, path)


def write_bucket_run(counts: DataFrame, batch_id: int, path: str, tier: int = 0) -> dict:
    """Bucket counts laid out by time: each file of a merged run covers a range of bucket ends of its own and a batch's files its
    short time, so a window opens its own files only."""
    rows = counts.select("hashtag", "bucket_end", "n")
    if tier:
        rows = rows.repartitionByRange("bucket_end", "hashtag")
    rows = rows.sortWithinPartitions("bucket_end")
    return write_run(rows, path, f"batch_id={int(batch_id)}", {"lo": F.min("bucket_end"), "hi": F.max("bucket_end")}, tier)


def merge_buckets(spark: SparkSession, runs: list[dict], tier: int, path: str) -> dict:
    merged = read_runs(spark, path, BUCKETS, runs).groupBy("hashtag", "bucket_end").agg(F.sum("n").alias("n"))
    return write_bucket_run(merged, int(_last_batch(runs).partition("=")[2]), path, tier)


# --- scores ---------------------------------------------------------------------------------

def slot_of(hashtag="hashtag"):
    """Hash range of the score store that holds a hashtag."""
    return F.pmod(F.xxhash64(hashtag), F.lit(SLOTS)).cast("int")


def write_scores(scores: DataFrame, version: int, path: str, tier: int = 0) -> dict:
    """Change rows of the score store (O-05): (window_label, hashtag, score, as_of), laid out by window label (O-26); merged runs
    are cut into files by hash range. A batch writes the scores that changed, no others."""
    rows = scores.select("window_label", "hashtag", "score", "as_of", slot_of().alias("slot"))
    rows = rows.repartitionByRange("window_label", "slot", "hashtag") if tier else rows.hint("rebalance")  # few small files
    rows = rows.sortWithinPartitions("window_label", "slot")
    return write_run(rows, path, f"version={int(version)}", {"lo": F.min("slot"), "hi": F.max("slot")}, tier, partition_by=["window_label"])


def read_scores(scores_log: DataFrame) -> DataFrame:
    """Last write wins per (window_label, hashtag): the value of the greatest version."""
    return (scores_log.groupBy("window_label", "hashtag")
            .agg(F.max_by(F.struct("score", "as_of"), "version").alias("r"))
            .select("window_label", "hashtag", "r.score", "r.as_of"))


def merge_scores(spark: SparkSession, runs: list[dict], tier: int, path: str) -> dict:
    """The last value of each score of the runs, which are neighbours in time."""
    return write_scores(read_scores(read_runs(spark, path, SCORES, runs)), int(_last_batch(runs).partition("=")[2]), path, tier)


# --- changes and rejects --------------------------------------------------------------------

def write_changes(records: DataFrame, batch_id: int, path: str, channel: str) -> dict:
    """Change notification (O-06): the ``record`` texts of one batch on a channel."""
    return write_run(records.select("record"), path, f"channel={channel}/batch_id={int(batch_id)}") | {"channel": channel}


def write_rejects(rejected: DataFrame, batch_id: int, path: str) -> dict:
    """Dead letters of one batch (O-24): edit_id, ts, payload, reason."""
    return write_run(rejected.select("edit_id", "ts", "payload", "reason"), path, f"batch_id={int(batch_id)}")


def as_record(df: DataFrame) -> DataFrame:
    """Rows as JSON texts in ``record``."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("record"))


# --- timeline -------------------------------------------------------------------------------

def write_timeline(timeline: DataFrame, path: str, keep: int = KEEP_VERSIONS) -> None:
    """Replace the stored timeline (O-08) by a positioned one: a new version folder, which readers see once it is
    whole. The newest ``keep`` versions stay for readers that are under way."""
    spark = timeline.sparkSession
    done = _versions(spark, path)
    timeline.write.mode("overwrite").parquet(os.path.join(path, f"version={(done[-1] if done else 0) + 1}"))
    drop_versions(spark, path, keep)


def read_timeline(spark: SparkSession, path: str) -> DataFrame:
    """Stored timeline (O-09), its newest whole version in timeline order; empty before the first."""
    done = _versions(spark, path)
    if not done:
        return spark.createDataFrame([], TIMELINE)
    manifest = read_manifest(spark, path, done[-1])
    if manifest is not None:
        return read_version(spark, path, manifest["cells"]).orderBy("position")
    return spark.read.schema(TIMELINE).parquet(os.path.join(path, f"version={done[-1]}")).orderBy("position")


def timeline_records(timeline: DataFrame) -> DataFrame:
    """The stored timeline as JSON text, one record per run in timeline order (O-08, O-51).

    The reference keeps one JSON array; here the array is never built in one row or task:
    each run is a record keyed by ``position``, and a reader concatenates them in order.
    """
    rec = F.to_json(F.struct("feature", "hashtag", "time", "last", "count"))
    return timeline.select("position", rec.alias("record"))


def preview(df: DataFrame, n: int = 10):
    """First n rows of a batch, as the reference prints them (O-10); a stream starts printing them
    to the console and its running query is returned."""
    if df.isStreaming:
        return df.writeStream.format("console").option("numRows", n).option("truncate", False).start()
    return df.limit(n)
