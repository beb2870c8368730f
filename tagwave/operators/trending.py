"""Trending counts over the last six hours (O-25, O-26, O-30, O-31, O-64).

The reference keeps a 6 h window sliding every 30 s. ``window('6 hours', '30 seconds')`` would
copy every row into 720 windows, so scores are built from 30 s bucket counts instead: one
partial+final hash aggregate per (hashtag, bucket), then a RANGE sum over the buckets of one
hashtag. A hashtag's window group holds at most one row per bucket of a day (and the window
before it), however many edits it has. Buckets and windows are half-open ``[start, end)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import epoch_seconds, score_key, ts_literal

WINDOW_SECONDS = 6 * 3600
SLIDE_SECONDS = 30
CHUNK_SECONDS = 24 * 3600
WINDOW_LABEL = "6"


def bucket_end(ts: str = "ts", slide: int = SLIDE_SECONDS):
    """End (epoch s) of the half-open slide bucket holding ``ts``: a row at an end opens the next."""
    return ((F.floor(epoch_seconds(ts) / slide) + 1) * slide).cast(T.LongType())


def default_as_of(rows: DataFrame, ts: str = "ts", slide: int = SLIDE_SECONDS) -> int | None:
    """End of the slide bucket holding the latest row: the instant the last window closes.

    One scalar aggregate (partial max per task, one value to the driver).
    """
    latest = rows.agg(F.max(epoch_seconds(ts)).alias("m")).first()["m"]
    return None if latest is None else (latest // slide + 1) * slide


def clock_bounds(clock: DataFrame, ts: str = "ts") -> tuple[int | None, int | None]:
    """(oldest, newest) epoch second of an arrival clock column: one scan of that column."""
    row = clock.agg(F.min(epoch_seconds(ts)), F.max(epoch_seconds(ts))).first()
    return row[0], row[1]


def probe_as_of(raw: DataFrame, derive, ts: str = "ts", slide: int = SLIDE_SECONDS,
                first_span: int = WINDOW_SECONDS, growth: int = 8, clock: DataFrame | None = None) -> int | None:
    """``default_as_of`` of ``derive(raw)`` without decoding the whole history.

    ``raw`` carries the arrival clock before the costly decode (``derive``). The newest derived
    row lies in the newest raw slice that yields any row, so slices ``[top - span, top]`` are
    probed with spans growing ``growth``-fold until one yields a row or covers all of ``raw``.
    Slice bounds are literals, so each probe reads only the row groups of its slice; a typical
    call reads the ``ts`` column once and decodes one six-hour slice. ``clock`` (optional) is
    the stored table ``raw`` is built from, so the bounds come straight off its scan.
    """
    lo_all, top = clock_bounds(clock if clock is not None else raw, ts)
    if top is None:
        return None
    ntz = _is_ntz(raw, ts)
    span = first_span
    while True:
        lo = top - span
        part = raw if lo <= lo_all else raw.where(F.col(ts) >= ts_literal(lo, ntz))
        found = default_as_of(derive(part), ts, slide)
        if found is not None or lo <= lo_all:
            return found
        span *= growth


def probe_newest(raw: DataFrame, derive, n: int, ts: str = "ts", clock: DataFrame | None = None,
                 first_span: int = WINDOW_SECONDS, growth: int = 8) -> DataFrame:
    """Raw rows that hold the ``n`` newest rows of ``derive(raw)``, without decoding the whole history.

    Slices of the arrival clock are counted backwards from the newest edit, spans growing ``growth``-fold,
    until they yield ``n`` derived rows or all of ``raw`` is read; bounds are literals and reach the scan.
    """
    lo_all, top = clock_bounds(clock if clock is not None else raw, ts)
    if top is None:
        return raw
    ntz, span, hi, found = _is_ntz(raw, ts), first_span, None, 0
    while True:
        lo = top - span
        part = raw if lo <= lo_all else raw.where(F.col(ts) >= ts_literal(lo, ntz))
        fresh = part if hi is None else part.where(F.col(ts) < ts_literal(hi, ntz))
        found += derive(fresh).count()
        if found >= n or lo <= lo_all:
            return part
        hi, span = lo, span * growth


def _is_ntz(df: DataFrame, ts: str) -> bool:
    return isinstance(df.schema[ts].dataType, T.TimestampNTZType)


def in_window(df: DataFrame, as_of: int, window: int = WINDOW_SECONDS, ts: str = "ts") -> DataFrame:
    """Rows with ``as_of - window <= ts < as_of``, bounds as literals so parquet skips row groups."""
    ntz = _is_ntz(df, ts)
    return df.where((F.col(ts) >= ts_literal(as_of - window, ntz)) & (F.col(ts) < ts_literal(as_of, ntz)))


def trending(hashtag_rows: DataFrame, as_of: int | None = None, window: int = WINDOW_SECONDS,
             ts: str = "ts") -> DataFrame:
    """Per hashtag, the number of (feature, hashtag) rows in ``[as_of - window, as_of)`` (O-30).

    ``as_of`` defaults to the end of the 30 s bucket holding the latest row, so it agrees with
    the rolling score of that bucket (O-31). Output: hashtag, score.
    """
    if as_of is None:
        as_of = default_as_of(hashtag_rows, ts)
        if as_of is None:
            return hashtag_rows.select("hashtag").where(F.lit(False)).withColumn("score", F.lit(0).cast("bigint"))
    return (in_window(hashtag_rows, as_of, window, ts)
            .groupBy("hashtag").agg(F.count(F.lit(1)).alias("score")))


def bucket_counts(hashtag_rows: DataFrame, slide: int = SLIDE_SECONDS, ts: str = "ts") -> DataFrame:
    """(hashtag, bucket_end, n): rows per hashtag per slide bucket, partial aggregation first."""
    return (hashtag_rows.groupBy("hashtag", bucket_end(ts, slide).alias("bucket_end"))
            .agg(F.count(F.lit(1)).alias("n")))


def rolling_scores(buckets: DataFrame, window: int = WINDOW_SECONDS, slide: int = SLIDE_SECONDS,
                   chunk: int = CHUNK_SECONDS) -> DataFrame:
    """Score at every non-empty bucket end: the sum of the buckets inside the window (O-31).

    The incremental add-new / subtract-old reduce of the reference, written as a RANGE frame
    over ``window - slide`` seconds back to the current bucket. A hashtag's history is cut into chunks of
    ``chunk`` seconds, each with a copy of the window before it, so a window group holds a day's
    buckets however long the history is. Output: hashtag, bucket_end, score.
    """
    own = F.floor(F.col("bucket_end") / chunk)
    reach = F.floor((F.col("bucket_end") + (window - slide)) / chunk)  # later chunks whose first window reaches here
    spread = buckets.select("hashtag", "bucket_end", "n", own.alias("_own"), F.explode(F.sequence(own, reach)).alias("_chunk"))
    w = (Window.partitionBy("hashtag", "_chunk").orderBy("bucket_end")
         .rangeBetween(-(window - slide), Window.currentRow))
    scored = spread.withColumn("score", F.sum("n").over(w).cast("bigint"))
    return scored.where(F.col("_own") == F.col("_chunk")).select("hashtag", "bucket_end", "score")


def latest_buckets(bucket_log: DataFrame) -> DataFrame:
    """Upsert read: the newest ``batch_id`` per (hashtag, bucket_end) wins (O-05 read side)."""
    return (bucket_log.groupBy("hashtag", "bucket_end")
            .agg(F.max_by("n", "batch_id").alias("n")))


def zero_scores(scores: DataFrame, known_tags: DataFrame) -> DataFrame:
    """Every hashtag ever seen, with score 0 when nothing is in the window (O-64).

    The reference's windowed state has no filter function, so keys whose count falls to zero
    persist and keep being written as 0. ``known_tags`` is one row per distinct hashtag.
    """
    return (known_tags.select("hashtag").distinct()
            .join(scores, "hashtag", "left")
            .select("hashtag", F.coalesce("score", F.lit(0)).cast("bigint").alias("score")))


def filter_min_score(scores: DataFrame, min_exclusive: int = 1) -> DataFrame:
    """Hashtags mentioned more than ``min_exclusive`` times; NULL scores fail the test (O-25)."""
    return scores.where(F.col("score") > min_exclusive)


def scores_for_window(scores: DataFrame, label: str = WINDOW_LABEL) -> DataFrame:
    """Rows of one window label (O-26); a partition filter on a table partitioned by label."""
    return scores.where(F.col("window_label") == label)


def with_score_keys(scores: DataFrame, label: str = WINDOW_LABEL) -> DataFrame:
    """Labelled score rows as the reference keys them: window_label, key, hashtag, score."""
    return scores.select(F.lit(label).alias("window_label"), score_key(label, "hashtag").alias("key"),
                         "hashtag", "score")
