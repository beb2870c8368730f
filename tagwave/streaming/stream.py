"""The streaming job (O-01, O-62, O-63, O-65, O-66), the timeline refresh (O-67) and the change
feed (O-07), run with ``availableNow`` over edit files Spark derives from ``events``.

One micro-batch does what the reference's three DStream outputs do, from one lineage, inside one ``foreachBatch`` and
in one commit: feature records, the hashtag log, 30 s bucket counts, scores, dead letters and change records. The six-hour
score is kept by change: the stored score plus the new buckets less those that leave the window, over bucket files
laid out by time. ``bucket_stream`` is the stateful alternative (tumbling window in update mode).
"""

from __future__ import annotations

import os
import time
from bisect import bisect_left
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import pack_entry, url_decode
from ..operators import edits as E
from ..operators import timeline as TL
from ..operators import trending as TR
from ..plans.catalog import LOOKUP_TAG
from ..schema import BUCKETS, CHANGES, FEATURES, FEED, HASHTAG_LOG, NEWEST, REJECTS, SCORES
from ..session import file_sizes, make_folder, scratch_path
from ..sources.edits import numbered_batch, parse_edits, read_edits
from ..sources.fixtures import load_edits
from . import sinks as S
from . import timeline_store as TS
from .commits import CommitConflict, CommitLog, State
from .runs import due, overlaps, read_runs

TRIGGER_SECONDS = 30   # micro-batch interval of the reference
REFRESH_SECONDS = 120  # timeline refresh interval of the reference
HASHTAG_CHANNEL = "hashtagsch"
FEATURE_CHANNEL = "featuresch"
WINDOWS = {TR.WINDOW_LABEL: TR.WINDOW_SECONDS}  # window label -> its seconds
INGEST = "ingest"      # the ingest's name in the commit log
MERGE_EVERY = 8        # runs of tier 0 that make a merge
CHANGES_KEEP = 1000    # commits whose change records stay for followers
BATCH_BYTES = 1 << 30  # files of one micro-batch
SPLIT_BYTES = 4 << 20  # of those files, read by one task: decoded edits are many times as large


def write_edit_files(spark: SparkSession, sf_dir: str, path: str, slices: int = 4) -> str:
    """Write the edits derived from ``events`` as parquet in arrival order, one job per time slice so
    that file times follow arrival (a file source replays them in order). Each slice has as many
    files as its rows need, in row groups of half a split: a task can't read less than one."""
    edits = load_edits(spark, sf_dir)
    make_folder(spark, path)
    lo, hi = TR.clock_bounds(edits)
    if lo is None:
        return path
    step = (hi - lo) // slices + 1
    for i in range(slices):
        a, b = lo + i * step, lo + (i + 1) * step
        part = edits.where((F.col("ts") >= TR.ts_literal(a)) & (F.col("ts") < TR.ts_literal(b)))
        part.write.mode("append").option("parquet.block.size", SPLIT_BYTES // 2).parquet(path)
    return path


def stream_paths(base: str) -> dict[str, str]:
    names = ("edits", "features", "hashtags", "newest", "buckets", "changes", "scores", "rejects", "commits", "timeline", "feed",
             "feed_log", "checkpoints")
    return {n: os.path.join(base, n) for n in names}


# --- the tables -----------------------------------------------------------------------------

SCHEMAS = {"features": FEATURES, "hashtags": HASHTAG_LOG, "newest": NEWEST, "buckets": BUCKETS, "scores": SCORES,
           "changes": CHANGES, "rejects": REJECTS}


def commit_log(spark: SparkSession, paths: dict[str, str]) -> CommitLog:
    return CommitLog(spark, paths["commits"])


def table(spark: SparkSession, paths: dict[str, str], name: str, state: State | None = None, keep=None, runs=None) -> DataFrame:
    """A table of the stream as of a state of its commit log (default: the newest); ``keep`` chooses files by their
    statistics, ``runs`` are the runs to read instead of all."""
    state = state or commit_log(spark, paths).state()
    return read_runs(spark, paths[name], SCHEMAS[name], state.runs(name) if runs is None else runs, keep)


def recent_segments(spark: SparkSession, paths: dict[str, str], n: int = S.RECENT_KEEP) -> DataFrame:
    """The segments of the capped feature log that hold its newest ``n`` rows (O-03)."""
    state = commit_log(spark, paths).state()
    return table(spark, paths, "features", state, runs=S.newest_segments(state.runs("features"), n))


def log_of(spark: SparkSession, paths: dict[str, str], tag: str) -> DataFrame:
    """The files of the hashtag log that may hold one hashtag (O-28)."""
    return table(spark, paths, "hashtags", keep=S.may_hold(spark, tag))


def last_scores(spark: SparkSession, paths: dict[str, str], state: State | None = None) -> DataFrame:
    """Every known (window_label, hashtag) with its score as of the newest score time, 0 for those out of the window (O-05, O-64)."""
    return S.read_scores(table(spark, paths, "scores", state))


def last_score_time(spark: SparkSession, paths: dict[str, str]) -> int | None:
    """The time the stored scores are as of."""
    return commit_log(spark, paths).state().facts.get("as_of")


def score_changes(spark: SparkSession, paths: dict[str, str], state: State, as_of: int, fresh: DataFrame | None = None,
                  windows: dict[str, int] | None = None) -> DataFrame:
    """(window_label, hashtag, score, as_of) of the scores that differ at ``as_of`` from those stored in ``state`` (O-31, O-63):
    a score plus its new buckets (``fresh``) less those that leave the window, the inverse reduce of the reference.

    The stored scores count the buckets that end in (before - window, before]. Leaving buckets end in (before - window, as_of -
    window]; only files of that range are opened, however long the history is. New rows count if they end after as_of - window, so
    late ones are counted as long as their bucket is in the window. A hashtag seen for the first time gets a row in any case.
    """
    before, parts = state.facts.get("as_of"), []
    for label, window in (windows or WINDOWS).items():
        lo = as_of - window
        if fresh is not None:
            n = F.when(F.col("bucket_end").between(lo + 1, as_of), F.col("n")).otherwise(F.lit(0))
            parts.append(fresh.select(F.lit(label).alias("window_label"), "hashtag", n.cast("bigint").alias("d")))
        if before is not None and as_of > before:
            leaving = table(spark, paths, "buckets", state, overlaps(before - window + 1, lo))
            parts.append(leaving.where(F.col("bucket_end").between(before - window + 1, lo))
                         .select(F.lit(label).alias("window_label"), "hashtag", (-F.col("n")).alias("d")))
    if not parts:
        return spark.createDataFrame([], T.StructType([SCORES[c] for c in ("window_label", "hashtag", "score", "as_of")]))
    delta = TL.union_edges(*parts).groupBy("window_label", "hashtag").agg(F.sum("d").alias("d")).persist()
    runs, keep = state.runs("scores"), None
    if any(r["tier"] for r in runs):  # merged runs are in the order of hash ranges
        slots = sorted(r[0] for r in delta.select(S.slot_of()).distinct().collect())  # at most SLOTS
        keep = lambda f: (k := bisect_left(slots, f["lo"])) < len(slots) and slots[k] <= f["hi"]
    stored = S.read_scores(table(spark, paths, "scores", state, keep)).drop("as_of")
    joined = delta.join(stored, ["window_label", "hashtag"], "left")
    return (joined.where(F.col("score").isNull() | (F.col("d") != 0))
            .select("window_label", "hashtag", (F.coalesce("score", F.lit(0)) + F.col("d")).cast("bigint").alias("score"),
                    F.lit(as_of).cast("bigint").alias("as_of")))


def advance_scores(spark: SparkSession, paths: dict[str, str], as_of: int, windows: dict[str, int] | None = None) -> None:
    """Bring the stored scores to a later time, without new edits, in a commit of its own."""
    log = commit_log(spark, paths)
    while True:
        state = log.state()
        if (state.facts.get("as_of") or as_of) >= as_of:
            return
        run = S.write_scores(score_changes(spark, paths, state, as_of, windows=windows), state.number + 1, paths["scores"])
        try:
            log.commit(state, {"scores": [run]}, facts={"as_of": as_of})
            return
        except CommitConflict:
            continue


# --- ingest ---------------------------------------------------------------------------------

def process_batch(paths: dict[str, str], windows: dict[str, int] | None = None, merge_every: int = MERGE_EVERY
                  ) -> Callable[[DataFrame, int], None]:
    """All outputs of one micro-batch from one lineage and in one commit (O-65, O-66): the edits are decoded once, the other sinks
    derive their runs from the features' run, and one manifest makes them all visible. A batch that was committed before is not
    written again; one that stopped half-way left nothing any reader sees."""

    opened: list[CommitLog] = []

    def run(batch_df: DataFrame, batch_id: int) -> None:
        spark = batch_df.sparkSession
        if not opened:
            opened.append(commit_log(spark, paths))  # reads new manifests only from batch to batch
        log = opened[0]
        while True:
            state = log.state()
            if state.marks.get(INGEST, -1) >= batch_id:
                return
            try:
                write_batch(batch_df, batch_id, log, state)
                break
            except CommitConflict:  # the refresh has moved the scores meanwhile
                continue
        merge_runs(spark, paths, merge_every, log)

    def write_batch(batch_df: DataFrame, batch_id: int, log: CommitLog, state: State) -> None:
        spark = batch_df.sparkSession
        runs: dict[str, list[dict]] = {}
        facts: dict = {}
        raw = None
        if "edit_id" not in batch_df.columns:  # a source without a sequence: it is handed out here (O-01)
            raw = batch_df.persist()
            batch_df, facts["next_edit_id"] = numbered_batch(raw, state.facts.get("next_edit_id", 0))
        parsed = parse_edits(batch_df).persist()
        try:
            runs["features"] = [S.write_recent_features(E.features(parsed), batch_id, paths["features"])]
            feats = table(spark, paths, "features", runs=runs["features"], state=state)
            ht = E.explode_hashtags(feats)

            def buckets_and_scores():
                runs["buckets"] = [S.write_bucket_run(TR.bucket_counts(ht), batch_id, paths["buckets"])]
                ends = [f["hi"] for f in runs["buckets"][0]["files"] if f["rows"]]
                if not ends:
                    return None
                as_of = max([*ends, *([state.facts["as_of"]] if "as_of" in state.facts else [])])
                fresh = table(spark, paths, "buckets", runs=runs["buckets"], state=state)
                changed = score_changes(spark, paths, state, as_of, fresh, windows)
                runs["scores"] = [S.write_scores(changed, state.number + 1, paths["scores"])]
                return as_of

            as_of, runs["rejects"], runs["hashtags"], runs["newest"], of_features = _together(
                spark, buckets_and_scores,
                lambda: [S.write_rejects(E.rejects(parsed), batch_id, paths["rejects"])],
                lambda: [S.write_hashtag_log(ht, batch_id, paths["hashtags"])],
                lambda: [S.write_hashtag_newest(ht, batch_id, paths["newest"])],
                lambda: S.write_changes(feats, batch_id, paths["changes"], FEATURE_CHANNEL))
        finally:
            parsed.unpersist()
            if raw is not None:
                raw.unpersist()
        if as_of is not None:
            facts["as_of"] = as_of
        records = S.as_record(ht.select("hashtag", "feature", "date"))
        if "scores" in runs:
            scored = table(spark, paths, "scores", runs=runs["scores"], state=state)
            records = records.unionByName(S.as_record(scored.select("window_label", "hashtag", "score")))
        runs["changes"] = [S.write_changes(records, batch_id, paths["changes"], HASHTAG_CHANNEL), of_features]
        kept = {r["path"] for r in S.newest_segments([*state.runs("features"), *runs["features"]])}
        old = [r["path"] for r in state.runs("features") if r["path"] not in kept]  # beyond the newest 1001 (O-03)
        log.commit(state, runs, {"features": old}, {INGEST: batch_id}, facts)

    return run


def _together(spark: SparkSession, *jobs: Callable):
    """Run independent writes as concurrent Spark jobs; their results, or the first failure once all have ended."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]
    return [r.result() for r in running]


MERGES = {"hashtags": S.merge_hashtag_log, "newest": S.merge_hashtag_newest, "buckets": S.merge_buckets, "scores": S.merge_scores}


def merge_runs(spark: SparkSession, paths: dict[str, str], every: int = MERGE_EVERY, log: CommitLog | None = None) -> None:
    """Merge the runs of the tables whose tier 0 has ``every`` runs, each group of tables that must agree in one commit, and let
    change records older than ``CHANGES_KEEP`` commits go. Readers of older states keep the replaced files until
    ``CommitLog.delete_dropped``."""
    log = log or commit_log(spark, paths)
    state = log.state()
    for group in (("hashtags", "newest"), ("buckets",), ("scores",)):
        work = {name: found for name in group if (found := due(state.runs(name), every))}
        if work:
            adds = {n: [MERGES[n](spark, runs, tier, paths[n])] for n, (runs, tier) in work.items()}
            _replace(log, adds, {n: [r["path"] for r in runs] for n, (runs, _) in work.items()})
    old = [r["path"] for r in state.runs("changes") if r["number"] <= state.number - CHANGES_KEEP]
    if len(old) >= every:
        _replace(log, {}, {"changes": old})


def _replace(log: CommitLog, adds: dict[str, list[dict]], removes: dict[str, list[str]]) -> None:
    """Commit a merge on whatever state is newest; nobody else removes the merged runs."""
    while True:
        state = log.state()
        if any(p not in state.tables[t] for t, paths in removes.items() for p in paths):
            return  # another writer was faster
        try:
            log.commit(state, adds, removes)
            return
        except CommitConflict:
            continue


def clean(spark: SparkSession, paths: dict[str, str], older_than: float = 86_400) -> int:
    """Delete the files of runs that merges and trims replaced more than ``older_than`` seconds ago."""
    return commit_log(spark, paths).delete_dropped(paths, older_than)


def run_stream(edits: DataFrame, paths: dict[str, str], available_now: bool = True,
               trigger_seconds: int = TRIGGER_SECONDS, windows: dict[str, int] | None = None):
    """Start the ingest stream (O-62, O-65, O-66): recover from ``checkpoints/ingest`` when
    present, else start fresh. ``available_now`` drains what exists (tests, backfills)."""
    writer = (edits.writeStream.foreachBatch(process_batch(paths, windows))
              .option("checkpointLocation", os.path.join(paths["checkpoints"], "ingest")))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(
        processingTime=f"{trigger_seconds} seconds")
    return writer.start()


def streamed_buckets(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Bucket totals: per-batch partial counts summed (a row of a bucket may arrive late)."""
    log = table(spark, paths, "buckets")
    return log.groupBy("hashtag", "bucket_end").agg(F.sum("n").cast("bigint").alias("n"))


def scores_from_buckets(buckets: DataFrame, as_of: int, window: int = TR.WINDOW_SECONDS) -> DataFrame:
    """Trending count at ``as_of`` (a bucket end) from bucket totals: buckets ending in
    ``(as_of - window, as_of]`` hold exactly the rows of ``[as_of - window, as_of)``."""
    inside = (F.col("bucket_end") > as_of - window) & (F.col("bucket_end") <= as_of)
    return buckets.where(inside).groupBy("hashtag").agg(F.sum("n").cast("bigint").alias("score"))


def bucket_stream(hashtag_rows: DataFrame, watermark: str | None = None, slide: str = "30 seconds") -> DataFrame:
    """Stateful alternative to per-batch partial counts: a tumbling event-time window for ``update``
    output mode. Without a watermark no late row is lost, as in the reference, and the state keeps one
    row per hashtag and bucket; a ``watermark`` bounds the state and makes Spark drop later
    rows. ``withWatermark`` needs an instant, so the wall-clock ``ts`` is read as UTC."""
    instant = F.timestamp_micros(F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"))
    rows = hashtag_rows.withColumn("event_time", instant)
    if watermark:
        rows = rows.withWatermark("event_time", watermark)
    return (rows.groupBy(F.window("event_time", slide), "hashtag")
            .agg(F.count(F.lit(1)).alias("n"))
            .select("hashtag", F.unix_seconds(F.col("window.end")).alias("bucket_end"), "n"))


def changed_hashtags(spark: SparkSession, paths: dict[str, str], state: State, before: dict, as_of: int) -> DataFrame | None:
    """Hashtags whose timeline entries can differ between an earlier refresh (its ``facts``) and ``as_of`` in ``state``; None if that
    can't be told from the bucket runs (time went back, or manifests or files of the batches since are gone).

    Entries change by rows that arrived since, also late ones, by rows that leave the window (the newest row before the window is
    an entry too), and by rows that were there but not yet due. All have a bucket, so bucket files of those ranges tell."""
    since, slide = before["as_of"], TR.SLIDE_SECONDS
    if as_of < since or as_of % slide or since % slide:
        return None
    manifests = commit_log(spark, paths).manifests(before["number"])
    if before["number"] < state.number and (not manifests or manifests[0]["number"] != before["number"] + 1):
        return None
    fresh = [r for m in manifests if m["number"] <= state.number for r in m["adds"].get("buckets", []) if r["tier"] == 0]
    readable = {*state.tables.get("buckets", {}), *(d["path"] for d in state.dropped if d["table"] == "buckets")}
    if any(r["path"] not in readable for r in fresh):
        return None
    ends = F.col("bucket_end")
    parts = [table(spark, paths, "buckets", state, runs=fresh).where(ends <= as_of)]
    for lo, hi in ((since - TR.WINDOW_SECONDS, as_of - TR.WINDOW_SECONDS), (since, as_of)):
        parts.append(table(spark, paths, "buckets", state, overlaps(lo + 1, hi)).where((ends > lo) & (ends <= hi)))
    return TL.union_edges(*[p.select("hashtag") for p in parts]).distinct().checkpoint(eager=True)


def refresh_timeline(spark: SparkSession, paths: dict[str, str], as_of: int | None = None,
                     on_empty: str = "keep", incremental: bool = True, cell_rows: int = TS.CELL_ROWS) -> bool:
    """One timeline refresh (O-67): scores at ``as_of`` (default: the newest score time) from the
    bucket table, newest entries from the hashtag log, run collapse, order, a new version of the
    stored timeline. Only hashtags changed since the stored version are collapsed again, and merged into its cells;
    ``incremental=False`` collapses all. With no hashtag scoring more than once, ``on_empty='keep'`` leaves the old
    timeline (quirk Q8). Returns True when a timeline was written."""
    stored_at = last_score_time(spark, paths)
    if as_of is None:  # the ingest has written these scores
        as_of = stored_at
    if as_of is None:
        return False
    if stored_at is not None and as_of > stored_at:
        advance_scores(spark, paths, as_of)
        stored_at = as_of
    state = commit_log(spark, paths).state()
    log = table(spark, paths, "hashtags", state)
    lo = as_of - TR.WINDOW_SECONDS
    if state.facts.get("as_of") == as_of:
        stored = TR.scores_for_window(last_scores(spark, paths, state))
    else:  # an earlier time, or the ingest is ahead: from the window's buckets
        stored = scores_from_buckets(table(spark, paths, "buckets", state, overlaps(lo + 1, as_of)), as_of)
    if on_empty == "keep" and TR.filter_min_score(stored).isEmpty():
        return False
    base = TS.read_manifest(spark, paths["timeline"]) if incremental else None
    changed = changed_hashtags(spark, paths, state, base["facts"], as_of) if base else None
    if changed is not None:
        stored = stored.join(changed, "hashtag", "left_semi")
    older = S.log_before(log, table(spark, paths, "newest", state), TR.ts_literal(lo))
    inside = table(spark, paths, "hashtags", state, S.in_clock(lo, as_of))
    before, after = Observation("entries"), Observation("runs")
    entries = (TL.top_by_score(log, stored, as_of, with_rank=False, older=older, window_rows=inside)
               .observe(before, F.count(F.lit(1)).alias("n")).checkpoint(eager=True))
    runs = TL.collapse_runs(entries).observe(after, F.count(F.lit(1)).alias("n")).checkpoint(eager=True)
    try:
        made = TS.merge_timeline(runs, paths["timeline"], base, changed, {"as_of": as_of, "number": state.number}, cell_rows)
    except CommitConflict:  # another refresh has replaced the version this one builds on
        return refresh_timeline(spark, paths, as_of, on_empty, incremental, cell_rows)
    cells = made["cells"]
    _note(spark, paths, {"collapse": {
        "as_of": as_of, "rows_before": sum(c["entries"] for c in cells), "rows_after": sum(c["rows"] for c in cells),
        "collapsed_before": before.get["n"], "collapsed_after": after.get["n"],
        "cells": len(cells), "rewritten": made["rewritten"]}})
    return True


def _note(spark: SparkSession, paths: dict[str, str], facts: dict) -> None:
    """Commit facts alone."""
    log = commit_log(spark, paths)
    while True:
        try:
            log.commit(log.state(), facts=facts)
            return
        except CommitConflict:
            continue


def schedule_refresh(spark: SparkSession, paths: dict[str, str], seconds: int = REFRESH_SECONDS,
                     available_now: bool = False, clock: Callable[[], float] = time.time):
    """Periodic timeline refresh (O-67). Live, a ``rate`` source ticks every ``seconds`` and each tick
    refreshes as of the clock, whether edits arrived or not, so scores of a quiet stream fall
    to zero. ``available_now`` refreshes once for the changes that exist, as of the newest score."""

    def tick(batch_df: DataFrame, batch_id: int) -> None:
        slide = TR.SLIDE_SECONDS
        refresh_timeline(spark, paths, int(clock()) // slide * slide)

    def drain(batch_df: DataFrame, batch_id: int) -> None:
        if not batch_df.isEmpty():
            refresh_timeline(spark, paths)

    checkpoints = os.path.join(paths["checkpoints"], "refresh")
    if available_now:
        return (_commits_stream(spark, paths).writeStream.foreachBatch(drain)
                .option("checkpointLocation", checkpoints).trigger(availableNow=True).start())
    return (spark.readStream.format("rate").option("rowsPerSecond", 1).load().writeStream.foreachBatch(tick)
            .option("checkpointLocation", checkpoints).trigger(processingTime=f"{seconds} seconds").start())


def _commits_stream(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """A stream that wakes for every new manifest; manifests appear whole and are never replaced."""
    make_folder(spark, paths["commits"])
    return (spark.readStream.format("text").option("pathGlobFilter", "commit-*.json").option("ignoreMissingFiles", "true")
            .load(paths["commits"]))


def emit_changes(spark: SparkSession, paths: dict[str, str], channel: str = HASHTAG_CHANNEL) -> bool:
    """Re-emit the stored timeline once for the commits with records on ``channel`` since the last emission. How far the
    feed has got is in a log of its own: a batch delivered again makes no commit and so no emission, and a follower that
    stopped while it emitted replaces that emission."""
    done = CommitLog(spark, paths["feed_log"])
    state = done.state()
    seen = state.marks.get(channel, -1)
    fresh = [m["number"] for m in commit_log(spark, paths).manifests(seen)
             if any(r.get("channel") == channel for r in m["adds"].get("changes", []))]
    if not fresh:
        return False
    S._write_batch(S.read_timeline(spark, paths["timeline"]), state.facts.get("emissions", 0), paths["feed"], "emit_id")
    done.commit(state, marks={channel: fresh[-1]}, facts={"emissions": state.facts.get("emissions", 0) + 1})
    return True


def follow_changes(spark: SparkSession, paths: dict[str, str], channel: str = HASHTAG_CHANNEL,
                   available_now: bool = True, trigger_seconds: int = TRIGGER_SECONDS):
    """Change subscription (O-07): a follower of the commit log re-emits the stored timeline once per trigger that finds new commits
    on ``channel`` (not once per record), by commit number. Live (``available_now=False``) it runs until stopped."""

    def emit(batch_df: DataFrame, batch_id: int) -> None:
        emit_changes(spark, paths, channel)

    writer = _commits_stream(spark, paths).writeStream.foreachBatch(emit).option(
        "checkpointLocation", os.path.join(paths["checkpoints"], "feed"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(
        processingTime=f"{trigger_seconds} seconds")
    return writer.start()


# --- registered streaming queries ----------------------------------------------------------

def _edit_stream(spark: SparkSession, path: str, batches: int = 4) -> DataFrame:
    """Edit files replayed in about ``batches`` micro-batches, more if they would exceed ``BATCH_BYTES`` (one file at least:
    a source takes no file above its bound)."""
    sizes = file_sizes(spark, path)
    bound = max([min(sum(sizes) // batches, BATCH_BYTES), *sizes]) if sizes else None
    return read_edits(ingest_session(spark), "parquet", path, streaming=True, max_bytes=bound)


def ingest_session(spark: SparkSession) -> SparkSession:
    """A session with the caller's settings whose tasks read ``SPLIT_BYTES`` of files at most, so what a task decodes and keeps
    of a micro-batch doesn't grow with the input."""
    s = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(name):
            s.conf.set(name, value)
    s.conf.set("spark.sql.files.maxPartitionBytes", str(SPLIT_BYTES))
    return s


def _run(spark: SparkSession, sf_dir: str, name: str) -> dict[str, str]:
    paths = stream_paths(scratch_path(spark, name))
    write_edit_files(spark, sf_dir, paths["edits"])
    run_stream(_edit_stream(spark, paths["edits"]), paths).awaitTermination()
    return paths


def q_stream_trending(spark, sf_dir):
    """Rolling 6 h scores from the bucket table the stream wrote (equals rolling_scores)."""
    paths = _run(spark, sf_dir, "stream-trending")
    return TR.rolling_scores(streamed_buckets(spark, paths))


def stateful_session(spark: SparkSession, state_partitions: int | None = None) -> SparkSession:
    """A session sharing the SparkContext, with its own SQL settings: the number of state store
    partitions of a stateful query is fixed by ``spark.sql.shuffle.partitions`` when it first
    starts, so it is set here (default: the cluster's cores) without touching the caller's."""
    s = spark.newSession()
    s.conf.set("spark.sql.shuffle.partitions", str(state_partitions or spark.sparkContext.defaultParallelism))
    return s


def q_stream_trending_stateful(spark, sf_dir):
    """Same scores with the stateful tumbling window variant in update mode."""
    paths = stream_paths(scratch_path(spark, "stream-stateful"))
    write_edit_files(spark, sf_dir, paths["edits"])
    stream_spark = stateful_session(spark)
    ht = E.explode_hashtags(E.features(parse_edits(_edit_stream(stream_spark, paths["edits"]))))
    q = (bucket_stream(ht).writeStream.outputMode("update")
         .foreachBatch(lambda df, bid: S.write_buckets(df, bid, paths["buckets"]))
         .option("checkpointLocation", os.path.join(paths["checkpoints"], "stateful"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return TR.rolling_scores(TR.latest_buckets(S.read_table(spark, paths["buckets"], BUCKETS)))


def q_stream_hashtag_log(spark, sf_dir):
    paths = _run(spark, sf_dir, "stream-log")
    return table(spark, paths, "hashtags").select("edit_id", "date", "feature", "hashtag")


def q_stream_latest_for_hashtag(spark, sf_dir):
    """One hashtag's newest 101 entries read from the stored log (file index, pushed-down hashtag filter)."""
    paths = _run(spark, sf_dir, "stream-lookup")
    tag = spark.range(1).select(url_decode(F.lit(LOOKUP_TAG))).first()[0]
    top = S.latest_for_hashtag(log_of(spark, paths, tag), tag)
    return top.select("hashtag", "edit_id", pack_entry("feature", "date").alias("entry"))


def q_stream_recent_features(spark, sf_dir):
    paths = _run(spark, sf_dir, "stream-recent")
    top = S.recent_features(recent_segments(spark, paths))
    record = F.to_json(F.struct("user", "id", "changeset", "date", "feature", "action", "comment",
                                F.array_sort("hashtags").alias("hashtags")))
    return top.select("edit_id", "user", "date", "feature", record.alias("record"))


def q_stream_scores_with_zeros(spark, sf_dir):
    """Every hashtag's last written score: the micro-batches' change rows, read last write first."""
    paths = _run(spark, sf_dir, "stream-zeros")
    return TR.scores_for_window(last_scores(spark, paths)).select("hashtag", "score")


def q_stream_scores_by_window(spark, sf_dir):
    """Last scores of several windows kept side by side, under a label each (O-26)."""
    paths = stream_paths(scratch_path(spark, "stream-windows"))
    write_edit_files(spark, sf_dir, paths["edits"])
    run_stream(_edit_stream(spark, paths["edits"]), paths, windows={**WINDOWS, "1": 3600, "24": 86_400}).awaitTermination()
    return last_scores(spark, paths).select("window_label", "hashtag", "score")


def q_stream_scores(spark, sf_dir):
    """Trending scores as of the newest bucket, from the upsert sink."""
    return q_stream_scores_with_zeros(spark, sf_dir).where("score > 0")


def q_timeline_refresh(spark, sf_dir):
    paths = _run(spark, sf_dir, "stream-timeline")
    schedule_refresh(spark, paths, available_now=True).awaitTermination()
    return S.read_timeline(spark, paths["timeline"]).select("position", "hashtag", "run", "feature", "time",
                                                            "last", "count")


def q_change_feed(spark, sf_dir):
    """Timeline re-emitted once per change batch (rows = batches x timeline length)."""
    paths = _run(spark, sf_dir, "stream-feed")
    refresh_timeline(spark, paths)
    follow_changes(spark, paths).awaitTermination()
    return S.read_table(spark, paths["feed"], FEED).select("emit_id", "position", "hashtag", "count")


def q_stream_rejected_features(spark, sf_dir):
    """The dead letters of all micro-batches."""
    return table(spark, _run(spark, sf_dir, "stream-rejects"), "rejects").select("edit_id", "reason")


def q_stream_collapse_stats(spark, sf_dir):
    """Rows before and after the run collapse, as observed while the timeline was made."""
    paths = _run(spark, sf_dir, "stream-collapse")
    refresh_timeline(spark, paths, on_empty="replace")
    counts = commit_log(spark, paths).state().facts.get("collapse", {"rows_before": 0, "rows_after": 0})
    return spark.createDataFrame([(counts["rows_before"], counts["rows_after"])], "entries bigint, runs bigint")


STREAM_QUERIES = {
    "stream_trending": q_stream_trending,
    "stream_trending_stateful": q_stream_trending_stateful,
    "stream_hashtag_log": q_stream_hashtag_log,
    "stream_latest_for_hashtag": q_stream_latest_for_hashtag,
    "stream_recent_features": q_stream_recent_features,
    "stream_rejected_features": q_stream_rejected_features,
    "stream_collapse_stats": q_stream_collapse_stats,
    "stream_scores": q_stream_scores,
    "stream_scores_with_zeros": q_stream_scores_with_zeros,
    "stream_scores_by_window": q_stream_scores_by_window,
    "timeline_refresh": q_timeline_refresh,
    "change_feed": q_change_feed,
}
