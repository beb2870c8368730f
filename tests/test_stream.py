"""Stream = batch: restart from the checkpoint mid-way, and a replayed batch replaces itself."""

import os
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tagwave.operators import trending as TR
from tagwave.plans.catalog import QUERIES, hashtag_rows
from tagwave.schema import BUCKETS, FEED, TIMELINE
from tagwave.session import scratch_path
from tagwave.sources.edits import kafka_sequence, read_edits
from tagwave.sources.fixtures import load_edits
from tagwave.streaming import sinks as S
from tagwave.streaming import stream as ST
from tagwave.streaming.sinks import log_before

T0 = datetime(2024, 1, 1)

SF = "/root/testdata/sf0.01"


def _batch_rolling(spark):
    return sorted(TR.rolling_scores(TR.bucket_counts(hashtag_rows(spark, SF))).collect())


def test_restart_from_checkpoint_equals_batch(spark):
    paths = ST.stream_paths(scratch_path(spark, "test-restart"))
    edits = load_edits(spark, SF)
    lo, hi = edits.agg(F.min("edit_id"), F.max("edit_id")).first()
    mid = (lo + hi) // 2
    # first half arrives, the stream drains it and stops
    edits.where(F.col("edit_id") <= mid).coalesce(2).write.parquet(os.path.join(paths["edits"], "part1"))
    src = os.path.join(paths["edits"], "*")  # two folders
    ST.run_stream(ST._edit_stream(spark, src), paths).awaitTermination()
    first = ST.table(spark, paths, "hashtags").count()
    # second half arrives; the restarted query resumes from its checkpoint
    edits.where(F.col("edit_id") > mid).coalesce(2).write.parquet(os.path.join(paths["edits"], "part2"))
    ST.run_stream(ST._edit_stream(spark, src), paths).awaitTermination()
    log = ST.table(spark, paths, "hashtags")
    assert 0 < first < log.count() == hashtag_rows(spark, SF).count()
    assert sorted(TR.rolling_scores(ST.streamed_buckets(spark, paths)).collect()) == _batch_rolling(spark)


def test_replayed_batch_is_idempotent(spark):
    paths = ST.stream_paths(scratch_path(spark, "test-replay"))
    batch = load_edits(spark, SF).where(F.col("edit_id") < 3000)
    run = ST.process_batch(paths)
    run(batch, 7)
    once = sorted(ST.table(spark, paths, "hashtags").collect())
    number = ST.commit_log(spark, paths).newest()
    run(batch, 7)  # the same micro-batch delivered again after a failure
    ST.process_batch(paths)(batch, 7)  # and after a restart
    assert ST.commit_log(spark, paths).newest() == number
    assert sorted(ST.table(spark, paths, "hashtags").collect()) == once
    assert ST.table(spark, paths, "buckets").agg(F.sum("n")).first()[0] == len(once)


def test_log_before_equals_full_log_scan(spark):
    """The index + straddling-batch read finds the same newest pre-window entry per hashtag."""
    import random
    from datetime import datetime, timedelta

    from tagwave.functions.text import ts_literal
    from tagwave.streaming import sinks as S

    rnd = random.Random(2)
    t0 = datetime(2024, 1, 1)
    rows = []
    for i in range(600):
        batch = i // 40
        ts = t0 + timedelta(minutes=batch * 30 + rnd.randint(0, 45))   # batches overlap in time
        rows.append((f"t{rnd.randint(0, 7)}", ts, i, 0, "2024-01-01 00:00:00", f"LINESTRING ({i} 0)"))
    ht = spark.createDataFrame(rows, "hashtag string, ts timestamp_ntz, edit_id long, pos int, date string, "
                                     "feature string")
    base = scratch_path(spark, "test-index")
    log_path, idx_path = os.path.join(base, "log"), os.path.join(base, "newest")
    for b in range(15):
        part = ht.where((F.col("edit_id") >= b * 40) & (F.col("edit_id") < (b + 1) * 40))
        S.write_hashtag_log(part, b, log_path)
        S.write_hashtag_newest(part, b, idx_path)
    log, idx = spark.read.parquet(log_path), spark.read.parquet(idx_path)
    key = F.struct("ts", "edit_id", "pos")
    epoch0 = int((t0 - datetime(1970, 1, 1)).total_seconds())
    for minutes in (20, 95, 200, 333):
        lo = ts_literal(epoch0 + minutes * 60)
        got = log_before(log, idx, lo).groupBy("hashtag").agg(F.max_by("edit_id", key).alias("e"))
        want = log.where(F.col("ts") < lo).groupBy("hashtag").agg(F.max_by("edit_id", key).alias("e"))
        assert sorted(got.collect()) == sorted(want.collect())


def test_change_feed_emits_once_per_batch(spark):
    """Each batch of change records re-emits the whole stored timeline once, not once per record."""
    paths = ST.stream_paths(scratch_path(spark, "test-feed"))
    ST.write_edit_files(spark, SF, paths["edits"], slices=2)
    ST.run_stream(ST._edit_stream(spark, paths["edits"]), paths).awaitTermination()
    assert ST.refresh_timeline(spark, paths)
    n_timeline = S.read_timeline(spark, paths["timeline"]).count()
    n_changes = ST.table(spark, paths, "changes").count()
    ST.follow_changes(spark, paths).awaitTermination()
    feed = spark.read.parquet(paths["feed"])
    assert n_changes > n_timeline > 0
    assert feed.count() == n_timeline * feed.select("emit_id").distinct().count()
    # a second batch of changes arrives later: one more emission of the timeline
    more = load_edits(spark, SF).where(F.col("edit_id") < 500)
    ST.process_batch(paths)(more, 99)
    ST.follow_changes(spark, paths).awaitTermination()
    feed = spark.read.parquet(paths["feed"])
    assert feed.select("emit_id").distinct().count() == 2 and feed.count() == 2 * n_timeline


def test_refresh_keeps_or_replaces_when_nothing_trends(spark):
    """Quirk Q8: with no hashtag scoring more than once, the old timeline stays ('keep') or an
    empty one replaces it ('replace')."""
    paths = ST.stream_paths(scratch_path(spark, "test-q8"))
    ST.write_edit_files(spark, "/root/testdata/sf0.001", paths["edits"], slices=1)
    ST.run_stream(ST._edit_stream(spark, paths["edits"]), paths).awaitTermination()
    assert ST.refresh_timeline(spark, paths, on_empty="keep") is False
    assert not os.path.exists(paths["timeline"])
    assert ST.refresh_timeline(spark, paths, on_empty="replace") is True
    assert S.read_timeline(spark, paths["timeline"]).count() == 0 and len(S._versions(spark, paths["timeline"])) == 1


def _drained(spark, name, base=None, sf=SF):
    paths = ST.stream_paths(base or scratch_path(spark, name))
    ST.write_edit_files(spark, sf, paths["edits"])
    ST.run_stream(ST._edit_stream(spark, paths["edits"]), paths).awaitTermination()
    return paths


def test_uri_folder_gives_whole_results(spark, tmp_path):
    paths = _drained(spark, "uri", "file:" + str(tmp_path / "sinks"))
    assert ST.refresh_timeline(spark, paths)
    rows = S.read_timeline(spark, paths["timeline"]).count()
    assert rows == 27
    for _ in range(2):  # the second follower sees the same changes again under the same batch id
        ST.follow_changes(spark, {**paths, "checkpoints": str(tmp_path / f"follow{_}")}).awaitTermination()
        assert S.read_table(spark, paths["feed"], FEED).count() == rows


def test_scores_per_batch_with_zeros_and_changes(spark):
    paths = _drained(spark, "scores")
    log = ST.table(spark, paths, "scores")
    times = sorted(r.as_of for r in log.select("as_of").distinct().collect())
    assert len(times) >= 2
    last = {r.hashtag: r.score for r in ST.last_scores(spark, paths).collect()}
    ht = hashtag_rows(spark, SF)
    wanted = TR.zero_scores(TR.trending(ht), ht.select("hashtag"))
    assert last == {r.hashtag: r.score for r in wanted.collect()}
    assert 0 in last.values()
    changes = ST.table(spark, paths, "changes")
    per = {r.channel: r["count"] for r in changes.groupBy("channel").count().collect()}
    features = QUERIES["features"](spark, SF).count()
    assert per == {"featuresch": features, "hashtagsch": ht.count() + log.count()}


def test_quiet_stream_decays_and_keeps_the_timeline(spark):
    paths = _drained(spark, "quiet")
    assert ST.refresh_timeline(spark, paths)
    stored = S.read_timeline(spark, paths["timeline"]).collect()
    later = ST.last_score_time(spark, paths) + 8 * 3600
    assert not ST.refresh_timeline(spark, paths, as_of=later)
    assert S.read_timeline(spark, paths["timeline"]).collect() == stored
    assert {r.score for r in ST.last_scores(spark, paths).collect()} == {0}


def test_refresh_ticks_without_edits(spark):
    paths = _drained(spark, "ticks")
    later = ST.last_score_time(spark, paths) + 7 * 3600
    query = ST.schedule_refresh(spark, paths, seconds=1, clock=lambda: later)
    try:
        for _ in range(60):
            if ST.last_score_time(spark, paths) >= later - 30:
                break
            time.sleep(0.5)
    finally:
        query.stop()
    assert ST.last_score_time(spark, paths) >= later - 30


def test_empty_batch_replaces_its_folder(spark, tmp_path):
    rows = spark.createDataFrame([("a", 30, 2)], "hashtag string, bucket_end bigint, n bigint")
    S.write_buckets(rows, 3, str(tmp_path / "b"))
    S.write_buckets(rows.limit(0), 3, str(tmp_path / "b"))
    assert S.read_table(spark, str(tmp_path / "b"), BUCKETS).count() == 0
    assert S.read_table(spark, str(tmp_path / "none"), BUCKETS).collect() == []


def test_timeline_versions_switch_when_whole(spark, tmp_path):
    path = str(tmp_path / "tl")
    row = [(1, "t", 1, "way", "d", "w", 1)]
    for n in range(1, 6):
        S.write_timeline(spark.createDataFrame(row * n, TIMELINE), path)
    os.makedirs(os.path.join(path, "version=9"))  # a write under way: no commit mark yet
    assert S.read_timeline(spark, path).count() == 5
    assert len(S._versions(spark, path)) == 3


@pytest.mark.parametrize("name", ["scores_with_zeros", "trending_edits", "timeline", "leader_changes", "recent_features",
                                  "latest_for_hashtag", "stream_scores", "timeline_refresh", "change_feed", "stream_trending",
                                  "stream_rejected_features"])
def test_empty_events(spark, tmp_path, name):
    spark.read.parquet(f"{SF}/events.parquet").limit(0).write.parquet(str(tmp_path / "events.parquet"))
    assert {**QUERIES, **ST.STREAM_QUERIES}[name](spark, str(tmp_path)).collect() == []


def test_stateful_buckets_keep_late_rows(spark, tmp_path):
    def edits(name, seconds):
        rows = [(i, T0 + timedelta(seconds=s), "tag") for i, s in enumerate(seconds)]
        spark.createDataFrame(rows, "edit_id long, ts timestamp_ntz, hashtag string").write.parquet(str(tmp_path / "in" / name))

    edits("1", [0, 40 * 3600])
    edits("2", [1, 41 * 3600])  # the first is 40 hours late
    stream = (ST.stateful_session(spark, 2).readStream.schema("edit_id long, ts timestamp_ntz, hashtag string")
              .option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*")))
    query = (ST.bucket_stream(stream).writeStream.outputMode("update")
             .foreachBatch(lambda df, i: S.write_buckets(df, i, str(tmp_path / "out")))
             .option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start())
    query.awaitTermination()
    assert TR.latest_buckets(S.read_table(spark, str(tmp_path / "out"), BUCKETS)).agg(F.sum("n")).first()[0] == 4


def test_text_and_message_sequences_are_unique(spark, tmp_path):
    (tmp_path / "a.txt").write_text("same\nsame\nother\n")
    (tmp_path / "b.txt").write_text("same\n")
    rows = read_edits(spark, "text", str(tmp_path), streaming=False).collect()
    assert len({r.edit_id for r in rows}) == 4 and all(r.ts is not None for r in rows)
    lines = {}
    for r in rows:
        lines.setdefault(r.edit_id >> 33, []).append((r.edit_id, r.payload))
    assert sorted([p for _, p in sorted(v)] for v in lines.values()) == [["same"], ["same", "same", "other"]]
    ids = spark.createDataFrame([(p, o) for p in (0, 1, 40) for o in (0, 7, 2**43)], "partition int, offset bigint")
    assert ids.select(kafka_sequence().alias("s")).distinct().count() == 9


def test_tasks_read_bounded_splits(spark, tmp_path, monkeypatch):
    """What one task reads of a micro-batch doesn't grow with the edits; the caller's settings stay."""
    monkeypatch.setattr(ST, "SPLIT_BYTES", 32_768)
    before = spark.conf.getAll
    path = ST.write_edit_files(spark, "/root/testdata/sf0.01", str(tmp_path / "edits"))
    session = ST._edit_stream(spark, path).sparkSession
    per_task = session.read.parquet(path).groupBy(F.spark_partition_id()).count().collect()
    total = sum(r["count"] for r in per_task)
    assert total == load_edits(spark, "/root/testdata/sf0.01").count()
    assert len(per_task) > 8 and max(r["count"] for r in per_task) < total / 4
    assert spark.conf.getAll == before and session.conf.get("spark.sql.shuffle.partitions") == spark.conf.get("spark.sql.shuffle.partitions")
