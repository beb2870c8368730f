"""The stream's commit log: all sinks or none, one emission per commit, scores by change, merged runs, trimmed segments."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tagwave.operators import edits as E
from tagwave.operators import trending as TR
from tagwave.schema import FEED
from tagwave.session import scratch_path
from tagwave.sources.edits import parse_edits, read_edits
from tagwave.sources.fixtures import load_edits
from tagwave.streaming import runs as R
from tagwave.streaming import sinks as S
from tagwave.streaming import stream as ST
from tagwave.streaming.commits import CommitConflict, CommitLog

SF = "/root/testdata/sf0.01"
WRITERS = ["write_recent_features", "write_rejects", "write_hashtag_log", "write_hashtag_newest", "write_bucket_run", "write_scores",
           "write_changes"]


@pytest.fixture(scope="module")
def edits(spark):
    return load_edits(spark, SF).cache()


def part(edits, a, b):
    return edits.where((F.col("edit_id") >= a) & (F.col("edit_id") < b)).coalesce(2)


def tables(spark, paths):
    return {name: sorted(map(str, ST.table(spark, paths, name).collect())) for name in ST.SCHEMAS}


def from_buckets(spark, paths, as_of, window=TR.WINDOW_SECONDS):
    buckets = ST.table(spark, paths, "buckets")
    return {r.hashtag: r.score for r in TR.zero_scores(ST.scores_from_buckets(buckets, as_of, window), buckets).collect()}


def stored(spark, paths, label="6"):
    return {r.hashtag: r.score for r in ST.last_scores(spark, paths).where(F.col("window_label") == label).collect()}


def test_a_batch_is_in_all_tables_or_in_none(spark, edits, monkeypatch):
    paths = ST.stream_paths(scratch_path(spark, "test-atomic"))
    ST.process_batch(paths)(part(edits, 0, 300), 0)
    before = tables(spark, paths)
    for name in WRITERS:
        real = getattr(S, name)

        def stops(*args, **kwargs):
            real(*args, **kwargs)
            raise RuntimeError("stopped after a write")

        with monkeypatch.context() as m:
            m.setattr(S, name, stops)
            with pytest.raises(RuntimeError, match="stopped"):
                ST.process_batch(paths)(part(edits, 300, 600), 1)
        assert ST.commit_log(spark, paths).newest() == 0
    assert tables(spark, paths) == before
    ST.process_batch(paths)(part(edits, 300, 600), 1)
    whole = tables(spark, paths)
    assert all(len(whole[n]) > len(before[n]) for n in whole)
    wanted = E.explode_hashtags(E.features(parse_edits(part(edits, 0, 600)))).count()
    assert len(whole["hashtags"]) == wanted
    assert tables_at(spark, paths, 0) == before


def tables_at(spark, paths, number):
    state = ST.commit_log(spark, paths).state(number)
    return {name: sorted(map(str, ST.table(spark, paths, name, state).collect())) for name in ST.SCHEMAS}


def test_feed_goes_by_commit(spark, edits):
    paths = ST.stream_paths(scratch_path(spark, "test-commit-feed"))
    run = ST.process_batch(paths)
    run(part(edits, 0, 2000), 0)
    ST.refresh_timeline(spark, paths, on_empty="replace")
    ST.follow_changes(spark, paths).awaitTermination()

    def emissions():
        return sorted(n for n in os.listdir(paths["feed"]) if n.startswith("emit_id="))

    assert emissions() == ["emit_id=0"]
    rows = S.read_table(spark, paths["feed"], FEED).count()
    run(part(edits, 0, 2000), 0)  # delivered again
    ST.follow_changes(spark, paths).awaitTermination()
    ST.follow_changes(spark, {**paths, "checkpoints": paths["checkpoints"] + "2"}).awaitTermination()  # its checkpoint lost
    assert emissions() == ["emit_id=0"] and S.read_table(spark, paths["feed"], FEED).count() == rows
    assert not ST.emit_changes(spark, paths)
    run(part(edits, 2000, 2500), 1)
    ST.follow_changes(spark, paths).awaitTermination()
    assert emissions() == ["emit_id=0", "emit_id=1"]


def test_scores_by_change_over_merged_runs(spark, edits, monkeypatch):
    """Random batches, late and far ones among them: the stored scores equal the sums over all buckets, each batch opens few
    bucket files and writes changed scores only; after merges each tier has one run and a lookup opens a file of each."""
    paths = ST.stream_paths(scratch_path(spark, "test-delta"))
    windows = {"6": 6 * 3600, "1": 3600}
    opened = []
    real = R.chosen_files
    monkeypatch.setattr(R, "chosen_files", lambda root, runs, keep=None: opened.append((root, keep, f := real(root, runs, keep))) or f)
    run = ST.process_batch(paths, windows, merge_every=2)
    rnd = random.Random(4)
    last, seen = {}, 0
    for batch in range(8):
        a = batch * 1200 if batch != 5 else 100  # batch 5 is late
        opened.clear()
        run(part(edits, a, a + rnd.choice([150, 400])), batch)
        leaving = [len(f) for root, keep, f in opened if root == paths["buckets"] and keep]
        assert sum(leaving) <= 4 * len(windows)
        as_of = ST.last_score_time(spark, paths)
        for label, seconds in windows.items():
            assert stored(spark, paths, label) == from_buckets(spark, paths, as_of, seconds)
        state = ST.commit_log(spark, paths).state(seen)
        now = {(r.window_label, r.hashtag): r.score for r in ST.last_scores(spark, paths).collect()}
        changed = sum(now.get(k) != last.get(k) for k in now)
        written = [r["rows"] for n in range(seen, ST.commit_log(spark, paths).newest() + 1) for m in ST.commit_log(spark, paths).manifests(n - 1)[:1]
                   for r in m["adds"].get("scores", []) if r["tier"] == 0]
        assert sum(written) == changed and state.number == seen
        last, seen = now, ST.commit_log(spark, paths).newest() + 1
    log = ST.commit_log(spark, paths)
    state = log.state()
    for name in ("hashtags", "newest", "buckets", "scores"):
        tiers = [r["tier"] for r in state.runs(name) if r["tier"]]
        assert len(tiers) == len(set(tiers)) and max(tiers) >= 2
    tag = ST.table(spark, paths, "hashtags").groupBy("hashtag").count().orderBy("count").first().hashtag
    files = real(paths["hashtags"], state.runs("hashtags"), S.may_hold(spark, tag))
    assert 1 <= len(files) <= len(state.runs("hashtags"))
    found = S.latest_for_hashtag(ST.log_of(spark, paths, tag), tag).collect()
    assert found == S.latest_for_hashtag(ST.table(spark, paths, "hashtags"), tag).collect() and found
    assert real(paths["hashtags"], state.runs("hashtags"), S.may_hold(spark, "~not a tag~")) == []
    # a reader of an older state is not disturbed by merges, until the replaced files are deleted
    older = ST.table(spark, paths, "hashtags", log.state(2))
    n = older.count()
    ST.clean(spark, paths, older_than=3600)
    assert older.count() == n
    whole = sorted(map(str, ST.table(spark, paths, "hashtags").collect()))
    assert ST.clean(spark, paths, older_than=-1) > 0
    assert sorted(map(str, ST.table(spark, paths, "hashtags").collect())) == whole
    assert log.state().dropped == []


def test_refresh_beside_the_ingest(spark, edits, monkeypatch):
    """The refresh moves the scores while a batch is under way: the batch starts again on the new state."""
    paths = ST.stream_paths(scratch_path(spark, "test-conflict"))
    run = ST.process_batch(paths)
    run(part(edits, 0, 400), 0)
    real, calls = S.write_hashtag_log, []

    def slow(*args):
        if not calls:
            calls.append(1)
            ST.advance_scores(spark, paths, ST.last_score_time(spark, paths) + 1800)
        return real(*args)

    monkeypatch.setattr(S, "write_hashtag_log", slow)
    run(part(edits, 400, 800), 1)
    as_of = ST.last_score_time(spark, paths)
    assert stored(spark, paths) == from_buckets(spark, paths, as_of)
    assert ST.table(spark, paths, "hashtags").count() == E.explode_hashtags(E.features(parse_edits(part(edits, 0, 800)))).count()


def test_numbers_are_taken_once(spark, tmp_path):
    for path in (str(tmp_path / "log"), "file:" + str(tmp_path / "uri")):
        log = CommitLog(spark, path, snapshot_every=3, keep=4)
        for i in range(11):
            log.commit(log.state(), {"t": [{"path": f"r{i}", "rows": 1, "tier": 0, "files": []}]}, {"t": [f"r{i - 1}"]} if i else None,
                       {"w": i}, {"x": i})
        other = CommitLog(spark, path)
        state = other.state()
        assert (state.number, [r["path"] for r in state.runs("t")], state.marks, state.facts) == (10, ["r10"], {"w": 10}, {"x": 10})
        assert [d["path"] for d in state.dropped] == [f"r{i}" for i in range(10)]
        with pytest.raises(CommitConflict):
            other.commit(other.state(9))
        assert len(other.manifests(-1)) < 11 and [m["number"] for m in other.manifests(8)] == [9, 10]


def test_newest_segments_hold_the_newest_rows():
    rnd = random.Random(9)
    for _ in range(200):
        runs, rows = [], []
        for k in range(rnd.randint(0, 12)):
            held = [[rnd.randint(0, 60), rnd.randint(0, 9)] for _ in range(rnd.randint(0, 6))]
            rows += [(p, k) for p in held]
            runs.append({"path": k, "rows": len(held), "files": [{"lo": min(held), "hi": max(held), "rows": len(held)}] if held else []})
        n = rnd.randint(1, 8)
        kept = {r["path"] for r in S.newest_segments(runs, n)}
        top = sorted((p for p, _ in rows), reverse=True)[:n]
        assert sorted((p for p, k in rows if k in kept), reverse=True)[:n] == top


def test_trimmed_feature_log(spark, edits):
    paths = ST.stream_paths(scratch_path(spark, "test-trim"))
    run = ST.process_batch(paths)
    for k in range(4):
        run(part(edits, k * 2500, (k + 1) * 2500), k)
    state = ST.commit_log(spark, paths).state()
    assert len(state.runs("features")) < 4 and [d for d in state.dropped if d["table"] == "features"]
    newest = S.recent_features(ST.recent_segments(spark, paths)).select("edit_id").collect()
    assert newest == S.recent_features(E.features(parse_edits(edits))).select("edit_id").collect() and len(newest) == 1001
    few = S.newest_segments(state.runs("features"), 10)
    assert len(few) == 1


def test_dead_letters(spark, tmp_path):
    rows = [(1, "not json"), (2, '{"type":"way"}'), (3, '{"id":"x"}'), (4, None)]
    batch = spark.createDataFrame(rows, "edit_id long, payload string").selectExpr(
        "edit_id", "TIMESTAMP_NTZ'2024-01-01 00:00:00' AS ts", "payload")
    paths = ST.stream_paths(str(tmp_path))
    ST.process_batch(paths)(batch, 0)
    found = {r.edit_id: r.reason for r in ST.table(spark, paths, "rejects").collect()}
    assert found == {r.edit_id: r.reason for r in E.rejects(parse_edits(batch)).collect()} and len(found) >= 3
    assert ST.last_score_time(spark, paths) is None and ST.table(spark, paths, "hashtags").count() == 0


def test_sequence_handed_out_at_ingest(spark, tmp_path):
    """A text stream's edits are numbered batch after batch without gaps, whatever the files are called."""
    paths = ST.stream_paths(str(tmp_path / "out"))
    source = tmp_path / "in"
    source.mkdir()
    seen = []
    for batch in range(3):
        for k in range(4):
            (source / f"{9 - batch}-{k}.txt").write_text("".join(f"bad {batch} {k} {i}\n" for i in range(5 + k)))
        ST.run_stream(read_edits(spark, "text", str(source)), paths).awaitTermination()
        rows = ST.table(spark, paths, "rejects").collect()
        fresh = sorted((r.edit_id, r.payload) for r in rows if r.payload.startswith(f"bad {batch}"))
        assert [i for i, _ in fresh] == list(range(len(seen), len(seen) + 26))
        for k in range(4):  # lines of a file stay in order
            places = [int(p.split()[3]) for _, p in fresh if p.split()[2] == str(k)]
            assert places == sorted(places)
        seen += fresh
    assert ST.commit_log(spark, paths).state().facts["next_edit_id"] == 78
