"""Run collapse against state machines, windows at their edges, timeline properties."""

import random
from itertools import groupby
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tagwave.operators import leaderboard as L
from tagwave.operators import timeline as TL
from tagwave.operators import trending as TR

T0 = datetime(2024, 1, 1, 12, 0, 0)


def runs_of(seq):
    """Runs of equal neighbours as (value, length)."""
    return [(value, len(list(same))) for value, same in groupby(seq)]


def kept_by_drop(seq):
    """The boundary-drop rule over run lengths: a run that starts while another waits to be
    emitted loses its first element; what is left of it is kept."""
    out, waiting = [], False
    for value, length in runs_of(seq):
        left = length - waiting
        out += [(value, left)] if left else []
        waiting = left > 0
    return out


@pytest.mark.parametrize("seq,exact,drop", [
    ("AABBC", [("A", 2), ("B", 2), ("C", 1)], [("A", 2), ("B", 1)]),
    ("ABCD", [("A", 1), ("B", 1), ("C", 1), ("D", 1)], [("A", 1), ("C", 1)]),
    ("A", [("A", 1)], [("A", 1)]),
    ("ABBB", [("A", 1), ("B", 3)], [("A", 1), ("B", 2)]),
    ("ABCC", [("A", 1), ("B", 1), ("C", 2)], [("A", 1), ("C", 2)]),
])
def test_fixture_table(seq, exact, drop):
    assert runs_of(seq) == exact
    assert kept_by_drop(seq) == drop


def _entries(spark, seqs):
    """seqs: {hashtag: string of letters, newest first}; letter = (time, class)."""
    rows = []
    eid = 0
    for tag, seq in seqs.items():
        n = len(seq)
        for i, ch in enumerate(seq):
            eid += 1
            hour = ord(ch.upper()) - 65
            feature = "POLYGON ((0 0))" if ch.isupper() else "LINESTRING (0 0)"
            rows.append((tag, 1, eid, T0 - timedelta(seconds=i), 0, f"2024-01-01 {hour:02d}:00:00", feature))
    return spark.createDataFrame(rows, "hashtag string, score long, edit_id long, ts timestamp_ntz, pos int, "
                                       "date string, feature string")


def _key(ch):
    return (f"2024-01-01 {ord(ch.upper()) - 65:02d}:00:00", "building" if ch.isupper() else "way")


def test_collapse_random_vs_state_machines(spark):
    rnd = random.Random(3)
    seqs = {f"t{i:02d}": "".join(rnd.choice("AAbB") for _ in range(rnd.randint(1, 12))) for i in range(25)}
    entries = _entries(spark, seqs)
    exact = TL.collapse_runs(entries).orderBy("hashtag", "run").collect()
    want = [(tag, _key(ch), n) for tag in sorted(seqs) for ch, n in runs_of(seqs[tag])]
    assert [(r.hashtag, (r.time, r.feature), r["count"]) for r in exact] == want
    assert sum(r["count"] for r in exact) == sum(len(s) for s in seqs.values())
    # boundary-drop: one state machine over all hashtags in ascending order
    flat = [(tag, ch) for tag in sorted(seqs) for ch in seqs[tag]]
    drop = TL.collapse_runs(entries, boundary="drop").orderBy("hashtag", "run").collect()
    got = [(r.hashtag, (r.time, r.feature), r["count"]) for r in drop]
    assert got == [(tag, _key(ch), n) for (tag, ch), n in kept_by_drop(flat)]


def _rows(spark, offsets):
    data = [(i, T0 + timedelta(seconds=o), 0, "2024-01-01 12:00:00", "LINESTRING (0 0)", "tag")
            for i, o in enumerate(offsets)]
    return spark.createDataFrame(data, "edit_id long, ts timestamp_ntz, pos int, date string, feature string, "
                                       "hashtag string")


def test_window_edges(spark):
    as_of = int((T0 - datetime(1970, 1, 1)).total_seconds()) + 21600
    start = _rows(spark, [0])                       # exactly as_of - 6 h: inside
    end = _rows(spark, [21600])                     # exactly as_of: outside
    before = _rows(spark, [-0.001])                 # 1 ms before the window: outside
    assert TR.trending(start, as_of).first()["score"] == 1
    assert TR.trending(end, as_of).count() == 0
    assert TR.trending(before, as_of).count() == 0
    zeros = TR.zero_scores(TR.trending(before, as_of), before.select("hashtag"))
    assert [tuple(r) for r in zeros.collect()] == [("tag", 0)]


def test_trending_agrees_with_rolling(spark):
    rnd = random.Random(5)
    df = _rows(spark, [rnd.uniform(0, 40000) for _ in range(400)])
    as_of = TR.default_as_of(df)
    rolling = TR.rolling_scores(TR.bucket_counts(df)).where(F.col("bucket_end") == as_of).first()["score"]
    assert TR.trending(df, as_of).first()["score"] == rolling


def test_top_leaders_prefix_of_ranked(spark):
    board = spark.createDataFrame([(f"t{i}", (i * 7) % 13) for i in range(40)], "hashtag string, total long")
    ranked = L.with_rank(board).orderBy("rank").collect()
    top = L.top_leaders(board).orderBy("rank").collect()
    assert [(r.hashtag, r.total) for r in top] == [(r.hashtag, r.total) for r in ranked[:9]]
    flags = L.with_leader_flag(L.with_rank(board)).where("leader").count()
    assert flags == 10


def _brute_leader_changes(steps, every, k):
    """Replay step by step, snapshot at each bucket end, diff the top-k sets."""
    totals, snaps = {}, []
    by_snap = {}
    for step, tag, count, t in sorted(steps):
        b = int(t.timestamp()) // every * every
        by_snap.setdefault(b, []).append((tag, count))
    prev, out = {}, set()
    for b in sorted(by_snap):
        for tag, count in by_snap[b]:
            totals[tag] = totals.get(tag, 0) + count
        ranked = sorted(totals.items(), key=lambda x: (-x[1], x[0]))[:k]
        cur = {tag: (i + 1, tot) for i, (tag, tot) in enumerate(ranked)}
        for tag, (r, tot) in cur.items():
            if tag not in prev:
                out.add((b, tag, "entered", r, tot))
        for tag, (r, tot) in prev.items():
            if tag not in cur:
                out.add((b, tag, "left", r, tot))
        prev = cur
    return out


def test_leader_changes_vs_replay(spark):
    from datetime import timezone
    rnd = random.Random(11)
    steps = []
    for step in range(1, 400):
        t = datetime(2024, 1, 1, tzinfo=timezone.utc) + timedelta(minutes=step * 7)
        steps.append((step, f"t{rnd.randint(0, 25):02d}", rnd.randint(1, 4), t))
    df = spark.createDataFrame([(s, tag, c, t.strftime("%Y-%m-%d %H:%M:%S")) for s, tag, c, t in steps],
                               "step long, hashtag string, count long, time string")
    want = _brute_leader_changes(steps, 3600, 3)
    for block in (2, 7, 128):
        got = {tuple(r) for r in L.leader_changes(df, every=3600, k=3, block=block).collect()}
        assert got == want


@pytest.mark.parametrize("per_hour", [5, 20])
def test_leader_changes_carry_at_most_k_tags(spark, per_hour):
    """New hashtags every hour, all with equal totals: nothing pairs them with later snapshots."""
    rows = [(h * per_hour + i, f"t{h:03}{i:02}", 1, f"2024-01-{1 + h // 24:02} {h % 24:02}:00:00")
            for h in range(150) for i in range(per_hour)]
    steps = spark.createDataFrame(rows, "step long, hashtag string, count long, time string")
    want = _brute_leader_changes([(s, tag, c, datetime.fromisoformat(t + "+00:00")) for s, tag, c, t in rows], 3600, 10)
    out = L.leader_changes(steps, k=10)
    assert {tuple(r) for r in out.collect()} == want
    assert "sequence(" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_newest_before_probing_matches_full_history(spark):
    """Backward probing finds each hashtag's newest pre-window row, however far back (or none)."""
    from pyspark.sql import functions as F

    base = datetime(2024, 3, 1)
    epoch = int((base - datetime(1970, 1, 1)).total_seconds())
    lo = epoch + 30 * 86400
    rows, eid = [], 0
    # hashtag -> offsets (seconds before lo) of its earlier rows
    history = {"near": [3 * 3600, 9 * 3600], "days": [2 * 86400], "weeks": [20 * 86400, 29 * 86400],
               "fresh": [], "decoy": [3600]}
    for tag, offsets in history.items():
        for off in offsets + [-60]:                      # -60: a row inside the window
            eid += 1
            rows.append((tag, eid, base + timedelta(seconds=lo - epoch - off), 0, "d", f"LINESTRING ({eid} 0)"))
    ht = spark.createDataFrame(rows, "hashtag string, edit_id long, ts timestamp_ntz, pos int, date string, "
                                     "feature string")
    tags = spark.createDataFrame([(t, 2) for t in history if t != "decoy"], "hashtag string, score long")
    for known in (None, ht.where(F.col("ts") >= TR.ts_literal(lo - 4 * 3600))):
        got = TL.newest_before(ht, tags, lo, epoch, known=known,
                               known_lo=None if known is None else lo - 4 * 3600)
        got = got.groupBy("hashtag").agg(F.max_by("edit_id", F.struct("ts", "edit_id", "pos")).alias("e"))
        want = (ht.where(F.col("ts") < TR.ts_literal(lo)).join(tags, "hashtag")
                .groupBy("hashtag").agg(F.max_by("edit_id", F.struct("ts", "edit_id", "pos")).alias("e")))
        assert sorted(got.collect()) == sorted(want.collect())
        assert "fresh" not in {r.hashtag for r in got.collect()}
