"""The stored timeline in cells: refreshes by changed hashtags equal full ones, untouched cells stay, old versions go."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tagwave.operators import timeline as TL
from tagwave.operators import trending as TR
from tagwave.schema import TIMELINE
from tagwave.session import scratch_path
from tagwave.sources.fixtures import load_edits
from tagwave.streaming import stream as ST
from tagwave.streaming import sinks as S
from tagwave.streaming import timeline_store as TS
from tagwave.streaming.commits import CommitConflict

SF = "/root/testdata/sf0.01"


def rows_of(df):
    return [tuple(r) for r in df.select(TIMELINE.fieldNames()).orderBy("position").collect()]


def run_rows(spark, rows):
    """(hashtag, run, time, count) as collapsed runs."""
    return spark.createDataFrame([(h, r, "way", t, "POINT", c) for h, r, t, c in rows],
                                 "hashtag string, run bigint, feature string, time string, last string, `count` bigint")


def ordered(spark, rows):
    return rows_of(TL.sort_timeline(run_rows(spark, rows)))


@pytest.fixture(scope="module")
def edits(spark):
    return load_edits(spark, SF).cache()


def test_refresh_by_change_equals_full_refresh(spark, edits):
    """Random batches in and out of order, merges, and quiet times in which the clock moves on."""
    paths = ST.stream_paths(scratch_path(spark, "test-incremental"))
    run = ST.process_batch(paths, merge_every=3)
    rnd = random.Random(11)
    ids = sorted(rnd.sample(range(5000, 9000), 9))
    cuts = [0, *ids, 10_000]
    order = list(range(10))
    order[4], order[6] = order[6], order[4]  # late rows
    refreshes = 0
    for batch, i in enumerate(order):
        run(edits.where((F.col("edit_id") >= cuts[i]) & (F.col("edit_id") < cuts[i + 1])).coalesce(2), batch)
        if rnd.random() < 0.3:
            continue  # two batches to one refresh
        as_of = ST.last_score_time(spark, paths) + rnd.choice([0, 0, 30, 3600])
        ST.refresh_timeline(spark, paths, as_of, on_empty="replace", cell_rows=7)
        full = {**paths, "timeline": f"{paths['timeline']}-full{batch}"}
        ST.refresh_timeline(spark, full, as_of, on_empty="replace", incremental=False)
        got, want = (S.read_timeline(spark, p["timeline"]) for p in (paths, full))
        assert rows_of(got) == rows_of(want)
        assert [r.position for r in got.collect()] == list(range(1, want.count() + 1))
        new = TS.read_manifest(spark, paths["timeline"])
        assert all(0 < c["rows"] <= 7 for c in new["cells"])
        refreshes += 1
    assert refreshes >= 4


def test_quiet_refresh_collapses_nothing_and_shares_all_cells(spark, edits):
    paths = ST.stream_paths(scratch_path(spark, "test-quiet-cells"))
    ST.process_batch(paths)(edits.where("edit_id < 9000").coalesce(2), 0)
    assert ST.refresh_timeline(spark, paths, cell_rows=5)
    first = TS.read_manifest(spark, paths["timeline"])
    facts = ST.commit_log(spark, paths).state().facts["collapse"]
    assert facts["collapsed_before"] == facts["rows_before"] > 0 and facts["collapsed_after"] == facts["rows_after"]
    assert ST.refresh_timeline(spark, paths, cell_rows=5)
    second = TS.read_manifest(spark, paths["timeline"])
    again = ST.commit_log(spark, paths).state().facts["collapse"]
    assert second["cells"] == first["cells"] and second["version"] == first["version"] + 1 and second["rewritten"] == 0
    assert again["collapsed_before"] == 0 and again["rows_before"] == facts["rows_before"]


def test_time_going_back_is_a_full_refresh(spark, edits):
    paths = ST.stream_paths(scratch_path(spark, "test-back"))
    ST.process_batch(paths)(edits.where("edit_id < 9000").coalesce(2), 0)
    ST.refresh_timeline(spark, paths, on_empty="replace")
    top = ST.last_score_time(spark, paths)
    for as_of in (top - 7200, top - 7200 + 15, top):
        ST.refresh_timeline(spark, paths, as_of, on_empty="replace")
        full = {**paths, "timeline": f"{paths['timeline']}-{as_of}"}
        ST.refresh_timeline(spark, full, as_of, on_empty="replace", incremental=False)
        assert rows_of(S.read_timeline(spark, paths["timeline"])) == rows_of(S.read_timeline(spark, full["timeline"]))


def test_cells_merge_in_random_rounds(spark, tmp_path):
    """Runs of a few hashtags replaced per round: order and positions equal a sort of everything, and cells between stay."""
    path, rnd = str(tmp_path / "t"), random.Random(5)
    dates = [f"2024-01-{d:02d} 00:00:00" for d in range(1, 29)] + ["", None, "no date"]
    made = lambda h: [(h, i + 1, rnd.choice(dates), rnd.randint(1, 9)) for i in range(rnd.randint(0, 5))]
    held = {f"#{i}": made(f"#{i}") for i in range(40)}
    every = lambda: [r for rows in held.values() for r in rows]
    base = TS.merge_timeline(run_rows(spark, every()), path, cell_rows=6)
    kept = 0
    for _ in range(5):
        changed = rnd.sample(sorted(held), 2) + [f"#new{rnd.randint(0, 99)}"]
        for h in changed:
            held[h] = made(h)
        tags = spark.createDataFrame([(h,) for h in changed], "hashtag string")
        runs = run_rows(spark, [r for h in changed for r in held[h]])
        new = TS.merge_timeline(runs, path, base, tags, cell_rows=6)
        assert rows_of(S.read_timeline(spark, path)) == ordered(spark, every())
        kept += sum(c in base["cells"] for c in new["cells"])
        base = new
    assert kept > 0
    assert len(TS.versions(spark, path)) == TS.KEEP_VERSIONS
    listed = {tuple(c[k] for k in TS._KEY) for v in TS.versions(spark, path) for c in TS.read_manifest(spark, path, v)["cells"]}
    on_disk = {(a.partition("=")[2], int(g.partition("=")[2]), int(p.partition("=")[2]))
               for a in os.listdir(f"{path}/cells") for g in os.listdir(f"{path}/cells/{a}") if "=" in g
               for p in os.listdir(f"{path}/cells/{a}/{g}") if "=" in p}
    assert on_disk == listed  # nothing that an older version alone used is left
    with pytest.raises(CommitConflict):
        TS.merge_timeline(run_rows(spark, []), path, {**base, "version": base["version"] - 1},
                          spark.createDataFrame([], "hashtag string"))


def test_scattered_cells_are_laid_out_anew(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [(f"#{i:02d}", 1, f"2024-01-{i + 1:02d} 00:00:00", 2) for i in range(28)]
    base = TS.merge_timeline(run_rows(spark, rows), path, cell_rows=1)
    assert len(base["cells"]) == 28
    new = TS.merge_timeline(run_rows(spark, []), path, base, spark.createDataFrame([("#03",)], "hashtag string"), cell_rows=100)
    assert [c["rows"] for c in new["cells"]] == [27]
    assert rows_of(S.read_timeline(spark, path)) == ordered(spark, rows[:3] + rows[4:])


def test_log_files_are_chosen_by_clock():
    keep = S.in_clock(100, 200)
    micro = 1_000_000
    assert keep({"ts_lo": 199 * micro, "ts_hi": 300 * micro}) and keep({"ts_lo": 0, "ts_hi": 100 * micro}) and keep({})
    assert not keep({"ts_lo": 200 * micro, "ts_hi": 300 * micro}) and not keep({"ts_lo": 0, "ts_hi": 100 * micro - 1})
    assert not keep({"ts_lo": None, "ts_hi": None})
