"""Membership index of the history: the newest older row of each hashtag from few decoded slices."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tagwave.operators import history as H
from tagwave.operators import timeline as TL
from tagwave.operators import trending as TR
from tagwave.plans.catalog import Context
from tagwave.session import scratch_path

BASE = datetime(2024, 3, 1)
EPOCH = int((BASE - datetime(1970, 1, 1)).total_seconds())
SCHEMA = "hashtag string, edit_id long, ts timestamp_ntz, pos int, date string, feature string"
HOUR = 3600


def log_rows(spark, rows):
    """(hashtag, seconds after the epoch day) as log rows."""
    return spark.createDataFrame([(t, i, None if off is None else BASE + timedelta(seconds=off), 0, "d", f"LINESTRING ({i} 0)")
                                  for i, (t, off) in enumerate(rows)], SCHEMA)


def newest(df, tags=None):
    df = df if tags is None else df.join(tags.select("hashtag"), "hashtag", "left_semi")
    return sorted(map(tuple, df.groupBy("hashtag").agg(F.max_by("edit_id", F.struct("ts", "edit_id", "pos"))).collect()))


def tags_of(spark, names):
    return spark.createDataFrame([(n, 2) for n in names], "hashtag string, score long")


@pytest.mark.parametrize("extended", [[], [10], [10, 25], [30]])
@pytest.mark.parametrize("known_hours", [None, 4, 12])
def test_newest_by_index_equals_whole_history(spark, extended, known_hours):
    rnd = random.Random(len(extended) * 10 + (known_hours or 0))
    lo = 30 * 24 * HOUR + 1800  # inside a slice
    rows = [(f"#{rnd.randint(0, 25)}", rnd.randint(0, lo + 2 * HOUR)) for _ in range(120)]
    rows += [("#now", lo + 60), ("#edge", lo), ("#edge", lo - 1), ("#first", 0), ("#nowhere", None)]
    ht = log_rows(spark, rows)
    path = scratch_path(spark, "test-index")
    for day in extended:
        H.extend_index(ht, path, EPOCH + day * 24 * HOUR + 7)
    tags = tags_of(spark, sorted({t for t, _ in rows if t != "#3"}) + ["#never"])
    known_lo = None if known_hours is None else EPOCH + lo - known_hours * HOUR
    known = None if known_hours is None else ht.where(F.col("ts") >= TR.ts_literal(known_lo))
    got = newest(H.newest_by_index(ht, tags, EPOCH + lo, path, known=known, known_lo=known_lo))
    assert got == newest(ht.where(F.col("ts") < TR.ts_literal(EPOCH + lo)), tags)
    assert not {"#now", "#never", "#nowhere"} & {t for t, _ in got}


def test_a_new_hashtag_decodes_no_older_slice(spark):
    """Rows of slices that nobody asks for raise when their feature is decoded."""
    day = 24 * HOUR
    rows = [("#old", 3 * day), ("#weeks", 9 * day + 60), ("#old", 20 * day), ("#new", 29 * day + 60), ("#old", 29 * day)]
    ht, path, lo = log_rows(spark, rows), scratch_path(spark, "test-index-new"), EPOCH + 29 * day
    H.extend_index(ht, path, lo)
    asked = ht.withColumn("feature", F.when(F.col("ts") >= TR.ts_literal(EPOCH + 9 * day), F.col("feature")).otherwise(
        F.raise_error("an old slice was decoded")))
    assert H.newest_by_index(asked, tags_of(spark, ["#new"]), lo, path).collect() == []
    got = H.newest_by_index(asked, tags_of(spark, ["#new", "#weeks", "#old"]), lo, path)
    assert newest(got) == [("#old", 2), ("#weeks", 1)]
    assert H.slices_to_decode(H.read_index(spark, path), tags_of(spark, ["#new"]), lo).isEmpty()


def test_index_is_extended_by_ended_slices_only(spark):
    day = 24 * HOUR
    ht, path = log_rows(spark, [("#a", 0), ("#a", 60), ("#b", 7 * HOUR), ("#a", 2 * day)]), scratch_path(spark, "test-index-grow")
    assert H.indexed_upto(spark, path) is None and H.read_index(spark, path).isEmpty()
    assert H.extend_index(ht, path, EPOCH + 7 * HOUR) == EPOCH + 6 * HOUR
    pairs = lambda: sorted((r.hashtag, r.slice - EPOCH) for r in H.read_index(spark, path).collect())
    assert pairs() == [("#a", 0)]
    assert H.extend_index(ht, path, EPOCH + 8 * HOUR) == EPOCH + 6 * HOUR  # nothing has ended since
    decoded = ht.withColumn("hashtag", F.when(F.col("ts") >= TR.ts_literal(EPOCH + 6 * HOUR), F.col("hashtag")).otherwise(
        F.raise_error("decoded again")))
    H.extend_index(decoded, path, EPOCH + 3 * day)
    assert pairs() == [("#a", 0), ("#a", 2 * day), ("#b", 6 * HOUR)]


def test_ranges_are_bounded():
    assert H._ranges([0, 10, 30, 20, 70], 10) == [(0, 40), (70, 80)]
    assert H._ranges([0, 100, 120, 500], 10, most=2) == [(0, 130), (500, 510)]
    assert H._ranges([], 10) == []


def test_entries_through_the_index(spark):
    sf = "/root/testdata/sf0.01"
    plain, index = Context(spark, sf), scratch_path(spark, "test-index-entries")
    H.extend_index(plain.ht, index, plain.as_of - TR.WINDOW_SECONDS)
    cols = ["hashtag", "score", "edit_id", "pos", "date", "feature"]
    through = Context(spark, sf, index=index).entries().select(cols)
    want = TL.top_by_score(plain.ht, plain.scores(), plain.as_of, with_rank=False).select(cols)
    assert sorted(map(str, through.collect())) == sorted(map(str, want.collect()))
