"""Timeline: trending scores joined with hashtag logs, run collapse and order (O-27..O-29b,
O-33, O-34, O-36, O-41, O-46, O-11).

"Newest" is the arrival order ``(ts, edit_id, pos)`` descending.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import feature_class
from ..functions.text import parse_time, ts_literal
from ..plans.scan import islands, ordered_scan
from .trending import WINDOW_SECONDS, _is_ntz, filter_min_score, in_window

def newest_first() -> list:
    """Arrival order, newest first; ``pos`` makes it total within a hashtag."""
    return [F.col("ts").desc(), F.col("edit_id").desc(), F.col("pos").desc()]


def join_scores(scores: DataFrame, log: DataFrame) -> DataFrame:
    """Trending scores joined with the hashtag log on hashtag (O-29b), inner.

    No broadcast hint: hashtags have no length bound, so no row count proves a size. AQE broadcasts
    the score side if its measured bytes allow, and else splits skewed partitions of the log side.
    """
    return log.join(scores.select("hashtag", "score"), "hashtag", "inner")


def newest_before(hashtag_rows: DataFrame, tags: DataFrame, lo: int, floor: int, known: DataFrame | None = None,
                  known_lo: int | None = None, first_span: int = WINDOW_SECONDS, growth: int = 8) -> DataFrame:
    """For each hashtag of ``tags``, its newest row with ``ts < lo``, found by probing backwards in
    time instead of decoding the whole history.

    ``known`` is an already decoded slice covering ``[known_lo, lo)``; a hashtag with a row there
    is resolved by it, since every older row is older still. Earlier slices ``[hi - span, hi)``
    (spans growing ``growth``-fold, literal bounds pushed into the scan) are decoded only while
    some hashtag is unresolved, each joined with the still-missing hashtags only, down to
    ``floor`` (the oldest arrival). A brand-new hashtag therefore costs a walk to ``floor``;
    hashtags with recent history cost one small slice. Returns candidate rows (at most one per
    hashtag and probe): hashtag, edit_id, ts, pos, date, feature.
    """
    ntz = _is_ntz(hashtag_rows, "ts")
    cols = ["edit_id", "ts", "pos", "date", "feature"]

    def newest(rows: DataFrame, wanted: DataFrame) -> DataFrame:
        # aggregated first: at most one row per task and hashtag meets the wanted ones
        picked = (rows.groupBy("hashtag").agg(F.max_by(F.struct(*cols), F.struct("ts", "edit_id", "pos")).alias("r"))
                  .join(wanted.select("hashtag"), "hashtag", "left_semi"))
        return picked.select("hashtag", *[F.col(f"r.{c}").alias(c) for c in cols]).checkpoint(eager=True)

    found, missing, hi = [], tags.select("hashtag"), lo
    if known is not None and known_lo is not None and known_lo < lo:
        found.append(newest(known.where((F.col("ts") >= ts_literal(known_lo, ntz))
                                        & (F.col("ts") < ts_literal(lo, ntz))), missing))
        missing = missing.join(found[-1], "hashtag", "left_anti")
        hi = known_lo
    span = first_span
    while hi > floor and not missing.isEmpty():
        a = hi - span
        part = hashtag_rows.where(F.col("ts") < ts_literal(hi, ntz))
        if a > floor:
            part = part.where(F.col("ts") >= ts_literal(a, ntz))
        found.append(newest(part, missing))
        missing = missing.join(found[-1], "hashtag", "left_anti")
        hi, span = a, span * growth
    if not found:
        return hashtag_rows.select("hashtag", *cols).where(F.lit(False))
    return union_edges(*found)


def top_by_score(hashtag_rows: DataFrame, scores: DataFrame, as_of: int, window: int = WINDOW_SECONDS,
                 min_exclusive: int = 1, with_rank: bool = True, older: DataFrame | None = None,
                 window_rows: DataFrame | None = None) -> DataFrame:
    """For each hashtag scoring more than ``min_exclusive``, its newest ``score + 1`` log entries
    (O-25, O-29b, O-36; the inclusive range 0..score of the reference, quirk Q6).

    The log as of ``as_of`` is every row with ``ts < as_of``, newest first. The score counts
    exactly the rows in ``[as_of - window, as_of)``, which are the ``score`` newest, so the
    entries are those rows plus the newest row before the window: one ``max_by`` per hashtag,
    with no per-hashtag sort of a long history. The history is aggregated before it meets the
    trending set (at most one row per task and hashtag, so a hot hashtag never becomes one task).
    ``older`` and ``window_rows`` (optional) are smaller sources holding every row before the window,
    respectively inside it (an index, an already decoded recent slice).
    Output: hashtag, score, edit_id, ts, pos, date, feature (+ entry_rank, 1 = newest).
    """
    tags = filter_min_score(scores, min_exclusive).select("hashtag", "score")
    cols = ["edit_id", "ts", "pos", "date", "feature"]
    recent = join_scores(tags, in_window(hashtag_rows if window_rows is None else window_rows, as_of, window))
    ntz = _is_ntz(hashtag_rows, "ts")
    older = (hashtag_rows if older is None else older).where(F.col("ts") < ts_literal(as_of - window, ntz))
    newest = F.max_by(F.struct(*cols), F.struct("ts", "edit_id", "pos")).alias("r")
    picked = join_scores(tags, older.groupBy("hashtag").agg(newest))
    newest_older = picked.select("hashtag", "score", *[F.col(f"r.{c}").alias(c) for c in cols])
    entries = union_edges(recent.select("hashtag", "score", *cols), newest_older)
    return rank_entries(entries) if with_rank else entries


def rank_entries(entries: DataFrame) -> DataFrame:
    """Position of each entry in its hashtag's list, 1 = newest (O-36's row_number)."""
    return ordered_scan(entries, newest_first(), by=["hashtag"], rank="entry_rank")


def union_edges(*dfs: DataFrame) -> DataFrame:
    """Union-all of entry lists, duplicates kept (O-46)."""
    out = dfs[0]
    for df in dfs[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def collapse_runs(entries: DataFrame, boundary: str = "exact") -> DataFrame:
    """Collapse consecutive entries of one hashtag with equal (time, feature class) (O-33).

    Entries are read newest first within each hashtag. ``last`` is the WKT of the run's newest
    entry. ``boundary='drop'`` reproduces the reference's collapse, which loses one element at
    each boundary (O-34, quirk Q5). Output: hashtag, run, feature, time, last, count.
    """
    key = F.struct(F.col("date").alias("time"), feature_class("feature").alias("cls"))
    numbered = islands(entries, newest_first(), ["hashtag"], key, run="run", rank="_erank", opens="_opens")
    runs = (numbered.groupBy("hashtag", "run")
            .agg(F.min_by(F.struct(F.col("date").alias("time"), feature_class("feature").alias("cls"),
                                   F.col("feature").alias("wkt")), "_erank").alias("first"),
                 F.min_by("feature", F.when(F.col("_opens") == 0, F.col("_erank"))).alias("_second"),
                 F.count(F.lit(1)).alias("count"))
            .select("hashtag", "run", F.col("first.cls").alias("feature"), F.col("first.time").alias("time"),
                    F.col("first.wkt").alias("last"), "_second", "count"))
    if boundary == "exact":
        return runs.drop("_second")
    if boundary != "drop":
        raise ValueError("boundary must be 'exact' or 'drop'")
    return drop_boundaries(runs)


def drop_boundaries(runs: DataFrame) -> DataFrame:
    """The reference's collapse over exact runs in one global order (O-34).

    Runs k = 1..n in order (hashtag ascending, then run). With j(k) the last index before k
    whose run has length >= 2 (or -1), the accumulator is occupied when run k starts iff
    k > 1 and k - 1 - j(k) is even; an occupied start drops the run's first entry. Both k and
    j(k) come from one scan over the global order: the number of runs so far, and its value
    at the last long run, carried as the running maximum of the run's own rank in the partition.
    """
    order = [F.col("hashtag").asc(), F.col("run").asc()]
    ranked = ordered_scan(runs, order, rank="_k", last_rank={"_j": F.col("count") >= 2})
    j = F.coalesce(F.col("_j"), F.lit(-1))
    occupied = (F.col("_k") > 1) & (((F.col("_k") - 1 - j) % 2) == 0)
    return (ranked.select("hashtag", "run", "feature", "time",
                          F.when(occupied, F.col("_second")).otherwise(F.col("last")).alias("last"),
                          F.when(occupied, F.col("count") - 1).otherwise(F.col("count")).alias("count"))
            .where(F.col("count") > 0))


def timeline_order() -> list:
    """Parsed time descending (unparseable last), then hashtag, class and run: a total order."""
    return [parse_time("time").desc_nulls_last(), F.col("hashtag").asc(), F.col("feature").asc(),
            F.col("run").asc()]


def sort_timeline(runs: DataFrame) -> DataFrame:
    """Timeline order: parsed time descending, unparseable last; hashtag, class and run break
    ties (O-41). Adds ``position`` (1-based) and ``n_runs`` from a range-partitioned scan."""
    return ordered_scan(runs, timeline_order(), rank="position", total="n_runs")


def collapse_stats(entries: DataFrame, runs: DataFrame) -> DataFrame:
    """Row counts before and after run collapse, one row (O-11)."""
    both = entries.select(F.lit(1).alias("_e")).unionByName(runs.select(F.lit(0).alias("_e")))
    return both.agg(F.count(F.when(F.col("_e") == 1, 1)).alias("entries"),
                    F.count(F.when(F.col("_e") == 0, 1)).alias("runs"))
