"""Replay of the timeline and the leaderboard built from it (O-35, O-37..O-40, O-42..O-45,
O-59, O-60).

The reference's client pops runs off the end of the timeline, so the replay runs oldest first,
adding each run's count to its hashtag's total and re-ranking. Here each step is a column:
running totals come from a segmented scan, ranks from a range-partitioned scan, and the
top-k views are ``orderBy().limit()`` (a per-partition top-k merged on the driver side).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clock, log_line, parse_time
from ..plans.scan import ordered_scan

LEADER_K = 10   # flagged as leaders (rank <= 10)
SHOWN = 9       # shown on the board (rank < 10), quirk Q11
LOG_KEEP = 100  # activity log length
BLOCK = 128     # snapshots folded in one group of leader_changes


def replay(timeline: DataFrame) -> DataFrame:
    """Chronological replay: step 1 is the last timeline element (O-42). No sentinel row.

    Output: step, hashtag, run, feature, time, last, count, n_runs.
    """
    return timeline.select((F.col("n_runs") - F.col("position") + 1).alias("step"),
                           "hashtag", "run", "feature", "time", "last", "count", "n_runs")


def running_totals(steps: DataFrame) -> DataFrame:
    """Each hashtag's total after every replay step (O-37): a running sum per hashtag split
    across range partitions, so one popular hashtag is not one task."""
    return ordered_scan(steps, [F.col("step").asc()], by=["hashtag"],
                        sums={"running_total": F.col("count")})


def leaderboard(timeline: DataFrame) -> DataFrame:
    """Final total per hashtag over the whole replay (O-35). Output: hashtag, total."""
    return timeline.groupBy("hashtag").agg(F.sum("count").cast("bigint").alias("total"))


def with_rank(board: DataFrame) -> DataFrame:
    """Rank by total descending, ties by hashtag, positions 1..n unshared (O-38, Q12)."""
    return ordered_scan(board, [F.col("total").desc(), F.col("hashtag").asc()], rank="rank")


def with_leader_flag(ranked: DataFrame, k: int = LEADER_K) -> DataFrame:
    """Top-k membership flag (O-39)."""
    return ranked.withColumn("leader", F.col("rank") <= k)


def top_leaders(board: DataFrame, n: int = SHOWN) -> DataFrame:
    """The n rows shown on the board, by total descending (O-44). Output: rank, hashtag, total."""
    top = board.orderBy(F.col("total").desc(), F.col("hashtag").asc()).limit(n)
    return top.select(F.row_number().over(Window.orderBy(F.col("total").desc(), F.col("hashtag").asc()))
                      .cast("bigint").alias("rank"), "hashtag", "total")


def with_progress(steps: DataFrame) -> DataFrame:
    """Replay progress percentage, 100 * step / length (O-40)."""
    return steps.withColumn("progress", F.lit(100.0) * F.col("step") / F.col("n_runs"))


def activity_log(steps: DataFrame, n: int = LOG_KEEP) -> DataFrame:
    """Newest n replay steps, newest first, with the ``H:MM - N feature(s) -tag`` line (O-45,
    O-59, O-60). Output: step, clock, line, hashtag, count, feature."""
    top = steps.orderBy(F.col("step").desc()).limit(n)
    hm = clock(parse_time("time"))
    return top.select("step", hm.alias("clock"), log_line(hm, "count", "feature", "hashtag").alias("line"),
                      "hashtag", "count", "feature")


def merge_leaders(older, newer, k: int):
    """The best ``k`` of two arrays of (loss, hashtag), ``loss`` being the negative total; a hashtag in both
    counts with ``newer``."""
    kept = F.filter(older, lambda x: ~F.exists(newer, lambda y: y["hashtag"] == x["hashtag"]))
    return F.slice(F.array_sort(F.concat(newer, kept)), 1, k)


def leaders_so_far(tops: DataFrame, k: int, n: int, block: int = BLOCK) -> DataFrame:
    """Running leaders: (b, top) rows, b = 1..n, to (b, top) with the best ``k`` of all rows up to b.

    Merging top-k lists is associative, so this is a prefix scan: rows are folded in blocks of ``block``, the blocks'
    last lists are scanned in the same way, and each block takes over the list before it. A
    group never holds more than ``block`` lists of ``k``.
    """
    if block < 2:
        raise ValueError("a block holds two lists at least")
    nothing = F.array().cast(tops.schema["top"].dataType)

    def step(done, x):
        before = F.coalesce(F.get(done, F.size(done) - 1)["top"], nothing)
        return F.concat(done, F.array(F.struct(x["b"].alias("b"), merge_leaders(before, x["top"], k).alias("top"))))

    items = F.sort_array(F.collect_list(F.struct("b", "top"))).alias("items")
    start = F.array().cast(f"array<struct<b:bigint,top:{tops.schema['top'].dataType.simpleString()}>>")
    local = (tops.groupBy(F.floor((F.col("b") - 1) / block).alias("block")).agg(items)
             .select("block", F.aggregate("items", start, step).alias("items")))
    if n <= block:
        return local.select(F.explode("items").alias("x")).select("x.b", "x.top")
    local = local.checkpoint(eager=True)
    ends = local.select((F.col("block") + 1).alias("b"), F.element_at("items", -1)["top"].alias("top"))
    carry = leaders_so_far(ends, k, -(-n // block), block).select(F.col("b").alias("block"), F.col("top").alias("carry"))
    return (local.join(carry, "block", "left").select("carry", F.explode("items").alias("x"))
            .select("x.b", merge_leaders(F.coalesce("carry", nothing), F.col("x.top"), k).alias("top")))


def leader_changes(steps: DataFrame, every: int = 3600, k: int = LEADER_K, block: int = BLOCK) -> DataFrame:
    """Leader entry and exit between replay snapshots (O-43).

    The reference re-ranks after each replayed run and flags a hashtag entering the top k
    (it gains leader status) or falling out of it (it loses it). Re-aimed to snapshots: the
    replay is cut every ``every`` seconds of entry time; at each snapshot every hashtag's total
    is its running total so far, leaders are the top ``k`` by (total desc, hashtag), and a
    change is a difference with the previous snapshot's leaders.

    Totals only grow and only updated hashtags move, so the leaders of a snapshot are the best ``k``
    of the leaders before it and of its own best ``k`` updated hashtags. At most ``k`` hashtags
    per snapshot are carried; nothing pairs hashtags with snapshots. Output: snapshot (epoch s), hashtag,
    change ('entered' with the new rank and total, 'left' with those of the previous snapshot), rank, total.
    """
    snap = F.coalesce(F.floor(F.unix_timestamp(parse_time("time")) / every) * every, F.lit(-1)).cast("bigint")
    upd = (steps.groupBy("hashtag", snap.alias("snapshot")).agg(F.sum("count").cast("bigint").alias("n"))
           .checkpoint(eager=True))
    snaps = ordered_scan(upd.select("snapshot").distinct(), [F.col("snapshot").asc()], rank="b").checkpoint(eager=True)
    # one row per hashtag and snapshot it was updated in (bounded by the number of snapshots)
    per_tag = Window.partitionBy("hashtag").orderBy("snapshot").rowsBetween(Window.unboundedPreceding, 0)
    totals = upd.select("hashtag", "snapshot", F.sum("n").over(per_tag).alias("total"))
    best = Window.partitionBy("snapshot").orderBy(F.col("total").desc(), F.col("hashtag").asc())
    tops = (totals.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k)
            .groupBy("snapshot").agg(F.sort_array(F.collect_list(F.struct((-F.col("total")).alias("loss"), "hashtag")))
                                     .alias("top"))
            .join(snaps, "snapshot").select("b", "top"))
    running = leaders_so_far(tops, k, snaps.count(), block)
    leaders = (running.select("b", F.posexplode("top").alias("at", "x"))
               .select("b", F.col("x.hashtag").alias("hashtag"), (F.col("at") + 1).alias("rank"), (-F.col("x.loss")).alias("total"))
               .checkpoint(eager=True))
    prev = leaders.select("hashtag", (F.col("b") + 1).alias("b"), F.col("rank").alias("p_rank"),
                          F.col("total").alias("p_total"))
    both = leaders.join(prev, ["hashtag", "b"], "full_outer").join(snaps, "b")
    return (both.where(F.col("rank").isNull() | F.col("p_rank").isNull())
            .select("snapshot", "hashtag",
                    F.when(F.col("p_rank").isNull(), F.lit("entered")).otherwise(F.lit("left")).alias("change"),
                    F.coalesce("rank", "p_rank").cast("bigint").alias("rank"),
                    F.coalesce("total", "p_total").alias("total")))
