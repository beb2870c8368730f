"""Running aggregates along one global order, without funnelling a group into one task.

Spark's window functions put each ``partitionBy`` group into a single task, and an
unpartitioned window puts the whole table there. Rank, lag and running sums over a
hashtag that holds a third of all rows (or over a whole leaderboard) need a scan that
stays parallel. This is the classic two-level prefix scan, built from DataFrame ops:

1. ``repartitionByRange`` on ``by + order`` (a sampled, balanced range shuffle) and a sort
   within partitions; ``monotonically_increasing_id`` then numbers rows in that order,
   with the range-partition index in its upper bits. This numbered input is written once
   with ``checkpoint()`` (the shared checkpoint folder): range bounds are re-sampled on every
   execution and Catalyst prunes each branch differently, so without it the local branch and
   the summary branch could disagree on partition ids. The checkpoint also cuts lineage,
   so a lost executor re-reads it instead of recomputing with new bounds.
2. A window over ``(range partition, segment)`` computes local running values. Each window
   group lies inside one range partition, so its size is bounded by the partition size.
3. A summary of at most one row per (range partition, segment) gives each group the carry from
   earlier partitions (a window over the summary, whose groups hold at most one row per range
   partition), and is joined back. Unsegmented summaries have one row per range partition, a
   proven bound, so they are broadcast.

The order must be total (unique within ``by``), so that a re-run task after a lost executor
numbers its rows the same way.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

_PART_BITS = 33  # monotonically_increasing_id: partition index above bit 33, row index below

def _num_partitions(df: DataFrame) -> int:
    conf = df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")
    return max(1, int(conf))


def numbered(df: DataFrame, keys: Sequence[Column], partitions: int | None = None) -> DataFrame:
    """Range-partition on ``keys``, sort inside partitions, number rows (``_rid``, ``_p``) and
    write the result to the checkpoint folder, so every later branch sees the same numbering."""
    ensure_checkpoint_dir(df.sparkSession)
    n = partitions or _num_partitions(df)
    ranged = (df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
              .withColumn("_rid", F.monotonically_increasing_id())
              .withColumn("_p", F.shiftright("_rid", _PART_BITS)))
    return ranged.checkpoint(eager=True)


def ordered_scan(
    df: DataFrame,
    order: Sequence[Column],
    by: Sequence[str] = (),
    *,
    sums: dict[str, Column] | None = None,
    maxes: dict[str, Column] | None = None,
    lags: dict[str, Column] | None = None,
    last_rank: dict[str, Column] | None = None,
    rank: str | None = None,
    total: str | None = None,
    exclusive: bool = False,
    partitions: int | None = None,
) -> DataFrame:
    """Add running columns along ``by + order``, restarting at each change of ``by``.

    sums / maxes: running sum / max of an expression (inclusive of the current row unless
    ``exclusive``). lags: the expression's value on the previous row of the segment (NULL on
    the first). last_rank: the position of the last earlier row for which a condition holds (NULL
    if there is none). rank: 1-based position in the segment. total: row count of the segment.
    """
    sums, maxes, lags, last_rank = dict(sums or {}), dict(maxes or {}), dict(lags or {}), dict(last_rank or {})
    by = list(by)
    keys = [F.col(c).asc() for c in by] + list(order)
    base = df
    for name, expr in {**sums, **maxes}.items():
        base = base.withColumn(f"_v_{name}", expr)
    for name, expr in lags.items():
        base = base.withColumn(f"_v_{name}", F.struct(expr.alias("v")))
    for name, expr in last_rank.items():
        base = base.withColumn(f"_v_{name}", expr)
    ranged = numbered(base, keys, partitions)

    w = Window.partitionBy("_p", *by).orderBy("_rid")
    frame = w.rowsBetween(Window.unboundedPreceding, -1 if exclusive else Window.currentRow)
    local_cols = []
    for name in sums:
        local_cols.append(F.sum(f"_v_{name}").over(frame).alias(f"_l_{name}"))
    for name in maxes:
        local_cols.append(F.max(f"_v_{name}").over(frame).alias(f"_l_{name}"))
    for name in lags:
        local_cols.append(F.lag(f"_v_{name}").over(w).alias(f"_l_{name}"))
    local_cols.append(F.row_number().over(w).alias("_lrank"))
    local = ranged.select("*", *local_cols)
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    marked = {name: F.when(F.col(f"_v_{name}"), F.col("_lrank")) for name in last_rank}
    if marked:
        local = local.select("*", *[F.max(rank_of).over(earlier).alias(f"_l_{name}") for name, rank_of in marked.items()])

    summary_aggs = [F.count(F.lit(1)).alias("_t_count")]
    summary_aggs += [F.sum(f"_v_{name}").alias(f"_t_{name}") for name in sums]
    summary_aggs += [F.max(f"_v_{name}").alias(f"_t_{name}") for name in maxes]
    summary_aggs += [F.max_by(f"_v_{name}", "_rid").alias(f"_t_{name}") for name in lags]
    summary_aggs += [F.max(rank_of).alias(f"_t_{name}") for name, rank_of in marked.items()]
    summary = local.groupBy("_p", *by).agg(*summary_aggs)

    ws = Window.partitionBy(*by).orderBy("_p")
    before = ws.rowsBetween(Window.unboundedPreceding, -1)
    carry_cols = [F.sum("_t_count").over(before).alias("_c_count")]
    if total:
        carry_cols.append(F.sum("_t_count").over(Window.partitionBy(*by)).alias("_c_total"))
    carry_cols += [F.sum(f"_t_{name}").over(before).alias(f"_c_{name}") for name in sums]
    carry_cols += [F.max(f"_t_{name}").over(before).alias(f"_c_{name}") for name in maxes]
    carry_cols += [F.lag(f"_t_{name}").over(ws).alias(f"_c_{name}") for name in lags]
    if last_rank:  # ranks in the partition become ranks in the segment
        summary = summary.withColumn("_c_before", F.coalesce(F.sum("_t_count").over(before), F.lit(0)))
        carry_cols += [F.max(F.col(f"_t_{name}") + F.col("_c_before")).over(before).alias(f"_c_{name}") for name in last_rank]
    carry = summary.select("_p", *by, *carry_cols)
    if not by:
        carry = F.broadcast(carry)  # one row per range partition
    joined = local.join(carry, ["_p", *by], "left")

    out = []
    for name in sums:
        out.append((F.coalesce(F.col(f"_l_{name}"), F.lit(0)) + F.coalesce(F.col(f"_c_{name}"), F.lit(0))).alias(name))
    for name in maxes:
        out.append(F.greatest(F.col(f"_l_{name}"), F.col(f"_c_{name}")).alias(name))
    for name in lags:
        out.append(F.coalesce(F.col(f"_l_{name}"), F.col(f"_c_{name}"))["v"].alias(name))
    for name in last_rank:
        here = F.col(f"_l_{name}") + F.coalesce(F.col("_c_count"), F.lit(0))
        out.append(F.coalesce(here, F.col(f"_c_{name}")).alias(name))
    if rank:
        out.append((F.col("_lrank") + F.coalesce(F.col("_c_count"), F.lit(0))).alias(rank))
    if total:
        out.append(F.col("_c_total").alias(total))
    return joined.select(*df.columns, *out)


def islands(
    df: DataFrame,
    order: Sequence[Column],
    by: Sequence[str],
    key: Column,
    *,
    run: str = "run",
    rank: str = "rank",
    opens: str | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Gaps and islands in one scan: number the runs of equal ``key`` along ``by + order``.

    ``run`` is the 1-based run index inside the segment, ``rank`` the row's 1-based position,
    ``opens`` (optional) 1 on the first row of each run, else 0.
    A row opens a run when its key differs (null-safe) from the previous row of the segment.
    Local run counts come from a window inside each range partition; the carry for a
    partition's first row comes from the previous partition's last key, read off a summary
    of one row per (range partition, segment).
    """
    by = list(by)
    keys = [F.col(c).asc() for c in by] + list(order)
    ranged = numbered(df.withColumn("_key", key), keys, partitions)
    w = Window.partitionBy("_p", *by).orderBy("_rid")
    prev = F.lag("_key").over(w)
    local = (ranged.withColumn("_opens", F.when(prev.isNotNull() & ~prev.eqNullSafe(F.col("_key")), 1).otherwise(0))
             .withColumn("_lrun", F.sum("_opens").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
             .withColumn("_lrank", F.row_number().over(w)))
    summary = local.groupBy("_p", *by).agg(
        F.min_by(F.struct(F.col("_key").alias("k")), "_rid").alias("_first"),
        F.max_by(F.struct(F.col("_key").alias("k")), "_rid").alias("_last"),
        F.sum("_opens").alias("_inner"),
        F.count(F.lit(1)).alias("_rows"),
    )
    ws = Window.partitionBy(*by).orderBy("_p")
    before = ws.rowsBetween(Window.unboundedPreceding, -1)
    prev_last = F.lag("_last").over(ws)
    first_opens = F.when(prev_last.isNull() | ~prev_last["k"].eqNullSafe(F.col("_first")["k"]), 1).otherwise(0)
    carry = (summary.withColumn("_fo", first_opens)
             .select("_p", *by,
                     (F.coalesce(F.sum(F.col("_inner") + F.col("_fo")).over(before), F.lit(0)) + F.col("_fo"))
                     .alias("_crun"),
                     F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_crank"),
                     F.col("_fo")))
    if not by:
        carry = F.broadcast(carry)  # one row per range partition
    joined = local.join(carry, ["_p", *by], "left")
    out = [(F.col("_lrun") + F.col("_crun")).cast("bigint").alias(run),
           (F.col("_lrank") + F.col("_crank")).cast("bigint").alias(rank)]
    if opens:
        out.append(F.when(F.col("_lrank") == 1, F.col("_fo")).otherwise(F.col("_opens")).alias(opens))
    return joined.select(*df.columns, *out)
