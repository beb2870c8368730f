"""Distributed scans equal single-task window functions, including one hot segment."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from tagwave.plans.scan import islands, ordered_scan


def _data(spark, n=3000, seed=7):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        seg = "hot" if rnd.random() < 0.4 else f"s{rnd.randint(0, 30)}"
        rows.append((seg, i, rnd.randint(0, 5), rnd.choice(["a", "b"])))
    return spark.createDataFrame(rows, "seg string, o long, v long, k string")


def test_ordered_scan_matches_window(spark):
    df = _data(spark)
    got = ordered_scan(df, [F.col("o").desc()], by=["seg"], sums={"s": F.col("v")}, maxes={"m": F.col("v")},
                       lags={"prev": F.col("o")}, rank="r", total="t", partitions=7)
    w = Window.partitionBy("seg").orderBy(F.col("o").desc())
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("*", F.sum("v").over(run).alias("s"), F.max("v").over(run).alias("m"),
                     F.lag("o").over(w).alias("prev"), F.row_number().over(w).alias("r"),
                     F.count("*").over(Window.partitionBy("seg")).alias("t"))
    assert sorted(got.collect()) == sorted(want.select(got.columns).collect())


def test_ordered_scan_global_rank_and_exclusive_max(spark):
    df = _data(spark)
    got = ordered_scan(df, [F.col("v").desc(), F.col("o").asc()], rank="r",
                       maxes={"m": F.when(F.col("k") == "a", F.col("o"))}, exclusive=True, partitions=5)
    w = Window.orderBy(F.col("v").desc(), F.col("o").asc())
    want = df.select("*", F.max(F.when(F.col("k") == "a", F.col("o"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
                     .alias("m"), F.row_number().over(w).alias("r"))
    assert sorted(got.collect()) == sorted(want.select(got.columns).collect())


def test_islands_match_lag_and_running_sum(spark):
    df = _data(spark)
    got = islands(df, [F.col("o").asc()], ["seg"], F.col("k"), run="run", rank="rank", opens="opens", partitions=6)
    w = Window.partitionBy("seg").orderBy("o")
    opens = F.when(F.lag("k").over(w).isNull() | (F.lag("k").over(w) != F.col("k")), 1).otherwise(0)
    want = (df.withColumn("opens", opens)
            .withColumn("run", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
            .withColumn("rank", F.row_number().over(w)))
    cols = ["seg", "o", "run", "rank", "opens"]
    assert sorted(got.select(cols).collect()) == sorted(want.select(cols).collect())
