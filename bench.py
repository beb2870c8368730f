"""Bench: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is built and fully executed into the ``noop`` sink (no collect). One warm-up run
of the flagship is excluded; each query's time is the median of $BENCH_RUNS runs.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tagwave.plans.catalog import QUERIES  # noqa: E402
from tagwave.session import local_session  # noqa: E402
from tagwave.streaming.stream import STREAM_QUERIES  # noqa: E402

ALL = {**QUERIES, **STREAM_QUERIES}
HEADLINE = ["trending_6h", "rolling_scores", "timeline", "leaderboard_ranked", "hashtag_features",
            "timeline_runs_drop", "running_totals", "leader_changes", "recent_features", "stream_trending",
            "timeline_refresh"]


def run_once(spark, name: str, sf_dir: str) -> float:
    t0 = time.perf_counter()
    ALL[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="tagwave-bench")
    run_once(spark, "trending_6h", sf_dir)  # JVM warm-up, not reported
    timings = {}
    for name in names:
        timings[name] = round(statistics.median(run_once(spark, name, sf_dir) for _ in range(runs)), 3)
    spark.stop()
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_query_seconds_total", "value": round(sum(timings.values()), 3),
                      "unit": "sec", "queries": timings, "sf": sf, "cpus": cpus}))


if __name__ == "__main__":
    main()
