"""Plan shape: the properties the design relies on at scale, read from explain()."""

from pyspark.sql import functions as F

from tagwave.operators import edits as E
from tagwave.operators import timeline as TL
from tagwave.operators import trending as TR
from tagwave.plans.catalog import Context, hashtag_rows
from tagwave.plans.scan import ordered_scan
from tagwave.sources.edits import parse_edits
from tagwave.sources.fixtures import arrival_clock, load_edits

SF = "/root/testdata/sf0.01"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_window_bounds_reach_the_scan_and_count_is_partial(spark):
    ht = hashtag_rows(spark, SF)
    plan = _plan(TR.trending(ht, 1706656530))
    assert "GreaterThanOrEqual(ts," in plan and "LessThan(ts," in plan      # PushedFilters on parquet
    assert "partial_count" in plan                                          # map-side combine
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string>" in plan


def test_json_is_decoded_once(spark):
    plan = _plan(hashtag_rows(spark, SF))
    assert plan.count("from_json(") == 1


def test_history_is_aggregated_before_the_join_without_a_broadcast_hint(spark):
    ctx = Context(spark, SF)
    entries = TL.top_by_score(ctx.ht, ctx.scores(), ctx.as_of, with_rank=False)
    assert "broadcast" not in entries._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "partial_max_by" in _plan(entries)


def test_scores_make_no_geometry_text(spark):
    ctx = Context(spark, SF, wide=False)
    ctx.scores()
    assert ctx._recent.columns == ["hashtag", "ts"]
    plan = _plan(ctx.ht.select("hashtag", "ts"))
    assert "format_string" not in plan and "LINESTRING (" not in plan


def test_newest_rows_come_from_a_bounded_slice(spark):
    raw = load_edits(spark, SF)
    part = TR.probe_newest(raw, lambda x: E.features(parse_edits(x)), 200, clock=arrival_clock(spark, SF))
    assert "GreaterThanOrEqual(ts," in _plan(part)
    assert E.features(parse_edits(part)).count() >= 200


def test_unsegmented_scan_carry_is_broadcast(spark):
    df = spark.range(0, 5000).withColumn("v", F.col("id") % 7)
    out = ordered_scan(df, [F.col("v").desc(), F.col("id").asc()], rank="r", partitions=4)
    assert "BroadcastExchange" in _plan(out) or "BroadcastHashJoin" in _plan(out)


def test_rolling_scores_aggregate_before_the_window(spark):
    plan = _plan(TR.rolling_scores(TR.bucket_counts(hashtag_rows(spark, SF))))
    assert "partial_count" in plan and "RangeFrame" in plan


def test_stored_log_lookup_pushes_the_hashtag(spark, tmp_path):
    from tagwave.streaming import sinks as S

    ht = hashtag_rows(spark, "/root/testdata/sf0.001")
    S.write_hashtag_log(ht, 0, str(tmp_path / "log"))
    plan = _plan(S.latest_for_hashtag(spark.read.parquet(str(tmp_path / "log")), "region3"))
    assert "EqualTo(hashtag,region3)" in plan and "TakeOrderedAndProject" in plan
