"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame over the whole input.

Every query starts from the driver's ``events`` table (turned into JSON edits by the fixture
recipe), so its work grows with the data. Column names equal those of ``plans.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tags import WHITESPACE
from ..functions import (
    bbox_center,
    clean_hashtag,
    feature_class,
    pack_entry,
    parse_int,
    parse_time,
    strip_score_prefix,
    unpack_entry,
    url_decode,
)
from ..operators import edits as E
from ..operators import history as H
from ..operators import leaderboard as L
from ..operators import timeline as TL
from ..operators import trending as TR
from ..session import scratch_path
from ..sources.edits import parse_edits
from ..sources.fixtures import arrival_clock, load_edits
from ..streaming.sinks import LATEST_KEEP, RECENT_KEEP, latest_for_hashtag, preview, recent_features, timeline_records

LOOKUP_TAG = "pipe%7Ctail"  # the requested (URL-encoded) hashtag of latest_for_hashtag


def parsed_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_edits(load_edits(spark, sf_dir))


def feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.features(parsed_edits(spark, sf_dir))


def hashtag_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.explode_hashtags(feature_rows(spark, sf_dir))


def derive_hashtags(raw: DataFrame) -> DataFrame:
    """Raw edits to (feature, hashtag) rows: decode, features, explode."""
    return E.explode_hashtags(E.features(parse_edits(raw)))


def _joined_tags(col: str = "hashtags"):
    """Hashtag array as sorted space-joined text (set order is unspecified, quirk Q17)."""
    return F.array_join(F.array_sort(F.col(col)), " ")


SLICE_MARGIN = 6 * 3600  # the decoded recent slice reaches this far before the window


class Context:
    """Per-query shared pieces: hashtag rows, the default ``as_of`` and the decoded recent slice
    (each resolved once)."""

    def __init__(self, spark: SparkSession, sf_dir: str, wide: bool = True, index: str | None = None):
        """``wide=False``: only hashtags and times are needed, so no geometry text is made. ``index``: folder of a
        membership index of the history, which names the slices to decode."""
        self.spark, self.sf_dir, self.wide = spark, sf_dir, wide
        self.index = index
        self.raw = load_edits(spark, sf_dir)
        self.ht = derive_hashtags(self.raw)
        self._as_of = None
        self._resolved = False
        self._recent = None
        self._bounds = (None, None, None)  # (oldest arrival, newest arrival, slice start)
        self._entries = None

    def _resolve(self) -> None:
        """Decode the newest slice of edits (six hours plus a margin) once, into the checkpoint
        folder; ``as_of`` comes from it, and so do the window's rows when the window lies inside
        it. Only when the slice holds no hashtag row does the probe look further back."""
        self._resolved = True
        clock = arrival_clock(self.spark, self.sf_dir)
        lo_all, top = TR.clock_bounds(clock)
        if top is None:
            return
        slice_lo = top - TR.WINDOW_SECONDS - SLICE_MARGIN
        self._bounds = (lo_all, top, slice_lo)
        part = self.ht if slice_lo <= lo_all else self.ht.where(F.col("ts") >= TR.ts_literal(slice_lo))
        if not self.wide:
            part = part.select("hashtag", "ts")
        recent = part.checkpoint(eager=True)  # the ts filter still reaches the parquet scan
        self._as_of = TR.default_as_of(recent)
        if self._as_of is None:
            self._as_of = TR.probe_as_of(self.raw, derive_hashtags, clock=clock)
        if self._as_of is not None and (slice_lo <= lo_all or self._as_of - TR.WINDOW_SECONDS >= slice_lo):
            self._recent = recent

    @property
    def as_of(self) -> int | None:
        if not self._resolved:
            self._resolve()
        return self._as_of

    def window_rows(self) -> DataFrame:
        """Hashtag rows holding the whole window: the decoded slice when it covers it."""
        if not self._resolved:
            self._resolve()
        return self.ht if self._recent is None else self._recent

    def log(self) -> DataFrame:
        """Hashtag rows before ``as_of``; none when no edit has a hashtag."""
        if self.as_of is None:
            return self.ht.where(F.lit(False))
        return self.ht.where(F.col("ts") < TR.ts_literal(self.as_of))

    def scores(self) -> DataFrame:
        return TR.trending(self.window_rows(), self.as_of)

    def entries(self, with_rank: bool = False) -> DataFrame:
        """Newest score+1 entries of the trending hashtags; each hashtag's newest row before the
        window is found by probing backwards from the decoded recent slice (``newest_before``),
        not by decoding the whole history."""
        if self.as_of is None:
            return TL.top_by_score(self.ht, self.scores(), 0, with_rank=with_rank)
        tags = TR.filter_min_score(self.scores()).select("hashtag")
        older = None
        lo_all, _, slice_lo = self._bounds
        if lo_all is not None:
            known = self._recent
            known_lo = None if known is None else max(slice_lo, lo_all)
            lo = self.as_of - TR.WINDOW_SECONDS
            if self.index is not None:
                older = H.newest_by_index(self.ht, tags, lo, self.index, known=known, known_lo=known_lo)
            else:
                older = TL.newest_before(self.ht, tags, lo, lo_all, known=known, known_lo=known_lo)
        return TL.top_by_score(self.ht, self.scores(), self.as_of, with_rank=with_rank, older=older,
                               window_rows=self.window_rows())

    def stable_entries(self) -> DataFrame:
        """Trending entries written to the checkpoint folder once: the runs, ranks and scans
        downstream read a small table instead of re-planning the decode and joins per branch,
        and a lost executor recomputes from it rather than from the edits."""
        if self._entries is None:
            self._entries = self.entries().checkpoint(eager=True)
        return self._entries

    def ranked_entries(self) -> DataFrame:
        return TL.rank_entries(self.stable_entries())

    def runs(self, boundary: str = "exact") -> DataFrame:
        return TL.collapse_runs(self.stable_entries(), boundary)

    def timeline(self) -> DataFrame:
        return TL.sort_timeline(self.runs())

    def steps(self) -> DataFrame:
        return L.replay(self.timeline())


# --- edits -------------------------------------------------------------------------------

def q_features(spark, sf_dir):
    f = feature_rows(spark, sf_dir)
    return f.select("edit_id", "user", "id", "changeset", "date", "feature", "action", "comment",
                    _joined_tags().alias("hashtags"), F.size("hashtags").alias("n_hashtags"))


def q_hashtags_per_edit(spark, sf_dir):
    ways = E.with_hashtags(E.with_comment(E.filter_ways(parsed_edits(spark, sf_dir))))
    return ways.select("edit_id", "comment", _joined_tags().alias("hashtags"), F.size("hashtags").alias("n_hashtags"))


def q_hashtag_features(spark, sf_dir):
    return hashtag_rows(spark, sf_dir).select("edit_id", "date", "feature", "hashtag")


def q_features_wkt(spark, sf_dir):
    f = feature_rows(spark, sf_dir)
    return f.select("edit_id", "geom_type", F.size("points").alias("n_points"), F.col("feature").alias("wkt"))


def q_feature_centers(spark, sf_dir):
    f = feature_rows(spark, sf_dir).select("edit_id", bbox_center("points").alias("c"))
    return f.select("edit_id", F.col("c.lon").alias("center_lon"), F.col("c.lat").alias("center_lat"))


def q_feature_class_counts(spark, sf_dir):
    ht = hashtag_rows(spark, sf_dir)
    return (ht.groupBy(feature_class("feature").alias("feature"))
            .agg(F.count(F.lit(1)).alias("n"), F.countDistinct("edit_id").alias("n_features")))


def q_rejected_features(spark, sf_dir):
    return E.rejects(parsed_edits(spark, sf_dir)).select("edit_id", "reason")


def q_parsed_times(spark, sf_dir):
    """Edit dates written without a zone, with ``Z``, with offsets and in the mail form, read as UTC (O-58)."""
    at = F.expr("try_cast(e.metadata.created_at AS TIMESTAMP_NTZ)")
    iso = F.date_format(at, "yyyy-MM-dd HH:mm:ss")
    texts = [iso, F.concat(iso, F.lit("Z")), F.concat(iso, F.lit("+05:00")), F.concat(iso, F.lit("-03:30")),
             F.concat(F.date_format(at, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0200"))]
    text = F.get(F.array(*texts), (F.col("edit_id") % 5).cast("int"))
    rows = parsed_edits(spark, sf_dir).select("edit_id", text.alias("text"))
    return rows.select("edit_id", "text", F.date_format(parse_time("text"), "yyyy-MM-dd HH:mm:ss").alias("utc"))


def q_clean_hashtag(spark, sf_dir):
    ways = E.with_comment(E.filter_ways(parsed_edits(spark, sf_dir)))
    tokens = ways.select(F.explode(F.split("comment", WHITESPACE)).alias("p")).where(F.col("p").startswith("#"))
    raw = tokens.select(F.substring("p", 2, 1 << 30).alias("raw")).where(F.col("raw") != "")
    return raw.groupBy("raw").agg(F.count(F.lit(1)).alias("n")).select("raw", clean_hashtag("raw").alias("hashtag"), "n")


def mentions(payload: str, tag: str) -> Column:
    """Raw edits that may carry a hashtag, told from the text before it is decoded: it holds the
    tag as it stands, or an escape that may hide it."""
    return F.col(payload).contains(tag) | F.col(payload).contains("\\")


def q_latest_for_hashtag(spark, sf_dir):
    tag = unquote(LOOKUP_TAG)
    raw = load_edits(spark, sf_dir).where(mentions("payload", tag))
    wanted = lambda part: derive_hashtags(part).where(F.col("hashtag") == tag)
    part = TR.probe_newest(raw, wanted, LATEST_KEEP, clock=arrival_clock(spark, sf_dir))
    top = latest_for_hashtag(derive_hashtags(part), url_decode(F.lit(LOOKUP_TAG)))
    return top.select("hashtag", "edit_id", pack_entry("feature", "date").alias("entry"))


def q_recent_features(spark, sf_dir):
    derive = lambda part: E.features(parse_edits(part))
    part = TR.probe_newest(load_edits(spark, sf_dir), derive, RECENT_KEEP, clock=arrival_clock(spark, sf_dir))
    top = recent_features(derive(part))
    record = F.to_json(F.struct("user", "id", "changeset", "date", "feature", "action", "comment",
                                F.array_sort("hashtags").alias("hashtags")))
    return top.select("edit_id", "user", "date", "feature", record.alias("record"))


def q_preview(spark, sf_dir):
    """The first rows by arrival sequence, as a log would show them (O-10)."""
    return preview(feature_rows(spark, sf_dir).select("edit_id", "user", "date", "feature").orderBy("edit_id"))


def q_packed_entries(spark, sf_dir):
    ht = hashtag_rows(spark, sf_dir)
    return ht.select("edit_id", "hashtag", pack_entry("feature", "date", "hashtag").alias("entry"))


def q_unpacked_entries(spark, sf_dir):
    ht = hashtag_rows(spark, sf_dir)
    u = ht.select("edit_id", unpack_entry(pack_entry("feature", "date", "hashtag")).alias("u"))
    return u.select("edit_id", F.col("u.feature").alias("feature"), F.col("u.time").alias("time"),
                    F.col("u.hashtag").alias("hashtag"))


# --- trending ----------------------------------------------------------------------------

def q_trending_6h(spark, sf_dir):
    return Context(spark, sf_dir, wide=False).scores()


def q_trending_repeated(spark, sf_dir):
    return TR.filter_min_score(Context(spark, sf_dir, wide=False).scores())


def q_score_keys(spark, sf_dir):
    keyed = TR.with_score_keys(Context(spark, sf_dir, wide=False).scores())
    stored = keyed.select("key", F.col("score").cast("string").alias("value"))
    return stored.select("key", strip_score_prefix("key").alias("hashtag"), parse_int("value").alias("score"))


def q_rolling_scores(spark, sf_dir):
    return TR.rolling_scores(TR.bucket_counts(hashtag_rows(spark, sf_dir)))


def q_scores_with_zeros(spark, sf_dir):
    ctx = Context(spark, sf_dir, wide=False)
    return TR.zero_scores(ctx.scores(), ctx.log().select("hashtag"))


# --- timeline ----------------------------------------------------------------------------

def q_trending_edits(spark, sf_dir):
    ctx = Context(spark, sf_dir)
    joined = TL.join_scores(TR.filter_min_score(ctx.scores()), ctx.log())
    return joined.select("hashtag", "score", "edit_id", "date", "feature")


def q_timeline_entries(spark, sf_dir):
    e = Context(spark, sf_dir).ranked_entries()
    return e.select("hashtag", "score", "edit_id", "date", "feature", "entry_rank")


def q_timeline_entries_indexed(spark, sf_dir):
    """The same entries through a membership index of the history, made here in two steps (as a daily job would extend it)."""
    index = scratch_path(spark, "history-index")
    ctx = Context(spark, sf_dir, index=index)
    lo, hi = TR.clock_bounds(arrival_clock(spark, sf_dir))
    if lo is not None:
        for upto in ((lo + hi) // 2, hi):
            H.extend_index(ctx.ht, index, upto)
    return ctx.ranked_entries().select("hashtag", "score", "edit_id", "date", "feature", "entry_rank")


def q_timeline_runs(spark, sf_dir):
    return Context(spark, sf_dir).runs("exact")


def q_timeline_runs_drop(spark, sf_dir):
    return Context(spark, sf_dir).runs("drop")


def q_collapse_stats(spark, sf_dir):
    ctx = Context(spark, sf_dir)
    entries = ctx.stable_entries()
    return TL.collapse_stats(entries, TL.collapse_runs(entries))


def q_timeline(spark, sf_dir):
    return Context(spark, sf_dir).timeline().select("position", "hashtag", "run", "feature", "time", "last", "count")


def q_timeline_json(spark, sf_dir):
    return timeline_records(Context(spark, sf_dir).timeline())


# --- leaderboard -------------------------------------------------------------------------

def q_timeline_replay(spark, sf_dir):
    return Context(spark, sf_dir).steps().select("step", "hashtag", "run", "feature", "time", "last", "count")


def q_timeline_progress(spark, sf_dir):
    return L.with_progress(Context(spark, sf_dir).steps()).select("step", "hashtag", "progress")


def q_running_totals(spark, sf_dir):
    ctx = Context(spark, sf_dir)
    return L.running_totals(ctx.steps()).select("step", "hashtag", "count", "running_total")


def q_leaderboard_totals(spark, sf_dir):
    return L.leaderboard(Context(spark, sf_dir).timeline())


def q_leaderboard_ranked(spark, sf_dir):
    ctx = Context(spark, sf_dir)
    board = L.leaderboard(ctx.timeline())
    return L.with_leader_flag(L.with_rank(board)).select("hashtag", "total", "rank", "leader")


def q_top_leaders(spark, sf_dir):
    return L.top_leaders(L.leaderboard(Context(spark, sf_dir).timeline()))


def q_leader_changes(spark, sf_dir):
    ctx = Context(spark, sf_dir)
    return L.leader_changes(ctx.steps())


def q_activity_log(spark, sf_dir):
    return L.activity_log(Context(spark, sf_dir).steps())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "trending_6h": q_trending_6h,
    "features": q_features,
    "hashtags_per_edit": q_hashtags_per_edit,
    "hashtag_features": q_hashtag_features,
    "features_wkt": q_features_wkt,
    "feature_centers": q_feature_centers,
    "feature_class_counts": q_feature_class_counts,
    "rejected_features": q_rejected_features,
    "parsed_times": q_parsed_times,
    "clean_hashtag": q_clean_hashtag,
    "latest_for_hashtag": q_latest_for_hashtag,
    "recent_features": q_recent_features,
    "preview": q_preview,
    "packed_entries": q_packed_entries,
    "unpacked_entries": q_unpacked_entries,
    "trending_repeated": q_trending_repeated,
    "score_keys": q_score_keys,
    "rolling_scores": q_rolling_scores,
    "scores_with_zeros": q_scores_with_zeros,
    "trending_edits": q_trending_edits,
    "timeline_entries": q_timeline_entries,
    "timeline_entries_indexed": q_timeline_entries_indexed,
    "timeline_runs": q_timeline_runs,
    "timeline_runs_drop": q_timeline_runs_drop,
    "collapse_stats": q_collapse_stats,
    "timeline": q_timeline,
    "timeline_json": q_timeline_json,
    "timeline_replay": q_timeline_replay,
    "timeline_progress": q_timeline_progress,
    "running_totals": q_running_totals,
    "leaderboard_totals": q_leaderboard_totals,
    "leaderboard_ranked": q_leaderboard_ranked,
    "top_leaders": q_top_leaders,
    "activity_log": q_activity_log,
    "leader_changes": q_leader_changes,
}
