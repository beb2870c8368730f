"""tagwave: trending-hashtag analytics over map edits on Spark DataFrames and Structured Streaming.

"""

from .operators.edits import explode_hashtags, features, rejects
from .operators.leaderboard import (
    activity_log,
    leader_changes,
    leaderboard,
    replay,
    running_totals,
    top_leaders,
    with_rank,
)
from .operators.timeline import collapse_runs, sort_timeline, top_by_score
from .operators.trending import bucket_counts, rolling_scores, trending, zero_scores
from .sources.edits import parse_edits, read_edits
from .streaming.stream import follow_changes, refresh_timeline, run_stream

__version__ = "0.1.0"

__all__ = [
    "activity_log", "bucket_counts", "collapse_runs", "explode_hashtags", "features", "follow_changes",
    "leader_changes", "leaderboard", "parse_edits", "read_edits", "refresh_timeline", "rejects", "replay",
    "rolling_scores", "run_stream", "running_totals", "sort_timeline", "top_by_score", "top_leaders", "trending",
    "with_rank", "zero_scores",
]
