"""Column builders: every scalar of the reference as a native Spark expression."""

from .geometry import bad_coordinate, bbox_center, feature_class, geometry_type, points, ring, valid_geometry, wkt
from .tags import DEFAULT_COMMENT, clean_hashtag, either, has_tag, hashtags
from .text import (
    clock,
    epoch_seconds,
    log_line,
    pack_entry,
    parse_int,
    parse_time,
    score_key,
    strip_score_prefix,
    ts_literal,
    unpack_entry,
    url_decode,
)

__all__ = [
    "DEFAULT_COMMENT", "bad_coordinate", "bbox_center", "clean_hashtag", "clock", "either", "epoch_seconds",
    "feature_class", "geometry_type", "has_tag", "hashtags", "log_line", "pack_entry", "parse_int", "parse_time",
    "points", "ring", "score_key", "strip_score_prefix", "ts_literal", "unpack_entry", "url_decode",
    "valid_geometry", "wkt",
]
