"""Scalar text and time helpers: entry packing, key prefixes, parsing and log lines."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tags import _c

# Fixed values that must equal the reference's key layout.
SCORE_KEY_PREFIX = "hashtags:score:"
LIST_KEY_PREFIX = "hashtags:list:"
ENTRY_SEP = "|"


def pack_entry(*cols: str | Column) -> Column:
    """``wkt|date`` (and ``|tag`` appended) as stored in the per-hashtag list (O-53)."""
    return F.concat_ws(ENTRY_SEP, *[_c(c) for c in cols])


def unpack_entry(entry: str | Column) -> Column:
    """Split a packed entry on '|' into struct<feature, time, hashtag> (O-54).

    Like the reference, a hashtag holding '|' is cut at its first '|' (quirk Q7).
    """
    parts = F.split(_c(entry), r"\|")
    return F.struct(
        F.element_at(parts, 1).alias("feature"),
        F.element_at(parts, 2).alias("time"),
        F.element_at(parts, 3).alias("hashtag"),
    )


def score_key(label: str | Column, tag: str | Column) -> Column:
    """``hashtags:score:<label>:<tag>``."""
    lab = F.lit(label) if isinstance(label, str) else label
    return F.concat(F.lit(SCORE_KEY_PREFIX), lab, F.lit(":"), _c(tag))


def strip_score_prefix(key: str | Column, label: str = "6") -> Column:
    """Hashtag from a score key: drop the 17-character prefix ``hashtags:score:6:`` (O-55)."""
    prefix = f"{SCORE_KEY_PREFIX}{label}:"
    return F.substring(_c(key), len(prefix) + 1, 1 << 30)


def parse_int(text: str | Column) -> Column:
    """Base-10 integer like ``parseInt(x, 10)``: leading sign and digits, else NULL (O-56)."""
    digits = F.regexp_extract(_c(text), r"^\s*([+-]?[0-9]+)", 1)
    return F.when(digits != "", digits.try_cast(T.LongType()))


def url_decode(text: str | Column) -> Column:
    """Percent-decoding of a requested hashtag; NULL on a malformed escape (O-57)."""
    return F.try_url_decode(_c(text))


def utc_wall_clock(instant: Column) -> Column:
    """TIMESTAMP_NTZ of an instant in UTC, whatever the session's zone."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(instant), F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"))


def parse_time(text: str | Column) -> Column:
    """Date string to TIMESTAMP_NTZ in UTC, NULL when unparseable (O-58).

    ISO forms with an offset or ``Z``, and the mail form (``Tue, 02 Jan 2024 12:00:00 +0500``),
    are instants and are moved to UTC; a date without a zone is read as UTC.
    """
    t = F.trim(_c(text))
    zoned = t.rlike(r"^\d.*[T ]\d{1,2}:.*(?:Z|UTC|GMT|[+-]\d{1,2}(?::?\d{2})?)$")
    iso = F.regexp_replace(t, r"([+-]\d{2})(\d{2})$", "$1:$2")
    mail = F.regexp_replace(F.regexp_replace(t, r"^[A-Za-z]{3},\s*", ""), r"(?:GMT|UTC?|Z)$", "+0000")
    return (F.when(zoned, utc_wall_clock(iso.try_cast(T.TimestampType())))
            .when(t.rlike(r"^(?:[A-Za-z]{3},\s*)?\d{1,2} [A-Za-z]{3} \d{4} "),
                  utc_wall_clock(F.try_to_timestamp(mail, F.lit("d MMM yyyy H:mm:ss Z"))))
            .otherwise(t.try_cast(T.TimestampNTZType())))


def clock(ts: str | Column) -> Column:
    """``H:MM`` with minutes zero-padded (O-59)."""
    return F.date_format(_c(ts), "H:mm")


def log_line(clock_col: str | Column, count: str | Column, feature: str | Column, tag: str | Column) -> Column:
    """``H:MM - N feature(s) -tag`` (O-60)."""
    return F.concat(_c(clock_col), F.lit(" - "), _c(count).cast("string"), F.lit(" "), _c(feature),
                    F.lit("(s) -"), _c(tag))


def epoch_seconds(ts: str | Column) -> Column:
    """Whole epoch seconds. TIMESTAMP_NTZ is read as UTC, so the session zone does not matter."""
    return F.unix_timestamp(_c(ts))


def ts_literal(epoch: int, ntz: bool = True) -> Column:
    """Timestamp literal for an epoch second, NTZ (wall clock in UTC) or an instant.

    A literal bound (not an expression of the column) lets Catalyst push the range into
    the parquet scan, so only row groups inside the window are read.
    """
    if ntz:
        text = datetime.fromtimestamp(epoch, tz=timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
        return F.expr(f"TIMESTAMP_NTZ '{text}'")
    return F.expr(f"timestamp_seconds({int(epoch)})")
