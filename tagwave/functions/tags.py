"""Tag predicates and hashtag extraction, all native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's behaviour.
DEFAULT_COMMENT = "(no comment)"
HASH = "#"
# Whitespace split as Python's str.split(): (?U) makes \s match Unicode spaces (no-break,
# em space, ...); Python also splits on the separators U+001C..U+001F, which \s does not.
WHITESPACE = r"(?U)[\s\x1c-\x1f]+"
WHITESPACE_SQL = WHITESPACE.replace("\\", "\\\\")  # inside a SQL string literal


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def has_tag(key: str, tags: str = "tags") -> Column:
    """Key presence only; the value is ignored, so ``building=no`` passes (O-15)."""
    return F.map_contains_key(F.expr(tags), F.lit(key))


def either(p: Column, q: Column) -> Column:
    """OR of two predicates (O-16)."""
    return p | q


def clean_hashtag(tag: str | Column) -> Column:
    """Strip one further leading '#', then one trailing comma (O-49)."""
    return F.regexp_replace(F.regexp_replace(_c(tag), r"^#", ""), r",$", "")


def hashtags_sql(comment: str, dedupe: str = "before") -> str:
    if dedupe not in ("before", "after"):
        raise ValueError("dedupe must be 'before' or 'after'")
    raw = f"transform(filter(split({comment}, '{WHITESPACE_SQL}'), p -> startswith(p, '{HASH}')), p -> substring(p, 2))"
    if dedupe == "before":
        raw = f"array_distinct({raw})"
    cleaned = (f"filter(transform(filter({raw}, t -> t <> ''), "
               f"t -> regexp_replace(regexp_replace(t, '^#', ''), ',$', '')), t -> t <> '')")
    return f"array_distinct({cleaned})" if dedupe == "after" else cleaned


def hashtags(comment: str, dedupe: str = "before") -> Column:
    """Array of hashtags of one comment (O-14, O-32, O-47, O-48).

    Tokens are split on whitespace, only tokens starting with '#' count, that '#' is dropped.
    ``dedupe='before'`` removes duplicate raw tokens before cleaning, so ``#a #a,`` yields ``a``
    twice, as the reference does; ``'after'`` removes duplicates of cleaned tags. Empty tags
    (from ``##`` or ``#,``) are dropped either way. ``comment`` is SQL text (a column name or
    expression): the expression is built as SQL in one call rather than node by node.
    """
    return F.expr(hashtags_sql(comment, dedupe))
