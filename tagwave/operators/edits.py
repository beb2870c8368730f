"""Edit operators: ways, comments, hashtags, geometry, features, rejects (O-12..O-24).

All are native column expressions over the decoded struct ``e``; none leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.tags import DEFAULT_COMMENT, either, has_tag, hashtags, hashtags_sql

TAGS = "e.tags"
FIELDS_PRESENT = ("e.user IS NOT NULL AND e.id IS NOT NULL AND e.action IS NOT NULL "
                  "AND e.metadata.id IS NOT NULL AND e.metadata.created_at IS NOT NULL")


def filter_ways(df: DataFrame) -> DataFrame:
    """Keep ways (O-12)."""
    return df.where("e.type = 'way'")


def with_comment(df: DataFrame, default: str = DEFAULT_COMMENT) -> DataFrame:
    """Absent (or JSON-null) comment becomes the default; an empty string is kept (O-13)."""
    return df.withColumn("comment", F.coalesce(F.col("e.metadata.comment"), F.lit(default)))


def with_hashtags(df: DataFrame, dedupe: str = "before") -> DataFrame:
    """Add the hashtag array of the comment (O-14)."""
    return df.withColumn("hashtags", hashtags("comment", dedupe))


def mapped() -> Column:
    """Building or highway tag present (O-17 predicate)."""
    return either(has_tag("building", TAGS), has_tag("highway", TAGS))


def filter_mapped(df: DataFrame) -> DataFrame:
    """Keep buildings and highways (O-17)."""
    return df.where(mapped())


def with_points(df: DataFrame) -> DataFrame:
    """Nodes with both coordinates as doubles, order kept (O-18)."""
    return df.withColumn("points", G.points("e.nodes"))


def with_geometry(df: DataFrame) -> DataFrame:
    """Polygon for buildings, line otherwise (O-19)."""
    return df.withColumn("geom_type", G.geometry_type(TAGS))


def _fields_present() -> Column:
    return F.expr(FIELDS_PRESENT)


def valid_sql() -> str:
    """Feature validity (O-21) as SQL: nodes present, coordinates numeric, enough points for the
    geometry, all record fields present."""
    return (f"e.nodes IS NOT NULL AND NOT {G.bad_coordinate_sql('e.nodes')} "
            f"AND ({G.valid_geometry_sql('geom_type', 'points')}) AND {FIELDS_PRESENT}")


def valid() -> Column:
    return F.expr(valid_sql())


def filter_valid(df: DataFrame) -> DataFrame:
    """Keep valid features (O-21)."""
    return df.where(valid_sql())


def to_features(df: DataFrame, digits: int = G.DIGITS) -> DataFrame:
    """Project the feature record (O-20): user, id, changeset, date, feature (WKT), action,
    comment, hashtags; plus the arrival sequence/clock and the point list for later operators."""
    return df.selectExpr(
        "edit_id", "ts", "e.user AS user", "e.id AS id", "e.metadata.id AS changeset",
        "e.metadata.created_at AS date", f"{G.wkt_sql('geom_type', 'points', digits)} AS feature",
        "e.action AS action", "comment", "hashtags", "points", "geom_type",
    )


def computed_once(df: DataFrame, **named: str) -> DataFrame:
    """Add columns evaluated exactly once per row.

    Catalyst inlines a projected expression into every filter that uses it (and into the
    ``size > 0`` filter it infers for an explode), so an array lambda would run once per use.
    Computing the columns inside a one-element ``explode`` makes them generator output, which
    no filter can be pushed beneath. ``named`` maps output names to SQL expressions.
    """
    packed = "named_struct(" + ", ".join(f"'{name}', {sql}" for name, sql in named.items()) + ")"
    out = df.selectExpr("*", f"explode(array({packed})) AS _once")
    return out.selectExpr(*[f"`{c}`" for c in df.columns], *[f"_once.{name} AS {name}" for name in named])


def features(parsed: DataFrame, dedupe: str = "before", digits: int = G.DIGITS) -> DataFrame:
    """Decoded edits to valid feature records: O-12, O-13, O-14, O-17, O-18, O-19, O-21, O-20.

    The cheap predicates (way, building/highway) run first on the decoded struct; comment,
    hashtags, points and geometry type are then computed once per surviving row.
    """
    df = filter_mapped(filter_ways(parsed))
    comment = f"coalesce(e.metadata.comment, '{DEFAULT_COMMENT}')"
    df = computed_once(df, comment=comment, hashtags=hashtags_sql(comment, dedupe),
                       points=G.points_sql("e.nodes"), geom_type=G.geometry_type_sql(TAGS))
    df = filter_valid(df)
    return to_features(df, digits)


def explode_hashtags(feats: DataFrame) -> DataFrame:
    """One row per (feature, hashtag); features without hashtags vanish (O-22, O-23).

    ``pos`` is the tag's place in the record, the last key of the arrival order
    ``(ts, edit_id, pos)`` used wherever "newest" matters.
    """
    return feats.selectExpr("edit_id", "ts", "date", "feature", "posexplode(hashtags) AS (pos, hashtag)")


REASONS = [
    ("undecodable json", lambda: F.col("e._corrupt").isNotNull() | F.col("e").isNull()),
    ("no type", lambda: F.col("e.type").isNull()),
    ("no tags", lambda: (F.col("e.type") == "way") & F.col("e.tags").isNull()),
    ("no nodes", lambda: F.col("_m") & F.col("e.nodes").isNull()),
    ("bad coordinate", lambda: F.col("_m") & G.bad_coordinate("e.nodes")),
    ("too few points", lambda: F.col("_m") & ~G.valid_geometry("geom_type", "points")),
    ("missing field", lambda: F.col("_m") & ~_fields_present()),
]


def rejects(parsed: DataFrame) -> DataFrame:
    """Records the reference would print and drop, or that would fail its task (O-24).

    Rows merely filtered (not a way, or neither building nor highway) are not rejects.
    Output: edit_id, ts, payload, reason (first matching reason).
    """
    df = parsed.withColumn("_m", F.coalesce((F.col("e.type") == "way") & mapped(), F.lit(False)))
    df = with_geometry(with_points(df))
    reason = F.lit(None).cast("string")
    for name, cond in reversed(REASONS):
        reason = F.when(F.coalesce(cond(), F.lit(False)), F.lit(name)).otherwise(reason)
    # generator output: the filter cannot be pushed beneath it and repeat the chain
    return (df.select("edit_id", "ts", "payload", F.explode(F.array(reason)).alias("reason"))
            .where(F.col("reason").isNotNull()))
