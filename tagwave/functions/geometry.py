"""Point lists, WKT text and bounding-box centres, computed on arrays of structs.

Each builder has a SQL-text form (``*_sql``, taking SQL expressions such as column names) and
a ``Column`` form wrapping it; the text form lets a whole projection be built in one call.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .tags import _c

POLYGON = "POLYGON"
LINESTRING = "LINESTRING"
DIGITS = 16  # decimals of WKT text, as the reference's library writes them: no coordinate loses any


def points_sql(nodes: str = "nodes") -> str:
    return (f"transform(filter({nodes}, n -> n.lon IS NOT NULL AND n.lat IS NOT NULL), "
            f"n -> named_struct('lon', try_cast(n.lon AS DOUBLE), 'lat', try_cast(n.lat AS DOUBLE)))")


def points(nodes: str = "nodes") -> Column:
    """Nodes having both coordinates, cast to double, order kept (O-18)."""
    return F.expr(points_sql(nodes))


def bad_coordinate_sql(nodes: str = "nodes") -> str:
    return (f"exists({nodes}, n -> n.lon IS NOT NULL AND n.lat IS NOT NULL "
            f"AND (try_cast(n.lon AS DOUBLE) IS NULL OR try_cast(n.lat AS DOUBLE) IS NULL))")


def bad_coordinate(nodes: str = "nodes") -> Column:
    """True when a node has both coordinates but one is not a number."""
    return F.expr(bad_coordinate_sql(nodes))


def geometry_type_sql(tags: str = "tags") -> str:
    return f"CASE WHEN map_contains_key({tags}, 'building') THEN '{POLYGON}' ELSE '{LINESTRING}' END"


def geometry_type(tags: str = "tags") -> Column:
    """Polygon when tagged building (building wins over highway), else line (O-19)."""
    return F.expr(geometry_type_sql(tags))


def valid_geometry_sql(geom_type: str, pts: str) -> str:
    return (f"CASE WHEN {geom_type} = '{POLYGON}' "
            f"THEN size({pts}) >= 3 AND NOT (size({pts}) = 3 AND {pts}[0] = element_at({pts}, -1)) "
            f"ELSE size({pts}) >= 2 END")


def valid_geometry(geom_type: str, pts: str) -> Column:
    """Polygon: >= 3 points and not exactly 3 with first = last. Line: >= 2 points (Q14)."""
    return F.expr(valid_geometry_sql(geom_type, pts))


def ring_sql(pts: str) -> str:
    return f"CASE WHEN {pts}[0] = element_at({pts}, -1) THEN {pts} ELSE concat({pts}, array({pts}[0])) END"


def ring(pts: str) -> Column:
    """Close a polygon ring once: append the first point unless it already ends the list."""
    return F.expr(ring_sql(pts))


def wkt_sql(geom_type: str, pts: str, digits: int = DIGITS) -> str:
    coord = f"q -> format_string('%.{digits}f %.{digits}f', q.lon, q.lat)"
    return (f"CASE WHEN {geom_type} = '{POLYGON}' "
            f"THEN concat('POLYGON ((', array_join(transform({ring_sql(pts)}, {coord}), ', '), '))') "
            f"ELSE concat('LINESTRING (', array_join(transform({pts}, {coord}), ', '), ')') END")


def wkt(geom_type: str, pts: str, digits: int = DIGITS) -> Column:
    """WKT text of a point list, ``POLYGON ((x y, ...))`` or ``LINESTRING (x y, ...)`` (O-50);
    polygon rings are closed once."""
    return F.expr(wkt_sql(geom_type, pts, digits))


def feature_class(wkt_text: str | Column) -> Column:
    """'building' for WKT starting with P (a polygon), else 'way' (O-27)."""
    return F.when(_c(wkt_text).startswith("P"), F.lit("building")).otherwise(F.lit("way"))


def bbox_center(pts: str) -> Column:
    """Centre of the bounding box of a point list, struct<lon, lat> (O-61)."""
    xs, ys = f"transform({pts}, q -> q.lon)", f"transform({pts}, q -> q.lat)"
    return F.expr(f"named_struct('lon', (array_min({xs}) + array_max({xs})) / 2, "
                  f"'lat', (array_min({ys}) + array_max({ys})) / 2)")
