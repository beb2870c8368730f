"""Edge tables for the scalar functions (FIXTURES.md section 3)."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagwave.functions import (clean_hashtag, clock, feature_class, hashtags, pack_entry, parse_int, parse_time,
                               strip_score_prefix, unpack_entry, url_decode)
from tagwave.functions import geometry as G
from tagwave.schema import POINT

HASHTAG_CASES = [
    ("#a #a,", ["a", "a"], ["a"]),
    ("a##b #c,, ##d # ## #, x#y (#z) #a#b #É #e,f", ["c,", "d", "a#b", "É", "e,f"], None),
    ("p #nbsp #em\t#tab  #é", ["nbsp", "em", "tab", "é"], None),
    ("#x\n#y", ["x", "y"], None),
    ("#pipe|tail", ["pipe|tail"], None),
    ("", [], None),
    ("(no comment)", [], None),
]


@pytest.mark.parametrize("comment,before,after", HASHTAG_CASES)
def test_hashtags(spark, comment, before, after):
    df = spark.createDataFrame([(comment,)], "c string")
    row = df.select(hashtags("c").alias("b"), hashtags("c", dedupe="after").alias("a")).first()
    assert sorted(row.b) == sorted(before)
    assert sorted(row.a) == sorted(after if after is not None else set(before))


def test_clean_hashtag(spark):
    df = spark.createDataFrame([("#a",), ("a,",), ("##a,,",), ("a",)], "t string")
    assert [r[0] for r in df.select(clean_hashtag("t")).collect()] == ["a", "a", "#a,", "a"]


def _pts(spark, pts):
    schema = T.StructType([T.StructField("pts", T.ArrayType(POINT))])
    return spark.createDataFrame([([{"lon": float(x), "lat": float(y)} for x, y in pts],)], schema)


@pytest.mark.parametrize("gtype,pts,valid,wkt", [
    ("POLYGON", [(0, 0), (1, 0), (1, 1)], True, "POLYGON ((0.0000000000000000 0.0000000000000000, 1.0000000000000000 0.0000000000000000, "
                                                 "1.0000000000000000 1.0000000000000000, 0.0000000000000000 0.0000000000000000))"),
    ("POLYGON", [(0, 0), (1, 0), (1, 1), (0, 0)], True, "POLYGON ((0.0000000000000000 0.0000000000000000, 1.0000000000000000 0.0000000000000000, "
                                                         "1.0000000000000000 1.0000000000000000, 0.0000000000000000 0.0000000000000000))"),
    ("POLYGON", [(0, 0), (1, 0)], False, None),
    ("POLYGON", [(0, 0), (1, 0), (0, 0)], False, None),
    ("LINESTRING", [(0.25, -1.5), (2, 3)], True, "LINESTRING (0.2500000000000000 -1.5000000000000000, 2.0000000000000000 3.0000000000000000)"),
    ("LINESTRING", [(1, 1)], False, None),
])
def test_geometry(spark, gtype, pts, valid, wkt):
    df = _pts(spark, pts).withColumn("g", F.lit(gtype))
    row = df.select(G.valid_geometry("g", "pts").alias("v"), G.wkt("g", "pts").alias("w")).first()
    assert row.v == valid
    if valid:
        assert row.w == wkt


def test_points_and_bad_coordinates(spark):
    schema = "nodes array<struct<lon:string,lat:string>>"
    df = spark.createDataFrame([([("1.5", "2"), (None, "3"), ("4", None), ("abc", "1")],)], schema)
    row = df.select(G.points("nodes").alias("p"), G.bad_coordinate("nodes").alias("bad")).first()
    assert [(p.lon, p.lat) for p in row.p] == [(1.5, 2.0), (None, 1.0)]
    assert row.bad is True


def test_building_wins_and_value_ignored(spark):
    df = spark.createDataFrame([({"building": "no", "highway": "path"},), ({"highway": "x"},)],
                               "tags map<string,string>")
    assert [r[0] for r in df.select(G.geometry_type("tags")).collect()] == ["POLYGON", "LINESTRING"]


def test_center(spark):
    row = _pts(spark, [(0, 0), (2, 0), (2, 4)]).select(G.bbox_center("pts").alias("c")).first()
    assert (row.c.lon, row.c.lat) == (1.0, 2.0)


def test_text_helpers(spark):
    df = spark.createDataFrame([("POLYGON ((1 2))", "2024-01-01 09:05:00", "pipe|tail", " 12abc", "a%7Cb")],
                               "w string, d string, t string, n string, u string")
    row = df.select(
        feature_class("w").alias("cls"),
        unpack_entry(pack_entry("w", "d", "t")).alias("u"),
        parse_int("n").alias("n"),
        url_decode("u").alias("dec"),
        clock(parse_time("d")).alias("clk"),
        strip_score_prefix(F.lit("hashtags:score:6:abc")).alias("tag"),
        parse_time(F.lit("not a date")).alias("bad"),
    ).first()
    assert row.cls == "building"
    assert (row.u.feature, row.u.time, row.u.hashtag) == ("POLYGON ((1 2))", "2024-01-01 09:05:00", "pipe")
    assert row.n == 12 and row.dec == "a|b" and row.clk == "9:05" and row.tag == "abc" and row.bad is None
