"""Every registered query against its DuckDB text on the smallest scale factor."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tagwave.plans.catalog import QUERIES
from tagwave.streaming.stream import STREAM_QUERIES
from tools.check_oracle import TABLES, rows_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = os.path.join(SF, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    yield con
    con.close()


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_oracle(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    res = duck.execute(entry.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    assert rows_of([tuple(r) for r in df.collect()], df.columns) == rows_of(res.fetchall(), dcols)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["hashtag", "score"]
    assert df.count() >= 0


def test_every_engine_query_has_an_oracle_or_is_a_feed():
    assert {*QUERIES, *STREAM_QUERIES} - set(entry.oracle_sql()) <= {"change_feed"}


TIMELINE_FAMILY = ["timeline_entries", "timeline_runs", "timeline_runs_drop", "timeline", "running_totals",
                   "leaderboard_ranked", "leader_changes", "timeline_progress"]


@pytest.fixture(scope="module")
def duck_oracle_sf():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    sf = "/root/testdata/sf0.01"
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{sf}/events.parquet')")
    yield con, sf
    con.close()


@pytest.mark.parametrize("name", TIMELINE_FAMILY)
def test_ordered_scans_match_oracle(spark, duck_oracle_sf, name):
    """The queries built on range-partitioned scans, where the tables span several partitions."""
    con, sf = duck_oracle_sf
    df = entry.queries()[name](spark, sf)
    got = rows_of([tuple(r) for r in df.collect()], df.columns)
    res = con.execute(entry.oracle_sql()[name])
    assert got == rows_of(res.fetchall(), [d[0] for d in res.description])
