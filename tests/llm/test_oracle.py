"""The operators that SQL can express against their DuckDB texts."""

import os

import duckdb
import pytest

from tagwave.llm.queries import ORACLE, QUERIES
from tools.check_oracle import TABLES, rows_of

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(path := os.path.join(SF, f"{t}.parquet")):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    df = QUERIES[name](spark, SF)
    wanted = con.execute(ORACLE[name])
    columns = [d[0] for d in wanted.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of([tuple(r) for r in df.collect()], df.columns) == rows_of(wanted.fetchall(), columns)
    con.close()
