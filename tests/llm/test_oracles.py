"""Queries with an oracle equal their DuckDB statement; all queries run on the small tables."""

import duckdb
import pytest

from cohortsmith.llm import queries as Q

SF = "/root/testdata/sf0.01"
TABLES = ("documents", "pages", "benchmark", "labels", "conversations")


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(Q.SQL[name])
    names = [c[0] for c in want.description]
    df = Q.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(repr, map(tuple, df.select(*names).collect()))) == sorted(map(repr, want.fetchall()))
