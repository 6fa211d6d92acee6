"""Queries with SQL agree with DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from seamline.llm import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in sorted(os.listdir(SF)):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    got = Q.queries()[name](spark, SF)
    columns = sorted(got.columns)
    rows = sorted(tuple(str(r[c]) for c in columns) for r in got.collect())
    found = con.execute(Q.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert rows == sorted(tuple(str(r[names.index(c)]) for c in columns) for r in found.fetchall())
