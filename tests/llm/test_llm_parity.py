"""The llm queries with SQL give the same rows in Spark and in DuckDB, at the smallest scale."""

from pathlib import Path

import duckdb
import pytest

from lectern.llm import plans

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    got = plans.QUERIES[name](spark, SF)
    cur = con.execute(plans.SQL[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == sorted(got.columns)
    want = sorted((tuple(row[names.index(c)] for c in got.columns) for row in cur.fetchall()), key=repr)
    assert sorted(map(tuple, got.collect()), key=repr) == want
