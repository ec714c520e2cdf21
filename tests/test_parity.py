"""Every query with SQL gives the same rows in Spark and in DuckDB, at the smallest scale."""

import math
import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from lectern.plans import alignment, checks, cleaning, exports, problems, regions, reports, texts, timeline

SF = os.environ.get("PARITY_SF_DIR", "/root/testdata/sf0.001")
CORE = {name for module in (problems, texts, timeline, exports, regions, cleaning, reports, alignment, checks) for name in module.SQL}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(SF).iterdir():
        path = f"{f}/*.parquet" if f.is_dir() else str(f)
        con.execute(f"create view {f.stem} as select * from '{path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else f"{v:.9g}"
    return v


@pytest.mark.parametrize("name", sorted(CORE))
def test_same_rows(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    cur = duck.execute(entry.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(row[names.index(c)]) for c in cols) for row in cur.fetchall()), key=repr)
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
