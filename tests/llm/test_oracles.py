"""Queries that SQL can express, against DuckDB on whole tables."""

from pathlib import Path

import duckdb
import pytest

from veldt.llm import queries
from veldt.llm.oracles import ORACLES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, duck, name):
    df = queries.queries()[name](spark, DATA)
    done = duck.execute(ORACLES[name])
    names = [d[0] for d in done.description]
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(str, (tuple(r) for r in df.select(*names).collect()))) == sorted(map(str, done.fetchall()))
