"""Every query of the catalog against its SQL in DuckDB."""

import datetime
import math
from pathlib import Path

import duckdb
import pytest

from veldt import catalog

DATA = "/root/testdata/sf0.001"
ORACLE = catalog.oracle_sql()


def cell(x):
    if isinstance(x, bool) or x is None:
        return str(x)
    if isinstance(x, (int, float)):
        return "nan" if math.isnan(x) else f"{float(x):.9g}"
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return str(x)


def bag(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_same_as_oracle(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    ours = bag(df.columns, df.collect())
    if name not in ORACLE:
        return
    done = duck.execute(ORACLE[name])
    theirs = bag([d[0] for d in done.description], done.fetchall())
    assert ours == theirs
