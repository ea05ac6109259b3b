"""Every registered query against its SQL in DuckDB, over whole tables."""

import glob
import os

import duckdb
import pytest

from quantloom.plans import library


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, (bool, int, str)):
        return v
    return float(f"{v:.9g}") if isinstance(v, float) else str(v)


def in_order(rows):
    return sorted(rows, key=lambda row: [(x is None, str(type(x)), 0 if x is None else x) for x in row])


@pytest.mark.parametrize("name", sorted(library.ORACLES))
def test_equals_sql(spark, duck, data, name):
    found = library.QUERIES[name](spark, data)
    columns = sorted(found.columns)
    result = duck.execute(library.ORACLES[name])
    theirs = [d[0] for d in result.description]
    assert sorted(theirs) == columns
    wanted = [tuple(plain(row[theirs.index(c)]) for c in columns) for row in result.fetchall()]
    assert in_order([tuple(plain(r[c]) for c in columns) for r in found.collect()]) == in_order(wanted)


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(set(library.QUERIES) - set(library.ORACLES)))
def test_runs_without_sql(spark, data, name):
    found = library.QUERIES[name](spark, data)
    assert found.columns and found.count() > 0
