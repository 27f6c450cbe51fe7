"""Every registered query against its DuckDB oracle on the smallest scale factor."""
import hashlib
import math

import duckdb
import pytest

import __spark_entry__ as E
from codecorpus.sources.tables import BASE_TABLES

SF = "/root/testdata/sf0.001"
SQL = E.oracle_sql()
KEYS = sorted(E.queries())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in BASE_TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6))
    if isinstance(v, (bytes, bytearray, memoryview)):
        return bytes(v).hex()
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return repr(v)


def _digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted("|".join(_norm(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("key", KEYS)
def test_query(spark, con, key):
    df = E.queries()[key](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    assert df.columns
    if key not in SQL:
        return
    res = con.execute(SQL[key])
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    assert _digest(df.columns, rows) == _digest(dcols, res.fetchall())


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0 and df.columns == ["repo_id", "n_files", "repo_map"]
