"""Every named query against its SQL in DuckDB, at the smallest scale."""

import os

import duckdb
import pytest

from phenogrid.plans import registry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(v):
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in SQL:
        assert rows
        return
    found = duck.execute(SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert {c: TYPES[t] for c, t in df.dtypes} == {d[0]: str(d[1]) for d in found.description}
    order = sorted(columns)
    at = [columns.index(c) for c in order]
    assert sorted(tuple(plain(r[c]) for c in order) for r in rows) == sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())
