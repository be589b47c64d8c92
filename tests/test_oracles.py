"""Every query of the engine against its reference SQL in DuckDB, on the small tables."""

import os

import duckdb
import pytest

from tessella.plans import catalogue

BASE = "/root/testdata/sf0.001"
SQL = catalogue.oracle_sql()


def plain(v):
    if v is None or v != v:
        return ""
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return f"{float(v):.9g}"
    return str(v)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(BASE):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{BASE}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, db, name):
    got = catalogue.queries()[name](spark, BASE)
    want = db.execute(SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    ours = sorted(tuple(plain(r[c]) for c in sorted(columns)) for r in got.collect())
    theirs = sorted(tuple(plain(v) for _, v in sorted(zip(columns, r))) for r in want.fetchall())
    assert ours == theirs


def test_queries_without_sql_run(spark):
    for name in sorted(set(catalogue.queries()) - set(SQL)):
        assert catalogue.queries()[name](spark, BASE).count() >= 0
