"""Every catalog query with SQL, at the smallest scale, against DuckDB."""

import os

import duckdb
import pytest

import millrace.plans.round_trips  # noqa: F401
from millrace.plans.catalog_queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def plain(v):
    if v is None or isinstance(v, (bool, str)):
        return str(v)
    if isinstance(v, (int, float)):
        return f"{float(v) + 0.0:.6g}"
    try:
        return f"{float(v):.6g}"
    except (TypeError, ValueError):
        return str(v)


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    for f in os.listdir(SF):
        out.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return out


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    mine = sorted([plain(r[c]) for c in columns] for r in df.collect())
    got = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == columns
    place = [names.index(c) for c in columns]
    assert mine == sorted([plain(r[k]) for k in place] for r in got.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    rows = QUERIES[name](spark, SF).collect()
    assert rows and all(v is not None for v in rows[0])
