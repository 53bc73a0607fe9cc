"""Every registered query of the reference's operators against its DuckDB SQL on the smallest tables."""

import os

import duckdb
import pytest

from veristrata.plans import registry

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DIR):
        path = f"{DIR}/{f}"
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    if v is None or v != v:
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return round(v, 7) + 0.0
    return v if isinstance(v, (bool, int)) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    said = duck.execute(ORACLES[name])
    columns = [c[0] for c in said.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    got = sorted(([plain(r[c]) for c in order] for r in df.collect()), key=repr)
    want = sorted(([plain(r[columns.index(c)]) for c in order] for r in said.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_without_sql(spark, name):
    assert QUERIES[name](spark, DIR).collect()


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
