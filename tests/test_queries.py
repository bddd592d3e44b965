"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import math

import pytest

from tidemark.plans import command_queries, keyed_queries, relational, stream_queries
from tidemark.sources.tables import TABLES

duckdb = pytest.importorskip("duckdb")
MODULES = (relational, keyed_queries, command_queries, stream_queries)
QUERIES = {k: v for m in MODULES for k, v in m.queries().items()}
ORACLES = {k: v for m in MODULES for k, v in m.oracle_sql().items()}


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.10g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, db, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    rel = db.sql(ORACLES[name])
    assert sorted(rel.columns) == columns
    want = [tuple(plain(dict(zip(rel.columns, r, strict=True))[c]) for c in columns) for r in rel.fetchall()]
    assert ordered(got) == ordered(want)


def test_every_query_has_an_oracle():
    assert ORACLES.keys() == QUERIES.keys()


def test_plans_push_filters_and_prune_columns(spark, sf):
    plan = QUERIES["rel_point_lookup"](spark, sf)._jdf.queryExecution().toString()
    assert "EqualTo(c_custkey,42)" in plan
    assert "ReadSchema: struct<c_custkey:bigint,c_name:string,c_acctbal:double>" in plan
    plan = QUERIES["scan_prefix"](spark, sf)._jdf.queryExecution().toString()
    assert "StringStartsWith(c_name,Customer#00000001)" in plan


def test_radius_join_has_no_nested_loop(spark, sf):
    plan = QUERIES["geo_radius_join"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
