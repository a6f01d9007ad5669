"""Every catalog query against its DuckDB SQL, and the shape of some plans."""

import os

import duckdb
import pytest

from lakeloom.plans import catalog


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
    return c


def normal(value):
    if value is None or value != value:
        return "null"
    return f"{value:.6g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_agrees_with_sql(spark, sf, duck, name):
    got = catalog.QUERIES[name](spark, sf)
    result = duck.execute(catalog.ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(got.columns) == sorted(columns)
    want = sorted(tuple(normal(v) for v in row) for row in result.fetchall())
    assert sorted(tuple(normal(r[c]) for c in columns) for r in got.collect()) == want


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_existence_becomes_semi_and_anti_joins(spark, sf):
    assert "LeftSemi" in plan(catalog.QUERIES["where_has"](spark, sf))
    assert "LeftAnti" in plan(catalog.QUERIES["doesnt_have"](spark, sf))
    assert "ExistenceJoin" in plan(catalog.QUERIES["or_where_has"](spark, sf))


def test_filters_and_columns_reach_the_scan(spark, sf):
    physical = catalog.QUERIES["filter_and"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderstatus)" in physical
    narrow = catalog.QUERIES["project_columns"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "o_orderdate" not in narrow


def test_topk_does_not_sort_everything(spark, sf):
    assert "TakeOrderedAndProject" in catalog.QUERIES["group_topk"](spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_verification_finds_only_the_left_out_column(spark, sf):
    assert [(r["kind"], r["column_name"]) for r in catalog.QUERIES["verify_schema"](spark, sf).collect()] == [("extra_column", "text")]


def test_entry_is_ordered(spark, sf):
    rows = catalog.flagship(spark, sf).collect()
    assert 0 < len(rows) <= 10 and [r["balance"] for r in rows] == sorted((r["balance"] for r in rows), reverse=True)
