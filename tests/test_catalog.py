"""Every query with an oracle against DuckDB, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from factloom.plans import catalog, changes, decided, formats

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def rows(df):
    def plain(x):
        if x is None or (not hasattr(x, "__len__") and pd.isna(x)):
            return None
        return round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x) if isinstance(x, str) else x.item() if hasattr(x, "item") else x

    names = sorted(df.columns)
    return sorted((tuple(plain(v) for v in r) for r in df[names].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), duck.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(changes.QUERIES | decided.QUERIES | formats.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() >= 0


def test_plans_push_filters_and_avoid_nested_loops(spark):
    def plan(name):
        return catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()

    assert "PushedFilters: [IsNotNull(doc_id)" in plan("s01_point_lookup")
    for name in ("f04_grants_as_table", "f05_ceilings_as_table", "j05_conflicts", "j14_emission_interval_join"):
        assert "NestedLoop" not in plan(name) and "Cartesian" not in plan(name), name
    assert "TakeOrderedAndProject" in plan("l01_recent_page")
