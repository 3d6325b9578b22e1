"""Every query of the catalogue against its SQL in DuckDB."""

import glob
import os

import duckdb
import pytest

from ledgerlens.plans import catalog, decoded, more, overlays, templated  # noqa: F401


def rows(df):
    columns = sorted(df.columns)
    plain = df[columns].astype(object).where(df[columns].notna(), None)
    return columns, sorted(map(str, ([int(v) if isinstance(v, float) and v.is_integer() else v for v in r] for r in plain.itertuples(index=False, name=None))))


@pytest.fixture(scope="module")
def oracle(small):
    c = duckdb.connect()
    for p in glob.glob(f"{small}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, small, oracle, name):
    assert rows(catalog.QUERIES[name](spark, small).toPandas()) == rows(oracle.execute(catalog.SQL[name]).df())


def test_plans_push_filters_and_prune_columns(spark, small):
    plan = catalog.balance_point(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_custkey,7)" in plan and "l_discount" not in plan


def test_top_rows_are_no_global_sort(spark, small):
    assert "TakeOrderedAndProject" in catalog.swap_history(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in catalog.orderbook(spark, small)._jdf.queryExecution().executedPlan().toString()
