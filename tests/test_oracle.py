"""Every registered query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from survperf.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool):
        return str(v)
    return f"{v + 0.0:.5f}" if isinstance(v, (int, float)) else str(v)


def compare(df, duck, sql):
    got, want = df.collect(), duck.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    names = sorted(df.columns)
    at = [want.columns.index(n) for n in names]
    assert sorted([plain(r[n]) for n in names] for r in got) == sorted([plain(r[i]) for i in at] for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    compare(registry.queries()[name](spark, SF), duck, registry.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    df = registry.queries()[name](spark, SF)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)
