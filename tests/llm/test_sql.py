"""The training-data queries that have SQL against it."""

import duckdb
import pytest

from survperf.llm import queries as Q
from survperf.llm import sql
from tests.test_oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    compare(Q.queries()[name](spark, SF), con, sql.oracle_sql()[name])
