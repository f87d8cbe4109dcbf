"""The queries that SQL can express, against DuckDB on the smallest tables."""

import duckdb
import pytest

from growthlens.fixed_values import FIXTURE_TABLES
from growthlens.llm.queries import ORACLE_SQL, QUERIES
from growthlens.plans.compare import compare, duckdb_views

from .conftest import SF


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    duckdb_views(con, SF, FIXTURE_TABLES)
    out = compare(name, QUERIES[name](spark, SF), con, ORACLE_SQL[name])
    assert out.ok, out.detail
