"""Every registered query against its DuckDB oracle on the smallest fixture,
and the flagship entry point on the smoke fixture."""

import duckdb
import pytest

import __spark_entry__ as entry
from growthlens.plans.compare import compare, duckdb_views
from growthlens.plans.oracle import ORACLE_SQL
from growthlens.plans.registry import QUERIES
from growthlens.sources.tables import FIXTURE_TABLES

from conftest import SF_SMALL

# The library's own queries; the training-data ones are tested in tests/llm.
NAMES = sorted(QUERIES)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    duckdb_views(c, SF_SMALL, FIXTURE_TABLES)
    return c


def test_every_query_has_an_oracle():
    assert set(NAMES) == set(ORACLE_SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF_SMALL)
    out = compare(name, df, con, entry.oracle_sql()[name])
    assert out.ok, out.detail


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns[:2] == ["cohort_month", "cohort_size"]


@pytest.mark.parametrize("name", NAMES)
def test_output_columns_are_plain_names(spark, name):
    import re
    cols = entry.queries()[name](spark, SF_SMALL).columns
    assert len(cols) == len(set(cols))
    assert all(re.fullmatch(r"[a-z_][a-z0-9_]*", c) for c in cols), cols


@pytest.mark.parametrize("name", NAMES)
def test_every_query_reads_the_fixture_tables(spark, name):
    from growthlens.plans.inspect import plan_text
    text = plan_text(entry.queries()[name](spark, SF_SMALL))
    assert "Scan parquet" in text or "ExistingRDD" in text   # checkpointed derivations
