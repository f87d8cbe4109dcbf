"""Ad-hoc SQL with bound parameters and capped fetch, row counts, the result sink."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from growthlens.sources import adhoc, catalog, sinks, views
from growthlens.sources.tables import Tables

from conftest import SF_SMALL


def test_run_sql_binds_values_and_frames(spark):
    t = Tables(spark, SF_SMALL)
    frames = adhoc.canonical_frames(t)
    df = adhoc.run_sql(spark, "SELECT COUNT(*) AS n FROM {orders} WHERE order_status = :s",
                       {"s": "cancelled"}, {"orders": frames["orders"]})
    expect = views.orders(t).where("order_status = 'cancelled'").count()
    assert df.collect()[0].n == expect


def test_run_sql_rejects_two_statements(spark):
    with pytest.raises(Exception):
        adhoc.run_sql(spark, "SELECT 1; SELECT 2").collect()


@pytest.mark.parametrize("n,limit,rows,truncated", [(3, 5, 3, False), (5, 5, 5, False), (6, 5, 5, True)])
def test_capped_fetch(spark, n, limit, rows, truncated):
    got = adhoc.capped(spark.range(n).repartition(3), [F.desc("id")], limit).collect()
    assert [r.id for r in got] == list(range(n - 1, n - 1 - rows, -1))
    assert all(r.truncated == truncated for r in got)


def test_capped_fetch_needs_an_order(spark):
    with pytest.raises(ValueError):
        adhoc.capped(spark.range(3), [])


def test_row_counts_and_schema_listing(spark):
    t = Tables(spark, SF_SMALL)
    got = {r.table_name: r.n for r in catalog.table_row_counts({"nation": t.nation, "region": t.region}).collect()}
    assert got == {"nation": 25, "region": 5}
    listing = dict(catalog.schema_listing(t, ["region"]))
    assert listing["region"].startswith("struct<r_regionkey:int")


def test_write_result_round_trip(spark):
    out = os.path.join(tempfile.mkdtemp(prefix="growthlens-sink-"), "cancellations")
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v long")
    sinks.write_result(df, out, partition_by=["k"])
    back = spark.read.parquet(out)
    assert sorted((r.k, r.v) for r in back.collect()) == [("a", 1), ("b", 2)]
