"""Distributed NTILE equals the single-partition window, for sizes at and
around the tile count and with ties on the ordering value."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from growthlens.operators import ranking

from frames import orders_frame


@pytest.mark.parametrize("n,parts", [(0, 4), (1, 4), (19, 4), (20, 3), (21, 5), (1561, 7), (2000, 16)])
def test_distributed_ntile_matches_window(spark, n, parts):
    df = spark.range(n).select(F.col("id").alias("k"), (F.col("id") % 37).cast("double").alias("v"))
    order = [F.desc("v"), F.asc("k")]
    got = ranking.distributed_ntile(df, 20, "v", "k", fanout=parts, key_fanout=3)
    expect = df.select("k", F.ntile(20).over(Window.orderBy(*order)).alias("t"),
                       F.row_number().over(Window.orderBy(*order)).alias("i"))
    joined = got.join(expect, "k", "full")
    assert joined.count() == n
    assert joined.where((F.col("tile") != F.col("t")) | (F.col("rank_pos") != F.col("i"))
                        | F.col("tile").isNull() | F.col("t").isNull()).count() == 0


@pytest.mark.parametrize("fanout", [2, 32])
def test_ntile_where_most_rows_are_tied(spark, fanout):
    df = spark.range(3000).select(F.col("id").alias("k"), F.when(F.col("id") % 3 != 0, 5).otherwise(F.col("id") % 11)
                                  .cast("decimal(28,2)").alias("v"))
    order = [F.desc("v"), F.asc("k")]
    expect = df.select("k", F.ntile(20).over(Window.orderBy(*order)).alias("t"))
    got = ranking.distributed_ntile(df, 20, "v", "k", fanout=fanout).join(expect, "k")
    assert got.count() == 3000 and got.where("tile <> t").count() == 0
    # The tied rows are spread over tasks.
    largest = ranking.distributed_ntile(df, 20, "v", "k", fanout=fanout)
    assert "checkpoint" not in largest._jdf.queryExecution().toString()


def test_first_ventile_size_of_1561_users(spark):
    df = spark.range(1561).select(F.col("id").alias("k"), F.rand(7).alias("v"))
    got = ranking.distributed_ntile(df, 20, "v", "k")
    assert got.where("tile = 1").count() == 79


def test_pareto_with_equal_gmv(spark):
    rows = [(i, i, "delivered", "2024-01-01", 100, "UPI") for i in range(1, 22)]
    orders = orders_frame(spark, rows)
    seg = {r.segment: r for r in ranking.pareto_split(orders).collect()}
    # 21 users -> q=1, r=1: the first tile holds 2 users, chosen by user_id on ties
    assert seg[ranking.TOP_SEGMENT].users == 2
    assert seg[ranking.REST_SEGMENT].users == 19
    top = ranking.power_users(orders).collect()
    assert [r.user_id for r in top] == [1, 2]
    ratio = ranking.concentration_ratio(orders).collect()[0]
    assert ratio.concentration_ratio == 1.0
