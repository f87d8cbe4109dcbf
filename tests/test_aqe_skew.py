"""AQE splits a hot key in the order-line semi join (thresholds lowered to
test size), and the result is unchanged."""

from pyspark.sql import functions as F

from growthlens.operators import revenue
from growthlens.plans.inspect import plan_text


def test_hot_order_key_is_split_by_aqe(spark):
    # one order holds a third of all lines
    lines = spark.range(60000).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("order_id"),
        (F.col("id") % 50).alias("restaurant_id"),
        (F.col("id") % 97).cast("decimal(18,2)").alias("revenue"))
    delivered = spark.range(60000).select(F.col("id").alias("order_id"))
    rest = spark.range(50).select(F.col("id").alias("restaurant_id"),
                                  F.concat(F.lit("r"), F.col("id")).alias("name"),
                                  (F.col("id") % 5).cast("string").alias("city"))
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1024",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4096",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        semi = lines.join(delivered, "order_id", "left_semi")
        df = revenue.top_n_per_group(semi, rest, 2)
        got = sorted(map(tuple, df.collect()))
        final = plan_text(df)
        assert "isFinalPlan=true" in final
        assert "skew=true" in final, final[:3000]
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    expect = sorted(map(tuple, revenue.top_n_per_group(semi, rest, 2).collect()))
    assert got == expect


SKEW_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1024",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4096",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


def _hot_user_orders(spark, n=60000):
    return spark.range(n, numPartitions=6).select(
        F.col("id").alias("order_id"), F.when(F.col("id") % 3 == 0, F.lit(5)).otherwise(F.col("id") % 2000).alias("user_id"),
        F.lit("delivered").alias("order_status"), F.lit(True).alias("is_delivered"),
        F.to_timestamp_ntz(F.lit("2020-01-01 00:00:00")).alias("order_ts"), F.to_date(F.lit("2020-01-01")).alias("order_date"),
        (F.col("id") % 97).cast("double").alias("order_amount"), F.lit("1-URGENT").alias("payment_method"))


def _users(spark):
    return spark.range(2000, numPartitions=6).select(
        F.col("id").alias("user_id"), F.lit("n").alias("name"), F.concat(F.lit("c"), F.col("id") % 7).alias("city"))


def _with_conf(spark, fn):
    old = {k: spark.conf.get(k, None) for k in SKEW_CONF}
    try:
        for k, v in SKEW_CONF.items():
            spark.conf.set(k, v)
        return fn()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_filter_scope_splits_a_hot_user(spark):
    from growthlens.functions.scope import Scope, filter_scope

    def run():
        df = filter_scope(_hot_user_orders(spark), _users(spark), Scope(cities=("c5", "c1")))
        return df.collect(), plan_text(df)

    rows, plan = _with_conf(spark, run)
    assert "skew=true" in plan
    assert len(rows) == sum((5 if i % 3 == 0 else i % 2000) % 7 in (5, 1) for i in range(60000))


def test_ad_hoc_query_sums_a_hot_user_before_the_shuffle(spark):
    from growthlens.plans.registry import BUYERS_SQL
    from growthlens.sources import adhoc

    df = adhoc.run_sql(spark, BUYERS_SQL, {"status": "delivered"}, {"orders": _hot_user_orders(spark), "users": _users(spark)})
    got = {r.city: r for r in _with_conf(spark, df.collect)}
    assert sum(r.orders for r in got.values()) == 60000 and sum(r.buyers for r in got.values()) == len(
        {5 if i % 3 == 0 else i % 2000 for i in range(60000)})
