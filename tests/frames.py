"""Builders for small hand-made frames shaped like the canonical views."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F


def orders_frame(spark, rows):
    """rows: (order_id, user_id, status 'delivered'/'cancelled', 'YYYY-MM-DD', amount, payment)."""
    data = [(oid, uid, st, dt.datetime.fromisoformat(d), float(a), p) for oid, uid, st, d, a, p in rows]
    df = spark.createDataFrame(
        data, "order_id long, user_id long, order_status string, order_ts timestamp_ntz, "
              "order_amount double, payment_method string")
    return df.select(
        "order_id", "user_id", "order_status",
        (F.col("order_status") == "delivered").alias("is_delivered"),
        "order_ts", F.to_date("order_ts").alias("order_date"), "order_amount", "payment_method")


def events_frame(spark, rows):
    """rows: (user_id, event_name, 'YYYY-MM-DD HH:MM:SS', platform)."""
    data = [(i, uid, ev, dt.datetime.fromisoformat(ts), plat) for i, (uid, ev, ts, plat) in enumerate(rows)]
    df = spark.createDataFrame(
        data, "event_id long, user_id long, event_name string, event_time timestamp_ntz, platform string")
    return df.withColumn("day", F.to_date("event_time"))


def user_city_frame(spark, rows):
    """rows: (user_id, name, city)."""
    return spark.createDataFrame(rows, "user_id long, name string, city string")
