"""Canonical views: the binding of the driver fixtures onto the analytic model.

The analytic model has orders, users, restaurants and app events. The
fixtures are a TPC-H-like star schema plus an event stream, bound as follows
(every operator reads only these functions, never the raw tables):

* orders       ← ``orders`` rows with status F (delivered) or P (cancelled);
                 status 'O' (still open) is not a finished order and drops out.
                 user_id = o_custkey, order_amount = o_totalprice,
                 payment_method = o_orderpriority, order_date = o_orderdate.
* users        ← ``customer ⋈ nation``; city = nation name. The fixtures carry
                 no signup date, so signup_date := the user's first F/P order
                 date (customers without one have no cohort).
* restaurants  ← ``supplier ⋈ nation ⋈ region``; city = nation name,
                 cuisine := region name, rating := s_acctbal (stand-ins).
* order lines  ← ``lineitem`` of delivered orders; revenue =
                 l_extendedprice * (1 - l_discount). They carry the
                 order → restaurant edge.
* app events   ← ``events``; funnel steps view → click → signup → purchase
                 ('error' is not a step); platform := props.k mod 3;
                 the funnel entity is a user-day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from growthlens.fixed_values import (CANCELLED, CANCELLED_CODE, DELIVERED, DELIVERED_CODE,  # noqa: F401
                                     ENTITY, FIRST_ORDER_LABELS, FIRST_ORDER_SPLITS, FUNNEL_STEPS,
                                     PLATFORMS)
from growthlens.functions.exprs import money
from growthlens.sources.tables import Tables


def orders(t: Tables) -> DataFrame:
    """One row per finished order."""
    o = t.orders
    status = F.col("o_orderstatus")
    return (
        o.where(status.isin(DELIVERED_CODE, CANCELLED_CODE))
        .select(
            F.col("o_orderkey").alias("order_id"),
            F.col("o_custkey").alias("user_id"),
            F.when(status == DELIVERED_CODE, DELIVERED).otherwise(CANCELLED).alias("order_status"),
            (status == DELIVERED_CODE).alias("is_delivered"),
            F.col("o_orderdate").alias("order_ts"),
            F.to_date("o_orderdate").alias("order_date"),
            F.col("o_totalprice").alias("order_amount"),
            F.col("o_orderpriority").alias("payment_method"),
        )
    )


def delivered_orders(t: Tables) -> DataFrame:
    return orders(t).where(F.col("is_delivered"))


def nations(t: Tables) -> DataFrame:
    """The city dimension; joins with it carry no hint, Spark knows its size."""
    return t.nation.select("n_nationkey", F.col("n_name").alias("city"), "n_regionkey")


def user_city(t: Tables) -> DataFrame:
    """(user_id, name, city) for every customer."""
    c = t.customer.select(
        F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"), "c_nationkey")
    return (c.join(nations(t), F.col("c_nationkey") == F.col("n_nationkey"), "inner")
             .select("user_id", "name", "city"))


def activity_from_orders(orders_df: DataFrame) -> DataFrame:
    """One row per user of an orders-shaped frame: signup_date (first order
    date), n_orders, n_delivered and the set of months with a delivered order.

    A single hash aggregate keyed by user (partial aggregation on the map
    side, so a user holding a third of all orders costs one row per map task).
    ``delivered_months`` holds month starts, so its size is bounded by the
    calendar span of the data, not by the number of orders.
    """
    month = F.trunc("order_date", "month")
    return orders_df.groupBy("user_id").agg(
        F.min("order_date").alias("signup_date"),
        F.count(F.lit(1)).alias("n_orders"),
        F.count(F.when(F.col("is_delivered"), 1)).alias("n_delivered"),
        F.collect_set(F.when(F.col("is_delivered"), month)).alias("delivered_months"),
        F.max("order_date").alias("last_order"),
    )


def all_activity(t: Tables) -> DataFrame:
    """``activity_from_orders`` of every user id and whether it is ``known`` to
    the users table. Unknown ones are in no cohort, but the data last until
    their ``last_order`` too, so retention needs no second scan for the end."""
    known = t.customer.select(F.col("c_custkey").alias("user_id")).distinct().withColumn("known", F.lit(True))
    return (activity_from_orders(orders(t)).join(known, "user_id", "left")
            .withColumn("known", F.coalesce("known", F.lit(False))))


def user_activity(t: Tables) -> DataFrame:
    """``activity_from_orders`` restricted to known customers (the users table)."""
    act = activity_from_orders(orders(t))
    # Inner join with the distinct customer keys, not a left-semi join:
    # Catalyst pushes a semi join below the aggregate, which would shuffle
    # orders at full grain and put a hot user's orders in one task.
    known = t.customer.select(F.col("c_custkey").alias("user_id")).distinct()
    return act.join(known, "user_id", "inner")


def users(t: Tables) -> DataFrame:
    """(user_id, name, city, signup_date) — users with a cohort. The join with
    ``user_city`` already keeps known customers only, so customer is read once."""
    act = activity_from_orders(orders(t)).select("user_id", "signup_date")
    return user_city(t).join(act, "user_id", "inner")


def restaurants(t: Tables) -> DataFrame:
    s = t.supplier.select(
        F.col("s_suppkey").alias("restaurant_id"), F.col("s_name").alias("name"),
        "s_nationkey", F.col("s_acctbal").alias("rating"))
    r = t.region.select("r_regionkey", F.col("r_name").alias("cuisine"))
    return (s.join(nations(t), F.col("s_nationkey") == F.col("n_nationkey"), "inner")
             .join(r, F.col("n_regionkey") == F.col("r_regionkey"), "inner")
             .select("restaurant_id", "name", "city", "cuisine", "rating"))


def order_lines(t: Tables) -> DataFrame:
    """(order_id, restaurant_id, revenue) for every line, of whatever order."""
    return t.lineitem.select(
        F.col("l_orderkey").alias("order_id"), F.col("l_suppkey").alias("restaurant_id"),
        (money("l_extendedprice") * (F.lit(1) - F.col("l_discount").cast("decimal(4,2)")))
        .alias("revenue"))


def delivered_lines(t: Tables) -> DataFrame:
    """``order_lines`` of delivered orders.

    A left-semi join: the order side contributes only its key, and the join
    keeps each line at most once whatever the order side holds.
    """
    return order_lines(t).join(delivered_orders(t).select("order_id"), "order_id", "left_semi")


def platform_of(props: str = "props"):
    """Platform of an event: props.k mod 3 → iOS / Android / Web; NULL when k is
    missing or not an integer. (A CASE chain rather than ``element_at`` on a
    literal array, which does not return NULL for a NULL index on Spark 4.1.)"""
    m = F.pmod(F.get_json_object(props, "$.k").try_cast("int"), F.lit(len(PLATFORMS)))
    expr = None
    for i, name in enumerate(PLATFORMS):
        expr = F.when(m == i, name) if expr is None else expr.when(m == i, name)
    return expr


def app_events(t: Tables) -> DataFrame:
    """All events with funnel columns: event_name, platform, day."""
    return t.events.select(
        "event_id", "user_id", F.col("event_type").alias("event_name"),
        F.col("ts").alias("event_time"), F.to_date("ts").alias("day"),
        platform_of().alias("platform"),
    )
