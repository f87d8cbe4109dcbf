"""Canonical views over tables already in the analytic model's own schema.

For users whose data has the shape the operators were designed for:

* users(user_id, name, city, signup_date, signup_platform)
* orders(order_id, user_id, restaurant_id, order_date, order_status,
  order_amount, delivery_time_min, payment_method) with status
  'delivered' / 'cancelled'
* restaurants(restaurant_id, name, city, cuisine, rating, is_active)
* app_events(event_id, user_id, event_name, event_time, platform)

Dates may be DATE, TIMESTAMP or 'YYYY-MM-DD' strings. Differences from the
fixture binding: the cohort base is the users table (users without any
order keep their cohort, with no retention), a restaurant's revenue is the
delivered order amount, the funnel entity is the user, and the funnel steps
and delivery-time buckets are ``MODEL_FUNNEL_STEPS`` / ``DELIVERY_TIME_*``.

    m = ModelViews(spark.table("users"), spark.table("orders"),
                   spark.table("restaurants"), spark.table("app_events"))
    funnel.funnel_steps(m.events, MODEL_FUNNEL_STEPS, entity=m.entity)
    retention.cohort_retention(m.activity)
    outcome.first_event_outcome(m.orders, DELIVERY_TIME_SPLITS, DELIVERY_TIME_LABELS,
                                value_col="delivery_time_min")
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from growthlens.fixed_values import (DELIVERED, DELIVERY_TIME_LABELS,  # noqa: F401
                                     DELIVERY_TIME_SPLITS, MODEL_FUNNEL_STEPS)
from growthlens.functions.exprs import money
from growthlens.sources.views import activity_from_orders


class ModelViews:
    entity = ("user_id",)

    def __init__(self, users: DataFrame, orders: DataFrame, restaurants: DataFrame | None = None,
                 app_events: DataFrame | None = None):
        self._users, self._orders = users, orders
        self._restaurants, self._events = restaurants, app_events

    @property
    def orders(self) -> DataFrame:
        o = self._orders
        date = F.to_date("order_date")
        return o.select(
            "order_id", "user_id", "restaurant_id", "order_status",
            (F.col("order_status") == DELIVERED).alias("is_delivered"),
            date.cast("timestamp_ntz").alias("order_ts"), date.alias("order_date"),
            F.col("order_amount").cast("double").alias("order_amount"),
            "delivery_time_min", "payment_method")

    @property
    def user_city(self) -> DataFrame:
        return self._users.select("user_id", "name", "city")

    @property
    def activity(self) -> DataFrame:
        """Every user with their own signup_date; order figures from orders
        (left join: users without orders have zero counts and no months)."""
        per_user = activity_from_orders(self.orders).drop("signup_date")
        users = self._users.select("user_id", F.to_date("signup_date").alias("signup_date"))
        joined = users.join(per_user, "user_id", "left")
        return joined.select(
            "user_id", "signup_date",
            F.coalesce("n_orders", F.lit(0)).alias("n_orders"),
            F.coalesce("n_delivered", F.lit(0)).alias("n_delivered"),
            F.coalesce("delivered_months", F.array().cast("array<date>")).alias("delivered_months"))

    @property
    def restaurants(self) -> DataFrame:
        return self._restaurants.select("restaurant_id", "name", "city", "cuisine", "rating")

    @property
    def lines(self) -> DataFrame:
        """(order_id, restaurant_id, revenue): one row per delivered order."""
        return (self.orders.where(F.col("is_delivered"))
                .select("order_id", "restaurant_id", money("order_amount").alias("revenue")))

    @property
    def events(self) -> DataFrame:
        e = self._events
        return e.select("event_id", "user_id", "event_name", F.col("event_time").cast("timestamp_ntz")
                        .alias("event_time"), F.to_date("event_time").alias("day"), "platform")
