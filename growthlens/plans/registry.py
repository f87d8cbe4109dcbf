"""Named query plans: every operator bound to the fixture tables with the
parameters the checks use. Each entry is ``(spark, sf_dir) -> DataFrame``.

The same names appear in ``growthlens.plans.oracle`` with an independent
DuckDB SQL formulation of the same question.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from growthlens.functions.scope import Scope, filter_scope
from growthlens.operators import funnel, outcome, ranking, retention, revenue, setops, testing
from growthlens.sources import adhoc, catalog, sinks, views
from growthlens.sources.tables import FIXTURE_TABLES, Tables

# Parameters of the registered instances (fixed, shared with the oracle).
SCOPE = Scope(
    month_start="1996-03", month_end="2000-06",
    cities=("NATION_1", "NATION_3", "NATION_5", "NATION_7", "NATION_11", "NATION_19"),
    payments=("1-URGENT", "2-HIGH", "5-LOW"),
    platforms=("iOS", "Web"),
)
MONTHS_ONLY = Scope(month_start="1997-01", month_end="1999-12")
FUNNEL_PLATFORMS = ("iOS", "Web")
DRILL_CITY = "NATION_9"
TWO_PAYMENTS = ("1-URGENT", "5-LOW")
FROM_STEP, TO_STEP = "signup", "purchase"
CORRELATION_RANGE = ("1995-01", "1997-12")
# How much buyers of a city spend, and how many of them came back.
BUYERS_SQL = """
WITH spend AS (
  SELECT user_id, count(*) AS n, sum(CAST(order_amount AS DECIMAL(18,2))) AS paid
  FROM {orders} WHERE order_status = :status GROUP BY user_id)
SELECT city, count(*) AS buyers, sum(n) AS orders,
       round(CAST(sum(paid) AS DOUBLE) / count(*), 2) AS spend_per_buyer,
       round(100.0D * count_if(n > 1) / count(*), 2) AS repeat_buyer_pct
FROM spend JOIN {users} USING (user_id)
GROUP BY city"""

# What each chosen payment method brought in.
PAYMENTS_SQL = """
SELECT payment_method, count(*) AS orders, count(DISTINCT user_id) AS buyers,
       CAST(sum(CAST(order_amount AS DECIMAL(18,2))) AS DOUBLE) AS paid
FROM {orders} WHERE payment_method IN (:payments) AND order_status = :status
GROUP BY payment_method"""
PAGE_SQL = """
SELECT order_id, user_id, payment_method, order_amount
FROM {orders} WHERE payment_method IN (:payments) AND order_amount >= :least"""


class Ctx:
    """Canonical views over one fixture directory (built lazily, once)."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.t = Tables(spark, sf_dir)
        self._memo: dict[str, DataFrame] = {}

    def _get(self, name, fn):
        if name not in self._memo:
            self._memo[name] = fn(self.t)
        return self._memo[name]

    @property
    def orders(self):
        return self._get("orders", views.orders)

    @property
    def user_city(self):
        return self._get("user_city", views.user_city)

    @property
    def activity(self):
        return self._get("activity", views.all_activity)

    @property
    def restaurants(self):
        return self._get("restaurants", views.restaurants)

    @property
    def lines(self):
        return self._get("lines", views.delivered_lines)

    @property
    def events(self):
        return self._get("events", views.app_events)


def _q(fn: Callable[[Ctx], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(Ctx(spark, sf_dir))
    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    return run


def _contingency_tables(c: Ctx) -> DataFrame:
    orders_side = testing.order_contingencies(c.orders, c.user_city)
    plat = testing.tag(testing.contingency_from(
        funnel.conversion_contingency(c.events, ordered=False), "platform", "converted",
        "not_converted"), "platform")
    first = testing.tag(testing.contingency_from(
        outcome.first_event_outcome(c.orders, ordered=False), "first_order_bucket", "reordered",
        "did_not_reorder"), "first_order_bucket")
    return orders_side.unionByName(plat).unionByName(first)


def _sql_buyers_by_city(c: Ctx) -> DataFrame:
    """An ad-hoc question through spark.sql with a bound status: all rows."""
    frames = adhoc.canonical_frames(c.t)
    return adhoc.run_sql(c.t.spark, BUYERS_SQL, {"status": "delivered"},
                         {"orders": frames["orders"], "users": frames["users"]})


def _sql_payment_totals(c: Ctx) -> DataFrame:
    """An ad-hoc question with a bound list of values."""
    return adhoc.run_sql(c.t.spark, PAYMENTS_SQL, {"payments": list(SCOPE.payments), "status": "delivered"},
                         {"orders": views.orders(c.t)})


def _page_of_orders(c: Ctx) -> DataFrame:
    """The first page of an ad-hoc listing; the cap is the feature."""
    rows = adhoc.run_sql(c.t.spark, PAGE_SQL, {"payments": TWO_PAYMENTS, "least": 1000.0}, {"orders": views.orders(c.t)})
    return adhoc.capped(rows, [F.desc("order_amount"), F.asc("order_id")])


def _counts(c: Ctx) -> DataFrame:
    if c.t.database:
        return catalog.table_row_counts({name: c.t.table(name) for name in FIXTURE_TABLES})
    return catalog.table_row_counts_of_files(c.t.spark, {name: c.t.path(name) for name in FIXTURE_TABLES})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    # funnels
    "funnel_steps": _q(lambda c: funnel.funnel_steps(c.events)),
    "funnel_steps_user_grain": _q(lambda c: funnel.funnel_steps(c.events, entity=("user_id",))),
    "funnel_overall": _q(lambda c: funnel.funnel_overall(c.events)),
    "funnel_steps_by_platform": _q(lambda c: funnel.funnel_steps(c.events, by=("platform",))),
    "funnel_ends_by_platform": _q(lambda c: funnel.funnel_ends(c.events, by=("platform",))),
    "funnel_zero_filled": _q(lambda c: funnel.funnel_zero_filled(c.events, platforms=FUNNEL_PLATFORMS)),
    "step_pair_baseline": _q(lambda c: funnel.step_pair_baseline(c.events, FROM_STEP, TO_STEP)),
    # retention
    "cohort_retention": _q(lambda c: retention.cohort_retention(c.activity)),
    "cohort_retention_observable": _q(
        lambda c: retention.cohort_retention_observable(c.activity)),
    "exposure_baseline": _q(lambda c: retention.exposure_baseline(c.activity)),
    "exposure_gap": _q(lambda c: retention.exposure_gap(
        retention.exposure_baseline(c.activity))),
    "exposure_correlation": _q(lambda c: retention.exposure_correlation(
        retention.exposure_baseline(c.activity))),
    "exposure_correlation_range": _q(lambda c: retention.exposure_correlation(
        retention.exposure_baseline(c.activity), *CORRELATION_RANGE)),
    # GMV
    "gmv_mom": _q(lambda c: revenue.gmv_mom(c.orders)),
    "gmv_mom_written": _q(lambda c: sinks.written_and_read(revenue.gmv_mom(c.orders), "monthly")),
    "gmv_monthly_filtered": _q(lambda c: revenue.gmv_monthly_filtered(c.orders, c.user_city, SCOPE)),
    "city_leaderboard": _q(lambda c: revenue.city_leaderboard(c.orders, c.user_city, MONTHS_ONLY)),
    "top_n_per_group": _q(lambda c: revenue.top_n_per_group(c.lines, c.restaurants)),
    "top_k_in_group": _q(lambda c: revenue.top_k_in_group(
        views.order_lines(c.t), c.restaurants, DRILL_CITY,
        delivered=views.delivered_orders(c.t).select("order_id"))),
    "group_share": _q(lambda c: revenue.group_share(c.lines, c.restaurants)),
    "group_top_share": _q(lambda c: revenue.group_top_share(c.lines, c.restaurants)),
    # concentration
    "power_users": _q(lambda c: ranking.power_users(c.orders)),
    "pareto_split": _q(lambda c: ranking.pareto_split(c.orders)),
    "concentration_ratio": _q(lambda c: ranking.concentration_ratio(c.orders)),
    "gmv_by_tile": _q(lambda c: ranking.gmv_by_tile(c.orders)),
    # cancellations
    "cancellation_by_city": _q(lambda c: revenue.cancellation_by_city(c.orders, c.user_city)),
    "cancellation_by_payment": _q(lambda c: revenue.cancellation_by_payment(c.orders)),
    "cancellation_filtered": _q(lambda c: revenue.cancellation_filtered(c.orders, c.user_city, SCOPE)),
    "revenue_at_risk_total": _q(lambda c: revenue.revenue_at_risk_total(c.orders)),
    # first event → outcome
    "first_event_outcome": _q(lambda c: outcome.first_event_outcome(c.orders)),
    # dashboard helpers
    "kpi_overview": _q(lambda c: revenue.kpi_overview(c.orders, c.user_city, c.events, SCOPE)),
    "filter_scope": _q(lambda c: filter_scope(c.orders, c.user_city, SCOPE).select(
        "order_id", "user_id", "city", "order_date", "order_status", "order_amount",
        "payment_method")),
    "dimension_values": _q(lambda c: catalog.dimension_values(c.orders, c.user_city, c.events)),
    "avg_order_value_by_city": _q(lambda c: revenue.avg_order_value_by_city(c.orders, c.user_city)),
    # statistics
    "contingency_city": _q(lambda c: testing.contingency_by_city(c.orders, c.user_city)),
    "contingency_payment": _q(lambda c: testing.contingency_by_payment(c.orders)),
    "contingency_platform": _q(lambda c: funnel.conversion_contingency(c.events)),
    "contingency_first_order": _q(lambda c: outcome.first_event_outcome(c.orders).select(
        "first_order_bucket", "reordered", "did_not_reorder")),
    "chi_square_tests": _q(lambda c: testing.chi_square(_contingency_tables(c))),
    "chi_square_two_payments": _q(lambda c: testing.chi_square(testing.tag(
        testing.contingency_by_payment(c.orders, TWO_PAYMENTS, ordered=False), "payment_method"))),
    "chi_square_cancellation_filtered": _q(lambda c: testing.chi_square(
        revenue.cancellation_filtered(c.orders, c.user_city, SCOPE, ordered=False).select(
            F.col("dimension").alias("test_id"), F.col("value").alias("label"),
            F.col("delivered").alias("a"), F.col("cancelled").alias("b")))),
    "chi_square_city_payment": _q(lambda c: testing.chi_square_table(testing.tag(
        testing.city_payment_cells(c.orders, c.user_city), "city_payment"))),
    "multiple_comparison_verdicts": _q(
        lambda c: testing.multiple_comparison_verdicts(
            testing.chi_square_raw(_contingency_tables(c)), p="p_raw")),
    "ab_assign": _q(lambda c: funnel.ab_arms(c.events, FROM_STEP, TO_STEP)),
    "two_proportion_ztest": _q(lambda c: testing.two_proportion_ztest(
        funnel.ab_arms(c.events, FROM_STEP, TO_STEP))),
    "required_sample_size": _q(lambda c: testing.required_sample_size(
        funnel.step_pair_baseline(c.events, FROM_STEP, TO_STEP), (3.0, 6.0, 10.0), (0.8, 0.9))),
    "required_sample_size_by_platform": _q(lambda c: testing.required_sample_size(
        funnel.step_pair_baseline(c.events, FROM_STEP, TO_STEP, by=("platform",)), (6.0,), (0.8,),
        by=("platform",))),
    "sql_buyers_by_city": _q(_sql_buyers_by_city),
    "sql_payment_totals": _q(_sql_payment_totals),
    "sql_page_of_orders": _q(_page_of_orders),
    # set-style
    "users_without_delivered_order": _q(lambda c: setops.entities_without_activity(
        c.user_city, views.delivered_orders(c.t), "user_id")),
    "orders_without_lines": _q(lambda c: setops.entities_without_activity(
        c.t.orders.select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("user_id"),
                          F.col("o_orderstatus").alias("status")),
        c.t.lineitem.select(F.col("l_orderkey").alias("order_id")), "order_id")),
    "table_row_counts": _q(_counts),
    "dataset_diff": _q(lambda c: setops.dataset_diff(
        c.orders.where(F.col("is_delivered")).select("user_id", "payment_method"),
        c.orders.where(~F.col("is_delivered")).select("user_id", "payment_method"))),
    "dataset_diff_schemas": _q(lambda c: setops.dataset_diff(
        c.orders.where(F.col("is_delivered")).select("user_id", "order_id", F.col("order_amount").alias("paid")),
        c.orders.where(F.col("order_date") < F.lit("1998-01-01").cast("date")).select(
            F.col("order_id").cast("string").alias("order_id"), "payment_method", "user_id"))),
}

FLAGSHIP = "cohort_retention"
