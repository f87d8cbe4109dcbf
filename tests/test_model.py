"""The operators on tables in the analytic model's own schema."""

import pytest

from growthlens.fixed_values import (DELIVERY_TIME_LABELS, DELIVERY_TIME_SPLITS,
                                     MODEL_FUNNEL_STEPS)
from growthlens.operators import funnel, outcome, retention, revenue
from growthlens.sources.model import ModelViews


@pytest.fixture(scope="module")
def model(spark):
    users = spark.createDataFrame([
        (1, "a", "Pune", "2024-01-05", "iOS"), (2, "b", "Pune", "2024-01-20", "Web"),
        (3, "c", "Delhi", "2024-02-02", "Android"), (4, "d", "Delhi", "2024-02-10", "iOS"),
    ], "user_id long, name string, city string, signup_date string, signup_platform string")
    orders = spark.createDataFrame([
        (1, 1, 10, "2024-02-03", "delivered", 300.0, 25, "UPI"),
        (2, 1, 11, "2024-03-09", "delivered", 200.0, 50, "Card"),
        (3, 2, 10, "2024-02-14", "cancelled", 150.0, 40, "UPI"),
        (4, 3, 11, "2024-02-05", "delivered", 500.0, 70, "UPI"),
        (5, 3, 11, "2024-02-05", "delivered", 120.0, 20, "UPI"),
    ], "order_id long, user_id long, restaurant_id long, order_date string, order_status string, "
       "order_amount double, delivery_time_min int, payment_method string")
    restaurants = spark.createDataFrame([(10, "R10", "Pune", "Thai", 4.1, 1), (11, "R11", "Delhi", "Pizza", 3.9, 1)],
                                        "restaurant_id long, name string, city string, cuisine string, "
                                        "rating double, is_active int")
    events = spark.createDataFrame([
        (1, 1, "app_open", "2024-01-05 10:00:00", "iOS"), (2, 1, "search", "2024-01-05 10:01:00", "iOS"),
        (3, 1, "app_open", "2024-01-06 10:00:00", "iOS"), (4, 2, "app_open", "2024-01-21 09:00:00", "Web"),
        (5, 1, "order_placed", "2024-01-06 10:05:00", "iOS"),
    ], "event_id long, user_id long, event_name string, event_time string, platform string")
    return ModelViews(users, orders, restaurants, events)


def test_cohorts_keep_users_without_orders(model):
    got = {r.cohort_month: r for r in retention.cohort_retention(model.activity).collect()}
    assert got["2024-01"].cohort_size == 2 and got["2024-01"].retained_m1 == 1
    assert got["2024-01"].retained_m2 == 1            # user 1 ordered again in March
    assert got["2024-02"].cohort_size == 2            # user 4 never ordered
    assert got["2024-02"].retained_m1 == 0


def test_user_grain_funnel_on_model_steps(model):
    rows = {r.event_name: r for r in funnel.funnel_steps(model.events, MODEL_FUNNEL_STEPS,
                                                         entity=model.entity).collect()}
    assert rows["app_open"].users == 2                 # distinct users, not user-days
    assert rows["search"].users == 1 and rows["order_placed"].prev_step_users == 1


def test_delivery_time_buckets(model):
    got = {r.first_order_bucket: r for r in outcome.first_event_outcome(
        model.orders, DELIVERY_TIME_SPLITS, DELIVERY_TIME_LABELS, value_col="delivery_time_min").collect()}
    # user 1: first order 25 min; user 3: two orders on one day, the lower
    # order_id (order 4, 70 min) is the first one
    assert (got["1: <30 min"].users, got["1: <30 min"].reordered) == (1, 1)
    assert (got["4: 60+ min"].users, got["4: 60+ min"].reordered) == (1, 1)
    assert set(got) == {"1: <30 min", "4: 60+ min"}


def test_restaurant_revenue_and_user_city_cancellations(model):
    top = {r.city: (r.name, r.revenue) for r in revenue.top_n_per_group(model.lines, model.restaurants, 1).collect()}
    assert top == {"Pune": ("R10", 300.0), "Delhi": ("R11", 820.0)}
    canc = {r.city: (r.total_orders, r.cancelled_orders) for r in
            revenue.cancellation_by_city(model.orders, model.user_city).collect()}
    assert canc == {"Pune": (3, 1), "Delhi": (2, 0)}


def test_published_funnel_figures(spark):
    """Users reaching each step as in the write-up (prefix sessions): step
    conversion, overall conversion and the worst step match it."""
    depth_counts = [1809, 1739, 1570, 1282, 862, 472]
    rows, eid = [], 0
    for uid in range(1, depth_counts[0] + 1):
        depth = sum(1 for c in depth_counts if uid <= c)
        for step in MODEL_FUNNEL_STEPS[:depth]:
            eid += 1
            rows.append((eid, uid, step, "2024-03-01 10:00:00", "iOS"))
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_name string, "
                                         "event_time string, platform string")
    m = ModelViews(None, None, None, events)
    steps = {r.event_name: r for r in funnel.funnel_steps(m.events, MODEL_FUNNEL_STEPS, m.entity).collect()}
    assert [steps[s].users for s in MODEL_FUNNEL_STEPS] == depth_counts
    assert [round(steps[s].step_conv_pct, 1) for s in MODEL_FUNNEL_STEPS[1:]] == [96.1, 90.3, 81.7, 67.2, 54.8]
    overall = funnel.funnel_overall(m.events, MODEL_FUNNEL_STEPS, m.entity).collect()[0]
    assert round(overall.open_to_order_pct, 1) == 26.1
    drops = funnel.funnel_zero_filled(m.events, MODEL_FUNNEL_STEPS, m.entity).collect()
    assert [r.event_name for r in drops if r.is_biggest_drop] == ["order_placed"]
    base = funnel.step_pair_baseline(m.events, "checkout", "order_placed", m.entity).collect()[0]
    assert (base.from_step_users, base.to_step_users, base.baseline_conversion_pct) == (862, 472, 54.76)


def test_signup_after_data_end_does_not_fail(spark):
    users = spark.createDataFrame([(1, "a", "Pune", "2024-01-05", "iOS"), (2, "b", "Pune", "2024-03-10", "Web"),
                                   (3, "c", "Pune", "2024-03-11", "Web")],
                                  "user_id long, name string, city string, signup_date string, "
                                  "signup_platform string")
    orders = spark.createDataFrame([(1, 1, 10, "2024-03-10", "delivered", 300.0, 25, "UPI")],
                                   "order_id long, user_id long, restaurant_id long, order_date string, "
                                   "order_status string, order_amount double, delivery_time_min int, "
                                   "payment_method string")
    m = ModelViews(users, orders)
    got = {r.cohort_month: r for r in retention.exposure_baseline(m.activity, m.orders).collect()}
    # user 3 signed up a day after the data end (window 0 days): no error, no hit
    assert got["2024-03"].cohort_size == 2
    assert got["2024-03"].expected_if_no_retention_pct == 0.0
