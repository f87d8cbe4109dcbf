"""Hand-made frames for the semantic gaps: users without orders, only-cancelled
users, same-day orders, December signups, unknown events, missing steps,
entities on two platforms, empty steps."""

import math

from pyspark.sql import functions as F

from growthlens.functions.scope import Scope
from growthlens.operators import funnel, outcome, retention, revenue
from growthlens.sources.views import activity_from_orders

from frames import events_frame, orders_frame, user_city_frame

ORDERS = [
    # user 1: signup Jan, delivered in Feb and Apr
    (1, 1, "delivered", "2024-01-10", 100, "UPI"),
    (2, 1, "delivered", "2024-02-03", 200, "UPI"),
    (3, 1, "delivered", "2024-04-20", 300, "Card"),
    # user 2: only cancelled orders (in the cohort, never retained)
    (4, 2, "cancelled", "2024-01-15", 50, "UPI"),
    # user 3: two orders on the same day; the lower order_id is the first
    (6, 3, "delivered", "2024-03-05", 900, "Card"),
    (5, 3, "delivered", "2024-03-05", 10, "Card"),
    # user 4: December signup, nothing of month+1 is observable
    (7, 4, "delivered", "2024-12-20", 500, "UPI"),
]


def test_cohort_retention_left_join_semantics(spark):
    act = activity_from_orders(orders_frame(spark, ORDERS))
    rows = {r.cohort_month: r for r in retention.cohort_retention(act).collect()}
    jan = rows["2024-01"]
    assert jan.cohort_size == 2                 # the only-cancelled user counts
    assert (jan.retained_m1, jan.retained_m2, jan.retained_m3) == (1, 0, 1)
    assert jan.retention_m1_pct == 50.0
    assert rows["2024-03"].retained_m1 == 0


def test_observable_mask_is_null_not_zero(spark):
    orders = orders_frame(spark, ORDERS)
    act = activity_from_orders(orders)
    got = {(r.cohort_month, r.horizon): r.retention_pct
           for r in retention.cohort_retention_observable(act, orders).collect()}
    assert got[("2024-12", 1)] is None          # after the last data month
    assert got[("2024-01", 2)] == 0.0           # observable and truly zero


def test_exposure_december_signup_has_zero_m1_days(spark):
    orders = orders_frame(spark, ORDERS)
    pu = {r.user_id: r for r in retention.exposure_per_user(activity_from_orders(orders), orders).collect()}
    assert pu[4].window_days == 1 and pu[4].m1_days == 0
    # user 1: signup 2024-01-10, data end 2024-12-20 -> 346 days; February has 29 days
    assert pu[1].window_days == 346 and pu[1].m1_days == 29
    assert pu[2].n_delivered == 0


def test_exposure_expected_formula(spark):
    orders = orders_frame(spark, ORDERS)
    base = {r.cohort_month: r for r in
            retention.exposure_baseline(activity_from_orders(orders), orders).collect()}
    p_user1 = 1 - (1 - 29 / 346) ** 3
    assert base["2024-01"].expected_if_no_retention_pct == round(100 * p_user1 / 2, 1)
    assert base["2024-12"].expected_if_no_retention_pct == 0.0


def test_first_event_tie_breaks_on_order_id(spark):
    got = {r.user_id: r for r in outcome.first_event_per_user(orders_frame(spark, ORDERS)).collect()}
    assert got[3].first_value == 10.0 and got[3].n_delivered == 2
    assert 2 not in got                          # no delivered order at all


def test_first_event_outcome_buckets(spark):
    res = {r.first_order_bucket: r for r in outcome.first_event_outcome(
        orders_frame(spark, ORDERS), splits=(150.0, 600.0), labels=("lo", "mid", "hi")).collect()}
    assert res["lo"].users == 2 and res["lo"].reordered == 2      # users 1 (100) and 3 (10)
    assert res["mid"].users == 1 and res["mid"].did_not_reorder == 1  # user 4 (500)
    assert "hi" not in res


def test_cancellation_and_scope(spark):
    orders = orders_frame(spark, ORDERS)
    cities = user_city_frame(spark, [(1, "a", "X"), (2, "b", "Y"), (3, "c", "X"), (4, "d", "Y")])
    by_city = {r.city: r for r in revenue.cancellation_by_city(orders, cities).collect()}
    assert by_city["Y"].total_orders == 2 and by_city["Y"].cancelled_orders == 1
    assert by_city["Y"].revenue_at_risk == 50.0
    scoped = revenue.cancellation_filtered(
        orders, cities, Scope(month_start="2024-01", month_end="2024-02", payments=("UPI",)))
    got = {(r.dimension, r.value): r for r in scoped.collect()}
    assert got[("payment_method", "UPI")].delivered == 2
    assert got[("payment_method", "UPI")].cancelled == 1
    assert ("payment_method", "Card") not in got


def test_kpi_empty_scope_reads_zero(spark):
    orders = orders_frame(spark, ORDERS)
    cities = user_city_frame(spark, [(1, "a", "X"), (2, "b", "Y"), (3, "c", "X"), (4, "d", "Y")])
    ev = events_frame(spark, [(1, "view", "2024-01-01 10:00:00", "iOS")])
    r = revenue.kpi_overview(orders, cities, ev, Scope(cities=("Nowhere",))).collect()[0]
    assert (r.gmv, r.delivered_orders, r.revenue_at_risk) == (0.0, 0, 0.0)
    assert r.gmv_share_pct == 0.0 and r.full_conversion_pct == 0.0


EVENTS = [
    (1, "view", "2024-01-01 10:00:00", "iOS"),
    (1, "click", "2024-01-01 10:01:00", "iOS"),
    (1, "purchase", "2024-01-01 09:59:00", "Android"),   # same user-day on a second platform
    (2, "view", "2024-01-01 11:00:00", "Web"),
    (2, "mystery", "2024-01-01 11:02:00", "Web"),        # unknown event name
    (2, "view", "2024-01-02 11:00:00", "Web"),           # second user-day
    (3, "click", "2024-01-03 12:00:00", "Web"),          # no first step at all
]


def test_funnel_steps_skip_unknown_and_absent(spark):
    rows = {r.event_name: r for r in funnel.funnel_steps(events_frame(spark, EVENTS)).collect()}
    assert set(rows) == {"view", "click", "purchase"}    # 'signup' absent, 'mystery' dropped
    assert rows["view"].users == 3 and rows["view"].prev_step_users is None
    assert rows["click"].users == 2 and rows["click"].step_conv_pct == round(100 * 2 / 3, 2)
    assert rows["purchase"].prev_step_users == 2         # LAG = previous present step


def test_funnel_zero_fill_and_biggest_drop(spark):
    rows = {r.event_name: r for r in funnel.funnel_zero_filled(events_frame(spark, EVENTS)).collect()}
    assert rows["signup"].users == 0 and rows["signup"].drop_pct == 100.0
    assert rows["purchase"].drop_pct == -math.inf        # 0 -> 1 is an infinite gain
    assert [n for n, r in rows.items() if r.is_biggest_drop] == ["signup"]
    assert rows["view"].drop_pct == 0.0


def test_funnel_zero_first_step(spark):
    ev = events_frame(spark, [(1, "click", "2024-01-01 10:00:00", "iOS")])
    rows = {r.event_name: r for r in funnel.funnel_zero_filled(ev).collect()}
    assert rows["view"].users == 0 and rows["click"].drop_pct == -math.inf
    assert rows["signup"].is_biggest_drop                # click 1 -> signup 0 loses 100 %


def test_entity_on_two_platforms_counts_in_both(spark):
    ends = {r.platform: r for r in funnel.funnel_ends(events_frame(spark, EVENTS), by=("platform",)).collect()}
    assert ends["iOS"].opened == 1 and ends["iOS"].ordered == 0
    assert ends["Android"].opened == 0 and ends["Android"].ordered == 1
    assert ends["Android"].open_to_order_pct is None     # 0 opened -> no rate


def test_conversion_contingency_never_negative(spark):
    ev = events_frame(spark, [(1, "purchase", "2024-01-01 10:00:00", "iOS"),
                              (2, "purchase", "2024-01-01 10:00:00", "iOS"),
                              (3, "view", "2024-01-01 10:00:00", "iOS")])
    r = funnel.conversion_contingency(ev).collect()[0]
    assert (r.converted, r.not_converted) == (0, 1)


def test_ab_arms_are_deterministic_and_complete(spark):
    rows = [(u, "signup", f"2024-01-{d:02d} 10:00:00", "iOS") for u in range(1, 40) for d in (1, 2)]
    rows += [(u, "purchase", "2024-01-01 11:00:00", "iOS") for u in range(1, 40, 3)]
    ev = events_frame(spark, rows)
    a = {r.arm: r for r in funnel.ab_arms(ev).collect()}
    b = {r.arm: r for r in funnel.ab_arms(ev).collect()}
    assert a == b
    assert sum(r.users for r in a.values()) == 78
    assert sum(r.converted for r in a.values()) == 13


def test_step_pair_baseline_user_grain(spark):
    r = funnel.step_pair_baseline(events_frame(spark, EVENTS), "view", "click", entity=("user_id",)).collect()[0]
    assert (r.from_step_users, r.to_step_users, r.baseline_conversion_pct) == (2, 2, 100.0)


def test_top_n_keeps_dense_rank_ties(spark):
    lines = spark.createDataFrame([(1, 1, 10.0), (2, 2, 10.0), (3, 3, 5.0), (4, 4, 1.0)],
                                  "order_id long, restaurant_id long, revenue double")
    rest = spark.createDataFrame([(i, f"r{i}", "C", "x", 1.0) for i in range(1, 5)],
                                 "restaurant_id long, name string, city string, cuisine string, rating double")
    got = revenue.top_n_per_group(lines, rest, 2).collect()
    assert sorted((r.name, r.city_rank) for r in got) == [("r1", 1), ("r2", 1), ("r3", 2)]
    top = revenue.group_top_share(lines, rest).collect()[0]
    assert top.top_restaurant == "r1" and top.top_share_pct == round(100 * 10 / 26, 2)
    shares = {r.name: r.share_pct for r in revenue.group_share(lines, rest).collect()}
    assert shares == {f"r{i}": round(100 * v / 26, 2) for i, v in ((1, 10), (2, 10), (3, 5), (4, 1))}
    top1 = revenue.top_k_in_group(lines, rest, "C", 1).collect()
    assert [r.name for r in top1] == ["r1"]


def test_top_k_in_group_counts_delivered_orders_only(spark):
    lines = spark.createDataFrame([(1, 1, 10.0), (2, 1, 5.0), (2, 2, 30.0), (3, 3, 7.0), (4, 4, 99.0)],
                                  "order_id long, restaurant_id long, revenue double")
    rest = spark.createDataFrame([(1, "r1", "C", "x", 1.0), (2, "r2", "C", "x", 2.0),
                                  (3, "r3", "C", "y", 3.0), (4, "r4", "D", "y", 4.0)],
                                 "restaurant_id long, name string, city string, cuisine string, rating double")
    every = [tuple(r) for r in revenue.top_k_in_group(lines, rest, "C", 2).collect()]
    assert every == [("r2", "x", 2.0, 1, 30.0), ("r1", "x", 1.0, 2, 15.0)]
    delivered = spark.createDataFrame([(1,), (3,), (4,)], "order_id long")
    some = [tuple(r) for r in revenue.top_k_in_group(lines, rest, "C", 2, delivered).collect()]
    assert some == [("r1", "x", 1.0, 1, 10.0), ("r3", "y", 3.0, 1, 7.0)]


def test_dataset_diff_counts_copies(spark):
    from growthlens.operators import setops

    a = spark.createDataFrame([(1, "x")] * 5 + [(2, "y"), (None, "n"), (3, "z")], "k long, v string")
    b = spark.createDataFrame([("x", 1)] * 2 + [("y", 2)] * 4 + [("z", 3)], "v string, k long")
    got = {(r.k, r.v, r.side, r.copies) for r in setops.dataset_diff(a, b).collect()}
    assert got == {(1, "x", "only_in_a", 3), (2, "y", "only_in_b", 3), (None, "n", "only_in_a", 1)}
    assert setops.dataset_diff(a, a).count() == 0
    # A row that makes up most of the data is counted, never made again.
    hot = spark.range(200_000, numPartitions=8).selectExpr("IF(id % 10 = 0, id, 7) AS k", "'h' AS v")
    plan = setops.dataset_diff(hot, a)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Generate" not in plan
    assert {(r.k, r.copies) for r in setops.dataset_diff(hot, a).where("k = 7").collect()} == {(7, 180_000)}


def test_pct_rounds_half_up_and_is_null_on_zero(spark):
    from growthlens.functions.exprs import pct
    r = spark.range(1).select(pct(F.lit(1), F.lit(800), 2).alias("a"),     # 0.125 -> 0.13
                              pct(F.lit(1), F.lit(0), 2).alias("b"),       # no ANSI error
                              pct(F.lit(2), F.lit(3), None).alias("c")).collect()[0]
    assert r.a == 0.13 and r.b is None and abs(r.c - 200 / 3) < 1e-12


def test_results_do_not_depend_on_session_time_zone(spark):
    from growthlens.plans.registry import QUERIES
    from conftest import SF_SMALL
    names = ("cohort_retention", "exposure_baseline", "gmv_monthly_filtered", "funnel_steps")
    base = {n: sorted(map(tuple, QUERIES[n](spark, SF_SMALL).collect())) for n in names}
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        for tz in ("Asia/Kolkata", "America/Los_Angeles"):
            spark.conf.set("spark.sql.session.timeZone", tz)
            for n in names:
                assert sorted(map(tuple, QUERIES[n](spark, SF_SMALL).collect())) == base[n], (tz, n)
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_platform_is_null_without_an_integer_k(spark):
    from growthlens.sources.views import platform_of
    df = spark.createDataFrame([(1, '{"k": 4}'), (2, '{"k": "x"}'), (3, '{}'), (4, '{"k": -1}')],
                               "user_id long, props string")
    got = {r.user_id: r.platform for r in df.select("user_id", platform_of().alias("platform")).collect()}
    assert got == {1: "Android", 2: None, 3: None, 4: "Web"}


def test_order_key_preserves_date_then_id_order(spark):
    from growthlens.operators.outcome import order_key
    rows = [("1969-12-31", 5), ("1970-01-01", -9223372036854775808), ("1970-01-01", -1),
            ("1970-01-01", 0), ("1970-01-01", 9223372036854775807), ("2024-02-29", 1), ("9999-12-31", 0)]
    df = spark.createDataFrame([(d, i, n) for n, (d, i) in enumerate(rows)], "d string, i long, n int")
    got = [r.n for r in df.select("n", order_key(F.to_date("d"), "i").alias("k")).orderBy("k").collect()]
    assert got == list(range(len(rows)))


def test_scope_rejects_malformed_filters():
    import pytest
    from growthlens.functions.scope import Scope
    for bad in (dict(month_start="2024-3"), dict(month_end="2024-13"), dict(month_start="2024-05", month_end="2024-04"),
                dict(cities="Pune")):
        with pytest.raises(ValueError):
            Scope(**bad)
    assert Scope(month_start="2024-01", month_end="2024-12", cities=("Pune",)).cities == ("Pune",)


def test_custom_retention_horizons(spark):
    act = activity_from_orders(orders_frame(spark, ORDERS))
    got = {r.cohort_month: r for r in retention.cohort_retention(act, horizons=(1, 3, 11)).collect()}
    jan = got["2024-01"]
    assert (jan.retained_m1, jan.retained_m3, jan.retained_m11) == (1, 1, 0)
    assert "retention_m11_pct" in jan.asDict()


def test_anti_join_with_a_hot_key(spark):
    from growthlens.operators.setops import entities_without_activity
    entities = spark.createDataFrame([(i, f"u{i}") for i in range(1, 6)], "user_id long, name string")
    activity = spark.createDataFrame([(1,)] * 5000 + [(3,)], "user_id long")   # user 1 is hot
    got = sorted(r.user_id for r in entities_without_activity(entities, activity, "user_id").collect())
    assert got == [2, 4, 5]


def test_tables_need_a_root_or_a_database(spark):
    import pytest
    from growthlens.sources.tables import Tables
    with pytest.raises(ValueError):
        Tables(spark)
