"""Metamorphic and calibration checks."""

import numpy as np

from growthlens.operators import retention, testing
from growthlens.sources import views
from growthlens.sources.tables import Tables

from conftest import SF_GATE


def test_flag_form_equals_count_distinct_form(spark):
    """Per-user flags + sums == COUNT(DISTINCT CASE ...) over users LEFT JOIN orders."""
    t = Tables(spark, SF_GATE)
    ours = retention.cohort_retention(views.user_activity(t))
    distinct_form = spark.sql("""
        SELECT date_format(u.signup_date, 'yyyy-MM') AS cohort_month,
               COUNT(DISTINCT u.user_id) AS cohort_size,
               COUNT(DISTINCT CASE WHEN trunc(d.order_date, 'MM') = add_months(trunc(u.signup_date, 'MM'), 1)
                                   THEN d.user_id END) AS retained_m1,
               COUNT(DISTINCT CASE WHEN trunc(d.order_date, 'MM') = add_months(trunc(u.signup_date, 'MM'), 2)
                                   THEN d.user_id END) AS retained_m2,
               COUNT(DISTINCT CASE WHEN trunc(d.order_date, 'MM') = add_months(trunc(u.signup_date, 'MM'), 3)
                                   THEN d.user_id END) AS retained_m3
        FROM {users} u LEFT JOIN {orders} d ON d.user_id = u.user_id AND d.is_delivered
        GROUP BY 1""", users=views.user_activity(t), orders=views.orders(t))
    cols = ["cohort_month", "cohort_size", "retained_m1", "retained_m2", "retained_m3"]
    assert sorted(map(tuple, ours.select(*cols).collect())) == sorted(map(tuple, distinct_form.collect()))


def test_chi_square_is_calibrated_under_the_null(spark):
    """400 independent tables drawn under independence, tested in one plan:
    the share with p < 0.05 is about 5 % (binomial 4-sigma band)."""
    rng = np.random.default_rng(42)
    rows = []
    for test in range(400):
        for label in range(4):
            n = int(rng.integers(200, 400))
            a = int(rng.binomial(n, 0.3))
            rows.append((f"t{test}", f"g{label}", a, n - a))
    tables = spark.createDataFrame(rows, "test_id string, label string, a long, b long")
    p = np.array([r.p_value for r in testing.chi_square(tables).collect()])
    assert len(p) == 400
    rate = (p < 0.05).mean()
    assert abs(rate - 0.05) < 4 * np.sqrt(0.05 * 0.95 / 400)
    # and p is roughly uniform: each quartile holds about a quarter
    counts = np.histogram(p, bins=4, range=(0, 1))[0]
    assert all(abs(c - 100) < 40 for c in counts)
