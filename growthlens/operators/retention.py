"""Signup-cohort retention and the exposure-adjusted zero-retention baseline.

Input is ``user_activity``: one row per user with signup_date, n_delivered
and the set of months with a delivered order (bounded by the calendar span).
Every flag is then a per-row expression, and each cohort figure one grouped
sum — no fan-out join of users to orders, no COUNT(DISTINCT) expansion.
Cohort size counts users with no delivered order at all (left-join semantics).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from growthlens.fixed_values import DAYS_PER_MONTH, RETENTION_HORIZONS
from growthlens.functions.exprs import hundred, month_key, pct
from growthlens.functions.stats import with_t_two_sided


def _signup_month():
    return F.trunc("signup_date", "month")


def _retained(h: int):
    """1 when the user has a delivered order in calendar month signup + h."""
    return F.array_contains("delivered_months", F.add_months(_signup_month(), h)).cast("int")


def _one_pass(activity: DataFrame) -> bool:
    """Whether ``activity`` carries what tells the end of the data: every user
    id's ``last_order``, with the unknown ones marked."""
    return {"known", "last_order"} <= set(activity.columns)


def _known(activity: DataFrame) -> DataFrame:
    return activity.where("known") if _one_pass(activity) else activity


def _retention_sums(activity: DataFrame, horizons: Sequence[int], *carried) -> DataFrame:
    by = [month_key("signup_date").alias("cohort_month")] + (["known"] if carried else [])
    more = ["last_order"] if carried else []
    per_user = activity.select(*by, *more, *[_retained(h).alias(f"r{h}") for h in horizons])
    return per_user.groupBy("cohort_month", *by[1:]).agg(
        F.count(F.lit(1)).alias("cohort_size"),
        *[F.sum(f"r{h}").cast("long").alias(f"retained_m{h}") for h in horizons], *carried)


def _rate(h: int):
    return pct(F.col(f"retained_m{h}"), F.col("cohort_size"), 2)


def cohort_retention(activity: DataFrame, horizons: Sequence[int] = RETENTION_HORIZONS) -> DataFrame:
    """cohort_month, cohort_size, retained_m{h}..., retention_m{h}_pct..."""
    return _retention_sums(_known(activity), horizons).select(
        "cohort_month", "cohort_size", *[f"retained_m{h}" for h in horizons],
        *[_rate(h).alias(f"retention_m{h}_pct") for h in horizons]).orderBy("cohort_month")


def cohort_retention_observable(activity: DataFrame, orders: DataFrame | None = None,
                                horizons: Sequence[int] = RETENTION_HORIZONS) -> DataFrame:
    """Long form: cohort_month, horizon, retention_pct — NULL where month
    cohort + horizon lies after the last month with any order (not yet
    observable, which is different from zero retention).

    The last month travels with the cohort sums where ``activity`` covers all
    user ids (``all_activity``); else it is a scalar over ``orders``."""
    if _one_pass(activity):
        sums = _retention_sums(activity, horizons, F.max("last_order").alias("last"))
        # A row per cohort, and per month of users without one.
        wide = sums.withColumn("last_month", F.trunc(F.max("last").over(Window.partitionBy()), "month")).where("known")
    else:
        wide = _retention_sums(activity, horizons).withColumn(
            "last_month", orders.select(F.max(F.trunc("order_date", "month"))).scalar())
    cells = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), _rate(h).alias("pct")) for h in horizons]))
    long = wide.select("cohort_month", "last_month", cells.alias("c"))
    cohort_start = F.to_date(F.concat(F.col("cohort_month"), F.lit("-01")))
    observable = F.add_months(cohort_start, F.col("c.horizon")) <= F.col("last_month")
    return long.select("cohort_month", F.col("c.horizon").alias("horizon"),
                       F.when(observable, F.col("c.pct")).alias("retention_pct")
                       ).orderBy("cohort_month", "horizon")


def _exposed(df: DataFrame) -> DataFrame:
    """``df`` (signup_date, data_end, ...) plus window_days (signup → data end,
    inclusive) and m1_days (days of month+1 inside the window, ≥ 0)."""
    next_month = F.add_months(_signup_month(), 1)
    m1_end = F.least(F.last_day(next_month), F.col("data_end"))
    m1_start = F.greatest(next_month, F.col("signup_date"))
    return (df.withColumn("window_days", F.datediff("data_end", "signup_date") + 1)
            .withColumn("m1_days", F.greatest(F.lit(0), F.datediff(m1_end, m1_start) + 1)))


def exposure_per_user(activity: DataFrame, orders: DataFrame) -> DataFrame:
    """Per user: cohort_month, window_days, m1_days, n_delivered, retained_m1.
    The data end is one scalar (max order date)."""
    ended = _known(activity).withColumn("data_end", orders.select(F.max("order_date")).scalar())
    return _exposed(ended).select("user_id", month_key("signup_date").alias("cohort_month"), "window_days", "m1_days",
                                  "n_delivered", _retained(1).alias("retained_m1"))


def exposure_baseline(activity: DataFrame, orders: DataFrame | None = None) -> DataFrame:
    """Per cohort: cohort_size, avg_window_months, observed_m1_pct,
    expected_if_no_retention_pct and excess_pct_points.

    expected = mean over users of 1 - (1 - m1_days/window_days)^n_delivered:
    the month+1 retention of a population whose orders land uniformly at
    random in its observable window. Excess is computed from unrounded values.

    A user's figures depend on the signup day, the number of orders and the
    retention flag alone, so users are counted by these; the end of the data
    travels with the counts (see ``cohort_retention_observable``).
    """
    one_pass = _one_pass(activity)
    users = activity.select("signup_date", "n_delivered", _retained(1).alias("retained_m1"), *(["known", "last_order"] if one_pass else []))
    alike = ["signup_date", "n_delivered", "retained_m1"]
    counted = F.count(F.lit(1)).alias("users")
    if one_pass:
        groups = (users.groupBy(*alike, "known").agg(counted, F.max("last_order").alias("last"))
                  .withColumn("data_end", F.max("last").over(Window.partitionBy())).where("known"))
    else:
        groups = users.groupBy(*alike).agg(counted).withColumn("data_end", orders.select(F.max("order_date")).scalar())
    p_hit = F.lit(1.0) - F.pow(F.lit(1.0) - F.try_divide(F.col("m1_days"), F.col("window_days")), F.col("n_delivered"))
    agg = _exposed(groups).groupBy(month_key("signup_date").alias("cohort_month")).agg(
        F.sum("users").alias("cohort_size"),
        F.sum(F.col("window_days") * F.col("users")).alias("days"),
        F.sum(F.col("retained_m1") * F.col("users")).alias("retained"),
        F.sum(p_hit * F.col("users")).alias("hits"),
        F.sum(F.when(p_hit.isNotNull(), F.col("users"))).alias("judged"),
    )
    observed = hundred() * F.col("retained") / F.col("cohort_size")
    expected = hundred() * F.try_divide(F.col("hits"), F.col("judged"))
    return agg.select(
        "cohort_month", "cohort_size",
        F.round(F.try_divide(F.col("days"), F.col("cohort_size")) / F.lit(DAYS_PER_MONTH), 1).alias("avg_window_months"),
        F.round(observed, 1).alias("observed_m1_pct"),
        F.round(expected, 1).alias("expected_if_no_retention_pct"),
        F.round(observed - expected, 1).alias("excess_pct_points"),
    ).orderBy("cohort_month")


def exposure_gap(baseline: DataFrame) -> DataFrame:
    """One row: mean absolute gap (pp) between the rounded observed and expected columns."""
    return baseline.agg(
        F.count(F.lit(1)).alias("cohorts"),
        F.round(F.avg(F.abs(F.col("observed_m1_pct") - F.col("expected_if_no_retention_pct"))), 2)
        .alias("mean_abs_gap_pp"))


def exposure_correlation(baseline: DataFrame, cohort_from: str | None = None,
                         cohort_to: str | None = None) -> DataFrame:
    """Pearson r between cohort window (months) and observed month+1 retention,
    with t = r·sqrt((n-2)/(1-r²)) and its two-sided p (n-2 dof)."""
    b = baseline
    if cohort_from:
        b = b.where(F.col("cohort_month") >= cohort_from)
    if cohort_to:
        b = b.where(F.col("cohort_month") <= cohort_to)
    agg = b.agg(F.count(F.lit(1)).alias("n"),
                F.corr("avg_window_months", "observed_m1_pct").alias("r"))
    t = F.col("r") * F.sqrt(F.try_divide(F.col("n") - 2, F.lit(1.0) - F.col("r") * F.col("r")))
    with_t = agg.select("n", "r", t.alias("t"), (F.col("n") - 2).alias("dof"))
    with_p = with_t_two_sided(with_t, "t", "dof", "p_raw")
    return with_p.select(
        F.col("n").alias("n_cohorts"),
        F.round("r", 6).alias("r"),
        F.round("t", 6).alias("t_stat"),
        F.round("p_raw", 8).alias("p_value"),
    )
