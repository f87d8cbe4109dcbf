"""Contingency tables and the statistics that judge them.

Contingency tables are aggregates Spark computes from the full tables; the
tests then run as Column arithmetic over those few rows, keyed by
``test_id`` so any number of tests (one per segment, say) run in one plan.
Tail probabilities are Column expressions of ``growthlens.functions.stats``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from growthlens.fixed_values import (ALPHA, NOT_SIGNIFICANT, RAW_SIGNIFICANT, SAMPLE_SIZE_LIFTS_PP,
                                     SAMPLE_SIZE_POWER, STILL_SIGNIFICANT)
from growthlens.functions.exprs import hundred
from growthlens.functions.stats import chi2_sf_sql, normal_quantile, with_normal_two_sided


# ------------------------------------------------------- contingency ----

def contingency_by_city(orders: DataFrame, user_city: DataFrame, ordered: bool = True) -> DataFrame:
    """(label, a=delivered, b=cancelled) per user city."""
    per_user = orders.groupBy("user_id").agg(
        F.count(F.when(F.col("is_delivered"), 1)).alias("d"),
        F.count(F.when(~F.col("is_delivered"), 1)).alias("c"))
    joined = per_user.join(user_city.select("user_id", "city"), "user_id", "inner")
    out = joined.groupBy(F.col("city").alias("label")).agg(F.sum("d").alias("a"), F.sum("c").alias("b"))
    return out.orderBy("label") if ordered else out


def contingency_by_payment(orders: DataFrame, payments: Sequence[str] | None = None,
                           ordered: bool = True) -> DataFrame:
    """(label, a=delivered, b=cancelled) per payment method."""
    o = orders.where(F.col("payment_method").isin(list(payments))) if payments else orders
    out = o.groupBy(F.col("payment_method").alias("label")).agg(
        F.count(F.when(F.col("is_delivered"), 1)).alias("a"),
        F.count(F.when(~F.col("is_delivered"), 1)).alias("b"))
    return out.orderBy("label") if ordered else out


def order_contingencies(orders: DataFrame, user_city: DataFrame) -> DataFrame:
    """Both order-side test tables in one pass over orders: (test_id, label, a, b)
    with test_id 'city' (user city) and 'payment_method', a = delivered,
    b = cancelled. Orders are pre-aggregated per (user, payment), joined to
    the user's city once, and aggregated under GROUPING SETS.

    Unlike ``contingency_by_payment``, payment counts here cover only orders
    whose user has a city (the inner join); on data with referential
    integrity the two agree."""
    per = orders.groupBy("user_id", "payment_method").agg(
        F.count(F.when(F.col("is_delivered"), 1)).alias("d"),
        F.count(F.when(~F.col("is_delivered"), 1)).alias("c"))
    joined = per.join(user_city.select("user_id", "city"), "user_id", "inner")
    agg = joined.groupingSets([["city"], ["payment_method"]], "city", "payment_method").agg(
        F.sum("d").alias("a"), F.sum("c").alias("b"), F.grouping("city").alias("g"))
    is_city = F.col("g") == 0
    return agg.select(
        F.when(is_city, F.lit("city")).otherwise(F.lit("payment_method")).alias("test_id"),
        F.when(is_city, F.col("city")).otherwise(F.col("payment_method")).alias("label"),
        "a", "b")


def contingency_from(frame: DataFrame, label: str, a: str, b: str) -> DataFrame:
    return frame.select(F.col(label).alias("label"), F.col(a).cast("long").alias("a"),
                        F.col(b).cast("long").alias("b"))


def city_payment_cells(orders: DataFrame, user_city: DataFrame) -> DataFrame:
    """(label = user city, outcome = payment method, n = orders): the cells that
    have orders. Orders are counted per user and payment before the join."""
    per = orders.groupBy("user_id", "payment_method").agg(F.count(F.lit(1)).alias("n"))
    joined = per.join(user_city.select("user_id", "city"), "user_id", "inner")
    return joined.groupBy(F.col("city").alias("label"), F.col("payment_method").alias("outcome")).agg(F.sum("n").alias("n"))


def tag(frame: DataFrame, test_id: str) -> DataFrame:
    return frame.select(F.lit(test_id).alias("test_id"), *[c for c in frame.columns if c != "test_id"])


# ----------------------------------------------------------- chi-square ----

def chi_square(tables: DataFrame, key: Sequence[str] = ("test_id",), yates: bool = True) -> DataFrame:
    """Pearson chi-square test of independence for r x 2 tables in long form
    (key..., label, a, b): key..., groups, chi2, dof, p_value, yates_applied.

    Expected counts E = row total x column total / N. With dof = 1 the Yates
    continuity correction max(|O - E| - 0.5, 0) is applied (as scipy does by
    default). A zero expected cell makes the test undefined: chi2 and p are
    NULL. A single group gives chi2 = 0, dof = 0, p = 1. ``chi_square_table``
    takes tables of more columns.
    """
    out = chi_square_raw(tables, key, yates)
    return out.select(*key, "groups", F.round("chi2_raw", 6).alias("chi2"), "dof",
                      F.round("p_raw", 10).alias("p_value"), "yates_applied").orderBy(*key)


def chi_square_raw(tables: DataFrame, key: Sequence[str] = ("test_id",), yates: bool = True) -> DataFrame:
    """``chi_square`` unrounded and unordered: key..., groups, dof, yates_applied,
    chi2_raw, p_raw. One aggregate per test, combined map-side.

    With row totals R, column totals A and B: chi2 = N^2 / AB * (AB/N - sum(ab/R)).
    Both terms in brackets are split into whole part and rest, so that counts of
    any size lose nothing to their difference. In a 2 x 2 table all four cells
    lie equally far from what is expected, and that distance follows from chi2.
    """
    key = list(key)
    cells = tables.selectExpr(*key, "CAST(a AS DECIMAL(19,0)) AS a", "CAST(b AS DECIMAL(19,0)) AS b")
    per = cells.groupBy(*key).agg(*map(F.expr, (
        "count(*) AS groups", "CAST(sum(a) AS DECIMAL(19,0)) AS A", "CAST(sum(b) AS DECIMAL(19,0)) AS B",
        "CAST(min(a + b) AS DOUBLE) AS least", "CAST(max(a + b) AS DOUBLE) AS most",
        "sum((a * b) div nullif(a + b, 0)) AS whole",
        "sum(CAST((a * b) % nullif(a + b, 0) AS DOUBLE) / nullif(CAST(a + b AS DOUBLE), 0D)) AS rest")))
    yates_at = "groups = 2" if yates else "FALSE"
    gap = per.selectExpr(
        *key, "groups", "CAST(groups - 1 AS INT) AS dof", f"{yates_at} AS yates_applied", "least", "most",
        "CAST(A AS DOUBLE) AS a", "CAST(B AS DOUBLE) AS b", "CAST(A AS DOUBLE) + CAST(B AS DOUBLE) AS n",
        "greatest(0D, CAST((A * B) div nullif(A + B, 0) - whole AS DOUBLE) "
        "+ CAST((A * B) % nullif(A + B, 0) AS DOUBLE) / nullif(CAST(A + B AS DOUBLE), 0D) - rest) AS gap")
    apart = "greatest(sqrt(gap * n * least) * sqrt(most) - n / 2, 0D)"
    return _with_p(gap.selectExpr(
        *key, "groups", "dof", "yates_applied",
        "CASE WHEN dof = 0 THEN 0D WHEN least > 0 AND a > 0 AND b > 0 THEN "
        f"IF(yates_applied, ({apart} / least) * ({apart} / most), gap * n) * (n / a / b) END AS chi2_raw"))


def _with_p(tests: DataFrame) -> DataFrame:
    """``p_raw`` of ``chi2_raw`` and ``dof``; no degree of freedom gives 1."""
    return tests.withColumn("p_raw", F.expr(f"CASE WHEN dof = 0 THEN 1D ELSE {chi2_sf_sql('chi2_raw', 'dof')} END"))


def chi_square_table(cells: DataFrame, key: Sequence[str] = ("test_id",), row: str = "label", column: str = "outcome",
                     n: str = "n", yates: bool = True) -> DataFrame:
    """Pearson chi-square test of independence for r x c tables in sparse long
    form (key..., row, column, n): key..., total, n_rows, n_columns, chi2, dof,
    p_value, yates_applied.

    Cells may be absent (a count of 0) or split over rows. Absent ones are not
    filled in: all expected counts sum to N, so theirs are N less the present
    ones'. dof = (r - 1)(c - 1); Yates at dof 1, by the distance that all four
    cells then share. A row or column total of zero makes the test undefined:
    chi2 and p are NULL. One row or one column gives chi2 = 0, dof = 0, p = 1. A
    NULL label is a label. Margins are aggregates joined back, so neither the
    number of tests nor that of labels is bounded.
    """
    key = list(key)
    # As structs, so that NULLs meet NULLs.
    counts = cells.select(F.struct(*key).alias("k"), F.struct(F.col(row)).alias("i"), F.struct(F.col(column)).alias("j"), F.col(n).alias("n"))
    tests = cells.sparkSession.sql(_TABLE_TEST, args={"yates": yates}, counts=counts)
    return _with_p(tests).select("k.*", "total", "n_rows", "n_columns", F.round("chi2_raw", 6).alias("chi2"), "dof",
                                 F.round("p_raw", 10).alias("p_value"), "yates_applied").orderBy(*key)


_TABLE_TEST = """
WITH cells AS (SELECT k, i, j, CAST(sum(n) AS DOUBLE) AS o FROM {counts} GROUP BY k, i, j),
row_sums AS (SELECT k, i, sum(o) AS in_row FROM cells GROUP BY k, i),
column_sums AS (SELECT k, j, sum(o) AS in_column FROM cells GROUP BY k, j),
by_row AS (
  SELECT k, sum(in_row) AS total, count(*) AS n_rows, min(in_row) AS least_row, sum(1 / nullif(in_row, 0)) AS row_inverses
  FROM row_sums GROUP BY k),
by_column AS (
  SELECT k, count(*) AS n_columns, min(in_column) AS least_column, sum(1 / nullif(in_column, 0)) AS column_inverses
  FROM column_sums GROUP BY k),
met AS (
  SELECT k, o, in_row * in_column / nullif(total, 0) AS e, total, n_rows, n_columns, least(least_row, least_column) AS least_sum,
         row_inverses * column_inverses AS inverses
  FROM cells JOIN row_sums USING (k, i) JOIN column_sums USING (k, j) JOIN by_row USING (k) JOIN by_column USING (k)),
tests AS (
  SELECT k, total, n_rows, n_columns, least_sum, inverses, CAST((n_rows - 1) * (n_columns - 1) AS INT) AS dof,
         sum((o - e) * (o - e) / nullif(e, 0)) AS present,
         IF(count(*) < n_rows * n_columns, total - sum(e), 0D) AS absent, max(abs(o - e)) AS apart
  FROM met GROUP BY k, total, n_rows, n_columns, least_sum, inverses)
SELECT k, CAST(total AS BIGINT) AS total, n_rows, n_columns, dof, dof = 1 AND :yates AS yates_applied,
       CASE WHEN dof = 0 THEN 0D
            WHEN least_sum > 0 AND dof = 1 AND :yates THEN pow(greatest(apart - 0.5D, 0D), 2) * total * inverses
            WHEN least_sum > 0 THEN present + absent END AS chi2_raw
FROM tests"""


def multiple_comparison_verdicts(tests: DataFrame, m: int | None = None, alpha: float = ALPHA,
                                 p: str = "p_value") -> DataFrame:
    """Per test: the naive verdict at alpha, the Bonferroni verdict at alpha/m and
    the family-wise error 1 - (1 - alpha)^m. m defaults to the number of tests.
    Verdicts compare ``p`` as it is; only the shown p_value is rounded."""
    # A row per test; counting them apart would compute every test twice.
    family = F.lit(m) if m else F.count(F.lit(1)).over(Window.partitionBy())
    with_m = tests.withColumn("family_size", family.cast("int"))
    threshold = F.lit(alpha) / F.col("family_size")
    survives = F.col(p) < threshold
    return with_m.select(
        "test_id", F.round(p, 10).alias("p_value"), "family_size",
        threshold.alias("bonferroni_alpha"),
        F.when(F.col(p) < alpha, RAW_SIGNIFICANT).otherwise(NOT_SIGNIFICANT).alias("raw_verdict"),
        F.when(survives, STILL_SIGNIFICANT).otherwise(NOT_SIGNIFICANT).alias("corrected_verdict"),
        F.coalesce(survives, F.lit(False)).alias("survives_correction"),
        F.round(F.lit(1.0) - F.pow(F.lit(1.0 - alpha), F.col("family_size")), 6)
        .alias("family_wise_error"))


# ------------------------------------------------------------ A/B test ----

def two_proportion_ztest(arms: DataFrame, control: str = "control",
                         treatment: str = "treatment") -> DataFrame:
    """Pooled two-proportion z-test between two arms of (arm, users, converted):
    one row with both arms' counts and rates, z_stat and two-sided p_value."""
    row = arms.agg(
        F.max(F.when(F.col("arm") == control, F.col("users"))).alias("n_control"),
        F.max(F.when(F.col("arm") == control, F.col("converted"))).alias("converted_control"),
        F.max(F.when(F.col("arm") == treatment, F.col("users"))).alias("n_treatment"),
        F.max(F.when(F.col("arm") == treatment, F.col("converted"))).alias("converted_treatment"))
    n1, x1 = F.col("n_control"), F.col("converted_control")
    n2, x2 = F.col("n_treatment"), F.col("converted_treatment")
    p1, p2 = F.try_divide(x1, n1), F.try_divide(x2, n2)   # an empty arm gives NULL, not an error
    pool = F.try_divide(x1 + x2, n1 + n2)
    se = F.sqrt(pool * (F.lit(1.0) - pool) * (F.try_divide(F.lit(1.0), n1) + F.try_divide(F.lit(1.0), n2)))
    z = F.try_divide(p1 - p2, se)
    with_z = row.select("n_control", "converted_control", "n_treatment", "converted_treatment",
                        (hundred() * p1).alias("rc"), (hundred() * p2).alias("rt"), z.alias("z"))
    with_p = with_normal_two_sided(with_z, "z", "p_raw")
    return with_p.select(
        "n_control", "converted_control", "n_treatment", "converted_treatment",
        F.round("rc", 2).alias("control_rate_pct"), F.round("rt", 2).alias("treatment_rate_pct"),
        F.round("z", 6).alias("z_stat"), F.round("p_raw", 10).alias("p_value"))


def required_sample_size(baseline: DataFrame, lifts_pp: Sequence[float] = SAMPLE_SIZE_LIFTS_PP,
                         powers: Sequence[float] = (SAMPLE_SIZE_POWER,), alpha: float = ALPHA,
                         by: Sequence[str] = ()) -> DataFrame:
    """Per (lift, power): users per group needed to detect ``lift_pp`` points on
    the observed baseline of ``step_pair_baseline`` (two-sided alpha),
    n = ceil((z_{1-alpha/2} + z_power)^2 (p1 q1 + p2 q2) / lift^2), and whether
    half of the observed population is enough."""
    z_a = normal_quantile(1 - alpha / 2)
    grid = F.array(*[F.struct(F.lit(float(l)).alias("lift_pp"), F.lit(float(p)).alias("power"),
                              F.lit(normal_quantile(p)).alias("z_b"))
                     for l in lifts_pp for p in powers])
    by = list(by)
    rows = baseline.select(
        *by,
        F.try_divide(F.col("to_step_users"), F.col("from_step_users")).alias("p1"),
        F.floor(F.col("from_step_users") / 2).cast("long").alias("available_per_group"),
        F.explode(grid).alias("g"))
    p1 = F.col("p1")
    lift = F.col("g.lift_pp") / F.lit(100.0)
    p2 = p1 + lift
    n = (F.pow(F.lit(z_a) + F.col("g.z_b"), 2) * (p1 * (1 - p1) + p2 * (1 - p2))) / (lift * lift)
    need = F.ceil(n).cast("long")
    return rows.select(
        *by,
        F.col("g.lift_pp").alias("lift_pp"), F.col("g.power").alias("power"),
        F.round(hundred() * p1, 2).alias("baseline_pct"),
        need.alias("required_n_per_group"), "available_per_group",
        (F.col("available_per_group") >= need).alias("enough"))


__all__ = ["contingency_by_city", "contingency_by_payment", "order_contingencies", "contingency_from",
           "city_payment_cells", "tag", "chi_square", "chi_square_raw", "chi_square_table", "multiple_comparison_verdicts", "two_proportion_ztest",
           "required_sample_size"]
