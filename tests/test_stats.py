"""Statistics against the published formula goldens (counts taken from the
reference write-up), plus the tails against textbook values."""

import math

import pytest

from growthlens.functions import stats
from growthlens.operators import testing

import tails


def _tables(spark, rows):
    return spark.createDataFrame(rows, "test_id string, label string, a long, b long")


def test_platform_chi_square_golden(spark):
    # converted / not converted per platform: 164/607, 154/595, 154/607 opened
    t = _tables(spark, [("p", "iOS", 164, 607 - 164), ("p", "Android", 154, 595 - 154),
                        ("p", "Web", 154, 607 - 154)])
    r = testing.chi_square(t).collect()[0]
    assert r.dof == 2 and not r.yates_applied
    assert r.chi2 == pytest.approx(0.4473, abs=1e-4)
    assert r.p_value == pytest.approx(0.7996, abs=1e-4)


def test_reorder_chi_square_golden(spark):
    t = _tables(spark, [("r", "1", 204, 318 - 204), ("r", "2", 226, 396 - 226),
                        ("r", "3", 287, 420 - 287), ("r", "4", 264, 427 - 264)])
    r = testing.chi_square(t).collect()[0]
    assert r.dof == 3
    assert r.chi2 == pytest.approx(11.4945, abs=1e-3)
    assert r.p_value == pytest.approx(0.00933, abs=1e-5)


def test_yates_on_two_by_two(spark):
    t = _tables(spark, [("y", "a", 10, 20), ("y", "b", 30, 25)])
    r = testing.chi_square(t).collect()[0]
    assert r.yates_applied and r.dof == 1
    # hand computation: N=85, E = row*col/N, |O-E| - 0.5 per cell
    n, rows, cols = 85, [30, 55], [40, 45]
    obs = [[10, 20], [30, 25]]
    chi = sum((abs(obs[i][j] - rows[i] * cols[j] / n) - 0.5) ** 2 / (rows[i] * cols[j] / n)
              for i in range(2) for j in range(2))
    assert r.chi2 == pytest.approx(chi, abs=1e-6)
    assert r.p_value == pytest.approx(tails.chi2_sf_scalar(chi, 1), abs=1e-8)


def test_one_group_and_zero_column(spark):
    one = testing.chi_square(_tables(spark, [("o", "a", 5, 7)])).collect()[0]
    assert (one.groups, one.dof, one.chi2, one.p_value) == (1, 0, 0.0, 1.0)
    zero = testing.chi_square(_tables(spark, [("z", "a", 5, 0), ("z", "b", 7, 0)])).collect()[0]
    assert zero.chi2 is None and zero.p_value is None


def test_many_tests_in_one_plan(spark):
    t = _tables(spark, [("x", "a", 10, 20), ("x", "b", 30, 25), ("y", "a", 1, 2), ("y", "b", 3, 4),
                        ("y", "c", 5, 9)])
    got = {r.test_id: r for r in testing.chi_square(t).collect()}
    assert got["x"].dof == 1 and got["y"].dof == 2


def test_bonferroni_golden(spark):
    tests = spark.createDataFrame([("city", 0.951), ("payment", 0.019), ("platform", 0.800),
                                   ("delivery", 0.009)], "test_id string, p_value double")
    got = {r.test_id: r for r in testing.multiple_comparison_verdicts(tests).collect()}
    assert got["payment"].bonferroni_alpha == pytest.approx(0.0125)
    assert got["payment"].raw_verdict == "significant"
    assert got["payment"].corrected_verdict == "not significant"
    assert got["delivery"].corrected_verdict == "still significant"
    assert got["city"].family_wise_error == pytest.approx(0.185494, abs=1e-6)


def test_ztest_golden(spark):
    arms = spark.createDataFrame([("control", 431, 234), ("treatment", 431, 253)],
                                 "arm string, users long, converted long")
    r = testing.two_proportion_ztest(arms).collect()[0]
    assert r.z_stat == pytest.approx(-1.30535, abs=1e-5)
    assert r.p_value == pytest.approx(0.19177, abs=1e-5)


def test_sample_size_golden(spark):
    base = spark.createDataFrame([(862, 472)], "from_step_users long, to_step_users long")
    got = {r.lift_pp: r for r in testing.required_sample_size(base).collect()}
    assert got[3.0].required_n_per_group == 4289
    assert got[6.0].required_n_per_group == 1060
    assert got[10.0].required_n_per_group == 374
    assert got[6.0].available_per_group == 431 and not got[6.0].enough
    assert got[10.0].enough


@pytest.mark.parametrize("t,nu", [(12.706, 1), (2.306, 8), (2.262, 9), (2.086, 20)])
def test_t_tail_table_values(t, nu):
    assert tails.t_two_sided_scalar(t, nu) == pytest.approx(0.05, abs=2e-4)


def test_correlation_p_golden():
    r, n = -0.93, 11
    t = r * math.sqrt((n - 2) / (1 - r * r))
    assert tails.t_two_sided_scalar(t, n - 2) == pytest.approx(3.4e-5, rel=0.05)


@pytest.mark.parametrize("k", range(1, 9))
def test_chi2_tail_matches_series_definition(k):
    # P(X > x) = Q(k/2, x/2): check against the survival identity for x -> 0 and a
    # direct numeric integration of the density.
    x = 3.7
    steps = 200000
    hi = 200.0
    h = (hi - x) / steps
    c = 1.0 / (2 ** (k / 2) * math.gamma(k / 2))
    dens = lambda v: c * v ** (k / 2 - 1) * math.exp(-v / 2)
    integral = h * (sum(dens(x + i * h) for i in range(1, steps)) + (dens(x) + dens(hi)) / 2)
    assert tails.chi2_sf_scalar(x, k) == pytest.approx(integral, rel=1e-6)
    assert tails.chi2_sf_scalar(0.0, k) == 1.0


def test_chi_square_matches_spark_ml_on_row_level_data(spark):
    """Without Yates (dof > 1) our contingency maths equals Spark ML's
    ChiSquareTest run on the row-level orders (payment x cancelled)."""
    from pyspark.ml.feature import StringIndexer, VectorAssembler
    from pyspark.ml.stat import ChiSquareTest
    from pyspark.sql import functions as F

    from growthlens.sources import views
    from growthlens.sources.tables import Tables

    orders = views.orders(Tables(spark, "/root/testdata/sf0.01"))
    ours = testing.chi_square(testing.tag(testing.contingency_by_payment(orders, ordered=False),
                                          "payment_method")).collect()[0]
    idx = StringIndexer(inputCol="payment_method", outputCol="pm").fit(orders).transform(orders)
    rows = VectorAssembler(inputCols=["pm"], outputCol="features").transform(
        idx.withColumn("label", (~F.col("is_delivered")).cast("double")))
    ml = ChiSquareTest.test(rows, "features", "label").collect()[0]
    assert ours.dof == ml.degreesOfFreedom[0] == 4
    assert ours.chi2 == pytest.approx(ml.statistics[0], abs=1e-6)
    assert ours.p_value == pytest.approx(ml.pValues[0], abs=1e-9)


def test_ztest_with_an_empty_arm_is_null_not_an_error(spark):
    arms = spark.createDataFrame([("control", 10, 3)], "arm string, users long, converted long")
    r = testing.two_proportion_ztest(arms).collect()[0]
    assert r.z_stat is None and r.n_treatment is None


def test_p_value_uses_the_unrounded_statistic(spark):
    """The reported p is computed from the exact chi2, not its rounded display."""
    rows = [("p", "1", 1000, 976), ("p", "2", 976, 1038), ("p", "3", 982, 1018),
            ("p", "4", 1008, 1035), ("p", "5", 967, 1021)]
    r = testing.chi_square(_tables(spark, rows)).collect()[0]
    a = [1000, 976, 982, 1008, 967]
    b = [976, 1038, 1018, 1035, 1021]
    sa, sb = sum(a), sum(b)
    n = sa + sb
    chi = sum((x - (x + y) * sa / n) ** 2 / ((x + y) * sa / n) + (y - (x + y) * sb / n) ** 2 / ((x + y) * sb / n)
              for x, y in zip(a, b))
    assert r.p_value == round(tails.chi2_sf_scalar(chi, 4), 10)


def _close(got, want, rel):
    return got == pytest.approx(want, rel=rel, abs=1e-300)


def test_chi_square_tail(spark):
    rows = [(x, k) for x in (0.0, 0.01, 0.4473, 1.7535, 3.7, 11.4945, 38.76, 80.0, 200.0, 700.0) for k in (1, 2, 3, 4, 5, 24, 25, 101)]
    rows += [(k * f, k) for k in (1500, 1600, 1601, 2000, 5000) for f in (0.9, 0.95, 1.0, 1.05, 1.2)]
    df = spark.createDataFrame([(float(x), k) for x, k in rows], "x double, k int")
    for r in stats.with_chi2_sf(df, "x", "k", "p").collect():
        assert _close(r.p, tails.chi2_sf_scalar(r.x, r.k), 1e-9), (r.x, r.k)


def test_normal_tail_keeps_relative_precision(spark):
    df = spark.createDataFrame([(z,) for z in (0.0, 0.5, -1.30535, 2.0, 2.8, 2.9, 3.5, 6.0, 8.0, 8.5, 9.0, -10.0, 12.0, 20.0, None)], "z double")
    for r in stats.with_normal_two_sided(df, "z", "p").collect():
        assert r.p is None if r.z is None else _close(r.p, tails.normal_two_sided_scalar(r.z), 1e-11), r.z


def test_student_tail_keeps_relative_precision(spark):
    df = spark.createDataFrame([(float(t), n) for t in (0, 0.7, 1.99, 2.01, 2.306, -5.3, 12.7, 40) for n in (1, 2, 3, 8, 9, 67, 68, 900)], "t double, nu int")
    for r in stats.with_t_two_sided(df, "t", "nu", "p").collect():
        assert _close(r.p, tails.t_two_sided_scalar(r.t, r.nu, 20_000), 1e-6), (r.t, r.nu)
    none = stats.with_t_two_sided(spark.createDataFrame([(None, 3), (1.0, 0), (1.0, None)], "t double, nu int"), "t", "nu", "p")
    assert {r.p for r in none.collect()} == {None}


def test_chi_square_of_very_large_counts(spark):
    rows = [("big", "x", 6_000_000_000, 4_000_000_000), ("big", "y", 6_000_100_000, 3_999_900_000),
            ("huge", "x", 10**17, 10**17), ("huge", "y", 10**17, 10**17), ("huge", "z", 10**17, 10**17)]
    got = {r.test_id: r for r in testing.chi_square_raw(_tables(spark, rows)).collect()}
    n, a = 10_000_000_000, 12_000_100_000
    e, f = a / 2, n - a / 2
    want = 2 * ((abs(6_000_000_000 - e) - 0.5) ** 2 / e + (abs(4_000_000_000 - f) - 0.5) ** 2 / f)
    assert got["big"].chi2_raw == pytest.approx(want, rel=1e-6) and 0 < got["big"].p_raw < 1
    assert (got["huge"].chi2_raw, got["huge"].p_raw) == (0.0, 1.0)


def test_two_thousand_groups_of_coin_flips_are_not_significant(spark):
    import random
    rng = random.Random(11)
    rows = [("coin", str(i), a, 1000 - a) for i in range(2001) for a in [sum(rng.getrandbits(1) for _ in range(1000))]]
    raw = testing.chi_square_raw(_tables(spark, rows))
    r = raw.collect()[0]
    assert r.dof == 2000 and r.p_raw == pytest.approx(tails.chi2_sf_scalar(r.chi2_raw, 2000), rel=1e-8) and r.p_raw > 0.05
    v = testing.multiple_comparison_verdicts(raw, p="p_raw").collect()[0]
    assert v.corrected_verdict == "not significant"


def test_verdicts_use_the_unrounded_p(spark):
    tests = spark.createDataFrame([("tiny", 4e-11), ("edge", 0.05 - 1e-12)], "test_id string, p_raw double")
    got = {r.test_id: r for r in testing.multiple_comparison_verdicts(tests, m=1, p="p_raw").collect()}
    assert got["tiny"].p_value == 0.0 and got["tiny"].corrected_verdict == "still significant"
    assert got["edge"].p_value == 0.05 and got["edge"].raw_verdict == "significant"
