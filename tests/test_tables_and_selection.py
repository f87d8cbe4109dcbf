"""Chi-square of r x c tables, selection of the top tile, schema-aware diff,
list parameters, NULLs under "everything selected", counts from files."""

import itertools
import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from growthlens.functions.scope import Scope, filter_scope
from growthlens.operators import funnel, ranking, retention, revenue, setops, testing
from growthlens.plans.inspect import plan_text, pushed_filters
from growthlens.plans.registry import QUERIES
from growthlens.sources import adhoc, catalog, sinks, views
from growthlens.sources.tables import Tables

import tails
from conftest import SF_GATE
from frames import events_frame, orders_frame, user_city_frame


# -- chi-square ------------------------------------------------------------------

def by_hand(cells):
    """(total, r, c, chi2, dof) over the full grid, absent cells as 0."""
    rows, columns = sorted({i for i, _, _ in cells}, key=str), sorted({j for _, j, _ in cells}, key=str)
    o = {(i, j): sum(n for a, b, n in cells if (a, b) == (i, j)) for i in rows for j in columns}
    n = sum(o.values())
    r = {i: sum(o[i, j] for j in columns) for i in rows}
    c = {j: sum(o[i, j] for i in rows) for j in columns}
    dof = (len(rows) - 1) * (len(columns) - 1)
    if dof and min(*r.values(), *c.values()) == 0:
        return n, len(rows), len(columns), None, dof
    fix = 0.5 if dof == 1 else 0.0
    chi2 = sum(max(abs(o[i, j] - r[i] * c[j] / n) - fix, 0) ** 2 / (r[i] * c[j] / n) for i in rows for j in columns) if dof else 0.0
    return n, len(rows), len(columns), chi2, dof


def test_tables_of_any_shape_with_absent_cells(spark):
    rng = random.Random(3)
    tests = {}
    for k in range(25):
        r, c = rng.randint(1, 7), rng.randint(1, 6)
        cells = [(f"r{i}", f"c{j}", rng.randint(0, 40)) for i in range(r) for j in range(c) if rng.random() < 0.7]
        tests[f"t{k}"] = cells + cells[:2] or [("r", "c", 1)]
    tests["two by two, one absent"] = [("a", "x", 9), ("a", "y", 4), ("b", "x", 7)]
    tests["a label without a name"] = [(None, "x", 5), (None, "y", 9), ("b", "x", 8), ("b", None, 6)]
    tests["a row of zeros"] = [("a", "x", 5), ("a", "y", 3), ("b", "x", 0), ("b", "y", 0), ("c", "x", 1)]
    tests["zeros only"] = [("a", "x", 0), ("b", "y", 0)]
    tests["large"] = [("a", "x", 6 * 10**9), ("a", "y", 4 * 10**9), ("b", "x", 6 * 10**9 + 10**5), ("b", "z", 4 * 10**9)]
    data = [(t, i, j, n) for t, cells in tests.items() for i, j, n in cells]
    df = spark.createDataFrame(data, "test_id string, label string, outcome string, n long")
    got = {r.test_id: r for r in testing.chi_square_table(df).collect()}
    assert set(got) == set(tests)
    for t, cells in tests.items():
        n, r, c, chi2, dof = by_hand(cells)
        x = got[t]
        assert (x.total, x.n_rows, x.n_columns, x.dof, x.yates_applied) == (n, r, c, dof, dof == 1), t
        if chi2 is None:
            assert x.chi2 is None and x.p_value is None, t
        else:
            assert x.chi2 == pytest.approx(chi2, rel=1e-9, abs=1e-6), t
            assert x.p_value == pytest.approx(tails.chi2_sf_scalar(chi2, dof) if dof else 1.0, abs=1e-8), t


def test_two_column_tables_agree_with_the_other_form(spark):
    rng = random.Random(8)
    wide = [(f"t{k}", f"g{i}", rng.randint(0, 50), rng.randint(1, 50)) for k in range(12) for i in range(rng.randint(2, 9))]
    a = spark.createDataFrame(wide, "test_id string, label string, a long, b long")
    long = spark.createDataFrame([(t, g, o, n) for t, g, x, y in wide for o, n in (("a", x), ("b", y))],
                                 "test_id string, label string, outcome string, n long")
    for yates in (True, False):
        one = {r.test_id: r for r in testing.chi_square(a, yates=yates).collect()}
        for r in testing.chi_square_table(long, yates=yates).collect():
            same = one[r.test_id]
            assert (r.n_rows, r.dof, r.yates_applied) == (same.groups, same.dof, same.yates_applied)
            assert r.chi2 == pytest.approx(same.chi2, abs=1e-5) and r.p_value == pytest.approx(same.p_value, abs=1e-7)


def test_two_by_two_of_any_counts(spark):
    rows = [(f"{i}", lab, a, b) for i, (w, x, y, z) in enumerate(itertools.product((0, 1, 7, 10**6), repeat=4))
            for lab, a, b in (("p", w, x), ("q", y, z))]
    got = {r.test_id: r for r in testing.chi_square_raw(spark.createDataFrame(rows, "test_id string, label string, a long, b long")).collect()}
    for i, (w, x, y, z) in enumerate(itertools.product((0, 1, 7, 10**6), repeat=4)):
        want = by_hand([("p", "a", w), ("p", "b", x), ("q", "a", y), ("q", "b", z)])[3]
        r = got[f"{i}"]
        assert r.chi2_raw is None if want is None else r.chi2_raw == pytest.approx(want, rel=1e-7, abs=1e-9), (w, x, y, z)


# -- selection ---------------------------------------------------------------------

@pytest.mark.parametrize("tiles", [1, 3, 20])
@pytest.mark.parametrize("values", [
    [], [5], [1.5] * 40, [0, 0, 0, 1], [-3, -2.5, -2.5, 0, 7, 7, 7, 1e12], [None, 4, None, 2, 9],
    [round(math.exp(random.Random(1).gauss(3, 2)) + i / 7, 2) for i in range(997)], [7] * 500 + list(range(500)),
])
def test_top_tile_equals_ntile(spark, tiles, values):
    df = spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(values)], "k long, v double").withColumn(
        "v", F.col("v").cast("decimal(28,2)"))
    order = [F.desc_nulls_last("v"), F.asc("k")]
    want = df.withColumn("t", F.ntile(tiles).over(Window.orderBy(*order))).agg(
        F.count(F.when(F.col("t") == 1, 1)).alias("n1"), F.coalesce(F.sum(F.when(F.col("t") == 1, F.col("v"))), F.lit(0)).alias("s1"),
        F.count(F.lit(1)).alias("n"), F.sum("v").alias("s")).collect()[0]
    got = ranking.top_tile(df, tiles, "v").collect()
    if not values:
        assert got == []
    else:
        assert (got[0].top_n, got[0].top_sum, got[0].n, got[0].total) == (want.n1, want.s1, want.n, want.s)


def test_pareto_of_nobody(spark):
    none = orders_frame(spark, [(1, 1, "cancelled", "2024-01-01", 5, "UPI")])
    assert ranking.pareto_split(none).collect() == []
    r = ranking.concentration_ratio(none).collect()[0]
    assert (r.top_users, r.total_users, r.concentration_ratio) == (0, 0, None)
    one = ranking.pareto_split(orders_frame(spark, [(1, 1, "delivered", "2024-01-01", 5, "UPI")])).collect()
    assert [(r.segment, r.users, r.pct_of_total_gmv) for r in one] == [(ranking.TOP_SEGMENT, 1, 100.0)]


# -- scans ---------------------------------------------------------------------------

def final_scans(spark, name, table):
    """File scans of a table in the plan that ran."""
    df = QUERIES[name](spark, SF_GATE)
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    column = {"orders": "o_orderstatus"}[table]
    return sum("FileScan parquet" in line and column in line for line in text.splitlines())


@pytest.mark.parametrize("name", [
    "pareto_split", "concentration_ratio", "dimension_values", "cohort_retention", "cohort_retention_observable",
    "exposure_baseline", "exposure_gap", "exposure_correlation", "chi_square_city_payment"])
def test_orders_are_scanned_once(spark, name):
    assert final_scans(spark, name, "orders") == 1


def test_counts_read_no_column(spark):
    assert "ReadSchema: struct<>" in plan_text(QUERIES["table_row_counts"](spark, SF_GATE))


def test_counts_of_files(spark, tmp_path):
    spark.range(7).repartition(3).write.parquet(f"{tmp_path}/a.parquet")
    spark.range(0).write.parquet(f"{tmp_path}/ab.parquet")
    spark.createDataFrame([("x", 1.0)] * 5, "s string, d double").write.parquet(f"{tmp_path}/ab.parquet/nested.parquet")
    paths = {n: f"{tmp_path}/{p}" for n, p in (("a", "a.parquet"), ("empty", "ab.parquet"), ("inner", "ab.parquet/nested.parquet"))}
    got = {r.table_name: r.n for r in catalog.table_row_counts_of_files(spark, paths).collect()}
    assert got == {"a": 7, "empty": 0, "inner": 5}


# -- retention's end of data ------------------------------------------------------------

def test_orders_of_unknown_users_still_end_the_data(spark):
    rows = [(1, 1, "delivered", "2024-01-10", 5, "UPI"), (2, 1, "delivered", "2024-02-03", 5, "UPI"),
            (3, 2, "delivered", "2024-02-05", 5, "UPI"), (4, 99, "cancelled", "2024-06-30", 5, "UPI")]
    orders = orders_frame(spark, rows)
    every = views.activity_from_orders(orders).withColumn("known", F.col("user_id") != 99)
    known = every.where("known").drop("known")
    for one, two in ((retention.cohort_retention_observable(every), retention.cohort_retention_observable(known, orders)),
                     (retention.exposure_baseline(every), retention.exposure_baseline(known, orders)),
                     (retention.cohort_retention(every), retention.cohort_retention(known))):
        assert one.collect() == two.collect() != []
    # Users alone would end in February, and month 4 of the January cohort with them.
    assert {r.horizon: r.retention_pct for r in retention.cohort_retention_observable(every).collect() if r.cohort_month == "2024-01"} == {
        1: 100.0, 2: 0.0, 3: 0.0}


# -- NULLs and "everything selected" -------------------------------------------------------

NULLS = [(1, 1, "delivered", "2024-01-01", 10, "UPI"), (2, 1, "delivered", "2024-01-05", 20, None),
         (3, 2, "cancelled", "2024-02-01", 40, "Card"), (4, 3, "delivered", "2024-02-01", 80, "Card")]
CITIES = [(1, "a", "Pune"), (2, "b", "Pune"), (3, "c", None)]


@pytest.mark.parametrize("scope", [Scope(), Scope(payments=("UPI", "Card"), cities=("Pune",))])
def test_everything_selected_leaves_nulls_out(spark, scope):
    orders, cities = orders_frame(spark, NULLS), user_city_frame(spark, CITIES)
    assert [(r.ym, r.gmv) for r in revenue.gmv_monthly_filtered(orders, cities, scope).collect()] == [("2024-01", 10.0)]
    assert [(r.city, r.orders, r.revenue) for r in revenue.city_leaderboard(orders, cities, scope).collect()] == [("Pune", 1, 10.0)]
    assert sorted(r.order_id for r in filter_scope(orders, cities, scope).collect()) == [1, 3]
    cut = {(r.dimension, r.value): (r.delivered, r.cancelled) for r in revenue.cancellation_filtered(orders, cities, scope).collect()}
    assert cut == {("city", "Pune"): (1, 1), ("payment_method", "UPI"): (1, 0), ("payment_method", "Card"): (0, 1)}
    events = events_frame(spark, [(1, "view", "2024-01-01 10:00:00", "iOS"), (1, "purchase", "2024-01-01 11:00:00", None)])
    k = revenue.kpi_overview(orders, cities, events, scope).collect()[0]
    assert (k.gmv, k.delivered_orders, k.revenue_at_risk, k.opened, k.ordered) == (10.0, 1, 40.0, 1, 0)
    # The unfiltered shares and figures keep them.
    assert k.gmv_share_pct == round(100 * 10 / 110, 2)
    steps = {r.event_name: r.users for r in funnel.funnel_zero_filled(events).collect()}
    assert steps["view"] == 1 and steps["purchase"] == 0
    by_city = {r.city: r.orders for r in revenue.avg_order_value_by_city(orders, cities).collect()}
    assert by_city == {"Pune": 2, None: 1}


# -- diff ----------------------------------------------------------------------------------

def diff(a, b):
    return sorted((tuple(r) for r in setops.dataset_diff(a, b).collect()), key=str)


def test_columns_of_one_side_are_differences(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = a.withColumn("extra", F.lit(1))
    assert diff(a, b) == [(None, None, "extra", "column_only_in_b", 0)]
    assert diff(b, a) == [(None, None, "extra", "column_only_in_a", 0)]
    c = spark.createDataFrame([("1", 5)], "k string, w int")
    assert diff(a, c) == sorted([("2", None, "only_in_a", 1), (None, "k", "column_type_differs", 0),
                                 (None, "v", "column_only_in_a", 0), (None, "w", "column_only_in_b", 0)], key=str)
    assert diff(a, a) == [] and setops.dataset_diff(a, a).columns == ["k", "v", "side", "copies"]


def test_maps_and_floats_are_compared_by_value(spark):
    schema = "m map<string,int>, d double, s struct<x:array<map<int,double>>>"
    nan = float("nan")
    a = spark.createDataFrame([({"p": 1, "q": 2}, -0.0, ([{1: nan, 2: -0.0}],)), (None, nan, None)], schema)
    b = spark.createDataFrame([({"q": 2, "p": 1}, 0.0, ([{2: 0.0, 1: nan}],)), (None, nan, None)], schema)
    assert diff(a, b) == []
    c = spark.createDataFrame([({"q": 2, "p": 3}, 0.0, ([{2: 0.0, 1: nan}],)), (None, nan, None)], schema)
    found = diff(a, c)
    assert [(r[0], r[3], r[4]) for r in found] == [({"p": 1, "q": 2}, "only_in_a", 1), ({"q": 2, "p": 3}, "only_in_b", 1)]


# -- ad-hoc -------------------------------------------------------------------------------------

def test_a_bound_list_reaches_the_scan(spark):
    pushed = " ".join(pushed_filters(QUERIES["sql_payment_totals"](spark, SF_GATE)))
    assert "In(o_orderpriority" in pushed


def test_list_markers_only_where_they_are_markers(spark):
    df = spark.createDataFrame([(1, "a"), (2, ":xs"), (3, "c")], "k int, v string")
    run = lambda sql, **args: [r[0] for r in adhoc.run_sql(spark, sql, args, {"t": df}).collect()]
    assert run("SELECT k FROM {t} WHERE v IN (:xs) /* :xs */ OR v = ':xs' -- :xs\nORDER BY k", xs=["a", "c"]) == [1, 2, 3]
    assert run("SELECT k FROM {t} WHERE k IN (:xs) AND k < :most", xs=(1, 2, 3), most=3) == [1, 2]
    assert run("SELECT k FROM {t} WHERE k IN (:xs)", xs=[]) == []
    assert run("SELECT k FROM {t} WHERE v IN (:xs)", xs={"a') OR (1=1"}) == []
    assert run("SELECT k::string FROM {t} WHERE k = :k", k=1) == ["1"]
    with pytest.raises(ValueError):
        run("SELECT k FROM {t} WHERE k IN (:xs)", xs=[1], xs__0=2)


def test_a_page_says_whether_it_is_cut(spark):
    df = spark.range(10).withColumn("v", F.col("id") % 3)
    page = adhoc.capped(df, [F.desc("v"), F.asc("id")], 4).collect()
    assert [(r.id, r.truncated) for r in page] == [(2, True), (5, True), (8, True), (1, True)]
    assert {r.truncated for r in adhoc.capped(df, [F.asc("id")], 10).collect()} == {False}


def test_written_results_lie_where_the_cluster_shares_them(spark, tmp_path):
    df = sinks.written_and_read(revenue.gmv_mom(views.orders(Tables(spark, SF_GATE))), "monthly", str(tmp_path))
    assert [p.name.startswith("growthlens-monthly-") for p in tmp_path.iterdir()] == [True]
    assert df.count() == revenue.gmv_mom(views.orders(Tables(spark, SF_GATE))).count() > 0
