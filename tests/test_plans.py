"""Physical-plan properties that matter at scale: filters and column pruning
reach the parquet scan, per-user aggregation happens before joins, top-N per
group is limited before its shuffle, and nothing large is moved to one task."""

import re

from growthlens.plans.inspect import operator_tree, plan_text, pushed_filters, read_schemas
from growthlens.plans.registry import QUERIES

from conftest import SF_GATE


def _q(spark, name):
    return QUERIES[name](spark, SF_GATE)


def test_scope_filters_reach_the_scan(spark):
    df = _q(spark, "gmv_monthly_filtered")
    pushed = " ".join(pushed_filters(df))
    assert "GreaterThanOrEqual(o_orderdate,1996-03-01" in pushed
    assert "LessThan(o_orderdate,2000-07-01" in pushed
    assert "In(o_orderpriority" in pushed
    assert "EqualTo(o_orderstatus,F)" in pushed


def test_column_pruning(spark):
    schemas = read_schemas(_q(spark, "gmv_mom"))
    assert schemas == ["struct<o_orderstatus:string,o_totalprice:double,o_orderdate:timestamp_ntz>"]
    ev = read_schemas(_q(spark, "funnel_steps"))
    assert all("props" not in s and "value" not in s for s in ev)


def test_user_aggregate_precedes_customer_join(spark):
    ops = operator_tree(_q(spark, "cohort_retention"))
    assert "LeftSemi" not in " ".join(ops)
    join_at = next(i for i, o in enumerate(ops) if "Join" in o)
    assert any("Aggregate" in o for o in ops[join_at + 1:])  # the per-user aggregate is below the join


def test_anti_join_sees_distinct_keys(spark):
    ops = operator_tree(_q(spark, "users_without_delivered_order"))
    anti = next(i for i, o in enumerate(ops) if "LeftAnti" in o)
    assert any("Aggregate" in o for o in ops[anti + 1:])


def test_top_n_is_limited_before_the_shuffle(spark):
    ops = operator_tree(_q(spark, "top_n_per_group"))
    limits = [i for i, o in enumerate(ops) if o == "WindowGroupLimit"]
    exchange = [i for i, o in enumerate(ops) if o == "Exchange"]
    assert len(limits) == 2 and any(limits[0] < e < limits[1] for e in exchange)


def _depth(line: str) -> int:
    return line.index("+-") if "+-" in line else 0


def _scans_below_single_partition_are_aggregated(text: str) -> bool:
    tree = text.split("\n\n")[0].splitlines()
    for i, line in enumerate(tree):
        if "Exchange" not in line:
            continue
        num = re.search(r"\((\d+)\)", line).group(1)
        args = re.search(rf"\({num}\) Exchange\n.*?Arguments: ([^\n]*)", text, re.S)
        if not (args and args.group(1).startswith("SinglePartition")):
            continue
        d0 = _depth(line)
        sub = []
        for other in tree[i + 1:]:
            if _depth(other) <= d0:
                break
            sub.append(other)
        for j, other in enumerate(sub):
            if "Scan parquet" not in other:
                continue
            depth, aggregated = _depth(other), False
            for up in reversed(sub[:j]):
                if _depth(up) < depth:
                    depth = _depth(up)
                    aggregated = aggregated or "Aggregate" in up
            if not aggregated:
                return False
    return True


def test_global_windows_only_over_aggregates(spark):
    """Every table scan under a SinglePartition exchange passes through an
    aggregate first, so only aggregated (small) rows meet in one task."""
    for name in ("funnel_steps", "gmv_mom", "funnel_zero_filled", "power_users", "pareto_split",
                 "funnel_steps_by_platform", "kpi_overview", "exposure_correlation"):
        assert _scans_below_single_partition_are_aggregated(plan_text(_q(spark, name))), name


def test_no_python_runs_on_executors(spark):
    """Every registered query, statistics included, is pure Spark SQL."""
    for name in QUERIES:
        text = plan_text(_q(spark, name))
        assert "ArrowEvalPython" not in text and "BatchEvalPython" not in text, name


def test_runtime_bloom_filter_prunes_lines_of_undelivered_orders(spark):
    """At scale (line scan above the 10 GB default) Catalyst builds a bloom filter
    from the delivered order keys and applies it to the line scan before the
    shuffle; lowering the threshold shows the same plan on the fixtures."""
    from growthlens.sources import views
    from growthlens.sources.tables import Tables
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
            "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "1"}
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        text = plan_text(views.delivered_lines(Tables(spark, SF_GATE)).groupBy("restaurant_id").count())
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert "might_contain" in text and "bloom_filter_agg" in text


def _without_broadcasts(spark, fn):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return fn()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_a_citys_lines_are_filtered_below_the_order_join(spark):
    """Only the city's lines reach the exchange by order: of the two semi joins
    the one on restaurant ids is the lower, next to the line scan."""
    text = _without_broadcasts(spark, lambda: plan_text(_q(spark, "top_k_in_group")))
    by_order = re.search(r"Left keys \[1\]: \[order_id#\d+L\]\nRight keys \[1\]: \[order_id#\d+L\]", text)
    by_restaurant = re.search(r"Left keys \[1\]: \[restaurant_id#\d+L\]\nRight keys \[1\]: \[restaurant_id#\d+L\]\nJoin type: LeftSemi", text)
    assert by_order and by_restaurant
    number = lambda m: int(re.findall(r"\n\((\d+)\) SortMergeJoin", text[:m.start()])[-1])
    assert number(by_restaurant) < number(by_order)   # numbered from the leaves up


def test_shares_and_diff_stay_in_hash_aggregation(spark):
    for name in ("group_share", "group_top_share", "dataset_diff", "sql_buyers_by_city"):
        assert "SortAggregate" not in plan_text(_q(spark, name)), name


def test_no_registered_query_is_cut(spark):
    """The only limits are the top-k features."""
    for name in QUERIES:
        text = plan_text(_q(spark, name))
        if name not in ("power_users", "top_k_in_group", "sql_page_of_orders"):
            assert "GlobalLimit" not in text and "TakeOrderedAndProject" not in text, name


def test_ad_hoc_query_aggregates_per_user_before_the_join(spark):
    ops = _without_broadcasts(spark, lambda: operator_tree(_q(spark, "sql_buyers_by_city")))
    join_at = next(i for i, o in enumerate(ops) if "Join" in o)
    assert any("Aggregate" in o for o in ops[join_at + 1:])


def test_chi_square_inner_steps_are_not_sorted(spark):
    for name in ("multiple_comparison_verdicts", "chi_square_cancellation_filtered"):
        assert plan_text(_q(spark, name)).count("rangepartitioning") <= 1, name
