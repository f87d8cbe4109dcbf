"""Independent anchor values for the sf0.01 fixtures (recorded in the design
survey from separate probes), pinned as regression checks."""

import pytest

from growthlens.plans.registry import QUERIES

from conftest import SF_GATE


@pytest.fixture(scope="module")
def q(spark):
    return lambda name: QUERIES[name](spark, SF_GATE).collect()


def test_funnel_anchors(q):
    assert [(r.event_name, r.users) for r in q("funnel_steps")] == [
        ("view", 1617), ("click", 1601), ("signup", 1611), ("purchase", 1604)]
    ends = {r.platform: (r.opened, r.ordered) for r in q("funnel_ends_by_platform")}
    assert ends == {"iOS": (649, 618), "Android": (583, 607), "Web": (608, 609)}


def test_retention_anchors(q):
    cohorts = q("cohort_retention")
    assert len(cohorts) == 69
    first = cohorts[0]
    assert (first.cohort_month, first.cohort_size, first.retained_m1, first.retention_m1_pct) == \
        ("1995-01", 119, 5, 4.2)
    exp = q("exposure_baseline")[0]
    assert (exp.observed_m1_pct, exp.expected_if_no_retention_pct) == (4.2, 4.6)


def test_revenue_and_concentration_anchors(q):
    mom = q("gmv_mom")
    assert len(mom) == 79 and mom[0].gmv == 18135336.89
    assert len(q("top_n_per_group")) == 66
    seg = {r.segment: (r.users, r.pct_of_total_gmv) for r in q("pareto_split")}
    assert seg == {"Top 5% (power users)": (72, 12.43), "Remaining 95%": (1357, 87.57)}
    assert len(q("cancellation_by_city")) == 25


def test_first_order_anchors(q):
    got = [(r.reordered, r.users) for r in q("first_event_outcome")]
    assert got == [(338, 372), (303, 341), (319, 365), (296, 351)]
