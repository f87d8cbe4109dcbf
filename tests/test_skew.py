"""Hot keys: one user holds a third of all orders and one user-day a third of
all events. Results must equal a brute-force pandas computation."""

import datetime as dt
import random

import pandas as pd
import pytest

from growthlens.operators import funnel, outcome, ranking, retention, revenue
from growthlens.sources.views import activity_from_orders

from frames import events_frame, orders_frame, user_city_frame


@pytest.fixture(scope="module")
def skewed(spark):
    rnd = random.Random(11)
    rows = []
    for oid in range(1, 3001):
        uid = 1 if oid % 3 == 0 else rnd.randint(2, 150)
        day = dt.date(2024, 1, 1) + dt.timedelta(days=rnd.randint(0, 364))
        rows.append((oid, uid, "delivered" if rnd.random() < 0.7 else "cancelled", day.isoformat(),
                     round(rnd.uniform(100, 1000), 2), rnd.choice(["UPI", "Card", "Cash"])))
    pdf = pd.DataFrame(rows, columns=["order_id", "user_id", "status", "date", "amount", "pay"])
    pdf["date"] = pd.to_datetime(pdf["date"])
    cities = [(u, f"n{u}", f"C{u % 4}") for u in range(1, 151)]
    return orders_frame(spark, rows), user_city_frame(spark, cities), pdf, dict((u, c) for u, _, c in cities)


def test_hot_user_cohort_retention(skewed):
    orders, _, pdf, _ = skewed
    got = {r.cohort_month: r for r in retention.cohort_retention(activity_from_orders(orders)).collect()}
    signup = pdf.groupby("user_id")["date"].min()
    dmonths = pdf[pdf.status == "delivered"].assign(m=lambda d: d.date.dt.to_period("M")) \
        .groupby("user_id")["m"].apply(set)
    expect = {}
    for uid, s in signup.items():
        cm = s.to_period("M")
        row = expect.setdefault(str(cm), [0, 0, 0, 0])
        row[0] += 1
        for h in (1, 2, 3):
            row[h] += int((cm + h) in dmonths.get(uid, set()))
    assert {k: [r.cohort_size, r.retained_m1, r.retained_m2, r.retained_m3] for k, r in got.items()} == expect


def test_hot_user_cancellations(skewed):
    orders, cities, pdf, city_of = skewed
    got = {r.city: (r.total_orders, r.cancelled_orders, r.revenue_at_risk)
           for r in revenue.cancellation_by_city(orders, cities).collect()}
    pdf = pdf.assign(city=pdf.user_id.map(city_of))
    expect = {c: (len(g), int((g.status == "cancelled").sum()),
                  round(g.loc[g.status == "cancelled", "amount"].sum(), 2)) for c, g in pdf.groupby("city")}
    assert got.keys() == expect.keys()
    for c in got:
        assert got[c][:2] == expect[c][:2]
        assert got[c][2] == pytest.approx(expect[c][2], abs=0.011)


def test_hot_user_pareto_and_first_order(skewed):
    orders, _, pdf, _ = skewed
    d = pdf[pdf.status == "delivered"]
    per = d.groupby("user_id")["amount"].sum().reset_index().sort_values(
        ["amount", "user_id"], ascending=[False, True])
    n = len(per)
    q, r = divmod(n, 20)
    top_n = q + 1 if r else q
    seg = {s.segment: s.users for s in ranking.pareto_split(orders).collect()}
    assert seg[ranking.TOP_SEGMENT] == top_n and seg[ranking.REST_SEGMENT] == n - top_n
    assert ranking.power_users(orders).collect()[0].user_id == 1

    first = d.sort_values(["date", "order_id"]).groupby("user_id").first()["amount"]
    cnt = d.groupby("user_id").size()
    got = {r.user_id: (r.first_value, r.n_delivered) for r in outcome.first_event_per_user(orders).collect()}
    assert got == {u: (first[u], int(cnt[u])) for u in cnt.index}


def test_hot_user_day_funnel(spark):
    rnd = random.Random(5)
    steps = ["view", "click", "signup", "purchase"]
    rows = []
    for i in range(3000):
        if i % 3 == 0:
            rows.append((7, rnd.choice(steps), "2024-01-05 10:00:00", "iOS"))
        else:
            rows.append((rnd.randint(1, 80), rnd.choice(steps + ["error"]),
                         f"2024-01-{rnd.randint(1, 28):02d} 12:00:00", rnd.choice(["iOS", "Web"])))
    got = {r.event_name: r.users for r in funnel.funnel_steps(events_frame(spark, rows)).collect()}
    pdf = pd.DataFrame(rows, columns=["u", "e", "ts", "p"])
    pdf["day"] = pdf.ts.str[:10]
    expect = pdf[pdf.e.isin(steps)].drop_duplicates(["e", "u", "day"]).groupby("e").size().to_dict()
    assert got == expect
