"""GMV, leaderboards, cancellations and revenue at risk.

Plan shape for every per-user-city figure: filter orders (pushed to the
scan) → pre-aggregate per user (map-side partial aggregation, so a user who
holds a third of all orders becomes one row per map task) → join the
one-row-per-user aggregate to the user's city → aggregate per city. The
join therefore sees #users rows, never #orders rows, and carries no hot key.

GMV is the sum of delivered order amounts; the cancelled amount is revenue
at risk. Money is rounded only at the end, from the unrounded sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from growthlens.fixed_values import ENTITY, FUNNEL_STEPS, TOP_K_IN_CITY, TOP_N_PER_CITY
from growthlens.functions.exprs import MONEY, hundred, money, money_out, money_sum, month_key, pct
from growthlens.functions.scope import ALL, Scope

def _delivered():
    return F.col("is_delivered")

def _cancelled():
    return ~F.col("is_delivered")



def _amount_if(cond):
    return F.sum(F.when(cond, money("order_amount")).otherwise(F.lit(0).cast(MONEY)))


def _count_if(cond):
    return F.count(F.when(cond, 1))


def _with_city(per_user: DataFrame, user_city: DataFrame, scope: Scope | None = None) -> DataFrame:
    """Inner join with the user's city, filtered where there is a scope."""
    cities = user_city.select("user_id", "city")
    return per_user.join(scope.cities_of(cities) if scope else cities, "user_id", "inner")


# ---------------------------------------------------------------- GMV ----

def gmv_mom(orders: DataFrame) -> DataFrame:
    """Monthly delivered GMV, the previous present month's GMV, growth %.

    The LAG runs on one row per month after the aggregate.
    """
    monthly = (orders.where(_delivered())
               .groupBy(F.trunc("order_date", "month").alias("month"))
               .agg(money_sum("order_amount").alias("gmv_raw")))
    prev = F.lag("gmv_raw").over(Window.orderBy("month"))
    return monthly.select(
        month_key("month").alias("ym"),
        money_out("gmv_raw").alias("gmv"),
        money_out(prev).alias("prev_gmv"),
        F.round(F.try_divide(hundred() * (F.col("gmv_raw") - prev), prev), 2).alias("mom_growth_pct"),
    ).orderBy("ym")


def gmv_monthly_filtered(orders: DataFrame, user_city: DataFrame, scope: Scope = ALL) -> DataFrame:
    """(ym, gmv) of delivered orders inside the filter scope."""
    per_user_month = (scope.orders(orders).where(_delivered())
                      .groupBy("user_id", F.trunc("order_date", "month").alias("month"))
                      .agg(money_sum("order_amount").alias("gmv_raw")))
    joined = _with_city(per_user_month, user_city, scope)
    return (joined.groupBy("month").agg(F.sum("gmv_raw").alias("gmv_raw"))
            .select(month_key("month").alias("ym"), money_out("gmv_raw").alias("gmv"))
            .orderBy("ym"))


def city_leaderboard(orders: DataFrame, user_city: DataFrame, scope: Scope = ALL) -> DataFrame:
    """(city, orders, revenue): delivered orders and GMV per user city."""
    per_user = (scope.orders(orders).where(_delivered()).groupBy("user_id")
                .agg(F.count(F.lit(1)).alias("n"), money_sum("order_amount").alias("gmv_raw")))
    joined = _with_city(per_user, user_city, scope)
    return (joined.groupBy("city")
            .agg(F.sum("n").alias("orders"), money_out(F.sum("gmv_raw")).alias("revenue"))
            .orderBy(F.desc("revenue"), "city"))


def avg_order_value_by_city(orders: DataFrame, user_city: DataFrame) -> DataFrame:
    """(city, orders, avg_order_value) over delivered orders."""
    per_user = (orders.where(_delivered()).groupBy("user_id")
                .agg(F.count(F.lit(1)).alias("n"), money_sum("order_amount").alias("amount")))
    joined = _with_city(per_user, user_city)
    agg = joined.groupBy("city").agg(F.sum("n").alias("orders"), F.sum("amount").alias("amount"))
    return agg.select("city", "orders",
                      F.round(F.try_divide(F.col("amount").cast("double"), F.col("orders")), 2)
                      .alias("avg_order_value")).orderBy(F.desc("avg_order_value"), "city")


# ------------------------------------------------------- restaurants ----

def restaurant_revenue(lines: DataFrame) -> DataFrame:
    """(restaurant_id, revenue_raw) from delivered order lines (partial aggregation)."""
    return lines.groupBy("restaurant_id").agg(F.sum("revenue").alias("revenue_raw"))


def top_n_per_group(lines: DataFrame, restaurants: DataFrame, n: int = TOP_N_PER_CITY) -> DataFrame:
    """Top-n restaurants by delivered revenue within each restaurant city
    (DENSE_RANK, so ties keep more than n rows): city, name, revenue, city_rank.

    ``dense_rank() <= n`` lets Catalyst insert a partial WindowGroupLimit before
    the shuffle on city, so each map task forwards only its local top ranks.
    """
    rev = restaurant_revenue(lines).join(restaurants.select("restaurant_id", "name", "city"),
                                         "restaurant_id", "inner")
    w = Window.partitionBy("city").orderBy(F.desc("revenue_raw"))
    ranked = rev.withColumn("city_rank", F.dense_rank().over(w)).where(F.col("city_rank") <= n)
    return (ranked.select("city", "name", money_out("revenue_raw").alias("revenue"), "city_rank")
            .orderBy("city", "city_rank", "name"))


def top_k_in_group(lines: DataFrame, restaurants: DataFrame, city: str, k: int = TOP_K_IN_CITY,
                   delivered: DataFrame | None = None) -> DataFrame:
    """Top-k restaurants of one city by delivered revenue:
    name, cuisine, rating, orders (distinct orders), revenue. Ties → lower id.

    ``delivered``: the order ids to count, where ``lines`` holds other orders
    too. The city's restaurants filter the lines first, below the join with the
    orders, so only that city's lines are shuffled by order. How the small side
    travels is Spark's choice.
    """
    in_city = restaurants.where(F.col("city") == city)
    lines = lines.join(in_city.select("restaurant_id"), "restaurant_id", "left_semi")
    if delivered is not None:
        lines = lines.join(delivered, "order_id", "left_semi")
    per = lines.groupBy("restaurant_id").agg(
        F.countDistinct("order_id").alias("orders"), F.sum("revenue").alias("revenue_raw"))
    top = (per.join(in_city, "restaurant_id", "inner")
              .orderBy(F.desc("revenue_raw"), F.asc("restaurant_id")).limit(k))
    return top.select("name", "cuisine", "rating", "orders",
                      money_out("revenue_raw").alias("revenue"))


def group_share(lines: DataFrame, restaurants: DataFrame) -> DataFrame:
    """Every restaurant's share of its city's delivered revenue: city,
    restaurant_id, name, revenue, city_revenue, share_pct. City totals are an
    aggregate that is joined back, so no task holds a city's restaurants."""
    rev = restaurant_revenue(lines).join(restaurants.select("restaurant_id", "name", "city"),
                                         "restaurant_id", "inner")
    total = rev.groupBy("city").agg(F.sum("revenue_raw").alias("city_raw"))
    return rev.join(total, "city").select(
        "city", "restaurant_id", "name", money_out("revenue_raw").alias("revenue"),
        money_out("city_raw").alias("city_revenue"),
        pct(F.col("revenue_raw"), F.col("city_raw"), 2).alias("share_pct"))


def _rank_key():
    """(revenue, lowest id) as one exact, order-preserving DECIMAL(38,0): whole
    hundredths of cents * 10^19 + (2^63 - id). A decimal key keeps ``max_by`` in
    hash aggregation, where a struct would force a sort."""
    units = (F.col("revenue_raw") * F.lit(10000)).cast("decimal(19,0)")
    low_id = F.lit(str(2 ** 63 - 1)).cast("decimal(19,0)") - F.col("restaurant_id").cast("decimal(19,0)")
    return (units * F.lit(str(10 ** 18)).cast("decimal(19,0)") * F.lit(10).cast("decimal(2,0)") + low_id).cast("decimal(38,0)")


def group_top_share(lines: DataFrame, restaurants: DataFrame) -> DataFrame:
    """Per restaurant city: its biggest restaurant and that restaurant's share of
    the city's delivered revenue: city, top_restaurant, top_revenue,
    city_revenue, top_share_pct. Plain aggregates, so a city holding a third of
    all restaurants is still combined map-side."""
    rev = restaurant_revenue(lines).join(restaurants.select("restaurant_id", "city"), "restaurant_id", "inner")
    top = rev.groupBy("city").agg(
        F.max_by("restaurant_id", _rank_key()).alias("restaurant_id"),
        F.max("revenue_raw").alias("top_raw"), F.sum("revenue_raw").alias("city_raw"))
    return top.join(restaurants.select("restaurant_id", "name"), "restaurant_id").select(
        "city", F.col("name").alias("top_restaurant"), money_out("top_raw").alias("top_revenue"),
        money_out("city_raw").alias("city_revenue"),
        pct(F.col("top_raw"), F.col("city_raw"), 2).alias("top_share_pct")).orderBy("city")


# ----------------------------------------------------- cancellations ----

def cancellation_by_city(orders: DataFrame, user_city: DataFrame) -> DataFrame:
    """city, total_orders, cancelled_orders, cancel_rate_pct, revenue_at_risk."""
    per_user = orders.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), _count_if(_cancelled()).alias("c"),
        _amount_if(_cancelled()).alias("risk"))
    agg = _with_city(per_user, user_city).groupBy("city").agg(
        F.sum("n").alias("total_orders"), F.sum("c").alias("cancelled_orders"),
        F.sum("risk").alias("risk"))
    return agg.select("city", "total_orders", "cancelled_orders",
                      pct(F.col("cancelled_orders"), F.col("total_orders"), 2).alias("cancel_rate_pct"),
                      money_out("risk").alias("revenue_at_risk")).orderBy(F.desc("cancel_rate_pct"))


def cancellation_by_payment(orders: DataFrame) -> DataFrame:
    """payment_method, total_orders, cancelled_orders, cancel_rate_pct, revenue_at_risk."""
    agg = orders.groupBy("payment_method").agg(
        F.count(F.lit(1)).alias("total_orders"), _count_if(_cancelled()).alias("cancelled_orders"),
        _amount_if(_cancelled()).alias("risk"))
    return agg.select("payment_method", "total_orders", "cancelled_orders",
                      pct(F.col("cancelled_orders"), F.col("total_orders"), 2).alias("cancel_rate_pct"),
                      money_out("risk").alias("revenue_at_risk")).orderBy(F.desc("cancel_rate_pct"))


def cancellation_filtered(orders: DataFrame, user_city: DataFrame, scope: Scope = ALL,
                          ordered: bool = True) -> DataFrame:
    """By user city and by payment method under the filter scope, in one pass
    (GROUPING SETS over one pre-aggregated join): dimension, value, delivered,
    cancelled, revenue_at_risk, cancel_rate_pct."""
    per = (scope.orders(orders).groupBy("user_id", "payment_method")
           .agg(_count_if(_delivered()).alias("d"), _count_if(_cancelled()).alias("c"),
                _amount_if(_cancelled()).alias("risk")))
    joined = _with_city(per, user_city, scope)
    agg = joined.groupingSets([["city"], ["payment_method"]], "city", "payment_method").agg(
        F.sum("d").alias("delivered"), F.sum("c").alias("cancelled"),
        F.sum("risk").alias("risk"), F.grouping("city").alias("g_city"))
    out = agg.select(
        F.when(F.col("g_city") == 0, F.lit("city")).otherwise(F.lit("payment_method")).alias("dimension"),
        F.when(F.col("g_city") == 0, F.col("city")).otherwise(F.col("payment_method")).alias("value"),
        "delivered", "cancelled",
        money_out("risk").alias("revenue_at_risk"),
        pct(F.col("cancelled"), F.col("delivered") + F.col("cancelled"), 2).alias("cancel_rate_pct"),
    )
    return out.orderBy("dimension", F.desc("cancel_rate_pct"), "value") if ordered else out


def revenue_at_risk_total(orders: DataFrame) -> DataFrame:
    """One row: revenue_at_risk, delivered_gmv, risk_to_gmv_pct."""
    agg = orders.agg(_amount_if(_cancelled()).alias("risk"), _amount_if(_delivered()).alias("gmv"))
    return agg.select(money_out("risk").alias("revenue_at_risk"),
                      money_out("gmv").alias("delivered_gmv"),
                      pct(F.col("risk"), F.col("gmv"), 2).alias("risk_to_gmv_pct"))


# --------------------------------------------------------------- KPIs ----

def kpi_overview(orders: DataFrame, user_city: DataFrame, events: DataFrame,
                 scope: Scope = ALL, first_step: str = FUNNEL_STEPS[0],
                 last_step: str = FUNNEL_STEPS[-1], entity=ENTITY) -> DataFrame:
    """One row of headline tiles under the filter scope, each with its
    unfiltered baseline: gmv, delivered_orders, revenue_at_risk,
    conversion_pct, and shares of the unfiltered values.

    Orders are read once: filtered and unfiltered sums are conditional
    aggregates of one per-user pre-aggregate. The funnel tile (platform filter
    only) is another single aggregate, attached as a scalar subquery.
    """
    in_scope = F.coalesce(scope.order_predicate(), F.lit(False))
    per_user = orders.groupBy("user_id").agg(
        _amount_if(_delivered() & in_scope).alias("gmv_in"),
        _count_if(_delivered() & in_scope).alias("orders_in"),
        _amount_if(_cancelled() & in_scope).alias("risk_in"),
        _amount_if(_delivered()).alias("gmv_all"),
        _count_if(_delivered()).alias("orders_all"),
        _amount_if(_cancelled()).alias("risk_all"),
    )
    cities = user_city.select("user_id", "city")
    joined = per_user.join(cities, "user_id", "left")
    city_ok = scope.city_predicate()

    def cond_sum(c):
        return F.sum(F.when(city_ok, F.col(c)))

    totals = joined.agg(
        money_out(cond_sum("gmv_in")).alias("gmv"),
        cond_sum("orders_in").alias("orders"),
        money_out(cond_sum("risk_in")).alias("risk"),
        money_out(F.sum("gmv_all")).alias("full_gmv"),
        F.sum("orders_all").alias("full_orders"),
        money_out(F.sum("risk_all")).alias("full_risk"),
    )

    ev = events.where(F.col("event_name").isin(first_step, last_step))
    plat_ok = F.coalesce(scope.platform_predicate(), F.lit(False))
    ent = list(entity)
    flags = ev.groupBy(*ent).agg(
        F.max((plat_ok & (F.col("event_name") == first_step)).cast("int")).alias("o_in"),
        F.max((plat_ok & (F.col("event_name") == last_step)).cast("int")).alias("p_in"),
        F.max((F.col("event_name") == first_step).cast("int")).alias("o_all"),
        F.max((F.col("event_name") == last_step).cast("int")).alias("p_all"),
    )
    funnel = flags.agg(F.struct(
        F.coalesce(F.sum("o_in"), F.lit(0)).alias("opened"),
        F.coalesce(F.sum("p_in"), F.lit(0)).alias("ordered"),
        F.coalesce(F.sum("o_all"), F.lit(0)).alias("full_opened"),
        F.coalesce(F.sum("p_all"), F.lit(0)).alias("full_ordered"),
    ).alias("f")).scalar()

    # Missing sums read as 0 in the tiles, and missing baselines as 1.
    gmv = F.coalesce(F.col("gmv"), F.lit(0.0))
    n_orders = F.coalesce(F.col("orders"), F.lit(0)).cast("long")
    risk = F.coalesce(F.col("risk"), F.lit(0.0))
    full_gmv = F.coalesce(F.nullif(F.col("full_gmv"), F.lit(0.0)), F.lit(1.0))
    full_orders = F.coalesce(F.nullif(F.col("full_orders"), F.lit(0)), F.lit(1)).cast("long")
    full_risk = F.coalesce(F.nullif(F.col("full_risk"), F.lit(0.0)), F.lit(1.0))
    opened, ordered = funnel.getField("opened"), funnel.getField("ordered")
    f_opened, f_ordered = funnel.getField("full_opened"), funnel.getField("full_ordered")

    def conv(o, n):
        return F.when(n > 0, F.round(hundred() * o / n, 2)).otherwise(F.lit(0.0))

    return totals.select(
        gmv.alias("gmv"),
        n_orders.alias("delivered_orders"),
        risk.alias("revenue_at_risk"),
        opened.cast("long").alias("opened"),
        ordered.cast("long").alias("ordered"),
        conv(ordered, opened).alias("conversion_pct"),
        F.round(hundred() * gmv / full_gmv, 2).alias("gmv_share_pct"),
        F.round(hundred() * n_orders / full_orders, 2).alias("orders_share_pct"),
        F.round(hundred() * risk / full_risk, 2).alias("risk_share_pct"),
        conv(f_ordered, f_opened).alias("full_conversion_pct"),
    )
