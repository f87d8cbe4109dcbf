"""Exact NTILE without a single-partition window, and the concentration
operators (power users, Pareto split, concentration ratio, GMV by tile). Where
only the first tile's size and sum are wanted, ``top_tile`` selects instead.

``NTILE(N) OVER (ORDER BY ...)`` with no PARTITION BY moves every row into one
task. ``distributed_ntile`` computes the identical assignment in parallel:

1. quantile bounds of the value and of the key, one small aggregate. They only
   have to be some fixed numbers: any bounds give the same ranks;
2. a row's bucket is its place among the bounds. Rows whose value equals a
   bound are a bucket of their own (a value that many rows share is bound to be
   one), split further by the key's bounds;
3. counts per bucket (bounded by the number of bounds) give each bucket's
   offset, and the rank is offset + row number within the bucket;
4. with n rows, q = n div N, r = n mod N, the first r tiles hold q+1 rows:
   tile = ceil(i/(q+1)) if i <= r(q+1) else r + ceil((i - r(q+1))/q).

Nothing is written or collected, and a recomputed stage gives the same ranks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from growthlens.fixed_values import N_TILES, POWER_USER_LIMIT, REST_SEGMENT, TOP_SEGMENT
from growthlens.functions.exprs import hundred, money_out, money_sum, pct

#: The value has FANOUT ** 2 - 1 quantile bounds, the key as many for its own
#: (smaller) fan-out.
FANOUT, KEY_FANOUT = 32, 8


def _quantiles(column: str, fanout: int) -> Column:
    n = fanout ** 2
    return F.percentile_approx(column, [i / n for i in range(1, n)], 10 * max(n, 100))


def _below(bounds: Column, fanout: int, value: Column) -> Column:
    """How many of the sorted ``bounds`` are smaller: first among every
    ``fanout``-th, then among those between two of them."""
    every = F.transform(F.sequence(F.lit(1), F.lit(fanout - 1)), lambda i: F.get(bounds, i * fanout - 1))
    coarse = F.size(F.filter(every, lambda b: b < value)) * fanout
    return coarse + F.size(F.filter(F.slice(bounds, coarse + 1, F.lit(fanout - 1)), lambda b: b < value))


def distributed_ntile(df: DataFrame, n_tiles: int, value: str, key: str,
                      fanout: int = FANOUT, key_fanout: int = KEY_FANOUT) -> DataFrame:
    """``df`` plus ``rank_pos`` (1..n) and ``tile`` (1..n_tiles), equal to
    ``row_number()`` / ``ntile(n_tiles)`` over ``ORDER BY value DESC, key``.
    ``value`` is numeric and not null; ``key`` is a unique number."""
    limits = df.select(F.struct(_quantiles(value, fanout).alias("v"), _quantiles(key, key_fanout).alias("k"))).scalar()
    # Bounds have the columns' own types: what equals a bound equals it exactly.
    below = df.withColumn("_limits", limits).withColumn("_below", _below(F.col("_limits.v"), fanout, F.col(value)))
    on_bound = F.coalesce(F.get(F.col("_limits.v"), F.col("_below")) == F.col(value), F.lit(False))
    # Descending by value: even numbers lie between bounds, odd ones on them.
    tagged = below.withColumn("_place", -2 * F.col("_below") - on_bound.cast("int")).withColumn(
        "_part", F.when(on_bound, _below(F.col("_limits.k"), key_fanout, F.col(key))).otherwise(0)).drop("_limits")
    counts = tagged.groupBy("_place", "_part").agg(F.count(F.lit(1)).alias("_cnt"))
    # Bounded: a row per value bound, and per key bound on each.
    before = Window.orderBy("_place", "_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_place", "_part", F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off"),
        F.sum("_cnt").over(Window.partitionBy()).alias("_n"))
    within = F.row_number().over(Window.partitionBy("_place", "_part").orderBy(F.desc(value), F.asc(key)))
    ranked = (tagged.withColumn("_row", within)
              .join(F.broadcast(offsets), ["_place", "_part"], "inner")
              .withColumn("rank_pos", F.col("_off") + F.col("_row")))
    i, n = F.col("rank_pos"), F.col("_n")
    q = F.floor(n / F.lit(n_tiles)).cast("long")
    r = (n % F.lit(n_tiles)).cast("long")
    big = r * (q + 1)
    tile = (F.when(q == 0, i)
             .when(i <= big, F.ceil(i / (q + 1)))
             .otherwise(r + F.ceil((i - big) / q))).cast("int")
    return ranked.withColumn("tile", tile).drop("_below", "_place", "_part", "_row", "_off", "_n")


def user_gmv(orders: DataFrame) -> DataFrame:
    """(user_id, orders, user_gmv_raw) over delivered orders (partial aggregation)."""
    return (orders.where(F.col("is_delivered")).groupBy("user_id")
            .agg(F.count(F.lit(1)).alias("orders"), money_sum("order_amount").alias("user_gmv_raw")))


def power_users(orders: DataFrame, n_tiles: int = N_TILES, limit: int = POWER_USER_LIMIT) -> DataFrame:
    """The first ``limit`` users of the top tile by delivered GMV:
    user_id, orders, user_gmv. Ties on GMV go to the lower user_id.

    A top-k; the first of N tiles of n rows holds ceil(n / N) of them."""
    per_user = user_gmv(orders)
    first_tile = per_user.select(F.ceil(F.count(F.lit(1)) / F.lit(n_tiles))).scalar()
    by = [F.desc("user_gmv_raw"), F.asc("user_id")]
    top = per_user.orderBy(*by).limit(limit)
    ranked = top.withColumn("place", F.row_number().over(Window.orderBy(*by)))  # of ``limit`` rows
    return (ranked.where(F.col("place") <= first_tile).orderBy("place")
            .select("user_id", "orders", money_out("user_gmv_raw").alias("user_gmv")))


#: A value's range is a whole number that never falls as the value rises, NULL
#: below all: 65,536 ranges per e-fold.
_TOP_TILE = """
WITH placed AS (
  SELECT v, coalesce(CAST(sign(v) AS INT) * CAST(floor(ln(abs(CAST(v AS DOUBLE)) + 1) * 65536) AS BIGINT), -(1L << 62)) AS range
  FROM {values}),
ranges AS (SELECT range, count(*) AS held, sum(v) AS held_sum FROM placed GROUP BY range),
sized AS (
  SELECT range, held, coalesce(sum(held) OVER above, 0) AS before, sum(held_sum) OVER above AS sum_before,
         sum(held) OVER () AS n, sum(held_sum) OVER () AS total
  FROM ranges WINDOW above AS (ORDER BY range DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cut AS (
  SELECT range, n, total, sum_before, (n + :tiles - 1) div :tiles AS top_n, (n + :tiles - 1) div :tiles - before AS need
  FROM sized WHERE before < (n + :tiles - 1) div :tiles AND before + held >= (n + :tiles - 1) div :tiles),
inside AS (
  SELECT /*+ BROADCAST(cut) */ v, top_n, n, total, sum_before, need, count(*) AS held
  FROM placed JOIN cut USING (range) GROUP BY ALL),
taken AS (
  SELECT *, greatest(0, least(held, need - coalesce(sum(held) OVER (
    ORDER BY v DESC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS took FROM inside)
SELECT top_n, coalesce(first(sum_before), 0) + coalesce(sum(v * took), 0) AS top_sum, n, total
FROM taken GROUP BY top_n, n, total"""


def top_tile(df: DataFrame, n_tiles: int, value: str) -> DataFrame:
    """One row on the first of ``n_tiles`` tiles of ``df`` by ``value``
    descending: top_n, top_sum, n, total (none for an empty ``df``). Equal to
    sums over ``ntile(n_tiles)``: whichever of tied rows are taken, the sum is one.

    Counts and sums per value range say which range holds the cut, one row and
    so a bounded broadcast; only that range's values are ranked, equal ones as
    one. Ranges are as many as the values' spread asks for, not as their number.
    """
    return df.sparkSession.sql(_TOP_TILE, args={"tiles": n_tiles}, values=df.select(F.col(value).alias("v")))


def pareto_split(orders: DataFrame, n_tiles: int = N_TILES) -> DataFrame:
    """Top tile vs the rest: segment, users, segment_gmv, pct_of_total_gmv."""
    top = top_tile(user_gmv(orders), n_tiles, "user_gmv_raw")
    total = F.coalesce(F.col("total"), F.lit(0))
    segments = F.inline(F.array(
        F.struct(F.lit(TOP_SEGMENT).alias("segment"), F.col("top_n").alias("users"), F.col("top_sum").alias("gmv_raw")),
        F.struct(F.lit(REST_SEGMENT).alias("segment"), (F.col("n") - F.col("top_n")).alias("users"),
                 (total - F.col("top_sum")).alias("gmv_raw"))))
    rows = top.select("total", segments).where(F.col("users") > 0)
    return rows.select("segment", "users", money_out("gmv_raw").alias("segment_gmv"),
                       F.round(F.try_divide(hundred() * F.col("gmv_raw"), F.col("total")), 2)
                       .alias("pct_of_total_gmv")).orderBy("segment")


def concentration_ratio(orders: DataFrame, n_tiles: int = N_TILES) -> DataFrame:
    """One row: top-tile users, all users, the top tile's GMV share and
    population share (%), and their ratio (how many times its head count)."""
    agg = top_tile(user_gmv(orders), n_tiles, "user_gmv_raw").agg(
        F.coalesce(F.max("top_n"), F.lit(0)).alias("top_users"), F.coalesce(F.max("n"), F.lit(0)).alias("total_users"),
        F.max("top_sum").alias("top_gmv"), F.max("total").alias("total_gmv"))
    gmv_share = F.try_divide(F.col("top_gmv").cast("double"), F.col("total_gmv"))
    pop_share = F.try_divide(F.col("top_users").cast("double"), F.col("total_users"))
    return agg.select(
        "top_users", "total_users",
        pct(F.col("top_gmv"), F.col("total_gmv"), 2).alias("top_gmv_share_pct"),
        pct(F.col("top_users"), F.col("total_users"), 2).alias("population_share_pct"),
        F.round(F.try_divide(gmv_share, pop_share), 2).alias("concentration_ratio"))


def gmv_by_tile(orders: DataFrame, n_tiles: int = N_TILES) -> DataFrame:
    """Per tile of users by delivered GMV: tile, users, tile_gmv, and the largest
    and smallest GMV in it. Ties go by user_id, so every user has one tile."""
    tiled = distributed_ntile(user_gmv(orders), n_tiles, "user_gmv_raw", "user_id")
    return tiled.groupBy("tile").agg(
        F.count(F.lit(1)).alias("users"), money_out(F.sum("user_gmv_raw")).alias("tile_gmv"),
        money_out(F.max("user_gmv_raw")).alias("largest_gmv"), money_out(F.min("user_gmv_raw")).alias("smallest_gmv")).orderBy("tile")
