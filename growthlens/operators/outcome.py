"""First-event → outcome bucketing: does the attribute of a user's first
delivered order predict a repeat order?

One hash aggregate per user replaces the ROW_NUMBER window, the second scan
and the join: ``min_by(attr, key(order_date, order_id))`` picks the first
order's attribute (ties on date broken by order id) and ``count`` the
delivered orders, both combined map-side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from growthlens.functions.exprs import bucketize, pct
from growthlens.fixed_values import FIRST_ORDER_LABELS, FIRST_ORDER_SPLITS, REORDER_MIN_COUNT


def order_key(date_col: str = "order_date", id_col: str = "order_id"):
    """(date, id) as one exact, order-preserving DECIMAL(38,0):
    days since 1970 * 10^20 + (id + 2^63). Any date and any 64-bit id map
    monotonically, and a decimal ordering key keeps ``min_by`` in hash
    aggregation (a struct key would force a sort-based aggregate)."""
    date = F.col(date_col) if isinstance(date_col, str) else date_col
    days = F.datediff(date, F.lit("1970-01-01").cast("date")).cast("decimal(10,0)")
    shifted = F.col(id_col).cast("decimal(20,0)") + F.lit(str(2 ** 63)).cast("decimal(20,0)")
    return (days * F.lit(str(10 ** 20)).cast("decimal(21,0)") + shifted).cast("decimal(38,0)")


def first_event_per_user(orders: DataFrame, value_col: str = "order_amount") -> DataFrame:
    """(user_id, first_value, n_delivered) over delivered orders; the first
    order is the earliest date, ties broken by the lower order id."""
    return (orders.where(F.col("is_delivered")).groupBy("user_id").agg(
        F.min_by(F.col(value_col), order_key()).alias("first_value"),
        F.count(F.lit(1)).alias("n_delivered")))


def first_event_outcome(orders: DataFrame, splits: Sequence[float] = FIRST_ORDER_SPLITS,
                        labels: Sequence[str] = FIRST_ORDER_LABELS, min_count: int = REORDER_MIN_COUNT,
                        value_col: str = "order_amount", ordered: bool = True) -> DataFrame:
    """first_order_bucket, users, reordered (≥ min_count delivered orders),
    did_not_reorder, reorder_rate_pct."""
    per_user = first_event_per_user(orders, value_col)
    b = per_user.select(bucketize("first_value", splits, labels).alias("first_order_bucket"),
                        (F.col("n_delivered") >= min_count).cast("int").alias("re"))
    agg = b.groupBy("first_order_bucket").agg(
        F.count(F.lit(1)).alias("users"),
        F.sum("re").cast("long").alias("reordered"),
        F.sum(F.lit(1) - F.col("re")).cast("long").alias("did_not_reorder"))
    out = agg.select("first_order_bucket", "users", "reordered", "did_not_reorder",
                     pct(F.col("reordered"), F.col("users"), 2).alias("reorder_rate_pct"))
    return out.orderBy("first_order_bucket") if ordered else out
