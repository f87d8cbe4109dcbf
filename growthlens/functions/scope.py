"""The filter bundle shared by the dashboard-style operators.

Month range, user city, payment method and platform. An empty or missing
selection means "all values", which NULL is not: like any other selection it
drops rows without the value. Order predicates are expressed on the raw
columns so they reach the parquet scan as pushed filters.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame

from growthlens.functions.exprs import in_values, month_range_predicate, where_all


@dataclass(frozen=True)
class Scope:
    month_start: str | None = None   # 'YYYY-MM', inclusive
    month_end: str | None = None     # 'YYYY-MM', inclusive
    cities: tuple[str, ...] | None = None
    payments: tuple[str, ...] | None = None
    platforms: tuple[str, ...] | None = None

    def __post_init__(self):
        for name in ("month_start", "month_end"):
            value = getattr(self, name)
            if value is not None and not re.fullmatch(r"\d{4}-(0[1-9]|1[0-2])", value):
                raise ValueError(f"{name} must be 'YYYY-MM', got {value!r}")
        if self.month_start and self.month_end and self.month_start > self.month_end:
            raise ValueError("month_start is after month_end")
        for name in ("cities", "payments", "platforms"):
            value = getattr(self, name)
            if isinstance(value, str):
                raise ValueError(f"{name} must be a sequence of values, not a single string")

    def orders(self, orders: DataFrame) -> DataFrame:
        """Month range and payment filters on the canonical orders view."""
        return where_all(
            orders,
            month_range_predicate("order_ts", self.month_start, self.month_end),
            in_values("payment_method", self.payments),
        )

    def order_predicate(self):
        """The same order filters as one Column."""
        months = month_range_predicate("order_ts", self.month_start, self.month_end)
        payments = in_values("payment_method", self.payments)
        return payments if months is None else months & payments

    def cities_of(self, user_city: DataFrame) -> DataFrame:
        return where_all(user_city, in_values("city", self.cities))

    def city_predicate(self):
        return in_values("city", self.cities)

    def platform_predicate(self):
        return in_values("platform", self.platforms)


ALL = Scope()


def filter_scope(orders: DataFrame, user_city: DataFrame, scope: Scope) -> DataFrame:
    """Orders inside ``scope`` with the user's city attached (inner join, as the
    dashboards join orders to users)."""
    scoped = scope.orders(orders)
    return scoped.join(scope.cities_of(user_city.select("user_id", "city")), "user_id", "inner")
