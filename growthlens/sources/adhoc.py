"""Ad-hoc SQL over the canonical views, with bound parameters and a capped fetch.

``spark.sql`` already is the query engine: DataFrames are passed as ``{name}``
placeholders (query-scoped views, nothing registered globally), values as
``:name`` parameter markers (never spliced into the text), and the parser
rejects multi-statement text. ``capped`` is for pages that show a bounded number
of rows.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from growthlens.sources import views
from growthlens.sources.tables import Tables

from growthlens.fixed_values import ROW_LIMIT


def canonical_frames(t: Tables) -> dict[str, DataFrame]:
    """The analytic model's tables, by the names ad-hoc SQL uses."""
    return {
        "orders": views.orders(t),
        "users": views.user_city(t),
        "restaurants": views.restaurants(t),
        "order_lines": views.delivered_lines(t),
        "app_events": views.app_events(t),
    }


def run_sql(spark: SparkSession, sql: str, args: Mapping[str, Any] | None = None,
            frames: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """``spark.sql(sql, args, **frames)``: ``{name}`` resolves to a frame,
    ``:name`` to a bound value.

    A list, tuple or set is bound as the values of an IN list (``c IN (:name)``),
    each a parameter of its own, so that the predicate reaches the scan. An empty
    one matches nothing.
    """
    text, bound = _expanded(sql, dict(args or {}))
    return spark.sql(text, args=bound, **dict(frames or {}))


#: What a marker may not be part of: quoted text, quoted names and comments.
_TOKENS = re.compile(r"""'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.)*"|`[^`]*`|--[^\n]*|/\*.*?\*/|::|:(?P<marker>[A-Za-z_]\w*)""", re.S)


def _expanded(sql: str, args: dict[str, Any]) -> tuple[str, dict[str, Any]]:
    """The text with every list marker as one marker per value, and all values
    by marker. Values never enter the text."""
    lists = {k: list(v) for k, v in args.items() if isinstance(v, (list, tuple, set, frozenset))}
    names = {k: [f"{k}__{i}" for i in range(len(v))] for k, v in lists.items()}
    bound = {k: v for k, v in args.items() if k not in lists}
    for k, own in names.items():
        for name, value in zip(own, lists[k]):
            if name in args:
                raise ValueError(f"parameter {name} is taken by the values of {k}")
            bound[name] = value

    def marker(m: re.Match) -> str:
        own = names.get(m["marker"])
        return m[0] if own is None else ", ".join(f":{n}" for n in own) or "NULL"

    return _TOKENS.sub(marker, sql), bound


def capped(df: DataFrame, order: Sequence[Column], row_limit: int = ROW_LIMIT) -> DataFrame:
    """The first ``row_limit`` rows of ``df`` by ``order``, plus a ``truncated``
    flag. ``order`` must be total (end it with a unique key), so that which rows
    are shown does not depend on the run.

    The window counts the at most row_limit + 1 rows the limit lets through.
    """
    if not order:
        raise ValueError("a capped fetch needs an order")
    head = df.orderBy(*order).limit(row_limit + 1)
    flagged = head.withColumn("truncated", F.count(F.lit(1)).over(Window.partitionBy()) > row_limit)
    return flagged.orderBy(*order).limit(row_limit)
