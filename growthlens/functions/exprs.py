"""Column helpers shared by every operator.

All of them build built-in Catalyst expressions (JVM side, whole-stage codegen);
none is a Python UDF.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# A double literal: `100.0 * bigint / bigint` must stay DOUBLE (never DECIMAL).
def hundred() -> Column:
    return F.lit(100.0)


# Money is summed exactly: amounts as cents (DECIMAL), so a total does not
# depend on the order Spark happens to add rows in (partitioning, retries),
# and equal totals stay equal for ranking. Results leave as rounded doubles.
MONEY = "decimal(18,2)"


def money(c) -> Column:
    return col(c).cast(MONEY)


def money_sum(c) -> Column:
    return F.sum(money(c))


def money_out(c) -> Column:
    """A money total as the double of its value rounded (HALF_UP) to cents."""
    return F.round(col(c), 2).cast("double")


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pct(num, den, digits: int | None = 2) -> Column:
    """round(100.0 * num / den, digits); NULL on a zero denominator."""
    value = F.try_divide(hundred() * col(num), col(den))
    return value if digits is None else F.round(value, digits)


def month_key(date_col) -> Column:
    """'YYYY-MM' month key of a date/timestamp column (string)."""
    return F.date_format(col(date_col), "yyyy-MM")


def parse_month(ym: str) -> _dt.date:
    year, month = int(ym[:4]), int(ym[5:7])
    return _dt.date(year, month, 1)


def add_months(d: _dt.date, n: int) -> _dt.date:
    total = d.year * 12 + (d.month - 1) + n
    return _dt.date(total // 12, total % 12 + 1, 1)


def ntz_literal(d: _dt.date) -> Column:
    """TIMESTAMP_NTZ literal at midnight of ``d`` (independent of session time zone)."""
    return F.expr(f"TIMESTAMP_NTZ '{d.isoformat()} 00:00:00'")


def month_range_predicate(ts_col, month_start: str | None, month_end: str | None) -> Column | None:
    """Inclusive 'YYYY-MM'..'YYYY-MM' range as a half-open range on the raw
    timestamp, so the bounds reach the parquet reader as pushed filters."""
    preds = []
    if month_start:
        preds.append(col(ts_col) >= ntz_literal(parse_month(month_start)))
    if month_end:
        preds.append(col(ts_col) < ntz_literal(add_months(parse_month(month_end), 1)))
    return _and_all(preds)


def in_values(c, values: Sequence | None) -> Column:
    """``c IN (values)``; an empty or missing selection means every value that
    there is to select, so NULLs drop out as they do from any selection."""
    return col(c).isin(list(values)) if values else col(c).isNotNull()


def _and_all(preds) -> Column | None:
    preds = [p for p in preds if p is not None]
    if not preds:
        return None
    out = preds[0]
    for p in preds[1:]:
        out = out & p
    return out


def where_all(df: DataFrame, *preds) -> DataFrame:
    pred = _and_all(preds)
    return df if pred is None else df.where(pred)


def bucketize(value, splits: Sequence[float], labels: Sequence[str]) -> Column:
    """Searched CASE: first label whose upper split the value is below, else the last."""
    if len(labels) != len(splits) + 1:
        raise ValueError("need len(splits) + 1 labels")
    expr = None
    for split, label in zip(splits, labels):
        cond = col(value) < F.lit(split)
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr.otherwise(labels[-1]) if expr is not None else F.lit(labels[-1])

