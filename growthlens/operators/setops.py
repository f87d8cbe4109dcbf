"""Set-style operators: entities without activity, and a two-way dataset diff."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType


def entities_without_activity(entities: DataFrame, activity: DataFrame,
                              on: str | Sequence[str]) -> DataFrame:
    """Rows of ``entities`` with no matching row in ``activity`` (NOT EXISTS).

    A left-anti join against the *distinct* activity keys: de-duplication is
    combined map-side, so a key holding a third of all activity rows reaches
    the join as one row per map task instead of sitting in one join task.
    """
    keys = [on] if isinstance(on, str) else list(on)
    return entities.join(activity.select(*keys).distinct(), keys, "left_anti")


def _grouped(c: str, kind: DataType) -> Column:
    """A key on which equal values meet: entries in key order for maps, at any
    depth. Spark itself takes -0.0 for 0.0 and any NaN for any other."""

    def key(value: Column, kind: DataType) -> Column:
        if not _holds_map(kind):
            return value
        if isinstance(kind, MapType):
            entries = F.transform(F.map_entries(value), lambda e: F.struct(
                key(e["key"], kind.keyType).alias("key"), key(e["value"], kind.valueType).alias("value")))
            return F.array_sort(entries)
        if isinstance(kind, ArrayType):
            return F.transform(value, lambda x: key(x, kind.elementType))
        return F.when(value.isNotNull(), F.struct(*[key(value[f.name], f.dataType).alias(f.name) for f in kind.fields]))

    return key(F.col(f"`{c}`"), kind)


def _holds_map(kind: DataType) -> bool:
    return (isinstance(kind, MapType) or (isinstance(kind, ArrayType) and _holds_map(kind.elementType))
            or (isinstance(kind, StructType) and any(_holds_map(f.dataType) for f in kind.fields)))


def schema_diff(a: DataFrame, b: DataFrame) -> list[tuple[str, str]]:
    """(column, side) for every column that only one of the two has, or that
    both have with different types; a's columns first, in order."""
    types = {c: dict(df.dtypes) for c, df in (("a", a), ("b", b))}
    found = [(c, "column_only_in_a" if c not in types["b"] else "column_type_differs")
             for c in a.columns if types["b"].get(c) != types["a"][c]]
    return found + [(c, "column_only_in_b") for c in b.columns if c not in types["a"]]


def dataset_diff(a: DataFrame, b: DataFrame, side_col: str = "side",
                 copies_col: str = "copies", column_col: str = "column_name") -> DataFrame:
    """Rows that ``a`` has more often than ``b`` or the other way round, tagged
    'only_in_a' / 'only_in_b', with how many copies more. Empty when the two
    are equal as multisets.

    Rows are compared on the columns of both, in a's order; values of different
    types as text. Where the schemas differ, each differing column is one more
    row: its name in ``column_col`` (NULL for data rows), 'column_only_in_a',
    'column_only_in_b' or 'column_type_differs', and 0 copies.

    One pass: each row counts +1 or -1, and equal rows are summed, combined
    map-side, so a row held a billion times is one row per map task. Copies are
    a number, not repeated rows. Maps are equal when their entries are, NaN
    equals NaN and -0.0 equals 0.0.
    """
    differing = schema_diff(a, b)
    types, others = dict(a.dtypes), dict(b.dtypes)
    columns = [c for c in a.columns if c in others]
    kinds = {f.name: f.dataType for f in a.schema.fields}

    def signed(df: DataFrame, sign: int) -> DataFrame:
        values = [F.col(f"`{c}`") if types[c] == others[c] else F.col(f"`{c}`").cast("string").alias(c) for c in columns]
        return df.select(*values, F.lit(sign).cast("long").alias("_sign"))

    rows = signed(a, 1).union(signed(b, -1))
    mapped = [c for c in columns if types[c] == others[c] and _holds_map(kinds[c])]
    keys = [_grouped(c, kinds[c]).alias(f"_key_{c}") if c in mapped else F.col(f"`{c}`") for c in columns]
    more = (rows.groupBy(*keys).agg(F.sum("_sign").alias("_more"), *[F.any_value(F.col(f"`{c}`")).alias(c) for c in mapped])
            .where(F.col("_more") != 0))
    shown = [F.col(f"`{c}`") for c in columns]
    side = F.when(F.col("_more") > 0, "only_in_a").otherwise("only_in_b").alias(side_col)
    copies = F.abs("_more").alias(copies_col)
    if not differing:
        return more.select(*shown, side, copies)
    found = more.select(*shown, F.lit(None).cast("string").alias(column_col), side, copies)
    listed = a.sparkSession.createDataFrame(differing, f"{column_col} string, {side_col} string").withColumn(copies_col, F.lit(0).cast("long"))
    return found.unionByName(listed, allowMissingColumns=True)
