"""Plan inspection helpers (what `.explain()` shows), used by the plan tests
and handy when reviewing an operator's physical plan."""

from __future__ import annotations

import contextlib
import io
import re

from pyspark.sql import DataFrame


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


def operator_tree(df: DataFrame) -> list[str]:
    """The operator names of the physical plan tree, top-down."""
    tree = plan_text(df).split("\n\n")[0]
    return [m.group(1) for m in re.finditer(r"([A-Z][A-Za-z]+(?: [A-Za-z]+)*) \(\d+\)", tree)]


def pushed_filters(df: DataFrame) -> list[str]:
    return re.findall(r"PushedFilters: \[(.*)\]", plan_text(df))


def read_schemas(df: DataFrame) -> list[str]:
    return re.findall(r"ReadSchema: (struct<.*>)", plan_text(df))
