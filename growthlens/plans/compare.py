"""Compare a registered Spark query with its DuckDB oracle.

Row count, column names and an order-insensitive multiset of values (floats
rounded to 6 decimals, NaN/inf spelled out, dates as ISO strings).
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        if math.isinf(v):
            return "inf" if v > 0 else "-inf"
        return round(v, 6) + 0.0
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def canonical_rows(rows) -> list[tuple]:
    return sorted(tuple(str(_norm(x)) for x in r) for r in rows)


@dataclass
class Outcome:
    name: str
    ok: bool
    spark_rows: int
    oracle_rows: int | None = None
    detail: str = ""
    spark_types: dict = field(default_factory=dict)


def compare(name: str, df: DataFrame, con, sql: str) -> Outcome:
    cols = sorted(df.columns)
    srows = [tuple(r[c] for c in cols) for r in df.collect()]
    stypes = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    rel = con.sql(sql)
    dcols = list(rel.columns)
    if sorted(dcols) != cols:
        return Outcome(name, False, len(srows), None, f"columns spark={cols} oracle={sorted(dcols)}",
                       stypes)
    idx = {c: i for i, c in enumerate(dcols)}
    drows = [tuple(r[idx[c]] for c in cols) for r in rel.fetchall()]
    a, b = canonical_rows(srows), canonical_rows(drows)
    if a == b:
        return Outcome(name, True, len(srows), len(drows), "", stypes)
    only_a = [r for r in a if r not in b][:3]
    only_b = [r for r in b if r not in a][:3]
    return Outcome(name, False, len(srows), len(drows),
                   f"cols={cols} spark-only={only_a} oracle-only={only_b}", stypes)


def duckdb_views(con, sf_dir: str, tables) -> None:
    """One DuckDB view per table; a table may be one parquet file or a
    directory of parts (as Spark writes it). Missing tables are skipped."""
    import os
    for t in tables:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.isdir(path):
            path = f"{path}/*.parquet"
        elif not os.path.exists(path):
            continue
        con.execute(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
