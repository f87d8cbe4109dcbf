"""Catalog-style sources: row counts per table, distinct dimension values,
and a schema listing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from growthlens.functions.exprs import month_key
from growthlens.sources.tables import Tables


def table_row_counts(frames: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, n) for each named frame: one global count per frame
    (answered from parquet footers for plain scans), unioned."""
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
             for name, df in frames.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def table_row_counts_of_files(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """(table_name, n) for parquet tables by path, all in one scan that reads no
    column: rows are counted from the files' footers and told apart by file. A
    table without rows counts 0."""
    # File URIs may spell the root with one slash or three.
    plain = lambda c: F.regexp_replace(c, "^([a-z0-9]+):/+", "$1:/")
    owner = F.lit(None).cast("string")
    for name, path in sorted(paths.items(), key=lambda x: len(x[1])):  # of nested paths the longest comes first
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        root = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()
        owner = F.when(F.startswith("file", plain(F.lit(root))), name).otherwise(owner)
    files = spark.read.schema("_none boolean").parquet(*paths.values()).select(plain(F.col("_metadata.file_path")).alias("file"))
    counts = files.groupBy("file").agg(F.count(F.lit(1)).alias("n")).select(owner.alias("table_name"), "n")
    none = spark.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("table_name"), F.lit(0).cast("long").alias("n")) for name in paths])))
    return counts.union(none).groupBy("table_name").agg(F.sum("n").alias("n"))


def dimension_values(orders: DataFrame, user_city: DataFrame, events: DataFrame) -> DataFrame:
    """(dimension, value): the selectable months, user cities, payment methods
    and platforms, as in the dashboards' filter lists."""
    of = lambda name, value: F.struct(F.lit(name).alias("dimension"), value.alias("value"))
    # Both order dimensions in one scan; equal values meet map-side.
    parts = [
        orders.select(F.inline(F.array(of("month", month_key("order_date")), of("payment_method", F.col("payment_method"))))),
        user_city.select(F.lit("city").alias("dimension"), F.col("city").alias("value")),
        events.select(F.lit("platform").alias("dimension"), F.col("platform").alias("value")),
    ]
    out = parts[0].distinct()
    for p in parts[1:]:
        out = out.unionByName(p.distinct())
    return out.orderBy("dimension", "value")


def schema_listing(tables: Tables, names: Sequence[str]) -> list[tuple[str, str]]:
    """(table, DDL-style column list) per table, from the parquet schemas."""
    return [(name, tables.table(name).schema.simpleString()) for name in sorted(names)]
