"""Result sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def write_result(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                 partition_by: list[str] | None = None) -> None:
    """Write an operator result (parquet by default) to any Hadoop-compatible URI."""
    w = df.write.mode(mode).format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def written_and_read(df: DataFrame, name: str, root: str | None = None) -> DataFrame:
    """``df`` written by the sink, and read back from there. A sink is an action,
    so this one runs when called. The folder lies in the cluster's shared one
    (``spark.checkpoint.dir``, else the warehouse) and goes when the session's
    file system closes."""
    spark = df.sparkSession
    root = root or spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{root.rstrip('/')}/growthlens-{name}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    write_result(df, path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)
