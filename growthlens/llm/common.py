"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ``[\x20\x09-\x0D]``, the white space of every operator here.
SPACE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes handled by one numpy pass; a longer single text is one pass of its own.
SLICE_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder for written intermediates: ``spark.checkpoint.dir`` of the
    session. Only a local-mode session without that setting gets its own."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set; point it at a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="growthlens-llm-"))
    return sc.getCheckpointDir()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back.

    Cuts the lineage so that a lost executor costs a reread, and gives later
    joins a plain scan, whose skewed partitions Spark can split. The folder goes
    with ``discard``, or when the session's file system closes.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/llm-{uuid.uuid4().hex}-{name}"
    df.write.parquet(path)
    hadoop, fs = _at(spark, path)
    fs.deleteOnExit(hadoop)
    out = spark.read.schema(df.schema).parquet(path)
    out._growthlens_path = path
    return out


def _at(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def discard(*written: DataFrame) -> None:
    """Remove what ``materialize`` wrote, once nothing reads it any more: what was
    made from it is written itself."""
    for df in written:
        hadoop, fs = _at(df.sparkSession, df._growthlens_path)
        fs.delete(hadoop, True)


def _ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that tasks
    import it where only the driver has it."""
    sc = spark.sparkContext
    if getattr(sc, "_growthlens_shipped", False):
        return
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = os.path.realpath(tempfile.mkdtemp(prefix="growthlens-py-"))
    sc.addPyFile(shutil.make_archive(f"{folder}/growthlens", "zip", os.path.dirname(here), os.path.basename(here)))
    sc._growthlens_shipped = True


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
              schema: str) -> DataFrame:
    """``mapInArrow`` with this package on the executors. A worker gives back
    what a task leaves unused: it serves the next stage too."""
    _ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            _give_back()

    return df.mapInArrow(run, schema)


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased and nothing else; ``lower`` is the fast form where the
    string is all ASCII."""
    return (F.when(F.octet_length(c) == F.char_length(c), F.lower(c))
            .otherwise(F.translate(c, _UPPER, _LOWER)))


def text_of(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def utf8(array: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying; null is empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = pc.fill_null(array, "").cast(pa.large_string())
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset:array.offset + len(array) + 1]
    raw = array.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data, offsets


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of at most ``limit`` bytes, or of one row."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = b
