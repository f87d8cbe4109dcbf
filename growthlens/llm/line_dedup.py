"""Line deduplication: explode normalised lines, hash them, count the distinct
documents of each hash, drop the lines over the threshold, reassemble by position.

DataFrame functions only. Lines travel as (id, position, 128-bit hash); whole
texts are shuffled once, for the reassembly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, ascii_lower, materialize, text_of

MIN_DOCS, MIN_CHARS = 2, 10


def _lines(column: str) -> Column:
    return F.split(text_of(column), "\n")


def _reassembled(lines: Column, cut: Column) -> Column:
    """``lines`` without the sorted positions ``cut``: the runs between two
    cuts are sliced out and put together, in time linear in the lines."""
    bounds = F.concat(F.array(F.lit(-1)), cut, F.array(F.size(lines)))
    run = F.transform(
        F.sequence(F.lit(0), F.size(cut)),
        lambda k: F.slice(lines, F.get(bounds, k) + 2, F.get(bounds, k + 1) - F.get(bounds, k) - 1))
    return F.flatten(run)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with repeated lines cut from ``text_col``, plus n_lines (before)
    and n_dropped.

    A line's key is the line stripped of ASCII white space at both ends, A-Z
    lower-cased. Keys of at least ``min_chars`` code points that occur in at
    least ``min_docs`` documents keep their lines only in the smallest id that
    holds the key (all its lines there). A null or empty text is one empty
    line and comes out empty. Rows with a null id are neither counted nor
    changed. Rows that share an id are one document for the count; each is cut
    by its own text. Other columns pass through untouched, whatever their names.
    """
    own = F.xxhash64(text_of(text_col)).alias("__ld_text")
    key = ascii_lower(F.btrim(F.col("__ld_line"), F.lit(SPACE)))
    lines = (docs.select(F.col(id_col).alias("__ld_id"), own,
                         F.posexplode(_lines(text_col)).alias("__ld_pos", "__ld_line"))
             .filter(F.col("__ld_id").isNotNull())
             .withColumn("__ld_key", key)
             .filter(F.char_length("__ld_key") >= min_chars)
             .select("__ld_id", "__ld_text", "__ld_pos", F.unhex(F.md5("__ld_key")).alias("__ld_hash")))
    # Written out: the join then reads it by a fresh exchange, and the rows of
    # a very common line are split over tasks.
    repeated = materialize(
        lines.groupBy("__ld_hash")
        .agg(F.countDistinct("__ld_id").alias("__ld_docs"), F.min("__ld_id").alias("__ld_owner"))
        .filter(F.col("__ld_docs") >= min_docs).select("__ld_hash", "__ld_owner"), "lines")
    cuts = (lines.join(repeated, "__ld_hash")
            .filter(F.col("__ld_id") != F.col("__ld_owner"))
            .groupBy("__ld_id", "__ld_text")
            .agg(F.array_sort(F.collect_set("__ld_pos")).alias("__ld_cut")))
    cut = F.col("__ld_cut")
    joined = docs.withColumn("__ld_own", own).join(
        cuts, (F.col(id_col) == cuts["__ld_id"]) & (F.col("__ld_own") == cuts["__ld_text"]), "left")
    kept = (F.when(cut.isNull(), text_of(text_col))
            .otherwise(F.array_join(_reassembled(_lines(text_col), cut), "\n")))
    return joined.select(
        *[kept.alias(c) if c == text_col else docs[c] for c in docs.columns
          if c not in ("n_lines", "n_dropped")],
        F.size(_lines(text_col)).cast("long").alias("n_lines"),
        F.coalesce(F.size(cut), F.lit(0)).cast("long").alias("n_dropped"))
