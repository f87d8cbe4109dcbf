"""Training corpus pipeline over ``documents``.

``STAGES`` are (name, function) pairs; a function takes (spark, docs, sf_dir)
and returns what it kept, which is written and read again before the next
stage. All but the last return the columns of ``docs``; ``n_chars``, where
there, follows the text. Columns that the operators add themselves never reach
the output, so extra columns of any name pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from growthlens.llm import decontaminate, jaccard_join, line_dedup, packing, quality_rules
from growthlens.llm.common import discard, materialize, table

#: Near-duplicate documents: shingles of five words, Jaccard similarity 0.8.
SHINGLE_WORDS, SIMILAR, OF = 5, 80, 100


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects. A null or empty text fails the
    length rule; repeated rows are judged alike, so they go or stay together;
    rows without id are judged like others."""
    row = docs.select(F.struct(*docs.columns).alias("row"), F.col("text").alias("text"))
    return quality_rules.quality_rules(row).filter("kept").select("row.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines it shares with a smaller doc_id. A null
    text becomes one empty line; rows that share an id are one document, so they
    keep their common lines; a row without id shares nothing and keeps all."""
    row = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text")
    cut = line_dedup.line_dedup(row)
    new = {"text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    return cut.select(*[new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id. Rows
    that share an id are repeats of one document: all rows of the smallest id
    stay, those of other ids in the group all go. Texts without words, null ones
    among them, are copies of nothing, and so are rows without id: they stay."""
    classes = jaccard_join.jaccard_classes(docs, words=SHINGLE_WORDS, similar=SIMILAR, of=OF)
    gone = materialize(classes.filter("component_id <> doc_id").select(F.col("doc_id").alias("gone_id")), "gone")
    return docs.join(gone, docs["doc_id"] == F.col("gone_id"), "left_anti")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of ``benchmark``. Each row is judged by its
    own text, repeats and rows without id too; null and empty texts stay."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into token windows. A null or empty
    text is one piece of one id; repeated rows are packed each; a null id stays."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", keep_good),
    ("line_dedup", drop_repeated_lines),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack_windows),
]

#: Tokenisation and packing have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        if k:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
