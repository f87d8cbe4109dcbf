"""Supervised subword embeddings: hashed word and character n-gram vectors,
averaged per document, softmax on top, trained by numpy gradient descent.

The model is fitted on the driver on a bounded sample of labelled rows
(``SAMPLE_PER_LABEL``). Averaging and softmax's logit difference are linear, so
tasks get one number per hash bucket and score whole texts in numpy passes.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, slices, text_of, utf8
from .shingles import mix, word_hashes

#: Hash buckets (a power of two), vector width, character n-gram lengths.
BUCKETS, WIDTH, GRAMS = 1 << 17, 16, (3, 4, 5)
#: Labelled rows used for fitting: at most so many of each label, those with the
#: smallest hash of their id.
SAMPLE_PER_LABEL = 1500
EPOCHS, RATE, SEED = 5, 0.5, 7
HELD_OUT_FOLDS, THRESHOLD = 5, 0.3
_P = np.uint64(0x9E3779B97F4A7C15)


class Model(NamedTuple):
    weights: np.ndarray  # per bucket: what one occurrence adds to the logit, before averaging
    bias: float


def _features(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text number of every word and character (byte) n-gram of the
    texts data[cuts[i]:cuts[i+1]], and of a mark per word that says whether its
    text has had the three words from there on before."""
    words, count = word_hashes(data, cuts)
    texts = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    owner = np.repeat(np.arange(len(cuts) - 1), count)
    buckets, owners = [words & np.uint64(BUCKETS - 1), _marks(words, owner)], [owner, owner]
    wide = data.astype(np.uint64)
    for n in GRAMS:
        m = max(0, len(data) - n + 1)
        h = np.full(m, n, np.uint64)
        for j in range(n if m else 0):
            h = h * _P + wide[j:j + m]
        own = texts[:m]
        inside = own == texts[n - 1:] if m else np.zeros(0, bool)
        buckets.append((mix(h) & np.uint64(BUCKETS - 1))[inside])
        owners.append(own[inside])
    return np.concatenate(buckets).astype(np.int64), np.concatenate(owners)


def _marks(words: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """A mark's bucket for each word: seen or not."""
    n = len(words)
    three = words.copy()
    for k in (1, 2):  # not beyond the text's end
        m = max(0, n - k)
        three[:m] = np.where(owner[:m] == owner[k:], mix(three[:m]) + words[k:], three[:m])
    key = mix(three + owner.astype(np.uint64) * _P)
    first = np.zeros(n, bool)
    first[np.unique(key, return_index=True)[1]] = True
    return mix(np.where(first, np.uint64(1), np.uint64(2))) & np.uint64(BUCKETS - 1)


def fit(texts: list[str], labels: list[int]) -> Model:
    """One pass of gradient steps per epoch over the sample, in a fixed order."""
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    out, bias = np.zeros((WIDTH, 2), np.float32), np.zeros(2, np.float32)
    rows = []
    for text in texts:
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        ids, times = np.unique(_features(raw, np.array([0, len(raw)]))[0], return_counts=True)
        rows.append((ids.astype(np.int32), (times / max(1, times.sum())).astype(np.float32)))
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in rng.permutation(len(rows)):
            ids, share = rows[i]
            mean = share @ vectors[ids]
            logits = mean @ out + bias
            chance = np.exp(logits - logits.max())
            error = chance / chance.sum()
            error[labels[i]] -= 1
            back = out @ error
            out -= rate * np.outer(mean, error)
            bias -= rate * 0.1 * error
            # Shares are tiny; each vector steps by its part of the largest.
            vectors[ids] -= np.outer(rate * share / share.max(initial=1e-9), back)
    return Model((vectors @ (out[:, 1] - out[:, 0])).astype(np.float64), float(bias[1] - bias[0]))


def scores(column, model: Model) -> Iterator[np.ndarray]:
    data, offsets = utf8(column)
    for a, b in slices(offsets):
        ids, owner = _features(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
        total = np.bincount(owner, model.weights[ids], b - a)
        count = np.maximum(1, np.bincount(owner, minlength=b - a))
        yield 1 / (1 + np.exp(-np.clip(total / count + model.bias, -500, 500)))


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str,
           per_label: int) -> tuple[list[str], list[int]]:
    """At most ``per_label`` whole texts of each label outside the held-out fold."""
    one = (labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
           .filter(F.crc32(F.col(id_col).cast("string")) % HELD_OUT_FOLDS != 0)
           .groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("label")))
    by_hash = [F.xxhash64("id"), F.col("id")]
    few = one.filter("label = 0").orderBy(*by_hash).limit(per_label).union(
        one.filter("label = 1").orderBy(*by_hash).limit(per_label))
    # At most 2 * per_label ids: a size that does not depend on the tables.
    rows = (docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
            .join(F.broadcast(few), "id").groupBy("id").agg(F.min("text").alias("text"), F.min("label").alias("label"))
            .orderBy("id").collect())
    return [r["text"] for r in rows], [r["label"] for r in rows]


def _score(model) :
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model.value
        for batch in batches:
            found = [*scores(batch.column(1), known)] or [np.zeros(0)]
            yield pa.record_batch([batch.column(0), pa.array(np.concatenate(found))], names=["id", "score"])

    return run


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "quality", per_label: int = SAMPLE_PER_LABEL) -> DataFrame:
    """Per row of ``docs``: id_col, held_out, score (0 to 1, higher: label 1
    likelier), predicted (1 from a score of 0.3).

    Rows whose crc32(id as text) mod 5 is 0 are held out: their labels are never
    seen. Scores come of whole texts alone. A null or empty text has no features
    and gets the score of the bias; without any labelled row every score is 0.5.
    Null labels, and labels other than 0 and 1, are ignored; of several labels
    of an id the smaller counts. A null id is not held out. Repeated rows come
    out each; other columns are ignored.
    """
    spark = docs.sparkSession
    texts, wanted = sample(docs, labels, id_col, text_col, label_col, per_label)
    model = fit(texts, wanted) if texts else Model(np.zeros(BUCKETS), 0.0)
    scored = map_arrow(docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text")),
                       _score(spark.sparkContext.broadcast(model)), "id long, score double")
    held = F.crc32(F.col("id").cast("string")) % HELD_OUT_FOLDS == 0
    return scored.select(F.col("id").alias(id_col), F.coalesce(held, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
