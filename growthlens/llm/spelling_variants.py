"""Spelling variants grouped by Bloom-guided neighbourhoods.

Words one edit apart are found from one of the two: a deletion makes the shorter
from the longer, a replacement the other of the same length. Every edit of every
word is probed against Bloom filters of the vocabulary, a shard per word length,
each key set in as many 64-bit blocks as its length asks for. Only what the
filters let pass is shuffled, to a join with the vocabulary that drops the
filters' mistakes.

Filters are broadcast in passes of at most ``FILTER_BYTES``: a pass holds the
keys of one residue of their hash and probes only edits of that residue, so a
vocabulary of any size goes through, and the number of passes follows its count.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize, text_of

#: Code points of a word and its occurrences, at least; how many times as many
#: occurrences its form has; every SLIP-th pair of document and word loses one.
LEAST_CHARS, LEAST_COUNT, FORM_RATIO, SLIP = 7, 2, 10, 31
#: Letters after lower-casing A-Z; each is one byte of Latin-1.
LETTERS = np.array([*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)], np.uint8)
#: Broadcast bytes of a pass, bits per key and block, bits set per block.
FILTER_BYTES, KEY_BITS, SET_BITS = 32 << 20, 16, 4
#: Words that a task counts before it hands them on; edits of one numpy pass.
TASK_WORDS, PASS_EDITS = 400_000, 1 << 20
#: Words of a probing task.
PROBED = 1 << 15
_WORD = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf]){%d,}" % LEAST_CHARS)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_rng = np.random.default_rng(20240611)
_LETTER = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)


# -- words ---------------------------------------------------------------------------

def slipped(word: bytes, doc: bytes) -> bytes:
    """The word as the document ``doc`` spells it: every SLIP-th misses a letter."""
    h = zlib.crc32(word, zlib.crc32(doc))
    if h % SLIP:
        return word
    text = word.decode()
    at = h % len(text)
    return (text[:at] + text[at + 1:]).encode()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: Counter[bytes] = Counter()

    def out() -> pa.RecordBatch:
        words = pa.array(list(found), pa.binary()).cast(pa.string())
        return pa.record_batch([words, pa.array(list(found.values()), pa.int64())], names=["word", "n"])

    for batch in batches:
        ids = batch.column(0).to_pylist()
        for i, text in zip(ids, batch.column(1)):
            doc = b":" if i is None else b"%d:" % i
            # Only ASCII is lower-cased in bytes; a run of C3 80 .. C3 BF is one
            # of U+00C0 .. U+00FF.
            words = Counter(_WORD.findall(text.as_py().encode("utf-8", "surrogatepass").lower()))
            for word, n in words.items():
                new = slipped(word, doc)
                if new is word or len(new.decode()) >= LEAST_CHARS:
                    found[new] += n
            if len(found) > TASK_WORDS:
                yield out()
                found.clear()
    if found:
        yield out()


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the words of all texts that are long and frequent enough."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    counts = map_arrow(texts, _count, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


# -- filters ---------------------------------------------------------------------------

def shard_of(length: int) -> int:
    """Lengths have a shard each up to 64, then share one per power of two."""
    return length if length <= 64 else 64 + length.bit_length()


def blocks_per_key(length: int) -> int:
    """Longer words have more edits, so a false pass must be rarer."""
    return 2 if length <= 64 else 4 if length <= 4096 else 6


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def keys(letters: np.ndarray) -> np.ndarray:
    """The hashes of words of one length, (n, length) bytes."""
    return (_LETTER[letters] * _powers(letters.shape[1], _BASE)).sum(axis=1, dtype=np.uint64)


def _block(key: np.ndarray, k: int, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, mask) of the k-th block of each key among ``blocks``."""
    h = _mix(key + np.uint64((k + 1) * 0xA24BAED4963EE407 & (1 << 64) - 1))
    place = ((h >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    mask = np.zeros(len(h), np.uint64)
    for j in range(SET_BITS):
        mask |= np.uint64(1) << ((h >> np.uint64(6 * j)) & np.uint64(63))
    return place.astype(np.int64), mask


class Filters:
    """The shards' blocks one after another; ``starts`` and ``sizes`` by shard."""

    def __init__(self, blocks: np.ndarray, starts: dict[int, int], sizes: dict[int, int], residue: int, passes: int):
        self.blocks, self.starts, self.sizes, self.residue, self.passes = blocks, starts, sizes, residue, passes

    def passing(self, key: np.ndarray, length: int) -> np.ndarray:
        """Indices of the keys of this pass that may be words."""
        shard = shard_of(length)
        if not self.sizes.get(shard):
            return np.zeros(0, np.int64)
        at = (np.arange(len(key)) if self.passes == 1
              else np.flatnonzero(_residue(key, self.passes) == self.residue))
        for k in range(blocks_per_key(length)):
            place, mask = _block(key[at], k, self.sizes[shard])
            at = at[self.blocks[self.starts[shard] + place] & mask == mask]
        return at


def _residue(key: np.ndarray, passes: int) -> np.ndarray:
    return (_mix(key ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(passes)).astype(np.int64)


def _by_length(column) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, letters) for the words of each length, as many as one
    numpy pass takes."""
    words = [w.encode("latin-1") for w in column.to_pylist()]
    size = np.array([len(w) for w in words])
    order = np.argsort(size, kind="stable")
    cuts = np.flatnonzero(np.diff(size[order])) + 1
    for rows in np.split(order, cuts):
        if len(rows):
            n = int(size[rows[0]])
            step = max(1, PASS_EDITS // (n * len(LETTERS)))
            for a in range(0, len(rows), step):
                part = rows[a:a + step]
                yield n, part, np.frombuffer(b"".join(words[i] for i in part), np.uint8).reshape(len(part), n)


def _set_blocks(starts: dict[int, int], sizes: dict[int, int], passes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, _, letters in _by_length(batch.column(0)):
                key, shard = keys(letters), shard_of(n)
                residue = _residue(key, passes)
                for k in range(blocks_per_key(n)):
                    place, mask = _block(key, k, sizes[shard])
                    yield pa.record_batch([pa.array(residue), pa.array(starts[shard] + place), pa.array(mask.view(np.int64))],
                                          names=["residue", "block", "mask"])

    return run


def _shards(words: DataFrame, filter_bytes: int) -> tuple[dict[int, int], dict[int, int], int]:
    """Blocks of each shard in a pass, where they start, and the passes. At most
    a hundred rows come to the driver."""
    length = F.char_length("word")
    shard = F.when(length <= 64, length).otherwise(64 + F.char_length(F.bin(length)))
    count = {r["shard"]: (r["n"], r["longest"]) for r in
             words.groupBy(shard.alias("shard")).agg(F.count("*").alias("n"), F.max(length).alias("longest")).collect()}
    blocks = {s: n * blocks_per_key(longest) * KEY_BITS // 64 + 1 for s, (n, longest) in count.items()}
    passes = -(-sum(blocks.values()) * 8 // filter_bytes)
    sizes = {s: -(-b // max(passes, 1)) for s, b in sorted(blocks.items())}
    starts = dict(zip(sizes, np.cumsum([0, *sizes.values()]).tolist()))
    return starts, sizes, passes


# -- edits ------------------------------------------------------------------------------

def _edits(letters: np.ndarray, alphabet: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(length, key, row, position, letter) of every deletion (letter 0) and of
    every replacement by a later letter: the earlier one is found from there."""
    n, m = letters.shape
    up, term = _powers(m, _BASE), _LETTER[letters]
    placed = term * up
    total = placed.sum(axis=1, dtype=np.uint64)
    if m > LEAST_CHARS:
        upto = np.cumsum(placed, axis=1, dtype=np.uint64)
        key = (upto - placed) + (total[:, None] - upto) * np.uint64(_INVERSE)
        new = np.ones((n, m), bool)
        new[:, 1:] = letters[:, 1:] != letters[:, :-1]  # in a run any letter gives the same
        row, at = np.nonzero(new)
        yield m - 1, key[row, at], row, at, np.zeros(len(row), np.uint8)
    step = max(1, PASS_EDITS // (n * len(alphabet)))
    for a in range(0, m, step):
        later = alphabet[None, None, :] > letters[:, a:a + step, None]
        row, at, letter = np.nonzero(later)
        letter = alphabet[letter]
        at = at + a
        yield m, total[row] + (_LETTER[letter] - term[row, at]) * up[at], row, at, letter


def _edited(word: str, at: int, letter: int) -> str:
    return word[:at] + (chr(letter) if letter else "") + word[at + 1:]


def _probe(shipped, alphabet: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters: Filters = shipped.value
        for batch in batches:
            words, counts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for _, rows, letters in _by_length(batch.column(0)):
                for n, key, row, at, letter in _edits(letters, alphabet):
                    hit = filters.passing(key, n)
                    if len(hit):
                        own = rows[row[hit]].tolist()
                        found = [_edited(words[i], p, c) for i, p, c in zip(own, at[hit].tolist(), letter[hit].tolist())]
                        yield pa.record_batch([pa.array(found), pa.array([words[i] for i in own]), pa.array([counts[i] for i in own], pa.int64())],
                                              names=["candidate", "word", "n"])

    return run


def near_words(words: DataFrame, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """(word, near, near_n) for every two words of ``words`` (word, n; distinct)
    one inserted, deleted or replaced letter apart, in both directions."""
    spark = words.sparkSession
    starts, sizes, passes = _shards(words, filter_bytes)
    if not passes:
        return spark.createDataFrame([], "word string, near string, near_n long")
    # A vocabulary that has few of the letters has few edits: at most 90 rows.
    used = [ord(r[0]) for r in words.select(F.explode(F.array_distinct(F.split("word", "")))).distinct().collect() if r[0]]
    alphabet = np.array(sorted(used), np.uint8)
    blocks = materialize(
        map_arrow(words.select("word"), _set_blocks(starts, sizes, passes), "residue long, block long, mask long")
        .groupBy("residue", "block").agg(F.bit_or("mask").alias("mask")), "blocks")
    dealt = words.repartition(int(sum(sizes.values()) * passes // (PROBED // 2)) + 1, "word")
    out = None
    for residue in range(passes):
        table = blocks.filter(F.col("residue") == residue).select("block", "mask").toArrow()  # filter_bytes at most, twice
        held = np.zeros(sum(sizes.values()), np.uint64)
        held[table["block"].to_numpy()] = table["mask"].to_numpy().view(np.uint64)
        shipped = spark.sparkContext.broadcast(Filters(held, starts, sizes, residue, passes))
        passed = materialize(map_arrow(dealt, _probe(shipped, alphabet), "candidate string, word string, n long"), "passed")
        shipped.unpersist()
        out = passed if out is None else out.union(passed)
    exact = out.join(words.select(F.col("word").alias("candidate"), F.col("n").alias("m")), "candidate")
    return exact.select(F.explode(F.array(
        F.struct(F.col("word"), F.col("candidate").alias("near"), F.col("m").alias("near_n")),
        F.struct(F.col("candidate").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")))).alias("x")).select("x.*")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): forms followed to the last, each round
    twice as far. A form is more frequent than its word, so none comes round."""
    at = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        beyond = at.select(F.col("word").alias("on"), F.col("root").alias("next"))
        moved = materialize(at.join(beyond, F.col("root") == F.col("on"), "left")
                            .select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        at = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return at


def variant_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """Per word of the vocabulary: word, form, root, n, n_near, form_n.

    Words are maximal runs of ``[A-Za-z\\u00C0-\\u00FF]``, A-Z lower-cased,
    after the slips of ``slipped``, of 7 code points and 2 occurrences at least.
    A word's form is its most frequent near word (of equals the smallest), if
    that occurs 10 times as often, else null; root follows the forms. A null or
    empty text has no words; a null id slips as an empty one; repeated rows count
    each; a run of any length is a word. An empty table gives no rows, other
    columns are ignored.
    """
    words = materialize(vocabulary(docs, id_col, text_col), "words")
    near = near_words(words, filter_bytes)
    # Of all near words the one of largest n, of equals the smallest.
    best = near.groupBy("word").agg(F.count("*").alias("n_near"),
                                    F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    best = best.select(F.col("word").alias("of"), "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))
    judged = materialize(
        words.join(best, F.col("word") == F.col("of"), "left")
        .withColumn("fits", F.col("near_n") >= FORM_RATIO * F.col("n"))
        .select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                F.when(F.col("fits"), F.col("near")).alias("form"), F.when(F.col("fits"), F.col("near_n")).alias("form_n")), "judged")
    ends = roots(judged.filter("form IS NOT NULL")).withColumnRenamed("word", "of")
    return judged.join(ends, F.col("word") == F.col("of"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
