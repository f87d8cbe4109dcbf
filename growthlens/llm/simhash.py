"""SimHash near-duplicates by tiled exact comparison.

A text's fingerprint has a bit for every bit set in over half of its shingles'
64-bit hashes. Equal fingerprints are merged; the rest are cut into tiles whose
members have the same population counts of both 32-bit halves. Two fingerprints
differ in at least as many bits as their halves' counts do, so a pair of tiles
whose counts differ beyond the radius is never formed; any other pair is
compared in full by exclusive-or and bit counts. Large tiles are cut once more
in the task, by the counts of the 16-bit quarters, and skipped by the same rule.

A strip (one pair of counts) of many fingerprints is dealt to several tiles by
hash, so no tile, row or task grows with the input. Each pair of tiles returns
a spanning forest of its links, never the links themselves: in a large family
of copies those grow with the square of its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, map_arrow, materialize, text_of
from .components import components

WORDS, RADIUS, SEED = 3, 3, 42
#: Fingerprints of a tile, about; pairs that one numpy pass compares.
TILE, PASS_PAIRS = 8192, 1 << 20
#: Pairs of rows from which a pair of tiles is cut by its quarters' counts.
CUT_PAIRS = 4 << 20
#: Hashes whose bits one numpy pass counts.
PASS_HASHES = 1 << 16
_HALF = np.uint64(32)


# -- fingerprints -----------------------------------------------------------------

def shingle_hashes(text: str, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """XXH64 of the space-joined ``words``-word shingles, repeats included."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found])
    last = ends[min(words, len(found)) - 1:] - 1
    first = np.concatenate(([0], ends[:len(last) - 1]))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in zip(first.tolist(), last.tolist())], np.uint64)


def _ones(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How often each bit is set in the hashes of each run from ``starts``."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.add.reduceat(bits, starts, axis=0, dtype=np.int64)


def fingerprints(texts: Iterator[str], words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """The fingerprint of each text; 0 without words."""
    out: list[np.ndarray] = []
    waiting: list[np.ndarray] = []
    held = 0

    def flush() -> None:
        nonlocal held
        size = np.array([len(h) for h in waiting])
        marks = np.zeros((len(waiting), 64), bool)
        full = np.flatnonzero(size)
        if len(full):
            starts = np.cumsum(size[full]) - size[full]
            joined, ones = np.concatenate(waiting), np.zeros((len(full), 64), np.int64)
            for a in range(0, len(joined), PASS_HASHES):  # a long text is counted in parts
                b = min(a + PASS_HASHES, len(joined))
                lo = int(np.searchsorted(starts, a, "right")) - 1
                hi = int(np.searchsorted(starts, b, "left"))
                ones[lo:hi] += _ones(joined[a:b], np.maximum(starts[lo:hi] - a, 0))
            marks[full] = 2 * ones > size[full][:, None]
        out.append(np.packbits(marks, axis=1, bitorder="little").view(np.uint64).ravel())
        waiting.clear()
        held = 0

    for text in texts:
        waiting.append(shingle_hashes(text, words, seed))
        held += len(waiting[-1])
        if held >= PASS_HASHES or len(waiting) >= 4096:
            flush()
    if waiting:
        flush()
    return np.concatenate([np.zeros(0, np.uint64), *out])


def _print(words: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = fingerprints((t.as_py() for t in batch.column(1)), words, seed)
            yield pa.record_batch([batch.column(0), pa.array(found.view(np.int64))], names=["id", "print"])

    return run


# -- tiles --------------------------------------------------------------------------

def _quarters(x: np.ndarray) -> np.ndarray:
    """Population counts of the four 16-bit parts, (n, 4)."""
    return np.bitwise_count(np.ascontiguousarray(x).view(np.uint16).reshape(-1, 4)).astype(np.int16)


def _cut(x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(counts, rows) of the parts of a tile that agree in all four counts."""
    counts, part = np.unique(_quarters(x), axis=0, return_inverse=True)
    order = np.argsort(part.ravel(), kind="stable")
    ends = np.cumsum(np.bincount(part.ravel(), minlength=len(counts)))
    return [(c, order[b - n:b]) for c, b, n in zip(counts, ends, np.diff(ends, prepend=0))]


def close_pairs(x: np.ndarray, y: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (of x, of y) that differ in at most ``radius`` bits."""
    if len(x) * len(y) < CUT_PAIRS:
        yield from _compared(x, np.arange(len(x)), y, np.arange(len(y)), radius)
        return
    right = _cut(y)
    counts = np.array([c for c, _ in right])
    for c, rows in _cut(x):
        near = np.flatnonzero(np.abs(counts - c).sum(axis=1) <= radius)
        if len(near):
            yield from _compared(x, rows, y, np.concatenate([right[k][1] for k in near]), radius)


def _compared(x, rows, y, others, radius):
    if not len(others):
        return
    step = max(1, PASS_PAIRS // len(others))
    against = y[others][None]
    for a in range(0, len(rows), step):
        part = rows[a:a + step]
        i, j = np.nonzero(np.bitwise_count(x[part][:, None] ^ against) <= radius)
        if len(i):
            yield part[i], others[j]


def forest(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``label`` (each row's smallest member) after joining the rows a and b."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (label[label] != label).any():
            label = label[label]


def _tile_links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i in range(batch.num_rows):
                x = batch.column(1)[i].values.to_numpy().view(np.uint64)
                y = batch.column(2)[i].values.to_numpy().view(np.uint64)
                own = batch.column(0)[i].as_py()
                nodes = x if own else np.concatenate((x, y))
                label, shift = np.arange(len(nodes)), 0 if own else len(x)
                for a, b in close_pairs(x, y, radius):
                    label = forest(label, a, b + shift)
                linked = np.flatnonzero(label != np.arange(len(nodes)))
                found_a.append(nodes[label[linked]].view(np.int64))
                found_b.append(nodes[linked].view(np.int64))
            yield pa.record_batch([pa.array(np.concatenate(found_a)), pa.array(np.concatenate(found_b))], names=["a", "b"])

    return run


def hamming_links(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(a, b): links that join whatever distinct values of the long column
    ``print`` can be reached from each other over at most ``radius`` differing
    bits at a time. Strips are at most 33 * 33, so their counts are broadcast."""
    known = prints.select("print", F.bit_count(F.shiftrightunsigned("print", 32)).alias("hi"),
                          F.bit_count(F.col("print").bitwiseAND(0xFFFFFFFF)).alias("lo"))
    strips = materialize(known.groupBy("hi", "lo").agg(F.ceil(F.count("*") / tile).alias("parts")), "strips")
    tiles = materialize(
        known.join(F.broadcast(strips), ["hi", "lo"])
        .withColumn("part", F.pmod(F.xxhash64("print"), "parts"))
        .groupBy("hi", "lo", "part").agg(F.collect_list("print").alias("prints")), "tiles")
    steps = F.array(*[F.struct(F.lit(i).alias("up"), F.lit(j).alias("side"))
                      for i in range(radius + 1) for j in range(-radius, radius + 1)
                      if abs(i) + abs(j) <= radius and (i, j) >= (0, 0)])
    # The tiles that a tile is compared with, itself included; of two the lesser.
    pairs = (tiles.withColumn("step", F.explode(steps))
             .select("hi", "lo", "part", "prints", (F.col("hi") + F.col("step.up")).alias("hi2"), (F.col("lo") + F.col("step.side")).alias("lo2"))
             .join(F.broadcast(strips.select(F.col("hi").alias("hi2"), F.col("lo").alias("lo2"), "parts")), ["hi2", "lo2"])
             .withColumn("part2", F.explode(F.expr("sequence(0L, parts - 1)")))
             .filter("hi2 > hi OR lo2 > lo OR part2 >= part"))
    own = (F.col("hi") == F.col("hi2")) & (F.col("lo") == F.col("lo2")) & (F.col("part") == F.col("part2"))
    right = tiles.select(F.col("hi").alias("hi2"), F.col("lo").alias("lo2"), F.col("part").alias("part2"), F.col("prints").alias("others"))
    met = pairs.withColumn("own", own).join(right, ["hi2", "lo2", "part2"])
    links = materialize(map_arrow(met.select("own", "prints", "others"), _tile_links(radius), "a long, b long").distinct(), "links")
    discard(strips, tiles)
    return links


def simhash_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    words: int = WORDS, radius: int = RADIUS, seed: int = SEED, tile: int = TILE) -> DataFrame:
    """(id_col, fingerprint, component_id) for every row of ``docs``.

    Words are runs without ASCII white space, A-Z lower-cased; a text of fewer
    than ``words`` words is one shingle; a null text or one without words has
    the fingerprint zero and is linked like any other. Fingerprints link at up
    to ``radius`` differing bits; component_id is the smallest id reachable.
    Repeated rows come out each. A row without id is linked too, but its id
    counts for nothing: among such rows alone component_id is null. An empty
    table gives no rows, other columns are ignored, texts of any length are
    hashed whole.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    prints = materialize(map_arrow(texts, _print(words, seed), "id long, print long"), "prints")
    first = materialize(prints.groupBy("print").agg(F.min("id").alias("first")), "first")
    classes = components(hamming_links(first.select("print"), radius, tile))
    member = materialize(first.join(classes, F.col("print") == F.col("node"), "left")
                         .select("print", "first", F.coalesce("component", "print").alias("class")), "member")
    smallest = member.groupBy("class").agg(F.min("first").alias("smallest"))
    ends = materialize(member.join(smallest, "class").select("print", "smallest"), "ends")
    discard(first, member)
    return prints.join(ends, "print").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
        F.col("smallest").alias("component_id"))
