"""Exact Jaccard self-join of word-shingle sets by universe partitioning.

Shingles are hashed into segments, so many that two sets similar enough must
agree on one (pigeonhole). The number of segments belongs to a size band, so
both sets of a pair use the same one. A set's index entries are hashes of its
segments; the first segments of each band also enter with each one token
deleted. That capacity pays for leaving out the entries that would cost most:
empty and small segments at once, frequent ones when their counts are known.
Candidates are verified on the whole sets.

Why nothing is lost. In a band with largest size U, a pair's symmetric
difference is at most H = U * 2(q-p)/(q+p) for a threshold p/q. The universe is
cut into H + 1 + 2(K + F) units; a plain segment is one unit, one with deletions
two. To share no entry, a pair must differ once in each plain segment and twice
in each with deletions, once for each unit, except where one of the two left an
entry out. Each leaves out at most K + F (a smaller set some more: half of what
its own bound lies below H), so more than H differences would be needed. F and
that half go to the segments with fewest tokens at once, K to the entries
counted most often. What it costs decides the split: small sets, whose segments
would hold few tokens and so be frequent, use deletions only and leave nothing
out; large ones, where deletions would add an entry per token, use few.

Classes instead of pairs. Equal sets are merged before indexing. In the sets
that share an entry (a bucket), each is first compared with the smallest id
only; a second pass compares only sets that are still in different classes. A
batch sends one row an entry to its bucket, whatever it holds of it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, map_arrow, materialize, text_of
from .components import components
from .shingles import mix, shingle_sets

WORDS, SIMILAR, OF = 4, 85, 100
#: Size bands are [edge, next edge), so many times as wide as the last; up to
#: SMALL as narrow as the threshold allows.
BAND_RATIO, SMALL = 1.6, 80
#: So many entries before its own does a row name, for pairs to be formed once.
LOOK_BACK = 16


class Band(NamedTuple):
    index: int
    largest: int
    differ: int  # H
    spare: int  # K
    free: int  # F
    deleted: int  # segments with deletions
    units: int


@cache
def band_of(size: int, p: int, q: int) -> Band:
    edge, index = 1, 0
    while True:
        following = edge * q // p + 1 if edge < SMALL else int(edge * BAND_RATIO)
        if size < following:
            break
        edge, index = following, index + 1
    differ = 2 * (following - 1) * (q - p) // (q + p)
    if edge < SMALL:
        deleted = differ // 2 + 1
        return Band(index, following - 1, differ, 0, 0, deleted, 2 * deleted)
    spare = free = 1 + differ // 48
    return Band(index, following - 1, differ, spare, free, 1 + spare // 4, differ + 1 + 2 * (spare + free))


def bands_for(size: int, p: int, q: int) -> list[Band]:
    """Its own band, and the next where a partner may be as large as that.
    Bands in which only equal sets are similar enough need no index."""
    own = band_of(size, p, q)
    found = [own, band_of(own.largest + 1, p, q)] if size * q // p > own.largest else [own]
    return [x for x in found if x.differ]


def left_out(size: int, band: Band, p: int, q: int) -> int:
    """Entries that a set of this size leaves out before any are counted."""
    own = (size + min(band.largest, size * q // p)) * (q - p) // (q + p)
    return min(band.units - 2 * band.deleted, band.free + max(0, band.differ - own) // 2)


def spares(size: int, p: int, q: int) -> tuple[int, int]:
    """K of the set's even and of its odd band."""
    found = {b.index & 1: b.spare for b in bands_for(size, p, q)} if size else {}
    return found.get(0, 0), found.get(1, 0)


_DELETED, _PARITY = np.uint64(1), np.uint64(2)
_TOKEN, _SEGMENT = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)


def entries(tokens: np.ndarray, band: Band, p: int, q: int) -> np.ndarray:
    """Index entries of a set in a band.

    An entry is a hash of band, segment and the segment's tokens; bit 0 marks
    the segments with deletions, bit 1 odd bands.
    """
    c, m = band.deleted, band.units - band.deleted
    unit = ((tokens >> np.uint64(20)) % np.uint64(band.units)).astype(np.int64)
    segment = np.where(unit < 2 * c, unit // 2, unit - c)
    order = np.argsort(segment, kind="stable")
    count = np.bincount(segment, minlength=m)
    ends = np.cumsum(count)
    values = mix(tokens[order] + _TOKEN)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))
    sums = total[ends] - total[ends - count]
    place = (np.arange(m, dtype=np.uint64) + np.uint64((band.index + 1) << 32)) * _SEGMENT
    full = mix(sums + place) & ~(_DELETED | _PARITY)
    # What costs most is left out at once: segments with deletions of two tokens
    # or fewer (two units each), then the plain segments with fewest tokens.
    out = left_out(len(tokens), band, p, q)
    thin = np.flatnonzero(count[:c] <= 2)[:out // 2]
    kept = np.sort(np.argsort(count[c:], kind="stable")[out - 2 * len(thin):])
    wide = np.ones(c, bool)
    wide[thin] = False
    # One token less in each of the first c segments.
    first = int(ends[c - 1])
    fewer = (sums[:c].repeat(count[:c]) - values[:first] + place[:c].repeat(count[:c]))[wide.repeat(count[:c])]
    fewer = mix(fewer) & ~(_DELETED | _PARITY)
    odd = _PARITY if band.index & 1 else np.uint64(0)
    return np.concatenate((full[:c][wide] | _DELETED, fewer | _DELETED, full[c:][kept])) | odd


def _sets(batches: Iterator[pa.RecordBatch], words: int):
    for batch in batches:
        ids = batch.column(0)
        for i, tokens in enumerate(shingle_sets(batch.column(1), words)):
            yield ids[i].as_py(), tokens


def parity(tokens: np.ndarray) -> np.ndarray:
    """256 bits: whether an odd number of tokens falls on each. Two sets differ
    in at least as many tokens as their bits do."""
    odd = np.bincount((tokens >> np.uint64(56)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


_BITS = [f"bits{i}" for i in range(4)]
_PROFILE = "id long, n long, digest binary, spare_even int, spare_odd int, " + ", ".join(f"{b} long" for b in _BITS)


def _profiles(words: int, p: int, q: int):
    """Per text: number of shingles, a 128-bit digest of the set, its spares,
    its parity bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, bits = [], [], [np.zeros((0, 4), np.int64)]
            for tokens in shingle_sets(batch.column(1), words):
                sizes.append(len(tokens))
                digests.append(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest())
                bits.append(parity(tokens)[None])
            even, odd = zip(*[spares(n, p, q) for n in sizes]) if sizes else ((), ())
            yield pa.record_batch(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                 pa.array(even, pa.int32()), pa.array(odd, pa.int32()), *map(pa.array, np.ascontiguousarray(np.concatenate(bits).T))],
                names=[x.split()[0] for x in _PROFILE.split(", ")])

    return run


def _may_match(x: str, y: str, p: int, q: int) -> Column:
    """False only for pairs whose sizes or parity bits rule the threshold out."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    apart = sum((F.bit_count(F.col(f"{x}.{b}").bitwiseXOR(F.col(f"{y}.{b}"))) for b in _BITS), F.lit(0))
    return (n * q >= m * p) & (m * q >= n * p) & (apart * (q + p) <= (n + m) * (q - p))


def _index(words: int, p: int, q: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []
        owners: list[int] = []
        waiting = 0
        for ident, tokens in _sets(batches, words):
            for band in bands_for(len(tokens), p, q) if len(tokens) else []:
                found.append(entries(tokens, band, p, q))
                owners.append(ident)
                waiting += len(found[-1])
            if waiting > 200_000:
                yield _entry_batch(found, owners)
                found, owners, waiting = [], [], 0
        if found:
            yield _entry_batch(found, owners)

    return run


_ENTRIES = "entry long, id long, pivot long"


def _entry_batch(found: list[np.ndarray], owners: list[int]) -> pa.RecordBatch:
    """Rows (entry, id, pivot). Of the ids that hold an entry in this batch the
    smallest goes to the entry's bucket for all of them; the others name it as
    pivot, it names itself. An entry held once in the batch has no pivot."""
    entry = np.concatenate(found).view(np.int64)
    ids = np.repeat(np.array(owners, np.int64), [len(x) for x in found])
    order = np.lexsort((ids, entry))
    entry, ids = entry[order], ids[order]
    again = np.concatenate(([False], entry[1:] == entry[:-1]))
    pivot = ids[np.maximum.accumulate(np.where(again, 0, np.arange(len(entry))))]
    alone = ~(again | np.concatenate((again[1:], [False])))
    kept = ~again | (ids != pivot)  # a set's repeated entry, should hashes meet
    return pa.record_batch([pa.array(entry[kept]), pa.array(ids[kept]), pa.array(pivot[kept], mask=alone[kept])],
                           names=["entry", "id", "pivot"])


def _bucketed(index: DataFrame) -> DataFrame:
    """(entry, id, pivot, local) of entries held by more than one id, from
    ``_index``'s rows. Those that name another as pivot stay ``local``: they are
    dealt by it too."""
    spread = F.expr("nullif(pivot, id)")
    return map_arrow(index.repartition("entry", spread).sortWithinPartitions("entry", spread, "id"),
                     _buckets, _ENTRIES + ", local boolean")


def _stars(buckets: DataFrame) -> DataFrame:
    """Every id with the smallest of its bucket, a < b. A local row has it from
    its pivot's; a pivot stands for no more rows than a batch has."""
    met = buckets.filter("NOT local").select("entry", F.col("id").alias("pivot"), F.col("pivot").alias("a"))
    far = buckets.filter("local").join(met, ["entry", "pivot"]).select("a", F.col("id").alias("b"))
    return buckets.filter("NOT local AND id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).union(far).distinct()


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by entry, pivot elsewhere (null first) and id. Rows without
    one get the smallest id of their entry as pivot, or go if it is their own
    and they stand for none. Holds one batch and one row."""
    entry = ident = pivot = np.zeros(0, np.int64)
    written = False
    for batch in batches:
        if not batch.num_rows:
            continue
        named = batch.column(2)
        own = named.fill_null(-1).to_numpy()
        known = ~named.is_null().to_numpy(zero_copy_only=False)
        new = batch.column(1).to_numpy()
        elsewhere = known & (own != new)
        if elsewhere.any():
            yield _bucket_batch([c.filter(pa.array(elsewhere)) for c in batch.columns], True)
        here = ~elsewhere
        if not here.any():
            continue
        stands = np.concatenate((np.zeros(len(entry), bool), known[here]))
        entry = np.concatenate((entry, batch.column(0).to_numpy()[here]))
        ident = np.concatenate((ident, new[here]))
        again = np.concatenate(([False], entry[1:] == entry[:-1]))
        start = np.maximum.accumulate(np.where(again, 0, np.arange(len(entry))))
        smallest = ident[start]
        if len(pivot):
            smallest[start == 0] = pivot[0]
        emit = again | np.concatenate((again[1:], [False])) | stands
        emit[0] &= not written
        if emit.any():
            yield _bucket_batch([pa.array(x[emit]) for x in (entry, ident, smallest)], False)
        written = bool(emit[-1]) or (len(entry) == 1 and written)
        entry, ident, pivot = entry[-1:], ident[-1:], smallest[-1:]


def _bucket_batch(columns: list[pa.Array], local: bool) -> pa.RecordBatch:
    marks = pa.array(np.full(len(columns[0]), local))
    return pa.record_batch([*columns, marks], names=["entry", "id", "pivot", "local"])


def _tokens(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at, held = batch.column(0).to_pylist(), 0, 0
            part: list[np.ndarray] = []
            for tokens in shingle_sets(batch.column(1), words):
                part.append(tokens.view(np.int64))
                held += len(tokens)
                if held > 200_000:
                    yield _token_batch(ids[at:at + len(part)], part)
                    at, held, part = at + len(part), 0, []
            if part:
                yield _token_batch(ids[at:], part)

    return run


def _token_batch(ids: list, part: list[np.ndarray]) -> pa.RecordBatch:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in part]))).astype(np.int32)
    return pa.record_batch([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(part)))],
                           names=["id", "tokens"])


#: Widest parity bits of a set, in bytes; a width of four bits per token until then.
MOST_WIDE = 4096


def wide_parity(tokens: np.ndarray) -> bytes:
    """``parity`` in enough bits that nearly every differing token shows."""
    size = max(256, min(8 * MOST_WIDE, 1 << (4 * len(tokens)).bit_length()))
    odd = np.bincount((tokens & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """A bound from below on how many tokens two sets differ in. The wider bits
    are folded to the width of the others."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[:len(x) // 2] ^ x[len(x) // 2:]
    while len(y) > len(x):
        y = y[:len(y) // 2] ^ y[len(y) // 2:]
    return int(np.bitwise_count(x ^ y).sum())


def _wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(1)
        tokens, ends = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
        wide = [wide_parity(tokens[a:b]) for a, b in zip(ends[:-1], ends[1:])]
        yield pa.record_batch([batch.column(0), pa.array(np.diff(ends), pa.int64()), pa.array(wide, pa.binary())], names=["id", "n", "wide"])


def _near_enough(p: int, q: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, wa, wb = (batch.column(i) for i in (2, 3, 4))
            kept = [least_difference(x.as_py(), y.as_py()) * (q + p) <= m.as_py() * (q - p) for m, x, y in zip(n, wa, wb)]
            yield batch.select([0, 1]).filter(pa.array(kept, pa.bool_()))

    return run


def _verified(pairs: DataFrame, profiles: DataFrame, texts: DataFrame, words: int, p: int, q: int) -> DataFrame:
    """The (a, b) of ``pairs`` whose whole sets are similar enough."""
    known = profiles.select("id", "n", *_BITS).dropDuplicates(["id"])
    asked = pairs = materialize(
        pairs.join(known.alias("x"), F.col("a") == F.col("x.id"))
        .join(known.alias("y"), F.col("b") == F.col("y.id"))
        .filter(_may_match("x", "y", p, q)).select("a", "b"), "pairs")
    # Written out: where the ids are few, Spark sends them to the texts instead
    # of shuffling those.
    wanted = materialize(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "wanted")
    sets = materialize(
        map_arrow(texts.join(wanted, "id", "left_semi").select("id", "text"),
                  _tokens(words), "id long, tokens array<long>").dropDuplicates(["id"]), "sets")
    # Pairs just short of the threshold are many in large families: their parity
    # bits are a sixteenth of the tokens that would otherwise travel with each.
    wide = materialize(map_arrow(sets, _wide, "id long, n long, wide binary"), "wide")
    x = wide.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("wide").alias("wa"))
    y = wide.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("wide").alias("wb"))
    checked = pairs.join(y, "b").join(x, "a").select("a", "b", F.col("na") + F.col("nb"), "wa", "wb")
    pairs = materialize(map_arrow(checked, _near_enough(p, q), "a long, b long"), "near")
    right = pairs.join(sets.select(F.col("id").alias("b"), F.col("tokens").alias("tb")), "b")
    both = right.join(sets.select(F.col("id").alias("a"), F.col("tokens").alias("ta")), "a")
    shared = F.size(F.array_intersect("ta", "tb"))
    links = materialize(
        both.withColumn("shared", shared)
        .filter(F.col("shared") * q >= (F.size("ta") + F.size("tb") - F.col("shared")) * p)
        .select("a", "b"), "links")
    discard(asked, wanted, sets, wide, pairs)
    return links


def _second_pairs(buckets: DataFrame, classes: DataFrame, profiles: DataFrame, p: int, q: int) -> DataFrame:
    """Pairs in a bucket, of sizes that may match, whose classes differ. Each
    set first leaves out its most frequent entries as far as allowed.

    Sets alike share many entries, but need to meet once. A row names the
    ``LOOK_BACK`` entries that come before its own, rarest first, among those
    its set kept; two rows that name one in common are no pair here, as their
    sets meet at that one, earlier. At the first entry that two sets share they
    name none in common, so each pair is formed."""
    rows = (buckets.join(classes.withColumnRenamed("node", "id"), "id", "left")
            .select("entry", "id", F.coalesce("component", "id").alias("class")))
    mixed = (rows.groupBy("entry").agg(F.min("class").alias("lo"), F.max("class").alias("hi"), F.count("*").alias("held"))
             .filter("lo < hi").select("entry", "held"))
    mixed = materialize(mixed, "mixed")
    held = rows = materialize(rows.join(mixed, "entry"), "rows")
    discard(mixed)
    odd = (F.col("entry").bitwiseAND(2) / 2).cast("int")
    sizes = profiles.select("id", "n", "spare_even", "spare_odd", *_BITS).dropDuplicates(["id"])
    rows = rows.join(sizes, "id").withColumn("odd", odd).withColumn("plain", F.col("entry").bitwiseAND(1) == 0)
    # A set's entries in one band are as many as its size allows.
    ranked = F.row_number().over(
        Window.partitionBy("id", "odd", "plain").orderBy(F.desc("held"), "entry"))
    left = F.when(F.col("odd") == 1, F.col("spare_odd")).otherwise(F.col("spare_even"))
    rows = rows.withColumn("rank", ranked).filter(~F.col("plain") | (F.col("rank") > left))
    before = F.collect_list("entry").over(
        Window.partitionBy("id").orderBy("held", "entry").rowsBetween(-LOOK_BACK, -1))
    rows = materialize(rows.select("entry", "id", "class", "n", *_BITS, before.alias("before")), "kept")
    discard(held)
    x, y = rows.alias("x"), rows.alias("y")
    return (x.join(y, (F.col("x.entry") == F.col("y.entry")) & (F.col("x.class") < F.col("y.class"))
                   & _may_match("x", "y", p, q) & ~F.arrays_overlap("x.before", "y.before"))
            .select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct())


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    words: int = WORDS, similar: int = SIMILAR, of: int = OF) -> DataFrame:
    """(id_col, n_shingles, component_id) for every row of ``docs``.

    Two documents link when of * intersection >= similar * union of their sets
    of distinct ``words``-word shingles (words: runs without ASCII white space,
    A-Z lower-cased; a shorter text is one shingle). component_id is the
    smallest id reachable by links. A text without words, or null, has an empty
    set and stands alone. Ids are whole numbers; rows that share one are repeats
    of one document and each comes out. A null id is never linked and has a null
    component_id. Other columns are ignored. ``similar / of`` is over 1 / 1.6.
    """
    if similar * BAND_RATIO <= of or similar > of:
        raise ValueError("the threshold must lie above 1 / BAND_RATIO and not above 1")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    profiles = materialize(
        map_arrow(texts, _profiles(words, similar, of),
                  _PROFILE), "profiles")
    known = profiles.filter("n > 0 AND id IS NOT NULL")
    same = materialize(known.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last"))
                       .filter("first < last").select("digest", "first"), "same")
    copies = materialize(known.join(same, "digest").filter("id <> first").select("id", "first").distinct(), "copies")
    single = texts.filter("id IS NOT NULL").join(copies.select("id"), "id", "left_anti").select("id", "text")
    buckets = materialize(_bucketed(map_arrow(single, _index(words, similar, of), _ENTRIES)), "buckets")
    links = _verified(_stars(buckets), profiles, single, words, similar, of)
    classes = components(links)
    more = _verified(_second_pairs(buckets, classes, profiles, similar, of), profiles, single, words, similar, of)
    if not more.isEmpty():
        classes = components(links.union(more))
    discard(buckets)
    return (profiles.select("id", "n").join(copies, "id", "left")
            .withColumn("node", F.coalesce("first", "id")).join(classes, "node", "left")
            .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                    F.coalesce("component", "node").alias("component_id")))
