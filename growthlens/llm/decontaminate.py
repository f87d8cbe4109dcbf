"""Benchmark decontamination by the q-gram lemma.

Benchmark items are cut into overlapping windows. A place in a document that
equals a window but for at most e edits shares at least n + 1 - q - q * e of its
character q-grams, all on diagonals (document position - window position) that
lie at most e apart. So shared q-grams are counted in overlapping diagonal
bands, regions that reach the bound are kept, and a banded alignment decides.

Quoted parts are found from any start in the item: every part of PART characters
holds one of the seeds, shorter windows at every quarter of it, whose
regions are then aligned with each part around the seed.

Benchmarks of any size go through in blocks of bounded size, one pass over the
documents each; only block and matches are shipped.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize, text_of

#: q-gram length; window length and step; edits per 100 characters; items
#: shorter than MIN_CHARS (normalised) are matched as they are, by whole words.
Q, WINDOW, STEP, EDITS_PER_100, MIN_CHARS = 10, 160, 80, 6, 24
#: Shortest part of a longer item that counts.
PART = 64
#: Characters of benchmark text per block (about 17 bytes each in a task),
#: characters of documents per pass.
BLOCK_CHARS, PASS_CHARS = 4_000_000, 250_000
_TABLE_BITS = 22
_P = 0x9E3779B97F4A7C15
_MATCHES = "id long, item_id long, start long, end long, edits long"
_KEYED = f"key long, {_MATCHES}"


@cache
def _fold() -> np.ndarray:
    """Per code point below 2^17: the letter, digit or mark in lower case (where
    that is one character), else 0. Higher ones stand for themselves."""
    out = np.zeros(1 << 17, np.uint32)
    for c in range(len(out)):
        if unicodedata.category(chr(c))[0] in "LNM":
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def normalised(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts laid end to end: code points of letters, digits and marks in
    lower case, every run of others as one space; where each stood; where each
    text starts among them."""
    fold = _fold()
    c = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    low = fold[np.minimum(c, len(fold) - 1)]
    if len(c) and c.max() >= len(fold):
        low = np.where(c < len(fold), low, c)
    word = low != 0
    keep = word.copy()
    keep[1:] |= word[:-1]  # the first of a run of others
    at = np.flatnonzero(keep)
    low = low[at]
    return np.where(low == 0, np.uint32(32), low), at, np.searchsorted(at, np.cumsum([0, *map(len, texts)]))


def gram_hashes(c: np.ndarray) -> np.ndarray:
    """Hashes of all Q-grams, from those of 1, 2, 4, 8 characters."""
    have = {1: c.astype(np.uint64)}
    size, rest, out = 1, Q, None
    while size <= Q:
        h = have[size]
        if rest & size:
            out = h if out is None else _joined(h, out, Q & (size - 1))
        if len(h) > size:
            have[2 * size] = _joined(h, h, size)
        else:
            have[2 * size] = h[:0]
        size *= 2
    h = out[:max(0, len(c) - Q + 1)]
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _joined(head: np.ndarray, tail: np.ndarray, length: int) -> np.ndarray:
    """``tail`` hashes ``length`` characters; ``head`` those right after."""
    later = head[length:]
    n = min(len(later), len(tail))
    return tail[:n] * np.uint64(pow(_P, length + 1, 1 << 64)) + later[:n]


def banded_alignment(window: np.ndarray, region: np.ndarray, edits: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best place of the whole ``window`` in
    ``region`` (ends of the region are free), or None beyond ``edits``.
    Row by row over the region, whose width is the band."""
    n, m = len(window), len(region)
    cost, origin = np.zeros(m + 1, np.int64), np.arange(m + 1)
    steps = np.arange(m + 1)
    for i in range(n):
        diagonal = cost[:-1] + (region != window[i])
        up = cost + 1
        best, came = up.copy(), origin.copy()
        better = diagonal < up[1:]
        best[1:][better] = diagonal[better]
        came[1:][better] = origin[:-1][better]
        run = np.minimum.accumulate(best - steps)  # the cheapest to come from the left
        left = run + steps < best
        if left.any():
            source = np.maximum.accumulate(np.where(left, 0, steps))
            came = came[source]
            best = run + steps
        cost, origin = best, came
        if cost.min() > edits:
            return None
    j = int(np.argmin(cost))
    return (int(cost[j]), int(origin[j]), j) if cost[j] <= edits else None


class Block:
    """The characters of a bounded number of benchmark items, their windows as
    places in them, and their q-grams, each once for all windows that hold it.

    About 17 bytes per character go to the tasks. ``part`` is the shortest
    quotation of a longer item that counts; its seeds start every quarter of it.
    """

    def __init__(self, items: list[tuple[int, str]], part: int = PART):
        self.part, self.step = part, part // 4
        self.seed, self.part_edits = part - self.step + 1, part * EDITS_PER_100 // 100
        if self.seed + 1 - Q - Q * self.part_edits < 1:
            raise ValueError(f"parts of {part} characters share too few q-grams within their edits")
        self.owners: list[int | None] = []
        long: list[np.ndarray] = []
        short: dict[int, dict[bytes, list[int | None]]] = {}
        for item, text in items:
            c, _, _ = normalised([text])
            c = c[int(c[:1].sum() == 32):len(c) - int(c[-1:].sum() == 32)]
            if len(c) >= MIN_CHARS:
                long.append(c)
                self.owners.append(item)
            elif len(c):  # too short for its edits: matched as it is, by whole words
                short.setdefault(1 + int((c == 32).sum()), {}).setdefault(c.tobytes(), []).append(item)
        self.short = {n: _ShortItems(found) for n, found in short.items()}
        size = np.array([len(c) for c in long], np.int64)
        self.codes = np.concatenate([np.zeros(0, np.uint32), *long])
        self.begin = np.concatenate(([0], np.cumsum(size)))
        self.regular = np.maximum(0, -(-(size - WINDOW) // STEP))  # windows before the last
        self.last = np.maximum(0, size - WINDOW)
        self.seeds = np.where(size > part, (size - self.seed) // self.step + 1, 0)
        #: Windows are numbered item by item: regular ones, the last, the seeds.
        self.first = np.concatenate(([0], np.cumsum(self.regular + 1 + self.seeds)))
        h = gram_hashes(self.codes)
        at = np.arange(len(h))
        whole = at + Q <= self.begin[1:][np.searchsorted(self.begin, at, "right") - 1] if len(h) else at < 0
        order = np.argsort(h[whole], kind="stable")
        self.grams = h[whole][order]
        self.where = at[whole][order].astype(np.int32)

    def window(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(item, start in it, length, whether a seed) of windows by number."""
        item = np.searchsorted(self.first, w, "right") - 1
        k = w - self.first[item]
        seed = k > self.regular[item]
        start = np.where(seed, (k - self.regular[item] - 1) * self.step, np.where(k < self.regular[item], k * STEP, self.last[item]))
        length = np.where(seed, self.seed, np.minimum(WINDOW, self.begin[item + 1] - self.begin[item]))
        return item, start, length, seed

    def _windows_of(self, at: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(at, window, place in it) for every window around item q-grams."""
        item = np.searchsorted(self.begin, place, "right") - 1
        p = place - self.begin[item]
        out = [(p >= self.last[item], self.regular[item], self.last[item])]
        for j in range(-(-WINDOW // STEP)):
            k = p // STEP - j
            out.append(((k >= 0) & (k < self.regular[item]) & (p + Q <= k * STEP + WINDOW), k, k * STEP))
        for j in range(-(-self.seed // self.step)):
            k = p // self.step - j
            out.append(((k >= 0) & (k < self.seeds[item]) & (p + Q <= k * self.step + self.seed), self.regular[item] + 1 + k, k * self.step))
        return (np.concatenate([at[ok] for ok, _, _ in out]),
                np.concatenate([(self.first[item] + k)[ok] for ok, k, _ in out]),
                np.concatenate([(p - start)[ok] for ok, _, start in out]))

    @cached_property
    def table(self) -> np.ndarray:
        found = np.zeros(1 << _TABLE_BITS, bool)
        found[(self.grams >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True
        return found

    def hits(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in c, place among the items' characters) of every shared
        q-gram."""
        h = gram_hashes(c)
        at = np.flatnonzero(self.table[(h >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)])
        lo = np.searchsorted(self.grams, h[at], "left")
        count = np.searchsorted(self.grams, h[at], "right") - lo
        rows = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
        return np.repeat(at, count), self.where[rows].astype(np.int64)

    def matches(self, texts: list[str]) -> Iterator[tuple[int, int, int, int, int]]:
        """(index of the text, item, start, end, edits); positions are code
        points of the whole text."""
        joined, origin, starts = normalised(texts)
        begin = np.cumsum([0, *map(len, texts)])
        if self.short:
            yield from self._short_matches(joined, origin, starts, begin)
        if not len(self.grams):
            return
        at, window, where = self._windows_of(*self.hits(joined))
        text = np.searchsorted(starts, at, "right") - 1
        # Too few in the whole text: no band of it can reach the bound.
        pair = text * int(self.first[-1]) + window
        _, one, same, count = np.unique(pair, return_index=True, return_inverse=True, return_counts=True)
        _, _, length, seed = self.window(window[one])
        edits = np.where(seed, self.part_edits, length * EDITS_PER_100 // 100)
        need = np.maximum(1, length + 1 - Q - Q * edits)
        enough = (count >= need)[same]
        at, window, text, where, same = at[enough], window[enough], text[enough], where[enough], same[enough]
        edits, need = edits[same], need[same]
        width = edits + 1
        shift = at - starts[text] - where + WINDOW  # diagonal, not negative
        band = shift // width
        # Each diagonal lies in two of the overlapping bands [k, k + 2) * width.
        key = np.stack((np.concatenate((text, text)), np.concatenate((window, window)),
                        np.concatenate((band, band - 1)), np.tile(where, 2), np.tile(need, 2)))
        key = key[:, np.lexsort(key[3::-1])]
        new = np.ones(key.shape[1], bool)
        new[1:] = (key[:4, 1:] != key[:4, :-1]).any(axis=0)
        key = key[:, new]  # a q-gram of the window counts once in a band
        head = np.ones(key.shape[1], bool)
        head[1:] = (key[:3, 1:] != key[:3, :-1]).any(axis=0)
        first = np.flatnonzero(head)
        shared = np.diff(np.append(first, key.shape[1]))
        done: set[tuple[int, int, int]] = set()
        covered: dict[tuple[int, int | None], list[tuple[int, int]]] = {}
        kept = first[shared >= key[4, first]] if len(first) else first
        item, start, length, seed = self.window(key[1, kept])
        regions = zip(key[0, kept].tolist(), key[1, kept].tolist(), key[2, kept].tolist(), item.tolist(), start.tolist(), length.tolist(), seed.tolist())
        # Whole windows first: a seed within a place of its item tells no more.
        for t, w, k, i, a, n, is_seed in sorted(regions, key=lambda r: r[6]):
            codes = self.codes[self.begin[i]:self.begin[i + 1]]
            part, e = codes[a:a + n], self.part_edits if is_seed else n * EDITS_PER_100 // 100
            middle = int(starts[t]) + k * (e + 1) - WINDOW
            lo, hi = middle - e, middle + 2 * (e + 1) + n + e
            places = covered.setdefault((t, i), [])
            if is_seed and any(x <= lo + e and hi - 2 * e - 2 <= y for x, y in places):
                continue
            lo, hi = max(int(starts[t]), lo), min(int(starts[t + 1]), hi)
            found = _place(part, joined[lo:hi], e)
            if found and is_seed:
                lo = max(int(starts[t]), lo - self.step - e)
                around = [codes[b:b + self.part] for b in range(max(0, a - self.step + 1), min(a, len(codes) - self.part) + 1)]
                found = _best(around, joined[lo:min(int(starts[t + 1]), hi + self.step + e)], e)
            if found and (t, w, lo + found[1]) not in done:
                done.add((t, w, lo + found[1]))
                places.append((lo + found[1], lo + found[2]))
                yield (t, self.owners[i], int(origin[lo + found[1]] - begin[t]),
                       int(origin[lo + found[2] - 1] - begin[t]) + 1, found[0])

    def _short_matches(self, joined, origin, starts, begin):
        """Whole words that are a short item, character for character."""
        black = joined != 32
        edge = np.zeros(len(joined) + 1, bool)
        edge[starts] = True
        head = np.flatnonzero(black & (np.concatenate(([True], ~black[:-1])) | edge[:-1]))
        tail = np.flatnonzero(black & (np.concatenate((~black[1:], [True])) | edge[1:])) + 1
        text = np.searchsorted(starts, head, "right") - 1
        for n, items in self.short.items():
            if len(head) < n:
                continue
            a, b = head[:len(head) - n + 1], tail[n - 1:]
            fits = (text[:len(head) - n + 1] == text[n - 1:]) & (b - a <= items.longest)
            for x, y, t in zip(a[fits].tolist(), b[fits].tolist(), text[:len(head) - n + 1][fits].tolist()):
                for item in items.owners.get(joined[x:y].tobytes(), ()):
                    yield t, item, int(origin[x] - begin[t]), int(origin[y - 1] - begin[t]) + 1, 0


class _ShortItems:
    """Items of one number of words: owners by characters."""

    def __init__(self, owners: dict[bytes, list[int | None]]):
        self.owners, self.longest = owners, max(len(c) // 4 for c in owners)


def _exact(window: np.ndarray, region: np.ndarray) -> tuple[int, int, int] | None:
    raw = region.tobytes()
    at = raw.find(window.tobytes())
    while at > 0 and at % 4:
        at = raw.find(window.tobytes(), at + 1)
    return (0, at // 4, at // 4 + len(window)) if at >= 0 else None


def _place(window: np.ndarray, region: np.ndarray, edits: int) -> tuple[int, int, int] | None:
    return _exact(window, region) or banded_alignment(window, region, edits)


def _best(parts: list[np.ndarray], region: np.ndarray, edits: int) -> tuple[int, int, int] | None:
    """The place of that of the ``parts``, all of one length, with the fewest edits."""
    for part in parts:
        if found := _exact(part, region):
            return found
    cost, steps = np.zeros((len(parts), len(region) + 1), np.int64), np.arange(len(region) + 1)
    for column in np.stack(parts, axis=1):
        best = cost + 1
        np.minimum(best[:, 1:], cost[:, :-1] + (region != column[:, None]), out=best[:, 1:])
        cost = np.minimum.accumulate(best - steps, axis=1) + steps
        if cost.min() > edits:
            return None
    return banded_alignment(parts[int(np.argmin(cost.min(axis=1)))], region, edits)


def _scan(block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = block.value
        for batch in batches:
            ids, texts, part, held = list(zip(*(batch.column(i).to_pylist() for i in (2, 0)))), batch.column(1), 0, 0
            rows: list[tuple] = []
            for i in range(len(ids)):
                held += len(texts[i].as_buffer() or b"")
                if held >= PASS_CHARS or i + 1 == len(ids):
                    rows += [(*ids[part + m[0]], *m[1:]) for m in known.matches(texts.slice(part, i + 1 - part).to_pylist())]
                    part, held = i + 1, 0
            if rows:
                yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*rows)],
                                      names=["key", "id", "item_id", "start", "end", "edits"])

    return run


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, part: int) -> Iterator[Block]:
    items, held = [], 0
    for item, text in (benchmark.select(F.col(item_col).cast("long"), text_of(text_col))
                       .distinct().toLocalIterator(prefetchPartitions=False)):
        if items and held + len(text) > BLOCK_CHARS:
            yield Block(items, part)
            items, held = [], 0
        items.append((item, text))
        held += len(text)
    if items:
        yield Block(items, part)


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      item_col: str = "item_id", item_text_col: str = "text", part: int = PART) -> DataFrame:
    """(id, item_id, start, end, edits): places of documents that equal a window
    or a part of a benchmark item but for a few edits.

    Compared are letters, digits and marks in lower case; anything else is one
    space. Windows are whole items up to 160 characters, else 160 every 80; parts
    are any ``part`` characters from any start, with up to 6 edits
    per 100. A passage longer than a part gives several rows; parts within the
    place of a window or part already found give none. Items under 24 characters
    match where the same words stand, without edits. Null and empty texts, and
    items without a letter or digit, match nothing; texts of any length are
    scanned whole. An item or document without id still counts. Rows are
    distinct, so repeated rows add none.
    """
    return _keyed_matches(docs, benchmark, id_col, text_col, item_col, item_text_col, part).drop("key").distinct()


def _key(text_col: str):
    return F.xxhash64(text_of(text_col))


def _keyed_matches(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str,
                   item_col: str = "item_id", item_text_col: str = "text", part: int = PART) -> DataFrame:
    """The matches and a hash of the text, which tells rows without id, or with
    the same id, apart."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"), _key(text_col).alias("key"))
    found = []
    for block in _blocks(benchmark, item_col, item_text_col, part):
        shipped = spark.sparkContext.broadcast(block)
        found.append(materialize(map_arrow(texts, _scan(shipped), _KEYED).distinct(), "matches"))
        shipped.unpersist()
    if not found:
        return spark.createDataFrame([], _KEYED)
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def decontamination_report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id",
                           text_col: str = "text", **options) -> DataFrame:
    """Per row of ``docs``: id_col, contaminated, n_items, item_ids (sorted,
    comma-joined), spans (``item:start:end:edits``, by item and place). Each row
    is judged by its own text, also without id or with that of another row."""
    found = _keyed_matches(docs, benchmark, id_col, text_col, **options)
    place = F.struct("item_id", "start", "end", "edits")
    each = found.groupBy("id", "key").agg(F.array_sort(F.collect_set("item_id")).alias("items"),
                                   F.array_sort(F.collect_set(place)).alias("places"))
    joined = docs.select(F.col(id_col).alias("own_id"), _key(text_col).alias("own_key")).join(
        each, F.col("own_id").cast("long").eqNullSafe(F.col("id")) & (F.col("own_key") == F.col("key")), "left")
    return joined.select(
        F.col("own_id").alias(id_col), F.col("items").isNotNull().alias("contaminated"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce(F.array_join("items", ","), F.lit("")).alias("item_ids"),
        F.coalesce(F.array_join(F.transform("places", lambda p: F.concat_ws(":", p["item_id"], p["start"], p["end"], p["edits"])), ","),
                   F.lit("")).alias("spans"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id",
                         text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that hold a benchmark passage; rows without id
    are judged like others."""
    bad = (_keyed_matches(docs, benchmark, id_col, text_col, **options)
           .select(F.col("id").alias("bad_id"), F.col("key").alias("bad_key")).distinct())
    return docs.join(bad, docs[id_col].cast("long").eqNullSafe(F.col("bad_id"))
                     & (F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit(""))) == F.col("bad_key")), "left_anti")
