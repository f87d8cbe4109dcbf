"""Whole texts to token ids of a word-end BPE vocabulary, word by word.

White space is dropped and bounds every token of such a vocabulary, so a text's
ids are those of its words put together. Words recur, so each worker process
keeps the ids of the words it met, by two 64-bit hashes in sorted arrays: about
40 bytes a word, looked up for half a megabyte of text at a time. The store is
bounded in bytes and starts anew when it is full.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import slices, utf8
from .shingles import _BASE, _INVERSE, _SPACE, _power, mix

#: Bytes of hashes and ids that a worker keeps; longer words are tokenised anew
#: each time.
KEPT_BYTES, LONGEST = 40 << 20, 256
#: Words of these characters only, and so short, are split here; any other goes
#: through the tokenizer whole. Their parts, of 64 characters at most, recur too.
_PLAIN = re.compile("[\x21-\x7eÀ-ÖØ-öø-ÿ]{1,64}")
_PART = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
KEPT_PARTS = 80_000
#: Texts by which a vocabulary shows whether it works as assumed.
_PROBES = ("Two words", " lead and  gap", "a\nb c", "It's x2y, 3.14 don't! #tag", "Über-all naïve")
_rng = np.random.default_rng(20240615)
_BYTES = _rng.integers(1, 1 << 63, (2, 256), dtype=np.uint64)
assert sys.byteorder == "little" and array("I").itemsize == 4


def _words(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, two hashes) of the words of the texts data[cuts[i]:cuts[i+1]]."""
    n = len(data)
    black = ~_SPACE[data]
    at_cut = np.zeros(n + 1, bool)
    at_cut[cuts] = True
    starts = np.flatnonzero(black & ~(np.concatenate(([False], black[:-1])) & ~at_cut[:n]))
    ends = np.flatnonzero(black & ~(np.concatenate((black[1:], [False])) & ~at_cut[1:])) + 1
    up, down = _power("up", _BASE, n), _power("down", _INVERSE, n)
    hashes = []
    for table in _BYTES:
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(table[data] * up, dtype=np.uint64)))
        hashes.append(mix((total[ends] - total[starts]) * down[starts]))
    return starts, ends, hashes[0], hashes[1]


class WordTokenizer:
    """``ids(text)``: little-endian 32-bit ids of ``text`` as bytes; ``each`` for
    a column of texts."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._all = Tokenizer.from_file(vocabulary)
        # A vocabulary of another kind tokenises whole texts.
        self._by_word = all(b"".join(map(self._whole, t.split())) == self._whole(t) for t in _PROBES)
        # Whether words split here, as this kind of vocabulary splits them, give
        # what the tokenizer gives; else it takes each word itself.
        self._parts: dict[str, bytes] = {}
        self._split_here = all(self._split(w) == self._whole(w) for text in _PROBES for w in text.split() if _PLAIN.fullmatch(w))
        self.clear()

    def clear(self) -> None:
        self._key, self._check = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self._at, self._size = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self._ids = np.zeros(0, np.uint32)

    def held_bytes(self) -> int:
        return sum(x.nbytes for x in (self._key, self._check, self._at, self._size, self._ids))

    def ids(self, text: str) -> bytes:
        return next(self.each(pa.array([text])))

    def each(self, column: pa.Array) -> Iterator[bytes]:
        if not self._by_word:
            for text in column:
                yield self._whole(text.as_py() or "")
            return
        data, offsets = utf8(column)
        for a, b in slices(offsets):
            yield from self._slice(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])

    def _slice(self, data: np.ndarray, cuts: np.ndarray) -> Iterator[bytes]:
        start, end, key, check = _words(data, cuts)
        place = np.searchsorted(self._key, key)
        known = place < len(self._key)
        known[known] = (self._key[place[known]] == key[known]) & (self._check[place[known]] == check[known])
        at, size = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
        at[known], size[known] = self._at[place[known]], self._size[place[known]]
        pool, missing = self._ids, np.flatnonzero(~known)
        if len(missing):
            order = missing[np.lexsort((check[missing], key[missing]))]
            new = np.ones(len(order), bool)
            new[1:] = (key[order[1:]] != key[order[:-1]]) | (check[order[1:]] != check[order[:-1]])
            first = order[new]
            raw = data.tobytes()
            found = self._each_of([raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip(start[first].tolist(), end[first].tolist())])
            sizes = np.array([len(x) // 4 for x in found], np.int64)
            own = np.cumsum(sizes) - sizes
            pool = np.concatenate((pool, np.frombuffer(b"".join(found), np.uint32)))
            at[order] = (own + len(self._ids))[np.cumsum(new) - 1]
            size[order] = sizes[np.cumsum(new) - 1]
            self._keep(key[first], check[first], own, sizes, found, end[first] - start[first])
        yield from self._spelled(pool, at, size, np.searchsorted(start, cuts))

    @staticmethod
    def _spelled(pool: np.ndarray, at: np.ndarray, size: np.ndarray, first: np.ndarray) -> Iterator[bytes]:
        upto = np.concatenate(([0], np.cumsum(size)))
        raw = pool[np.repeat(at - upto[:-1], size) + np.arange(upto[-1])].tobytes()
        for a, b in zip(upto[first[:-1]].tolist(), upto[first[1:]].tolist()):
            yield raw[4 * a:4 * b]

    def _keep(self, key, check, own, sizes, found: list[bytes], length) -> None:
        """Store new words, sorted by key; of equal keys one."""
        fits = length <= LONGEST
        fits[1:] &= key[1:] != key[:-1]
        if self.held_bytes() + int(fits.sum()) * 24 + 4 * int(sizes[fits].sum()) > KEPT_BYTES:
            self.clear()
            if int(fits.sum()) * 24 + 4 * int(sizes[fits].sum()) > KEPT_BYTES:
                return
        place = np.searchsorted(self._key, key)
        inside = place < len(self._key)
        fits[inside] &= self._key[place[inside]] != key[inside]
        sizes = sizes[fits]
        base = len(self._ids)
        self._ids = np.concatenate((self._ids, np.frombuffer(b"".join(x for x, f in zip(found, fits) if f), np.uint32)))
        place = place[fits]
        self._key = np.insert(self._key, place, key[fits])
        self._check = np.insert(self._check, place, check[fits])
        self._at = np.insert(self._at, place, (base + np.cumsum(sizes) - sizes).astype(np.int32))
        self._size = np.insert(self._size, place, sizes.astype(np.int32))

    def _each_of(self, words: list[str]) -> list[bytes]:
        if not self._split_here:
            return list(map(self._whole, words))
        return [self._split(w) if _PLAIN.fullmatch(w) and "<|" not in w else self._whole(w) for w in words]

    def _split(self, word: str) -> bytes:
        get, new = self._parts.get, self._part
        return b"".join([get(p) or new(p) for p in _PART.findall(word.lower())])

    def _part(self, part: str) -> bytes:
        if part.isascii():  # the byte alphabet is these characters themselves
            found = array("I", [t.id for t in self._all.model.tokenize(part)]).tobytes()
        else:
            found = self._whole(part)
        if len(self._parts) >= KEPT_PARTS:
            self._parts.clear()
        self._parts[part] = found
        return found

    def _whole(self, text: str) -> bytes:
        return array("I", self._all.encode(text, add_special_tokens=False).ids).tobytes()


_found: dict[str, WordTokenizer] = {}


def word_tokenizer(vocabulary: str) -> WordTokenizer:
    """One per worker process, which keeps it from task to task."""
    if vocabulary not in _found:
        _found[vocabulary] = WordTokenizer(vocabulary)
    return _found[vocabulary]
