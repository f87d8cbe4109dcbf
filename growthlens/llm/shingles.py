"""Sets of hashed word shingles, many texts per numpy pass."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .common import SLICE_BYTES, slices, utf8

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PLACE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(kind: str, base: np.uint64, n: int) -> np.ndarray:
    found = _powers.get(kind)
    if found is None or len(found) < n:
        found = np.full(max(n, 1), base, np.uint64)
        found[0] = 1
        found = np.multiply.accumulate(found)
        if n <= SLICE_BYTES + 1:
            _powers[kind] = found
    return found[:n]


def word_hashes(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of the texts data[cuts[i]:cuts[i+1]], and the
    number of words in each text. Words are runs without ASCII white space."""
    n = len(data)
    black = ~_SPACE[data]
    at_cut = np.zeros(n + 1, bool)
    at_cut[cuts] = True
    before = np.concatenate(([False], black[:-1])) & ~at_cut[:n]
    starts = np.flatnonzero(black & ~before)
    after = np.concatenate((black[1:], [False])) & ~at_cut[1:]
    ends = np.flatnonzero(black & ~after) + 1
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * _power("up", _BASE, n), dtype=np.uint64)))
    hashes = (total[ends] - total[starts]) * _power("down", _INVERSE, n)[starts]
    return mix(hashes), np.diff(np.searchsorted(starts, cuts))


def shingle_sets(column, words: int) -> Iterator[np.ndarray]:
    """For each text of an Arrow string column the sorted distinct hashes of its
    ``words``-word shingles; a shorter text gives one for its whole sequence,
    one without words an empty set."""
    data, offsets = utf8(column)
    for a, b in slices(offsets):
        cuts = offsets[a:b + 1] - offsets[a]
        h, count = word_hashes(data[offsets[a]:offsets[b]], cuts)
        at = np.concatenate(([0], np.cumsum(count)))
        m = max(0, len(h) - words + 1)
        full = np.zeros(m, np.uint64)
        for j in range(words if m else 0):
            full += h[j:j + m] * _PLACE[j]
        full = mix(full)
        for i in range(b - a):
            lo, hi = at[i], at[i + 1]
            if hi - lo >= words:
                yield np.unique(full[lo:hi - words + 1])
            elif hi > lo:
                short = (h[lo:hi] * _PLACE[:hi - lo]).sum(dtype=np.uint64) + np.uint64(hi - lo)
                yield mix(np.array([short], np.uint64))
            else:
                yield np.zeros(0, np.uint64)
