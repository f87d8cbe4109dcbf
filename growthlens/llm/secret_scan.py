"""Secret scans: random strings found by how badly a vocabulary tokenises them.

Text that looks like language takes few tokens for its characters; keys and
passwords take many. Candidate strings with few characters per token under a
tiktoken vocabulary are reported, after known digests and identifiers are set
aside: whole runs, their parts between separators, and windows of tokens, so
that readable text joined to a key does not hide it. Fixed patterns for assignments, access keys and hex runs are reported
besides, whatever their token count.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, text_of

VOCABULARY = "byte_bpe_50k.tiktoken"
#: A candidate is random below so many characters per token.
CHARS_PER_TOKEN, MIN_CHARS, CANDIDATE_CHARS = 2.2, 16, 4096
#: Windows are the tokens that reach so many characters. They, and strings that
#: are shorter or without a digit, as words are, are held to a stricter limit.
WINDOW_CHARS, STRICT = 20, 0.8
#: Letters of one case take more characters per token than mixed ones do, also
#: random ones: 0.95 of random strings of 20 stay below this share of the limit,
#: and no word so long of the four languages does.
ONE_CASE = 0.93
#: Order of kinds that start at the same place.
KINDS = ("assign", "access", "hex", "random")

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ASSIGN_WORDS = (b"passw", b"secret", b"token", b"api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_CHARS)
_PART = re.compile(r"[A-Za-z0-9]{%d,}" % MIN_CHARS)
_CLASSES = re.compile(r"[A-Za-z]+|[0-9]+|[+/_=-]+")
_NUMBERS = re.compile(r"[0-9+/_=-]*")
#: Digests (MD5, SHA-1, SHA-224/256/384/512 in hex) and UUIDs: random looking,
#: but identifiers, not secrets.
_KNOWN = re.compile(
    r"(?<![A-Za-z0-9])(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128}"
    r"|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12})(?![A-Za-z0-9])")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns; each kind leftmost and without
    overlap, matches that fail their length test dropped afterwards."""
    found = []
    raw = text.encode("utf-8", "surrogatepass")
    low = raw.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        found += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in raw:
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    # Runs under 24 characters fail anyhow; longer ones are matched whole.
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


class TokenTest:
    def __init__(self, vocabulary: str, limit: float):
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._code = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._chars = np.zeros(max(ranks.values()) + 1, np.int64)
        self._chars[list(ranks.values())] = [len(token) for token in ranks]
        self._limit = limit

    def random_spans(self, text: str) -> list[tuple[int, int, str]]:
        found = []
        for m in _CANDIDATE.finditer(text):
            at = m.start()
            for known in (*_KNOWN.finditer(text, at, m.end()), None):
                stop = known.start() if known else m.end()
                if stop - at >= MIN_CHARS:
                    found += [(at + a, at + b, "random") for a, b in self._random(text[at:stop])]
                at = known.end() if known else stop
        return found

    def _random(self, s: str) -> list[tuple[int, int]]:
        """(start, end) of the random places in a run, apart from each other."""
        if _NUMBERS.fullmatch(s):
            return []
        chars = self._tokens(s)
        found = [m.span() for m in _PART.finditer(s) if self._low(m[0], self._tokens(m[0]))]
        # Separators are tokens of their own in readable names: not counted.
        end = np.cumsum(chars)
        start = end - chars
        word = np.array([any(map(str.isalnum, s[a:b])) for a, b in zip(start.tolist(), end.tolist())])
        if self._low(s, chars) and (self._share(s) == 1 or self._low(s, chars[word])):
            found.append((0, len(s)))
        start, end, chars = start[word], end[word], chars[word]
        upto = np.cumsum(chars)
        last = np.searchsorted(upto, upto - chars + WINDOW_CHARS)
        first = np.flatnonzero(last < len(end))
        last = last[first]
        low = upto[last] - upto[first] + chars[first] < self._limit * STRICT * (last - first + 1)
        for i, j in zip(first[low].tolist(), last[low].tolist()):
            while i < j and chars[i] > 3:
                i += 1
            while i < j and chars[j] > 3:
                j -= 1
            found.append((int(start[i]), int(end[j])))
        out: list[tuple[int, int]] = []
        for a, b in sorted(x for x in found if not _NUMBERS.fullmatch(s, *x)):
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], max(out[-1][1], b))
            else:
                out.append((a, b))
        return out

    def _share(self, s: str) -> float:
        """How much of the limit holds for a string, by its alphabet."""
        if len(s) < WINDOW_CHARS:
            return STRICT
        if any(map(str.isdigit, s)):
            return 1.0
        return ONE_CASE if s.isalpha() and (s.islower() or s.isupper()) else STRICT

    def _low(self, s: str, chars: np.ndarray) -> bool:
        return chars.sum() < self._limit * self._share(s) * len(chars)

    def _tokens(self, s: str) -> np.ndarray:
        # In pieces, so that one very long run costs no more than its length, cut
        # where letters, digits and separators meet: no token spans that.
        out, at = [], 0
        while len(s) - at > CANDIDATE_CHARS:
            ends = [m.end() for m in _CLASSES.finditer(s, at, at + CANDIDATE_CHARS)]
            stop = ends[-2] if len(ends) > 1 else at + CANDIDATE_CHARS
            out += self._code.encode_ordinary(s[at:stop])
            at = stop
        return self._chars[out + self._code.encode_ordinary(s[at:])]


_tests: dict[tuple[str, float], TokenTest] = {}


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def _scan(vocabulary: str, limit: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (vocabulary, limit) not in _tests:
            _tests[vocabulary, limit] = TokenTest(vocabulary, limit)
        test = _tests[vocabulary, limit]
        for batch in batches:
            counts: tuple[list, list, list] = ([], [], [])
            base, spans = [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                own = base_spans(text)
                every = sorted(own + test.random_spans(text), key=lambda s: (s[0], KINDS.index(s[2])))
                for out, kind in zip(counts, KINDS):
                    out.append(sum(s[2] == kind for s in own))
                base.append(hashlib.sha256(_joined(own).encode()).hexdigest())
                spans.append(_joined(every))
            yield pa.record_batch([batch.column(0), *(pa.array(x, pa.int64()) for x in counts),
                                   pa.array(base, pa.string()), pa.array(spans, pa.string())],
                                  names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return run


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                vocabulary: str | None = None, chars_per_token: float = CHARS_PER_TOKEN) -> DataFrame:
    """Per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256 (of the
    joined fixed-pattern spans) and spans (all, ``kind:start:end`` by start, then
    kind; code points, end exclusive).

    A null or empty text has no spans and the digest of the empty string; a text
    or run of any length is read whole.
    Repeated rows come out each, a null id stays null, other columns are ignored.
    """
    vocabulary = str(vocabulary or public_tokenizers.path(VOCABULARY))
    return map_arrow(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")),
        _scan(vocabulary, chars_per_token),
        "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
