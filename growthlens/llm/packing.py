"""Sum-of-squares online packing of tokenised documents into fixed windows.

Each task packs the documents of its partition as they come. A level array
counts the open windows by fill; a document goes to the fill (or a new window)
that leaves the sum of the squared counts smallest. Documents longer than a
window fill whole windows first. Beyond a bound of open windows the fullest is
completed by cutting a piece of the emptiest. Windows still open at the end are
all completed so, and the last one is cut into powers of two, which take no
padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, text_of
from .tokens import word_tokenizer

WINDOW, END_ID, VOCABULARY = 2048, 1, "word_bpe_49k.json"
#: Open windows that a task holds; the memory for their tokens.
MOST_OPEN = 2048
_ID_BYTES = 4
_SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
           "sequence_id long, offset long")


class Piece:
    __slots__ = ("doc", "start", "ids", "total")

    def __init__(self, doc, start: int, ids: bytes, total: int):
        self.doc, self.start, self.ids, self.total = doc, start, ids, total

    def __len__(self) -> int:
        return len(self.ids) // _ID_BYTES

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return (Piece(self.doc, self.start, self.ids[:n * _ID_BYTES], self.total),
                Piece(self.doc, self.start + n, self.ids[n * _ID_BYTES:], self.total))


class Packer:
    """``add`` and ``close`` return completed windows, as lists of pieces."""

    def __init__(self, window: int = WINDOW, most_open: int = MOST_OPEN):
        self.window, self.most_open = window, most_open
        self.level = np.zeros(window + 1, np.int64)  # open windows by fill
        self.open: list[list[list[Piece]]] = [[] for _ in range(window)]
        self.n_open = 0

    def add(self, piece: Piece) -> list[list[Piece]]:
        done = []
        while len(piece) >= self.window:
            head, piece = piece.cut(self.window)
            done.append([head])
        if len(piece):
            done += self._place(piece)
        if self.n_open > self.most_open:
            done += self._fill_fullest()
        return done

    def _fill_fullest(self) -> list[list[Piece]]:
        """Complete the fullest open window by cutting a piece of the emptiest;
        the rest stay open and go on as before."""
        held = np.flatnonzero(self.level)
        full, empty = int(held[-1]), int(held[0])
        pieces = self._taken(full)
        while full < self.window:
            other = self._taken(empty)
            piece = other.pop()
            left = empty - len(piece)
            if len(piece) > self.window - full:
                piece, rest = piece.cut(self.window - full)
                other.append(rest)
                left += len(rest)
            pieces.append(piece)
            full += len(piece)
            if left:
                self._put(left, other)
                empty = left
            else:
                empty = int(np.flatnonzero(self.level)[0])
        return [pieces]

    def _taken(self, fill: int) -> list[Piece]:
        self.level[fill] -= 1
        self.n_open -= 1
        return self.open[fill].pop()

    def _put(self, fill: int, pieces: list[Piece]) -> None:
        self.open[fill].append(pieces)
        self.level[fill] += 1
        self.n_open += 1

    def _place(self, piece: Piece) -> list[list[Piece]]:
        n, count = len(piece), self.level
        # Change of the sum of squares for the fills 1 .. window - n.
        fills = count[1:self.window - n + 1]
        change = 2 * (count[n + 1:self.window + 1] - fills + 1)
        if len(change):
            change[-1] = 1 - 2 * fills[-1]  # a full window leaves the array
            change = np.where(fills > 0, change, np.iinfo(np.int64).max)
            best = len(change) - 1 - int(np.argmin(change[::-1]))  # of equals, the fullest
            at = best + 1 if change[best] <= 2 * count[n] + 1 else 0
        else:
            at = 0
        if at:
            pieces = self.open[at].pop()
            self.level[at] -= 1
        else:
            pieces = []
            self.n_open += 1
        pieces.append(piece)
        if at + n == self.window:
            self.n_open -= 1
            return [pieces]
        self.open[at + n].append(pieces)
        self.level[at + n] += 1
        return []

    def close(self) -> list[list[Piece]]:
        """Complete all open windows by cutting."""
        left = [(fill, pieces) for fill in range(self.window) for pieces in self.open[fill]]
        self.open = [[] for _ in range(self.window)]
        self.level[:] = 0
        self.n_open = 0
        done: list[list[Piece]] = []
        spare: list[Piece] = []  # of the emptiest windows
        while left:
            fill, pieces = left.pop()  # the fullest
            while fill < self.window and (spare or left):
                if not spare:
                    spare = left.pop(0)[1]
                piece = spare.pop()
                if len(piece) > self.window - fill:
                    piece, rest = piece.cut(self.window - fill)
                    spare.append(rest)
                pieces.append(piece)
                fill += len(piece)
            done += [pieces] if fill == self.window else self._powers(pieces)
        if spare:
            done += self._powers(spare)
        return done

    def _powers(self, pieces: list[Piece]) -> list[list[Piece]]:
        """Windows of as many ids as the binary digits of their number say."""
        done = []
        rest = sum(map(len, pieces))
        while rest:
            size = 1 << (rest.bit_length() - 1)
            rest -= size
            out: list[Piece] = []
            while size:
                piece = pieces.pop(0)
                if len(piece) > size:
                    piece, later = piece.cut(size)
                    pieces.insert(0, later)
                out.append(piece)
                size -= len(piece)
            done.append(out)
        return done


def _pack(vocabulary: str, window: int, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, packer = word_tokenizer(vocabulary), Packer(window)
        # Windows of one partition have ids of their own, the same on a rerun.
        sequence = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []

        def number(done: list[list[Piece]]) -> None:
            nonlocal sequence
            for pieces in done:
                offset = 0
                for p in pieces:
                    rows.append((p.doc, p.start, len(p), zlib.crc32(p.ids), p.total, sequence, offset))
                    offset += len(p)
                sequence += 1

        def batch_of() -> pa.RecordBatch:
            out = pa.record_batch([pa.array(x, pa.int64()) for x in zip(*rows)],
                                  names=[x.split()[0] for x in _SCHEMA.split(", ")])
            rows.clear()
            return out

        for batch in batches:
            for doc, found in zip(batch.column(0).to_pylist(), tokenizer.each(batch.column(1))):
                tokens = found + end
                number(packer.add(Piece(doc, 0, tokens, len(tokens) // _ID_BYTES)))
                if len(rows) >= 20_000:
                    yield batch_of()
        number(packer.close())
        if rows:
            yield batch_of()

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None,
         window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece of a document: doc_id, start (its ids before it),
    length, ids_crc32, doc_tokens, sequence_id, offset (in the sequence).

    Each document is its ids (no special tokens added), then ``end_id``; a null
    or empty text is ``end_id`` alone. Each id lies in exactly one piece, and a
    sequence's offsets have no gap. Sequences are full, or hold a power of two
    of ids. Repeated rows are packed each; a null id stays null. An empty table
    gives no rows. Other columns are ignored. Texts of any length are packed
    whole. A vocabulary of another kind than word-end BPE tokenises whole texts.
    """
    vocabulary = vocabulary or public_tokenizers.path(VOCABULARY)
    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")),
                     _pack(str(vocabulary), window, end_id), _SCHEMA)
