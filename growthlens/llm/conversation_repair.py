"""Repair of conversation structure by a grammar-compressed dynamic programme.

A row of a conversation is a symbol of a small alphabet: its role's initial and
its fault. What the cheapest edits do to a run of symbols is a min-plus transfer
matrix: for each pair of grammar states (before, after) the least cost and, of
equal cost, the ASCII-least audit. Matrices of neighbouring runs multiply.

Re-Pair replaces the most frequent pair of neighbours by a new symbol again and
again, over the sequences of many conversations at once. Each rule's matrix is
the product of its two sides' matrices, worked out bottom-up once and shared by
every conversation that holds the rule; audits are ropes, whose parts are shared
likewise and written out at the end only.

Why the order (cost, audit) survives multiplication: a row's edit costs what its
initial says, and so does an insertion, so an audit's text fixes its cost. Of two
audits of one run neither is then a proper prefix of the other at the same cost,
and comparing them decides the comparison of whatever follows them.

Conversations are streamed in order and never held: a task keeps one character
per row of a conversation, as its audit has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, map_arrow, materialize

#: What the edits cost, and the grammar ``(s?(ua)+)?``.
RETAIN, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
ROLES = {"u": "user", "a": "assistant"}
#: States: nothing yet, after the system row, after a user row, after an
#: assistant row; and where a row of an initial leads.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ACCEPT = (START, ASSISTANT)
LEGAL = ("su", "ua", "au")
#: Symbols: initials in lower case, in upper case if truncated; rows of other
#: initials o and O; rows that must go.
GONE = "x"
SYMBOLS = "sSuUaAoO" + GONE
#: Symbols whose sequences one grammar is made of.
BLOCK_SYMBOLS = 1 << 20


# -- ropes -------------------------------------------------------------------------

_P, _M = 0x1F3D5B79, (1 << 61) - 1


class Rope:
    """A text as a tree; equal texts have equal (length, mark)."""

    __slots__ = ("left", "right", "text", "length", "mark", "power")

    def __init__(self, text: str = "", left: Rope | None = None, right: Rope | None = None):
        self.left, self.right, self.text = left, right, text
        if left is None:
            self.length, self.mark, self.power = len(text), 0, pow(_P, len(text), _M)
            for c in text:
                self.mark = (self.mark * _P + ord(c)) % _M
        else:
            self.length = left.length + right.length
            self.mark = (left.mark * right.power + right.mark) % _M
            self.power = left.power * right.power % _M

    def __str__(self) -> str:
        out, waiting = [], [self]
        while waiting:
            r = waiting.pop()
            if r.left is None:
                out.append(r.text)
            else:
                waiting += (r.right, r.left)
        return "".join(out)


EMPTY = Rope()


def joined(a: Rope, b: Rope) -> Rope:
    return b if not a.length else a if not b.length else Rope(left=a, right=b)


def before(a: Rope, b: Rope) -> bool:
    """Whether a's text is less than b's. Equal parts in step are passed over."""
    x, y = [a], [b]
    while x and y:
        p, q = x.pop(), y.pop()
        if p is q or (p.length == q.length and p.mark == q.mark):
            continue
        if p.left is not None and (p.length >= q.length or q.left is None):
            x += (p.right, p.left)
            y.append(q)
        elif q.left is not None:
            y += (q.right, q.left)
            x.append(p)
        else:
            n = min(p.length, q.length)
            if p.text[:n] != q.text[:n]:
                return p.text[:n] < q.text[:n]
            if p.length > n:
                x.append(Rope(p.text[n:]))
            if q.length > n:
                y.append(Rope(q.text[n:]))
    return bool(y) and not x


# -- transfer matrices ----------------------------------------------------------------

#: 4 x 4 of (cost, audit), None where no edits lead there.
Matrix = tuple


def _better(new, old) -> bool:
    return old is None or new[0] < old[0] or (new[0] == old[0] and before(new[1], old[1]))


def times(a: Matrix, b: Matrix) -> Matrix:
    """The matrix of a run and the run after it; of any number of first states."""
    out = []
    for row in a:
        new = [None] * 4
        for k, first in enumerate(row):
            if first is None:
                continue
            for j, second in enumerate(b[k]):
                if second is None or (new[j] is not None and first[0] + second[0] > new[j][0]):
                    continue
                found = (first[0] + second[0], joined(first[1], second[1]))
                if _better(found, new[j]):
                    new[j] = found
        out.append(tuple(new))
    return tuple(out)


def insertions() -> Matrix:
    """Any rows inserted at one place; more than two lead nowhere new."""
    out = [[(0, EMPTY) if i == j else None for j in range(4)] for i in range(4)]
    for i in range(4):
        at, cost = i, 0
        for n in (1, 2):
            at = next((NEXT[at, r] for r in ROLES if (at, r) in NEXT), None)
            cost += INSERT
            if at is not None and _better((cost, Rope("I" * n)), out[i][at]):
                out[i][at] = (cost, Rope("I" * n))
    return tuple(map(tuple, out))


def row_edits(symbol: str) -> Matrix:
    """One row kept, given another role or deleted."""
    out = [[(DELETE, Rope("D")) if i == j else None for j in range(4)] for i in range(4)]
    if symbol != GONE:
        more = TRUNCATED if symbol.isupper() else 0
        for i in range(4):
            for initial in "sua":
                j = NEXT.get((i, initial))
                if j is None:
                    continue
                if initial == symbol.lower():
                    edit = (RETAIN + more, Rope("K"))
                elif initial in ROLES:
                    edit = (REROLE + more, Rope("R"))
                else:
                    continue
                if _better(edit, out[i][j]):
                    out[i][j] = edit
    return tuple(map(tuple, out))


_INSERTIONS = insertions()
#: Insertions, then a row's own edit: whatever follows begins with insertions.
TERMINAL = {s: times(_INSERTIONS, row_edits(s)) for s in SYMBOLS}


# -- Re-Pair ------------------------------------------------------------------------------

def re_pair(data: np.ndarray, symbols: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(the compressed data, the rules). Symbols are 0 .. symbols - 1, -1 ends a
    sequence and stays; rule k is the symbol ``symbols + k``. A round replaces
    the most frequent pair, and with it the next ones that share no symbol with
    a pair already chosen: they would not be touched by its replacement."""
    rules: list[tuple[int, int]] = []
    while True:
        total = symbols + len(rules)
        inside = (data[:-1] >= 0) & (data[1:] >= 0)
        pairs, count = np.unique((data[:-1] * total + data[1:])[inside], return_counts=True)
        chosen: dict[int, int] = {}
        used: set[int] = set()
        for k in np.argsort(-count, kind="stable")[:4096].tolist():
            if count[k] < 2:
                break
            a, b = divmod(int(pairs[k]), total)
            if a not in used and b not in used:
                used |= {a, b}
                chosen[a * total + b] = symbols + len(rules) + len(chosen)
        if not chosen:
            return data, rules
        codes = np.where(inside, data[:-1] * total + data[1:], -1)
        keys = np.array(sorted(chosen), np.int64)
        slot = np.minimum(np.searchsorted(keys, codes), len(keys) - 1)
        at = np.flatnonzero(keys[slot] == codes)
        # Within a run of one symbol its pairs overlap: every other one counts.
        follows = np.concatenate(([False], np.diff(at) == 1))
        run = np.maximum.accumulate(np.where(follows, 0, np.arange(len(at))))
        at = at[(np.arange(len(at)) - run) % 2 == 0]
        data = data.copy()
        data[at] = np.array([chosen[int(k)] for k in keys])[slot[at]]
        keep = np.ones(len(data), bool)
        keep[at + 1] = False
        data = data[keep]
        rules += [divmod(c, total) for c, _ in sorted(chosen.items(), key=lambda x: x[1])]


def repairs(sequences: list[str]) -> list[tuple[int, str]]:
    """(cost, audit) of the cheapest repair of each sequence of symbols, over one
    grammar for all of them."""
    different = list(dict.fromkeys(sequences))
    code = np.full(128, -1, np.int64)
    code[[ord(c) for c in SYMBOLS]] = np.arange(len(SYMBOLS))
    data = code[np.frombuffer(("\n".join(different) + "\n").encode(), np.uint8)]
    packed, rules = re_pair(data, len(SYMBOLS))
    matrix = [TERMINAL[s] for s in SYMBOLS]
    for a, b in rules:
        matrix.append(times(matrix[a], matrix[b]))
    found, now = {}, iter(different)
    begin = ((0, EMPTY), None, None, None)
    state: Matrix = (begin,)
    for symbol in packed.tolist():
        if symbol >= 0:
            state = times(state, matrix[symbol])
            continue
        ends, best = times(state, _INSERTIONS)[0], None
        for s in ACCEPT:
            if ends[s] is not None and _better(ends[s], best):
                best = ends[s]
        found[next(now)] = (best[0], str(best[1]))
        state = (begin,)
    return [found[s] for s in sequences]


# -- Spark -----------------------------------------------------------------------------------

def _blank_for_null(c: str, kind: str = "string") -> Column:
    return F.coalesce(F.col(c).cast(kind), F.lit(" "))


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
            text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, gone): the rows with the faults that
    crc32(``conv_id:turn``) % 20 picks; a null counts as one space. Dropped rows
    stay, marked ``gone``, so that their conversation does."""
    pick = F.crc32(F.concat(_blank_for_null(conv_col), F.lit(":"), _blank_for_null(turn_col))) % 20
    text = _blank_for_null(text_col)
    return rows.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        F.when(pick == 4, "user").otherwise(_blank_for_null(role_col)).alias("role"),
        F.when(pick.isin(0, 1), "").when(pick == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (pick == 0).alias("gone"),
        F.explode(F.when(pick == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def marked(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text, gone) and ``symbol``, but for
    duplicates within one turn; ``later``: an earlier turn has the same role and
    text. The earliest turn of a text is a pre-aggregated minimum, so a text or
    a conversation of any number of rows is no task's burden."""
    rows = rows.withColumn("same", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    earliest = (rows.filter(~F.col("gone")).groupBy("conv_id", "same")
                .agg(F.min("turn").alias("first_turn"), F.max(F.col("turn").isNull()).alias("unplaced"))
                .withColumnsRenamed({"conv_id": "of", "same": "what"}))
    tail = F.rtrim("text", F.lit(SPACE))
    last, initial = F.substring(tail, -1, 1), F.substring("role", 1, 1)
    role = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    symbol = (F.when(tail == "", GONE).when(last.isin(".", "!", "?"), role).otherwise(F.upper(role)))
    met = rows.join(earliest, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("same") == F.col("what")), "left")
    later = F.col("turn").isNotNull() & (F.col("unplaced") | (F.col("turn") > F.col("first_turn")))
    return met.select("conv_id", "turn", "role", "text", "gone", F.coalesce(later, F.lit(False)).alias("later"),
                      (tail == "").alias("blank"), symbol.alias("symbol"))


_FACTS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, symbols string"


def _in_order(rows: DataFrame) -> DataFrame:
    """Conversations together, rows by turn (nulls first), then role and text."""
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")


class _Facts:
    """What is counted of one conversation while its rows go by."""

    def __init__(self, conv):
        self.conv, self.first, self.last, self.turns = conv, None, None, 0
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.symbols: list[str] = []
        self.row = self.initial = None

    def add(self, turn, role, text, later, blank, symbol) -> None:
        if turn is not None:
            if turn != self.last:
                self.turns += 1
            self.first = turn if self.first is None else self.first
            self.last = turn
        if self.initial is not None and self.initial + role[:1] not in LEGAL:
            self.illegal += 1
        self.initial = role[:1]
        again = later or self.row == (turn, role, text)  # equal rows of a turn are neighbours
        self.row = (turn, role, text)
        if blank:
            self.blank += 1
        elif again:
            self.duplicate += 1
            symbol = GONE
        elif symbol.isupper():
            self.truncated += 1
        self.symbols.append(symbol)

    def result(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return (self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, "".join(self.symbols))


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _FACTS.split(", ")]
    types = [pa.int64()] * 6 + [pa.string()]
    at: _Facts | None = None
    done: list[tuple] = []
    held = 0
    for batch in batches:
        for conv, turn, role, text, gone, later, blank, symbol in zip(*(c.to_pylist() for c in batch.columns)):
            if at is None or conv != at.conv:
                if at is not None:
                    done.append(at.result())
                    held += len(done[-1][-1])
                at = _Facts(conv)
            if not gone:
                at.add(turn, role, text, later, blank, symbol)
        if held + len(done) > BLOCK_SYMBOLS:
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*done), types)], names=names)
            done, held = [], 0
    if at is not None:
        done.append(at.result())
        yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*done), types)], names=names)


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows with cost and audit; a grammar for each block of rows."""
    for batch in batches:
        sequences, part, held = batch.column(batch.num_columns - 1).to_pylist(), 0, 0
        for i, s in enumerate(sequences):
            held += len(s) + 1
            if held >= BLOCK_SYMBOLS or i + 1 == len(sequences):
                found = repairs(sequences[part:i + 1])
                costs, audits = zip(*found)
                rows = batch.slice(part, i + 1 - part)
                yield pa.record_batch([*rows.columns[:-1], pa.array(costs, pa.int64()), pa.array(audits, pa.string())],
                                      names=[*batch.schema.names[:-1], "cost", "audit"])
                part, held = i + 1, 0


class _Writer:
    """The hash of a repaired conversation, row by row."""

    def __init__(self, conv):
        self.conv, self.audit, self.at, self.state, self.hash, self.empty = conv, "", 0, START, hashlib.sha256(), True

    def _line(self, role: str, text: str) -> None:
        if not self.empty:
            self.hash.update(b"\n")
        self.empty = False
        self.hash.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
        self.state = NEXT[self.state, role[0]]

    def _due(self) -> str:
        return ROLES["a" if self.state == USER else "u"]

    def _insert(self) -> None:
        while self.audit[self.at:self.at + 1] == "I":
            self._line(self._due(), "")
            self.at += 1

    def add(self, role: str, text: str) -> None:
        self._insert()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            self._line(role if edit == "K" else self._due(), text)

    def result(self) -> tuple:
        self._insert()
        if self.at != len(self.audit):
            raise ValueError(f"conversation {self.conv}: its rows are not those that were repaired")
        return self.conv, self.hash.hexdigest()


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at: _Writer | None = None
    done: list[tuple] = []

    def out() -> pa.RecordBatch:
        return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*done), (pa.int64(), pa.string()))], names=["conv_id", "repaired_sha256"])

    for batch in batches:
        for conv, role, text, audit in zip(*(c.to_pylist() for c in batch.columns)):
            if at is None or conv != at.conv:
                if at is not None:
                    done.append(at.result())
                at = _Writer(conv)
            if audit is not None:
                at.audit = audit
            else:
                at.add(role, text)
        if len(done) > 10_000:
            yield out()
            done = []
    if at is not None:
        done.append(at.result())
        yield out()


def repair_conversations(rows: DataFrame) -> DataFrame:
    """Per conversation of ``rows`` (conv_id, turn, role, text, gone; see
    ``damaged``): conv_id, gaps, blank, duplicate, truncated, illegal, cost,
    audit, repaired_sha256.

    Rows go by turn, nulls first; rows of one turn by role and text. Repeated
    rows are duplicates of the first. Rows whose conv_id is null are one
    conversation, as rows of any other id are. A conversation whose rows are all
    ``gone`` has zeros, an empty audit and the empty text's hash. An empty table
    gives no rows, other columns are ignored. Texts of any length are read once
    per pass; a conversation of any number of rows is one task's stream, since
    its hash is one.
    """
    known = materialize(marked(rows), "marked")
    facts = map_arrow(_in_order(known).select("conv_id", "turn", "role", "text", "gone", "later", "blank", "symbol"),
                      _facts, _FACTS)
    judged = materialize(map_arrow(facts, _repair, _FACTS.replace("symbols string", "cost long, audit string")), "judged")
    # Each conversation's audit goes ahead of its rows.
    stream = (judged.select("conv_id", F.lit(0).alias("place"), F.lit(None).cast("long").alias("turn"),
                            F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), "audit")
              .union(known.filter(~F.col("gone")).select("conv_id", F.lit(1), "turn", "role", "text", F.lit(None).cast("string"))))
    ordered = stream.repartition("conv_id").sortWithinPartitions(
        "conv_id", "place", F.col("turn").asc_nulls_first(), "role", "text").select("conv_id", "role", "text", "audit")
    written = map_arrow(ordered, _write, "conv_id long, repaired_sha256 string").withColumnRenamed("conv_id", "of")
    return judged.join(written, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")
