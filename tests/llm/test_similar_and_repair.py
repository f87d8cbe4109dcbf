"""SimHash classes, conversation repair and spelling variants against brute force."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from growthlens.llm import conversation_repair as C
from growthlens.llm import simhash as S
from growthlens.llm import spelling_variants as V
from growthlens.llm.common import table

from .conftest import HARD, SF, texts_frame


# -- SimHash ---------------------------------------------------------------------

def fingerprint(text, words=3):
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    shingles = [b" ".join(w[i:i + words]) for i in range(len(w) - words + 1)] if len(w) >= words else [b" ".join(w)] if w else []
    h = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reachable(values, radius):
    parent = {x: x for x in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(values), 2):
        if (a ^ b).bit_count() <= radius:
            parent[find(b)] = find(a)
    return {x: find(x) for x in values}


def classes(rows, radius=3):
    prints = {(i, t): fingerprint(t) for i, t in rows}
    of = reachable(set(prints.values()), radius)
    smallest = {}
    for (i, _), p in prints.items():
        if i is not None:
            smallest[of[p]] = min(smallest.get(of[p], i), i)
    return Counter((i, f"{prints[i, t]:016x}", smallest.get(of[prints[i, t]])) for i, t in rows)


def test_documents_by_simhash(docs, doc_rows):
    assert Counter(map(tuple, S.simhash_classes(docs).collect())) == classes(doc_rows)


def test_hard_texts_by_simhash(spark, no_docs):
    df, rows = texts_frame(spark)
    rows = rows + [(None, "x y z")]
    df = df.unionByName(spark.createDataFrame(rows[-1:], "doc_id long, text string"), allowMissingColumns=True)
    assert Counter(map(tuple, S.simhash_classes(df).collect())) == classes(rows)
    assert S.simhash_classes(no_docs).collect() == []


@pytest.mark.parametrize("radius,tile", [(3, 8192), (3, 7), (1, 40), (0, 100)])
def test_links_of_any_radius_over_any_tiles(spark, radius, tile):
    rng = random.Random(radius + tile)
    values = {0, (1 << 64) - 1}
    for _ in range(60):
        x = rng.getrandbits(64)
        values.add(x)
        for _ in range(rng.randint(0, 6)):
            x ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4)))
            values.add(x)
    signed = [(int(np.uint64(x).astype(np.int64)),) for x in values]
    links = S.hamming_links(spark.createDataFrame(signed, "print long"), radius, tile).collect()
    unsigned = [tuple(int(np.int64(v).astype(np.uint64)) for v in r) for r in links]
    want = reachable(values, radius)
    assert all(want[a] == want[b] for a, b in unsigned)
    label = {x: x for x in values}
    for _ in values:
        for a, b in unsigned:
            label[a] = label[b] = min(label[a], label[b])
    groups = lambda of: Counter(frozenset(x for x in of if of[x] == g) for g in set(of.values()))
    assert groups(label) == groups(want)


def test_large_tiles_are_cut_by_quarters(monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 1 << 63, 700, dtype=np.uint64)
    y = np.concatenate((x[:200] ^ np.uint64(0b111), x[200:300] ^ np.uint64(1 << 40), x[300:330] ^ np.uint64(15)))
    want = {(i, j) for i, j in np.argwhere(np.bitwise_count(x[:, None] ^ y[None]) <= 3).tolist()}
    monkeypatch.setattr(S, "CUT_PAIRS", 10)
    monkeypatch.setattr(S, "PASS_PAIRS", 1000)
    found = [p for a, b in S.close_pairs(x, y, 3) for p in zip(a.tolist(), b.tolist())]
    assert set(found) == want and len(found) == len(want) >= 300


def test_a_family_of_close_prints_gives_few_links(spark):
    rows = [((1 << a) | (1 << b),) for a in range(60) for b in range(a)]
    assert S.hamming_links(spark.createDataFrame(rows, "print long")).count() < 3 * len(rows)


def test_long_texts_are_counted_in_parts(monkeypatch):
    texts = ["a b c d e f g h", "", "x y", "the cat sat on the mat " * 50, "one two three four"]
    want = [fingerprint(t) for t in texts]
    for size in (1, 3, 7, 1000):
        monkeypatch.setattr(S, "PASS_HASHES", size)
        assert S.fingerprints(iter(texts)).tolist() == want


# -- conversations -------------------------------------------------------------------

WHITE = " \t\n\x0b\x0c\r"


def damage(rows):
    """conv -> rows (turn, role, text) after damage, in order."""
    out = {}
    for conv, turn, role, text in rows:
        blank = lambda v: " " if v is None else str(v)
        pick = zlib.crc32(f"{blank(conv)}:{blank(turn)}".encode()) % 20
        role, text = blank(role), blank(text)
        found = out.setdefault(conv, [])
        if pick == 1:
            text = ""
        elif pick == 2:
            text = re.sub("[.!?]", "", text)
        elif pick == 4:
            role = "user"
        found += [(turn, role, text)] * {0: 0, 3: 2}.get(pick, 1)
    for found in out.values():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    return out


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = text.rstrip(WHITE)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """Dijkstra-like sweep over (row, output state), keeping whole audits."""
    nexts = {"": "su", "s": "u", "u": "a", "a": "u"}
    best = {"": (0, "", ())}

    def relax(table, state, value):
        if state not in table or value[:2] < table[state][:2]:
            table[state] = value
            return True
        return False

    def insertions(table):
        again = True
        while again:
            again = False
            for s, (cost, audit, out) in list(table.items()):
                for r in nexts[s]:
                    if r != "s":
                        again |= relax(table, r, (cost + 2, audit + "I", out + ((("user" if r == "u" else "assistant"), ""),)))
        return table

    for (_, role, text), fault in zip(rows, found):
        new = {}
        for s, (cost, audit, out) in insertions(dict(best)).items():
            relax(new, s, (cost + 3, audit + "D", out))
            if fault in ("", "truncated"):
                more = fault == "truncated"
                for r in nexts[s]:
                    if role[:1] == r:
                        relax(new, r, (cost + more, audit + "K", out + ((role, text),)))
                    elif r != "s":
                        relax(new, r, (cost + 2 + more, audit + "R", out + ((("user" if r == "u" else "assistant"), text),)))
        best = new
    ends = insertions(dict(best))
    return min(v for s, v in ends.items() if s in ("", "a"))


def repaired(rows):
    out = []
    for conv, found in damage(rows).items():
        fault = faults(found)
        turns = [t for t, _, _ in found if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(found, found[1:]))
        cost, audit, lines = cheapest(found, fault)
        text = "\n".join(f"{r}:{t}" for r, t in lines)
        count = Counter(fault)
        out.append((conv, gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit,
                    hashlib.sha256(text.encode()).hexdigest()))
    return Counter(out)


SCHEMA = "conv_id long, turn long, role string, text string"


def test_conversations_of_the_fixture(spark):
    df = table(spark, SF, "conversations")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    assert Counter(map(tuple, C.repair_conversations(C.damaged(df)).collect())) == repaired(rows)


def test_random_and_hard_conversations(spark):
    rng = random.Random(4)
    roles = ["user", "assistant", "system", "tool", "", None, "u", "assistant", "user"]
    texts = ["Yes.", "No", "", " \t\n", None, "Why?", "the same", "Yes.", "é! ", "a\nb.", "x" * 3000]
    rows = []
    for conv in [None, *range(300)]:
        for _ in range(rng.randint(1, 12)):
            rows.append((conv, rng.choice([None, *range(-1, 14)]), rng.choice(roles), rng.choice(texts)))
    rows += rows[:40] * 3
    df = spark.createDataFrame(rows, SCHEMA).repartition(4).selectExpr("*", "'mine' AS symbol", "'mine' AS audit", "1 AS gone")
    assert Counter(map(tuple, C.repair_conversations(C.damaged(df)).collect())) == repaired(rows)


def test_one_very_long_conversation(spark):
    rows = [(7, i, ("user", "assistant")[i % 2], f"line {i}.") for i in range(30_000)]
    got = C.repair_conversations(C.damaged(spark.createDataFrame(rows, SCHEMA))).collect()
    assert Counter(map(tuple, got)) == repaired(rows)


def test_no_conversations(spark):
    assert C.repair_conversations(C.damaged(spark.createDataFrame([], SCHEMA))).collect() == []


def test_rows_all_dropped(spark):
    gone = [t for t in range(500) if zlib.crc32(f"5:{t}".encode()) % 20 == 0][:3]
    got = C.repair_conversations(C.damaged(spark.createDataFrame([(5, t, "user", "x.") for t in gone], SCHEMA))).collect()
    assert list(map(tuple, got)) == [(5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_re_pair_rules_spell_the_sequences():
    rng = np.random.default_rng(3)
    for alphabet in (1, 2, 9):
        data = np.concatenate([np.append(rng.integers(0, alphabet, n), -1) for n in rng.integers(0, 60, 40)])
        packed, rules = C.re_pair(data, alphabet)

        def spell(s):
            return [s] if s < alphabet else [x for side in rules[s - alphabet] for x in spell(side)]

        assert [x for s in packed.tolist() for x in spell(s)] == data.tolist()
        pairs = Counter((a, b) for a, b in zip(packed[:-1].tolist(), packed[1:].tolist()) if a >= 0 and b >= 0 and a != b)
        assert not pairs or max(pairs.values()) == 1


def test_ropes_compare_as_their_texts():
    rng = random.Random(2)

    def rope(n):
        if n < 3:
            return C.Rope("".join(rng.choice("DIK") for _ in range(n)))
        k = rng.randrange(n + 1)
        return C.joined(rope(k), rope(n - k))

    parts = [rope(rng.randrange(12)) for _ in range(60)]
    for a, b in itertools.product(parts, parts):
        assert C.before(a, b) == (str(a) < str(b))


# -- spelling variants -----------------------------------------------------------------

def variants(rows):
    count = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            word = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if h % 31 == 0:
                word = word[:h % len(word)] + word[h % len(word) + 1:]
            if len(word) >= 7:
                count[word] += 1
    words = {w: n for w, n in count.items() if n >= 2}
    holes = {}
    for w in words:
        for k in range(len(w)):
            holes.setdefault((len(w), k, w[:k] + w[k + 1:]), set()).add(w)
    near = {w: set() for w in words}
    for (_, k, _), same in holes.items():
        for w in same:
            near[w] |= same - {w}
    for w in words:
        for k in range(len(w)):
            v = w[:k] + w[k + 1:]
            if v in words:
                near[w].add(v)
                near[v].add(w)
    form = {}
    for w, others in near.items():
        if others:
            best = min(others, key=lambda v: (-words[v], v))
            if words[best] >= 10 * words[w]:
                form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None))
    return Counter(out)


def test_variants_in_documents(docs, doc_rows):
    got = Counter(map(tuple, V.variant_groups(docs).collect()))
    assert got == variants(doc_rows)
    assert sum(r[1] is not None for r in got) >= 10


@pytest.mark.parametrize("filter_bytes", [32 << 20, 3000])
def test_variants_over_several_passes(spark, filter_bytes):
    rng = random.Random(9)
    base = ["".join(rng.choice("abcdeéÿÀ") for _ in range(rng.randint(6, 11))) for _ in range(60)]
    base += ["aaaaaaaa", "z" * 70, "y" * 5000]
    rows = []
    for i in range(400):
        text = []
        for _ in range(25):
            w = rng.choice(base[:1 + rng.randrange(len(base))])
            if rng.random() < 0.3:
                k, c = rng.randrange(len(w)), rng.choice("abcdeé")
                w = rng.choice((w[:k] + w[k + 1:], w[:k] + c + w[k + 1:], w[:k] + c + w[k:]))
            text.append(w.upper() if rng.random() < 0.1 and w.isascii() else w)
        rows.append((i if i % 50 else None, rng.choice((" ", "-", "1", "×", "÷", "ş")).join(text)))
    rows += rows[:20]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).selectExpr("*", "1 AS n", "2 AS word", "3 AS form")
    assert Counter(map(tuple, V.variant_groups(df, filter_bytes=filter_bytes).collect())) == variants(rows)


def test_variants_in_hard_texts(spark, no_docs):
    df, rows = texts_frame(spark, HARD + ["ÀÉÎÕÜØÿ ÀÉÎÕÜØÿ ÀÉÎÕÜØÿa", "ABCDEFG abcdefg abcdefh ABCDEFH"])
    assert Counter(map(tuple, V.variant_groups(df).collect())) == variants(rows)
    assert V.variant_groups(no_docs).collect() == []


def test_filters_pass_every_word_and_few_others():
    rng = np.random.default_rng(1)
    letters = rng.choice(V.LETTERS, (20_000, 9))
    key = V.keys(letters)
    size = 20_000 * 2 * V.KEY_BITS // 64 + 1
    blocks = np.zeros(size, np.uint64)
    for k in range(2):
        place, mask = V._block(key, k, size)
        np.bitwise_or.at(blocks, place, mask)
    found = V.Filters(blocks, {9: 0}, {9: size}, 0, 1)
    assert len(found.passing(key, 9)) == 20_000
    assert len(found.passing(V.keys(rng.choice(V.LETTERS, (200_000, 9))), 9)) < 2_000
