import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from growthlens.llm import jaccard_join as J
from growthlens.llm.components import components
from growthlens.llm.shingles import shingle_sets

from .conftest import texts_frame


def sets_of(rows, words):
    out = {}
    for i, t in rows:
        w = (t or "").encode("utf-8", "surrogatepass").lower().split()
        out[i] = frozenset(tuple(w[k:k + words]) for k in range(len(w) - words + 1)) if len(w) >= words else (
            frozenset([tuple(w)]) if w else frozenset())
    return out


def classes_of(rows, words=4, p=85, q=100):
    sets = sets_of(rows, words)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, s in sets.items():
        shared = Counter(j for g in s for j in holders[g])
        for j, k in shared.items():
            if q * k >= p * (len(s) + len(sets[j]) - k):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for g in s:
            holders[g].append(i)
    return {i: (len(sets[i]), find(i)) for i in sets}


def compare(df, rows, words=4, p=85, q=100):
    got = Counter(map(tuple, J.jaccard_classes(df, words=words, similar=p, of=q).collect()))
    want = classes_of(rows, words, p, q)
    assert got == Counter((i, *want[i]) for i, _ in rows)


def test_documents(docs, doc_rows):
    compare(docs, doc_rows)


def test_hard_texts(spark):
    compare(*texts_frame(spark))


@pytest.mark.parametrize("words,p,q", [(4, 85, 100), (5, 80, 100)])
def test_edited_copies_around_the_threshold(spark, words, p, q):
    rng = random.Random(words)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.choice((3, 5, 6, 8, 12, 20, 40, 90, 200, 600)))]
        for _ in range(rng.randint(1, 8)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                k = rng.randrange(len(copy))
                copy[k:k + rng.randint(0, 1)] = [rng.choice(vocabulary)] * rng.randint(0, 2)
                copy = copy or ["w"]
            rows.append((len(rows), " ".join(copy)))
    rng.shuffle(rows)
    compare(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), rows, words, p, q)


def test_chain_is_one_class(spark):
    # Each differs from the next by little, from the far ones by much.
    words = [f"t{i}" for i in range(400)]
    rows = [(i, " ".join(words[5 * i:5 * i + 150])) for i in range(40)]
    compare(spark.createDataFrame(rows, "doc_id long, text string"), rows)
    assert len({c for _, c in classes_of(rows).values()}) == 1


def test_many_copies_and_a_shared_passage(spark):
    rng = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(55))
    rows = [(i, "all of these are the same few words here") for i in range(300)]
    rows += [(1000 + i, passage + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(20))) for i in range(200)]
    compare(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), rows)


def test_an_entry_that_very_many_hold_is_spread(spark):
    """One entry in each of 50,000 ids, besides one of each id's own and one per
    hundred ids: no partition gets much more than the others, no member goes."""
    ids = 50_000

    def index(batches):
        for batch in batches:
            held = batch.column(0).to_numpy()
            found = [np.array([7 << 40, (1 << 50) + int(i), (1 << 51) + int(i) // 100], np.uint64) for i in held]
            for k in range(0, len(held), 1000):
                yield J._entry_batch(found[k:k + 1000], held[k:k + 1000].tolist())

    rows = spark.range(0, ids, numPartitions=8).mapInArrow(index, J._ENTRIES)
    dealt = rows.repartition(16, "entry", F.expr("nullif(pivot, id)")).groupBy(F.spark_partition_id()).count()
    counts = [r["count"] for r in dealt.collect()]
    assert max(counts) < 2 * np.median(counts)
    got = J._bucketed(rows).toPandas()
    assert len(got) == len(got.drop_duplicates(["entry", "id"])) == 2 * ids
    assert set(got.entry) == {7 << 40} | {(1 << 51) + i for i in range(ids // 100)}
    hot = got[got.entry == 7 << 40]
    assert set(hot["id"]) == set(range(ids)) and (~hot["local"]).sum() <= 60
    stars = J._stars(J._bucketed(rows)).toPandas()
    assert Counter(zip(stars.a, stars.b)) == Counter({(a, b): 1 for b in range(ids) for a in {0, b // 100 * 100} if a < b})


def test_unlike_sets_that_share_many_entries_meet_few_times(spark, monkeypatch):
    """Texts of a family, too unlike to link, share dozens of entries a pair. A
    pair is formed a few times at most, and none that shares an entry is missing."""
    rng = random.Random(4)
    common = [[f"c{k}_{i}" for i in range(30)] for k in range(60)]
    rows = []
    for i in range(14):
        share = rng.choice((0.5, 0.88, 0.88, 0.9))
        parts = [c if rng.random() < share else [f"o{i}_{k}_{j}" for j in range(30)] for k, c in enumerate(common)]
        rows.append((i, " ".join(w for part in parts for w in part)))
    rows.append(rows[-1])
    docs = spark.createDataFrame(rows, "id long, text string").repartition(3)
    profiles = J.map_arrow(docs, J._profiles(4, 85, 100), J._PROFILE)
    buckets = J.materialize(J._bucketed(J.map_arrow(docs, J._index(4, 85, 100), J._ENTRIES)), "buckets")
    classes = spark.createDataFrame([(2, 1)], "node long, component long")
    kept, written = [], J.materialize

    def seen(df, name):
        out = written(df, name)
        if name == "kept":
            kept.append({(r.entry, r.id) for r in out.collect()})
        return out

    monkeypatch.setattr(J, "materialize", seen)
    monkeypatch.setattr(type(docs), "distinct", lambda self: self)
    got = [tuple(r) for r in J._second_pairs(buckets, classes, profiles, 85, 100).collect()]
    held = defaultdict(list)
    for entry, i in kept[0]:
        held[entry].append(i)
    # Of this length no two sets are told apart by their 256 parity bits.
    shared = Counter((a, b) for ids in held.values() for a in ids for b in ids if a < b and (a, b) != (1, 2))
    assert set(got) == set(shared) and len(shared) > 50
    assert shared.total() > 20 * len(shared) and len(got) < 6 * len(shared)


@pytest.mark.parametrize("batch", [3, 40, 10_000])
def test_buckets_in_small_batches(spark, batch):
    rng = np.random.default_rng(batch)
    held = {(int(e), int(i)) for e, i in zip(rng.integers(0, 60, 400) ** 2 // 40, rng.integers(-5, 90, 400))}
    pairs = sorted(held, key=lambda x: (x[1] % 7, x))
    batches = []
    for k in range(0, len(pairs), 90):
        part = pairs[k:k + 90]
        batches.append(J._entry_batch([np.array([e], np.uint64) for e, _ in part], [i for _, i in part]))
    rows = pa.Table.from_batches(batches).to_pandas().astype({"pivot": "Int64"})
    rows["spread"] = rows["pivot"].where(rows["pivot"] != rows["id"])
    rows = rows.sort_values(["entry", "spread", "id"], na_position="first")[["entry", "id", "pivot"]]
    stream = pa.Table.from_pandas(rows, preserve_index=False).to_batches(max_chunksize=batch)
    got = [tuple(r.values())[:3] for b in J._buckets(iter(stream)) for r in b.to_pylist()]
    many = Counter(e for e, _ in held)
    members = {(e, i) for e, i, _ in got}
    assert len(got) == len(members) and {x for x in held if many[x[0]] > 1} == members
    above = {(e, i): p for e, i, p in got}
    for e, i in members:
        while above[e, i] != i:
            i = above[e, i]
        assert i == min(j for f, j in held if f == e)


def test_null_ids_and_empty_table(spark, no_docs):
    assert J.jaccard_classes(no_docs).count() == 0
    df = spark.createDataFrame([(None, "a b c d e"), (None, "a b c d e"), (4, "a b c d e"), (2, "a b c d e")], "doc_id long, text string")
    got = sorted(map(tuple, J.jaccard_classes(df).collect()), key=str)
    assert got == sorted([(None, 2, None), (None, 2, None), (4, 2, 2), (2, 2, 2)], key=str)


def test_shingles_agree_with_tuples():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab Cé\t\n ") for _ in range(rng.randint(0, 40))) for _ in range(400)] + [None, ""]
    for words in (1, 4, 5):
        got = [len(s) for s in shingle_sets(pa.array(texts), words)]
        want = sets_of(list(enumerate(texts)), words)
        assert got == [len(want[i]) for i in range(len(texts))]


@pytest.mark.parametrize("p,q", [(85, 100), (80, 100), (7, 10), (9, 10)])
def test_pairs_at_the_bound_share_entries(p, q):
    """Random pairs at the largest allowed difference keep an entry in common
    after both left out what they may, the counted ones included."""
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(6, 700))
        common = int(rng.integers(1, n + 1))
        total = common * q // p  # the largest union of similar sets
        if total <= common:
            continue
        left = int(rng.integers(0, total - common + 1))
        tokens = rng.integers(0, 1 << 63, total, dtype=np.uint64)
        a, b = np.sort(tokens[:common + left]), np.sort(np.concatenate((tokens[:common], tokens[common + left:])))
        assert q * common >= p * total
        shared, spare = set(), 0
        for band in set(J.bands_for(len(a), p, q)) & set(J.bands_for(len(b), p, q)):
            x, y = (set(J.entries(t, band, p, q).tolist()) for t in (a, b))
            shared |= {e for e in x & y if not e & 1}
            deleted = {e for e in x & y if e & 1}
            spare = 2 * band.spare
            if deleted:
                break
        else:
            assert len(shared) > spare


def test_parity_bits_bound_the_difference():
    rng = np.random.default_rng(9)
    for _ in range(200):
        sizes = rng.integers(0, 2000, 3)
        parts = [rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in sizes]
        a, b = (np.unique(np.concatenate((parts[0], x))) for x in parts[1:])
        differ = len(np.setxor1d(a, b))
        assert J.least_difference(J.wide_parity(a), J.wide_parity(b)) <= differ
        assert int(np.bitwise_count(J.parity(a).view(np.uint64) ^ J.parity(b).view(np.uint64)).sum()) <= differ


def test_components_of_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(100, 160)] + [(7, 3), (3, 9), (5, 5)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 3: 3, 7: 3, 9: 3}
