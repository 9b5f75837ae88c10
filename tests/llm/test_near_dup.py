import random
from collections import Counter

import numpy as np

from sluiceway.llm.near_dup import COORDINATES, drop_near_duplicates, near_duplicates, signatures


def bag(text):
    w = (text or "").lower().split()
    return Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()


def near(a, b):
    return sum((a & b).values()) >= 0.8 * sum((a | b).values()) if a and b else False


def brute(items):
    bags = {k: bag(t) for k, t in items}
    label = {k: k for k in bags}
    ids = sorted(bags)
    pairs = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if near(bags[a], bags[b])]
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            m = min(label[a], label[b])
            changed |= label[a] != m or label[b] != m
            label[a] = label[b] = m
    return label


def corpus():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    prose = lambda n: [word() for _ in range(n)]
    items, k = [], 0
    for _ in range(25):
        base = prose(r.randint(60, 300))
        for _ in range(r.randint(1, 8)):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2, len(w) // 20])):
                w[r.randrange(len(w))] = word()
            items.append((k, " ".join(w)))
            k += 1
    chain = prose(200)
    for s in range(12):
        chain = chain[6:] + prose(6)
        items.append((500 + s, " ".join(chain)))
    return items + [(900, "one two"), (901, "One  two"), (902, "one"), (903, ""), (904, " \n"), (905, "loop loop " * 4000), (906, "loop loop " * 4001)]


def test_equals_brute_force(texts):
    items = corpus()
    got = {r.doc_id: r.class_id for r in near_duplicates(texts(items)).collect()}
    assert got == brute(items)


def test_odd_rows_and_filter(texts):
    items = [(1, "a b c d e f g h"), (1, "a b c d e f g h"), (2, "A b c d e f g h"), (None, "x"), (None, "x"), (3, None), (4, None)]
    docs = texts(items).selectExpr("*", "1 AS class_id", "2 AS bands")
    kept = drop_near_duplicates(docs)
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect() if r.doc_id) == [(False, 1), (False, 3), (False, 4)]
    assert kept.filter("doc_id IS NULL").count() == 2 and kept.columns == docs.columns
    got = {r.doc_id: (r.class_id, r.n_copies) for r in near_duplicates(docs).collect()}
    assert got == {1: (1, 2), 2: (1, 2), 3: (3, 1), 4: (4, 1)}
    assert near_duplicates(texts([])).collect() == []


def test_agreement_is_the_similarity():
    r = np.random.default_rng(0)
    for shared in (0.3, 0.6, 0.9):
        agree = []
        for _ in range(40):
            n = 400
            common = r.integers(1, 2**62, int(n * shared)).astype(np.uint64)
            own = [r.integers(1, 2**62, n - len(common)).astype(np.uint64) for _ in range(2)]
            s = np.concatenate([common, own[0], common, own[1]])
            sig = signatures(s, np.repeat([0, 1], n), 2)
            assert (sig != 0).all()
            agree.append((sig[0] == sig[1]).mean())
        true = shared / (2 - shared)
        assert abs(np.mean(agree) - true) < 4 * np.sqrt(true * (1 - true) / (40 * COORDINATES))


def test_large_group_in_blocks(texts, monkeypatch):
    """A family of copies edited lightly or heavily, its buckets dealt into blocks of eight."""
    import sluiceway.llm.near_dup as module

    monkeypatch.setattr(module, "BLOCK", 8)
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    base, items = [word() for _ in range(150)], []
    for k in range(90):
        w = list(base)
        for _ in range(r.randint(0, 14)):
            w[r.randrange(len(w))] = word()
        items.append((k, " ".join(w)))
    want = brute(items)
    got = {x.doc_id: x.class_id for x in near_duplicates(texts(items)).collect()}
    assert got == want and 3 < len(set(want.values())) < 80


def test_two_texts_on_one_id(texts):
    """One text of a repeated id counts, for the search and for the exact check alike."""
    r = random.Random(3)
    items = []
    for k in range(20):
        one, two = (" ".join(str(r.randrange(10**6)) for _ in range(40)) for _ in range(2))
        items += [(k, one), (k, two), (100 + k, one), (200 + k, two)]
    got = {x.doc_id: x.class_id for x in near_duplicates(texts(items)).collect()}
    assert all((got[100 + k] == k) != (got[200 + k] == k) for k in range(20))
    kept = sorted((x.doc_id, x.text) for x in drop_near_duplicates(texts(items)).collect())
    assert sorted({k for k, _ in kept if k < 20}) == list(range(20)) and len(kept) == 60


def test_equals_exact_pairs_of_the_table(spark):
    """All 1,000 texts of sf0.01: classes by exact pairs, counted over shared shingles."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    bags = {r.doc_id: bag(r.text) for r in docs.select("doc_id", "text").collect()}
    holders = {}
    for k, b in bags.items():
        for s, n in b.items():
            holders.setdefault(s, []).append((k, n))
    shared = Counter()
    for rows in holders.values():
        for x, (a, m) in enumerate(rows):
            for b, n in rows[:x]:
                shared[min(a, b), max(a, b)] += min(m, n)
    size = {k: sum(b.values()) for k, b in bags.items()}
    label = {k: k for k in bags}

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for (a, b), n in shared.items():
        if n >= 0.8 * (size[a] + size[b] - n):
            a, b = root(a), root(b)
            label[max(a, b)] = min(a, b)
    got = {x.doc_id: x.class_id for x in near_duplicates(docs).collect()}
    assert got == {k: root(k) for k in bags} and len(set(got.values())) < len(got)
