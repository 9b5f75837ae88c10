import random

from sluiceway.llm import decontam
from sluiceway.llm.decontam import drop_leaks, find_leaks


def shingles(words):
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute(docs, items):
    out = set()
    for d, text in docs:
        w = (text or "").lower().split()
        have = shingles(w) | {tuple(w[k : k + n]) for n in range(1, 5) for k in range(len(w) - n + 1)}
        for i, item in items:
            v = (item or "").lower().split()
            if i is None or not v:
                continue
            halves = [h for h in (v[: (len(v) + 1) // 2], v[(len(v) + 1) // 2 :]) if h]
            if all(len(shingles(h) & have) >= 0.8 * len(shingles(h)) for h in halves):
                out.add((d, i))
    return out


def data():
    r = random.Random(3)
    vocabulary = ["".join(r.choice("abcdef") for _ in range(r.randint(2, 5))) for _ in range(600)]
    prose = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(prose(r.randint(12, 90)))) for k in range(30)] + [(30, None), (31, ""), (None, "zz yy"), (32, "lone five words stand here now")]
    docs = []
    for k in range(300):
        w = prose(r.randint(5, 400))
        if k % 3 == 0:
            item = r.choice(items[:30])[1].split()
            if k % 2:
                item[r.randrange(len(item))] = "edited"
            if k % 9 == 0:
                item = item[: len(item) // 2]
            at = r.randrange(len(w))
            w[at:at] = item
        docs.append((k, " ".join(w).title() if k % 5 == 0 else " ".join(w)))
    return docs + [(900, None), (901, ""), (902, "x " * 30_000 + items[4][1]), (903, items[32 + 1][1])], items


def test_equals_brute_force(texts, spark, monkeypatch):
    docs, items = data()
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS part")
    truth = brute(docs, items)
    assert len(truth) > 40
    assert {(r.doc_id, r.item_id) for r in find_leaks(texts(docs), bench).collect()} == truth
    monkeypatch.setattr(decontam, "PART_ITEMS", 7)
    assert {(r.doc_id, r.item_id) for r in find_leaks(texts(docs), bench).collect()} == truth
    kept = drop_leaks(texts(docs + [(None, "a b")]), bench)
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in truth} | {None}


def test_empty(texts, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert find_leaks(texts([(1, "a")]), none).collect() == []
    assert drop_leaks(texts([(1, "a"), (1, "a")]), none).count() == 2
    assert find_leaks(texts([]), spark.createDataFrame([(1, "a b c")], "item_id long, text string")).collect() == []


def test_split_and_edited(texts, spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("ghijkl") for _ in range(7))
    items = [(k, " ".join(word() for _ in range(40))) for k in range(20)]
    docs = []
    for k, text in items:
        w = text.split()
        filler = lambda n: [word() for _ in range(n)]
        # The last word of each half is edited; the halves, or pieces of ten words and more, stand far apart.
        docs.append((k, " ".join(filler(20) + w[:19] + ["edited"] + filler(90) + w[20:39] + ["edited"] + filler(20))))
        docs.append((100 + k, " ".join(w[:19] + filler(90) + w[20:30] + filler(90) + w[25:40])))
        docs.append((200 + k, " ".join(w[:19] + filler(90) + w[20:34])))
    truth = brute(docs, items)
    assert {(k, k) for k in range(20)} | {(100 + k, k) for k in range(20)} == truth
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(x.doc_id, x.item_id) for x in find_leaks(texts(docs), bench).collect()} == truth
