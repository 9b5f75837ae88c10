import random
import zlib

import pytest

from sluiceway.llm.toxicity import drop_toxic, score_toxicity


def corpus(n=900):
    r = random.Random(4)
    vocabulary = [f"w{k}" for k in range(300)]
    rows, labels = [], []
    for k in range(n):
        words = [r.choice(vocabulary) for _ in range(r.randint(3, 60))]
        toxic = k % 6 == 0
        if toxic:
            words.insert(r.randrange(len(words)), r.choice(["badone", "BadTwo"]))
        rows.append((k, " ".join(words), "en", "s", 1))
        labels.append((k, 1, int(toxic)))
    return rows, labels


@pytest.fixture
def trained(spark, documents):
    rows, labels = corpus()
    extra = [(5000, None, None, None, None), (5001, "", "en", "s", 0), (5002, "x " * 50_000 + "badone", "en", "s", 1), (0, "badone", "en", "s", 1), (None, "w1", "en", "s", 1)]
    return documents(rows + extra), spark.createDataFrame(labels + [(1, None, None)], "doc_id long, quality int, toxic int"), labels


def test_held_out_accuracy(trained):
    docs, labels, truth = trained
    got = score_toxicity(docs, labels).collect()
    assert len(got) == docs.count()
    toxic = {k: t for k, _, t in truth}
    held = [r for r in got if r.held_out and r.doc_id in toxic]
    assert held and all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in held)
    assert sum(r.predicted == toxic[r.doc_id] for r in held) >= 0.98 * len(held)
    by = {r.doc_id: r for r in got}
    assert by[5000].score == by[5001].score and by[5001].predicted == 0 and by[5002].predicted == 1
    assert all(0 <= r.score <= 1 for r in got)


def test_filter_keeps_columns(trained):
    docs, labels, truth = trained
    kept = drop_toxic(docs.selectExpr("*", "1 AS score", "2 AS label"), labels)
    assert kept.columns == [*docs.columns, "score", "label"]
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert 5000 in ids and 5002 not in ids


def test_no_labels_no_rows(documents, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert score_toxicity(documents([]), labels).collect() == []
    assert [r.score for r in score_toxicity(documents([(1, "a", "en", "s", 1)]), labels).collect()] == [0.5]


def test_equals_plain_ftrl():
    """The learner against the update rule written out coordinate by coordinate."""
    import math
    import random

    import pyarrow as pa

    from sluiceway.llm import toxicity as t
    from sluiceway.llm.common import Words, flat

    r = random.Random(2)
    texts = [" ".join(r.choice(["bad", "good", "cat", "dog", "sun", "Moon", "x"]) for _ in range(r.randint(0, 12))) for _ in range(60)]
    labels = [int("bad" in x) for x in texts]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(60)), pa.array(labels)], names=["text", "place", "label"])
    got = next(t._learn(iter([batch]), 3)).to_pydict()
    rows = []
    for x in texts:
        data, offsets = flat(pa.array([x]))
        rows.append(sorted(set(t._features(Words(data, offsets, 0, 1))[0].tolist())))
    z, n, bz, bn, bias = {}, {}, 0.0, 0.0, 0.0

    def weight(k):
        v = z.get(k, 0.0)
        return 0.0 if abs(v) <= t.L1 else -(v - math.copysign(t.L1, v)) / ((t.BETA + math.sqrt(n.get(k, 0.0))) / t.ALPHA + t.L2)

    for _ in range(3):
        for y, f in zip(labels, rows):
            w = {k: weight(k) for k in f}
            g = 1 / (1 + math.exp(-max(-35, min(35, sum(w.values()) + bias)))) - y
            for k in f:
                old = n.get(k, 0.0)
                z[k] = z.get(k, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / t.ALPHA * w[k]
                n[k] = old + g * g
            bz, bn = bz + g - (math.sqrt(bn + g * g) - math.sqrt(bn)) / t.ALPHA * bias, bn + g * g
            bias = -bz / ((t.BETA + math.sqrt(bn)) / t.ALPHA)
    want = {k: weight(k) for k in z if weight(k)} | {-1: bias}
    assert set(got["feature"]) == set(want) and all(abs(want[k] - w) < 1e-9 for k, w in zip(got["feature"], got["weight"]))
