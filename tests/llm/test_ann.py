import numpy as np

from sluiceway.llm import ann
from sluiceway.llm.ann import nearest


def brute(ids, vectors, k=10):
    out = {}
    for i in np.flatnonzero(ids % 100 == 0):
        d = vectors - vectors[i]
        d = np.sqrt((d * d).sum(axis=1))
        best = np.lexsort((ids, d))
        out[int(ids[i])] = [(int(ids[j]), d[j]) for j in best if j != i][:k]
    return out


def measured(got, truth):
    hits = sum(len({v for v, _ in got.get(q, [])} & {v for v, _ in best}) for q, best in truth.items())
    return hits / sum(map(len, truth.values()))


def rows_of(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def test_recall_on_the_table(spark, sf, monkeypatch):
    monkeypatch.setattr(ann, "SHARD_ROWS", 200)
    monkeypatch.setattr(ann, "QUERY_ROWS", 2)
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    pdf = table.orderBy("vec_id").toPandas()
    truth = brute(pdf.vec_id.to_numpy(), np.stack(pdf.embedding).astype(np.float64))
    got = rows_of(nearest(table))
    assert measured(got, truth) >= 0.9
    for q, found in got.items():
        assert [d for _, d in found] == sorted(d for _, d in found) and len(found) == 10
        exact = dict(truth[q])
        assert all(abs(exact[v] - d) < 1e-12 for v, d in found if v in exact)


def test_copies_edges_and_ties(spark):
    r = np.random.default_rng(1)
    base = r.standard_normal(8).tolist()
    rows = [(k, base) for k in range(150)] + [(k, r.standard_normal(8).tolist()) for k in range(150, 400)]
    odd = [(1000, None), (1100, [0.0] * 8), (1200, [float("nan")] * 8), (1300, [None, *base[1:]]), (1400, []), (None, base), (1500, [1.0, 2.0]), (1501, [1.0, 3.0]), (0, base), (1600, [float("inf")] * 8)]
    got = rows_of(nearest(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").selectExpr("*", "1 AS label", "1 AS v")))
    assert set(got) == {0, 100, 200, 300, 1500}
    assert got[0] == [(k, 0.0) for k in range(1, 11)] and got[100] == [(k, 0.0) for k in range(10)]
    assert got[1500] == [(1501, 1.0)]
    assert nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def plain_search(vectors, ids, query, own, k, step):
    """Windows grown turn by turn, collisions counted one vector at a time."""
    axes = ann.directions(vectors.shape[1])
    apart = np.abs(vectors @ axes.T - axes @ query)
    radius = step
    while True:
        everything = radius * ann.WIDTH / 2 >= apart.max()
        hits = [i for i in range(len(ids)) if ids[i] != own and (everything or (apart[i] <= radius * ann.WIDTH / 2).sum() >= ann.THRESHOLD)]
        best = sorted((np.sqrt(((vectors[i] - query) ** 2).sum()), ids[i]) for i in hits)[:k]
        if everything or len(best) == k and best[-1][0] <= radius:
            return best
        radius *= ann.RATIO


def test_a_shard_finds_what_growing_windows_find():
    r = np.random.default_rng(5)
    centres = r.standard_normal((6, 12))
    vectors = np.concatenate([centres[r.integers(0, 6, 300)] + 0.2 * r.standard_normal((300, 12)), np.repeat(centres[:1], 40, axis=0), 30 * r.standard_normal((3, 12))])
    ids = r.permutation(1000)[: len(vectors)]
    index = ann.Index(ids, vectors)
    asked = np.array([*range(0, 300, 9), 301, 341])
    for i, (found, far) in zip(asked, index.search(vectors[asked], ids[asked], 10)):
        assert list(zip(far, found)) == plain_search(vectors, ids, vectors[i], ids[i], 10, index.step)
    few = ann.Index(ids[:4], vectors[:4])
    ((found, _),) = few.search(vectors[:1], ids[:1], 10)
    assert sorted(found) == sorted(ids[1:4])
