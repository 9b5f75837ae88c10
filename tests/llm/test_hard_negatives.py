import math

import duckdb
import numpy as np

from sluiceway.llm import hard_negatives as module
from sluiceway.llm.hard_negatives import Shard, bounds, mine_hard_negatives, oracle, window

SCHEMA = "vec_id long, label int, embedding array<double>"


def brute(rows):
    best = {}
    for i, label, x in rows:
        if i is None or label is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        best[i] = min(best.get(i, (label, x)), (label, x))
    v = {i: (label, [math.floor(256 * c) for c in x]) for i, (label, x) in best.items()}
    out = []
    for a in (i for i in v if i % 50 == 0):
        label, q = v[a]
        score = {i: min(max(sum(p * r for p, r in zip(x, q)), -(2**63)), 2**63 - 1) for i, (_, x) in v.items() if i != a and len(x) == len(q)}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if v[i][0] == label][:5]:
            hard = [i for i in order if v[i][0] != label and 50 * score[p] <= 100 * score[i] <= 95 * score[p]][:3]
            out += [(a, p, k, i, score[p], score[i]) for k, i in enumerate(hard, 1)]
    return sorted(out)


def got(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS dim", "'x' AS shard", "2 AS rank", "3 AS v", "4 AS id")
    return sorted(map(tuple, mine_hard_negatives(df).collect()))


def clustered(n, dim, seed, spread=0.15):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((8, dim))
    return [(int(i), int(r.integers(0, 10)), (centres[r.integers(0, 8)] + spread * r.standard_normal(dim)).tolist()) for i in range(n)]


def test_many_shards_of_clustered_vectors(spark, monkeypatch):
    monkeypatch.setattr(module, "SHARD_ROWS", 60)
    monkeypatch.setattr(module, "ANCHOR_ROWS", 4)
    monkeypatch.setattr(module, "SAMPLE", 150)
    rows = clustered(900, 12, 1)
    want = brute(rows)
    assert len(want) > 100 and got(spark, rows) == want


def test_odd_rows_ties_and_dimensions(spark):
    rows = clustered(260, 4, 2)
    same = rows[3][2]
    rows += [(k, 1, same) for k in range(300, 420)] + [(k, 2, [c * 0.8 for c in same]) for k in range(420, 480)]
    rows += [(None, 1, same), (500, None, same), (501, 1, None), (502, 1, [None, *same[1:]]), (550, 1, [float("nan")] * 4), (600, 1, [float("inf")] * 4), (650, 1, [])]
    rows += [(700, 3, [1.0, 2.0]), (701, 4, [1.0, 3.0]), (702, 9, [1.0, 1.5]), (703, 4, [-1.0, -1.5]), (750, 5, [0.0] * 4), (751, 5, [0.0] * 4), (653, 1, []), (652, 2, [])]
    rows += [rows[5], (50, 9, same), (50, -3, same), (800, -3, same)]
    want = brute(rows)
    assert got(spark, rows) == want and {700, 650} <= {r[0] for r in want}
    assert got(spark, []) == []


def test_scores_that_doubles_cannot_hold(spark):
    r = np.random.default_rng(4)
    rows = [(k, int(k % 3), (2.0**20 * r.uniform(0.3, 1, 3)).tolist()) for k in range(0, 130)]
    rows += [(k, int(k % 3), [1e300, -1e290, 3.0]) for k in range(150, 156)]
    want = brute(rows)
    assert any(x[4] > 2**53 and x[4] % 2 for x in want) and got(spark, rows) == want


def test_equals_sql_on_the_table(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = con.execute(oracle())
    columns = [c[0] for c in want.description]
    df = mine_hard_negatives(spark.read.parquet(f"{sf}/embeddings.parquet"))
    assert sorted(map(tuple, df.select(*columns).collect())) == sorted(want.fetchall())


def test_windows_are_exact():
    for s in [*range(-300, 301), 2**62 + 1]:
        low, high = window(s)
        assert all((50 * s <= 100 * x <= 95 * s) == (low <= x <= high) for x in (low - 1, low, high, high + 1, s // 2, -(-s // 2)))


def test_bounds_hold_and_lists_are_left_out():
    r = np.random.default_rng(6)
    centres = 500 * r.standard_normal((30, 8))
    v = np.floor(np.repeat(centres, 20, axis=0) + 5 * r.standard_normal((600, 8)))
    clusters = np.repeat(np.arange(30), 20)
    shard = Shard(np.arange(600), np.zeros(600, np.int64), clusters, np.sqrt(((v - centres[clusters]) ** 2).sum(axis=1)), v, centres)
    seen = []
    original, module.inner_products = module.inner_products, lambda *a: (seen.append(1), original(*a))[1]
    try:
        for q in v[::50]:
            low, high = bounds(centres, shard.radius, q)
            assert ((v @ q).reshape(30, 20).max(axis=1) <= high).all() and ((v @ q).reshape(30, 20).min(axis=1) >= low).all()
            (best,) = shard.search(q, -1, 0, [[-(2**63), 2**63 - 1, -(2**63)]], True, 3)
            score = (v @ q).astype(int)
            assert best == sorted((-int(s), i) for i, s in enumerate(score))[:3]
    finally:
        module.inner_products = original
    assert len(seen) < 12 * 30 / 3
