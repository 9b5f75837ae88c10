from collections import defaultdict

import duckdb
import pytest

from sluiceway.llm.mixing import mix_sources, mixed_documents, oracle


def fill(sizes):
    """Targets by sharing the excess again and again."""
    names = sorted([s for s in sizes if s is not None]) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, open_, out = sum(sizes.values()) * 1.5, set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 2 * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        out |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        open_ -= over
    return out


def rows():
    out = [(k, "w " * (k % 17), None, f"s{k % 5}" if k % 11 else None, None) for k in range(400)]
    out += [(k, "many words here " * 5, None, "hot", None) for k in range(400, 700)]
    return out + [(7000, None, None, "", None), (7001, "", None, "s1", None), (None, "a b", None, "s2", None), (401, "x y", None, "hot", None)] * 2


def test_targets_and_totals(documents):
    got = mix_sources(documents(rows())).collect()
    sizes, taken, aim = defaultdict(int), defaultdict(int), {}
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        aim[r.source] = r.target
        assert 0 <= r.taken <= 2 * r.size
    assert len(got) == len(rows())
    assert aim == pytest.approx(fill(sizes))
    for s in sizes:
        assert abs(taken[s] - aim[s]) <= 3


def test_equals_sql(spark, sf):
    got = sorted(map(tuple, mix_sources(spark.read.parquet(f"{sf}/documents.parquet")).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert got == sorted(con.execute(oracle()).fetchall())


def test_empty_and_repeats(documents, spark):
    assert mix_sources(documents([])).collect() == []
    same = [(1, "a b c", "en", "s", 5)] * 9
    assert sum(r.taken for r in mix_sources(documents(same)).collect()) in range(36, 41)
    full = mixed_documents(documents(same[:1] + [(2, "d", "en", "t", 1)], ).selectExpr("*", "1 AS size2"))
    assert {"text", "size", "taken", "size2"} <= set(full.columns) and full.count() == 2
