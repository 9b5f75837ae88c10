import random
from collections import defaultdict

import duckdb

from sluiceway.llm.chat import oracle, render_conversations


def brute(rows):
    convs = defaultdict(list)
    key = lambda x: tuple((v is not None, v if v is not None else 0) for v in x)
    for c, *rest in sorted(set(rows) - {r for r in rows if r[0] is None}, key=key):
        convs[c].append((rest[1], rest[2]))
    out = {}
    for c, turns in convs.items():
        same = [d for d, other in convs.items() if other == turns]
        if min(same) == c and not any(len(o) > len(turns) and o[: len(turns)] == turns for o in convs.values()):
            out[c] = (len(turns), len(same), "".join(f"<|im_start|>{r or 'unknown'}\n{t or ''}<|im_end|>\n" for r, t in turns))
    return out


def rows():
    r = random.Random(0)
    out = [(c, k, r.choice(["user", "assistant"]), r.choice(["hi", "yes", "no"])) for c in range(60) for k in range(r.randint(1, 4))]
    out += [(100 + c, k, "user", f"t{k}") for c in range(8) for k in range(c + 1)]
    out += [(200, None, None, None), (201, 0, "user", ""), (202, 0, "user", None), (203, 0, "user", "x" * 100_000), (203, 0, "user", "x" * 100_000), (None, 0, "user", "hi"), (204, 0, "user", "b"), (204, 0, "user", "a")]
    return out


def test_equals_brute_force(spark):
    df = spark.createDataFrame(rows(), "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS place", "2 AS h1")
    assert {r.conv_id: tuple(r)[1:] for r in render_conversations(df).collect()} == brute(rows())


def test_equals_sql(spark, sf):
    got = sorted(map(tuple, render_conversations(spark.read.parquet(f"{sf}/conversations.parquet")).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    assert got == sorted(con.execute(oracle()).fetchall())


def test_empty(spark):
    assert render_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
