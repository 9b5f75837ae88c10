import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from sluiceway.llm import collocations as module
from sluiceway.llm.collocations import Scanner, collocations, oracle

LOWERED = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top):
    """lang, rank, phrase, a, l, r, n, score by counting all phrases."""
    f, n = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        counts = f.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWERED)):
            words = [w for w in re.split(r"[ \t]", piece) if w]
            n[lang] += len(words)
            for k in range(1, 5):
                counts.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = Counter()
        for p, a in found.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(inside[p[i : i + k]], a)
        scored = []
        for p, a in found.items():
            if 100 * inside[p] >= 80 * a:
                continue
            score, _, left, right = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, rank, p.decode(), -a, left, right, n[lang], -score) for rank, (score, a, p, left, right) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def corpus():
    r = random.Random(3)
    words = ["the", "The", "of", "ab", "cdé", "x", "ß", "Éa", "x y", "日本", "a" * 40]
    pair = [("en", "de"), ("fr", None)]
    rows = [(" ".join(r.choice(words) for _ in range(r.randint(0, 60))) + r.choice(["", ".", "!\n", " ,"]), r.choice(r.choice(pair))) for _ in range(400)]
    rows += [("one\ttwo  three four. one two", "en")] * 40 + [("new york. new york city", None), ("new york", "und")] * 30
    rows += [(None, "en"), ("", None), ("\t ,.", "de"), (None, None), ("a a a a a a " * 5000, "en"), ("\x0bfoo bar\x0cfoo bar\rfoo bar\x00", "fr")]
    return rows


def got(spark, rows, top=2000, parts=3):
    df = spark.createDataFrame(rows, "text string, lang string").repartition(parts)
    df = df.selectExpr("*", "1 AS n", "'x' AS phrase", "2 AS shard", "3 AS kind")
    return sorted((r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in collocations(df, top).collect())


@pytest.mark.parametrize("least", [30, 6])
def test_equals_brute_force(spark, monkeypatch, least):
    monkeypatch.setattr(module, "LEAST", least)
    want = brute(corpus(), least, 2000)
    assert len(want) > 20 and got(spark, corpus()) == want


def test_shards_salts_and_a_narrow_sketch_change_nothing(spark, monkeypatch):
    """Five and more automata, a group of text for each few hundred characters, cells that all phrases share."""
    monkeypatch.setattr(module, "SHARD_PHRASES", 9)
    monkeypatch.setattr(module, "GROUP_CHARS", 400)
    monkeypatch.setattr(module, "CELLS", 1 << 16)
    assert got(spark, corpus(), 50) == brute(corpus(), 30, 50)


def test_equals_sql_on_the_table(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(oracle())
    columns = [c[0] for c in want.description]
    df = collocations(spark.read.parquet(f"{sf}/documents.parquet"))
    assert sorted(map(tuple, df.select(*columns).collect())) == sorted(want.fetchall())


def test_empty_and_infrequent(spark):
    assert got(spark, []) == [] and got(spark, [("few words here", "en")]) == [] and got(spark, [(None, None)]) == []


def test_overlapping_matches_and_guards():
    s = Scanner(["a", "a a", "a b", "b", "aa"])
    s.scan(["a a a b", "aa b", "a a a b"], np.array([1, 2, 3]))
    assert dict(zip(s.phrases, s.counts.tolist())) == {"a": 12, "a a": 8, "a b": 4, "b": 6, "aa": 2}


def test_packed_texts_come_back_and_are_small(monkeypatch):
    r = random.Random(5)
    texts = ["日本 ß", *(" ".join(r.choice(["the", "of", "and", "cdé"]) + str(r.randrange(300)) for _ in range(3)) for _ in range(5000))]
    weights = np.array([2**32 - 1, *(1 + k % 300 for k in range(5000))])
    monkeypatch.setattr(module, "PACKED", 1 << 14)
    values = list(module._packed(pa.array(texts), weights))
    back = [x for v in values for x in zip(*module._unpacked(*v))]
    assert len(values) > 3 and sorted(back) == sorted(zip(texts, weights)) and [t for t, _ in back] == sorted(texts, key=str.encode)
    assert 2 * sum(len(blob) for blob, _, _ in values) < sum(len(t.encode()) + 4 for t in texts)


def test_weights_beyond_32_bits_are_split():
    batches = list(module._packed_parts({(3, "en"): Counter({"a b": 2**33 + 5, "c": 1})}))
    sums = Counter()
    for row in (x for b in batches for x in b.to_pylist()):
        assert (row["shard"], row["lang"]) == (3, "en")
        for text, weight in zip(*module._unpacked(row["blob"], row["size"], row["n"])):
            sums[text] += int(weight)
    assert sums == {"a b": 2**33 + 5, "c": 1}


def test_what_is_gathered_is_packed(spark):
    """One row a bucket or a language, not one for each candidate and stretch."""
    docs = spark.createDataFrame([("one two three four five six " * 40, "en")] * 50, "text string, lang string").coalesce(1)
    filters = []
    for _ in range(3):
        filters.append(spark.sparkContext.broadcast(module._level(docs, 1 << 20, filters)))
    rows = module._pieces_of(docs, filters, 1).collect()
    assert sorted(r.kind for r in rows) == [0, 1, 2] and {r.n for r in rows if r.kind == 2} == {50 * 240}
