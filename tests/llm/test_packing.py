import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sluiceway.llm import packing
from sluiceway.llm.packing import END, Encoder, Plan, grouped, pack_documents, packing_plan

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None, "", " \t\n ", "Don't we'll they'RE x's 'S ''t", "Áb İ é.́ word.́ ẛ̣ 힣ᆨ", "<|endoftext|>A <|EndOfText|> x<|startoftext|>.", "a\x85b c d \x1c e\x0bf\x0cg",
    "Ünïcode!? ... ,, wörd.. STRASSE ẞ İstanbul ΑΣ. ΣΣ", "日本語 テスト 12345 a1b2.", "word's. it's, a.b,c x.", "﻿x ​q <| foo|>. A<|B.", "x" * 5000, "the " * 9000,
]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def plain(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [END]


def checked(rows, texts, tokenizer, capacity):
    """Every id of every document once, in its place, no sequence over the capacity, none with a gap."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
        assert r.length == len(r.ids) and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
    assert set(by_doc) == set(texts)
    for k, t in texts.items():
        parts = sorted(by_doc[k], key=lambda r: r.piece)
        want = plain(tokenizer, t)
        assert [r.piece for r in parts] == list(range(-(-len(want) // capacity))) and [r.start for r in parts] == [capacity * r.piece for r in parts]
        assert [x for r in parts for x in r.ids] == want and all(len(r.ids) == capacity for r in parts[:-1])
    for places in by_sequence.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))] and sum(n for _, n in places) <= capacity
    return len(by_sequence)


def test_table_is_packed_whole(spark, sf, tokenizer):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    n = checked(pack_documents(docs, PATH).collect(), texts, tokenizer, 4096)
    total = sum(len(plain(tokenizer, t)) for t in texts.values())
    assert n <= -(-total // 4096) + 1


def test_odd_texts_small_sequences_and_other_columns(spark, tokenizer, texts):
    rows = list(enumerate(ODD))
    docs = texts(rows).withColumns({c: F.lit("x") for c in ("part", "length", "rank", "n", "first", "sequence")}).repartition(3)
    for capacity in (4096, 64, 7):
        checked(pack_documents(docs, PATH, capacity).collect(), dict(rows), tokenizer, capacity)


def test_repeated_rows_and_empty_table(spark, texts):
    docs = texts([(1, "same words"), (1, "same words"), (2, "same words"), (None, None)])
    got = pack_documents(docs, PATH).collect()
    assert Counter(r.doc_id for r in got) == {1: 2, 2: 1, None: 1} and len({(r.sequence_id, r.offset) for r in got}) == 4
    assert pack_documents(texts([]), PATH).collect() == []


def test_words_give_what_whole_texts_give(tokenizer):
    with open(PATH, encoding="utf-8") as f:
        encoder = Encoder(f.read())
    texts = [t or "" for t in ODD] * 3
    got = [ids[a:b].tolist() for _, ids, at in encoder.batch(pa.array(texts)) for a, b in zip(at[:-1], at[1:])]
    assert got == [plain(tokenizer, t) for t in texts]


def best_fit(lengths, capacity):
    """Best fit, longest first, one piece at a time."""
    bins = []
    for x in sorted(lengths, reverse=True):
        fits = [b for b in bins if b >= x]
        if fits:
            bins.remove(min(fits))
            bins.append(min(fits) - x)
        else:
            bins.append(capacity - x)
    return sorted(bins)


@pytest.mark.parametrize("seed", range(6))
def test_bulk_best_fit_equals_one_by_one(seed):
    r = np.random.default_rng(seed)
    lengths = r.choice(r.integers(1, 101, 12), 300)
    plan = Plan(np.bincount(lengths, minlength=101), 100)
    plan.best_fit()
    assert plan.bins == len(best_fit(lengths.tolist(), 100))


@pytest.mark.parametrize("seed", range(6))
def test_plans_place_each_piece_once(seed):
    r = np.random.default_rng(seed)
    counts = np.bincount(r.integers(1, [101, 60, 40, 101, 30, 90][seed], 3000), minlength=101)
    plan = packing_plan(counts, 100)
    room, seen = defaultdict(list), Counter()
    for length, first, n, sequence, per, offset in plan.rows:
        assert first == seen[length]
        seen[length] += n
        for k in range(n):
            room[sequence + k // per].append((offset + k % per * length, length))
    assert all(seen[x] == counts[x] for x in range(101)) and set(room) == set(range(plan.bins))
    for places in room.values():
        places.sort()
        assert all(b == a + n for (a, n), (b, _) in zip(places, places[1:])) and places[0][0] == 0 and sum(places[-1]) <= 100
    assert plan.bins <= len(best_fit(np.repeat(np.arange(101), counts).tolist(), 100))


def test_groups_have_equal_cardinality():
    counts = np.zeros(101, np.int64)
    counts[[90, 80, 70, 60, 50]] = [5, 100, 5, 40, 10]
    groups = grouped(counts, 10, 4)
    assert [sum(n for _, n in g) for g in groups] == [40, 40, 40, 40] and groups[0] == [[90, 5], [80, 35]]


def test_configurations_are_optimal():
    """Three sizes of which only mixed bins are full."""
    sizes, demand = np.array([60, 40, 30]), np.array([10.0, 10.0, 20.0])
    # Ten bins of 60 and 40, then three of 30 to a bin.
    assert abs(sum(x for _, x in packing.configurations(sizes, demand, 100)) - (10 + 20 / 3)) < 1e-6
