import hashlib
import random

import numpy as np
import pytest

from sluiceway.llm import suffix_dedup
from sluiceway.llm.suffix_dedup import remove_repeats
from sluiceway.llm.suffix_order import common_prefixes, suffix_array


def brute(items, w=100):
    seen, out = set(), {}
    for k, text in sorted(items, key=lambda x: (x[0] is None, x[0])):
        raw = (text or "").encode()
        gone = [False] * len(raw)
        for i in range(len(raw) - w + 1):
            s = raw[i : i + w]
            if s in seen:
                gone[i : i + w] = [True] * w
            seen.add(s)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[k] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def cases(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    common, base = prose(40), prose(120)
    items = [(0, base), (1, base), (2, None), (3, ""), (4, "a" * 700), (5, "ab" * 300), (6, common)]
    items += [(k, prose(r.randint(1, 60)) + common + prose(r.randint(0, 60))) for k in range(7, 30)]
    items += [(30, base.replace(" ", "  ", 1)), (31, common + common), (32, "x"), (None, base[30:] + "z"), (33, "a" * 99), (34, "a" * 100)]
    r.shuffle(items)
    return items


@pytest.mark.parametrize("hold", [96 << 20, 2000])
def test_equals_brute_force(texts, monkeypatch, hold):
    monkeypatch.setattr(suffix_dedup, "HOLD", hold)
    items = cases(hold)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(texts(items)).collect()}
    assert got == brute(items)


def test_overflow_in_place(monkeypatch):
    """A worker that may hold little hands strings on, and loses none."""
    import pyarrow as pa

    monkeypatch.setattr(suffix_dedup, "HOLD", 3000)
    items = [(k, t) for k, t in cases(5) if k is not None]
    batch = pa.RecordBatch.from_pydict({"text": [t or "" for _, t in items], "_doc": [k for k, _ in items], "_mark": [0] * len(items)})
    packed = list(suffix_dedup._shards(iter([batch]), 1, 100))
    out = [r for b in suffix_dedup._search(iter(packed), 100) for r in b.to_pylist()]
    assert any(r["overflow"] for r in out)


def test_repeated_rows_and_empty_table(texts):
    long = "word " * 50
    rows = remove_repeats(texts([(1, long), (1, long), (2, long)])).collect()
    assert [r.n_removed for r in rows if r.doc_id == 1] == [r.n_removed for r in rows if r.doc_id == 1][:1] * 2
    assert [r.n_removed for r in rows if r.doc_id == 2] == [250]
    assert remove_repeats(texts([])).collect() == []


def test_suffix_array_and_prefixes():
    r = np.random.default_rng(3)
    for depth in (5, 1000):
        for _ in range(60):
            t = r.integers(97, 97 + r.integers(1, 4), r.integers(1, 200)).astype(np.uint8)
            s, order = t.tobytes(), suffix_array(t, depth)
            keys = [s[i : i + depth] for i in order]
            assert sorted(order.tolist()) == list(range(len(t))) and keys == sorted(keys)
            for a, b, n in zip(order[1:], order[:-1], common_prefixes(t, order, depth)):
                true = next((k for k, (x, y) in enumerate(zip(s[a:], s[b:])) if x != y), min(len(s) - a, len(s) - b))
                assert min(true, depth) == min(n, depth)


def test_common_string_long_text_and_clashing_columns(texts):
    """A line that every document holds, many times within one; a text of 200,000 bytes; columns named as the inner ones."""
    import hashlib

    line = " ".join(f"common{k}" for k in range(20))
    long = " ".join(str(k * k) for k in range(24_000))
    items = [(k, f"own {k} {line} {'again ' + line if k % 3 == 0 else ''} end {k}") for k in range(40)] + [(90, long), (91, "x" + long)]
    docs = texts(items).selectExpr("*", "1 AS _doc", "2 AS _mark", "3 AS shard", "4 AS n_bytes")
    seen, want = set(), {}
    for k, t in items:
        raw = t.encode()
        cut = [False] * len(raw)
        last = -1
        for s in range(len(raw) - 99):
            w = hashlib.md5(raw[s : s + 100]).digest()
            if w in seen:
                cut[max(s, last) : s + 100] = [True] * (s + 100 - max(s, last))
                last = s + 100
            seen.add(w)
        want[k] = (len(raw), sum(cut), hashlib.sha256(bytes(b for b, c in zip(raw, cut) if not c)).hexdigest())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.kept_sha256) for r in remove_repeats(docs).collect()}
    assert got == want


def test_only_windows_that_may_repeat_are_sorted():
    r = np.random.default_rng(3)
    line = bytes(r.integers(97, 123, 60).astype(np.uint8))
    strings = []
    for k in range(300):
        around = bytes(r.integers(97, 123, 80).astype(np.uint8))
        strings.append((around[:40] + line + around[40:], (k, 0, 5 * k)))
    assert suffix_dedup.suspects(strings, 100) == []
    common = b"x" * 10 + line + b"y" * 40
    strings += [(common + b"1" * 30, (900, 0, 7)), (b"2" * 30 + common, (901, 0, 9)), (b"short", (902, 0, 0))]
    assert suffix_dedup.suspects(strings, 100) == [(common, (900, 0, 7)), (common, (901, 0, 39))]
    assert list(suffix_dedup.repeats_in(strings, 100)) == [(901, 0, 39, 149)]
    for window in (1, 2, 3, 7, 100):
        d = r.integers(97, 99, 300).astype(np.uint8)
        h = suffix_dedup.window_hashes(d, window)
        seen: dict[bytes, int] = {}
        assert len(h) == 301 - window and all(seen.setdefault(d[k : k + window].tobytes(), int(h[k])) == h[k] for k in range(len(h))) and len(set(seen.values())) == len(seen)


def packed_strings(chunks, each):
    """Packed runs as the workers get them: chunks of random texts, and the texts."""
    import pyarrow as pa

    r = random.Random(7)
    texts = [["".join(r.choice("abcdefghij ") for _ in range(120)) for _ in range(each)] for _ in range(chunks)]
    out = []
    for k, some in enumerate(texts):
        ids = [k * each + n for n in range(each)]
        out += suffix_dedup._shards(iter([pa.RecordBatch.from_pydict({"text": some, "_doc": ids, "_mark": ids})]), 1, 100)
    return out


def test_what_is_held_is_not_weighed_for_each_blob(monkeypatch):
    """Many different strings of many minimizers: none is large, so none can leave, and weighing them again and again is of no use."""
    weighed = []

    class Weighed(suffix_dedup.Counter):
        def __init__(self):
            weighed.append(1)
            super().__init__()

    monkeypatch.setattr(suffix_dedup, "HOLD", 20_000)
    monkeypatch.setattr(suffix_dedup, "Counter", Weighed)
    blobs = packed_strings(100, 10)
    assert [r for b in suffix_dedup._search(iter(blobs), 100) for r in b.to_pylist()] == []
    assert len(blobs) == 100 and 1 <= len(weighed) <= 8


def test_each_shard_has_a_task_of_its_own(spark):
    packed = spark.range(400).selectExpr("CAST(id % 40 AS int) AS shard", "CAST('x' AS binary) AS packed")
    got = suffix_dedup._dealt(packed, 40).selectExpr("shard", "spark_partition_id() AS task").distinct().collect()
    assert len(got) == 40 == len({r.task for r in got}) == len({r.shard for r in got})


def test_windows_of_overflowed_strings_come_in_large_batches(monkeypatch):
    import pyarrow as pa
    import xxhash

    keys = [bytes([97 + k % 26]) * (100 + k % 5) for k in range(300)]
    batch = pa.RecordBatch.from_pydict({"doc": list(range(300)), "mark": [-k for k in range(300)], "s": [7 * k for k in range(300)], "overflow": keys})
    want = [{"w": xxhash.xxh3_128_digest(key[x : x + 100]), "doc": k, "mark": -k, "s": 7 * k + x} for k, key in enumerate(keys) for x in range(len(key) - 99)]
    for size, most in ((1 << 16, 1), (100, 10)):
        monkeypatch.setattr(suffix_dedup, "BATCH", size, raising=False)
        got = list(suffix_dedup._windows(iter([batch]), 100))
        assert len(got) <= most and [r for b in got for r in b.to_pylist()] == want
