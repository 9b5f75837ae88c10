"""Removal of repeated byte strings, by suffix order of content-dealt shards.

Every window of WINDOW bytes is dealt by its minimizer, the least hash of its
GRAM-byte strings: equal windows have equal minimizers, so they meet in one
shard wherever they stand.  Neighbouring windows with one minimizer travel as
one string, so a byte is sent about three times, compressed.  Equal strings
collapse within each chunk of documents before they are sent, so a shard gets
one copy from a chunk however common a string is, and within the shard again;
where different strings share a minimizer, the suffixes of what may be a repeat
in them (windows whose hash comes twice) are sorted by induction and windows
with a common prefix of WINDOW bytes compared by place.  A minimizer whose different strings outgrow a worker
is dealt anew, window by window, by plain aggregation; the result is the same.
"""

from __future__ import annotations

import hashlib
import struct
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluiceway.llm.common import BYTE_VALUE, U64, flat, ints, materialize, mix, partitions_for, ranges
from sluiceway.llm.suffix_order import common_prefixes, suffix_array

WINDOW, GRAM = 100, 24
#: Text bytes expanded at once, bytes sorted at once, distinct bytes a worker may hold.
CHUNK, BLOCK, HOLD = 8 << 20, 4 << 20, 96 << 20
#: Bytes of runs a shard, bytes of overflowed strings a task.
SHARD_BYTES, OVER_BYTES = 24 << 20, 2 << 20
#: Bytes whose windows are hashed at once, windows dealt anew at once.
STEP, BATCH = 1 << 20, 1 << 16
_B = U64(0x9E3779B97F4A7C15 | 1)


def _power(n: int) -> np.uint64:
    return U64(pow(int(_B), n, 1 << 64))


def grams(d: np.ndarray, seed: int) -> np.ndarray:
    """Hashes of the GRAM-byte strings of d."""
    h = BYTE_VALUE[d]
    h2 = h[:-1] * _power(1) + h[1:]
    h4 = h2[:-2] * _power(2) + h2[2:]
    h8 = h4[:-4] * _power(4) + h4[4:]
    h16 = h8[:-8] * _power(8) + h8[8:]
    h24 = h16[:-8] * _power(8) + h8[16:]
    return mix(h24 ^ U64(seed))


def least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    done = 1
    while done < width:
        step = min(done, width - done)
        h = np.minimum(h[:-step], h[step:])
        done += step
    return h


def runs(d: np.ndarray, bounds: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Maximal runs of windows with one minimizer.

    Returns the minimizer, the document, the first start, the end of the last
    window, and whether the minimizer may stand twice in the run, so that the run
    can hold one window twice.
    """
    sizes = np.diff(bounds)
    if len(d) < window:
        none = np.zeros(0, np.int64)
        return none.astype(U64), none, none, none, none.astype(bool)
    width = window - GRAM + 1
    h = grams(d, 17)
    m = least(h, width)
    # A gram is chosen where the largest minimum of the windows over it is its own hash.
    around = np.concatenate([np.full(width - 1, ~U64(0)), ~m, np.full(width - 1, ~U64(0))])
    chosen = np.flatnonzero(least(around, width) == ~h)
    again = (h[chosen[1:]] == h[chosen[:-1]]) & (np.diff(chosen) < width)
    twice = np.unique(h[chosen[1:]][again])
    valid = np.zeros(len(d) + 1, np.int32)
    fit = sizes >= window
    np.add.at(valid, bounds[:-1][fit], 1)
    np.add.at(valid, bounds[1:][fit] - window + 1, -1)
    valid = np.cumsum(valid[: len(m)]) > 0
    new = valid.copy()
    new[1:] &= m[1:] != m[:-1]
    new[bounds[:-1][fit]] = True
    start = np.flatnonzero(new)
    doc = np.searchsorted(bounds, start, "right") - 1
    last = bounds[doc + 1] - window
    last[:-1] = np.minimum(last[:-1], start[1:] - 1)
    return m[start], doc, start, last + window, np.isin(m[start], twice)


def _collapsed(raw: bytes, h: np.ndarray, start: np.ndarray, end: np.ndarray, place: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Of runs (minimizer h, bytes start to end): those whose bytes no run at an earlier place has, and the others.

    Runs at one place, of rows that are one document, count once.  So whatever a
    common string's number of copies, a shard gets one of them from each chunk.
    """
    key = mix(h ^ mix((end - start).astype(U64)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    alike = np.zeros(len(key), bool)
    alike[order[1:][same]] = alike[order[:-1][same]] = True
    some = np.flatnonzero(alike)
    some = some[np.lexsort(tuple(x[some] for x in reversed(place)))]
    seen: dict[bytes, int] = {}
    spare, later = np.zeros(len(key), bool), []
    for k in some.tolist():
        q = seen.setdefault(raw[start[k] : end[k]], k)
        if q != k:
            spare[k] = True
            if any(x[q] != x[k] for x in place):
                later.append(k)
    return np.flatnonzero(~spare), np.array(later, np.int64)


def _shards(batches: Iterator[pa.RecordBatch], parts: int, window: int) -> Iterator[pa.RecordBatch]:
    """Documents to packed runs, one row a chunk and shard."""
    packer = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        data, offsets = flat(batch.column("text"))
        ids, marks = ints(batch.column("_doc")), ints(batch.column("_mark"))
        for i, j in ranges(offsets, CHUNK):
            lo = offsets[i]
            d, bounds = data[lo : offsets[j]], offsets[i : j + 1] - lo
            found = [runs(d[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], window) + (np.int64(a), bounds[a]) for a, b in ranges(bounds, 1 << 18)]
            h = np.concatenate([x[0] for x in found])
            if not len(h):
                continue
            doc = np.concatenate([x[1] + x[5] for x in found])
            start = np.concatenate([x[2] + x[6] for x in found])
            end = np.concatenate([x[3] + x[6] for x in found])
            loop = np.concatenate([x[4] for x in found])
            raw = d.tobytes()
            shard = (h >> U64(20)) % U64(parts)
            rows, blobs = [], []
            first, later = _collapsed(raw, h, start, end, (ids[doc + i], marks[doc + i], start - bounds[doc]))
            if len(later):
                # Copies within a chunk are found here; they need no shard of their own, so any will do.
                spans = np.stack([ids[doc[later] + i], marks[doc[later] + i], (start - bounds[doc])[later], (end - bounds[doc])[later]])
                rows.append(int(shard[0]))
                blobs.append(packer.compress(struct.pack("<q", -len(later)) + spans.astype(np.int64).tobytes()))
            order = first[np.argsort(shard[first], kind="stable")]
            shard, h, doc, start, end, loop = (x[order] for x in (shard, h, doc, start, end, loop))
            cuts = np.append(np.flatnonzero(np.append(True, shard[1:] != shard[:-1])), len(shard))
            size, at = end - start, start - bounds[doc]
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                body = b"".join([raw[x:y] for x, y in zip(start[a:b].tolist(), end[a:b].tolist())])
                k = doc[a:b] + i
                head = b"".join([struct.pack("<q", b - a), h[a:b].tobytes(), ids[k].tobytes(), marks[k].tobytes(), at[a:b].astype(np.int64).tobytes(), size[a:b].astype(np.int64).tobytes(), loop[a:b].astype(np.int64).tobytes()])
                rows.append(int(shard[a]))
                blobs.append(packer.compress(head + body))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(blobs, pa.binary())], names=["shard", "packed"])


_FOUND = "doc long, mark long, s long, e long, overflow binary"


def _found(rows: list[tuple], overflow: list[bytes | None] | None = None) -> pa.RecordBatch:
    cols = [pa.array([r[k] for r in rows], pa.int64()) for k in range(4)]
    return pa.RecordBatch.from_arrays([*cols, pa.array(overflow or [None] * len(rows), pa.binary())], names=["doc", "mark", "s", "e", "overflow"])


def window_hashes(d: np.ndarray, window: int) -> np.ndarray:
    """Hashes of the `window`-byte strings of d, put together from strings of doubling length."""
    h, size, left = BYTE_VALUE[d], 1, window
    out, done = None, 0
    while left:
        if left & 1:
            rest = h[done:]
            out = rest if out is None else out[: len(rest)] * _power(size) + rest
            done += size
        left >>= 1
        if left:
            h = h[:-size] * _power(size) + h[size:]
            size *= 2
    return mix(out.copy())


def suspects(strings: list[tuple[bytes, tuple[int, int, int]]], window: int) -> list[tuple[bytes, tuple[int, int, int]]]:
    """The stretches of strings whose windows have a hash that comes more than once.

    No other window can be a repeat, so only these need a suffix order; it
    decides, hashes being equal by chance too.  Many different strings around one
    common passage come down to little.
    """
    t = np.frombuffer(b"".join(s for s, _ in strings), np.uint8)
    size = np.array([len(s) for s, _ in strings])
    begin = np.cumsum(size) - size
    if len(t) < window:
        return []
    inner = np.zeros(len(t) + 1, np.int8)
    fit = size >= window
    np.add.at(inner, begin[fit], 1)
    np.add.at(inner, (begin + size - window + 1)[fit], -1)
    at = np.flatnonzero(np.cumsum(inner, dtype=np.int8)[: len(t) - window + 1])
    # Only the hashes of windows within one string are kept of each step.
    cuts = np.searchsorted(at, np.arange(0, len(t) - window + 1 + STEP, STEP))
    h = np.concatenate([window_hashes(t[k * STEP : (k + 1) * STEP + window - 1], window)[at[a:b] - k * STEP] for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]))])
    ordered = np.sort(h)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(again):
        return []
    again = again[np.append(True, again[1:] != again[:-1])]
    hit = at[again[np.minimum(np.searchsorted(again, h), len(again) - 1)] == h]
    owner = np.searchsorted(begin, hit, "right") - 1
    cut = np.flatnonzero((hit[1:] != hit[:-1] + 1) | (owner[1:] != owner[:-1])) + 1
    heads, tails = np.append(0, cut), np.append(cut, len(hit)) - 1
    out = []
    for k, a, b in zip(owner[heads].tolist(), (hit - begin[owner])[heads].tolist(), (hit - begin[owner])[tails].tolist()):
        text, (doc, mark, start) = strings[k]
        out.append((text[a : b + window], (doc, mark, start + a)))
    return out


def repeats_in(strings: list[tuple[bytes, tuple[int, int, int]]], window: int) -> Iterator[tuple[int, int, int, int]]:
    """(document, mark, start, end) of runs of windows that stand earlier in the same strings.

    strings: bytes and place (document, mark, start); no window stands in two of them.
    """
    strings = suspects(strings, window)
    if not strings:
        return
    t = np.frombuffer(b"".join(s for s, _ in strings), np.uint8)
    size = np.array([len(s) for s, _ in strings])
    begin = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(strings)), size)
    inside = np.arange(len(t)) - begin[owner]
    order = suffix_array(t, window)
    order = order[(inside + window <= size[owner])[order]]
    if len(order) < 2:
        return
    group = np.append(0, np.cumsum(common_prefixes(t, order, window) < window))
    # Strings of one document can overlap, so a window's place is its document's with its own start.
    ids = np.array([p for _, p in strings], np.int64)
    _, docs = np.unique(ids[:, :2], axis=0, return_inverse=True)
    own = owner[order]
    place = ids[own, 2] + inside[order]
    best = np.lexsort((place, docs.reshape(-1)[own], group))
    later = np.zeros(len(t) + 1, bool)
    firsts = np.append(True, group[best][1:] != group[best][:-1])
    later[order[best[~firsts]]] = True
    hit = np.flatnonzero(later)
    if not len(hit):
        return
    new = np.append(True, (hit[1:] != hit[:-1] + 1) | (owner[hit[1:]] != owner[hit[:-1]]))
    heads = hit[new]
    tails = hit[np.append(np.flatnonzero(new)[1:] - 1, len(hit) - 1)]
    for a, b in zip(heads.tolist(), tails.tolist()):
        doc, mark, start = strings[owner[a]][1]
        yield doc, mark, start + int(inside[a]), start + int(inside[b]) + window


def _search(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Packed runs of whole shards to repeated stretches."""
    unpack = zstandard.ZstdDecompressor()
    first: dict[bytes, tuple[int, int, int, int, int]] = {}
    large: set[int] = set()
    held, limit = 0, HOLD
    for batch in batches:
        for blob in batch.column("packed"):
            raw = unpack.decompress(blob.as_py())
            (n,) = struct.unpack_from("<q", raw)
            if n < 0:
                yield _found(np.frombuffer(raw, np.int64, -4 * n, 8).reshape(4, -n).T.tolist())
                continue
            h, doc, mark, at, size, loop = np.frombuffer(raw, np.int64, 6 * n, 8).reshape(6, n)
            ends = np.cumsum(size) + 8 + 48 * n
            out: list[tuple] = []
            over: list[bytes | None] = []
            for x, p, y, z, twice in zip(h.tolist(), zip(doc.tolist(), mark.tolist(), at.tolist()), ends.tolist(), size.tolist(), loop.tolist()):
                key = raw[y - z : y]
                if x in large:
                    out.append((*p, p[2] + len(key)))
                    over.append(key)
                    continue
                q = first.get(key)
                if q is None:
                    first[key] = (*p, x, twice)
                    held += len(key) + 200
                    continue
                if p < q[:3]:
                    first[key] = (*p, x, twice)
                    p = q[:3]
                elif p == q[:3]:
                    continue
                out.append((*p, p[2] + len(key)))
                over.append(None)
            if held > limit:
                weight: Counter[int] = Counter()
                for key, q in first.items():
                    weight[q[3]] += len(key) + 200
                large.update(x for x, w in weight.items() if w > HOLD // 16)
                for key in [k for k, q in first.items() if q[3] in large]:
                    q = first.pop(key)
                    held -= len(key) + 200
                    out.append((*q[:3], q[2] + len(key)))
                    over.append(key)
                # Weighing reads all that is held, so it waits until that has doubled, or it would be done anew for each blob.
                limit = max(HOLD, 2 * held)
            if out:
                yield _found(out, over)
    if not first:
        return
    h = np.array([q[3] for q in first.values()], np.int64)
    _, inverse, counts = np.unique(h, return_inverse=True, return_counts=True)
    several = np.flatnonzero((counts[inverse] > 1) | np.array([q[4] for q in first.values()], bool))
    several = several[np.argsort(inverse[several], kind="stable")]
    items = list(first.items())
    block: list[tuple[bytes, tuple[int, int, int]]] = []
    filled, group = 0, -1
    for k in several.tolist():
        key, q = items[k]
        if filled > BLOCK and inverse[k] != group:
            if rows := list(repeats_in(block, window)):
                yield _found(rows)
            block, filled = [], 0
        block.append((key, q[:3]))
        filled, group = filled + len(key), inverse[k]
    if block and (rows := list(repeats_in(block, window))):
        yield _found(rows)


def _windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Each window of an overflowed string, as a 128-bit hash."""
    for batch in batches:
        keys = batch.column("overflow")
        sizes = pc.binary_length(keys).to_numpy(zero_copy_only=False) - window + 1
        for i, j in ranges(np.append(0, np.cumsum(sizes)), BATCH):
            n, some = sizes[i:j], keys[i:j].to_pylist()
            inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            doc, mark, s = (np.repeat(ints(batch.column(c))[i:j], n) for c in ("doc", "mark", "s"))
            w = [xxhash.xxh3_128_digest(key[k : k + window]) for key in some for k in range(len(key) - window + 1)]
            yield pa.RecordBatch.from_arrays([pa.array(w, pa.binary()), pa.array(doc), pa.array(mark), pa.array(s + inside)], names=["w", "doc", "mark", "s"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
        for text, starts, ends in zip(batch.column("text").to_pylist(), batch.column("ss").to_pylist(), batch.column("es").to_pylist()):
            raw = (text or "").encode()
            spans: list[list[int]] = []
            for s, e in sorted(zip(starts or (), ends or ())):
                if spans and s <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], e)
                else:
                    spans.append([s, e])
            parts, at = [], 0
            for s, e in spans:
                parts.append(raw[at:s])
                at = e
            kept = b"".join([*parts, raw[at:]])
            for k, v in zip(out, (len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept)):
                out[k].append(v)
        types = {"kept": pa.binary(), "kept_sha256": pa.string()}
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(v, types.get(k, pa.int64())) for k, v in out.items())], names=["doc_id", *out])


def _dealt(packed: DataFrame, parts: int) -> DataFrame:
    """Each shard to a task of its own; dealt by a hash of their numbers, several would meet in one."""
    return packed.repartitionById(parts, "shard")


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc, mark, s, e: stretches of UTF-8 bytes covered by windows that also start earlier.

    docs: _doc long (the order of documents), _mark long (tells texts of one id apart), text.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = partitions_for(spark, 3.5 * total, SHARD_BYTES)
    packed = docs.select("_doc", "_mark", "text").mapInArrow(lambda it: _shards(it, parts, window), "shard int, packed binary")
    found = materialize(_dealt(packed, parts).mapInArrow(lambda it: _search(it, window), _FOUND), "repeats")
    spans = found.filter(F.col("overflow").isNull()).drop("overflow")
    again = found.filter(F.col("overflow").isNotNull())
    over = again.agg(F.sum(F.octet_length("overflow"))).first()[0] or 0
    if over:
        # All strings of an overflowed minimizer stand in one task's file, so they are dealt out first.
        dealt = again.repartition(partitions_for(spark, over, OVER_BYTES), "doc", "mark", "s").distinct()
        windows = materialize(dealt.mapInArrow(lambda it: _windows(it, window), "w binary, doc long, mark long, s long"), "windows")
        firsts = windows.groupBy("w").agg(F.min(F.struct("doc", "mark", "s")).alias("f"))
        later = windows.join(firsts, "w").filter(F.struct("doc", "mark", "s") != F.col("f"))
        spans = spans.union(later.select("doc", "mark", "s", (F.col("s") + window).alias("e")))
    return spans


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Cut from each text every byte of a `window`-byte string that also starts earlier.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining
    bytes, which may split a character).  Null text is empty.  Documents stand in
    the order of doc_id, null last; rows with one doc_id and different texts in
    the order of a hash of the text; rows equal in both are one document, given
    back as often as they come.  Texts shorter than the window are kept whole.
    Other columns are ignored.
    """
    keyed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"),
    ).select("doc_id", "text", F.coalesce("doc_id", F.lit(2**63 - 1)).alias("_doc"), F.xxhash64("text", F.col("doc_id").isNull()).alias("_mark"))
    spans = repeated_spans(keyed, window)
    spans = spans.groupBy("doc", "mark").agg(F.collect_list("s").alias("ss"), F.collect_list("e").alias("es"))
    joined = keyed.join(spans, (keyed["_doc"] == spans["doc"]) & (keyed["_mark"] == spans["mark"]), "left")
    return joined.select("doc_id", "text", "ss", "es").mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
