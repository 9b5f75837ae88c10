"""Collocations: phrases of two to four words whose words come together more often than apart.

A sketch of two rows of cells bounds each phrase's count from above, first for
words, then for pairs of words that pass, then for triples and fours of pairs
that pass.  Phrases whose bound reaches the threshold are candidates.  They are
dealt into shards and compiled into Aho-Corasick automata whose patterns have a
blank on both sides; the stretches of text in which candidates can lie, each
distinct one once per batch with its weight, are scanned for all overlapping
matches.  The sums of the matches are exact counts, to which the threshold and
the scores apply.
"""

from __future__ import annotations

import ctypes
import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluiceway.llm.common import LOWER, LOWERED_VALUE, POWERS, U64, flat, materialize, mix, ranges

LEAST, LONGEST, TOP, INSIDE = 30, 4, 2000, 80
#: Cells of a sketch's row: a power of two, about one for eight words, at most this many (a bitmap of 32 MB).
CELLS = 1 << 28
#: Candidates of one automaton (some 250 bytes each), and characters of the text that one group scans.
SHARD_PHRASES, GROUP_CHARS = 1 << 19, 64 << 20
#: Bytes of text that are cut into words at once, and hashes that are counted at once.
CHUNK, COUNTED = 2 << 20, 2 << 20
#: Bytes of text whose stretches collapse together, and of texts in one packed value.
GATHERED, PACKED = 16 << 20, 256 << 10
#: Bytes of documents for one bucket of candidates, and the fewest buckets.
BUCKET_BYTES, BUCKETS = 64 << 20, 64
_BLOCK = 1 << 16

#: 1: blank, 2: between pieces, 0: in a word.
_CLASS = np.zeros(256, np.uint8)
_CLASS[[0x20, 0x09]] = 1
_CLASS[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2


def _give_back() -> None:
    """Returns freed memory to the system at a task's end; the worker waits beside others for its next task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


# --- words and phrases of a batch ----------------------------------------------


class Pieces:
    """The words of documents i..j with the piece each lies in; `hash` tells a word and its language apart."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, i: int, j: int, language: np.ndarray) -> None:
        lo, hi = int(offsets[i]), int(offsets[j])
        self.data = d = data[lo:hi]
        bounds = offsets[i : j + 1] - lo
        kind = _CLASS[d]
        inside = kind == 0
        edge = np.zeros(len(d) + 1, bool)
        edge[bounds] = True
        begins, stops = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1] | edge[1:-1]
        stops[:-1] &= ~inside[1:] | edge[1:-1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        self.piece = np.cumsum((kind == 2) | edge[:-1])[self.start]
        up, down = POWERS.get(len(d) + 1)
        total = np.zeros(len(d) + 1, U64)
        np.cumsum(LOWERED_VALUE[d] * up[: len(d)], out=total[1:])
        h = mix((total[self.end] - total[self.start]) * down[self.start] + (self.end - self.start).astype(U64))
        self.doc = i + np.repeat(np.arange(j - i), np.diff(np.searchsorted(self.start, bounds)))
        self.hash = mix(h ^ language[self.doc])

    def phrases(self, filters: list[Filter]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per number of words, from 1: hashes of the phrases from each word on, and which may be frequent.

        The filters hold for one word, two words, three and more; where one is
        missing, those stand whose parts may be frequent.
        """
        h, out, g = self.hash, [], self.hash
        for n in range(1, LONGEST + 1):
            if n == 1:
                may = np.ones(len(h), bool)
            else:
                g = mix((g[:-1] * U64(0x9FB21C651E98DF25) + U64(n)) ^ h[n - 1 :])
                may = out[-1][1][:-1] & out[-1][1][1:]
                if n == 2:
                    may &= self.piece[:-1] == self.piece[1:]
            if min(n, 3) <= len(filters) and may.any():
                some = np.flatnonzero(may)
                may[some] = filters[min(n, 3) - 1].holds(g[some])
            out.append((g, may))
        return out

    def strings(self, first: np.ndarray, size: np.ndarray) -> pa.Array:
        """The phrases of `size` words from `first` on, A-Z lowered, with one blank between words."""
        bounds = np.cumsum(size) - size
        word = np.arange(int(size.sum())) + np.repeat(first - bounds, size)
        width = self.end[word] - self.start[word] + 1
        at = np.cumsum(width) - width
        place = np.arange(int(width.sum())) + np.repeat(self.start[word] - at, width)
        text = LOWER[np.append(self.data, np.uint8(0))[place]]
        text[at + width - 1] = 0x20
        offsets = np.append(at[bounds], len(text)) if len(bounds) else np.zeros(1, np.int64)
        # The last blank of each is cut off by a rim of one byte.
        keep = np.ones(len(text), bool)
        keep[offsets[1:] - 1] = False
        return pa.StringArray.from_buffers(len(size), pa.py_buffer((offsets - np.arange(len(offsets))).astype(np.int32)), pa.py_buffer(text[keep]))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Pieces, list[str], np.ndarray]]:
    """Pieces of texts with their languages' names and each document's language as a number."""
    for b in batches:
        names = pc.fill_null(b.column(1), "und").dictionary_encode()
        own = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        known = names.dictionary.to_pylist()
        code = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in known] or [0], U64)
        data, offsets = flat(b.column(0))
        for i, j in ranges(offsets, CHUNK):
            yield Pieces(data, offsets, i, j, code[own]), known, own


# --- the sketch ------------------------------------------------------------------


class Filter:
    """Which phrases may be frequent: a bit for each cell of the sketch's two rows."""

    def __init__(self, cells: int, bits: np.ndarray) -> None:
        self.cells, self.bits = cells, bits

    def holds(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for row in (0, 1):
            cell = _cell(h, row, self.cells)
            out &= (self.bits[row][cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1
        return out


def _cell(h: np.ndarray, row: int, cells: int) -> np.ndarray:
    return ((h >> U64(32 * row)) & U64(cells - 1)).astype(np.int64)


def _level(docs: DataFrame, cells: int, filters: list) -> Filter:
    """The next filter: counts of cells by task, summed by blocks of cells; those that reach LEAST are set."""

    def cells_of(hashes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        h = np.concatenate(hashes)
        for row in (0, 1):
            cell, n = np.unique(_cell(h, row, cells), return_counts=True)
            block, first = np.unique(cell // _BLOCK, return_index=True)
            # Of a block's cells, in order, the steps are kept.
            cell = (cell % _BLOCK).astype(np.uint16)
            step = np.diff(cell, prepend=np.uint16(0))
            step[first] = cell[first]
            size = np.diff(np.append(first, len(cell)))
            blobs = [_compress(_by_place(s) + _by_place(c)) for s, c in zip(np.split(step, first[1:]), np.split(n.astype(np.uint32), first[1:]))]
            yield pa.RecordBatch.from_arrays([pa.array((row * (cells // _BLOCK) + block).astype(np.int64)), pa.array(size.astype(np.int32)), pa.array(blobs, pa.binary())], ["block", "size", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, hashes, held, pieces = [f.value for f in filters], [], 0, None
        level = len(before) + 1
        for pieces, _, _ in _chunks(batches):
            for n, (g, may) in enumerate(pieces.phrases(before), 1):
                if n == level or n > level == 3:
                    hashes.append(g[may])
                    held += len(hashes[-1])
            if held > COUNTED:
                yield from cells_of(hashes)
                hashes, held = [], 0
        if held:
            yield from cells_of(hashes)
        del pieces, hashes
        _give_back()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for block, size, counts in zip(*(c.to_pylist() for c in b.columns)):
                raw = pa.decompress(counts, 6 * size, "zstd", asbytes=True)
                if block not in sums:
                    sums[block] = np.zeros(_BLOCK, np.int64)
                sums[block][np.cumsum(_of_places(raw[: 2 * size], np.uint16), dtype=np.int64)] += _of_places(raw[2 * size :], np.uint32)
        full = [(k, np.packbits(v >= LEAST, bitorder="little").tobytes()) for k, v in sums.items() if (v >= LEAST).any()]
        del sums
        _give_back()
        yield pa.RecordBatch.from_pylist([{"block": k, "bits": v} for k, v in full], pa.schema([("block", pa.int64()), ("bits", pa.binary())]))

    counted = docs.select("text", "lang").mapInArrow(count, "block long, size int, counts binary")
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * cells // _BLOCK // 64)
    bits = np.zeros((2, cells // 8), np.uint8)
    width = _BLOCK // 8
    for r in counted.repartition(parts, "block").mapInArrow(add, "block long, bits binary").collect():
        row, k = divmod(r.block, cells // _BLOCK)
        bits[row, k * width : (k + 1) * width] = np.frombuffer(r.bits, np.uint8)
    return Filter(cells, bits)


# --- packed values -----------------------------------------------------------------


def _compress(raw: bytes) -> bytes:
    return pa.Codec("zstd", compression_level=6).compress(raw, asbytes=True)


def _by_place(values: np.ndarray) -> bytes:
    """All first bytes, then all second ones, and so on: small numbers leave long runs of zeros."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def _of_places(raw: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _packed(texts: pa.Array, weights: np.ndarray) -> Iterator[tuple[bytes, int, int]]:
    """Texts in order with their weights as compressed values of some PACKED bytes; their sizes and numbers of texts.

    A line break stands between texts; no word holds one.
    """
    order = pc.sort_indices(texts)
    texts, weights = texts.take(order), weights[order.to_numpy()].astype(np.uint32)
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    first = np.unique(ends // PACKED, return_index=True)[1]
    bounds = np.append(first, len(texts))
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), texts), "\n")
    for k, line in enumerate(joined.to_pylist()):
        raw = line.encode() + _by_place(weights[bounds[k] : bounds[k + 1]])
        yield _compress(raw), len(raw), int(bounds[k + 1] - bounds[k])


def _unpacked(blob: bytes, size: int, n: int) -> tuple[list[str], np.ndarray]:
    raw = pa.decompress(blob, size, "zstd", asbytes=True)
    return raw[: size - 4 * n].decode().split("\n"), _of_places(raw[size - 4 * n :], np.uint32)


# --- candidates and the text they can lie in -----------------------------------------


def _pieces_of(docs: DataFrame, filters: list, buckets: int) -> DataFrame:
    """kind, lang, bucket, blob, size, n by batch: packed candidates of two words and more, by bucket (0), packed stretches of text and how often each comes (1) and numbers of words (2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = [f.value for f in filters]
        for b in batches:
            texts, langs, found, hashes, owners, names, held = [], [], [], [], [], [], 0
            for pieces, names, own in _chunks(iter([b])):
                if held > GATHERED:
                    yield from collapsed(texts, langs, found, hashes, owners, names)
                    texts, langs, found, hashes, owners, held = [], [], [], [], [], 0
                held += len(pieces.data)
                per_size = pieces.phrases(before)
                lang = own[pieces.doc]
                first, size, fresh = [], [], []
                for n, (g, may) in enumerate(per_size[1:], 2):
                    some = np.flatnonzero(may)
                    some = some[np.unique(g[some], return_index=True)[1]]
                    first.append(some)
                    size.append(np.full(len(some), n))
                    fresh.append(g[some])
                first = np.concatenate(first)
                found.append(pieces.strings(first, np.concatenate(size)))
                hashes += fresh
                owners.append(lang[first])
                # A stretch goes on as long as pairs may be frequent; a word alone may be, too.
                may, tied = per_size[0][1], np.append(per_size[1][1], False)
                opens = np.flatnonzero(may & ~np.append(False, tied[:-1])[: len(may)])
                closes = np.flatnonzero(may & ~tied[: len(may)])
                texts.append(pieces.strings(opens, closes - opens + 1))
                langs.append(lang[opens])
                key, n = np.unique(lang, return_counts=True)
                yield _rows([(2, names[k], 0, b"", 0, int(m)) for k, m in zip(key, n)])
            if texts:
                yield from collapsed(texts, langs, found, hashes, owners, names)
        _give_back()

    def collapsed(texts: list, langs: list, found: list, hashes: list, owners: list, names: list[str]) -> Iterator[pa.RecordBatch]:
        """Each candidate once, and each stretch once with its weight."""
        hashed, once = np.unique(np.concatenate(hashes), return_index=True)
        place = np.concatenate(owners)[once] * buckets + (hashed % U64(buckets)).astype(np.int64)
        yield from by_place(0, pa.concat_arrays(found).take(pa.array(once)), place, np.zeros(len(once), np.int64), names)
        whole = pa.concat_arrays(texts).dictionary_encode()
        key = whole.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(names) + np.concatenate(langs)
        key, n = np.unique(key, return_counts=True)
        yield from by_place(1, whole.dictionary.take(pa.array(key // len(names))), key % len(names) * buckets, n, names)

    def by_place(kind: int, texts: pa.Array, place: np.ndarray, weights: np.ndarray, names: list[str]) -> Iterator[pa.RecordBatch]:
        """place: a language's number times buckets, and the bucket."""
        order = np.argsort(place, kind="stable")
        for some in np.split(order, np.flatnonzero(np.diff(place[order])) + 1):
            if len(some):
                lang, bucket = divmod(int(place[some[0]]), buckets)
                yield _rows([(kind, names[lang], bucket, *v) for v in _packed(texts.take(pa.array(some)), weights[some])])

    return docs.select("text", "lang").mapInArrow(run, "kind int, lang string, bucket int, blob binary, size long, n long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of kind, lang, bucket, blob, size, n."""
    kinds = (pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 6, kinds)], ["kind", "lang", "bucket", "blob", "size", "n"])


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, blob, size, n of whole buckets: each candidate once."""
    found: dict[str, tuple[list[pa.Array], int]] = {}
    for b in batches:
        for lang, blob, size, n in zip(*(c.to_pylist() for c in b.columns)):
            held, more = found.get(lang, ([], 0))
            held, more = [*held, pa.array(_unpacked(blob, size, n)[0], pa.string())], more + n
            if more > max(COUNTED, 2 * len(held[0])):
                held, more = [pc.unique(pa.chunked_array(held))], 0
            found[lang] = held, more
    for lang, (held, _) in found.items():
        once = pc.unique(pa.chunked_array(held))
        for k in range(0, len(once), _BLOCK):
            some = once.slice(k, _BLOCK)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), some], ["lang", "phrase"])
    del found
    _give_back()


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, phrase, shard: to shard, lang, blob, size, n, packed by shard within a batch."""
    for b in batches:
        for lang in pc.unique(b.column(0)).to_pylist():
            own = b.filter(pc.equal(b.column(0), lang))
            shard = own.column(2).to_numpy()
            for s in np.unique(shard):
                some = own.column(1).filter(pa.array(shard == s))
                yield _shard_rows([(int(s), lang, *v) for v in _packed(some, np.zeros(len(some), np.int64))])


def _shard_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.string(), pa.binary(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["shard", "lang", "blob", "size", "n"])


def _windows(words: list[str], shards: int) -> Iterator[tuple[int, str]]:
    """A stretch of text by shard: what lies within LONGEST words from a word of the shard on, overlaps as one."""
    parts: dict[int, list[list[int]]] = {}
    for k, w in enumerate(words):
        own = parts.setdefault(zlib.crc32(w.encode()) % shards, [])
        stop = min(k + LONGEST, len(words))
        if own and k < own[-1][1]:
            own[-1][1] = stop
        else:
            own.append([k, stop])
    for shard, spans in parts.items():
        for i, j in spans:
            yield shard, " ".join(words[i:j])


def _cut_by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, blob, size, n, shards: to shard, lang, blob, size, n."""
    parts: dict[tuple[int, str], Counter] = {}
    held = 0
    for b in batches:
        for lang, blob, size, n, shards in zip(*(c.to_pylist() for c in b.columns)):
            for text, weight in zip(*_unpacked(blob, size, n)):
                for s, p in _windows(text.split(" "), shards):
                    parts.setdefault((s, lang), Counter())[p] += int(weight)
            held += size
            if held > GATHERED:
                yield from _packed_parts(parts)
                parts, held = {}, 0
    yield from _packed_parts(parts)


def _packed_parts(parts: dict[tuple[int, str], Counter]) -> Iterator[pa.RecordBatch]:
    for (s, lang), counts in parts.items():
        # A weight is within 32 bits: of the same text more, there are several.
        rows = [(p, min(w - at, _MOST)) for p, w in counts.items() for at in range(0, w, _MOST)]
        yield _shard_rows([(s, lang, *v) for v in _packed(pa.array([p for p, _ in rows], pa.string()), np.array([w for _, w in rows], np.int64))])


_MOST = (1 << 32) - 1


# --- the scan ------------------------------------------------------------------


class Scanner:
    """Counts of phrases in stretches of text, by an automaton over phrases with a blank on both sides.

    Each word of a phrase is a short code in the automaton, any other word a line
    break; a code has few characters, so it has few states, and few kinds of
    them, so no state has many ways on.
    """

    def __init__(self, phrases: list[str]) -> None:
        self.phrases, self.counts = phrases, np.zeros(len(phrases), np.int64)
        self.code: dict[str, str] = {}
        self.automaton = ahocorasick.Automaton()
        for k, p in enumerate(phrases):
            self.automaton.add_word(f" {' '.join([self.code.setdefault(w, _code(len(self.code))) for w in p.split(' ')])} ", k)
        if phrases:
            self.automaton.make_automaton()

    def scan(self, texts: list[str], weights: np.ndarray) -> None:
        """All occurrences, overlapping ones too; texts of one weight are scanned as one, with a line break between."""
        order, get = np.argsort(weights, kind="stable"), self.code.get
        for some in np.split(order, np.flatnonzero(np.diff(weights[order])) + 1):
            words = " \n ".join([texts[k] for k in some]).split(" ")
            line = f" {' '.join([get(w, BREAK) for w in words])} "
            hits = Counter(map(itemgetter(1), self.automaton.iter(line)))
            if hits:
                at = np.fromiter(hits.keys(), np.int64, len(hits))
                self.counts[at] += np.fromiter(hits.values(), np.int64, len(hits)) * weights[some[0]]


#: What is no word of a phrase.
BREAK = "\n"


def _code(k: int) -> str:
    """A number as a text of 64 kinds of characters, none of them a blank or a break."""
    more, k = divmod(k, 64)
    return (_code(more - 1) if more else "") + chr(0x30 + k)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """place, lang, blob, size, n in the order of place, twice a group's number and 1 for text: a group's candidates come before its texts."""
    group, lang, phrases, scanner = -1, "", [], None

    def counted() -> Iterator[pa.RecordBatch]:
        if scanner is not None and (hit := np.flatnonzero(scanner.counts)).size:
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(hit), "phrase": [scanner.phrases[k] for k in hit], "n": scanner.counts[hit]})

    for b in batches:
        for place, own, blob, size, n in zip(*(c.to_pylist() for c in b.columns)):
            if group != place // 2:
                yield from counted()
                group, lang, phrases, scanner = place // 2, own, [], None
            texts, weights = _unpacked(blob, size, n)
            if place % 2 == 0:
                phrases += texts
                continue
            if scanner is None:
                scanner = Scanner(phrases)
            scanner.scan(texts, weights.astype(np.int64))
    yield from counted()
    phrases, scanner = [], None
    _give_back()


def phrase_counts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """lang, phrase, f of all phrases of 1 to 4 words with f >= 30; lang, n: words by language."""
    spark: SparkSession = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells = min(CELLS, max(1 << 20, 1 << max(0, int(size) // 48).bit_length()))
    filters = []
    for _ in range(3):
        filters.append(spark.sparkContext.broadcast(_level(docs, cells, filters)))
    buckets = max(BUCKETS, int(size) // BUCKET_BYTES)
    rows = materialize(_pieces_of(docs, filters, buckets), "phrases")
    for f in filters:
        f.destroy()
    found = rows.filter("kind = 0").repartition("bucket").select("lang", "blob", "size", "n").mapInArrow(_distinct, "lang string, phrase string")
    words = found.select("lang", F.explode(F.split("phrase", " ", -1)).alias("phrase")).distinct()
    candidates = materialize(found.unionByName(words), "candidates")
    stretches = rows.filter("kind = 1").select("lang", "blob", "size", "n")
    # One row a language: its automata, the groups that share the text of each, and the first group's number.
    chars = candidates.groupBy("lang").agg(F.ceil(F.count("*") / SHARD_PHRASES).cast("int").alias("shards"))
    sizes = stretches.groupBy("lang").agg(F.sum(F.col("size") - 4 * F.col("n")).alias("size"))
    copies_of_text = F.least(F.col("shards"), F.lit(LONGEST)) / F.col("shards")
    deal = chars.join(sizes, "lang").select("lang", "shards", F.greatest(F.lit(1), F.ceil(F.col("size") * copies_of_text / GROUP_CHARS)).cast("int").alias("salts"))
    before = Window.orderBy("lang").rowsBetween(Window.unboundedPreceding, -1)
    deal = materialize(deal.withColumn("base", F.coalesce(F.sum(F.col("shards") * F.col("salts")).over(before), F.lit(0)).cast("int")), "deal")
    groups, most = deal.agg(F.sum(F.col("shards") * F.col("salts")), F.max("shards")).first()
    first = F.substring_index("phrase", " ", 1)
    shard = F.when(F.col("shards") == 1, 0).otherwise(F.crc32(first.cast("binary")) % F.col("shards")).cast("int")
    own = F.col("base") + F.col("shard") * F.col("salts") + F.col("salt")
    packed = "shard int, lang string, blob binary, size long, n long"
    # Every group of a shard gets its candidates, and a share of its packed texts.
    dealt = candidates.join(deal.select("lang", "shards"), "lang").select("lang", "phrase", shard.alias("shard")).mapInArrow(_dealt, packed)
    copies = dealt.join(deal, "lang").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select(own.alias("group"), F.lit(0).alias("kind"), "lang", "blob", "size", "n")
    shared = stretches.join(deal.select("lang", "shards"), "lang")
    cut = shared.filter("shards = 1").select(F.lit(0).alias("shard"), "lang", "blob", "size", "n")
    if (most or 1) > 1:
        cut = cut.unionByName(shared.filter("shards > 1").select("lang", "blob", "size", "n", "shards").mapInArrow(_cut_by_shard, packed))
    salted = cut.join(deal, "lang").withColumn("salt", F.pmod(F.xxhash64("blob"), F.col("salts")).cast("int")).select(own.alias("group"), F.lit(1).alias("kind"), "lang", "blob", "size", "n")
    # A group is a partition of its own; its candidates come first.
    together = copies.unionByName(salted).repartitionById(int(groups or 1), "group").withColumn("place", F.col("group").cast("long") * 2 + F.col("kind")).sortWithinPartitions("place").select("place", "lang", "blob", "size", "n")
    counts = together.mapInArrow(_scan, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("f")).filter(F.col("f") >= LEAST)
    return materialize(counts, "counts"), rows.filter("kind = 2").groupBy("lang").agg(F.sum("n").alias("n"))


# --- scores ----------------------------------------------------------------------


def collocations(docs: DataFrame, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of each language.

    A null lang is `und`, a null text empty; documents that repeat count each;
    other columns are ignored; a language without a frequent phrase, or an empty
    table, gives no row.  Phrases of one language in a batch, and words in the
    filters, are told apart by 64-bit hashes; counts are of strings.
    """
    counts, words = phrase_counts(docs)
    parts = counts.withColumn("w", F.split("phrase", " ", -1))
    found = parts.filter(F.size("w") > 1).withColumnRenamed("f", "a")
    cuts = found.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.concat_ws(" ", F.slice("w", 1, F.col("k"))).alias("head"), F.concat_ws(" ", F.slice("w", F.col("k") + 1, F.size("w") - F.col("k"))).alias("rest"))
    left = counts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    scored = cuts.join(left, ["lang", "head"]).join(right, ["lang", "rest"])
    score = F.expr("(CAST(a AS DECIMAL(20, 0)) * 2000000BD) div (CAST(l AS DECIMAL(20, 0)) + CAST(r AS DECIMAL(20, 0)))")
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "k", "l", "r", "a")).alias("b"))
    spans = [(k, n) for n in range(2, LONGEST) for k in range(1, LONGEST + 1)]
    inner = F.array(*(F.when((F.size("w") > n) & (F.size("w") >= k + n - 1), F.concat_ws(" ", F.slice("w", k, n))) for k, n in spans))
    longer = found.filter(F.size("w") > 2).select("lang", F.explode(F.array_compact(inner)).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = best.join(longer, ["lang", "phrase"], "left").filter(F.expr(f"longer IS NULL OR 100 * CAST(longer AS DECIMAL(20, 0)) < {INSIDE} * CAST(b.a AS DECIMAL(20, 0))"))
    order = Window.partitionBy("lang").orderBy(F.desc("b.score"), F.desc("b.a"), "phrase")
    first = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return first.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "b.a", "b.l", "b.r", "n", "b.score")


def oracle() -> str:
    """DuckDB SQL of op11: all phrases counted."""
    each = lambda k: f"SELECT lang, {k} AS k, unnest(list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i:i + {k - 1}], ' '))) AS phrase FROM w"
    return rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY 1),
g AS ({" UNION ALL ".join(each(k) for k in range(1, 5))}),
f AS (SELECT lang, k, phrase, count(*) AS f, string_split(phrase, ' ') AS w FROM g GROUP BY 1, 2, 3 HAVING count(*) >= 30),
c AS (SELECT f.lang, f.phrase, f.f AS a, unnest(range(1, f.k)) AS k, f.w FROM f WHERE f.k > 1),
s AS (SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, CAST(CAST(2000000 AS HUGEINT) * c.a // (CAST(x.f AS HUGEINT) + y.f) AS BIGINT) AS score
  FROM c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[:c.k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, array_to_string(w[j:j + m - 1], ' ') AS phrase, max(f) AS longer FROM f, range(1, 4) u(j), range(2, 4) v(m) WHERE m < k AND j + m - 1 <= k GROUP BY 1, 2)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank, b.phrase, b.a, b.l, b.r, n.n, b.score
FROM b JOIN n USING (lang) LEFT JOIN i ON i.lang = b.lang AND i.phrase = b.phrase WHERE i.longer IS NULL OR 100 * CAST(i.longer AS HUGEINT) < 80 * CAST(b.a AS HUGEINT)
QUALIFY rank <= 2000
"""
