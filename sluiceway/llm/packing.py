"""Best-fit packing of tokenized documents into sequences, by linear grouping.

What a packing needs to know of a corpus is how many pieces have each length, a
table of at most `capacity` rows.  From it the driver makes a plan: large lengths
are sorted and cut into groups of equal cardinality, each rounded up to its
longest; configurations of these few sizes are optimised by column generation;
actual lengths take the places of rounded ones; the rest is placed by best fit,
longest first, many equal bins at a time.  The plan has a few thousand rows at
any size of the corpus.  Each piece then finds its place from its rank among the
pieces of its length, which is a prefix sum over tasks.
"""

from __future__ import annotations

import bisect
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluiceway.llm.common import flat, materialize, ranges

CAPACITY = 4096
#: The id after each document.
END = 1
#: Lengths over this share of a sequence are grouped and rounded, and into how many groups; of the plans the one with fewest sequences counts.
SCHEMES = ((1 / 2, 128), (1 / 3, 128), (1 / 4, 128), (1 / 8, 64))

_PIECES = "doc_id long, piece int, start long, length long, ids array<int>, ids_crc32 long, part int, nth long"


# --- tokens ------------------------------------------------------------------


def gathered(values: np.ndarray, offsets: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists `order` of a ragged array, one after another, and their offsets."""
    sizes = np.diff(offsets)[order]
    bounds = np.zeros(len(order) + 1, np.int64)
    np.cumsum(sizes, out=bounds[1:])
    at = np.arange(bounds[-1]) + np.repeat(offsets[:-1][order] - bounds[:-1], sizes)
    return values[at], bounds


class Encoder:
    """Token ids of texts, each distinct word encoded once.

    The tokenizer drops white space and never joins over it, so a text's ids are
    those of its words (runs without ASCII white space), one after another.  It
    lowers letters, and breaks between a letter and the marks .,;:!? behind it; so
    words are told apart without case and such endings, but for those with `<|`,
    where its own special tokens may stand.
    """

    def __init__(self, definition: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[k for t, k in vocabulary.items() if t.endswith("</w>")]] = True

    def each(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, and offsets."""
        plain = pc.match_substring_regex(words, "^[a-z]+$").to_numpy(zero_copy_only=False)
        sizes, parts, order = np.zeros(len(words), np.int64), [], []
        letters = np.flatnonzero(plain)
        for k in range(0, len(letters), 1024):
            some = letters[k : k + 1024]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words.take(pa.array(some)).to_pylist())], add_special_tokens=False)[0].ids, np.int32)
            stops = np.flatnonzero(self.ends[ids]) + 1  # a word of letters has one end
            sizes[some] = np.diff(stops, prepend=0)
            parts.append(ids)
            order.append(some)
        others = np.flatnonzero(~plain)
        for k in range(0, len(others), 1024):
            some = others[k : k + 1024]
            for w, e in zip(some, self.tokenizer.encode_batch_fast(words.take(pa.array(some)).to_pylist(), add_special_tokens=False)):
                sizes[w] = len(e.ids)
                parts.append(np.array(e.ids, np.int32))
            order.append(some)
        whole = np.concatenate([np.zeros(0, np.int32), *parts])
        first = np.concatenate([np.zeros(0, np.int64), *order])
        place = np.empty(len(words), np.int64)
        place[first] = np.arange(len(first))
        bounds = np.zeros(len(words) + 1, np.int64)
        np.cumsum(sizes[first], out=bounds[1:])
        return gathered(whole, bounds, place)

    def batch(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Runs of texts: the first one's number, ids of all with END after each, and offsets."""
        lists = pc.ascii_split_whitespace(texts)
        words = lists.flatten().dictionary_encode()
        found, index = words.dictionary, words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        marked = pc.match_substring_regex(found, "^[A-Za-z]+[.,;:!?]+$")
        core = pc.if_else(marked, pc.utf8_rtrim(found, ".,;:!?"), found)
        tail = pc.if_else(marked, pc.utf8_ltrim(found, "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"), "")
        core = pc.if_else(pc.match_substring(core, "<|"), core, pc.ascii_lower(core))
        both = pa.concat_arrays([core, tail]).dictionary_encode()
        ids, offsets = self.each(both.dictionary)
        halves = both.indices.to_numpy(zero_copy_only=False).astype(np.int64).reshape(2, -1)
        ids, pairs = gathered(ids, offsets, halves.T.ravel())
        ids, offsets = np.append(ids, np.int32(END)), np.append(pairs[::2], pairs[-1] + 1)  # the last list is END
        ends = lists.offsets.to_numpy().astype(np.int64)
        ends -= ends[0]
        for i, j in ranges(ends, 1 << 20):
            own = np.insert(index[ends[i] : ends[j]], ends[i + 1 : j + 1] - ends[i], len(offsets) - 2)
            out, at = gathered(ids, offsets, own)
            yield i, out, at[ends[i : j + 1] - ends[i] + np.arange(j - i + 1)]


_encoders: dict[int, Encoder] = {}


def _encoder(definition: Broadcast) -> Encoder:
    """This worker's own, made once."""
    key = hash(definition.value)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(definition.value)
    return _encoders[key]


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids, ids_crc32, part, nth: each document's ids, and END, cut every `capacity` ids.

    part is the task, nth the piece's number among those of its length there.  A
    null text is empty: its ids are END alone.
    """
    with open(path, encoding="utf-8") as f:
        definition = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seen = _encoder(definition), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in batches:
            texts = pc.fill_null(b.column(1), "")
            _, bytes_ = flat(texts)
            for i, j in ranges(bytes_, 32 << 20):
                for k, ids, at in encoder.batch(texts.slice(i, j - i)):
                    lengths = np.diff(at)
                    pieces = (lengths - 1) // capacity + 1
                    first = np.repeat(np.cumsum(pieces) - pieces, pieces)
                    piece = np.arange(len(first)) - first
                    start = piece * capacity
                    doc = np.repeat(np.arange(len(lengths)), pieces)
                    length = np.minimum(lengths[doc] - start, capacity)
                    begin = at[:-1][doc] + start
                    data = memoryview(np.ascontiguousarray(ids, "<i4")).cast("B")
                    crc = np.array([zlib.crc32(data[4 * x : 4 * (x + n)]) for x, n in zip(begin.tolist(), length.tolist())], np.int64)
                    order = np.argsort(length, kind="stable")
                    ordered = length[order]
                    fresh = np.flatnonzero(np.diff(ordered, prepend=-1))
                    nth = np.empty(len(order), np.int64)
                    nth[order] = np.arange(len(order)) - np.repeat(fresh, np.diff(np.append(fresh, len(order)))) + seen[ordered]
                    seen += np.bincount(length, minlength=capacity + 1)
                    lists = pa.ListArray.from_arrays(pa.array(np.append(begin, len(ids)).astype(np.int32)), pa.array(ids))
                    owner = b.column(0).take(pa.array(i + k + doc))
                    yield pa.RecordBatch.from_arrays([owner.cast(pa.int64()), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), lists, pa.array(crc), pa.array(np.full(len(doc), part, np.int32)), pa.array(nth)], ["doc_id", "piece", "start", "length", "ids", "ids_crc32", "part", "nth"])

    return docs.select("doc_id", "text").mapInArrow(run, _PIECES)


# --- the plan ----------------------------------------------------------------


def grouped(counts: np.ndarray, least: int, groups: int) -> list[list[list[int]]]:
    """Lengths over `least` by groups of equal cardinality, longest first: [length, how many], the first of a group its size."""
    lengths = [int(x) for x in np.flatnonzero(counts) if x > least][::-1]
    total = sum(int(counts[x]) for x in lengths)
    if len(lengths) <= groups:
        return [[[x, int(counts[x])]] for x in lengths]
    each, out, room = -(-total // groups), [], 0
    for x in lengths:
        left = int(counts[x])
        while left:
            if not room:
                out.append([])
                room = each
            take = min(left, room)
            out[-1].append([x, take])
            left, room = left - take, room - take
    return out


def _best_configuration(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The multiset of sizes, within the capacity, that is worth most."""
    best, picks = np.zeros(capacity + 1), []
    for _ in range(capacity // int(sizes.min())):
        more, pick = best.copy(), np.full(capacity + 1, -1)
        for g, (s, w) in enumerate(zip(sizes, worth)):
            value = best[: capacity + 1 - s] + w
            better = value > more[s:] + 1e-12
            more[s:][better], pick[s:][better] = value[better], g
        if (pick < 0).all():
            break
        best = more
        picks.append(pick)
    config, room = np.zeros(len(sizes)), capacity
    for pick in reversed(picks):
        if pick[room] >= 0:
            config[pick[room]] += 1
            room -= int(sizes[pick[room]])
    return float(worth @ config), config


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, float]]:
    """Configurations and how often to use each, so that all demand is met with the fewest bins: a linear programme by column generation."""
    n = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    share = demand / demand.sum()
    for _ in range(200 * n):
        inverse = np.linalg.inv(basis)
        use, worth = inverse @ share, inverse.sum(axis=0)
        value, config = _best_configuration(sizes, np.maximum(worth, 0), capacity)
        if value <= 1 + 1e-9:
            break
        step = inverse @ config
        up = step > 1e-12
        ratio = np.where(up, np.maximum(use, 0) / np.where(up, step, 1), np.inf)
        basis[:, int(np.argmin(ratio))] = config
    use = np.linalg.inv(basis) @ share * demand.sum()
    return [(basis[:, k], max(0.0, float(use[k]))) for k in range(n)]


class Plan:
    """Bins as runs of equal ones, filled many at a time; `rows`: length, first (rank), n, sequence, per, offset.

    Pieces of a length with ranks first..first+n-1 go `per` to a sequence, from `sequence` on, beginning at `offset`.
    """

    def __init__(self, counts: np.ndarray, capacity: int) -> None:
        self.capacity, self.left, self.rank, self.bins = capacity, counts.astype(object).copy(), [0] * (capacity + 1), 0
        self.rows: list[tuple[int, int, int, int, int, int]] = []
        self.open: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by free room: first sequence, how many
        self.rooms: list[int] = []  # with open bins, ascending

    def take(self, length: int, n: int, sequence: int, per: int, offset: int) -> None:
        self.rows.append((length, self.rank[length], n, sequence, per, offset))
        self.rank[length] += n
        self.left[length] -= n

    def put(self, room: int, sequence: int, n: int) -> None:
        if n and room:
            if not self.open[room]:
                bisect.insort(self.rooms, room)
            self.open[room].append((sequence, n))

    def fill(self, groups: list[list[list[int]]], config: np.ndarray, times: int) -> None:
        """`times` bins of a configuration, with the longest pieces that are left of each group."""
        runs = [(self.bins, times, 0)]
        self.bins += times
        for g in (g for g, k in enumerate(config) for _ in range(int(k))):
            stock, after = groups[g], []
            for sequence, n, used in runs:
                while n:
                    length, there = stock[0]
                    m = min(n, there)
                    self.take(length, m, sequence, 1, used)
                    after.append((sequence, m, used + length))
                    sequence, n = sequence + m, n - m
                    stock[0][1] -= m
                    if not stock[0][1]:
                        stock.pop(0)
            runs = after
        for sequence, n, used in runs:
            self.put(self.capacity - used, sequence, n)

    def best_fit(self) -> None:
        """All pieces that are left, longest first, each into the fullest bin that has room."""
        for length in range(self.capacity, 0, -1):
            while n := int(self.left[length]):
                at = bisect.bisect_left(self.rooms, length)
                if at == len(self.rooms):
                    per = self.capacity // length
                    self.put(self.capacity, self.bins, -(-n // per))
                    self.bins += -(-n // per)
                    continue
                room = self.rooms[at]
                sequence, there = self.open[room].pop()
                if not self.open[room]:
                    self.rooms.pop(at)
                # A bin that took one is the fullest with room, until it is full.
                per = room // length
                full = min(there, n // per)
                if full:
                    self.take(length, full * per, sequence, per, self.capacity - room)
                    self.put(room - per * length, sequence, full)
                else:
                    self.take(length, n, sequence, per, self.capacity - room)
                    self.put(room - n * length, sequence, 1)
                    full = 1
                self.put(room, sequence + full, there - full)


def grouped_plan(counts: np.ndarray, capacity: int, large: float, groups: int) -> Plan:
    """The plan for counts[length] pieces of each length, those over `large` of the capacity by configurations of `groups` sizes."""
    plan = Plan(counts, capacity)
    plan_groups = grouped(counts, int(capacity * large), groups)
    if plan_groups:
        sizes = np.array([g[0][0] for g in plan_groups])
        demand = np.array([float(sum(n for _, n in g)) for g in plan_groups])
        for config, use in configurations(sizes, demand, capacity):
            whole = [sum(n for _, n in plan_groups[g]) // int(k) for g, k in enumerate(config) if k]
            if times := min(int(use + 1e-6), *whole):
                plan.fill(plan_groups, config, times)
    plan.best_fit()
    return plan


def packing_plan(counts: np.ndarray, capacity: int = CAPACITY) -> Plan:
    """Of the plans for SCHEMES the one with fewest sequences, at once if no packing can have fewer."""
    least, best = -(-sum(int(n) * x for x, n in enumerate(counts)) // capacity), None
    for large, groups in SCHEMES:
        plan = grouped_plan(counts, capacity, large, groups)
        best = plan if best is None or plan.bins < best.bins else best
        if best.bins == least:
            break
    return best


# --- packing -----------------------------------------------------------------


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids, ids_crc32, sequence_id, offset: each piece of each document and its place.

    Only documents longer than the capacity are cut.  A null or empty text is END
    alone; rows that repeat a doc_id or a text are documents of their own, null
    ids too; other columns are ignored; an empty table gives no row.  ids may be
    left out by the caller; they then are not read again.
    """
    spark = docs.sparkSession
    pieces = materialize(token_pieces(docs, path, capacity), "pieces")
    by_part = materialize(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
    counts = np.zeros(capacity + 1, np.int64)
    for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect():  # one row a length
        counts[r.length] = r.n
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = by_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rows = [tuple(map(int, r)) for r in packing_plan(counts, capacity).rows]
    plan = spark.createDataFrame(rows, "at long, first long, n long, sequence long, per long, begin long")
    ranked = pieces.join(base, ["part", "length"]).withColumn("rank", F.col("base") + F.col("nth"))
    # The plan's rows depend on the capacity, not on the corpus.
    placed = ranked.join(F.broadcast(plan), (F.col("length") == F.col("at")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("n")))
    nth = F.col("rank") - F.col("first")
    sequence = F.col("sequence") + F.expr("(rank - first) div per")
    return placed.select("doc_id", "piece", "start", "length", "ids", "ids_crc32", sequence.alias("sequence_id"), (F.col("begin") + nth % F.col("per") * F.col("length")).alias("offset"))
