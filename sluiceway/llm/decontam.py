"""Benchmark decontamination: BM25 over the test items with block-max WAND.

The items are indexed: for each term its postings (item, score), and for blocks
of BLOCK_ITEMS items the greatest score a term has in the block.  Every document
is a query of its distinct terms.  A document's sums of block maxima are bounds
of its items' scores: blocks below their threshold are skipped, and in the
others WAND walks the postings, jumping to items whose terms' bounds reach the
threshold.  All items that reach it are checked on the document: an item leaks if
its question and its answer both overlap by five-word shingles.

The threshold misses no such item.  Say a half may lack m of its distinct
shingles, and does not lack all: then the document has a shingle at some place p
of the half.  A term of the half that the document lacks has its first place
before p or all its places after p + 4; the shingle that begins with it there, or
else ends with it, is lacking, and no two terms get the same one.  So at most m
terms are lacking, and the score is at least the item's own one less the m
greatest of the half's terms, for both halves.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluiceway.llm.common import U64, Words, flat, free_name, materialize, ranges

SHINGLE, OVERLAP = 5, 0.8
K1, B = 1.2, 0.75
#: Room for rounding in the scores that retrieve an item.
ROUNDING = 0.999
BLOCK_ITEMS = 8
#: Items indexed at once: larger benchmarks are searched part by part, with the statistics of all items.
PART_ITEMS = 512
CHUNK = 1 << 20


class BlockIndex:
    """The inverted index of some test items (id, text).

    found: of each of their terms, in how many of all `number` test items it is;
    mean: the words of all test items on average.
    """

    def __init__(self, items: list[tuple[int, str]], found: dict[int, int], number: int, mean: float) -> None:
        texts = pa.array([t for _, t in items], pa.string())
        data, offsets = flat(texts)
        words = Words(data, offsets, 0, len(items))
        self.ids = [k for k, _ in items]
        lengths = words.count.astype(np.float64)
        counts = [Counter(words.hash[words.first[i] : words.first[i + 1]].tolist()) for i in range(len(items))]
        self.terms = np.array(sorted({t for c in counts for t in c}), U64)
        place = {t: k for k, t in enumerate(self.terms.tolist())}
        self.postings: list[list[tuple[int, float]]] = [[] for _ in place]
        self.halves = [self._parts(words, i) for i in range(len(items))]
        self.need = np.zeros(len(items))
        for i, c in enumerate(counts):
            scores = {}
            for t, n in c.items():
                idf = np.log(1 + (number - found[t] + 0.5) / (found[t] + 0.5))
                score = idf * n * (K1 + 1) / (n + K1 * (1 - B + B * lengths[i] / mean))
                self.postings[place[t]].append((i, score))
                scores[t] = score
            self.need[i] = ROUNDING * (sum(scores.values()) - self._lost(words, i, scores))
        blocks = -(-len(items) // BLOCK_ITEMS)
        self.block_max = np.zeros((len(place) + 1, blocks), np.float32)
        self.rows: list[dict[int, list[tuple[int, float]]]] = [{} for _ in range(blocks)]
        for k, row in enumerate(self.postings):
            for i, score in row:
                self.rows[i // BLOCK_ITEMS].setdefault(k, []).append((i, score))
                # Rounded up: a bound must not fall below the scores it stands for.
                self.block_max[k, i // BLOCK_ITEMS] = max(self.block_max[k, i // BLOCK_ITEMS], np.nextafter(np.float32(score), np.float32(np.inf)))
        full = lengths > 0
        self.block_need = np.array([min((self.need[i] for i in range(b * BLOCK_ITEMS, min(len(items), (b + 1) * BLOCK_ITEMS)) if full[i]), default=np.inf) for b in range(blocks)])

    @staticmethod
    def _parts(words: Words, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Shingles of an item's question (its first half) and answer (the rest)."""
        h = words.hash[words.first[i] : words.first[i + 1]]
        cut = (len(h) + 1) // 2
        return _shingles(h[:cut]), _shingles(h[cut:])

    def _lost(self, words: Words, i: int, scores: dict[int, float]) -> float:
        """The most that an item's score can lack where both halves overlap enough."""
        h = words.hash[words.first[i] : words.first[i + 1]].tolist()
        cut = (len(h) + 1) // 2
        out = 0.0
        for half, shingles in zip((h[:cut], h[cut:]), self.halves[i]):
            lacking = int(len(shingles) * (1 - OVERLAP) + 1e-6)
            out += sum(sorted((scores[t] for t in set(half)), reverse=True)[:lacking])
        return out

    def search(self, terms: np.ndarray, block: int) -> list[int]:
        """Items of a block that a document's distinct terms score up to their threshold: WAND over the block."""
        rows, bounds = self.rows[block], self.block_max[terms, block]
        lists = [[rows[k], 0, float(x)] for k, x in zip(terms[bounds > 0].tolist(), bounds[bounds > 0])]
        out, least = [], self.block_need[block]
        while lists:
            lists.sort(key=lambda x: x[0][x[1]][0])
            bound, pivot = 0.0, None
            for x in lists:
                bound += x[2]
                if bound >= least:
                    pivot = x[0][x[1]][0]
                    break
            if pivot is None:
                return out
            if lists[0][0][lists[0][1]][0] == pivot:
                score = 0.0
                for x in lists:
                    if x[0][x[1]][0] != pivot:
                        break
                    score += x[0][x[1]][1]
                    x[1] += 1
                if score >= self.need[pivot]:
                    out.append(pivot)
            else:
                for x in lists:
                    while x[1] < len(x[0]) and x[0][x[1]][0] < pivot:
                        x[1] += 1
            lists = [x for x in lists if x[1] < len(x[0])]
        return out


def _shingles(h: np.ndarray) -> np.ndarray:
    """Hashes of the distinct five-word shingles of a list of word hashes; fewer words are one shingle."""
    if not len(h):
        return np.zeros(0, U64)
    n = min(SHINGLE, len(h))
    g = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        g *= U64(0x9FB21C651E98DF25)
        g ^= g >> U64(29)
        g += h[k : len(h) - n + 1 + k]
    return np.unique(g)


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By part of the benchmark: each term with the items that hold it, and a row without term for all items and their words."""
    for batch in batches:
        data, offsets = flat(batch.column("text"))
        words = Words(data, offsets, 0, batch.num_rows)
        part = np.array(batch.column("part").to_pylist(), np.int64)
        pairs = np.unique(np.stack([words.doc, words.hash.view(np.int64)]), axis=1)
        owner = part[pairs[0]]
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(owner, part), pa.int32()), pa.array(np.append(pairs[1], np.zeros(n, np.int64)), mask=np.append(np.zeros(len(owner), bool), np.ones(n, bool))),
             pa.array(np.ones(len(owner) + n, np.int64)), pa.array(np.append(np.zeros(len(owner), np.int64), words.count))],
            names=["part", "term", "n", "words"],
        )


def _search(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    index: BlockIndex = shared.value
    for batch in batches:
        data, offsets = flat(batch.column("text"))
        ids = batch.column("doc_id").to_pylist()
        out: list[tuple] = []
        for i, j in ranges(offsets, CHUNK):
            words = Words(data, offsets, i, j)
            if not len(words.hash) or not len(index.terms):
                continue
            term = np.searchsorted(index.terms, words.hash)
            term[term == len(index.terms)] = 0
            term = np.where(index.terms[term] == words.hash, term, len(index.terms))
            # A term counts once in a document, as it does in the score.
            size = len(index.terms)
            key = np.unique(words.doc[term < size] * size + term[term < size])
            owner, term = key // size, key % size
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])[: len(owner)])
            stops = np.append(starts[1:], len(owner))
            bound = np.add.reduceat(index.block_max[term], starts, axis=0) if len(starts) else np.zeros((0, len(index.block_need)))
            candidates: dict[int, list[int]] = {}
            for p, b in np.argwhere(bound >= index.block_need):
                found = index.search(term[starts[p] : stops[p]], int(b))
                candidates.setdefault(int(owner[starts[p]]), []).extend(found)
            for d, items in candidates.items():
                if not items:
                    continue
                h = words.hash[words.first[d] : words.first[d + 1]]
                whole = _shingles(h)
                for x in sorted(items):
                    question, answer = index.halves[x]
                    q, a = _part_overlap(question, h, whole), _part_overlap(answer, h, whole)
                    if q >= OVERLAP and a >= OVERLAP:
                        out.append((ids[i + d], index.ids[x], q, a))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.float64()))], names=["doc_id", "item_id", "question", "answer"])


def _part_overlap(part: np.ndarray, words: np.ndarray, whole: np.ndarray) -> float:
    """Share of an item part's shingles that the document has; both are sorted."""
    if not len(part):
        return 1.0
    at = np.searchsorted(whole, part)
    hit = whole[np.minimum(at, len(whole) - 1)] == part
    if not hit.any() and len(part) == 1:
        # A part of fewer than five words is one short shingle.
        for n in range(1, SHINGLE):
            g = words[: max(0, len(words) - n + 1)].copy()
            for k in range(1, n):
                g *= U64(0x9FB21C651E98DF25)
                g ^= g >> U64(29)
                g += words[k : len(words) - n + 1 + k]
            if part[0] in g:
                return 1.0
    return float(hit.mean())


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, question, answer: each test item a document holds, with the overlaps of its halves.

    An item's question is the first half of its words, its answer the other half;
    both must have 80 % of their distinct five-word shingles in the document.
    Words are runs of bytes other than ASCII white space, A-Z as a-z.  Items and
    texts that are null or without words leak nothing; items without id are left
    out; an item_id with several texts counts as each of them.  Rows that repeat
    a doc_id are searched each, and equal results come once.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.col("text").isNotNull())
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter(F.col("item_id").isNotNull() & (F.length(F.trim("text")) > 0)).distinct()
    parts = max(1, -(-items.count() // PART_ITEMS))
    numbered = materialize(items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)).cast("int")), "items")
    terms = materialize(numbered.mapInArrow(_item_terms, "part int, term long, n long, words long"), "terms")
    number, words = terms.filter("term IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    holders = terms.filter("term IS NOT NULL").groupBy("term").agg(F.sum("n").alias("n"))
    found = None
    for part in range(parts):
        # About PART_ITEMS items and their terms are on the driver and broadcast at a time.
        some = sorted((r["item_id"], r["text"]) for r in numbered.filter(F.col("part") == part).collect())
        if not some:
            continue
        own = terms.filter((F.col("part") == part) & F.col("term").isNotNull()).select("term").distinct()
        known = {r["term"] & 2**64 - 1: r["n"] for r in holders.join(own, "term").collect()}
        shared = spark.sparkContext.broadcast(BlockIndex(some, known, number, max(words / max(number, 1), 1.0)))
        hits = rows.mapInArrow(lambda it, shared=shared: _search(it, shared), "doc_id long, item_id long, question double, answer double")
        if parts > 1:
            hits = materialize(hits, "hits")
            shared.unpersist()
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return spark.createDataFrame([], "doc_id long, item_id long, question double, answer double")
    return found.groupBy("doc_id", "item_id").agg(F.max("question").alias("question"), F.max("answer").alias("answer"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that hold a test item; all columns are kept.

    Null and empty texts hold none; rows without doc_id stay, as nothing names
    them; of rows that repeat a doc_id all go if one holds an item.
    """
    name = free_name(docs, "_leak")
    leaks = find_leaks(docs, benchmark).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(leaks, F.col("doc_id") == F.col(name), "left_anti")
