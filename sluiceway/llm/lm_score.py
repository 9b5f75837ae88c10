"""Document probabilities from a subword lattice and corpus word counts.

A word that the corpus does not settle has the marginal probability of its
lattice: all ways to spell it with pieces of an existing vocabulary, each way
the product of its pieces' weights, added up by a forward recursion in log
space.  The vocabulary's scores are ranks, read as probabilities by Zipf's law;
from these the weights are fitted to all distinct learned words, each once, by
expectation-maximisation (the expected use of each piece comes from a forward
and a backward recursion; the pieces stay as they are).  Pieces that begin a
word and pieces that go on are told apart, so the words' probabilities add up to
1.  Corpus counts are discounted absolutely, by as much as the numbers of words
that occur once and twice imply, and the mass gained goes to the lattice.  A
document is a Polya urn over these word probabilities: words it has already used
are likelier to come again.

Counts are gathered from all learning documents.  Words with at least N / HEAVY
of the N tokens, so at most HEAVY of them, are broadcast; the rest are asked for
in packed requests, dealt by word to the counts and by document block back.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluiceway.llm.common import U64, Words, crc_mod, flat, ints, materialize, mix, ranges

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
HEAVY = 1 << 19
URN, ZIPF_SHIFT = 300.0, 2.7
#: Rounds of fitting the pieces' weights, and the counts that their own scores stand for.
ROUNDS, PRIOR = 4, 1000.0
#: Probability of a character outside the vocabulary, shared by all code points.
UNKNOWN = 1e-4 / 1_114_112
CHUNK, PART_TOKENS, WORDS = 4 << 20, 1_500_000, 20_000
MARK = "▁"
END = U64(0xE7037ED1A0B428DB)


def pieces(path: str) -> list[tuple[str, float]]:
    """The vocabulary's pieces with their log-probabilities."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = [(model.id_to_piece(k), model.get_score(k)) for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k))]
    found = [(p, s) for p, s in found if p.rfind(MARK) <= 0]
    order = np.argsort([-s for _, s in found], kind="stable")
    rank = np.empty(len(found))
    rank[order] = np.arange(len(found))
    p = 1 / (rank + ZIPF_SHIFT)
    return [(found[k][0], float(x)) for k, x in enumerate(np.log(p / p.sum()))]


@lru_cache(maxsize=2)
def _trie(names: tuple[str, ...]) -> ahocorasick.Automaton:
    trie = ahocorasick.Automaton()
    for k, p in enumerate(names):
        trie.add_word(p, (len(p), k))
    trie.make_automaton()
    return trie


def _sweep(to: np.ndarray, start: np.ndarray, score: np.ndarray, level: np.ndarray, nodes: int, seeds: np.ndarray) -> np.ndarray:
    """Log-probability of each node: the sum over all paths of arcs start -> to from the seeds, level by level."""
    out = np.full(nodes, -np.inf)
    out[seeds] = 0.0
    order = np.lexsort((to, level))
    to, start, score, level = to[order], start[order], score[order], level[order]
    cuts = np.searchsorted(level, np.arange(1, int(level.max(initial=0)) + 2))
    for a, b in zip(cuts[:-1], cuts[1:]):
        if a == b:
            continue
        value = out[start[a:b]] + score[a:b]
        heads = np.flatnonzero(np.append(True, to[a + 1 : b] != to[a : b - 1]))
        top = np.maximum.reduceat(value, heads)
        safe = np.where(np.isfinite(top), top, 0)
        sums = np.add.reduceat(np.exp(value - np.repeat(safe, np.diff(np.append(heads, b - a)))), heads)
        out[to[a:b][heads]] = np.log(np.maximum(sums, 1e-300)) + safe
    return out


class Lattice:
    """Marginal log-probabilities of words."""

    def __init__(self, vocabulary: list[tuple[str, float]]) -> None:
        self.begins = np.array([p[0] == MARK for p, _ in vocabulary])
        scores = np.array([s for _, s in vocabulary])
        self.stop = float(np.logaddexp.reduce(scores[self.begins]))  # the next piece begins a word
        # The first piece is one of those that begin a word.
        self.scores = np.where(self.begins, scores - self.stop, scores)
        self.trie = _trie(tuple(p for p, _ in vocabulary))

    def _arcs(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """Each word's first and last node; each arc's word, first and last node, levels from both ends, piece (-1: none) and score."""
        n = np.array([len(w) + 1 for w in words], np.int64)
        begin = np.cumsum(n) - n
        joined = MARK + MARK.join(w.replace(MARK, "\ufffd") for w in words)
        ends, sizes, found = [], [], []
        for end, (size, k) in self.trie.iter(joined):
            ends.append(end), sizes.append(size), found.append(k)
        end, size, piece = np.array(ends, np.int64) + 1, np.array(sizes, np.int64), np.array(found, np.int64)
        # Beside the matches, one arc for each single character that no piece spells.
        lone = np.ones(int(n.sum()), bool)
        lone[end[size == 1] - 1] = False
        alone = np.flatnonzero(lone) + 1
        end, size = np.append(end, alone), np.append(size, np.ones(len(alone), np.int64))
        piece = np.append(piece, np.full(len(alone), -1))
        word = np.searchsorted(begin, end - 1, "right") - 1
        score = np.where(piece < 0, np.log(UNKNOWN), self.scores[piece])
        first = begin + np.arange(len(words))
        inside = end - begin[word]
        return first, first + n, word, end - size + word, end + word, inside, n[word] - inside + size, piece, score

    def score(self, words: list[str]) -> np.ndarray:
        """The log-probability of each word (without mark): a forward recursion over all words at once."""
        first, last, _, start, end, level, _, _, score = self._arcs(words)
        return _sweep(end, start, score, level, int(last[-1]) + 1, first)[last] + self.stop

    def expected(self, words: list[str]) -> np.ndarray:
        """How often each piece is expected in the words' spellings, by a forward and a backward recursion."""
        first, last, word, start, end, level, back, piece, score = self._arcs(words)
        nodes = int(last[-1]) + 1
        alpha = _sweep(end, start, score, level, nodes, first)
        beta = _sweep(start, end, score, back, nodes, last)
        share = np.exp(alpha[start] + score + beta[end] - alpha[last][word])
        return np.bincount(piece[piece >= 0], weights=share[piece >= 0], minlength=len(self.scores))


def refitted(vocabulary: list[tuple[str, float]], expected: np.ndarray, words: int) -> list[tuple[str, float]]:
    """The vocabulary with weights fitted to expected counts from so many words.

    The vocabulary's own scores stand for PRIOR counts, so pieces that the corpus
    does not use keep a share.
    """
    begins = np.array([p[0] == MARK for p, _ in vocabulary])
    old = np.exp([s for _, s in vocabulary])
    stop = old[begins].sum()
    rest = expected[~begins].sum() + words + PRIOR
    new = np.where(begins, expected + PRIOR * old / stop, expected + PRIOR * old)
    new[begins] *= (words + PRIOR * stop) / rest / new[begins].sum()
    new[~begins] /= rest
    return [(p, float(x)) for (p, _), x in zip(vocabulary, np.log(new))]


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words of chunks of documents, with their counts in learning documents."""
    for batch in batches:
        data, offsets = flat(batch.column("text"))
        learn = ~np.array(batch.column("held_out").to_pylist(), bool)
        for i, j in ranges(offsets, CHUNK):
            words = Words(data, offsets, i, j)
            h, at, back = np.unique(words.hash, return_index=True, return_inverse=True)
            count = np.bincount(back, weights=learn[i:j][words.doc], minlength=len(h)).astype(np.int64)
            texts = [words.text(k) for k in at.tolist()]
            ends = int(learn[i:j].sum())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(h, END).view(np.int64)), pa.array([*texts, None], pa.binary()), pa.array(np.append(count, ends))], names=["h", "word", "c"]
            )


def _texts(batch: pa.RecordBatch) -> tuple[list[int], list[str]]:
    """The rows of a batch that hold words, and the words."""
    real = [(k, w.decode("utf-8", "replace")) for k, w in enumerate(batch.column("word").to_pylist()) if w is not None]
    return [k for k, _ in real], [w for _, w in real]


def _expected(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    """Expected counts of the pieces in the distinct words of a partition."""
    lattice = Lattice(model.value)
    total = np.zeros(len(model.value))
    for batch in batches:
        words = _texts(batch)[1]
        for a in range(0, len(words), WORDS):
            total += lattice.expected(words[a : a + WORDS])
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["piece", "e"])


def _spelled(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    """The lattice's log-probability of each word."""
    lattice = Lattice(model.value)
    for batch in batches:
        real, words = _texts(batch)
        out = np.zeros(batch.num_rows)
        for a in range(0, len(real), WORDS):
            out[real[a : a + WORDS]] = lattice.score(words[a : a + WORDS])
        yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("c"), pa.array(out)], names=["h", "c", "spell"])


def fitted(words: DataFrame, vocabulary: list[tuple[str, float]], rounds: int = ROUNDS) -> list[tuple[str, float]]:
    """The vocabulary with its weights fitted to all distinct learned words (h, word, c).

    Each round sends the weights out and gets one sum for each piece back, so
    the driver holds no more than the vocabulary.
    """
    context = words.sparkSession.sparkContext
    learned = words.filter((F.col("c") > 0) & F.col("word").isNotNull()).select("word")
    count = learned.count()
    now = vocabulary
    for _ in range(rounds if count else 0):
        model = context.broadcast(now)
        sums = learned.mapInArrow(lambda it, m=model: _expected(it, m), "piece long, e double").groupBy("piece").agg(F.sum("e").alias("e")).toPandas()
        model.destroy()
        expected = np.zeros(len(vocabulary))
        expected[sums["piece"].to_numpy()] = sums["e"].to_numpy()
        now = refitted(vocabulary, expected, count)
    return now


def discount(once: int, twice: int) -> float:
    """The share of a count that goes to the lattice, from how many words occur once and twice."""
    return (once + 1) / (once + 2 * twice + 2)


def _chance(c: np.ndarray, spell: np.ndarray, n: int, v: int, less: float) -> np.ndarray:
    """Natural logarithm of a word's probability in the corpus."""
    own = np.maximum(c - less, 0) / max(n, 1)
    rest = less * v / n if n else 1.0
    return np.logaddexp(np.log(np.maximum(own, 1e-320)), np.log(rest) + spell)


def _urn(p: np.ndarray, times: np.ndarray) -> np.ndarray:
    """log of the rising factorial of URN * exp(p) over `times` draws."""
    x = URN * np.exp(p)
    out = p + np.log(URN)
    for k in range(1, min(int(times.max(initial=1)), 8)):
        out += np.where(times > k, np.log(x + k), 0)
    many = np.flatnonzero(times > 8)
    if len(many):
        out[many] += _log_gamma(x[many] + times[many]) - _log_gamma(x[many] + 8)
    return out


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, for x of 8 and more."""
    y = 1 / (x * x)
    return (x - 0.5) * np.log(x) - x + 0.9189385332046727 + (1 / 12 - y * (1 / 360 - y * (1 / 1260 - y / 1680))) / x


_PACKED = "part long, block long, packed binary"


def _ask(batches: Iterator[pa.RecordBatch], model, parts: int) -> Iterator[pa.RecordBatch]:
    """Per block of documents: what the heavy words give, and requests for the others."""
    heavy_h, heavy_c, heavy_p, n, v = model.value[:5]
    block = TaskContext.get().partitionId() << 32
    for batch in batches:
        data, offsets = flat(batch.column("text"))
        ids, valid = ints(batch.column("doc_id")), ~np.array(batch.column("doc_id").is_null().to_pylist(), bool)
        for i, j in ranges(offsets, CHUNK):
            words = Words(data, offsets, i, j)
            m = j - i
            docs = np.concatenate([words.doc, np.arange(m)])
            h = np.concatenate([words.hash, np.full(m, END)])
            order = np.lexsort((h, docs))
            h, docs = h[order], docs[order]
            new = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (docs[1:] != docs[:-1])))
            times = np.diff(np.append(new, len(h)))
            h, docs = h[new], docs[new]
            at = np.minimum(np.searchsorted(heavy_h, h), max(len(heavy_h) - 1, 0))
            hit = heavy_h[at] == h if len(heavy_h) else np.zeros(len(h), bool)
            k, t, d = at[hit], times[hit], docs[hit]
            total = words.count + 1
            sums = [
                total.astype(np.float64), np.bincount(d, weights=t, minlength=m),
                np.bincount(d, weights=t * np.log10((heavy_c[k] + 1) / (n + v + 1)), minlength=m),
                np.bincount(d, weights=_urn(heavy_p[k], t), minlength=m) - np.array([_log_gamma(np.array([URN + x]))[0] for x in total]) + _log_gamma(np.array([URN]))[0],
            ]
            head = struct.pack("<qq", 0, m) + ids[i:j].tobytes() + valid[i:j].astype(np.int64).tobytes() + b"".join(s.tobytes() for s in sums)
            rows = [(int(block % parts), block, head)]
            h, t, d = h[~hit], times[~hit], docs[~hit]
            part = (h >> U64(24)) % U64(parts)
            order = np.argsort(part, kind="stable")
            h, t, d, part = h[order], t[order], d[order], part[order]
            cuts = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
            for a, b in zip(cuts.tolist(), np.append(cuts[1:], len(part)).tolist()):
                body = struct.pack("<qq", 1, b - a) + h[a:b].tobytes() + t[a:b].astype(np.int32).tobytes() + d[a:b].astype(np.int32).tobytes()
                rows.append((int(part[a]), block, body))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["part", "block", "packed"])
            block += 1


def _pack_words(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """The word table, packed by part; block -1 comes first."""
    for batch in batches:
        h, c, s = ints(batch.column("h")).view(U64), ints(batch.column("c")), batch.column("spell").to_numpy()
        part = (h >> U64(24)) % U64(parts)
        order = np.argsort(part, kind="stable")
        h, c, s, part = h[order], c[order], s[order], part[order]
        cuts = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
        rows = [(int(part[a]), -1, struct.pack("<qq", 2, b - a) + h[a:b].tobytes() + c[a:b].tobytes() + s[a:b].tobytes()) for a, b in zip(cuts.tolist(), np.append(cuts[1:], len(part)).tolist())]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["part", "block", "packed"])


def _answer(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    """Answers to requests, added up by document, to the blocks they came from.

    Rows come sorted by part and block, so a part's words come before its requests.
    """
    n, v, less = model.value[3:]
    part, held = None, []
    for batch in batches:
        rows: list[tuple[int, bytes]] = []
        for p, block, raw in zip(batch.column("part").to_pylist(), batch.column("block").to_pylist(), batch.column("packed")):
            raw = raw.as_py()
            kind, m = struct.unpack_from("<qq", raw)
            if kind == 0:
                rows.append((block, raw))
                continue
            if p != part:
                part, held, table = p, [], None
            if kind == 2:
                held.append((np.frombuffer(raw, U64, m, 16), np.frombuffer(raw, np.int64, m, 16 + 8 * m), np.frombuffer(raw, np.float64, m, 16 + 16 * m)))
                continue
            if table is None:
                h, c, s = (np.concatenate(x) for x in zip(*held))
                order = np.argsort(h)
                table = h[order], c[order], _chance(c[order], s[order], n, v, less)
            h, t, d = np.frombuffer(raw, U64, m, 16), np.frombuffer(raw, np.int32, m, 16 + 8 * m), np.frombuffer(raw, np.int32, m, 16 + 12 * m)
            at = np.searchsorted(table[0], h)
            c, p_word = table[1][at], table[2][at]
            docs, back = np.unique(d, return_inverse=True)
            sums = [np.bincount(back, weights=w) for w in (t * (c > 0), t * np.log10((c + 1) / (n + v + 1)), _urn(p_word, t))]
            rows.append((block, struct.pack("<qq", 1, len(docs)) + docs.astype(np.int64).tobytes() + b"".join(x.tobytes() for x in sums)))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["block", "packed"])


def _gather(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Answers of each block (rows come sorted by block) to rows of documents."""

    def rows(group: list[bytes]) -> pa.RecordBatch:
        head = next(x for x in group if struct.unpack_from("<q", x)[0] == 0)
        m = struct.unpack_from("<qq", head)[1]
        ids, valid = np.frombuffer(head, np.int64, 2 * m, 16).reshape(2, m)
        sums = np.frombuffer(head, np.float64, 4 * m, 16 + 16 * m).reshape(4, m).copy()
        for raw in sorted(x for x in group if struct.unpack_from("<q", x)[0] == 1):
            k = struct.unpack_from("<qq", raw)[1]
            docs = np.frombuffer(raw, np.int64, k, 16)
            sums[1:, docs] += np.frombuffer(raw, np.float64, 3 * k, 16 + 8 * k).reshape(3, k)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, mask=valid == 0), pa.array(sums[0].astype(np.int64)), pa.array(np.rint(sums[1]).astype(np.int64)), pa.array(np.full(m, n)), pa.array(sums[2]), pa.array(sums[3] / np.log(10))],
            names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    block, group = None, []
    for batch in batches:
        for b, raw in zip(batch.column("block").to_pylist(), batch.column("packed")):
            if b != block and group:
                yield rows(group)
                group = []
            block = b
            group.append(raw.as_py())
    if group:
        yield rows(group)


def score_documents(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs.

    Learns from rows whose crc32 of doc_id modulo 7 is not 2.  Tokens are runs of
    bytes other than ASCII white space with A-Z as a-z, then one end; null and
    empty texts have the end alone.  base_score: add-one unigram score; score:
    log10 of the model's probability of the text.  A null doc_id counts as empty
    text for the crc32.  `vocabulary` is a path on the driver.  Repeated rows are learned from and scored each.  Words
    are told apart by hashes of 64 bits.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (crc_mod("doc_id", 7) == 2).alias("held_out"))
    counted = rows.select("text", "held_out").mapInArrow(_word_counts, "h long, word binary, c long").groupBy("h").agg(F.first("word").alias("word"), F.sum("c").alias("c"))
    counted = materialize(counted, "counted")
    n, v, once, twice = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), *(F.count_if(x) for x in (F.col("c") > 0, F.col("c") == 1, F.col("c") == 2))).first()
    weights = spark.sparkContext.broadcast(fitted(counted, pieces(vocabulary)))
    words = materialize(counted.mapInArrow(lambda it: _spelled(it, weights), "h long, c long, spell double"), "words")
    # At most HEAVY words have a count of n / HEAVY or more.
    top = words.filter(F.col("c") >= max(n / HEAVY, 2)).toPandas().sort_values("h", key=lambda x: x.to_numpy().view(U64))
    h, c, s = top["h"].to_numpy().view(U64), top["c"].to_numpy(), top["spell"].to_numpy()
    s[h == END] = -np.inf
    less = discount(once, twice)
    model = spark.sparkContext.broadcast((h, c, _chance(c, s, n, v, less), n, v, less))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions", "8")), n // PART_TOKENS)
    asked = rows.select("doc_id", "text").mapInArrow(lambda it: _ask(it, model, parts), _PACKED)
    known = words.withColumn("spell", F.when(F.col("h") == F.lit(int(END.view(np.int64))), F.lit(float("-inf"))).otherwise(F.col("spell"))).mapInArrow(lambda it: _pack_words(it, parts), _PACKED)
    dealt = asked.unionByName(known).repartition(parts, "part").sortWithinPartitions("part", "block")
    answers = dealt.mapInArrow(lambda it: _answer(it, model), "block long, packed binary")
    scored = answers.repartition(parts, "block").sortWithinPartitions("block").mapInArrow(lambda it: _gather(it, n), "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return scored.select("doc_id", (crc_mod("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
