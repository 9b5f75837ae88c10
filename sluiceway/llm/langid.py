"""Languages of a text as a mixture, by expectation-maximisation over word likelihoods.

Each language has a model of hashed byte trigrams, counted over all learning
documents.  A text's words come each from one language; EM estimates the
languages' shares.  Then languages are dropped one by one as long as the
likelihood, less a penalty per language, gains from it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluiceway.llm.common import LOWERED_VALUE, U64, Words, crc_mod, flat, ranges

#: Hash buckets of n-grams, whatever the number of languages: the model has 256 KB a language.
BUCKET_BITS = 15
ROUNDS, SMOOTHING = 8, 0.5
#: Text bytes and n-gram likelihoods (n-grams by languages) expanded at once.
CHUNK, CELLS = 1 << 20, 8 << 20


def _grams(words: Words, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the trigrams of each word, one for each byte with its neighbours, and their words."""
    d = words.data
    value = LOWERED_VALUE[d]
    padded = np.concatenate([np.zeros(1, U64), value, np.zeros(1, U64)])
    word = np.repeat(np.arange(len(words.start)), words.end - words.start)
    size = words.end - words.start
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(words.start, size)
    first = np.ones(len(at), bool)
    first[1:] = word[1:] != word[:-1]
    last = np.ones(len(at), bool)
    last[:-1] = first[1:]
    # The edges of a word count as byte value 0.
    before = np.where(first, U64(0), padded[at])
    after = np.where(last, U64(0), padded[at + 2])
    h = before * U64(0x9E3779B97F4A7C15) + padded[at + 1] * U64(0xBF58476D1CE4E5B9) + after * U64(0x94D049BB133111EB)
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    return (h >> U64(64 - bits)).astype(np.int64), word


def _count(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """n-gram counts of a partition's documents, one row a language."""
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), dtype=object)
        data, offsets = flat(batch.column("text"))
        for i, j in ranges(offsets, CHUNK):
            words = Words(data, offsets, i, j)
            gram, word = _grams(words, bits)
            doc = words.doc[word]
            for lang in set(langs[i:j]):
                hit = (langs[i:j] == lang)[doc]
                part = np.bincount(gram[hit], minlength=1 << bits)
                counts[lang] = counts[lang] + part if lang in counts else part
    if counts:
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([c.astype(np.int64).tolist() for c in counts.values()], pa.list_(pa.int64()))], names=["lang", "counts"])


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray, int]:
    """Languages, log-probabilities (bucket by language) and bucket bits.

    Learned from all rows with a language whose crc32 of doc_id modulo 3 is not
    1.  Only one vector a language and partition leaves the executors' maps; they
    are added up element-wise before the driver sees one vector a language.
    """
    rows = docs.filter(F.col("lang").isNotNull() & (crc_mod("doc_id", 3) != 1)).select("lang", "text")
    bits = BUCKET_BITS
    counted = rows.mapInArrow(lambda it: _count(it, bits), "lang string, counts array<bigint>")
    totals: dict[str, np.ndarray] = {}
    summed = counted.select("lang", F.posexplode("counts").alias("k", "c")).filter("c > 0").groupBy("lang", "k").agg(F.sum("c").alias("c"))
    table = summed.toPandas()
    for lang, part in table.groupby("lang"):
        totals[lang] = np.bincount(part["k"], weights=part["c"], minlength=1 << bits)
    langs = sorted(set(totals) | {r[0] for r in rows.select("lang").distinct().collect()})
    if not langs:
        return [], np.zeros((1 << bits, 0)), bits
    c = np.stack([totals.get(lang, np.zeros(1 << bits)) for lang in langs], axis=1) + SMOOTHING
    return langs, np.log(c / c.sum(axis=0)), bits


def mixture(likely: np.ndarray, first: np.ndarray, allowed: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the allowed languages and log-likelihood, per document.

    likely: log-likelihood of each word by language; first: index of each
    document's first word, with the total at the end (no document is empty).
    """
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n)), n)
    top = np.where(allowed[doc], likely, -np.inf).max(axis=1)
    p = np.exp(likely - top[:, None]) * allowed[doc]
    share = allowed / allowed.sum(axis=1, keepdims=True)
    for _ in range(rounds):
        q = p * share[doc]
        q /= q.sum(axis=1, keepdims=True)
        share = np.maximum(np.add.reduceat(q, first[:-1], axis=0) / n[:, None], 1e-12) * allowed
    fit = np.log((p * share[doc]).sum(axis=1)) + top
    return share, np.add.reduceat(fit, first[:-1])


def select(likely: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Shares of each document's chosen languages; 0 for the others.

    Backward choice: start from the languages EM gives a share, and drop the one
    with the least share while the likelihood falls by no more than the penalty
    of a parameter, half the logarithm of the number of words.
    """
    n, k = np.diff(first), likely.shape[1]
    share, fit = mixture(likely, first, np.ones((len(n), k), bool))
    allowed = share > 1e-6
    active = np.flatnonzero(allowed.sum(axis=1) > 1)
    while len(active):
        some = np.where(allowed[active], share[active], np.inf)
        trial = allowed[active].copy()
        # Of equal shares the last language goes.
        trial[np.arange(len(active)), k - 1 - some[:, ::-1].argmin(axis=1)] = False
        take = np.concatenate([np.arange(first[d], first[d + 1]) for d in active])
        inner = np.append(0, np.cumsum(n[active]))
        new_share, new_fit = mixture(likely[take], inner, trial)
        better = fit[active] - new_fit <= 0.5 * np.log(n[active]) + 1
        done = active[better]
        allowed[done], share[done], fit[done] = trial[better], new_share[better], new_fit[better]
        active = done[allowed[done].sum(axis=1) > 1]
    return share * allowed


def _by_word(table: np.ndarray, gram: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Log-likelihoods of words by language, so many n-grams at a time that memory is bounded; begins has the total at the end."""
    out = np.empty((len(begins) - 1, table.shape[1]))
    for a, b in ranges(begins, max(CELLS // table.shape[1], 1)):
        out[a:b] = np.add.reduceat(table[gram[begins[a] : begins[b]]], begins[a:b] - begins[a], axis=0)
    return out


def _predict(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    langs, table, bits = model.value
    names = np.array([*langs, "und"], dtype=object)
    for batch in batches:
        text = batch.column("text")
        data, offsets = flat(text)
        best, score = np.full(batch.num_rows, len(langs)), np.zeros(batch.num_rows)
        sets: list[list[str]] = [[]] * batch.num_rows
        letters = np.array(pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_pylist(), bool)
        for i, j in ranges(offsets, max(CHUNK // max(1, len(langs) // 8), 1)):
            words = Words(data, offsets, i, j)
            if not langs or not len(words.start):
                continue
            gram, word = _grams(words, bits)
            likely = _by_word(table, gram, np.searchsorted(word, np.arange(len(words.start) + 1)))
            full = np.flatnonzero(words.count > 0)
            share = select(likely, np.append(words.first[:-1][full], len(words.start)))
            best[i + full], score[i + full] = share.argmax(axis=1), np.clip(share.max(axis=1), 0, 1)
            for d, row in zip(full.tolist(), share):
                sets[i + d] = [langs[x] for x in np.argsort(-row, kind="stable") if row[x] > 0]
        best[~letters], score[~letters] = len(langs), 0
        sets = [s if ok else [] for s, ok in zip(sets, letters)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), pa.array(names[best].tolist(), pa.string()), pa.array(score), pa.array(sets, pa.list_(pa.string()))], names=["doc_id", "lang_pred", "score", "langs"]
        )


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, langs for every row of docs.

    lang_pred: the language with the largest share; score: that share; langs: all
    chosen languages, largest share first.  `und`, with score 0 and no languages,
    if the text is null, has no letter, or nothing was learned.  Ties go to the
    language first in code-point order.  Predictions come from the text alone.
    """
    model = docs.sparkSession.sparkContext.broadcast(learn(docs))
    found = docs.select("doc_id", "text").mapInArrow(lambda it: _predict(it, model), "doc_id long, lang_pred string, score double, langs array<string>")
    return found.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "langs")
