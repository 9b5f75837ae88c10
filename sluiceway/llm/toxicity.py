"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the presence of hashed words, word pairs and pairs with
one word between them.  FTRL-proximal gives each coordinate its own rate and
sets most weights to exactly 0, so the model is a short list: it is broadcast
(at most 2**DIM_BITS weights) and scoring is one gather per feature.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from sluiceway.llm.common import U64, Words, crc_mod, flat, ints, ranges, whole_row

DIM_BITS = 22
#: At most so many labelled rows of each class are learned from, those with the least hash of doc_id.
TRAIN_ROWS = 8000
EPOCHS, ALPHA, BETA, L1, L2 = 4, 1.0, 1.0, 10.0, 0.1
THRESHOLD = 0.3
CHUNK = 2 << 20


def _features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all words, pairs and skip-pairs, and their documents."""
    h, doc = words.hash, words.doc
    out, where = [h], [doc]
    for step, salt in ((1, U64(0xA24BAED4963EE407)), (2, U64(0x9FB21C651E98DF25))):
        both = doc[:-step] == doc[step:] if len(doc) > step else np.zeros(0, bool)
        if len(both):
            out.append(((h[:-step] * salt) ^ (h[step:] >> U64(7)) ^ h[step:])[both])
            where.append(doc[:-step][both])
    f = np.concatenate(out)
    return ((f * U64(0x9E3779B97F4A7C15)) >> U64(64 - DIM_BITS)).astype(np.int64), np.concatenate(where)


def _learn(batches: Iterator[pa.RecordBatch], epochs: int) -> Iterator[pa.RecordBatch]:
    """The weights learned from all rows of the (bounded) sample."""
    rows: list[tuple[int, int, np.ndarray]] = []
    for batch in batches:
        data, offsets = flat(batch.column("text"))
        order, label = ints(batch.column("place")), ints(batch.column("label"))
        for i, j in ranges(offsets, CHUNK):
            f, doc = _features(Words(data, offsets, i, j))
            pair = np.unique((doc << DIM_BITS) | f)
            cut = np.searchsorted(pair, np.arange(j - i + 1) << DIM_BITS)
            for k in range(j - i):
                rows.append((int(order[i + k]), int(label[i + k]), (pair[cut[k] : cut[k + 1]] & ((1 << DIM_BITS) - 1)).astype(np.int32)))
    rows.sort(key=lambda r: r[:2])
    z, n, w = (np.zeros(1 << DIM_BITS) for _ in range(3))
    bias_z = bias_n = bias = 0.0
    for _ in range(epochs):
        for _, y, f in rows:
            v = w[f]
            p = 1 / (1 + np.exp(-np.clip(v.sum() + bias, -35, 35)))
            g = p - y
            grown = n[f] + g * g
            rate = (np.sqrt(grown) - np.sqrt(n[f])) / ALPHA
            z[f] += g - rate * v
            n[f] = grown
            now = z[f]
            w[f] = np.where(np.abs(now) <= L1, 0, -(now - np.sign(now) * L1) / ((BETA + np.sqrt(grown)) / ALPHA + L2))
            grown_b = bias_n + g * g
            bias_z += g - (np.sqrt(grown_b) - np.sqrt(bias_n)) / ALPHA * bias
            bias_n = grown_b
            bias = -bias_z / ((BETA + np.sqrt(grown_b)) / ALPHA)
    at = np.flatnonzero(w)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int64()), pa.array(np.append(w[at], bias), pa.float64())], names=["feature", "weight"])


def _score(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    at, weight, bias = model.value
    table = np.zeros(1 << DIM_BITS, np.float32)
    table[at] = weight
    for batch in batches:
        data, offsets = flat(batch.column("text"))
        total = np.full(batch.num_rows, bias)
        for i, j in ranges(offsets, CHUNK):
            f, doc = _features(Words(data, offsets, i, j))
            hit = np.flatnonzero(table[f])
            pair = np.unique((doc[hit] << DIM_BITS) | f[hit])
            np.add.at(total, i + (pair >> DIM_BITS), table[pair & ((1 << DIM_BITS) - 1)])
        score = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
        names = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(score)], names=[*names, "score"])


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """Feature numbers, weights and bias learned from `rows` documents of each class at most.

    Held-out documents (crc32 of doc_id modulo 4 is 2), null labels and null ids
    are not learned from.  A doc_id with several labels counts as toxic if one
    says so.  The bias is moved from the classes' odds in the sample to those of
    all learning labels.  Without labelled rows of both classes it stays.
    """
    y = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (crc_mod("doc_id", 4) != 2))
    y = y.groupBy("doc_id").agg(F.max("toxic").cast("long").alias("label")).withColumn("place", F.xxhash64("doc_id"))
    picked = [y.filter(F.col("label") == k).orderBy("place", "doc_id").limit(rows) for k in (0, 1)]
    chosen = F.broadcast(picked[0].union(picked[1]))  # at most 2 * rows ids
    sample = docs.select("doc_id", "text").join(chosen, "doc_id").select("text", "place", "label").repartition(1)  # an exchange: only the sample meets in one task
    model = sample.mapInArrow(lambda it: _learn(it, epochs), "feature long, weight double").toPandas()
    if not len(model):
        return np.zeros(0, np.int64), np.zeros(0), 0.0
    real = model["feature"] >= 0
    bias = float(model["weight"][~real].iloc[0])
    seen = {r["label"]: r["count"] for r in y.groupBy("label").count().collect()}
    if len(seen) > 1:
        bias += np.log(seen[1] / seen[0]) - np.log(min(seen[1], rows) / min(seen[0], rows))
    return model["feature"][real].to_numpy(), model["weight"][real].to_numpy(), bias


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs.

    Scores come from the text alone: null and empty texts have no feature and get
    the score of the bias.  Rows with one doc_id are scored each; A-Z count as
    a-z.  Words are runs of bytes other than ASCII white space.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(train(docs, labels, rows))
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda it: _score(it, model), "doc_id long, score double")
    return scored.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without those whose text scores `threshold` or more; all columns are kept.

    Each row is judged by its own text: null and empty texts get the score of the
    bias, rows that repeat a doc_id are judged each, rows with equal texts alike.
    Columns other than text may have any name.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(train(docs, labels))
    whole = docs.select(whole_row(docs).alias("_row"), F.col("text"))
    schema = StructType([whole.schema["_row"], StructField("score", DoubleType())])
    return whole.mapInArrow(lambda it: _score(it, model), schema).filter(F.col("score") < threshold).select("_row.*")
