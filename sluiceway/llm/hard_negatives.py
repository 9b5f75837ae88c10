"""Hard negatives by exact search in inverted lists.

Centroids are fitted to a bounded sample; every row goes into the list of its
centroid, and each list keeps the largest distance to it.  By Cauchy and Schwarz
an anchor's inner product with a member is at most that with the centroid plus
norm times radius, and at least that less it.  Lists are dealt into shards of
bounded size.  An anchor first goes to the shard that promises most, then, with
the scores found there, to the others that can still matter.  In a shard it
visits lists from the highest bound down, passes by those outside its window, and
stops where the bound is below its last score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluiceway.llm.common import materialize

ANCHORS, RELABELLED, CLASSES, SCALE = 50, 7, 10, 256
POSITIVES, NEGATIVES, LOW, HIGH = 5, 3, 50, 95
#: Rows that the centroids are fitted to, and rounds; the most centroids.
SAMPLE, ROUNDS, CENTROIDS = 16_384, 8, 1_024
#: Rows of lists that a task holds, and anchors that pass them.
SHARD_ROWS, ANCHOR_ROWS = 32_768, 65_536
_EXACT, _LEAST, _MOST = 2.0**53, -(2**63), 2**63 - 1

_LISTS = "dim int, cluster int, far double, id long, label long, v array<double>"
_FOUND = "anchor_id long, key long, id long, score long"


# --- rows ----------------------------------------------------------------------


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, label, embedding of the rows that take part, one for each vec_id: that of the least label, then the least vector."""
    x = F.col("embedding").cast("array<double>")
    fit = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    own = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % RELABELLED == 0, (own + 1) % CLASSES).otherwise(own)
    one = rows.filter(F.coalesce(fit, F.lit(False))).groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min(F.struct(label.alias("label"), x.alias("x"))).alias("r"))
    return one.select("vec_id", "r.label", F.col("r.x").alias("embedding"))


def scaled(x: np.ndarray) -> np.ndarray:
    """Whole numbers, as doubles; what passes the range of doubles becomes their largest."""
    with np.errstate(over="ignore"):
        return np.nan_to_num(np.floor(x * SCALE))


def resized(centroids: np.ndarray, dim: int) -> np.ndarray:
    """Centroids for vectors of another dimension: cut off, or with zeros behind."""
    out = np.zeros((len(centroids), dim))
    n = min(dim, centroids.shape[1])
    out[:, :n] = centroids[:, :n]
    return out


def fit_centroids(rows: DataFrame, n: int) -> np.ndarray:
    """About sqrt(n) centroids by Lloyd's rounds over the SAMPLE rows whose ids have the least hashes; the lists hold any vector whatever they are."""
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").collect()
    dim = max((len(r.embedding) for r in sample), default=1) or 1
    x = np.concatenate([np.zeros((0, dim)), *(resized(scaled(np.array(r.embedding, float).reshape(1, -1)), dim) for r in sample)])
    x = x[np.isfinite((x * x).sum(axis=1))]
    k = int(min(CENTROIDS, max(1, round(n**0.5)), max(len(x), 1)))
    centroids = x[:k].copy() if len(x) else np.zeros((1, dim))
    for _ in range(ROUNDS):
        nearest = np.argmax(x @ centroids.T - 0.5 * (centroids * centroids).sum(axis=1), axis=1) if len(x) else np.zeros(0, int)
        sizes = np.bincount(nearest, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, x)
        centroids[sizes > 0] = sums[sizes > 0] / sizes[sizes > 0, None]
    return centroids


def _vectors(column: pa.Array) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Vectors by dimension: the rows' places and a matrix."""
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)
    dims = np.diff(offsets)
    out = []
    for d in np.unique(dims):
        at = np.flatnonzero(dims == d)
        out.append((int(d), at, values[offsets[:-1][at][:, None] + np.arange(d)].reshape(len(at), d)))
    return out


def inverted_lists(rows: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """dim, shard, cluster, far, id, label, v: each row in its list, the lists dealt into shards of some SHARD_ROWS rows; and the centroids."""
    fitted = fit_centroids(rows, rows.count())
    centroids = rows.sparkSession.sparkContext.broadcast(fitted)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, at, x in _vectors(b.column(2)):
                v, c = scaled(x), resized(centroids.value, dim)
                with np.errstate(over="ignore", invalid="ignore"):
                    cluster = np.argmax(np.nan_to_num(v @ c.T - 0.5 * (c * c).sum(axis=1), nan=0.0), axis=1)
                    far = np.sqrt(((v - c[cluster]) ** 2).sum(axis=1))
                lists = pa.ListArray.from_arrays(pa.array((np.arange(len(at) + 1) * dim).astype(np.int32)), pa.array(v.ravel()))
                keys = pa.array(at)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), dim, np.int32)), pa.array(cluster.astype(np.int32)), pa.array(far), b.column(0).take(keys), b.column(1).take(keys), lists], ["dim", "cluster", "far", "id", "label", "v"])

    assigned = materialize(rows.select("vec_id", "label", "embedding").mapInArrow(assign, _LISTS), "assigned")
    upto = Window.partitionBy("dim").orderBy("cluster").rowsBetween(Window.unboundedPreceding, -1)  # at most CENTROIDS rows
    sizes = assigned.groupBy("dim", "cluster").agg(F.count("*").alias("n"))
    first = F.floor(F.coalesce(F.sum("n").over(upto), F.lit(0)) / SHARD_ROWS)
    places = sizes.select("dim", "cluster", first.alias("first"), F.ceil(F.col("n") / SHARD_ROWS).alias("parts"))
    shard = (F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int")
    lists = assigned.join(places, ["dim", "cluster"]).select("dim", shard.alias("shard"), "cluster", "far", "id", "label", "v")
    return materialize(lists, "lists"), fitted


# --- bounds --------------------------------------------------------------------


def bounds(centroids: np.ndarray, radius: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest inner product that each list's members can have with q, rounded outwards."""
    with np.errstate(over="ignore", invalid="ignore"):
        norm = np.sqrt(q @ q)
        middle, reach = centroids @ q, norm * radius
        slack = 1e-9 * (norm * np.sqrt((centroids * centroids).sum(axis=1)) + reach) + 1e-6
        low, high = middle - reach - slack, middle + reach + slack
    return np.where(np.isfinite(low), low, -np.inf), np.where(np.isfinite(high), high, np.inf)


def window(score: int) -> tuple[int, int]:
    """The least and the greatest score of a hard negative beside a positive's."""
    return -(-LOW * score // 100), HIGH * score // 100


def inner_products(v: np.ndarray, q: np.ndarray, largest: float) -> np.ndarray:
    """Exact inner products; beyond what doubles hold, by whole numbers of any size, kept within a long's range."""
    if largest < _EXACT:
        return (v @ q).astype(np.int64)
    return np.array([min(max(sum(int(a) * int(b) for a, b in zip(row, q)), _LEAST), _MOST) for row in v], np.int64)


class Shard:
    """The lists of one shard."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, clusters: np.ndarray, far: np.ndarray, v: np.ndarray, centroids: np.ndarray) -> None:
        order = np.lexsort((ids, clusters))
        self.ids, self.labels, self.v = ids[order], labels[order], np.ascontiguousarray(v[order])
        own, self.first = np.unique(clusters[order], return_index=True)
        self.centroids, self.radius = centroids[own], np.maximum.reduceat(far[order], self.first) if len(order) else np.zeros(0)
        self.first = np.append(self.first, len(order))
        with np.errstate(over="ignore"):
            self.norm = float(np.sqrt((self.v * self.v).sum(axis=1).max(initial=0)))

    def search(self, q: np.ndarray, anchor: int, label: int, wants: list[list[int]], same: bool, k: int) -> list[list[tuple[int, int]]]:
        """For each want (least score, greatest score, score to reach) the k best rows of the anchor's label, or of others: (-score, id)."""
        low, high = bounds(self.centroids, self.radius, q)
        with np.errstate(over="ignore"):
            largest = self.norm * float(np.sqrt(q @ q))
        best: list[list[tuple[int, int]]] = [[] for _ in wants]
        floors = [max(a, t) for a, _, t in wants]
        for c in np.argsort(-high, kind="stable"):
            if high[c] < min(floors):
                break
            if not any(high[c] >= f and low[c] <= b for f, (_, b, _) in zip(floors, wants)):
                continue
            i, j = self.first[c], self.first[c + 1]
            score = inner_products(self.v[i:j], q, largest)
            some = np.flatnonzero((score >= min(floors)) & ((self.labels[i:j] == label) == same) & (self.ids[i:j] != anchor))
            if not len(some):
                continue
            score, ids = score[some], self.ids[i:j][some]
            for w, (_, b, t) in enumerate(wants):
                fit = np.flatnonzero((score >= floors[w]) & (score <= b))
                if len(fit):
                    fit = fit[np.lexsort((ids[fit], -score[fit]))[:k]]
                    best[w] = sorted(best[w] + [(-int(s), int(x)) for s, x in zip(score[fit], ids[fit])])[:k]
                    if len(best[w]) == k:
                        floors[w] = max(floors[w], -best[w][-1][0])
        return best


# --- search over shards ----------------------------------------------------------


class Search:
    """Searches of many anchors over all shards; requests: dim, id, label, v, keys, at, reach (a score to reach for each key)."""

    def __init__(self, lists: DataFrame, centroids: np.ndarray, same: bool, k: int) -> None:
        self.lists, self.same, self.k = lists, same, k
        # A row for each list of a dimension, and one for each SHARD_ROWS rows.
        stats = lists.groupBy("dim", "shard", "cluster").agg(F.max("far").alias("radius")).toPandas()
        by_dim = {int(d): (g["shard"].to_numpy(), g["cluster"].to_numpy(), g["radius"].to_numpy()) for d, g in stats.groupby("dim")}
        self.shared = lists.sparkSession.sparkContext.broadcast((centroids, by_dim))

    def routed(self, requests: DataFrame, home: bool) -> DataFrame:
        """Requests with the shard that promises most, or with the others that may hold a row better than what is at hand."""
        shared, same = self.shared, self.same

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centroids, by_dim = shared.value
            sized = {d: resized(centroids, d)[cluster] for d, (_, cluster, _) in by_dim.items()}
            for b in batches:
                at, to = [], []
                rows = b.select(["keys", "at", "reach"]).to_pylist()
                for dim, places, v in _vectors(b.column(b.schema.get_field_index("v"))):
                    shard, _, radius = by_dim[dim]
                    for place, q in zip(places, v):
                        low, high = bounds(sized[dim], radius, q)
                        nearest = int(shard[np.lexsort((shard, -high))[0]])
                        if home:
                            shards = [nearest]
                        else:
                            may = np.zeros(len(shard), bool)
                            for a, z, t in _wants(rows[place], same):
                                may |= (high >= max(a, t)) & (low <= z)
                            shards = [int(s) for s in np.unique(shard[may]) if s != nearest]
                        at += [int(place)] * len(shards)
                        to += shards
                out = b.take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(to, pa.int32())], [*out.schema.names, "shard"])

        columns = "dim", "id", "label", "v", "keys", "at", "reach"
        return requests.select(*columns).mapInArrow(route, "dim int, id long, label long, v array<double>, keys array<long>, at array<long>, reach array<long>, shard int")

    def found(self, requests: DataFrame, salts: int) -> DataFrame:
        """anchor_id, key, id, score: what the shards that requests were routed to hold."""
        shared, same, k = self.shared, self.same, self.k

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Rows by dim, shard, salt and kind: a shard's lists come before the requests to it."""
            group, held, shard = None, [], None
            for b in batches:
                dim, number, salt, kind = (b.column(c).to_numpy() for c in range(4))
                cuts = np.flatnonzero((np.diff(dim) != 0) | (np.diff(number) != 0) | (np.diff(salt) != 0) | (np.diff(kind) != 0)) + 1
                for i, j in zip([0, *cuts], [*cuts, len(dim)]):
                    if i == j:
                        continue
                    if group != (dim[i], number[i], salt[i]):
                        group, held, shard = (dim[i], number[i], salt[i]), [], None
                    part = b.slice(i, j - i)
                    ids, labels = part.column("id").to_numpy(), part.column("label").to_numpy()
                    _, _, v = _vectors(part.column("v"))[0]
                    if kind[i] == 0:
                        held.append((ids, labels, part.column("cluster").to_numpy(), part.column("far").to_numpy(), v))
                        continue
                    if shard is None:
                        shard = Shard(*(np.concatenate(x) for x in zip(*held)), resized(shared.value[0], int(dim[i])))
                        held = []
                    out = []
                    for row, anchor, label, q in zip(part.select(["keys", "at", "reach"]).to_pylist(), ids.tolist(), labels.tolist(), v):
                        for key, best in zip(row["keys"], shard.search(q, anchor, label, _wants(row, same), same, k)):
                            out += [(anchor, key, x, -s) for s, x in best]
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["anchor_id", "key", "id", "score"])

        empty = F.lit(None).cast("array<long>")
        lists = self.lists.select("dim", "shard", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("kind"), "id", "label", "cluster", "far", "v", empty.alias("keys"), empty.alias("at"), empty.alias("reach"))
        asked = requests.select("dim", "shard", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("salt"), F.lit(1).alias("kind"), "id", "label", F.lit(0).alias("cluster"), F.lit(0.0).alias("far"), "v", "keys", "at", "reach")
        return lists.unionByName(asked).repartition("dim", "shard", "salt").sortWithinPartitions("dim", "shard", "salt", "kind").mapInArrow(run, _FOUND)

    def best(self, found: DataFrame) -> DataFrame:
        """The k best of each anchor and key, with their rank."""
        order = Window.partitionBy("anchor_id", "key").orderBy(F.desc("score"), "id")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= self.k)

    def __call__(self, requests: DataFrame, salts: int) -> DataFrame:
        """anchor_id, key, id, score, rank over all shards."""
        near = materialize(self.best(self.found(self.routed(requests, True), salts)), "near")
        last = near.groupBy("anchor_id", "key").agg(F.max("rank").alias("n"), F.min("score").alias("score")).filter(F.col("n") == self.k)
        reached = last.groupBy(F.col("anchor_id").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("key", "score"))).alias("reached"))  # a few keys
        reach: Column = F.transform("keys", lambda x: F.coalesce(F.try_element_at("reached", x), F.lit(_LEAST)))
        later = requests.drop("reach").join(reached, "id", "left").withColumn("reach", reach).drop("reached")
        return self.best(near.drop("rank").unionByName(self.found(self.routed(later, False), salts)))


def _wants(row: dict, same: bool) -> list[list[int]]:
    """Least score, greatest score and score to reach for each key."""
    return [[*((_LEAST, _MOST) if same else window(s)), t] for s, t in zip(row["at"], row["reach"])]


# --- mining ----------------------------------------------------------------------


def mine_hard_negatives(embeddings: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Rows without vec_id take no part, like those without label or with a vector
    that is null or holds null, NaN or infinity.  Of rows that repeat a vec_id
    that with the least label, then the least vector counts.  Vectors meet those
    of their own dimension only; empty ones score 0.  Scores beyond a long's
    range become its ends.  Other columns are ignored; an empty table gives no row.
    """
    rows = materialize(usable(embeddings), "usable")
    lists, centroids = inverted_lists(rows)
    anchors = lists.filter(F.col("id") % ANCHORS == 0).select("dim", "id", "label", "v")
    salts = max(1, -(-anchors.count() // ANCHOR_ROWS))
    none = F.array(F.lit(_LEAST))
    positives = Search(lists, centroids, True, POSITIVES)(anchors.select("*", F.array(F.lit(0).cast("long")).alias("keys"), F.array(F.lit(0).cast("long")).alias("at"), none.alias("reach")), salts)
    positives = materialize(positives.select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    each = positives.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("p"))  # at most POSITIVES
    asked = anchors.join(each, "id").select("dim", "id", "label", "v", F.col("p.positive_id").alias("keys"), F.col("p.positive_score").alias("at"), F.transform("p", lambda _: F.lit(_LEAST)).alias("reach"))
    negatives = Search(lists, centroids, False, NEGATIVES)(asked, salts).select("anchor_id", F.col("key").alias("positive_id"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return negatives.join(positives, ["anchor_id", "positive_id"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def oracle() -> str:
    """DuckDB SQL of op12: all inner products of the anchors."""
    return f"""
WITH e AS (SELECT vec_id, CASE WHEN vec_id % {RELABELLED} = 0 THEN (CAST(label AS BIGINT) + 1) % {CLASSES} ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % {ANCHORS} = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES})
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank, s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND {LOW} * CAST(p.positive_score AS HUGEINT) <= 100 * CAST(s.score AS HUGEINT) AND 100 * CAST(s.score AS HUGEINT) <= {HIGH} * CAST(p.positive_score AS HUGEINT)
QUALIFY rank <= {NEGATIVES}
"""
