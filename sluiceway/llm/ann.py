"""Approximate nearest neighbours by collision-counting hashing with virtual rehashing.

Vectors are dealt to shards of bounded size.  A shard keeps, for each of
PROJECTIONS random directions, its vectors' projections as one sorted array.  A
query opens a window around its own projection in every array; a vector inside
it collides there.  Vectors with THRESHOLD collisions are verified by their
exact distance.  While fewer than k verified vectors lie within the radius that
the windows stand for, the windows grow by RATIO: the arrays stay, so rehashing
is virtual.  A window is a range of places in its array, so the windows of all
turns are found by bisection for many queries at once, and collisions are
counted by comparing the vectors' places with them.  The shards' best k are
merged by query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluiceway.llm.common import materialize

PROJECTIONS, THRESHOLD, RATIO, WIDTH = 40, 24, 1.5, 2.0
SHARD_ROWS, QUERY_ROWS = 8192, 1024
#: Queries whose windows are found together.
QUERIES = 32
SEED = 7


def directions(dim: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([SEED, dim])).standard_normal((PROJECTIONS, dim))


class Index:
    """Sorted projections of one shard, and each vector's place in them."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        n = len(ids)
        self.ids, self.vectors = ids, vectors
        self.axes = directions(vectors.shape[1])
        p = self.axes @ vectors.T
        order = np.argsort(p, axis=1, kind="stable")
        self.sorted = np.take_along_axis(p, order, axis=1)
        # Unsigned places: below a window they wrap round, so one comparison tells what lies inside.
        self.place = np.empty(p.shape, np.uint16 if n < 1 << 16 else np.uint32)
        np.put_along_axis(self.place, order, np.arange(n, dtype=self.place.dtype)[None, :], axis=1)
        # The first window: about the distance at which a projection holds a few vectors.
        gap = (self.sorted[:, -1] - self.sorted[:, 0]) / max(n, 1)
        self.step = max(float(np.median(gap)) * 4, 1e-9)

    def windows(self, where: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Radius of each turn, and the windows' first places and sizes by query, projection and turn; the last turn's hold all vectors."""
        spread = np.abs(np.stack([where - self.sorted[:, 0], where - self.sorted[:, -1]])).max()
        reach = max(float(spread) * 2 / WIDTH, self.step) if np.isfinite(spread) else np.finfo(float).max
        turns = int(np.ceil(np.log(reach / self.step) / np.log(RATIO))) + 1
        with np.errstate(over="ignore"):
            radius = self.step * RATIO ** np.arange(turns)
        edge = where[:, :, None] + radius * WIDTH / 2 * np.array([-1.0, 1.0])[:, None, None, None]
        low = np.stack([np.searchsorted(row, edge[0, :, j]) for j, row in enumerate(self.sorted)], axis=1)
        high = np.stack([np.searchsorted(row, edge[1, :, j], "right") for j, row in enumerate(self.sorted)], axis=1)
        low[:, :, -1], high[:, :, -1] = 0, len(self.ids)
        return radius, low.astype(self.place.dtype), (high - low).astype(self.place.dtype)

    def colliding(self, low: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The vectors that lie in THRESHOLD of the windows."""
        inside = np.less(self.place - low[:, None], size[:, None])
        return inside.sum(axis=0, dtype=np.uint8) >= THRESHOLD

    def search(self, queries: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids and distances of the best k found for each query, nearest first, ties to the smaller id.

        A query ends in its first turn whose radius holds k verified vectors.
        What is verified grows with the turns, so that turn is looked for from
        the one in which the query before ended, downwards or upwards.
        """
        hint = 0
        for begin in range(0, len(queries), QUERIES):
            some = queries[begin : begin + QUERIES]
            radius, low, size = self.windows(some @ self.axes.T)
            last = len(radius) - 1
            for x, query in enumerate(some):
                distance = np.full(len(self.ids), -1.0)
                distance[self.ids == own[begin + x]] = np.inf

                def best(turn: int) -> tuple[bool, np.ndarray]:
                    if turn < last and int(size[x, :, turn].sum(dtype=np.int64)) < THRESHOLD * k:
                        return False, np.zeros(0, np.int64)  # too few collisions for k vectors
                    met = np.flatnonzero(self.colliding(low[x, :, turn], size[x, :, turn]))
                    new = met[distance[met] < 0]
                    d = self.vectors[new] - query
                    distance[new] = np.sqrt((d * d).sum(axis=1))
                    met = met[self.ids[met] != own[begin + x]]
                    far = distance[met]
                    if len(met) > k:
                        near = far <= np.partition(far, k - 1)[k - 1]
                        met, far = met[near], far[near]
                    met = met[np.lexsort((self.ids[met], far))][:k]
                    return turn == last or len(met) == k and distance[met[-1]] <= radius[turn], met

                turn = min(hint, last)
                done, found = best(turn)
                if done:
                    while turn and (before := best(turn - 1))[0]:
                        turn, found = turn - 1, before[1]
                while not done:
                    turn += 1
                    done, found = best(turn)
                hint = turn
                yield self.ids[found], distance[found]


def _matrix(column) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(values.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(values), -1)


def _near(data: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if data.num_rows and queries.num_rows:
        index = Index(data["vec_id"].to_numpy(), _matrix(data["v"]))
        own = queries["vec_id"].to_numpy()
        for x, (ids, dist) in enumerate(index.search(_matrix(queries["v"]), own, k)):
            found.append((np.full(len(ids), own[x]), ids, dist))
    cols = [np.concatenate([f[c] for f in found]) if found else np.zeros(0, float if c == 2 else np.int64) for c in range(3)]
    return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v: the vectors that can take part, in double precision."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))


def nearest(vectors: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row whose vec_id is divisible by `every`.

    score is the Euclidean distance.  Null, empty and zero vectors and those with
    null or non-finite components take no part.  Candidates have another vec_id
    and the same length as the query.  Rows repeated with the same vector count
    once; a vec_id with several vectors is as many candidates, of which the
    nearest counts, and as many queries, of which the best matches count.
    """
    spark = vectors.sparkSession
    # Written once: the vectors are counted, dealt and asked from, and the exchange of distinct is the dear part.
    rows = materialize(usable(vectors).distinct().withColumn("dim", F.size("v")), "vectors")
    sizes = {r["dim"]: (r["n"], r["q"]) for r in rows.groupBy("dim").agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("q")).collect()}
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # As many shards and blocks as the rows need, whatever their length.
    shards = max(-(-n // SHARD_ROWS) for n, _ in sizes.values())
    blocks = max(1, *(-(-q // QUERY_ROWS) for _, q in sizes.values()))
    part = lambda m, salt: F.pmod(F.xxhash64("vec_id", "v", F.lit(salt)), F.lit(m))
    data = rows.select("dim", part(shards, 1).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "vec_id", "v")
    queries = rows.filter(F.col("vec_id") % every == 0).select("dim", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), part(blocks, 2).cast("int").alias("block"), "vec_id", "v")
    keys = ["dim", F.col("shard").cast("int").alias("shard"), "block", "vec_id", "v"]
    pairs = data.select(*keys).groupBy("dim", "shard", "block").cogroup(queries.select(*keys).groupBy("dim", "shard", "block"))
    found = pairs.applyInArrow(lambda a, b: _near(a, b, k), "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
