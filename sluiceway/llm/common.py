"""What the corpus operators share: staging tables, and text as numpy arrays.

Python workers get whole Arrow batches.  A batch's strings are one byte buffer
with offsets, so words, hashes and windows are found for thousands of texts at
once; only chunks of a few MB are expanded at a time, so memory is bounded by
the chunk (or by the longest single text).
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_rng = np.random.Generator(np.random.PCG64(20240601))
BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(U64) | U64(1)
_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


_staged: set[str] = set()


# --- staging ---------------------------------------------------------------


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share: spark.checkpoint.dir.  Only where Spark itself is local may it be unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        named = tempfile.mkdtemp(prefix="sluiceway-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def staging_root(spark: SparkSession) -> str:
    """This application's own folder in the shared one; it is deleted when the driver ends."""
    root = f"{shared_dir(spark)}/sluiceway/{spark.sparkContext.applicationId}"
    if root not in _staged:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
        _staged.add(root)
    return root


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores before it until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def quoted(name: str) -> str:
    """A column's name as an expression, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def whole_row(df: DataFrame) -> Column:
    """All columns of df as one struct."""
    return F.struct(*map(quoted, df.columns))


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    Lineage ends there: a lost executor costs no recomputation before it.
    """
    spark = df.sparkSession
    path = f"{staging_root(spark)}/{uuid.uuid4().hex}/{tag}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions_for(spark: SparkSession, total_bytes: int, each: int) -> int:
    """Shuffle partitions so that one gets about `each` bytes, not below the session's number."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "8")), -(-int(total_bytes) // each))


def crc_mod(col: str, m: int) -> Column:
    """crc32 of the id's decimal text, modulo m; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % m


# --- strings of an Arrow column as arrays ------------------------------------


def flat(arr) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null is empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = pc.fill_null(arr, b"" if pa.types.is_binary(arr.type) or pa.types.is_large_binary(arr.type) else "")
    large = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(arr.buffers()[1], np.int64 if large else np.int32)[arr.offset : arr.offset + len(arr) + 1]
    data = arr.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets.astype(np.int64)


def ranges(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of documents of at most `limit` bytes together (or one longer document)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def ints(col, null: int = np.iinfo(np.int64).max) -> np.ndarray:
    """A column of whole numbers as int64, null as `null`."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return pc.fill_null(col.cast(pa.int64()), null).to_numpy(zero_copy_only=False)


# --- hashing -----------------------------------------------------------------


def mix(h: np.ndarray) -> np.ndarray:
    """A finalizer whose every output bit depends on every input bit; in place."""
    h ^= h >> U64(30)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


class _Powers:
    def __init__(self) -> None:
        self.up, self.down = np.ones(1, U64), np.ones(1, U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            inverse = pow(_BASE, -1, 1 << 64)
            self.up = np.full(n, _BASE & (2**64 - 1), U64)
            self.down = np.full(n, inverse, U64)
            self.up[0] = self.down[0] = 1
            np.multiply.accumulate(self.up, out=self.up)
            np.multiply.accumulate(self.down, out=self.down)
        return self.up, self.down


POWERS = _Powers()


class Words:
    """The words of documents i..j: maximal runs of bytes other than ASCII white space.

    start, end: byte positions in `data`; doc: number of the document from i;
    hash: 64-bit hash of the word with A-Z lowered; first: index of each
    document's first word, with the total at the end.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, i: int, j: int) -> None:
        lo, hi = int(offsets[i]), int(offsets[j])
        self.data = d = data[lo:hi]
        bounds = offsets[i : j + 1] - lo
        inside = ~_SPACES[d]
        edge = np.zeros(len(d) + 1, bool)
        edge[bounds] = True
        begins, stops = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1] | edge[1:-1]
        stops[:-1] &= ~inside[1:] | edge[1:-1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.start, bounds)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(j - i), self.count)
        up, down = POWERS.get(len(d) + 1)
        total = np.zeros(len(d) + 1, U64)
        np.cumsum(LOWERED_VALUE[d] * up[: len(d)], out=total[1:])
        h = (total[self.end] - total[self.start]) * down[self.start]
        self.hash = mix(h + (self.end - self.start).astype(U64))

    def text(self, k: int) -> bytes:
        return LOWER[self.data[self.start[k] : self.end[k]]].tobytes()


LOWERED_VALUE = BYTE_VALUE[LOWER]


def ngrams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each document's n-word shingles, and their documents.

    A document of 1 to n-1 words has one shingle of all its words; one without
    words has none.
    """
    h, m = words.hash, len(words.hash)
    short = (words.count > 0) & (words.count < n)
    out, doc = np.zeros(0, U64), np.zeros(0, np.int64)
    if m >= n:
        g = h[: m - n + 1].copy()
        for k in range(1, n):
            g *= U64(0x9FB21C651E98DF25)
            g ^= g >> U64(29)
            g += h[k : m - n + 1 + k]
        whole = words.doc[: m - n + 1] == words.doc[n - 1 :]
        out, doc = mix(g[whole]), words.doc[: m - n + 1][whole]
    if short.any():
        some = np.flatnonzero(short)
        extra = np.zeros(len(some), U64)
        for x, k in enumerate(some):
            g = h[words.first[k]]
            with np.errstate(over="ignore"):
                for y in h[words.first[k] + 1 : words.first[k + 1]]:
                    g = g * U64(0x9FB21C651E98DF25)
                    g = (g ^ (g >> U64(29))) + y
            extra[x] = g
        out, doc = np.concatenate([out, mix(extra)]), np.concatenate([doc, some])
        order = np.argsort(doc, kind="stable")
        out, doc = out[order], doc[order]
    return out, doc
