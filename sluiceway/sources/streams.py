"""Messages out of byte streams, by octet count or by line.

Segments are shuffled by their stream and sorted within the tasks.  A task reads
them batch by batch and carries on what is unfinished: it holds one batch and one
unfinished message, however long a stream is.  Where a message begins depends on
all that came before, so one stream is one task's; different streams, also those
of one capture, are read side by side.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the longest unfinished text that is kept.
MAX_PENDING = 1_000_000
_COUNTED = re.compile(rb"0*(\d{0,18}) ")
_DIGITS = re.compile(rb"\d+ ")


def cut(pending: bytes, limit: int = MAX_PENDING) -> tuple[list[bytes], bytes]:
    """Whole messages at the start of a stream and what is left: a count of octets and a blank come before a message, or a line end after it."""
    out, at = [], 0
    while at < len(pending):
        if _DIGITS.match(pending, at):
            m = _COUNTED.match(pending, at)
            end = m.end() + int(m[1] or 0) if m else len(pending) + 1
            if end > len(pending):
                break
            out.append(pending[m.end() : end])
        else:
            end = pending.find(b"\n", at) + 1
            if not end:
                break
            out.append(pending[at : end - 1])
        at = end
    left = pending[at:]
    return out, left if len(left) <= limit else b""


def _reader(stream: int, data: int, limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(batch: pa.RecordBatch, at: list[int], texts: list[bytes | None]) -> pa.RecordBatch:
            columns = batch.take(pa.array(at, pa.int32())).columns
            columns[data] = pa.array(texts, batch.schema.field(data).type)
            return pa.RecordBatch.from_arrays(columns, schema=batch.schema)

        here, pending, last = None, b"", None
        for batch in batches:
            at, found, place = [], [], None
            for k, (name, text) in enumerate(zip(batch.column(stream).to_pylist(), batch.column(data).to_pylist())):
                if name is None:
                    at.append(k)
                    found.append(text)
                    continue
                if name != here:
                    if pending.strip() and place is None:
                        yield rows(last, [0], [pending])
                    elif pending.strip():
                        at.append(place)
                        found.append(pending)
                    here, pending = name, b""
                if text:
                    messages, pending = cut(pending + text, limit)
                    at += [k] * len(messages)
                    found += messages
                    place = k
            if place is not None:
                last = batch.slice(place, 1)
            yield rows(batch, at, found)
        if pending.strip():
            yield rows(last, [0], [pending])

    return read


def reassembled(segments: DataFrame, stream: str, order: list[str], data: str, limit: int = MAX_PENDING) -> DataFrame:
    """The columns of segments, one row a message: data is its text, the others are those of the segment that it ends in.

    stream tells streams apart and may be of any type; rows without one are
    messages as they are.  Segments of a stream follow one another by order, those
    that tie by their bytes.  Null or empty data add nothing.  What a stream leaves
    unfinished is a message too, unless it is blank; more than `limit` unfinished
    bytes after a segment are dropped, as a sender that ends no message would
    fill the memory.  data is binary.
    """
    names = segments.columns
    at = lambda c: F.col(f"_{names.index(c)}")
    rows = segments.toDF(*(f"_{k}" for k in range(len(names))))
    alone = F.when(at(stream).isNull(), F.xxhash64(*map(at, order)))
    dealt = rows.repartition(at(stream), alone).sortWithinPartitions(*map(at, (stream, *order, data)))
    return dealt.mapInArrow(_reader(names.index(stream), names.index(data), limit), rows.schema).toDF(*names)
