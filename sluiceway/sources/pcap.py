"""Packet captures: the log messages in UDP datagrams and TCP streams.

A file is cut into packets by one task; many files are read side by side.  The
streams in them are dealt to all tasks.  Damaged files give the packets before
the damage.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluiceway.sources.messages import decode_line
from sluiceway.sources.streams import cut, reassembled

#: Ports of log traffic.
PORTS = (514, 6514, 601)
#: Packets that leave the reader at a time.
BATCH = 4096
#: Link types, file magics and block types of the capture formats.
ETHERNET, RAW, COOKED = 1, (12, 101), 113
CLASSIC = {b"\xd4\xc3\xb2\xa1": "<", b"\xa1\xb2\xc3\xd4": ">"}
SECTION, INTERFACE, SIMPLE, ENHANCED = 0x0A0D0D0A, 1, 3, 6

SCHEMA = "path string, packet long, time_ms long, transport string, src_ip string, port int, flow binary, payload binary"


def frames(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """Time in milliseconds, link type and bytes of each packet."""
    if order := CLASSIC.get(data[:4]):
        if len(data) < 24:
            return
        link, at = struct.unpack_from(order + "I", data, 20)[0], 24
        while at + 16 <= len(data):
            seconds, micros, size = struct.unpack_from(order + "III", data, at)
            if at + 16 + size > len(data):
                return
            yield seconds * 1000 + micros // 1000, link, data[at + 16 : at + 16 + size]
            at += 16 + size
        return
    order, links, at = "<", [], 0
    while at + 12 <= len(data):
        if data[at : at + 4] == b"\x0a\x0d\x0d\x0a":
            order, links = ("<" if data[at + 8 : at + 12] == b"\x4d\x3c\x2b\x1a" else ">"), []
        kind, size = struct.unpack_from(order + "II", data, at)
        if size < 12 or at + size > len(data) or (at == 0 and kind != SECTION):
            return
        body = data[at + 8 : at + size - 4]
        if kind == INTERFACE and len(body) >= 2:
            links.append(struct.unpack_from(order + "H", body)[0])
        elif kind == ENHANCED and len(body) >= 20:
            which, high, low, kept = struct.unpack_from(order + "IIII", body)
            if which < len(links):
                yield ((high << 32) + low) // 1000, links[which], body[20 : 20 + kept]
        elif kind == SIMPLE and links and len(body) >= 4:
            yield 0, links[0], body[4 : 4 + struct.unpack_from(order + "I", body)[0]]
        at += size


def _network(link: int, frame: bytes) -> bytes:
    """The IPv4 packet of a frame, or nothing."""
    if link == ETHERNET:
        at = 16 if frame[12:14] == b"\x81\x00" else 12
        return frame[at + 2 :] if frame[at : at + 2] == b"\x08\x00" else b""
    if link == COOKED:
        return frame[16:] if frame[14:16] == b"\x08\x00" else b""
    return frame if link in RAW else b""


def segments(data: bytes) -> Iterator[tuple[int, int, str, str, int, bytes | None, bytes]]:
    """Packet number, time, transport, source address, port, flow (null for datagrams) and bytes of each packet of a file that may hold messages."""
    for number, (time, link, frame) in enumerate(frames(data), 1):
        ip = _network(link, frame)
        if len(ip) < 20 or ip[0] >> 4 != 4:
            continue
        head, total, source = (ip[0] & 15) * 4, struct.unpack_from(">H", ip, 2)[0], ".".join(map(str, ip[12:16]))
        body = ip[head : total or len(ip)]
        if ip[9] == 17 and len(body) >= 8:
            port, size = struct.unpack_from(">HH", body, 2)
            yield number, time, "udp", source, port, None, body[8 : max(size, 8)]
        elif ip[9] == 6 and len(body) >= 20:
            port = struct.unpack_from(">H", body, 2)[0]
            text = body[(body[12] >> 4) * 4 :]
            if port in PORTS and text:
                yield number, time, "tcp", source, port, ip[12:20] + body[:4], text


def payloads(data: bytes) -> Iterator[tuple[int, int, str, str, int, bytes]]:
    """Packet number, time, transport, source address, port and text of each message of one small capture at hand."""
    streams: dict[bytes, tuple[bytes, tuple]] = {}
    for *about, flow, text in segments(data):
        if flow is None:
            yield (*about, text)
            continue
        found, left = cut(streams.get(flow, (b"",))[0] + text)
        streams[flow] = (left, about)
        yield from ((*about, x) for x in found)
    yield from ((*about, left) for left, about in streams.values() if left.strip())


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            rows = ((path, *row) for row in segments(bytes(content)))
            while some := list(islice(rows, BATCH)):
                yield pd.DataFrame(some, columns=["path", "packet", "time_ms", "transport", "src_ip", "port", "flow", "payload"])


def read_packets(spark: SparkSession, path: str) -> DataFrame:
    """One row a message of the capture files at path, whatever its port."""
    packets = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(_read, SCHEMA)
    flows = packets.withColumn("flow", F.when(F.col("flow").isNotNull(), F.struct("path", "flow")))
    messages = reassembled(flows, "flow", ["packet"], "payload")
    return messages.drop("flow").withColumn("payload", F.make_valid_utf8(F.col("payload").cast("string")))


def read_captures(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Messages of the capture files at path that were sent to a log port.

    strict: all messages count as udp, also those of streams.
    """
    kept = read_packets(spark, path).filter(F.col("port").isin(*PORTS)).withColumn("_m", decode_line(F.trim("payload")))
    transport = F.lit("udp") if strict else F.col("transport")
    return kept.select("path", "packet", F.timestamp_millis("time_ms").alias("sim_time"), transport.alias("transport"), "port", F.col("src_ip").alias("fromhost_ip"), F.coalesce("_m.hostname", "src_ip").alias("fromhost"), "_m.*")
