import random

from sluiceway.sources.pcap import payloads, read_packets
from sluiceway.sources.streams import cut, reassembled
from tests.test_captures import classic, ethernet, ip, tcp, udp


def test_cut():
    assert cut(b"") == ([], b"")
    assert cut(b"a\nb") == ([b"a"], b"b")
    assert cut(b"3 a\nb0 2 xy\n7") == ([b"a\nb", b"", b"xy", b""], b"7")
    assert cut(b"9" * 5000 + b" x\n") == ([], b"9" * 5000 + b" x\n")
    assert cut(b"000003 abc12") == ([b"abc"], b"12")
    assert cut(b"abcd", limit=3) == ([], b"")


def plain(rows, limit):
    """Streams in one pass over all rows in order."""
    out, open_ = [], {}
    for name, k, text in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2] or b"")):
        if name is None:
            out.append((None, k, text))
            continue
        found, left = cut(open_.get(name, (b"", 0))[0] + (text or b""), limit)
        if text:
            open_[name] = (left, k)
        out += [(name, k, t) for t in found]
    return sorted(out + [(n, k, left) for n, (left, k) in open_.items() if left.strip()], key=repr)


def test_many_streams_over_many_tasks(spark):
    rnd = random.Random(5)
    rows = []
    for name in ["hot"] * 8 + ["a", "b", "c", None]:
        bits = [rnd.choice([b"<13>x y\n", b"5 ab\ncd", b"\n", b"  ", b"12 ", b"long" * 9 + b"\n", None, b"", b"\xff\n", b"7"]) for _ in range(60)]
        rows += [(name, rnd.randrange(400), bit) for bit in bits]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for size, limit in ((old, 1_000_000), ("3", 1_000_000), ("1", 20)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        segments = spark.createDataFrame(rows, "`a.b` string, `my k` long, data binary").repartition(7)
        got = reassembled(segments, "a.b", ["my k"], "data", limit).collect()
        assert sorted(((r[0], r[1], None if r[2] is None else bytes(r[2])) for r in got), key=repr) == plain(rows, limit)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_empty_table(spark):
    assert reassembled(spark.createDataFrame([], "s int, k int, data binary"), "s", ["k"], "data").collect() == []


def test_streams_of_a_capture_are_dealt(spark, tmp_path):
    packets = [ethernet(udp(b"<13>d")), ethernet(tcp(b"\xff<13>one\n<1")), ethernet(ip(tcp(b"<9>other", 514)[20:], 6, "10.0.0.9")), ethernet(tcp(b"3>two\n4 tail")), ethernet(ip(tcp(b" host\n", 514)[20:], 6, "10.0.0.9")), ethernet(tcp(b" x"))]
    want = []
    for name, some in (("a", packets), ("b", packets[:3])):
        (tmp_path / f"{name}.pcap").write_bytes(classic(some))
        want += [(name, *row[:-1], row[-1].decode("utf-8", "replace")) for row in payloads(classic(some))]
    rows = read_packets(spark, str(tmp_path))
    got = [(r.path[-6], r.packet, r.time_ms, r.transport, r.src_ip, r.port, r.payload) for r in rows.collect()]
    assert sorted(got) == sorted(want) and len(want) == 10
    assert "hashpartitioning(" in rows._jdf.queryExecution().toString()
