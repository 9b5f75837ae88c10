import struct

from sluiceway.queries import SELECTORS
from sluiceway.sources.config import parse_config
from sluiceway.sources.pcap import frames, payloads, read_captures, read_packets
from sluiceway.streaming.route import deliveries, route_lines


def ip(body, protocol, source="10.0.0.7"):
    return struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(body), 0, 0, 64, protocol, 0, bytes(map(int, source.split("."))), bytes([10, 0, 0, 1])) + body


def udp(text, port=514):
    return ip(struct.pack(">HHHH", 999, port, 8 + len(text), 0) + text, 17)


def tcp(text, port=601):
    return ip(struct.pack(">HHIIBBHHH", 999, port, 0, 0, 0x50, 0, 0, 0, 0) + text, 6)


def ethernet(packet, vlan=False):
    return bytes(12) + (b"\x81\x00\x00\x05" if vlan else b"") + b"\x08\x00" + packet


def classic(packets, order="<", link=1):
    out = struct.pack(order + "IHHIIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, link)
    return out + b"".join(struct.pack(order + "IIII", 1700000000, 5000, len(p), len(p)) + p for p in packets)


def blocks(packets, order="<"):
    block = lambda kind, body: struct.pack(order + "II", kind, len(body) + 12) + body + struct.pack(order + "I", len(body) + 12)
    out = block(0x0A0D0D0A, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack(order + "HHI", 12, 0, 0))
    for p in packets:
        out += block(6, struct.pack(order + "IIIII", 0, 1, 5000, len(p), len(p)) + p + bytes(-len(p) % 4))
    return out


def texts(data):
    return [(x[2], x[4], x[5]) for x in payloads(data)]


def test_datagrams_and_streams():
    packets = [ethernet(udp(b"<13>a")), ethernet(tcp(b"<13>one\n<13>t")), ethernet(tcp(b"wo\n5 <1>ab3 xyz4 ab"), vlan=True), ethernet(tcp(b"web", 80)), ethernet(udp(b"dns", 53))]
    want = [("udp", 514, b"<13>a"), ("tcp", 601, b"<13>one"), ("tcp", 601, b"<13>two"), ("tcp", 601, b"<1>ab"), ("tcp", 601, b"xyz"), ("udp", 53, b"dns"), ("tcp", 601, b"4 ab")]
    assert texts(classic(packets)) == want and texts(classic(packets, ">")) == want


def test_damage_and_formats():
    whole = classic([ethernet(udp(b"x")), ethernet(udp(b"y"))])
    assert [t for *_, t in texts(whole[:-3])] == [b"x"]
    assert texts(b"") == texts(b"no capture at all") == []
    for order in "<>":
        found = list(frames(blocks([udp(b"q")], order)))
        assert len(found) == 1 and found[0][:2] == (((1 << 32) + 5000) // 1000, 12)
        assert texts(blocks([udp(b"q")], order)) == [("udp", 514, b"q")]


def test_files(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(classic([ethernet(udp(b"<34>Oct  1 22:14:15 mymachine su[7]: failed")), ethernet(tcp(b"<13>late\n")), ethernet(udp(b"z", 53))]))
    assert read_packets(spark, str(tmp_path)).count() == 3
    rows = {r.programname: r for r in read_captures(spark, str(tmp_path)).collect()}
    assert len(rows) == 2 and rows["su"].hostname == rows["su"].fromhost == "mymachine" and rows["su"].fromhost_ip == "10.0.0.7"
    assert rows[None].transport == "tcp" and rows[None].fromhost == "10.0.0.7" and rows[None].msg == "late"
    assert {r.transport for r in read_captures(spark, str(tmp_path), strict=True).collect()} == {"udp"}


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("<3>Jan  2 03:04:05 h kernel: up\n\n<15>Jan  2 03:04:05 h app: dbg\n")
    routed = deliveries(route_lines(spark.readStream.text(str(tmp_path / "in")), parse_config(SELECTORS, {})))
    run = routed.writeStream.format("memory").queryName("routed_lines").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination(60)
    got = {tuple(r) for r in spark.table("routed_lines").collect()}
    assert got == {("omfile", "/var/log/kern.log", "up"), ("omfile", "/var/log/messages", "up"), ("omfile", "/var/log/debug.log", "dbg")}
