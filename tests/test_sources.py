import datetime
import struct

import pytest

from tidewarden.plans.analysis import analyze
from tidewarden.sources import event_store
from tidewarden.sources.captures import questions, read_captures
from tidewarden.sources.zeek import read_zeek, zeek_errors
from tidewarden.streaming import live

HEADER = "#separator \\x09\n#set_separator\t,\n#empty_field\t(empty)\n#unset_field\t-\n#path\t{log}\n#fields\t{fields}\n"


def test_zeek_logs(spark, tmp_path):
    first = HEADER.format(log="dns", fields="ts\tid.orig_h\tquery\tqtype_name\trcode_name")
    second = HEADER.format(log="dns", fields="query\tqtype\torig_h")
    (tmp_path / "a.log").write_text(first + "1.5\t10.0.0.1\ta.example.\tAAAA\tNOERROR\n-\t-\tb.example\t-\t-\nx\t10.0.0.2\t(empty)\tA\t-\n2\t1.1.1.1\t-\tA\t-\n" + second + "c.example\t28\t10.0.0.3\n")
    (tmp_path / "b.log").write_text(HEADER.format(log="conn", fields="ts\tuid") + "1\tx\n")
    (tmp_path / "c.log").write_text('{"query": "a.example"}\n')
    (tmp_path / "d.log").write_text("no header\n")
    (tmp_path / "e.log").write_text("")
    (tmp_path / "f.log").write_text("#separator ;\n#path;dns\n#fields query;ts\nd.example;oops\n")
    got = sorted((r.domain, r.query_type, r.source_ip, r.timestamp, r.rcode) for r in read_zeek(spark, str(tmp_path)).collect())
    assert got == [
        ("a.example", "AAAA", "10.0.0.1", 1.5, "NOERROR"), ("b.example", "A", None, None, None), ("c.example", "28", "10.0.0.3", None, None), ("d.example", "A", None, None, None)
    ]
    errors = {r.path[-5:]: r.error for r in zeek_errors(spark, str(tmp_path)).collect()}
    assert errors == {"b.log": "NOT_A_DNS_LOG", "c.log": "JSON_NOT_SUPPORTED", "d.log": "NO_FIELDS_HEADER"}


def name(text: str) -> bytes:
    return b"".join(bytes([len(x)]) + x.encode() for x in text.split(".")) + b"\0"


def message(text: str, kind: int = 1, response: bool = False) -> bytes:
    return struct.pack("!6H", 7, 0x8000 if response else 0, 1, 0, 0, 0) + name(text) + struct.pack("!2H", kind, 1)


def ip4(payload: bytes, protocol: int = 17) -> bytes:
    return struct.pack("!BBHHHBBH4s4s", 0x45, 0, 20 + len(payload), 0, 0, 64, protocol, 0, bytes([10, 0, 0, 1]), bytes([10, 0, 0, 2])) + payload


def udp(payload: bytes, port: int = 53) -> bytes:
    return struct.pack("!4H", 4000, port, 8 + len(payload), 0) + payload


def tcp(payload: bytes) -> bytes:
    return struct.pack("!2H2IBBHHH", 4000, 53, 0, 0, 0x50, 0, 0, 0, 0) + struct.pack("!H", len(payload)) + payload


def ethernet(packet: bytes, *tags: int, kind: int = 0x0800) -> bytes:
    return bytes(12) + b"".join(struct.pack("!2H", t, 1) for t in tags) + struct.pack("!H", kind) + packet


def pcap(frames: list[bytes], order: str = "<", magic: int = 0xA1B2C3D4, link: int = 1) -> bytes:
    head = struct.pack(f"{order}IHHiIII", magic, 2, 4, 0, 0, 65535, link)
    return head + b"".join(struct.pack(f"{order}4I", 5, 500_000, len(f), len(f)) + f for f in frames)


def ng(frames: list[bytes]) -> bytes:
    def block(kind: int, body: bytes) -> bytes:
        body += bytes(-len(body) % 4)
        return struct.pack("<2I", kind, 12 + len(body)) + body + struct.pack("<I", 12 + len(body))

    out = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack("<HHI", 101, 0, 0))
    return out + b"".join(block(6, struct.pack("<5I", 0, 0, 0, len(f), len(f)) + f) for f in frames)


def test_captures(spark, tmp_path):
    ip6 = struct.pack("!IHBB16s16s", 6 << 28, 0, 17, 64, bytes(15) + b"\1", bytes(15) + b"\2") + udp(message("six.example", 28))
    frames = [ethernet(ip4(udp(message("a.example")))), ethernet(ip4(udp(message("b.example", 16, True))), 0x88A8, 0x8100), ethernet(ip4(udp(b"junk", 80))), ethernet(ip4(tcp(message("t.example", 9999)), 6)), ethernet(ip6, kind=0x86DD)]
    (tmp_path / "a.pcap").write_bytes(pcap(frames) + b"\0" * 20)
    (tmp_path / "b.pcap").write_bytes(pcap(frames[:1], ">", 0xA1B23C4D))
    (tmp_path / "c.pcapng").write_bytes(ng([ip4(udp(message("ng.example")))]))
    (tmp_path / "d.pcap").write_bytes(b"nothing that is known here")
    (tmp_path / "e.pcap").write_bytes(b"")
    rows = read_captures(spark, str(tmp_path), max_bytes=10_000, rows=2).collect()
    got = sorted((r.path[-6:], r.seq, r.domain, r.query_type, r.source_ip, r.transport, r.timestamp, r.is_response) for r in rows if not r.error)
    assert got == [
        ("a.pcap", 0, "a.example", "A", "10.0.0.1", "udp", 5.5, False), ("a.pcap", 1, "b.example", "TXT", "10.0.0.1", "udp", 5.5, True),
        ("a.pcap", 2, "t.example", "TYPE9999", "10.0.0.1", "tcp", 5.5, False), ("a.pcap", 3, "six.example", "AAAA", "0:0:0:0:0:0:0:1", "udp", 5.5, False),
        ("b.pcap", 0, "a.example", "A", "10.0.0.1", "udp", 5.0005, False), ("pcapng", 0, "ng.example", "A", "10.0.0.1", "udp", None, False),
    ]
    assert {r.path[-6:]: r.error for r in rows if r.error} == {"d.pcap": "UNKNOWN_FORMAT"}
    assert {r.error for r in read_captures(spark, str(tmp_path / "a.pcap"), max_bytes=10).collect()} == {"TOO_LARGE"}


@pytest.mark.parametrize("tail", [b"\xc0\x0c\0\1\0\1", b"\xc0\xff\0\1\0\1", b"\x3fabc", b""])
def test_broken_names(tail):
    assert questions(struct.pack("!6H", 1, 0, 1, 0, 0, 0) + tail) == []


def test_names_are_escaped():
    assert questions(message("a b.x@y"))[0][0] == r"a\032b.x\@y"


def test_event_store(spark, tmp_path):
    path = str(tmp_path / "events")
    judged = analyze(spark.createDataFrame([("good.example", "A", "10.0.0.1"), ("..", "A", None)], "raw string, query_type string, client_address string"))
    rows = event_store.answered(event_store.decisions(judged, dns=True))
    event_store.append(rows, path, 0)
    event_store.append(rows, path, 1)
    event_store.append(rows, path, 1)  # a retry
    got = event_store.read(spark, path).collect()
    assert [(r.domain, r.event_type, r.client_address, r.cache_hit) for r in got] == [("good.example", "dns", "10.0.0.1", False)] * 2
    assert len({r.id for r in got}) == 2
    assert event_store.clear(spark, path) == 2
    assert event_store.read(spark, path).count() == 0


def test_streams(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    asked = [(i, t + datetime.timedelta(seconds=s), n, "A", "IN", ttl, d) for i, (s, n, ttl, d) in enumerate([(0, "a.x", 60, "ALLOW"), (30, "A.x.", 60, "ALLOW"), (61, "a.x", 0, "BLOCK"), (62, "a.x", 9, "ALLOW"), (5000, "b.x", None, "ALLOW")])]
    schema = "id long, ts timestamp, domain string, query_type string, query_class string, ttl long, decision string"
    spark.createDataFrame(asked, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    events = lambda: live.event_stream(spark, str(tmp_path / "in"), schema)

    def run(df, mode: str, into: str):
        query = df.writeStream.format("memory").queryName(into).outputMode(mode).trigger(availableNow=True).start()
        query.awaitTermination(120)
        query.stop()
        return spark.table(into).collect()

    hours = run(live.hourly_activity(live.once(events()), "decision", ["ALLOW", "BLOCK"], None), "append", "hours")
    assert ("2024-01-01T00:00:00Z", 3, 1) in [tuple(r) for r in hours]
    assert {r.id: r.cache_hit for r in run(live.cache_hits(events()), "append", "hits")} == {0: False, 1: True, 2: False, 3: False, 4: False}
    event_store.stream_into(events(), str(tmp_path / "out"), str(tmp_path / "cp"), availableNow=True).awaitTermination(120)
    assert event_store.read(spark, str(tmp_path / "out")).count() == 5
