"""Captures read in ranges against one sequential read, records of messages, and captures written and read back."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from tidewarden.sources import capture_source, captures, common
from tidewarden.streaming import live


def name(text):
    return b"".join(bytes([len(x)]) + x.encode() for x in text.split(".") if x) + b"\0"


def message(question, kind=1, answers=(), authority=(), extra=(), response=True):
    head = struct.pack("!6H", 7, 0x8180 if response else 0x0100, 1, len(answers), len(authority), len(extra))
    return head + name(question) + struct.pack("!2H", kind, 1) + b"".join([*answers, *authority, *extra])


def record(kind, ttl, data, owner=b"\xc0\x0c"):
    return owner + struct.pack("!2HIH", kind, 1, ttl, len(data)) + data


def packet(payload, port=53):
    return struct.pack("!BBHHHBBH4s4s", 0x45, 0, 28 + len(payload), 0, 0, 64, 17, 0, b"\x0a\0\0\1", b"\xc0\0\2\x35") + struct.pack("!4H", 4000, port, 8 + len(payload), 0) + payload


def pcap(frames, order="<", magic=0xA1B2C3D4, snap=65535):
    return struct.pack(f"{order}IHHiIII", magic, 2, 4, 0, 0, snap, 101) + b"".join(struct.pack(f"{order}4I", 1_700_000_000 + i, i * 7 % 1_000_000, len(f), len(f)) + f for i, f in enumerate(frames))


def frames(rng, n, ending=b"-"):
    """DNS, other packets, noise, and packets that hold a capture of their own, which ends before the packet does, or with it."""
    inner = pcap([packet(message("inner.example")) for _ in range(5)])
    out = []
    for i in range(n):
        dns = packet(message(f"n{i}.example.com", answers=[record(1, i, b"\1\2\3\4")] * (i % 2), response=bool(i % 2)))
        out.append(rng.choice([dns, dns, dns, packet(b"x" * rng.randint(0, 900), 80), packet(inner + inner[24:] * 20 + ending, 80), rng.randbytes(rng.randint(0, 300)), b""]))
    return out


def plain(path):
    return [r[2:9] for r in captures.decode("", path.read_bytes())]


@pytest.mark.parametrize(("order", "cut", "step"), [("<", 0, 5000), (">", 0, 100_000), ("<", 5, 3001)])
def test_ranges_equal_one_read(spark, tmp_path, order, cut, step):
    raw = pcap(frames(random.Random(step), 600), order)
    path = tmp_path / "a.pcap"
    path.write_bytes(raw[: len(raw) - cut])
    rows = capture_source.read_questions(spark, str(path), step)
    assert rows.rdd.getNumPartitions() == -(-(len(raw) - cut) // step)
    got = sorted(rows.collect(), key=lambda r: r.seq)
    assert [tuple(r)[2:9] for r in got] == plain(path) and len({r.seq for r in got}) == len(got)
    assert [tuple(r) for r in sorted(capture_source.read_questions(spark, str(path), 0).collect(), key=lambda r: r.seq)] == [tuple(r) for r in got]


def test_captures_inside_packets(spark, tmp_path):
    """Records inside a packet that end where it ends look like the file's own; such a read fails, and a checked one is right."""
    path = tmp_path / "a.pcap"
    path.write_bytes(pcap(frames(random.Random(5000), 600, b"")))
    with pytest.raises(Exception, match="rangeBytes 0"):
        capture_source.read_questions(spark, str(path), 5000).count()
    assert capture_source.borders(spark, str(path), 5000).where("first <> expected").count() > 0
    got = sorted(capture_source.read_questions(spark, str(path), 5000, checked=True).collect(), key=lambda r: r.seq)
    assert [tuple(r)[2:9] for r in got] == plain(path)
    assert capture_source.read_records(spark, str(path), 5000, checked=True).count() == sum(len(captures.records(m[0])) for m in map(lambda f: captures.message_of(*captures.ip_packet(f[0], f[1])), captures.libpcap(path.read_bytes())) if m)


def test_files_of_all_kinds(spark, tmp_path):
    (tmp_path / "short.pcap").write_bytes(b"abc")
    (tmp_path / "other.bin").write_bytes(b"x" * 100)
    (tmp_path / "_skipped").write_bytes(b"x" * 100)
    (tmp_path / "none.pcap").write_bytes(b"")
    block = lambda kind, body: struct.pack("<2I", kind, 12 + len(body)) + body + struct.pack("<I", 12 + len(body))
    one = packet(message("ng.example"))
    held = one + b"\0" * (-len(one) % 4)
    ng = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack("<HHI", 101, 0, 0)) + block(6, struct.pack("<5I", 0, 0, 0, len(one), len(one)) + held)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.pcapng").write_bytes(ng * 40)
    rows = capture_source.read_questions(spark, str(tmp_path), 100).collect()
    assert sorted((r.path.rsplit("/", 1)[1], r.error) for r in rows if r.error) == [("none.pcap", "TOO_SHORT"), ("other.bin", "UNKNOWN_FORMAT"), ("short.pcap", "TOO_SHORT")]
    assert [r.domain for r in rows if not r.error] == ["ng.example"] * 40
    assert common.capture_errors(spark, str(tmp_path)).count() == 3
    (tmp_path / "empty").mkdir()
    assert capture_source.read_questions(spark, str(tmp_path / "empty")).count() == 0


def test_records_of_a_message():
    soa = b"\2ns\xc0\x0c" + name("post.example") + struct.pack("!5I", 1, 2, 3, 4, 5)
    answers = [record(1, 60, b"\1\2\3\4"), record(28, 2**31, b"\0" * 15 + b"\1"), record(15, 5, b"\0\7\4mail\xc0\x0c"), record(16, 9, b'\3a"b\2cd'), record(5, 1, name("other.example"))]
    got = captures.records(message("asked.example", answers=answers, authority=[record(6, 30, soa)], extra=[record(41, 0, b"", b"\0"), record(65, 8, b"\1\2")]))
    assert got == [
        ("answer", "asked.example", "A", 1, 60, "1.2.3.4"), ("answer", "asked.example", "AAAA", 1, 0, "::1"), ("answer", "asked.example", "MX", 1, 5, "7 mail.asked.example"),
        ("answer", "asked.example", "TXT", 1, 9, r'"a\"b" "cd"'), ("answer", "asked.example", "CNAME", 1, 1, "other.example"), ("authority", "asked.example", "SOA", 1, 30, "ns.asked.example post.example 1 2 3 4 5"),
        ("additional", "asked.example", "HTTPS", 1, 8, "0102"),
    ]
    whole = message("asked.example", answers=answers)
    assert all(captures.records(whole[:n]) == [] for n in range(len(whole)))  # broken anywhere: none
    assert captures.records(message("a.example", answers=[record(1, 5, b"\1\2\3")])) == [] and captures.records(message("a.example")) == []


def test_lifetimes_and_the_cache(spark, tmp_path):
    """Answers are kept for the shortest of their living sets, and questions within that time are hits."""
    start = 1_700_000_000
    sent = [(0, [record(1, 40, b"\1\2\3\4"), record(5, 0, name("x.example"))]), (30, [record(1, 40, b"\1\2\3\4")]), (50, [record(1, 0, b"\1\2\3\4"), record(1, 9, b"\1\2\3\5")]), (55, []), (60, [record(1, 900, b"\1\2\3\4")]), (500, [])]
    rows = [(float(start + t), bytearray(packet(message("Name.example", answers=a)))) for t, a in sent]
    path = str(tmp_path / "out")
    capture_source.write_packets(spark.createDataFrame(rows, capture_source.PACKETS).coalesce(1), path)
    capture_source.write_packets(spark.createDataFrame(rows[:0], capture_source.PACKETS), path)
    kept = capture_source.answer_ttls(capture_source.read_records(spark, path))
    queries = common.cache_queries(capture_source.read_questions(spark, path), kept)
    assert [r.ttl for r in queries.orderBy("ts").collect()] == [40, 40, None, None, 300, None]
    arriving = str(tmp_path / "arriving")
    queries.coalesce(1).write.parquet(arriving)
    stream = live.cache_hits(live.event_stream(spark, arriving, queries.schema))
    stream.writeStream.format("memory").queryName("hits").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(200)
    hits = queries.join(spark.table("hits").select("id", "cache_hit"), "id").orderBy("ts").collect()
    assert [r.cache_hit for r in hits] == [False, True, False, False, False, False]


def test_written_captures_come_back(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.range(1000).select((F.col("id") + 0.25).alias("timestamp"), F.lit(packet(message("w.example", 16))).alias("packet"))
    capture_source.write_packets(rows.repartition(3), path)
    got = capture_source.read_questions(spark, path, 4096).collect()
    assert sorted(r.timestamp for r in got) == [i + 0.25 for i in range(1000)] and {(r.domain, r.query_type) for r in got} == {("w.example", "TXT")}
    with pytest.raises(Exception, match="append"):
        rows.write.format(capture_source.FORMAT).option("path", path).mode("overwrite").save()
