"""DNS questions of packet captures: Spark reads the files, each row's bytes are decoded where they are.

A capture is one row, so it must fit a task; rotating captures keep them small. Bytes that aren't DNS are skipped, a file
that is no capture becomes one row with its error.
"""

from __future__ import annotations

import ipaddress
import re
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, seq long, domain string, query_type string, source_ip string, dest_ip string, transport string, timestamp double, is_response boolean, error string"

# Link types, and how many bytes stand before the IP packet, with the place of its ethertype.
ETHERNET, NULL_LINK, RAW_LINKS = 1, 0, (101, 228, 229)
ETHERTYPE_AT = {ETHERNET: (12, 14), 113: (14, 16), 276: (0, 20)}
VLAN_TAGS, IP_ETHERTYPES = (0x8100, 0x88A8, 0x9100), {0x0800: 4, 0x86DD: 6}
NULL_FAMILIES = {2: 4, 24: 6, 28: 6, 30: 6}
#: First bytes of a libpcap file: byte order, and parts of a second.
MAGICS = {b"\xd4\xc3\xb2\xa1": ("<", 1e6), b"\x4d\x3c\xb2\xa1": ("<", 1e9), b"\xa1\xb2\xc3\xd4": (">", 1e6), b"\xa1\xb2\x3c\x4d": (">", 1e9)}
NG_MAGIC, NG_ORDERS = b"\x0a\x0d\x0d\x0a", {b"\x4d\x3c\x2b\x1a": "<", b"\x1a\x2b\x3c\x4d": ">"}
TYPES = {
    1: "A", 2: "NS", 5: "CNAME", 6: "SOA", 10: "NULL", 12: "PTR", 13: "HINFO", 15: "MX", 16: "TXT", 28: "AAAA", 33: "SRV", 35: "NAPTR", 39: "DNAME",
    43: "DS", 46: "RRSIG", 47: "NSEC", 48: "DNSKEY", 50: "NSEC3", 52: "TLSA", 64: "SVCB", 65: "HTTPS", 99: "SPF", 251: "IXFR", 252: "AXFR", 255: "ANY", 257: "CAA",
}

Packet = tuple[bytes, int, float | None]


class NoCapture(ValueError):
    """The bytes are in no format that is known here."""


def libpcap(data: bytes) -> Iterator[Packet]:
    if len(data) < 24:
        raise NoCapture("TOO_SHORT")
    if data[:4] not in MAGICS:
        raise NoCapture("UNKNOWN_FORMAT")
    order, parts = MAGICS[data[:4]]
    (link,) = struct.unpack_from(f"{order}I", data, 20)
    record, at = struct.Struct(f"{order}4I"), 24
    while at + record.size <= len(data):
        seconds, part, size, _ = record.unpack_from(data, at)
        at += record.size
        if at + size > len(data):  # cut off
            return
        yield data[at : at + size], link, seconds + part / parts
        at += size


def pcapng(data: bytes) -> Iterator[Packet]:
    """Packets of enhanced and simple blocks; times aren't read."""
    if len(data) < 12:
        raise NoCapture("TOO_SHORT")
    if data[8:12] not in NG_ORDERS:
        raise NoCapture("UNKNOWN_FORMAT")
    order, links, at = NG_ORDERS[data[8:12]], [], 0
    while at + 12 <= len(data):
        kind, size = struct.unpack_from(f"{order}2I", data, at)
        if size < 12 or at + size > len(data):
            return
        body = data[at + 8 : at + size - 4]
        if kind == 1 and len(body) >= 8:
            links.append(struct.unpack_from(f"{order}H", body)[0])
        elif kind == 6 and len(body) >= 20:
            which, _, _, held = struct.unpack_from(f"{order}4I", body)
            yield body[20 : 20 + held], links[which] if which < len(links) else ETHERNET, None
        elif kind == 3 and len(body) >= 4:
            yield body[4:], links[0] if links else ETHERNET, None
        at += size


def ip_packet(frame: bytes, link: int) -> tuple[int, bytes]:
    """IP version and packet of a frame; version 0 if it carries none."""
    if link in RAW_LINKS:
        return (frame[0] >> 4 if frame else 0), frame
    if link == NULL_LINK and len(frame) >= 4:
        family = int.from_bytes(frame[:4], "little")
        return NULL_FAMILIES.get(family if family <= 0xFFFF else int.from_bytes(frame[:4], "big"), 0), frame[4:]
    type_at, start = ETHERTYPE_AT.get(link, (0, len(frame) + 1))
    if len(frame) < start:
        return 0, b""
    kind = int.from_bytes(frame[type_at : type_at + 2], "big")
    while link == ETHERNET and kind in VLAN_TAGS and len(frame) >= start + 4:
        kind = int.from_bytes(frame[start + 2 : start + 4], "big")
        start += 4
    return IP_ETHERTYPES.get(kind, 0), frame[start:]


def message_of(version: int, packet: bytes) -> tuple[bytes, str, str, str] | None:
    """(message, source, destination, transport) of a packet from or to port 53. Later fragments and TCP segments that
    don't start a message have none; IPv6 extension headers aren't followed."""
    if version == 4 and len(packet) >= 20:
        size = 4 * (packet[0] & 15)
        if size < 20 or len(packet) < size or int.from_bytes(packet[6:8], "big") & 0x1FFF:
            return None
        protocol, ends = packet[9], [str(ipaddress.IPv4Address(packet[i : i + 4])) for i in (12, 16)]
    elif version == 6 and len(packet) >= 40:
        size, protocol = 40, packet[6]
        ends = [":".join(f"{x:x}" for x in struct.unpack_from("!8H", packet, i)) for i in (8, 24)]
    else:
        return None
    rest = packet[size:]
    if 53 not in (int.from_bytes(rest[:2], "big"), int.from_bytes(rest[2:4], "big")):
        return None
    if protocol == 17 and len(rest) >= 8:
        return rest[8:], *ends, "udp"
    if protocol == 6 and len(rest) >= 20:
        start = 4 * (rest[12] >> 4)
        stream = rest[start:] if start >= 20 else b""
        message = stream[2 : 2 + int.from_bytes(stream[:2], "big")]
        return (message, *ends, "tcp") if len(message) >= 12 else None
    return None


def _label(raw: bytes) -> str:
    """A label in presentation form."""
    text = raw.decode("latin-1")
    return re.sub(r'["().;\\@$]|[^!-~]', lambda m: f"\\{m[0]}" if "!" <= m[0] <= "~" else f"\\{ord(m[0]):03d}", text)


def name_at(message: bytes, at: int) -> tuple[list[str], int] | None:
    """(labels, place after the name) of the name at a place; None if it is broken. Pointers lead backwards only."""
    labels, here, after, least = [], at, None, at
    while True:
        if here >= len(message):
            return None
        size = message[here]
        if size >= 0xC0:
            target = int.from_bytes(message[here : here + 2], "big") & 0x3FFF
            after = here + 2 if after is None else after
            if target >= least:
                return None
            here = least = target
        elif size > 63 or here + 1 + size > len(message):
            return None
        elif size == 0:
            return labels, here + 1 if after is None else after
        else:
            labels.append(_label(message[here + 1 : here + 1 + size]))
            here += 1 + size


def questions(message: bytes) -> list[tuple[str, str, bool]]:
    """(name, type, is a response) of each question of a message; none if it is broken."""
    if len(message) < 12:
        return []
    flags, count = struct.unpack_from("!2H", message, 2)
    found, at = [], 12
    for _ in range(count):
        if not (got := name_at(message, at)) or got[1] + 4 > len(message):
            return []
        (kind,) = struct.unpack_from("!H", message, got[1])
        at = got[1] + 4
        if got[0]:
            found.append((".".join(got[0]), TYPES.get(kind, f"TYPE{kind}"), bool(flags & 0x8000)))
    return found


# The sections of a message that hold records, and types by what their data are.
RECORD_SECTIONS = ("answer", "authority", "additional")
OPT, ADDRESSES, NAMED = 41, {1: ipaddress.IPv4Address, 28: ipaddress.IPv6Address}, (2, 5, 12, 39)
MX, TEXTS, SRV, SOA = 15, (16, 99), 33, 6


def _data(message: bytes, at: int, size: int, kind: int) -> str:
    """The data of a record as text: addresses, names, numbers and quoted strings; hexadecimal for other types."""
    raw, names = message[at : at + size], []

    def name(place: int) -> int:
        got = name_at(message, place)
        if not got or got[1] > at + size:
            raise ValueError
        names.append(".".join(got[0]) or ".")
        return got[1]

    if kind in ADDRESSES:
        return str(ADDRESSES[kind](raw))
    if kind in NAMED:
        name(at)
        return names[0]
    if kind == MX:
        name(at + 2)
        return f"{int.from_bytes(raw[:2], 'big')} {names[0]}"
    if kind == SRV:
        name(at + 6)
        return " ".join(map(str, struct.unpack_from("!3H", raw))) + f" {names[0]}"
    if kind == SOA:
        end = name(name(at)) - at
        return f"{names[0]} {names[1]} " + " ".join(map(str, struct.unpack_from("!5I", raw, end)))
    if kind in TEXTS:
        parts, i = [], 0
        while i < size:
            parts.append('"' + raw[i + 1 : i + 1 + raw[i]].decode("latin-1").replace("\\", "\\\\").replace('"', '\\"') + '"')
            i += 1 + raw[i]
        return " ".join(parts)
    return raw.hex()


def records(message: bytes) -> list[tuple[str, str, str, int, int, str]]:
    """(section, name, type, class, lifetime, data) of each record of a message, but for the pseudo-records of EDNS; none if
    the message is broken. Lifetimes beyond 31 bits are 0."""
    if len(message) < 12:
        return []
    asked, *counts = struct.unpack_from("!4H", message, 4)
    found, at = [], 12
    try:
        for _ in range(asked):
            at = name_at(message, at)[1] + 4
        for section, count in zip(RECORD_SECTIONS, counts, strict=True):
            for _ in range(count):
                labels, at = name_at(message, at)
                kind, group, ttl, size = struct.unpack_from("!2HIH", message, at)
                at += 10
                if at + size > len(message):
                    return []
                if kind != OPT:
                    found.append((section, ".".join(labels) or ".", TYPES.get(kind, f"TYPE{kind}"), group, ttl if ttl < 1 << 31 else 0, _data(message, at, size, kind)))
                at += size
    except (TypeError, ValueError, IndexError, struct.error):  # a name, a field or the data end too soon
        return []
    return found


def decode(path: str, data: bytes, max_packets: int | None = None) -> Iterator[tuple]:
    """Rows of one capture, in the order of its packets."""
    seq = 0
    try:
        for n, (frame, link, when) in enumerate(pcapng(data) if data[:4] == NG_MAGIC else libpcap(data)):
            if max_packets is not None and n >= max_packets:
                return
            got = message_of(*ip_packet(frame, link))
            for name, kind, response in questions(got[0]) if got else []:
                yield path, seq, name, kind, *got[1:], when, response, None
                seq += 1
    except NoCapture as e:
        yield path, None, None, None, None, None, None, None, None, str(e)


def read_captures(spark: SparkSession, path: str, max_bytes: int | None = None, max_packets: int | None = None, rows: int = 20_000) -> DataFrame:
    """Rows of ``SCHEMA``, one for each DNS question of the libpcap and pcapng files at ``path``, responses marked.

    A file that is none, or is larger than ``max_bytes``, has one row with ``error`` (UNKNOWN_FORMAT, TOO_SHORT, TOO_LARGE);
    Spark's readers pass over files of no bytes, so these have no row. ``max_packets``: a guard for each file, none by default. Tasks hold one file and ``rows`` rows."""
    return decoded(spark.read.format("binaryFile").load(path).select("path", "length", "content"), max_bytes, max_packets, rows)


def decoded(files: DataFrame, max_bytes: int | None = None, max_packets: int | None = None, rows: int = 20_000) -> DataFrame:
    """Rows of ``SCHEMA`` from rows (path, length, content), each a capture."""
    columns = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch.path, batch.content, strict=True):
                held: list[tuple] = []
                for row in decode(name, data, max_packets):
                    held.append(row)
                    if len(held) >= rows:
                        yield _frame(held, columns)
                        held = []
                if held:
                    yield _frame(held, columns)

    if max_bytes is None:
        return files.select("path", "content").mapInPandas(run, SCHEMA)
    fit = files.where(F.col("length") <= max_bytes).select("path", "content").mapInPandas(run, SCHEMA)
    over = files.where(F.col("length") > max_bytes).select("path", F.lit("TOO_LARGE").alias("error"))
    return fit.unionByName(over, allowMissingColumns=True)


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=columns).astype({"seq": "Int64", "timestamp": "Float64", "is_response": "boolean"})
