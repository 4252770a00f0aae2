"""Packet captures as a data source of byte ranges, for reading and for writing.

``spark.read.format("dns_capture")`` cuts each libpcap file into ranges; a task reads one of them as a stream, so neither a
file nor a range need fit memory. A range owns the records whose headers begin in it. Its first record is found by
resynchronising: the first place from which plausible headers follow one another for longer than a record can be, or
to the end of the file. A packet that carries a capture of its own can still be taken for records, if those end where it
ends. So each task also looks up where the next range will begin and fails if that isn't where its own records end:
rows are never lost or read twice in silence. ``checked`` reads the headers of all ranges first and begins each range
where the one before it ends; ``rangeBytes`` 0 reads each file from its start to its end.

In pcapng files interfaces may be declared anywhere before their packets, so such a file is one range.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from tidewarden.sources import captures

FORMAT = "dns_capture"
QUESTIONS = captures.SCHEMA
RECORDS = "path string, seq long, section string, nth int, name string, record_type string, record_class int, ttl long, data string, timestamp double"
#: Where the records of a range begin, and where those of the next one do.
BORDERS = "path string, start long, first long, next long"
#: Ranges that may be begun elsewhere than found, in one read.
MOVED = 100_000
#: What a capture is written from.
PACKETS = "timestamp double, packet binary"
#: Bytes of a range, of a read, and rows of a batch that is handed to Spark.
RANGE, CHUNK, ROWS = 64 << 20, 1 << 20, 20_000
#: What a record may hold if its file names no bound or a small one; headers that must follow one another at least, and seconds
#: between two of them at most. Records that are unlike this are read all the same, but no range begins at them unchecked.
LARGEST, LINKS, APART = 262_144, 64, 30 * 86400


def _open(path: str):
    """(filesystem, path in it) of a path or address."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def listed(path: str) -> list[tuple[str, int]]:
    """(path, size) of the file, or of the files below the folder; names that begin with _ or . are passed over."""
    from pyarrow import fs

    system, inner = _open(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inner, recursive=True))
    head = inner.rstrip("/")
    files = [f for f in found if f.type == fs.FileType.File and not any(p[:1] in ("_", ".") for p in f.path[len(head) :].split("/") if p)]
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    return sorted((prefix + f.path, f.size) for f in files)


class Bytes:
    """A file's bytes by place, read in chunks."""

    def __init__(self, path: str):
        system, inner = _open(path)
        self.file = system.open_input_file(inner)
        self.size, self.start, self.held = self.file.size(), 0, b""

    def take(self, at: int, n: int) -> bytes:
        """Up to n bytes from ``at`` on; fewer at the end of the file."""
        if at < self.start or at + n > self.start + len(self.held):
            self.start, self.held = at, self.file.read_at(max(0, min(max(n, CHUNK), self.size - at)), at)
        return self.held[at - self.start : at - self.start + n]


@dataclass
class Libpcap:
    """What the header of a libpcap file says."""

    order: str
    parts: float
    link: int
    largest: int

    @classmethod
    def of(cls, data: Bytes) -> Libpcap:
        head = data.take(0, 24)
        if len(head) < 24:
            raise captures.NoCapture("TOO_SHORT")
        if head[:4] not in captures.MAGICS:
            raise captures.NoCapture("UNKNOWN_FORMAT")
        order, parts = captures.MAGICS[head[:4]]
        snap, link = struct.unpack_from(f"{order}2I", head, 16)
        return cls(order, parts, link, max(snap if snap < 1 << 30 else 0, LARGEST))

    def header(self, data: Bytes, at: int) -> tuple[float, int] | None:
        """(time, bytes held) of the record at a place; None if the file ends in it."""
        raw = data.take(at, 16)
        if len(raw) < 16:
            return None
        seconds, part, size, _ = struct.unpack(f"{self.order}4I", raw)
        return (seconds + part / self.parts, size) if at + 16 + size <= data.size else None

    def plausible(self, data: Bytes, at: int, when: int | None = None) -> tuple[int | None, int | None]:
        """(where the next record begins if a header may stand at ``at``, a header's second); beyond the file's end if it ends in
        the record. ``when``: the second of the header before."""
        raw = data.take(at, 16)
        if len(raw) < 16:
            return data.size + 1, when
        second, part, size, whole = struct.unpack(f"{self.order}4I", raw)
        fits = part < self.parts and size <= whole <= self.largest and (when is None or abs(second - when) <= APART)
        return (at + 16 + size if fits else None), second

    def first(self, data: Bytes, start: int) -> int:
        """The place of the first record that begins at ``start`` or later. Where no chain comes to the end of the file, since
        the file was cut off, the longest one counts."""
        if start <= 24:
            return 24
        most, longest = 0, data.size
        for at in range(start, data.size):
            place, links, when = at, 0, None
            while place is not None and place < data.size and (place - at <= self.largest + 16 or links < LINKS):
                (place, when), links = self.plausible(data, place, when), links + 1
            if place is not None and place <= data.size:
                return at
            if place is not None and links > most:
                most, longest = links, at
        return longest

    def records(self, data: Bytes, part: Range) -> Iterator[tuple[int, bytes, float]]:
        """(place, frame, time) of the records whose headers begin in a range."""
        at = self.first(data, part.start) if part.first < 0 else part.first
        while at < part.end and (head := self.header(data, at)):
            yield at, data.take(at + 16, head[1]), head[0]
            at += 16 + head[1]
        if part.next < 0 and at >= part.end and self.header(data, at):
            part.next = self.first(data, part.end)
        if 0 <= part.next != at and at >= part.end:
            raise ValueError(f"records end at {at}, but the range from {part.end} on begins at {part.next}; read the capture checked, or with rangeBytes 0")

    def border(self, data: Bytes, part: Range) -> tuple[int, int]:
        """(place of the first record of a range, place of the first one behind it)."""
        at = first = self.first(data, part.start) if part.first < 0 else part.first
        while at < part.end and (head := self.header(data, at)):
            at += 16 + head[1]
        return first, at


def _ng_records(data: Bytes) -> Iterator[tuple[int, bytes, int]]:
    """(place, frame, link) of the packets of a pcapng file; times aren't read."""
    head = data.take(0, 12)
    if len(head) < 12:
        raise captures.NoCapture("TOO_SHORT")
    if head[8:12] not in captures.NG_ORDERS:
        raise captures.NoCapture("UNKNOWN_FORMAT")
    order, links, at = captures.NG_ORDERS[head[8:12]], [], 0
    while len(head := data.take(at, 8)) == 8:
        kind, size = struct.unpack(f"{order}2I", head)
        if size < 12 or at + size > data.size:
            return
        body = data.take(at + 8, size - 12) if kind in (1, 3, 6) else b""
        if kind == 1 and len(body) >= 8:
            links.append(struct.unpack_from(f"{order}H", body)[0])
        elif kind == 6 and len(body) >= 20:
            which, _, _, held = struct.unpack_from(f"{order}4I", body)
            yield at, body[20 : 20 + held], links[which] if which < len(links) else captures.ETHERNET
        elif kind == 3 and len(body) >= 4:
            yield at, body[4:], links[0] if links else captures.ETHERNET
        at += size


class Range(InputPartition):
    """Bytes of a file; ``first`` and ``next``: where its records and those behind it begin, if that is known (else -1)."""

    def __init__(self, path: str, start: int, end: int, first: int = -1, next: int = -1):
        self.path, self.start, self.end, self.first, self.next = path, start, end, first, next


def _messages(part: Range) -> Iterator[tuple[int, tuple, float | None]]:
    """(place, (message, source, destination, transport), time) of the DNS messages of a range."""
    data = Bytes(part.path)
    if data.take(0, 4) == captures.NG_MAGIC:
        frames = ((at, frame, link, None) for at, frame, link in _ng_records(data))
    else:
        file = Libpcap.of(data)
        frames = ((at, frame, file.link, when) for at, frame, when in file.records(data, part))
    for at, frame, link, when in frames:
        if got := captures.message_of(*captures.ip_packet(frame, link)):
            yield at, got, when


#: Rows are in order by place, then by their number in the message.
SEQ_BITS = 16


def _question_rows(part: Range) -> Iterator[tuple]:
    for at, got, when in _messages(part):
        for i, (name, kind, response) in enumerate(captures.questions(got[0])):
            yield part.path, (at << SEQ_BITS) + i, name, kind, *got[1:], when, response, None


def _record_rows(part: Range) -> Iterator[tuple]:
    for at, got, when in _messages(part):
        for i, record in enumerate(captures.records(got[0])):
            yield part.path, at << SEQ_BITS, record[0], i, *record[1:], when


def _border_rows(part: Range) -> Iterator[tuple]:
    data = Bytes(part.path)
    if data.take(0, 4) != captures.NG_MAGIC:
        yield part.path, part.start, *Libpcap.of(data).border(data, part)


class CaptureReader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.path, self.rows = options["path"], options.get("rows", "questions")
        self.first = {(p, start): first for p, start, first in json.loads(options.get("first", "[]"))}
        self.range = int(options.get("rangeBytes", RANGE))
        self.schema = pa.schema([(f.name, {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}[f.dataType.simpleString()]) for f in schema])

    def partitions(self) -> list[Range]:
        out = []
        for path, size in listed(self.path):
            whole = self.range <= 0 or size <= self.range or Bytes(path).take(0, 4) not in captures.MAGICS
            step = max(1, size if whole else self.range)
            for a in range(0, max(1, size), step):
                first, following = self.first.get((path, a), -1), self.first.get((path, a + step), -1)
                out.append(Range(path, a, min(size, a + step), first, following))
        return out or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        held: list[tuple] = []
        try:
            for row in {"questions": _question_rows, "records": _record_rows, "borders": _border_rows}[self.rows](partition):
                held.append(row)
                if len(held) >= ROWS:
                    yield self._batch(held)
                    held = []
        except captures.NoCapture as e:
            if self.rows == "questions":
                held.append((partition.path, *[None] * (len(self.schema) - 2), str(e)))
        if held:
            yield self._batch(held)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), self.schema, strict=True)], schema=self.schema)


@dataclass
class Written(WriterCommitMessage):
    name: str | None


class CaptureWriter(DataSourceWriter):
    """Each task writes a libpcap file of its rows, in their order; files appear when all tasks are done."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.link = options["path"], int(options.get("link", captures.RAW_LINKS[0]))
        if overwrite:
            raise ValueError("captures are only added to a folder: write with mode append")

    def write(self, iterator: Iterator) -> Written:
        system, inner = _open(self.path)
        name = f"{uuid.uuid4().hex}.pcap"
        system.create_dir(f"{inner}/_temporary", recursive=True)
        with system.open_output_stream(f"{inner}/_temporary/{name}") as out:
            out.write(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, LARGEST, self.link))
            for when, packet in iterator:
                us = round(when * 1e6)
                out.write(struct.pack("<4I", us // 1_000_000, us % 1_000_000, len(packet), len(packet)) + bytes(packet))
        return Written(name)

    def commit(self, messages: list[Written | None]) -> None:
        system, inner = _open(self.path)
        for i, m in enumerate(messages):
            if m:
                system.move(f"{inner}/_temporary/{m.name}", f"{inner}/part-{i:05d}-{m.name}")

    def abort(self, messages: list[Written | None]) -> None:
        system, inner = _open(self.path)
        for m in messages:
            if m:
                system.delete_file(f"{inner}/_temporary/{m.name}")


class CaptureSource(DataSource):
    """Options: ``path``; ``rangeBytes``; ``rows``: questions (the default), records or borders; ``first``: where ranges begin, as JSON
    [path, start, first]; for writing ``link``, the link type."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return {"records": RECORDS, "borders": BORDERS}.get(self.options.get("rows"), QUESTIONS)

    def reader(self, schema) -> CaptureReader:
        return CaptureReader(self.options, schema)

    def writer(self, schema, overwrite: bool) -> CaptureWriter:
        return CaptureWriter(self.options, overwrite)


def borders(spark: SparkSession, path: str, range_bytes: int = RANGE, first: list = ()) -> DataFrame:
    """Rows of ``BORDERS``, one for each range, with ``expected``: where the records of the range before it end (null for the
    first range of a file). A range whose ``first`` differs begins in the wrong place."""
    spark.dataSource.register(CaptureSource)
    found = spark.read.format(FORMAT).option("rangeBytes", range_bytes).option("rows", "borders").option("first", json.dumps(list(first))).load(path)
    return found.withColumn("expected", F.lag("next").over(Window.partitionBy("path").orderBy("start")))


def first_records(spark: SparkSession, path: str, range_bytes: int = RANGE) -> list:
    """[path, start, first] of the ranges that resynchronising would begin in the wrong place. Each pass puts right at least
    one more range of each file that has such; chains of records soon meet, so a pass or two do."""
    moved: dict = {}
    while True:
        wrong = borders(spark, path, range_bytes, [[*k, v] for k, v in moved.items()]).where("first <> expected").limit(MOVED + 1).collect()
        if not wrong:
            return [[*k, v] for k, v in moved.items()]
        moved |= {(r.path, r.start): r.expected for r in wrong}
        if len(moved) > MOVED:
            raise ValueError("too many ranges begin inside packets; read the captures with larger ranges or with rangeBytes 0")


def _load(spark: SparkSession, path: str, range_bytes: int, rows: str, checked: bool) -> DataFrame:
    spark.dataSource.register(CaptureSource)
    first = first_records(spark, path, range_bytes) if checked and range_bytes > 0 else []
    return spark.read.format(FORMAT).option("rangeBytes", range_bytes).option("rows", rows).option("first", json.dumps(first)).load(path)


def read_questions(spark: SparkSession, path: str, range_bytes: int = RANGE, checked: bool = False) -> DataFrame:
    """Rows of ``QUESTIONS``, one for each DNS question; ``seq`` orders those of a file. A file that is no capture has one row
    with ``error``. ``path``: a file or folder that workers can open (local and shared folders, or a store that pyarrow knows);
    ``captures.read_captures`` reads what only Spark can. ``checked``: see above; it reads the captures twice."""
    return _load(spark, path, range_bytes, "questions", checked)


def read_records(spark: SparkSession, path: str, range_bytes: int = RANGE, checked: bool = False) -> DataFrame:
    """Rows of ``RECORDS``, one for each resource record of a message: ``section`` is answer, authority or additional, ``nth`` its
    place in the message. Messages that are broken anywhere have none."""
    return _load(spark, path, range_bytes, "records", checked)


def write_packets(packets: DataFrame, path: str, link: int = captures.RAW_LINKS[0]) -> None:
    """Writes rows of ``PACKETS`` as libpcap files, one for each partition."""
    packets.sparkSession.dataSource.register(CaptureSource)
    packets.select("timestamp", "packet").write.format(FORMAT).option("path", path).option("link", link).mode("append").save()


def answer_ttls(records: DataFrame, max_ttl: int = 300) -> DataFrame:
    """Rows (path, seq, ttl): how long a cache keeps each message: the least lifetime above 0 of its answer and authority
    sections' record sets, from 1 to ``max_ttl`` seconds. A set lives as long as its shortest record. Messages without
    such a set have no row, and aren't kept."""
    sets = records.where("section in ('answer', 'authority')").groupBy("path", "seq", "section", F.lower("name").alias("name"), "record_type", "record_class").agg(F.min("ttl").alias("ttl"))
    least = sets.where("ttl > 0").groupBy("path", "seq").agg(F.min("ttl").alias("ttl"))
    return least.withColumn("ttl", F.greatest(F.lit(1), F.least(F.lit(max_ttl), "ttl")).cast("long"))
