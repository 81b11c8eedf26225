"""Capture files (pcap and pcapng): a Spark data source with a partition per file, and readers of whole files and of spans of long ones.

Files are read in a stream and yield Arrow batches, so a task holds one block of a file and one batch of rows.

Only the link types and protocols that the detections read are decoded: Ethernet, IPv4,
TCP, UDP, ICMP, ARP and DNS over UDP. Records that break off end a file's rows without error.
"""

from __future__ import annotations

import io
import struct
import warnings
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schemas import PACKET_SCHEMA
from ..scratch import materialize

SCHEMA = PACKET_SCHEMA
_ARROW = pa.schema([
    ("capture_id", pa.string()), ("pkt_seq", pa.int64()), ("ts", pa.timestamp("us", tz="UTC")), ("ts_ms", pa.int64()), ("protocol", pa.string()), ("src_ip", pa.string()), ("src_port", pa.int32()),
    ("dst_ip", pa.string()), ("dst_port", pa.int32()), ("length", pa.int64()), ("flags", pa.string()), ("payload_size", pa.int64()), ("tcp_window", pa.int32()), ("raw_summary", pa.string()),
    ("dns_query", pa.string()), ("dns_response", pa.string()),
])
_BATCH = 8192
_FLAGS = (("SYN", 2), ("ACK", 16), ("FIN", 1), ("RST", 4), ("PSH", 8), ("URG", 32))
_ICMP = {0: "Echo Reply", 3: "Destination Unreachable", 5: "Redirect", 8: "Echo Request", 11: "Time Exceeded"}


def _name(data: bytes, at: int, depth: int = 0) -> tuple[str, int]:
    parts, end = [], None
    while at < len(data) and depth < 32:
        n = data[at]
        if n == 0:
            return ".".join(parts), end or at + 1
        if n & 0xC0 == 0xC0 and at + 1 < len(data):
            end, at, depth = end or at + 2, (n & 0x3F) << 8 | data[at + 1], depth + 1
            continue
        parts.append(data[at + 1 : at + 1 + n].decode("ascii", "replace"))
        at += n + 1
    return ".".join(parts), end or at


def _dns(data: bytes) -> tuple[str, str]:
    """First question's name and first answer's data, empty where there is none."""
    if len(data) < 12:
        return "", ""
    questions, answers = struct.unpack("!HH", data[4:8])
    at, query = 12, ""
    for i in range(questions):
        name, at = _name(data, at)
        query = query or name
        at += 4
    if not answers or at >= len(data):
        return query, ""
    _, at = _name(data, at)
    if at + 10 > len(data):
        return query, ""
    kind, _, _, n = struct.unpack("!HHIH", data[at : at + 10])
    body = data[at + 10 : at + 10 + n]
    if kind == 1 and len(body) == 4:
        return query, ".".join(map(str, body))
    if kind in (2, 5, 12):
        return query, _name(data, at + 10)[0]
    return query, body.hex()


def decode(frame: bytes, length: int) -> tuple:
    """(protocol, src_ip, src_port, dst_ip, dst_port, length, flags, payload_size, tcp_window, summary, query, response) of a frame."""
    empty = ("", "", 0, "", 0, length, "", 0, 0, "", "", "")
    if len(frame) < 14:
        return empty
    kind = struct.unpack("!H", frame[12:14])[0]
    if kind == 0x0806 and len(frame) >= 42:
        return ("ARP", ".".join(map(str, frame[28:32])), 0, ".".join(map(str, frame[38:42])), 0, length, "", 0, 0, "ARP", "", "")
    if kind != 0x0800 or len(frame) < 34:
        return empty
    ip = frame[14:]
    head = (ip[0] & 15) * 4
    total = struct.unpack("!H", ip[2:4])[0] or len(ip)
    src, dst, body = ".".join(map(str, ip[12:16])), ".".join(map(str, ip[16:20])), ip[head:total]
    if ip[9] == 6 and len(body) >= 20:
        sp, dp, _, _, off, bits, window = struct.unpack("!HHIIBBH", body[:16])
        return ("TCP", src, sp, dst, dp, length, ",".join(f for f, b in _FLAGS if bits & b), max(0, len(body) - (off >> 4) * 4), window, f"TCP {src}:{sp} > {dst}:{dp}", "", "")
    if ip[9] == 17 and len(body) >= 8:
        sp, dp = struct.unpack("!HH", body[:4])
        if 53 in (sp, dp) and len(body) >= 20:
            query, response = _dns(body[8:])
            return ("DNS", src, sp, dst, dp, length, "", len(body) - 8, 0, f"DNS {query}", query, response)
        long_header = len(body) >= 13 and body[8] & 0xC0 == 0xC0 and 443 in (sp, dp)
        summary = f"UDP {src}:{sp} > {dst}:{dp}" + (f" QUIC Version=0x{body[9:13].hex()}" if long_header else "")
        return ("UDP", src, sp, dst, dp, length, "", len(body) - 8, 0, summary, "", "")
    if ip[9] == 1 and body:
        return ("ICMP", src, 0, dst, 0, length, _ICMP.get(body[0], f"Type-{body[0]}"), max(0, len(body) - 8), 0, "ICMP", "", "")
    return ("OTHER", src, 0, dst, 0, length, "", len(body), 0, "IP", "", "")


_MOST = 1 << 26  # a block that says it is longer is broken


@dataclass
class Place:
    """Where a record or block starts, and what must be known to read on from there."""

    at: int
    order: str
    blocks: bool
    #: Ticks a second of every interface that was described so far; of a classic capture, of all.
    ticks: list[int]


def _classic(file: BinaryIO, place: Place, until: int | None) -> Iterator[tuple[int, int, bytes]]:
    per_ms = place.ticks[0] // 1000
    while (until is None or place.at < until) and len(head := file.read(16)) == 16:
        sec, part, kept, length = struct.unpack(place.order + "IIII", head)
        if kept > _MOST:
            warnings.warn(f"a packet that says it has {kept} bytes ends the capture", stacklevel=2)
            return
        if len(frame := file.read(kept)) < kept:
            return
        place.at += 16 + kept
        yield sec * 1000 + part // per_ms, length, frame


def _resolution(options: bytes, order: str) -> int:
    """Ticks a second of an interface, from its options."""
    while len(options) >= 4:
        code, n = struct.unpack(order + "HH", options[:4])
        if code == 9 and n:
            return 2 ** (options[4] & 127) if options[4] & 128 else 10 ** options[4]
        options = options[4 + n + -n % 4 :]
    return 1_000_000


def _blocks(file: BinaryIO, place: Place, until: int | None) -> Iterator[tuple[int, int, bytes]]:
    while (until is None or place.at < until) and len(head := file.read(8)) == 8:
        kind = struct.unpack(place.order + "I", head[:4])[0]
        start = b""
        if head[:4] == b"\x0a\x0d\x0d\x0a":  # a section says its own byte order
            start = file.read(4)
            place.order, place.ticks = "<" if start == b"\x4d\x3c\x2b\x1a" else ">", []
        size = struct.unpack(place.order + "I", head[4:])[0]
        if size < 12 + len(start) or size > _MOST or len(body := file.read(size - 8 - len(start))) < size - 8 - len(start):
            return
        place.at += size
        if kind == 1:
            place.ticks.append(_resolution(body[8:-4], place.order))
        elif kind == 6 and len(body) >= 24:
            where, high, low, kept, length = struct.unpack(place.order + "IIIII", body[:20])
            if where < len(place.ticks) and 20 + kept <= len(body) - 4:
                yield (high << 32 | low) * 1000 // place.ticks[where], length, body[20 : 20 + kept]


def first_place(file: BinaryIO) -> Place | None:
    """Where a capture's records begin; None where it is none."""
    magic = file.read(4)
    if magic == b"\x0a\x0d\x0d\x0a":
        return Place(0, "<", True, [])
    order = {b"\xd4\xc3\xb2\xa1": ("<", 1_000_000), b"\xa1\xb2\xc3\xd4": (">", 1_000_000), b"\x4d\x3c\xb2\xa1": ("<", 1_000_000_000), b"\xa1\xb2\x3c\x4d": (">", 1_000_000_000)}.get(magic)
    return Place(24, order[0], False, [order[1]]) if order else None


def records(file: BinaryIO, place: Place | None = None, until: int | None = None) -> Iterator[tuple[int, int, bytes]]:
    """(milliseconds, length, frame) of a capture's records, from ``place`` (moved along) to those that start before ``until``; nothing where it is none."""
    place = place or first_place(file)
    if place is None:
        return iter(())
    file.seek(place.at)
    return _blocks(file, place, until) if place.blocks else _classic(file, place, until)


class PcapSource(DataSource):
    """``spark.read.format("pcap").option("paths", "a.pcap,b.pcap").load()``; register with ``spark.dataSource.register``."""

    @classmethod
    def name(cls) -> str:
        return "pcap"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader([p for p in self.options.get("paths", self.options.get("path", "")).split(",") if p])


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        with open(partition.value, "rb") as file:
            yield from _rows(partition.value, records(file))


def _rows(path: str, found: Iterable[tuple[int, int, bytes]], first: int = 0) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _ARROW)], schema=_ARROW)

    for seq, (ms, length, frame) in enumerate(found, first):
        held.append((path, seq, ms * 1000, ms, *decode(frame, length)))
        if len(held) == _BATCH:
            yield batch()
            held = []
    if held:
        yield batch()


def packets_from_files(spark, path: str):
    """Captures by Spark's own file reader, for paths that only it reads: one task a file, never the driver. Spark hands a file over
    whole, 2 GB at most; longer captures need ``packets_in_spans``."""

    def parse(batches):
        for b in batches:
            for p, data in zip(b.column(0).to_pylist(), b.column(1)):
                yield from _rows(p, records(io.BytesIO(data.as_buffer())))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(parse, SCHEMA)


def _opened(path: str) -> BinaryIO:
    """A file to seek in, by the scheme of its path (those that Arrow knows; local ones without)."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    system, inner = (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)
    return io.BufferedReader(system.open_input_file(inner), 1 << 20)


def _spans(path: str, file: BinaryIO, span: int) -> Iterator[tuple]:
    """(path, at, until, first record's number, byte order, blocks, ticks): stretches of ``span`` bytes or a little more, the last one open."""
    place = first_place(file)
    if place is None:
        return
    start = (place.at, 0, place.order, place.blocks, list(place.ticks))
    for seq, _ in enumerate(records(file, place), 1):
        if place.at - start[0] >= span:
            yield (path, start[0], place.at, *start[1:])
            start = (place.at, seq, place.order, place.blocks, list(place.ticks))
    yield (path, start[0], None, *start[1:])


_SPAN = "path string, at long, until long, first long, order string, blocks boolean, ticks array<long>"
_SPAN_ARROW = pa.schema([("path", pa.string()), ("at", pa.int64()), ("until", pa.int64()), ("first", pa.int64()), ("order", pa.string()), ("blocks", pa.bool_()), ("ticks", pa.list_(pa.int64()))])


def packets_in_spans(spark, path: str, span: int = 1 << 26):
    """Captures of any length by many tasks: where records start is only known by walking over them, so a task a file walks first, without
    decoding, and notes where every ``span`` bytes begin; the stretches are then decoded side by side. Rows equal those of the other readers.

    Workers open the files themselves, so their paths must be shared ones whose scheme Arrow can read."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in b.column(0).to_pylist():
                with _opened(p) as file:
                    found = list(_spans(p, file, span))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), _SPAN_ARROW)], schema=_SPAN_ARROW)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                with _opened(r["path"]) as file:
                    yield from _rows(r["path"], records(file, Place(r["at"], r["order"], r["blocks"], r["ticks"]), r["until"]), r["first"])

    listed = spark.read.format("binaryFile").load(path).select("path")  # names only, no contents
    found = materialize(listed.mapInArrow(walk, _SPAN), "capture-spans")
    return found.repartition(max(1, found.count())).mapInArrow(read, SCHEMA)
