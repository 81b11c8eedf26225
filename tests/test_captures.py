"""Long captures read by many tasks give the rows of the readers that take a file as a whole."""

import io
import struct

import pytest

from netquarry.sources import pcap

from . import simulated
from .test_operators import _pcapng

FRAMES = [(1_700_000_000_000 + 7 * i, simulated.frame_of("TCP", "10.0.0.1", 1000 + i, "10.0.0.2", 80, "SYN", b"y" * (i % 50))) for i in range(300)]


def _big_endian_nanoseconds(frames):
    out = [struct.pack(">IHHiIII", 0xA1B23C4D, 2, 4, 0, 0, 65535, 1)]
    return b"".join(out + [struct.pack(">IIII", ms // 1000, ms % 1000 * 1_000_000, len(f), len(f)) + f for ms, f in frames])


CASES = {
    "plain.pcap": simulated.pcap_bytes(FRAMES), "broken end.pcap": simulated.pcap_bytes(FRAMES)[:-3], "nano.pcap": _big_endian_nanoseconds(FRAMES), "none.pcap": simulated.pcap_bytes([]),
    "two sections.pcapng": _pcapng(FRAMES[:100]) + _pcapng(FRAMES[100:]), "late interface.pcapng": _pcapng(FRAMES) + b"\x06\0\0\0broken", "other.txt": b"no capture", "empty.pcap": b"",
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("span", [1, 500, 1 << 20])
def test_spans_cover_every_record_once(name, span):
    data = CASES[name]
    whole = list(pcap.records(io.BytesIO(data)))
    spans = list(pcap._spans(name, io.BytesIO(data), span))
    got = []
    for _, at, until, first, order, blocks, ticks in spans:
        assert first == len(got)
        got += pcap.records(io.BytesIO(data), pcap.Place(at, order, blocks, list(ticks)), until)
    assert got == whole
    assert len(spans) > 50 or span > 500 or len(whole) < 100  # long captures are cut


def test_span_reader_equals_whole_file_reader(spark, tmp_path):
    for name, data in CASES.items():
        (tmp_path / name).write_bytes(data)
    spans = pcap.packets_in_spans(spark, str(tmp_path), span=2000)
    whole = pcap.packets_from_files(spark, str(tmp_path))
    assert spans.schema == whole.schema and spans.rdd.getNumPartitions() > 20
    assert spans.count() == whole.count() == 300 * 5 - 1
    assert spans.exceptAll(whole).count() == whole.exceptAll(spans).count() == 0


def test_no_captures(spark, tmp_path):
    (tmp_path / "x").write_bytes(b"")
    assert pcap.packets_in_spans(spark, str(tmp_path)).count() == 0
