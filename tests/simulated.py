"""Traffic and capture files that tests make up."""

import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netquarry.sources.pcap import _FLAGS

_START_MS = 1_700_000_000_000


def traffic_mix(spark: SparkSession, n: int = 300_000) -> DataFrame:
    """Packets in the shares 70 web, 15 name look-ups, 10 other UDP, 5 SYN of every hundred."""
    m = F.col("id") % 100
    kind = F.when(m < 70, "web").when(m < 85, "dns").when(m < 95, "udp").otherwise("syn")
    host = F.concat(F.lit("10.2.0."), (F.col("id") % 200 + 1).cast("string"))
    return spark.range(n).withColumn("kind", kind).select(
        F.lit("mix").alias("capture_id"), F.col("id").alias("pkt_seq"), (F.lit(_START_MS) + F.col("id") * 2).alias("ts_ms"),
        F.when(F.col("kind") == "dns", "DNS").when(F.col("kind") == "udp", "UDP").otherwise("TCP").alias("protocol"), host.alias("src_ip"), (40000 + F.col("id") % 1000).cast("int").alias("src_port"),
        F.lit("10.2.1.1").alias("dst_ip"), F.when(F.col("kind") == "dns", 53).when(F.col("kind") == "udp", 123).when(F.col("kind") == "syn", (F.col("id") % 1024).cast("int")).otherwise(80).alias("dst_port"),
        (60 + F.col("id") % 1300).alias("length"), (F.col("id") % 1300).alias("payload_size"), F.when(F.col("kind") == "syn", "SYN").when(F.col("kind") == "web", "ACK,PSH").otherwise("").alias("flags"),
        F.when(F.col("kind") == "dns", F.concat(F.lit("host"), (F.col("id") % 50).cast("string"), F.lit(".example.com"))).otherwise("").alias("dns_query"), F.lit("").alias("dns_response"), F.lit("").alias("raw_summary"),
    )


def attack(spark: SparkSession, kind: str, n: int, span_ms: int = 60_000, src_ip: str = "10.9.9.9", dst_ip: str = "10.9.0.1") -> DataFrame:
    """One attack's packets: synflood, portscan, rststorm, udpflood, dnstunnel or quicflood."""
    flags = {"synflood": "SYN", "portscan": "SYN", "rststorm": "RST"}.get(kind, "")
    protocol = "DNS" if kind == "dnstunnel" else "TCP" if flags else "UDP"
    port = {"portscan": F.col("id") + 1, "udpflood": F.lit(9999), "dnstunnel": F.lit(53), "quicflood": F.lit(443)}.get(kind, F.lit(80))
    query = F.concat(F.expr("repeat('a', 35)"), F.lit(".tunnel.example.com")) if kind == "dnstunnel" else F.lit("")
    return spark.range(n).select(
        F.lit(kind).alias("capture_id"), F.col("id").alias("pkt_seq"), (F.lit(_START_MS) + F.floor(F.col("id") * span_ms / n)).cast("long").alias("ts_ms"), F.lit(protocol).alias("protocol"),
        F.lit(src_ip).alias("src_ip"), (20000 + F.col("id") % 40000).cast("int").alias("src_port"), F.lit(dst_ip).alias("dst_ip"), port.cast("int").alias("dst_port"),
        F.lit(1350 if kind == "quicflood" else 60).cast("long").alias("length"), F.lit(6).cast("long").alias("payload_size"), F.lit(flags).alias("flags"), query.alias("dns_query"), F.lit("").alias("dns_response"), F.lit("").alias("raw_summary"),
    )


def _ip(text: str) -> bytes:
    return bytes(map(int, text.split(".")))


def frame_of(protocol: str, src_ip: str, src_port: int, dst_ip: str, dst_port: int, flags: str = "", payload: bytes = b"", query: str = "") -> bytes:
    """An Ethernet frame of a TCP, UDP or DNS packet."""
    if protocol == "TCP":
        body = struct.pack("!HHIIBBHHH", src_port, dst_port, 0, 0, 5 << 4, sum(b for f, b in _FLAGS if f in flags.split(",")), 8192, 0, 0) + payload
    else:
        if query:
            payload = struct.pack("!HHHHHH", 1, 0x100, 1, 0, 0, 0) + b"".join(bytes([len(p)]) + p.encode() for p in query.split(".")) + b"\0\0\1\0\1"
        body = struct.pack("!HHHH", src_port, dst_port, 8 + len(payload), 0) + payload
    ip = struct.pack("!BBHHHBBH", 0x45, 0, 20 + len(body), 0, 0, 64, 6 if protocol == "TCP" else 17, 0) + _ip(src_ip) + _ip(dst_ip)
    return b"\0" * 12 + b"\x08\0" + ip + body


def pcap_bytes(frames: list[tuple[int, bytes]]) -> bytes:
    """A pcap file of (milliseconds, frame)."""
    out = [struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)]
    for ms, f in frames:
        out.append(struct.pack("<IIII", ms // 1000, ms % 1000 * 1000, len(f), len(f)) + f)
    return b"".join(out)
