"""Flows, talkers and capture statistics.

Flow totals come from the (flow, direction) grain, so one shuffle serves the flow, its
dominant direction and its counts. Order of arrival is ``pkt_seq`` everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def end_point(side: str) -> Column:
    return F.concat_ws(":", f"{side}_ip", F.col(f"{side}_port").cast("string"))


def has_flag(flag: str) -> Column:
    return F.contains(F.col("flags"), F.lit(flag))


def initiator_syn() -> Column:
    return (F.col("protocol") == "TCP") & has_flag("SYN") & ~has_flag("ACK")


def of_protocol(packets: DataFrame, protocol: str) -> DataFrame:
    return packets.where(F.upper("protocol") == protocol.upper())


def of_ip(packets: DataFrame, ip: str) -> DataFrame:
    return packets.where((F.col("src_ip") == ip) | (F.col("dst_ip") == ip))


def of_port(packets: DataFrame, port: int) -> DataFrame:
    return packets.where((F.col("src_port") == port) | (F.col("dst_port") == port))


def first_packets(packets: DataFrame, n: int) -> DataFrame:
    return packets.orderBy("pkt_seq").limit(n)


def protocol_distribution(packets: DataFrame) -> DataFrame:
    """Packets by protocol, most first, earlier seen first among equals."""
    return packets.groupBy("protocol").agg(F.count(F.lit(1)).alias("packets"), F.min("pkt_seq").alias("first_seq")).orderBy(F.desc("packets"), "first_seq")


def top_talkers(packets: DataFrame, k: int = 10) -> DataFrame:
    """Directed pairs of addresses by bytes."""
    rows = packets.where((F.col("src_ip") != "") & (F.col("dst_ip") != ""))
    pairs = rows.groupBy(F.concat_ws(" -> ", "src_ip", "dst_ip").alias("pair")).agg(F.count(F.lit(1)).alias("packets"), F.sum("length").alias("bytes"), F.min("pkt_seq").alias("first_seq"))
    return pairs.orderBy(F.desc("bytes"), "first_seq").limit(k)


def directions(packets: DataFrame, ordered: bool = True) -> DataFrame:
    """Pre-aggregate: one row per flow (protocol and unordered pair of end points) and direction."""
    first, last = ("pkt_seq", "pkt_seq") if ordered else ("ts_ms", "ts_ms")
    rows = packets.where(F.col("protocol").isin("TCP", "UDP") & (F.col("src_ip") != "") & (F.col("dst_ip") != ""))
    src, dst = end_point("src"), end_point("dst")
    return rows.groupBy("protocol", F.least(src, dst).alias("lo"), F.greatest(src, dst).alias("hi"), "src_ip", "src_port", "dst_ip", "dst_port").agg(
        F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes"), F.sum("payload_size").alias("payload"),
        F.min(F.struct(F.col(first).alias("seq"), "ts_ms")).alias("first"), F.max(F.struct(F.col(last).alias("seq"), "ts_ms")).alias("last"),
    )


def flows(packets: DataFrame, ordered: bool = True) -> DataFrame:
    """Flows with totals, first and last packet, and the dominant direction: most packets, then the larger
    (source, port, destination, port), ports as numbers."""
    return flows_of(directions(packets, ordered))


def flows_of(found: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Flows from their directions (of each capture by itself, where ``by`` names it)."""
    by = by or []
    top = F.max(F.struct("n", "src_ip", "src_port", "dst_ip", "dst_port", "bytes"))
    grouped = found.groupBy(*by, "protocol", "lo", "hi").agg(
        F.sum("n").alias("packets"), F.sum("bytes").alias("bytes"), F.sum("payload").alias("payload"), F.min("first").alias("first"), F.max("last").alias("last"), top.alias("dom")
    )
    return grouped.select(
        *by, "protocol", "lo", "hi", "packets", "bytes", "payload", F.col("first.seq").alias("first_seq"), F.col("first.ts_ms").alias("first_ms"), F.col("last.ts_ms").alias("last_ms"),
        F.col("dom.src_ip").alias("dom_src_ip"), F.col("dom.src_port").cast("long").alias("dom_src_port"), F.col("dom.dst_ip").alias("dom_dst_ip"),
        F.col("dom.dst_port").cast("long").alias("dom_dst_port"), F.col("dom.n").alias("dom_packets"), F.col("dom.bytes").alias("dom_bytes"),
    )


FLAGS = ("SYN", "ACK", "FIN", "RST", "PSH", "URG")


def flow_flag_counts(packets: DataFrame) -> DataFrame:
    """Packets of each flow that carry each flag."""
    rows = packets.where(F.col("protocol").isin("TCP", "UDP") & (F.col("src_ip") != "") & (F.col("dst_ip") != ""))
    src, dst, flags = end_point("src"), end_point("dst"), F.split("flags", ",")
    return rows.groupBy("protocol", F.least(src, dst).alias("lo"), F.greatest(src, dst).alias("hi")).agg(
        *[F.count_if(F.array_contains(flags, f)).alias(f.lower()) for f in FLAGS]
    )


def flag_text(bits: Column) -> Column:
    """TCP flag byte as names in fixed order."""
    places = {"SYN": 2, "ACK": 16, "FIN": 1, "RST": 4, "PSH": 8, "URG": 32}
    return F.concat_ws(",", *[F.when(bits.bitwiseAND(F.lit(b)) != 0, F.lit(f)) for f, b in places.items()])


def icmp_type(number: Column) -> Column:
    names = {0: "Echo Reply", 3: "Destination Unreachable", 5: "Redirect", 8: "Echo Request", 11: "Time Exceeded"}
    text = F.concat(F.lit("Type-"), number.cast("string"))
    for n, name in names.items():
        text = F.when(number == n, name).otherwise(text)
    return text


def top_flows(found: DataFrame, by: str, k: int = 10) -> DataFrame:
    return found.orderBy(F.desc(by), "first_seq").limit(k)


def tcp_conversations(packets: DataFrame) -> DataFrame:
    """Packets of the undirected TCP conversations, a row each with its place in the conversation (from 1).

    A conversation is never gathered: packets are counted in stretches of 65536 arrivals, and numbered inside a
    stretch from where the stretches before it end.
    """
    src, dst = end_point("src"), end_point("dst")
    rows = of_protocol(packets, "TCP").select(F.least(src, dst).alias("lo"), F.greatest(src, dst).alias("hi"), "pkt_seq", F.floor(F.col("pkt_seq") / 65536).alias("stretch"))
    counts = rows.groupBy("lo", "hi", "stretch").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("lo", "hi").orderBy("stretch")) - F.col("n")).drop("n")
    inside = rows.withColumn("at", F.row_number().over(Window.partitionBy("lo", "hi", "stretch").orderBy("pkt_seq")))
    return inside.join(before, ["lo", "hi", "stretch"]).select("lo", "hi", (F.col("before") + F.col("at")).cast("long").alias("place"), "pkt_seq")


def capture_summary(packets: DataFrame) -> DataFrame:
    return packets.agg(
        F.count(F.lit(1)).alias("packets"), F.sum("length").alias("bytes"), F.min_by("ts_ms", "pkt_seq").alias("first_ms"), F.max_by("ts_ms", "pkt_seq").alias("last_ms")
    )


def flow_stats(found: DataFrame) -> DataFrame:
    """Totals and averages (2 places) over flows, in one pass; one row of zeros where there are none."""
    lo_ip, hi_ip = F.substring_index("lo", ":", 1), F.substring_index("hi", ":", 1)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    most = lambda c: F.coalesce(F.max(c), F.lit(0))
    mean = lambda c: F.coalesce(F.round(F.try_divide(F.sum(c), F.count(F.lit(1))), 2), F.lit(0.0))
    return found.agg(
        F.count(F.lit(1)).alias("flows"), total("packets").alias("packets"), total("bytes").alias("bytes"), total("payload").alias("payload"), mean("packets").alias("avg_packets"), mean("bytes").alias("avg_bytes"),
        most("bytes").alias("max_bytes"), most("packets").alias("max_packets"),
        F.count_distinct("dom_src_ip").alias("src_ips"), F.count_distinct("dom_dst_ip").alias("dst_ips"), F.count_distinct("dom_src_port").alias("src_ports"),
        F.count_distinct("dom_dst_port").alias("dst_ports"), F.count_distinct(F.concat_ws("|", lo_ip, hi_ip)).alias("ip_pairs"),
    )


def most_common(found: DataFrame, column: str, k: int, order: str = "first_seq") -> DataFrame:
    """The k commonest values of a column, earlier seen first among equals."""
    return found.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first")).orderBy(F.desc("n"), "first").limit(k).select("value", "n")


def flow_protocols(found: DataFrame) -> DataFrame:
    """Flows by protocol, with their share in ten-thousandths."""
    counted = found.groupBy("protocol").agg(F.count(F.lit(1)).alias("flows"))
    return counted.withColumn("share_bp", F.floor(F.col("flows") * 10000 / F.sum("flows").over(Window.partitionBy())).cast("long"))  # a row per protocol


def flow_records(found: DataFrame, flags: DataFrame) -> DataFrame:
    """Flows with a map of their flag counts (flags that occur), as reports export them."""
    pairs = F.map_filter(F.map_from_arrays(F.array(*[F.lit(f) for f in FLAGS]), F.array(*[F.col(f.lower()) for f in FLAGS])), lambda _, n: n > 0)
    counts = flags.select("protocol", "lo", "hi", pairs.alias("flag_counts"), "syn", "ack", "fin", "rst")
    return found.join(counts, ["protocol", "lo", "hi"], "left")


def flows_with(found: DataFrame, protocol: str | None = None, ip: str | None = None, port: int | None = None) -> DataFrame:
    """Flows of a protocol, and with an address or a port at either end."""
    if protocol is not None:
        found = found.where(F.upper("protocol") == protocol.upper())
    if ip is not None:
        found = found.where((F.col("dom_src_ip") == ip) | (F.col("dom_dst_ip") == ip))
    if port is not None:
        found = found.where((F.col("dom_src_port") == port) | (F.col("dom_dst_port") == port))
    return found


def packet_records(packets: DataFrame) -> DataFrame:
    """Packets as JSON objects of the fields that reports show."""
    fields = ["ts_ms", "protocol", "src_ip", "src_port", "dst_ip", "dst_port", "length", "flags", "payload_size", "raw_summary", "dns_query"]
    return packets.select("pkt_seq", F.to_json(F.struct(*fields)).alias("record"))


def flow_packets(found: DataFrame, counts: DataFrame) -> DataFrame:
    """Flows (with ``flow_flag_counts``) as one packet each, for operators that take packets: the dominant direction's end points, the flow's bytes,
    and for TCP the flags that were seen."""
    named = F.concat_ws(",", *[F.when(F.col(f.lower()) > 0, f) for f in ("SYN", "ACK", "RST")])
    return found.join(counts, ["protocol", "lo", "hi"]).select(
        "protocol", F.col("dom_src_ip").alias("src_ip"), F.col("dom_src_port").alias("src_port"), F.col("dom_dst_ip").alias("dst_ip"), F.col("dom_dst_port").alias("dst_port"), F.col("first_ms").alias("ts_ms"),
        F.col("bytes").alias("length"), F.col("bytes").alias("payload_size"), F.when(F.col("protocol") == "TCP", named).otherwise("").alias("flags"),
    )
