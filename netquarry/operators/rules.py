"""Threshold detections over one narrow pre-aggregate of the packets.

``signals`` has a row per measure (what a packet is to a rule), key and second key: an address and a port, a flow
and a direction, a version. It is an ordinary aggregation with sums on the map side, so it runs over a table and
over a stream alike. ``keyed`` folds the second key; every rule is then a filter over it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import Thresholds
from ..scratch import materialize
from .flows import end_point, has_flag, initiator_syn

#: QUIC version 1, version 2 and drafts 20, 21 and 29.
KNOWN_QUIC = ("00000001", "6b3343cf", "ff000020", "ff000021", "ff00001d")


def _by(found: DataFrame) -> list[str]:
    """The capture, where the rows keep captures apart."""
    return ["capture_id"] if "capture_id" in found.columns else []


def signals(packets: DataFrame, t: Thresholds, captures: bool = False, only: tuple[str, ...] = (), also: tuple[str, ...] = ()) -> DataFrame:
    """The pre-aggregate: measure, a, b with ``n`` packets, ``bytes``, ``f`` and ``l`` (pkt_seq, ts_ms) of the first and last; ``other`` and
    ``other_bytes`` are those of a measure's second role (SYN-ACKs that a host got, what it asked, large QUIC packets).
    With ``captures`` every rule runs for each capture by itself; ``only`` names the measures wanted, ``also`` columns that are part of the key."""
    c, none = F.col, F.lit("")
    tcp, udp, dns = c("protocol") == "TCP", c("protocol") == "UDP", c("protocol") == "DNS"
    quic = udp & (c("dst_port") == 443)
    syn, answer = initiator_syn(), c("dns_response") != ""
    version = F.lower(F.regexp_extract("raw_summary", r"Version[=:\s]+0x([0-9a-fA-F]+)", 1))
    src, dst = end_point("src"), end_point("dst")
    named = (c("src_ip") != "") & (c("dst_ip") != "")
    entries = [
        ("syn", syn, c("src_ip"), none, True), ("syn", tcp & has_flag("SYN") & has_flag("ACK"), c("dst_ip"), none, False),
        ("scan", syn & (c("src_ip") != "") & (c("dst_port") > 0), c("src_ip"), c("dst_port").cast("string"), True),
        ("long_dns", dns & (F.length(F.rtrim(c("dns_query"), F.lit("."))) > t.dns_max_len), c("src_ip"), none, True),
        ("way", c("protocol").isin("TCP", "UDP") & named, F.concat_ws("|", "protocol", F.least(src, dst), F.greatest(src, dst)), F.concat_ws("|", "src_ip", c("src_port").cast("string"), "dst_ip", c("dst_port").cast("string")), True),
        ("rst", tcp & has_flag("RST"), c("src_ip"), none, True), ("udp", udp, c("dst_ip"), none, True),
        ("dns", dns & answer & (c("dst_ip") != ""), c("dst_ip"), none, True), ("dns", dns & ~answer & (c("dns_query") != "") & (c("src_ip") != ""), c("src_ip"), none, False),
        ("quic", quic, c("src_ip"), c("src_port").cast("string"), True), ("quic", quic & (c("length") > t.quic_large_bytes), c("src_ip"), c("src_port").cast("string"), False),
        ("quic_way", quic, F.concat(src, F.lit("->"), dst), none, True),
        ("version", quic & F.contains("raw_summary", F.lit("QUIC")) & ~version.isin("", "00000000", *KNOWN_QUIC), version, none, True),
    ]
    each = [F.when(when, F.struct(F.lit(m).alias("measure"), a.alias("a"), b.alias("b"), F.lit(own).alias("own"))) for m, when, a, b, own in entries if not only or m in only]
    by = ["capture_id"] * captures + list(also)
    rows = packets.select(*by, "pkt_seq", "ts_ms", "length", F.explode(F.array_compact(F.array(*each))).alias("x")).select(*by, "pkt_seq", "ts_ms", "length", "x.*")
    own = F.col("own")
    seq = F.when(own, F.col("pkt_seq"))
    # numbers only, so that the sums stay in a hash table; first and last are put together afterwards
    summed = rows.groupBy(*by, "measure", "a", "b").agg(
        F.count_if(own).alias("n"), F.count_if(~own).alias("other"), F.coalesce(F.sum(F.when(own, F.col("length"))), F.lit(0)).alias("bytes"), F.coalesce(F.sum(F.when(~own, F.col("length"))), F.lit(0)).alias("other_bytes"),
        F.min(seq).alias("f_seq"), F.min_by("ts_ms", seq).alias("f_ms"), F.max(seq).alias("l_seq"), F.max_by("ts_ms", seq).alias("l_ms"),
    )
    ends = [F.struct(F.col(f"{x}_seq").alias("pkt_seq"), F.col(f"{x}_ms").alias("ts_ms")).alias(x) for x in "fl"]
    return summed.select(*by, "measure", "a", "b", "n", "other", "bytes", "other_bytes", *ends)


def keyed(found: DataFrame) -> DataFrame:
    """``signals`` by measure and key: sums, ``keys`` (second keys), ``ports`` (of scans, sorted; 65535 at most) and ``top`` (a flow's
    dominant direction: most packets, then the larger end points, ports as numbers)."""
    end = F.split("b", r"\|")
    way = F.struct(F.col("n").alias("n"), end[0].alias("src_ip"), end[1].cast("int").alias("src_port"), end[2].alias("dst_ip"), end[3].cast("int").alias("dst_port"))
    return found.groupBy(*_by(found), "measure", "a").agg(
        F.sum("n").alias("n"), F.sum("other").alias("other"), F.sum("bytes").alias("bytes"), F.sum("other_bytes").alias("other_bytes"), F.min(F.when(F.col("n") > 0, F.col("f"))).alias("f"), F.max(F.when(F.col("n") > 0, F.col("l"))).alias("l"),
        F.count_if(F.col("n") > 0).alias("keys"), F.array_sort(F.collect_set(F.when(F.col("measure") == "scan", F.col("b").cast("int")))).alias("ports"),
        F.max(F.when(F.col("measure") == "way", way)).alias("top"),
    )


def _of(found: DataFrame, measure: str) -> DataFrame:
    return found.where((F.col("measure") == measure) & (F.col("n") > 0))


def _alert(kind: str, order: int, severity: Column, key: Column, value: Column, detail: Column | None = None) -> list[Column]:
    return [
        F.lit(order).cast("long").alias("rule_ord"), F.lit(kind).alias("type"), severity.alias("severity"), key.alias("subject"), value.cast("double").alias("value"),
        (F.lit(None).cast("string") if detail is None else detail).alias("detail"), F.col("f.pkt_seq").alias("key_ord"), F.col("f.ts_ms").alias("first_ms"), F.col("l.ts_ms").alias("last_ms"),
    ]


def _high(value: Column, high: float) -> Column:
    return F.when(value > high, F.lit("HIGH")).otherwise(F.lit("MEDIUM"))


def _fired(found: DataFrame, measure: str, least: float, kind: str, order: int, severity: Column, value: str = "n", detail: Column | None = None) -> DataFrame:
    return _of(found, measure).where(F.col(value) >= least).select(*_by(found), *_alert(kind, order, severity, F.col("a"), F.col(value), detail))


def syn_flood(found: DataFrame, t: Thresholds) -> DataFrame:
    """Initiator SYNs that a source sent less the SYN-ACKs it got."""
    net = F.col("n") - F.col("other")
    return _of(found, "syn").where(net >= t.syn_flood_min).select(*_by(found), *_alert("SYN_FLOOD_SUSPECTED", 1, _high(net, t.syn_flood_high), F.col("a"), net))


def port_scan(found: DataFrame, t: Thresholds) -> DataFrame:
    sample = F.array_join(F.transform(F.slice("ports", 1, 20), lambda x: x.cast("string")), ",")
    return _fired(found, "scan", t.port_scan_min, "PORT_SCAN_SUSPECTED", 2, _high(F.col("keys"), t.port_scan_high), "keys", sample)


def dns_tunnel(found: DataFrame, t: Thresholds) -> DataFrame:
    return _fired(found, "long_dns", t.dns_tunnel_min, "DNS_TUNNEL_SUSPECTED", 3, _high(F.col("n"), t.dns_tunnel_high))


def large_transfer(found: DataFrame, t: Thresholds) -> DataFrame:
    way = F.concat(F.concat_ws(":", "top.src_ip", F.col("top.src_port").cast("string")), F.lit(" -> "), F.concat_ws(":", "top.dst_ip", F.col("top.dst_port").cast("string")))
    rows = _of(found, "way").where(F.col("bytes") > t.large_flow_mb * 1024 * 1024)
    return rows.select(*_by(found), *_alert("LARGE_DATA_TRANSFER", 4, F.lit("MEDIUM"), F.col("a"), F.col("bytes"), way))


def rst_storm(found: DataFrame, t: Thresholds) -> DataFrame:
    return _fired(found, "rst", t.rst_storm_min, "RST_STORM", 5, F.lit("LOW"))


def udp_flood(found: DataFrame, t: Thresholds) -> DataFrame:
    return _fired(found, "udp", t.udp_flood_min, "UDP_FLOOD_SUSPECTED", 6, _high(F.col("n"), t.udp_flood_high))


def dns_amplification(found: DataFrame, t: Thresholds) -> DataFrame:
    """Bytes answered to a target over bytes it asked; a target that never asked divides by 1.

    A packet with an answer is a response, whatever query it repeats.
    """
    asked = F.when(F.col("other") > 0, F.col("other_bytes")).otherwise(1)
    ratio = F.when(asked > 0, F.col("bytes") / asked).otherwise(F.col("bytes").cast("double"))
    rows = _of(found, "dns").where((F.col("n") >= t.dns_amp_responses) & (ratio >= t.dns_amp_ratio))
    return rows.select(*_by(found), *_alert("DNS_AMPLIFICATION_SUSPECTED", 7, F.lit("HIGH"), F.col("a"), F.col("n"), F.concat_ws("/", F.col("bytes").cast("string"), asked.cast("string"))))


def quic_connections(found: DataFrame, t: Thresholds) -> DataFrame:
    return _fired(found, "quic", t.quic_connections, "QUIC_CONNECTION_FLOOD", 8, F.lit("HIGH"), "keys")


def quic_long_flow(found: DataFrame, t: Thresholds) -> DataFrame:
    return _fired(found, "quic_way", t.quic_long_flow, "QUIC_LONG_FLOW_ANOMALY", 9, F.lit("MEDIUM"))


def quic_initial_ratio(found: DataFrame, t: Thresholds) -> DataFrame:
    totals = _of(found, "quic").groupBy(*_by(found)).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum("other").alias("large"), F.min("f").alias("f"), F.max("l").alias("l"))
    rows = totals.where((F.col("n") > 0) & (F.col("large") / F.col("n") >= t.quic_large_share))
    return rows.select(*_by(found), *_alert("QUIC_INITIAL_RATIO_ANOMALY", 10, F.lit("MEDIUM"), F.lit("all"), F.col("large"), F.col("n").cast("string")))


def quic_unknown_version(found: DataFrame, t: Thresholds, shown: int = 100) -> DataFrame:
    """One alert for all unknown versions: how many there are, and the first ``shown`` of them in order."""
    each, by = _of(found, "version"), _by(found)
    if by:
        early = each.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("a"))).where(F.col("r") <= shown)
    else:
        early = each.orderBy("a").limit(shown)
    first = early.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list("a")), ",").alias("versions"))
    counted = each.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("f").alias("f"), F.max("l").alias("l")).where("n > 0")
    rows = counted.join(first, by) if by else counted.crossJoin(first)  # one row each
    return rows.select(*_by(found), *_alert("QUIC_UNKNOWN_VERSION", 11, F.lit("LOW"), F.lit("all"), F.col("n"), F.col("versions")))


#: Every rule with the measure that it reads.
_RULES = {
    "rule_syn_flood": (syn_flood, "syn"), "rule_port_scan": (port_scan, "scan"), "rule_dns_tunnel": (dns_tunnel, "long_dns"), "rule_large_transfer": (large_transfer, "way"), "rule_rst_storm": (rst_storm, "rst"),
    "rule_udp_flood": (udp_flood, "udp"), "rule_dns_amplification": (dns_amplification, "dns"), "rule_quic_conn_flood": (quic_connections, "quic"), "rule_quic_long_flow": (quic_long_flow, "quic_way"),
    "rule_quic_initial_ratio": (quic_initial_ratio, "quic"), "rule_quic_unknown_version": (quic_unknown_version, "version"),
}


def levels(t: Thresholds) -> dict[str, tuple[str, Column]]:
    """For every measure the type of its alert and its level (3 HIGH, 2 MEDIUM, 1 LOW, 0 none) by a key's sums so far: n, other, bytes,
    other_bytes and ``keys``; ``quic_all`` is a capture's QUIC traffic as a whole, ``version`` all its unknown versions."""
    n, other, size, keys = (F.col(c) for c in ("n", "other", "bytes", "keys"))
    high = lambda value, least, most: F.when(value >= least, F.when(value > most, 3).otherwise(2)).otherwise(0)
    over = lambda value, least, level: F.when(value >= least, level).otherwise(0)
    asked = F.when(other > 0, F.col("other_bytes")).otherwise(1)
    ratio = F.when(asked > 0, size / asked).otherwise(size.cast("double"))
    found = {
        "syn": ("SYN_FLOOD_SUSPECTED", high(n - other, t.syn_flood_min, t.syn_flood_high)), "scan": ("PORT_SCAN_SUSPECTED", high(keys, t.port_scan_min, t.port_scan_high)),
        "long_dns": ("DNS_TUNNEL_SUSPECTED", high(n, t.dns_tunnel_min, t.dns_tunnel_high)), "way": ("LARGE_DATA_TRANSFER", F.when(size > t.large_flow_mb * 1024 * 1024, 2).otherwise(0)),
        "rst": ("RST_STORM", over(n, t.rst_storm_min, 1)), "udp": ("UDP_FLOOD_SUSPECTED", high(n, t.udp_flood_min, t.udp_flood_high)),
        "dns": ("DNS_AMPLIFICATION_SUSPECTED", F.when((n >= t.dns_amp_responses) & (ratio >= t.dns_amp_ratio), 3).otherwise(0)), "quic": ("QUIC_CONNECTION_FLOOD", over(keys, t.quic_connections, 3)),
        "quic_way": ("QUIC_LONG_FLOW_ANOMALY", over(n, t.quic_long_flow, 2)), "quic_all": ("QUIC_INITIAL_RATIO_ANOMALY", over(F.try_divide(other, n), t.quic_large_share, 2)), "version": ("QUIC_UNKNOWN_VERSION", over(keys, 1, 1)),
    }
    return {m: (kind, F.when(n > 0, level).otherwise(0)) for m, (kind, level) in found.items()}


def _from_packets(rule, measure: str):
    return lambda packets, t: rule(keyed(signals(packets, t, only=(measure,))), t)


#: Every rule by itself, from packets.
RULES = {name: _from_packets(rule, measure) for name, (rule, measure) in _RULES.items()}

#: The detector that each type of alert names.
DETECTORS = {
    "SYN_FLOOD_SUSPECTED": "rule-based-syn-flood", "PORT_SCAN_SUSPECTED": "rule-based-port-scan", "DNS_TUNNEL_SUSPECTED": "rule-based-dns-tunnel", "LARGE_DATA_TRANSFER": "rule-based-large-transfer",
    "RST_STORM": "rule-based-rst-storm", "UDP_FLOOD_SUSPECTED": "rule-based-udp-flood", "DNS_AMPLIFICATION_SUSPECTED": "rule-based-dns-amplification",
    "QUIC_CONNECTION_FLOOD": "rule-based-quic-connection-flood", "QUIC_LONG_FLOW_ANOMALY": "rule-based-quic-long-flow", "QUIC_INITIAL_RATIO_ANOMALY": "rule-based-quic-initial-ratio",
    "QUIC_UNKNOWN_VERSION": "rule-based-quic-version", "BASELINE_DEVIATION": "ewma-statistical-baseline", "BASELINE_MULTI_DIM": "ewma-statistical-baseline", "ML_ANOMALY": "isolation-forest-unsupervised",
}


def detector(kind: Column) -> Column:
    found = F.lit("unknown")
    for name, by in DETECTORS.items():
        found = F.when(kind == name, by).otherwise(found)
    return found


def time_window(first_ms: Column, last_ms: Column) -> Column:
    """``first ~ last`` as times to the millisecond; empty where one is missing."""
    text = lambda ms: F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd HH:mm:ss.SSS")
    return F.when(first_ms.isNull() | last_ms.isNull(), "").otherwise(F.concat(text(first_ms), F.lit(" ~ "), text(last_ms)))


SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW")


def severity_rank(severity: Column) -> Column:
    rank = F.lit(len(SEVERITIES))
    for i, s in enumerate(SEVERITIES):
        rank = F.when(severity == s, i).otherwise(rank)
    return rank


def alerts_of(found: DataFrame, t: Thresholds) -> DataFrame:
    """Alerts of all rules from ``signals``, whose keys are written once."""
    table = materialize(keyed(found), "keys")
    return reduce(DataFrame.unionByName, [rule(table, t) for rule, _ in _RULES.values()])


def unsorted_alerts(packets: DataFrame, t: Thresholds, captures: bool = False) -> DataFrame:
    return alerts_of(signals(packets, t, captures), t)


def in_order(alerts: DataFrame) -> DataFrame:
    """Alerts by severity, then rule, then the key that was seen first."""
    return alerts.orderBy(severity_rank(F.col("severity")), "rule_ord", "key_ord", "subject")


def all_alerts(packets: DataFrame, t: Thresholds) -> DataFrame:
    return in_order(unsorted_alerts(packets, t))


def severity_summary(alerts: DataFrame) -> DataFrame:
    return alerts.agg(*[F.count_if(F.col("severity") == s).alias(s.lower()) for s in SEVERITIES], F.count(F.lit(1)).alias("total"))


def engine_contribution(alerts: DataFrame) -> DataFrame:
    """Alerts by detector, with their share in ten-thousandths (whole numbers compare exactly)."""
    counted = alerts.groupBy(detector(F.col("type")).alias("detector")).agg(F.count(F.lit(1)).alias("alerts"))
    return counted.withColumn("share_bp", F.floor(F.col("alerts") * 10000 / F.sum("alerts").over(Window.partitionBy())).cast("long"))  # a row per detector


#: Parts of alert types and the stage (0 to 6) that each stands for.
KILL_CHAIN = [("SCAN", 0), ("RECON", 0), ("SYN", 4), ("FLOOD", 4), ("DOS", 4), ("DNS", 5), ("TUNNEL", 5), ("RST", 4), ("LARGE", 6), ("BURST", 6)]


def kill_chain_stages(alerts: DataFrame) -> DataFrame:
    """Stages that the alerts' types name; one type may name several."""
    hit = F.array_distinct(F.array_compact(F.array(*[F.when(F.contains("type", F.lit(p)), F.lit(s).cast("long")) for p, s in KILL_CHAIN])))
    return alerts.select("type", F.explode(hit).alias("stage")).groupBy("stage").agg(F.count(F.lit(1)).alias("alerts"), F.count_distinct("type").alias("types"))


def indicators(alerts: DataFrame) -> DataFrame:
    """Addresses that alerts name, each with its first rule and number of alerts."""
    ip = F.regexp_extract("subject", r"\b(\d+\.\d+\.\d+\.\d+)\b", 1)
    return alerts.withColumn("ip", ip).where("ip <> ''").groupBy(*_by(alerts), "ip").agg(F.min("rule_ord").alias("first_rule"), F.count(F.lit(1)).alias("alerts"))


def syn_candidates(packets: DataFrame, least: int = 50, high: int = 200) -> DataFrame:
    keyed = packets.where(initiator_syn()).groupBy("src_ip").agg(F.count(F.lit(1)).alias("syns"), F.count_distinct("dst_ip").alias("targets"))
    return keyed.where(F.col("syns") >= least).withColumn("severity", _high(F.col("syns"), high))


def scan_candidates(packets: DataFrame, least: int = 20, high: int = 100) -> DataFrame:
    keyed = packets.where(F.col("protocol").isin("TCP", "UDP") & (F.col("dst_port") > 0)).groupBy("src_ip").agg(F.array_sort(F.collect_set("dst_port")).alias("p"))
    return keyed.where(F.size("p") >= least).select(
        "src_ip", F.size("p").cast("long").alias("ports"), F.array_join(F.transform(F.slice("p", 1, 10), lambda x: x.cast("string")), ",").alias("sample"), _high(F.size("p"), high).alias("severity")
    )


def tunnel_candidates(packets: DataFrame, longest: int = 30, high: int = 20, shown: int = 5) -> DataFrame:
    rows = packets.where((F.col("dns_query") != "") & (F.length("dns_query") > longest))
    counts = rows.groupBy("src_ip").agg(F.count(F.lit(1)).alias("queries"))
    # the first few of every stretch of arrivals, then of the source: neither window holds all its queries
    early = rows.withColumn("r", F.row_number().over(Window.partitionBy("src_ip", F.floor(F.col("pkt_seq") / 65536)).orderBy("pkt_seq"))).where(F.col("r") <= shown)
    early = early.withColumn("r", F.row_number().over(Window.partitionBy("src_ip").orderBy("pkt_seq"))).where(F.col("r") <= shown)
    sample = early.groupBy("src_ip").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pkt_seq", "dns_query"))), lambda x: x["dns_query"]), ",").alias("sample"))
    return counts.join(sample, "src_ip").select("src_ip", "queries", "sample", _high(F.col("queries"), high).alias("severity"))


def threshold_sweep(rows: DataFrame, value: Column, truth: Column, cuts: list[float], *by: str) -> DataFrame:
    """For each cut (and ``by``, such as the rule): rows whose value reaches it against the truth, their rates in ten-thousandths, and if it
    is the first cut that finds all and nothing else. Every cut is counted in one pass."""
    each = rows.select(*by, value.alias("v"), truth.alias("t"), F.explode(F.array(*[F.lit(float(c)) for c in cuts])).alias("cut"))
    hit = F.col("v") >= F.col("cut")
    found = each.groupBy(*by, "cut").agg(F.count_if(hit & F.col("t")).alias("tp"), F.count_if(hit & ~F.col("t")).alias("fp"), F.count_if(~hit & F.col("t")).alias("fn"), F.count_if(~hit & ~F.col("t")).alias("tn"))
    rate = lambda a, b: F.coalesce(F.floor(F.try_divide(F.col(a) * 10000, F.col(a) + F.col(b))), F.lit(0)).cast("long")
    perfect = (F.col("fn") == 0) & (F.col("fp") == 0) & (F.col("tp") > 0)
    first = F.min(F.when(perfect, F.col("cut"))).over(Window.partitionBy(*by))  # a row per cut
    return found.withColumns({"tpr_bp": rate("tp", "fn"), "fpr_bp": rate("fp", "tn"), "optimum": F.coalesce(F.col("cut") == first, F.lit(False))})
