"""Traffic queries over the events table as packets, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import baseline, flows, rules, seasonal, windows
from ..schemas import Thresholds
from ..sources.packets import packets_from_events, packets_from_lineitem, table

#: Scaled so that some, not all, keys of the test tables fire.
SCALED = Thresholds(
    syn_flood_min=80, syn_flood_high=100, port_scan_min=15, port_scan_high=19, dns_max_len=30, dns_tunnel_min=50, dns_tunnel_high=60, large_flow_mb=0.00390625, rst_storm_min=85,
    udp_flood_min=50, udp_flood_high=100, dns_amp_ratio=0.5, dns_amp_responses=35, quic_connections=5, quic_long_flow=4, quic_large_share=0.05,
)
HOUR = 3600
SIGMA = 1.5

PACKETS = r"""
base AS (
  SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k, event_id % 3 = 0 AS rev FROM events),
ends AS (
  SELECT *, '10.0.0.' || (user_id % 16) AS a_ip, CAST(40000 + user_id % 5 AS INT) AS a_port, '10.0.1.' || (k % 8) AS b_ip,
         CAST(CASE WHEN event_type = 'purchase' AND k % 2 = 0 THEN 443 ELSE 1000 + k % 20 END AS INT) AS b_port,
         CAST(60 + floor(value * 10) AS BIGINT) AS length FROM base),
packets AS (
  SELECT event_id AS pkt_seq, ts, epoch_us(ts) // 1000 AS ts_ms,
         CASE event_type WHEN 'signup' THEN 'DNS' WHEN 'purchase' THEN 'UDP' ELSE 'TCP' END AS protocol,
         CASE WHEN rev THEN b_ip ELSE a_ip END AS src_ip, CASE WHEN rev THEN b_port ELSE a_port END AS src_port,
         CASE WHEN rev THEN a_ip ELSE b_ip END AS dst_ip, CASE WHEN rev THEN a_port ELSE b_port END AS dst_port,
         length, greatest(length - 54, 0) AS payload_size,
         CASE WHEN event_type = 'click' THEN 'SYN' WHEN event_type = 'view' AND k % 4 = 0 THEN 'SYN,ACK' WHEN event_type = 'view' THEN 'ACK,PSH'
              WHEN event_type = 'error' THEN 'ACK,RST' ELSE '' END AS flags,
         CASE WHEN event_type = 'signup' THEN repeat('a', k % 50) || '.example.com' ELSE '' END AS dns_query,
         CASE WHEN event_type = 'signup' AND rev THEN '10.0.0.1' ELSE '' END AS dns_response,
         CASE WHEN event_type = 'purchase' AND k % 2 = 0 THEN 'UDP QUIC Version=0x' || CASE k % 6 WHEN 0 THEN '00000001' WHEN 2 THEN 'ff00001d' ELSE 'deadbeef' END ELSE '' END AS raw_summary
  FROM ends)"""

_SYN = "protocol = 'TCP' AND contains(flags, 'SYN') AND NOT contains(flags, 'ACK')"

FLOWS = r"""
dirs AS (
  SELECT protocol, least(src_ip || ':' || src_port, dst_ip || ':' || dst_port) AS lo, greatest(src_ip || ':' || src_port, dst_ip || ':' || dst_port) AS hi,
         src_ip, src_port, dst_ip, dst_port, count(*) AS n, CAST(sum(length) AS BIGINT) AS bytes, CAST(sum(payload_size) AS BIGINT) AS payload,
         min(pkt_seq) AS first_seq, min_by(ts_ms, pkt_seq) AS first_ms, max(pkt_seq) AS last_seq, max_by(ts_ms, pkt_seq) AS last_ms
  FROM packets WHERE protocol IN ('TCP', 'UDP') AND src_ip <> '' AND dst_ip <> '' GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY protocol, lo, hi ORDER BY n DESC, src_ip DESC, src_port DESC, dst_ip DESC, dst_port DESC) AS r FROM dirs),
flows AS (
  SELECT protocol, lo, hi, CAST(sum(n) AS BIGINT) AS packets, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(payload) AS BIGINT) AS payload,
         min(first_seq) AS first_seq, min_by(first_ms, first_seq) AS first_ms, max_by(last_ms, last_seq) AS last_ms,
         max(CASE WHEN r = 1 THEN src_ip END) AS dom_src_ip, CAST(max(CASE WHEN r = 1 THEN src_port END) AS BIGINT) AS dom_src_port,
         max(CASE WHEN r = 1 THEN dst_ip END) AS dom_dst_ip, CAST(max(CASE WHEN r = 1 THEN dst_port END) AS BIGINT) AS dom_dst_port,
         max(CASE WHEN r = 1 THEN n END) AS dom_packets, max(CASE WHEN r = 1 THEN bytes END) AS dom_bytes
  FROM ranked GROUP BY protocol, lo, hi)"""

WINDOWS = rf"""
anchor AS (SELECT min_by(ts_ms, pkt_seq) AS t0 FROM packets),
wins AS (
  SELECT CAST(floor((ts_ms - t0) / ({HOUR} * 1000)) AS BIGINT) AS bucket, count(*) AS packets, CAST(sum(length) AS BIGINT) AS bytes, count(*) FILTER ({_SYN}) AS syn,
         count(DISTINCT CASE WHEN dst_port > 0 THEN dst_port END) AS dports
  FROM packets, anchor GROUP BY 1),
windows AS (SELECT row_number() OVER (ORDER BY bucket) - 1 AS window_index, * FROM wins)"""

_TRAIN = 360  # windows that the baseline learns from; the rest are held against it

DIMS = r"""
dims AS (
  SELECT window_index, 0 AS dim_ord, 'packets' AS dimension, CAST(packets AS DOUBLE) AS value FROM windows UNION ALL
  SELECT window_index, 1, 'bytes', CAST(bytes AS DOUBLE) FROM windows UNION ALL
  SELECT window_index, 2, 'syn', CAST(syn AS DOUBLE) FROM windows UNION ALL
  SELECT window_index, 3, 'dports', CAST(dports AS DOUBLE) FROM windows)"""

PROFILE = rf"""
med0 AS (SELECT dimension, median(value) AS m FROM dims WHERE window_index < {_TRAIN} GROUP BY 1),
mad0 AS (SELECT d.dimension, any_value(m) AS m, median(abs(value - m)) AS a FROM dims d JOIN med0 USING (dimension) WHERE window_index < {_TRAIN} GROUP BY 1),
bad AS (SELECT DISTINCT window_index FROM dims JOIN mad0 USING (dimension) WHERE window_index < {_TRAIN} AND a > 0 AND value > m + 3 * a / 0.6745),
clean AS (SELECT * FROM dims WHERE window_index < {_TRAIN} AND window_index NOT IN (SELECT window_index FROM bad)),
med1 AS (SELECT dimension, median(value) AS median FROM clean GROUP BY 1),
prof AS (
  SELECT c.dimension, any_value(median) AS median, median(abs(value - median)) AS raw_mad, count(*) AS samples FROM clean c JOIN med1 USING (dimension) GROUP BY 1),
profile AS (
  SELECT dimension, median, greatest(raw_mad, 1.0, median * CASE dimension WHEN 'packets' THEN 0.30::DOUBLE ELSE 0.50::DOUBLE END) AS mad, raw_mad, samples FROM prof),
devs AS (
  SELECT d.window_index, dim_ord, d.dimension, value, p.median, p.mad, (value - p.median) * 0.6745::DOUBLE / p.mad AS z
  FROM dims d JOIN profile p USING (dimension) WHERE window_index >= {_TRAIN}),
deviations AS (SELECT *, CASE WHEN z > 2 * {SIGMA}::DOUBLE THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM devs WHERE z > {SIGMA}::DOUBLE)"""


def _with(*parts: str, recursive: bool = False) -> str:
    return "WITH " + "RECURSIVE " * recursive + ",".join(parts) + "\n"


def _packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets_from_events(table(spark, sf_dir, "events"))


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.windows(_packets(spark, sf_dir), HOUR)


def _train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark, sf_dir).where(F.col("window_index") < _TRAIN)


def _later(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark, sf_dir).where(F.col("window_index") >= _TRAIN)


def _profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baseline.learn(_train(spark, sf_dir))


def _deviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baseline.deviations(_later(spark, sf_dir), _profile(spark, sf_dir), SIGMA)


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark, sf_dir).select(F.col("window_index").alias("idx"), F.col("packets").cast("double").alias("value"))


QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = sql


P = _with(PACKETS)
_add("protocol_distribution", lambda s, d: flows.protocol_distribution(_packets(s, d)), P + "SELECT protocol, count(*) AS packets, min(pkt_seq) AS first_seq FROM packets GROUP BY 1")
_add("top_talkers", lambda s, d: flows.top_talkers(_packets(s, d)), P + """
SELECT src_ip || ' -> ' || dst_ip AS pair, count(*) AS packets, CAST(sum(length) AS BIGINT) AS bytes, min(pkt_seq) AS first_seq
FROM packets WHERE src_ip <> '' AND dst_ip <> '' GROUP BY 1 ORDER BY bytes DESC, first_seq LIMIT 10""")
_add("tcp_conversations", lambda s, d: flows.tcp_conversations(_packets(s, d)), P + """
SELECT least(src_ip || ':' || src_port, dst_ip || ':' || dst_port) AS lo, greatest(src_ip || ':' || src_port, dst_ip || ':' || dst_port) AS hi,
       row_number() OVER (PARTITION BY least(src_ip || ':' || src_port, dst_ip || ':' || dst_port), greatest(src_ip || ':' || src_port, dst_ip || ':' || dst_port) ORDER BY pkt_seq) AS place, pkt_seq FROM packets WHERE protocol = 'TCP'""")
_add("flow_aggregate", lambda s, d: flows.flows(_packets(s, d)).select("protocol", "lo", "hi", "packets", "bytes", "payload", "first_ms", "last_ms"),
     _with(PACKETS, FLOWS) + "SELECT protocol, lo, hi, packets, bytes, payload, first_ms, last_ms FROM flows")
_add("flow_dominant_direction", lambda s, d: flows.flows(_packets(s, d)).select("protocol", "lo", "hi", "dom_src_ip", "dom_src_port", "dom_dst_ip", "dom_dst_port", "dom_packets", "dom_bytes"),
     _with(PACKETS, FLOWS) + "SELECT protocol, lo, hi, dom_src_ip, dom_src_port, dom_dst_ip, dom_dst_port, dom_packets, dom_bytes FROM flows")
_add("flow_flag_counts", lambda s, d: flows.flow_flag_counts(_packets(s, d)), P + """
SELECT protocol, least(src_ip || ':' || src_port, dst_ip || ':' || dst_port) AS lo, greatest(src_ip || ':' || src_port, dst_ip || ':' || dst_port) AS hi,
""" + ", ".join(f"count(*) FILTER (list_contains(string_split(flags, ','), '{f}')) AS {f.lower()}" for f in flows.FLAGS) + """
FROM packets WHERE protocol IN ('TCP', 'UDP') GROUP BY 1, 2, 3""")
_add("flow_stats_summary", lambda s, d: flows.flow_stats(flows.flows(_packets(s, d))), _with(PACKETS, FLOWS) + """
SELECT count(*) AS flows, CAST(sum(packets) AS BIGINT) AS packets, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(payload) AS BIGINT) AS payload, round(sum(packets)::DOUBLE / count(*), 2) AS avg_packets, round(sum(bytes)::DOUBLE / count(*), 2) AS avg_bytes, max(bytes) AS max_bytes, max(packets) AS max_packets,
       count(DISTINCT dom_src_ip) AS src_ips, count(DISTINCT dom_dst_ip) AS dst_ips, count(DISTINCT dom_src_port) AS src_ports, count(DISTINCT dom_dst_port) AS dst_ports,
       count(DISTINCT split_part(lo, ':', 1) || '|' || split_part(hi, ':', 1)) AS ip_pairs FROM flows""")
_add("flow_protocols", lambda s, d: flows.flow_protocols(flows.flows(_packets(s, d))), _with(PACKETS, FLOWS) + "SELECT protocol, count(*) AS flows, CAST(floor(count(*) * 10000 / (SELECT count(*) FROM flows)) AS BIGINT) AS share_bp FROM flows GROUP BY 1")
_add("top_flow_ports", lambda s, d: flows.most_common(flows.flows(_packets(s, d)), "dom_dst_port", 5), _with(PACKETS, FLOWS) + "SELECT value, n FROM (SELECT dom_dst_port AS value, count(*) AS n, min(first_seq) AS f FROM flows GROUP BY 1 ORDER BY n DESC, f LIMIT 5)")
_add("flow_records", lambda s, d: flows.flow_records(flows.flows(_packets(s, d)), flows.flow_flag_counts(_packets(s, d))).select("protocol", "lo", "hi", "packets", "syn", "rst", F.array_join(F.array_sort(F.transform(F.map_entries("flag_counts"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))), ",").alias("flags")),
     _with(PACKETS, FLOWS) + """,
k AS (SELECT protocol, least(src_ip || ':' || src_port, dst_ip || ':' || dst_port) AS lo, greatest(src_ip || ':' || src_port, dst_ip || ':' || dst_port) AS hi, unnest(string_split(flags, ',')) AS f FROM packets WHERE protocol IN ('TCP', 'UDP')),
c AS (SELECT protocol, lo, hi, f, count(*) AS n FROM k WHERE f <> '' GROUP BY ALL)
SELECT protocol, lo, hi, any_value(packets) AS packets, CAST(coalesce(sum(n) FILTER (f = 'SYN'), 0) AS BIGINT) AS syn, CAST(coalesce(sum(n) FILTER (f = 'RST'), 0) AS BIGINT) AS rst, coalesce(string_agg(f || '=' || n, ',' ORDER BY f || '=' || n), '') AS flags FROM flows LEFT JOIN c USING (protocol, lo, hi) GROUP BY 1, 2, 3""")
_add("flows_by_ip_port", lambda s, d: flows.flows_with(flows.flows(_packets(s, d)), "tcp", "10.0.1.3", 1003).select("protocol", "lo", "hi", "packets"),
     _with(PACKETS, FLOWS) + "SELECT protocol, lo, hi, packets FROM flows WHERE protocol = 'TCP' AND (dom_src_ip = '10.0.1.3' OR dom_dst_ip = '10.0.1.3') AND (dom_src_port = 1003 OR dom_dst_port = 1003)")
for _by in ("bytes", "packets"):
    _add(f"top_flows_by_{_by}", lambda s, d, by=_by: flows.top_flows(flows.flows(_packets(s, d)), by).select("protocol", "lo", "hi", "packets", "bytes"),
         _with(PACKETS, FLOWS) + f"SELECT protocol, lo, hi, packets, bytes FROM flows ORDER BY {_by} DESC, first_seq LIMIT 10")
_add("capture_summary", lambda s, d: flows.capture_summary(_packets(s, d)), P + "SELECT count(*) AS packets, CAST(sum(length) AS BIGINT) AS bytes, min_by(ts_ms, pkt_seq) AS first_ms, max_by(ts_ms, pkt_seq) AS last_ms FROM packets")
_add("filter_by_ip_port", lambda s, d: flows.of_port(flows.of_ip(flows.of_protocol(_packets(s, d), "tcp"), "10.0.1.3"), 1003).select("pkt_seq", "src_ip", "dst_ip", "length"),
     P + "SELECT pkt_seq, src_ip, dst_ip, length FROM packets WHERE protocol = 'TCP' AND (src_ip = '10.0.1.3' OR dst_ip = '10.0.1.3') AND (src_port = 1003 OR dst_port = 1003)")
_add("first_n_sample", lambda s, d: flows.first_packets(_packets(s, d), 100).select("pkt_seq", "protocol", "src_ip", "dst_ip", "length"),
     P + "SELECT pkt_seq, protocol, src_ip, dst_ip, length FROM packets ORDER BY pkt_seq LIMIT 100")
_add("flag_rendering", lambda s, d: _packets(s, d).select("pkt_seq", flows.flag_text((F.col("pkt_seq") % 64).cast("int")).alias("names"), flows.icmp_type((F.col("pkt_seq") % 13).cast("int")).alias("icmp")), P + """
SELECT pkt_seq, concat_ws(',', CASE WHEN b & 2 <> 0 THEN 'SYN' END, CASE WHEN b & 16 <> 0 THEN 'ACK' END, CASE WHEN b & 1 <> 0 THEN 'FIN' END,
  CASE WHEN b & 4 <> 0 THEN 'RST' END, CASE WHEN b & 8 <> 0 THEN 'PSH' END, CASE WHEN b & 32 <> 0 THEN 'URG' END) AS names,
  CASE pkt_seq % 13 WHEN 0 THEN 'Echo Reply' WHEN 3 THEN 'Destination Unreachable' WHEN 5 THEN 'Redirect' WHEN 8 THEN 'Echo Request' WHEN 11 THEN 'Time Exceeded' ELSE 'Type-' || (pkt_seq % 13) END AS icmp
FROM (SELECT pkt_seq, pkt_seq % 64 AS b FROM packets)""")
_add("lineitem_flows", lambda s, d: flows.flows(packets_from_lineitem(table(s, d, "lineitem")), ordered=False).select("protocol", "lo", "hi", "packets", "bytes", "dom_src_ip", "dom_src_port", "dom_packets"), r"""
WITH p AS (
  SELECT CASE WHEN l_linenumber % 4 = 0 THEN 'UDP' ELSE 'TCP' END AS protocol, l_returnflag <> 'R' AS fwd, '10.1.0.' || (l_suppkey % 20) AS a, '10.1.0.' || (l_partkey % 20) AS b,
         CAST(floor(l_extendedprice) AS BIGINT) AS length FROM lineitem),
q AS (SELECT protocol, length, CASE WHEN fwd THEN a ELSE b END AS src_ip, CASE WHEN fwd THEN 41000 ELSE 80 END AS src_port, CASE WHEN fwd THEN b ELSE a END AS dst_ip, CASE WHEN fwd THEN 80 ELSE 41000 END AS dst_port FROM p),
d AS (
  SELECT protocol, least(src_ip || ':' || src_port, dst_ip || ':' || dst_port) AS lo, greatest(src_ip || ':' || src_port, dst_ip || ':' || dst_port) AS hi, src_ip, src_port, dst_ip, dst_port,
         count(*) AS n, CAST(sum(length) AS BIGINT) AS bytes FROM q GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY protocol, lo, hi ORDER BY n DESC, src_ip DESC, src_port DESC, dst_ip DESC, dst_port DESC) AS k FROM d)
SELECT protocol, lo, hi, CAST(sum(n) AS BIGINT) AS packets, CAST(sum(bytes) AS BIGINT) AS bytes, max(CASE WHEN k = 1 THEN src_ip END) AS dom_src_ip,
       CAST(max(CASE WHEN k = 1 THEN src_port END) AS BIGINT) AS dom_src_port, max(CASE WHEN k = 1 THEN n END) AS dom_packets FROM r GROUP BY 1, 2, 3""")

_MS = "min_by(ts_ms, pkt_seq) AS first_ms, max_by(ts_ms, pkt_seq) AS last_ms, min(pkt_seq) AS key_ord"
def rule_sql(_T: Thresholds) -> dict[str, str]:
    """SQL of every rule over packets and flows."""
    return {
    "rule_syn_flood": rf"""
SELECT 1 AS rule_ord, 'SYN_FLOOD_SUSPECTED' AS type, CASE WHEN net > {_T.syn_flood_high} THEN 'HIGH' ELSE 'MEDIUM' END AS severity, src_ip AS subject, CAST(net AS DOUBLE) AS value,
       CAST(NULL AS VARCHAR) AS detail, key_ord, first_ms, last_ms
FROM (SELECT s.src_ip, s.n - coalesce(a.n, 0) AS net, first_ms, last_ms, key_ord
      FROM (SELECT src_ip, count(*) AS n, {_MS} FROM packets WHERE {_SYN} GROUP BY 1) s
      LEFT JOIN (SELECT dst_ip, count(*) AS n FROM packets WHERE protocol = 'TCP' AND contains(flags, 'SYN') AND contains(flags, 'ACK') GROUP BY 1) a ON s.src_ip = a.dst_ip)
WHERE net >= {_T.syn_flood_min}""",
    "rule_port_scan": rf"""
SELECT 2 AS rule_ord, 'PORT_SCAN_SUSPECTED' AS type, CASE WHEN n > {_T.port_scan_high} THEN 'HIGH' ELSE 'MEDIUM' END AS severity, src_ip AS subject, CAST(n AS DOUBLE) AS value,
       array_to_string(list_sort(p)[1:20], ',') AS detail, key_ord, first_ms, last_ms
FROM (SELECT src_ip, list(DISTINCT dst_port) AS p, count(DISTINCT dst_port) AS n, {_MS} FROM packets WHERE {_SYN} AND src_ip <> '' AND dst_port > 0 GROUP BY 1) WHERE n >= {_T.port_scan_min}""",
    "rule_dns_tunnel": rf"""
SELECT 3 AS rule_ord, 'DNS_TUNNEL_SUSPECTED' AS type, CASE WHEN n > {_T.dns_tunnel_high} THEN 'HIGH' ELSE 'MEDIUM' END AS severity, src_ip AS subject, CAST(n AS DOUBLE) AS value, CAST(NULL AS VARCHAR) AS detail, key_ord, first_ms, last_ms
FROM (SELECT src_ip, count(*) AS n, {_MS} FROM packets WHERE protocol = 'DNS' AND length(rtrim(dns_query, '.')) > {_T.dns_max_len} GROUP BY 1) WHERE n >= {_T.dns_tunnel_min}""",
    "rule_large_transfer": rf"""
SELECT 4 AS rule_ord, 'LARGE_DATA_TRANSFER' AS type, 'MEDIUM' AS severity, protocol || '|' || lo || '|' || hi AS subject, CAST(bytes AS DOUBLE) AS value,
       dom_src_ip || ':' || dom_src_port || ' -> ' || dom_dst_ip || ':' || dom_dst_port AS detail, first_seq AS key_ord, first_ms, last_ms
FROM flows WHERE bytes > {_T.large_flow_mb} * 1024 * 1024""",
    "rule_rst_storm": rf"""
SELECT 5 AS rule_ord, 'RST_STORM' AS type, 'LOW' AS severity, src_ip AS subject, CAST(n AS DOUBLE) AS value, CAST(NULL AS VARCHAR) AS detail, key_ord, first_ms, last_ms
FROM (SELECT src_ip, count(*) AS n, {_MS} FROM packets WHERE protocol = 'TCP' AND contains(flags, 'RST') GROUP BY 1) WHERE n >= {_T.rst_storm_min}""",
    "rule_udp_flood": rf"""
SELECT 6 AS rule_ord, 'UDP_FLOOD_SUSPECTED' AS type, CASE WHEN n > {_T.udp_flood_high} THEN 'HIGH' ELSE 'MEDIUM' END AS severity, dst_ip AS subject, CAST(n AS DOUBLE) AS value, CAST(NULL AS VARCHAR) AS detail, key_ord, first_ms, last_ms
FROM (SELECT dst_ip, count(*) AS n, {_MS} FROM packets WHERE protocol = 'UDP' GROUP BY 1) WHERE n >= {_T.udp_flood_min}""",
    "rule_dns_amplification": rf"""
SELECT 7 AS rule_ord, 'DNS_AMPLIFICATION_SUSPECTED' AS type, 'HIGH' AS severity, r.dst_ip AS subject, CAST(n AS DOUBLE) AS value, out || '/' || coalesce(asked, 1) AS detail, key_ord, first_ms, last_ms
FROM (SELECT dst_ip, count(*) AS n, CAST(sum(length) AS BIGINT) AS out, {_MS} FROM packets WHERE protocol = 'DNS' AND dns_response <> '' AND dst_ip <> '' GROUP BY 1) r
LEFT JOIN (SELECT src_ip, CAST(sum(length) AS BIGINT) AS asked FROM packets WHERE protocol = 'DNS' AND dns_response = '' AND dns_query <> '' GROUP BY 1) q ON r.dst_ip = q.src_ip
WHERE n >= {_T.dns_amp_responses} AND CASE WHEN coalesce(asked, 1) > 0 THEN out::DOUBLE / coalesce(asked, 1) ELSE out END >= {_T.dns_amp_ratio}""",
    "rule_quic_conn_flood": rf"""
SELECT 8 AS rule_ord, 'QUIC_CONNECTION_FLOOD' AS type, 'HIGH' AS severity, src_ip AS subject, CAST(n AS DOUBLE) AS value, CAST(NULL AS VARCHAR) AS detail, key_ord, first_ms, last_ms
FROM (SELECT src_ip, count(DISTINCT src_port) AS n, {_MS} FROM packets WHERE protocol = 'UDP' AND dst_port = 443 GROUP BY 1) WHERE n >= {_T.quic_connections}""",
    "rule_quic_long_flow": rf"""
SELECT 9 AS rule_ord, 'QUIC_LONG_FLOW_ANOMALY' AS type, 'MEDIUM' AS severity, flow AS subject, CAST(n AS DOUBLE) AS value, CAST(NULL AS VARCHAR) AS detail, key_ord, first_ms, last_ms
FROM (SELECT src_ip || ':' || src_port || '->' || dst_ip || ':' || dst_port AS flow, count(*) AS n, {_MS} FROM packets WHERE protocol = 'UDP' AND dst_port = 443 GROUP BY 1) WHERE n >= {_T.quic_long_flow}""",
    "rule_quic_initial_ratio": rf"""
SELECT 10 AS rule_ord, 'QUIC_INITIAL_RATIO_ANOMALY' AS type, 'MEDIUM' AS severity, 'all' AS subject, CAST(large AS DOUBLE) AS value, CAST(n AS VARCHAR) AS detail, key_ord, first_ms, last_ms
FROM (SELECT count(*) AS n, count(*) FILTER (length > {_T.quic_large_bytes}) AS large, {_MS} FROM packets WHERE protocol = 'UDP' AND dst_port = 443) WHERE n > 0 AND large::DOUBLE / n >= {_T.quic_large_share}""",
    "rule_quic_unknown_version": r"""
SELECT 11 AS rule_ord, 'QUIC_UNKNOWN_VERSION' AS type, 'LOW' AS severity, 'all' AS subject, CAST(len(v) AS DOUBLE) AS value, array_to_string(list_sort(v)[1:100], ',') AS detail, key_ord, first_ms, last_ms
FROM (SELECT list(DISTINCT ver) AS v, """ + _MS + r""" FROM (SELECT *, lower(regexp_extract(raw_summary, 'Version[=:\s]+0x([0-9a-fA-F]+)', 1)) AS ver FROM packets
      WHERE protocol = 'UDP' AND dst_port = 443 AND contains(raw_summary, 'QUIC')) WHERE ver NOT IN ('', '00000000', '00000001', '6b3343cf', 'ff000020', 'ff000021', 'ff00001d')) WHERE len(v) > 0""",
}


_RULE_SQL = rule_sql(SCALED)
for _name, _rule in rules.RULES.items():
    _add(_name, lambda s, d, rule=_rule: rule(_packets(s, d), SCALED), _with(PACKETS, FLOWS) + f"SELECT * REPLACE (CAST(rule_ord AS BIGINT) AS rule_ord) FROM ({_RULE_SQL[_name]})")
ALERTS = "\nalerts AS (" + "\nUNION ALL BY NAME\n".join(f"SELECT * FROM ({x})" for x in _RULE_SQL.values()) + ")"
_A = _with(PACKETS, FLOWS, ALERTS)


def _alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.all_alerts(_packets(spark, sf_dir), SCALED)


_add("alerts_all_sorted", _alerts, _A + "SELECT * REPLACE (CAST(rule_ord AS BIGINT) AS rule_ord) FROM alerts")
_add("severity_summary", lambda s, d: rules.severity_summary(_alerts(s, d)), _A + """
SELECT count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'HIGH') AS high, count(*) FILTER (severity = 'MEDIUM') AS medium, count(*) FILTER (severity = 'LOW') AS low, count(*) AS total FROM alerts""")
_add("engine_contribution", lambda s, d: rules.engine_contribution(_alerts(s, d)), _A + "SELECT CASE type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rules.DETECTORS.items()) + " ELSE 'unknown' END AS detector, count(*) AS alerts, CAST(floor(count(*) * 10000 / (SELECT count(*) FROM alerts)) AS BIGINT) AS share_bp FROM alerts GROUP BY 1")
_add("alert_windows", lambda s, d: _alerts(s, d).select("type", "subject", rules.time_window(F.col("first_ms"), F.col("last_ms")).alias("time_window")),
     _A + "SELECT type, subject, strftime(make_timestamp(first_ms * 1000), '%Y-%m-%d %H:%M:%S.%g') || ' ~ ' || strftime(make_timestamp(last_ms * 1000), '%Y-%m-%d %H:%M:%S.%g') AS time_window FROM alerts")
_add("kill_chain_stages", lambda s, d: rules.kill_chain_stages(_alerts(s, d)), _A + """
SELECT stage, count(*) AS alerts, count(DISTINCT type) AS types FROM (
  SELECT type, unnest(list_distinct(list_filter([""" + ", ".join(f"CASE WHEN contains(type, '{p}') THEN {s}::BIGINT END" for p, s in rules.KILL_CHAIN) + """], lambda x: x IS NOT NULL))) AS stage FROM alerts) GROUP BY 1""")
_add("ioc_extract", lambda s, d: rules.indicators(_alerts(s, d)), _A + r"""
SELECT ip, CAST(min(rule_ord) AS BIGINT) AS first_rule, count(*) AS alerts FROM (SELECT *, regexp_extract(subject, '\b(\d+\.\d+\.\d+\.\d+)\b', 1) AS ip FROM alerts) WHERE ip <> '' GROUP BY 1""")
_add("syn_flood_candidates", lambda s, d: rules.syn_candidates(_packets(s, d)), P + f"""
SELECT src_ip, count(*) AS syns, count(DISTINCT dst_ip) AS targets, CASE WHEN count(*) > 200 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM packets WHERE {_SYN} GROUP BY 1 HAVING count(*) >= 50""")
_add("port_scan_candidates", lambda s, d: rules.scan_candidates(_packets(s, d)), P + """
SELECT src_ip, count(DISTINCT dst_port) AS ports, array_to_string(list_sort(list(DISTINCT dst_port))[1:10], ',') AS sample, CASE WHEN count(DISTINCT dst_port) > 100 THEN 'HIGH' ELSE 'MEDIUM' END AS severity
FROM packets WHERE protocol IN ('TCP', 'UDP') AND dst_port > 0 GROUP BY 1 HAVING count(DISTINCT dst_port) >= 20""")
_add("dns_tunnel_candidates", lambda s, d: rules.tunnel_candidates(_packets(s, d)), P + """
SELECT src_ip, count(*) AS queries, array_to_string(list(dns_query ORDER BY pkt_seq)[1:5], ',') AS sample, CASE WHEN count(*) > 20 THEN 'HIGH' ELSE 'MEDIUM' END AS severity
FROM packets WHERE dns_query <> '' AND length(dns_query) > 30 GROUP BY 1""")
_CUTS = [20, 40, 60, 80, 100]


def _sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SYN counts of sources by day against days on which the source was answered by a reset."""
    p = _packets(spark, sf_dir)
    day = F.floor(F.col("ts_ms") / 86_400_000).alias("day")
    syns = p.groupBy(day, F.col("src_ip").alias("ip")).agg(F.count_if(flows.initiator_syn()).alias("syns"))
    hit = p.where(flows.has_flag("RST")).select(day, F.col("dst_ip").alias("ip")).distinct().withColumn("hit", F.lit(True))
    rows = syns.join(hit, ["day", "ip"], "left")
    return rules.threshold_sweep(rows, F.col("syns"), F.coalesce("hit", F.lit(False)), _CUTS)


_add("threshold_sweep", _sweep, P + f"""
, k AS (SELECT ts_ms // 86400000 AS day, src_ip AS ip, count(*) FILTER ({_SYN}) AS syns FROM packets GROUP BY 1, 2),
h AS (SELECT DISTINCT ts_ms // 86400000 AS day, dst_ip AS ip FROM packets WHERE contains(flags, 'RST')),
r AS (SELECT syns, h.ip IS NOT NULL AS t FROM k LEFT JOIN h USING (day, ip)),
c AS (SELECT cut::DOUBLE AS cut, count(*) FILTER (syns >= cut AND t) AS tp, count(*) FILTER (syns >= cut AND NOT t) AS fp, count(*) FILTER (syns < cut AND t) AS fn, count(*) FILTER (syns < cut AND NOT t) AS tn FROM r, (VALUES {", ".join(f"({c})" for c in _CUTS)}) c(cut) GROUP BY 1)
SELECT *, CASE WHEN tp + fn > 0 THEN CAST(floor(tp * 10000 / (tp + fn)) AS BIGINT) ELSE 0 END AS tpr_bp, CASE WHEN fp + tn > 0 THEN CAST(floor(fp * 10000 / (fp + tn)) AS BIGINT) ELSE 0 END AS fpr_bp,
       coalesce(cut = min(CASE WHEN fn = 0 AND fp = 0 AND tp > 0 THEN cut END) OVER (), false) AS optimum FROM c""")

_W = _with(PACKETS, WINDOWS)
_B = _with(PACKETS, WINDOWS, DIMS, PROFILE)
_add("window_aggregate", _windows, _W + "SELECT * FROM windows")
_add("window_series", lambda s, d: _windows(s, d).select("window_index", "packets", "bytes"), _W + "SELECT window_index, packets, bytes FROM windows")
_add("epoch_slices", lambda s, d: windows.epoch_slices(_packets(s, d), HOUR), P + f"""
SELECT CAST(floor(ts_ms / ({HOUR} * 1000)) AS BIGINT) AS bucket, count(*) AS packets, CAST(sum(length) AS BIGINT) AS bytes, count(*) FILTER ({_SYN}) AS syn FROM packets GROUP BY 1""")
_add("prefix_cumulative", lambda s, d: windows.prefix_cumulative(_packets(s, d), HOUR).drop("capture_id"), _W + f""",
f AS (SELECT src_ip, min(CAST(floor((ts_ms - t0) / ({HOUR} * 1000)) AS BIGINT)) AS bucket FROM packets, anchor GROUP BY 1),
g AS (SELECT bucket, count(*) AS fresh FROM f GROUP BY 1)
SELECT window_index, CAST(sum(packets) OVER w AS BIGINT) AS cum_packets, CAST(sum(bytes) OVER w AS BIGINT) AS cum_bytes, CAST(sum(syn) OVER w AS BIGINT) AS cum_syn, CAST(sum(coalesce(fresh, 0)) OVER w AS BIGINT) AS cum_sources
FROM windows LEFT JOIN g USING (bucket) WINDOW w AS (ORDER BY bucket)""")
_add("baseline_trim", lambda s, d: baseline.trimmed(_train(s, d)).select("window_index", "packets", "bytes"), _B + f"SELECT window_index, packets, bytes FROM windows WHERE window_index < {_TRAIN} AND window_index NOT IN (SELECT window_index FROM bad)")
_add("baseline_learn", _profile, _B + "SELECT dimension, median, mad, raw_mad, samples FROM profile")
_add("baseline_deviations_frozen", lambda s, d: _deviations(s, d).select("window_index", "dimension", "value", "severity"), _B + "SELECT window_index, dimension, value, severity FROM deviations")
_add("baseline_multi_dim", lambda s, d: baseline.multi_dimension(_deviations(s, d)), _B + """
SELECT window_index, string_agg(dimension, ',' ORDER BY dim_ord) AS dimensions, count(*) AS dimension_count, CASE WHEN count(*) >= 3 OR max(z) > 6 THEN 'CRITICAL' ELSE 'HIGH' END AS severity
FROM deviations GROUP BY 1 HAVING count(*) >= 2""")
_add("baseline_top3_per_dim", lambda s, d: baseline.top_per_dimension(_deviations(s, d)), _B + """
SELECT dimension, rank, window_index, value, severity FROM (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY z DESC, window_index) AS rank FROM deviations) WHERE rank <= 3""")


def _ewma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baseline.smoothed_windows(baseline.smoothed(_later(spark, sf_dir), _profile(spark, sf_dir), SIGMA, 0.1))


_D4 = ("packets", "bytes", "syn", "dports")
_SENS = {"packets": "0.30", "bytes": "0.50", "syn": "0.50", "dports": "0.50"}
_Z = {c: f"(w.{c}::DOUBLE - e.{c}_m) * 0.6745::DOUBLE / e.{c}_a > {SIGMA}::DOUBLE" for c in _D4}
_CALM = "NOT (" + " OR ".join(f"({z})" for z in _Z.values()) + ")"
_MID = {c: f"(0.1::DOUBLE * w.{c}::DOUBLE + 0.9::DOUBLE * e.{c}_m)" for c in _D4}
_add("baseline_ewma_online", _ewma, "WITH RECURSIVE " + ",".join((PACKETS, WINDOWS, DIMS, PROFILE)) + f""",
later AS (SELECT row_number() OVER (ORDER BY window_index) AS r, * FROM windows WHERE window_index >= {_TRAIN}),
ewma AS (
  SELECT CAST(0 AS BIGINT) AS r, CAST(-1 AS BIGINT) AS window_index, '' AS dimensions, CAST(0 AS BIGINT) AS calm, {", ".join(f"(SELECT median FROM profile WHERE dimension = '{c}') AS {c}_m, (SELECT mad FROM profile WHERE dimension = '{c}') AS {c}_a" for c in _D4)}
  UNION ALL
  SELECT w.r, w.window_index, concat_ws(',', {", ".join(f"CASE WHEN {_Z[c]} THEN '{c}' END" for c in _D4)}), CASE WHEN {_CALM} THEN 1::BIGINT ELSE 0::BIGINT END,
    {", ".join(f"CASE WHEN {_CALM} THEN round({_MID[c]}, 4) ELSE e.{c}_m END, CASE WHEN {_CALM} THEN round(greatest(0.1::DOUBLE * abs(w.{c}::DOUBLE - e.{c}_m) + 0.9::DOUBLE * e.{c}_a, 1.0::DOUBLE, {_MID[c]} * {_SENS[c]}::DOUBLE), 4) ELSE e.{c}_a END" for c in _D4)}
  FROM ewma e JOIN later w ON w.r = e.r + 1)
SELECT window_index, dimensions, calm FROM ewma WHERE r > 0""")
_add("ks_drift", lambda s, d: baseline.drift(_train(s, d), _later(s, d)), _B + f""",
t AS (SELECT dimension, value, count(*) FILTER (window_index < {_TRAIN}) AS x, count(*) FILTER (window_index >= {_TRAIN}) AS y FROM dims GROUP BY 1, 2),
c AS (SELECT dimension, sum(x) OVER (PARTITION BY dimension ORDER BY value) AS cx, sum(y) OVER (PARTITION BY dimension ORDER BY value) AS cy, sum(x) OVER (PARTITION BY dimension) AS n1, sum(y) OVER (PARTITION BY dimension) AS n2 FROM t),
m AS (SELECT dimension, CAST(max(abs(cx * n2 - cy * n1)) AS BIGINT) AS numerator, CAST(any_value(n1) AS BIGINT) AS n1, CAST(any_value(n2) AS BIGINT) AS n2 FROM c GROUP BY 1)
SELECT dimension, numerator, n1, n2, CAST(numerator::DOUBLE / (n1 * n2) > 1.36 * sqrt((n1 + n2)::DOUBLE / (n1 * n2)) AS BIGINT) AS detected FROM m WHERE n2 >= 5""")
_add("sigma_sensitivity", lambda s, d: baseline.sensitivity(_later(s, d), _profile(s, d), [0.5, 1.0, 1.5, 2.0, 3.0]), _B + """
SELECT sigma, count(*) AS deviations, count(DISTINCT window_index) AS windows FROM devs, (VALUES (0.5::DOUBLE), (1.0), (1.5), (2.0), (3.0)) s(sigma) WHERE z > sigma GROUP BY 1""")
_PARTS = _with(PACKETS, WINDOWS) + """,
x AS (SELECT window_index AS idx, packets::DOUBLE AS value, avg(packets::DOUBLE) OVER (ORDER BY window_index ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS trend FROM windows),
y AS (SELECT *, avg(value - trend) OVER (PARTITION BY idx % 24) AS seasonal FROM x),
parts AS (SELECT *, value - trend - seasonal AS residual FROM y)"""


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seasonal.decompose(_series(spark, sf_dir), 24)


_add("seasonal_decompose", lambda s, d: _parts(s, d).select("idx", "value", *[F.round(c, 6).alias(c) for c in ("trend", "seasonal", "residual")]), _PARTS + " SELECT idx, value, round(trend, 6) AS trend, round(seasonal, 6) AS seasonal, round(residual, 6) AS residual FROM parts")
_add("seasonal_anomalies", lambda s, d: seasonal.anomalies(_parts(s, d), 2.0), _PARTS + """,
st AS (SELECT avg(residual) AS m, CASE WHEN stddev_pop(residual) > 0 THEN stddev_pop(residual) ELSE 1 END AS s FROM parts)
SELECT idx, value, CASE WHEN residual > m THEN 'high' ELSE 'low' END AS direction, CASE WHEN abs(residual - m) / s > 5 THEN 'CRITICAL' WHEN abs(residual - m) / s > 4 THEN 'HIGH' ELSE 'MEDIUM' END AS severity
FROM parts, st WHERE abs(residual - m) > 2 * s""")
_add("seasonal_stats", lambda s, d: seasonal.statistics(_parts(s, d)).select("n", *[F.round(c, 6).alias(c) for c in ("trend_explained", "seasonal_explained", "residual_explained", "amplitude", "slope")]), _PARTS + """
SELECT count(*) AS n, round(var_pop(trend) / var_pop(value), 6) AS trend_explained, round(var_pop(seasonal) / var_pop(value), 6) AS seasonal_explained, round(var_pop(residual) / var_pop(value), 6) AS residual_explained,
       round(max(seasonal) - min(seasonal), 6) AS amplitude, round((max_by(trend, idx) - min_by(trend, idx)) / count(*), 6) AS slope FROM parts""")
