"""Parameters and schemas shared by the operators."""

from __future__ import annotations

from dataclasses import dataclass

#: Packet records. Empty text and 0 stand for "missing"; pkt_seq is the order of arrival.
PACKET_SCHEMA = (
    "capture_id string, pkt_seq long, ts timestamp, ts_ms long, protocol string, src_ip string, src_port int, dst_ip string, dst_port int, "
    "length long, flags string, payload_size long, tcp_window int, raw_summary string, dns_query string, dns_response string"
)


@dataclass(frozen=True)
class Thresholds:
    """Detection thresholds. A ``min`` is met at the value itself, a ``high`` above it."""

    syn_flood_min: int = 80
    syn_flood_high: int = 500
    port_scan_min: int = 15
    port_scan_high: int = 100
    dns_max_len: int = 30
    dns_tunnel_min: int = 3
    dns_tunnel_high: int = 20
    large_flow_mb: float = 10.0
    rst_storm_min: int = 30
    udp_flood_min: int = 100
    udp_flood_high: int = 500
    dns_amp_ratio: float = 5.0
    dns_amp_responses: int = 5
    quic_connections: int = 50
    quic_long_flow: int = 200
    quic_large_share: float = 0.3
    quic_large_bytes: int = 1200


@dataclass(frozen=True)
class BaselineSettings:
    window_sec: int = 10
    alpha: float = 0.1
    sigma: float = 3.0
    min_windows: int = 20
    drift_windows: int = 10


#: Windowed dimensions in fixed order, with the smallest share of the median that counts as spread.
DIMENSIONS = {"packets": 0.30, "bytes": 0.50, "syn": 0.50, "dports": 0.50}

#: From the median absolute deviation to a standard deviation.
MAD_SCALE = 0.6745
