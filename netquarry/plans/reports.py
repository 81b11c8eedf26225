"""What reports print: text summaries, indicator lists, packets as JSON, stored lists, sizes and addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import flows, fusion, records, rules, summaries
from ..sources.packets import packets_from_events, table
from .records import _DAYS, _FALL, _features, _H, _history
from .traffic import _A, _alerts, PACKETS, _with

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, query, sql: str) -> None:
    QUERIES[name] = query
    ORACLE_SQL[name] = sql


def _packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets_from_events(table(spark, sf_dir, "events"))


def _overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    packets = _packets(spark, sf_dir)
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    totals = packets.agg(F.count(F.lit(1)).alias("packets"), F.sum("length").alias("bytes"), at(F.min_by("ts", "pkt_seq")).alias("start"), at(F.max_by("ts", "pkt_seq")).alias("end"))
    totals = totals.crossJoin(F.broadcast(flows.flows(packets).agg(F.count(F.lit(1)).alias("flows"))))  # one row
    return summaries.traffic_lines(totals, flows.protocol_distribution(packets)).unionByName(summaries.alert_lines(_alerts(spark, sf_dir)))


_SEV = rules.SEVERITIES
_SIZE = "CASE WHEN {n} < 1024 THEN {b} WHEN {n} < 1048576 THEN printf('%.1f KB', round_even({n} / 1024.0::DOUBLE, 1)) WHEN {n} < 1073741824 THEN printf('%.1f MB', round_even({n} / 1048576.0::DOUBLE, 1)) ELSE printf('%.1f GB', round_even({n} / 1073741824.0::DOUBLE, 1)) END"
_add("summary_lines", _overview, _A + f""",
t AS (SELECT count(*) AS n, CAST(sum(length) AS BIGINT) AS b, strftime(min_by(ts, pkt_seq), '%Y-%m-%d %H:%M:%S') AS s, strftime(max_by(ts, pkt_seq), '%Y-%m-%d %H:%M:%S') AS e, (SELECT count(*) FROM flows) AS f FROM packets),
sv AS (SELECT count(*) AS n, {", ".join(f"count(*) FILTER (severity = '{s}') AS {s.lower()}" for s in _SEV)} FROM alerts)
SELECT 0 AS section, unnest([0::BIGINT, 1, 2, 3]) AS place, unnest(['📦 总数据包数: ' || n, '🔀 网络流数量: ' || f, '📈 总流量: ' || {_SIZE.format(n="b", b="b || ' B'")}, '⏰ 时间范围: ' || s || ' ~ ' || e]) AS line FROM t UNION ALL
SELECT 1, min(pkt_seq), '  • ' || protocol || ': ' || count(*) || ' 包 (' || printf('%.1f', round_even(count(*)::DOUBLE / any_value(t.n) * 100, 1)) || '%)' FROM packets, t GROUP BY protocol UNION ALL
SELECT 3, 0, '🚨 异常检测: 共 ' || n || ' 条告警' FROM sv UNION ALL {" UNION ALL ".join(f"SELECT 3, {i}, '  • {s}: ' || {s.lower()} || ' 条' FROM sv WHERE {s.lower()} > 0" for i, s in enumerate(_SEV, 1))}""")
_add("verdict_lines", lambda s, d: _features(s, d).select("capture_id", F.posexplode(summaries.verdict_lines(F.round(fusion.weighted_score(), 6), F.lit(False))).alias("place", "line")), _DAYS + f""",
v AS (SELECT capture_id, round({_FALL}, 6) AS p FROM feat)
SELECT capture_id, unnest([0, 1, 2, 3]) AS place, unnest(['🎯 三引擎融合判定: ' || CASE WHEN p >= 0.5 THEN '🔴 攻击' ELSE '🟢 正常' END, '  • 置信度: ' || printf('%.2f', round_even(greatest(p, 1 - p), 2)), '  • 攻击概率: ' || printf('%.4f', round_even(p, 4)), '  • 元学习器: 未加载（固定权重回退）']) AS line FROM v""")
_add("most_common_ports", lambda s, d: summaries.most_common(_packets(s, d), "dst_port", 10, "pkt_seq"), _with(PACKETS) + "SELECT dst_port, count(*) AS n FROM packets GROUP BY 1 ORDER BY n DESC, min(pkt_seq) LIMIT 10")
_add("packet_records", lambda s, d: flows.packet_records(_packets(s, d)), _with(PACKETS) + """
SELECT pkt_seq, CAST(to_json({'ts_ms': ts_ms, 'protocol': protocol, 'src_ip': src_ip, 'src_port': src_port, 'dst_ip': dst_ip, 'dst_port': dst_port, 'length': length, 'flags': flags, 'payload_size': payload_size, 'raw_summary': raw_summary, 'dns_query': dns_query}) AS VARCHAR) AS record FROM packets""")


def _damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored analyses, every third report and every fifth severity broken."""
    rows = _history(spark, sf_dir)
    return rows.withColumns({"raw": F.when(F.col("id") % 3 == 0, F.expr("substring(raw, 1, 20)")).otherwise(F.col("raw")), "severity": F.when(F.col("id") % 5 == 0, F.lit(None)).otherwise(F.col("severity"))})


_add("history_list", lambda s, d: records.listed(_damaged(s, d), 60, 20).select("id", "ts_ms", F.to_json("severity").alias("severity"), F.array_join(F.array_sort(F.map_keys("raw")), ",").alias("parts")), _H + """
SELECT id, ts_ms, CASE WHEN id % 5 = 0 THEN '{}' ELSE '{"' || sev || '":' || sev_n || '}' END AS severity, CASE WHEN id % 3 = 0 THEN '' ELSE 'anomaly_detection,file_hash' END AS parts FROM history ORDER BY ts_ms DESC, id LIMIT 60 OFFSET 20""")
_add("chat_session", lambda s, d: records.session_messages(table(s, d, "conversations"), 1, 3).select("turn", "role", "text"), "SELECT turn, role, text FROM conversations WHERE conv_id = 1 ORDER BY turn LIMIT 3")
_add("knowledge_base_stats", lambda s, d: records.knowledge_base_stats(_history(s, d), table(s, d, "conversations")), _H + """,
a AS (SELECT unnest(CASE WHEN is_attack THEN ['SYN_FLOOD_SUSPECTED', sev] ELSE [sev] END) AS type FROM history), g AS (SELECT type, count(*) AS n FROM a GROUP BY 1 ORDER BY n DESC, type LIMIT 10)
SELECT count(*) AS history, round(count(*) FILTER (is_attack)::DOUBLE / count(*), 3) AS attack_rate, count(*) FILTER (needs_review) AS needs_review, count(*) FILTER (sev = 'HIGH') AS high_risk, (SELECT count(*) FROM conversations) AS chat,
       (SELECT string_agg(type || '=' || n, ',' ORDER BY n DESC, type) FROM g) AS top_attack_types FROM history""")
_add("report_indicators", lambda s, d: summaries.report_indicators(records.stored_alerts(_history(s, d)).withColumn("dst_ip", F.when(F.col("id") % 2 == 0, F.concat(F.lit("host"), (F.col("id") % 9).cast("string")))), "id", "type"), _H + """,
a AS (SELECT id, unnest(CASE WHEN is_attack THEN [{'t': sev, 's': '10.0.0.' || (id % 256), 'p': NULL}, {'t': 'SYN_FLOOD_SUSPECTED', 's': '', 'p': CAST(1000 + id % 50 AS VARCHAR)}] ELSE [{'t': sev, 's': '10.0.0.' || (id % 256), 'p': NULL}] END) AS x FROM history),
v AS (SELECT id, x.t AS t, 0 AS k, x.s AS value, 'IP' AS kind FROM a UNION ALL SELECT id, x.t, 1, CASE WHEN id % 2 = 0 THEN 'host' || (id % 9) END, '域名' FROM a UNION ALL SELECT id, x.t, 2, x.p, '端口' FROM a)
SELECT value, arg_min(kind, {'i': id, 't': t, 'k': k}) AS kind, arg_min(t, {'i': id, 't': t, 'k': k}) AS type FROM v WHERE value <> '' GROUP BY 1""")
_add("size_formats", lambda s, d: table(s, d, "orders").withColumn("n", F.col("o_orderkey") * F.col("o_custkey") * 64).select("o_orderkey", scalars.summary_size(F.col("n")).alias("summary"), scalars.report_size(F.col("n")).alias("report")), f"""
WITH x AS (SELECT o_orderkey, o_orderkey * o_custkey * 64 AS n FROM orders) SELECT o_orderkey, {_SIZE.format(n="n", b="n || ' B'")} AS summary, {_SIZE.format(n="n", b="printf('%.1f B', n::DOUBLE)")} AS report FROM x""")


def _six(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of both families made of the order's number, every other kind of them malformed."""
    h = F.lower(F.hex(F.col("o_orderkey") % 65536))
    forms = [F.concat(F.lit("fe80::"), h), F.concat(F.lit("2400:1::"), h, F.lit(":1")), F.concat(F.lit("::ffff:10.0.0."), (F.col("o_orderkey") % 256).cast("string")), F.concat(F.lit("2400::"), h, F.lit("::1")), F.concat(F.lit("fd00:1:2:3:4:5:6:"), h), F.concat(F.lit("1:2:3:"), h), F.concat(F.lit("8.8.8."), (F.col("o_orderkey") % 256).cast("string"))]
    return table(spark, sf_dir, "orders").select("o_orderkey", F.get(F.array(*forms), (F.col("o_orderkey") % 7).cast("int")).alias("ip"))


_add("address_families", lambda s, d: _six(s, d).select("o_orderkey", scalars.is_ip(F.col("ip")).alias("valid"), scalars.is_private_ip(F.col("ip")).alias("private")), """
SELECT o_orderkey, o_orderkey % 7 NOT IN (3, 5) AS valid, o_orderkey % 7 IN (0, 2, 4) AS private FROM orders""")
