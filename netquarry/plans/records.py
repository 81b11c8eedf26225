"""Queries over stored results, evaluation and fusion, each with SQL that gives the same rows."""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import baseline, engines, evaluate, flows, forest, fusion, records, rules, store, windows
from ..scratch import materialize
from ..sources.packets import packets_from_events, table
from . import traffic
from .forest_sql import forest_sql, strange_sql
from .traffic import _A, _B, _TRAIN, _deviations, _later, _windows, HOUR, PACKETS, SCALED, SIGMA, WINDOWS, _alerts, _packets, _with

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = sql


def _raw_alerts(level: Column) -> Column:
    """Alerts inside a stored report: one of its severity's name with an address, and for attacks one with a port."""
    key = F.col("o_orderkey")
    first = F.struct(F.when(level <= 2, "HIGH").when(level == 3, "MEDIUM").otherwise("LOW").alias("type"), F.concat(F.lit("10.0.0."), (key % 256).cast("string")).alias("src_ip"), F.lit(None).cast("long").alias("dst_port"))
    second = F.struct(F.lit("SYN_FLOOD_SUSPECTED").alias("type"), F.lit("").alias("src_ip"), (1000 + key % 50).alias("dst_port"))
    return F.when(F.col("o_orderstatus") == "F", F.array(first, second)).otherwise(F.array(first))


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as stored analyses."""
    level = F.element_at(F.split("o_orderpriority", "-"), 1).cast("int")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("ts_ms"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
        (F.col("o_custkey") % 20).alias("alerts"), (F.col("o_orderstatus") == "F").alias("is_attack"), (F.col("o_orderpriority") == "1-URGENT").alias("needs_review"),
        F.to_json(F.create_map(F.when(level <= 2, "HIGH").when(level == 3, "MEDIUM").otherwise("LOW"), F.col("o_custkey") % 5 + 1)).alias("severity"),
        F.to_json(F.struct(F.sha2(F.col("o_orderkey").cast("string"), 256).alias("file_hash"), F.struct(_raw_alerts(level).alias("alerts")).alias("anomaly_detection"))).alias("raw"),
    )


HISTORY = """
history AS (
  SELECT o_orderkey AS id, epoch_us(o_orderdate) // 1000 AS ts_ms, strftime(o_orderdate, '%Y-%m-%d') AS day, o_custkey % 20 AS alerts, o_orderstatus = 'F' AS is_attack, o_orderpriority = '1-URGENT' AS needs_review,
         CASE WHEN CAST(o_orderpriority[1:1] AS INT) <= 2 THEN 'HIGH' WHEN o_orderpriority[1:1] = '3' THEN 'MEDIUM' ELSE 'LOW' END AS sev, o_custkey % 5 + 1 AS sev_n FROM orders)"""
_H = _with(HISTORY)
_add("history_page", lambda s, d: records.page(_history(s, d), [F.desc("ts_ms"), F.col("id")], 50, 100).select("id", "ts_ms", "alerts"), _H + "SELECT id, ts_ms, alerts FROM history ORDER BY ts_ms DESC, id LIMIT 50 OFFSET 100")
_add("history_trend", lambda s, d: records.daily_trend(_history(s, d)), _H + """
SELECT day, count(*) AS analyses, CAST(sum(alerts) AS BIGINT) AS alerts, count(*) FILTER (is_attack) AS attacks, count(*) FILTER (needs_review) AS reviews FROM history GROUP BY 1""")
_add("trend_summary", lambda s, d: records.trend_summary(_history(s, d)), _H + """
SELECT count(*) AS total_records, count(*) FILTER (is_attack) AS attack_records, count(*) FILTER (NOT is_attack) AS normal_records, round(count(*) FILTER (is_attack)::DOUBLE / count(*), 3) AS attack_rate, CAST(sum(alerts) AS BIGINT) AS total_alerts,
       round(sum(alerts)::DOUBLE / count(*), 2) AS avg_alerts, count(*) FILTER (needs_review) AS needs_review, count(*) FILTER (sev = 'HIGH') AS high_risk FROM history""")
_add("verdict_by_day", lambda s, d: records.verdict_by_day(_history(s, d)), _H + "SELECT day, count(*) FILTER (is_attack) AS attack, count(*) FILTER (NOT is_attack) AS normal FROM history GROUP BY 1")
_add("top_attack_types", lambda s, d: records.top_attack_types(_history(s, d)), _H + """, a AS (SELECT unnest(CASE WHEN is_attack THEN ['SYN_FLOOD_SUSPECTED', sev] ELSE [sev] END) AS type FROM history) SELECT type, count(*) AS n FROM a GROUP BY 1 ORDER BY n DESC, type LIMIT 10""")
_add("record_indicators", lambda s, d: records.record_indicators(_history(s, d)), _H + """
SELECT id, 'IP' AS kind, '10.0.0.' || (id % 256) AS value, sev AS source FROM history UNION ALL SELECT id, 'Port', CAST(1000 + id % 50 AS VARCHAR), 'SYN_FLOOD_SUSPECTED' FROM history WHERE is_attack""")
_add("record_by_id", lambda s, d: records.by_id(_history(s, d), 7).select("id", "day", "alerts"), _H + "SELECT id, day, alerts FROM history WHERE id = 7")
_add("evidence_timeline", lambda s, d: records.evidence_timeline(_alerts(s, d)).select("place", "type", "evidence"), _A + """
SELECT row_number() OVER (ORDER BY first_ms, key_ord, rule_ord, subject) AS place, type, severity || ' ' || subject || ' = ' || CAST(CAST(value AS BIGINT) AS VARCHAR) AS evidence FROM alerts ORDER BY first_ms, key_ord, rule_ord, subject LIMIT 20""")
_add("severity_by_day", lambda s, d: records.severity_by_day(_history(s, d)), _H + "SELECT day, sev AS severity, CAST(sum(sev_n) AS BIGINT) AS n FROM history GROUP BY 1, 2")
_add("last_days", lambda s, d: records.latest(records.daily_trend(_history(s, d)), [F.desc("day")], 7).select("day", "analyses"), _H + "SELECT day, count(*) AS analyses FROM history GROUP BY 1 ORDER BY day DESC LIMIT 7")
_add("retention_latest_n", lambda s, d: records.latest(_history(s, d), [F.desc("ts_ms"), F.col("id")], 60).select("id", "ts_ms"), _H + "SELECT id, ts_ms FROM history ORDER BY ts_ms DESC, id LIMIT 60")
_add("related_samples", lambda s, d: records.related(_history(s, d), 1), _H + """,
t AS (SELECT * FROM history WHERE id = 1), pool AS (SELECT * FROM history ORDER BY ts_ms DESC, id LIMIT 100)
SELECT * FROM (
  SELECT p.id, CAST(CASE WHEN p.is_attack = t.is_attack THEN 3 ELSE 0 END + CASE WHEN t.alerts > 0 AND abs(p.alerts - t.alerts)::DOUBLE / t.alerts < 0.2 THEN 3 ELSE 0 END
         + CASE WHEN p.sev = t.sev THEN 2 ELSE 0 END + CASE WHEN abs(floor((t.ts_ms - p.ts_ms)::DOUBLE / 86400000)) <= 7 THEN 2 ELSE 0 END AS BIGINT) AS points FROM pool p, t WHERE p.id <> 1)
WHERE points > 3 ORDER BY points DESC, id LIMIT 5""")
_add("cache_lookup_by_hash", lambda s, d: records.by_file_hash(_history(s, d), "6b86b273ff34fce19d6b804eff5a3f5747ada4eaa22f1d49c01e52ddb7875b4b").select("id", "alerts"), _H + "SELECT id, alerts FROM history WHERE sha256(CAST(id AS VARCHAR)) = '6b86b273ff34fce19d6b804eff5a3f5747ada4eaa22f1d49c01e52ddb7875b4b'")
_add("upsert_latest", lambda s, d: records.upserted(_history(s, d).select("id", "alerts", "ts_ms"), _history(s, d).where("id % 3 = 0").select("id", (F.col("alerts") + 100).alias("alerts"), (F.col("ts_ms") + 1).alias("ts_ms")), "id", "ts_ms"),
     _H + "SELECT id, CASE WHEN id % 3 = 0 THEN alerts + 100 ELSE alerts END AS alerts, CASE WHEN id % 3 = 0 THEN ts_ms + 1 ELSE ts_ms END AS ts_ms FROM history")
_add("delete_by_key", lambda s, d: records.deleted(_history(s, d), _history(s, d).where("needs_review"), "id").agg(F.count(F.lit(1)).alias("rows"), F.sum("alerts").alias("alerts")), _H + "SELECT count(*) AS rows, CAST(sum(alerts) AS BIGINT) AS alerts FROM history WHERE NOT needs_review")
_add("table_counts", lambda s, d: _history(s, d).agg(F.count(F.lit(1)).alias("n")).select(F.lit("history").alias("name"), "n").unionByName(table(s, d, "conversations").agg(F.count(F.lit(1)).alias("n")).select(F.lit("chat").alias("name"), "n")),
     "SELECT 'history' AS name, count(*) AS n FROM orders UNION ALL SELECT 'chat', count(*) FROM conversations")


def _audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("path"), F.when(F.col("event_type") == "error", 500).otherwise(200).cast("long").alias("status_code"), F.col("value").alias("duration_ms")
    )


_AUDIT = "WITH audit AS (SELECT event_id AS id, event_type AS path, CASE WHEN event_type = 'error' THEN 500::BIGINT ELSE 200::BIGINT END AS status_code, value AS duration_ms FROM events)\n"
_add("audit_stats", lambda s, d: records.audit_stats(_audit(s, d)), _AUDIT + "SELECT path, count(*) AS n, count(*) FILTER (status_code >= 400) AS errors, round(avg(duration_ms), 1) AS avg_ms FROM audit GROUP BY 1 ORDER BY n DESC, path LIMIT 10")
_add("audit_totals", lambda s, d: records.audit_totals(_audit(s, d)), _AUDIT + "SELECT count(*) AS total, count(*) FILTER (status_code >= 400) AS errors, round(count(*) FILTER (status_code >= 400)::DOUBLE / count(*), 4) AS error_rate, round(avg(duration_ms), 2) AS avg_ms FROM audit")
_add("audit_query", lambda s, d: records.page(records.audit_query(_audit(s, d), 500, "err"), [F.desc("id")], 100, 20).select("id", "path", "status_code"), _AUDIT + "SELECT id, path, status_code FROM audit WHERE status_code = 500 AND contains(path, 'err') ORDER BY id DESC LIMIT 100 OFFSET 20")
_add("chat_history", lambda s, d: records.chat_context(table(s, d, "conversations")).select("conv_id", "turn", "role"), """
SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 10 AND role <> 'system' AND length(trim(text)) > 0""")


def _logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "signup", "WARNING").otherwise("INFO")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("line"), F.concat_ws(" | ", F.lit("2024-01-01 00:00:00"), F.rpad(level, 8, " "), F.concat(F.lit("app:run:"), F.col("user_id").cast("string"), F.lit(" - "), F.col("props"))).alias("value"))


_LOG = "WITH logs AS (SELECT event_id AS line, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARNING' ELSE 'INFO' END AS level, 'app:run:' || user_id AS module, props AS message FROM events)\n"
_add("log_parse", lambda s, d: records.log_records(_logs(s, d)).select("line", "level", "module", "message"), _LOG + "SELECT line, level, module, message FROM logs")
_add("log_level_stats", lambda s, d: records.level_counts(records.log_records(_logs(s, d))), _LOG + "SELECT level, count(*) AS n FROM (SELECT * FROM logs ORDER BY line DESC LIMIT 1000) GROUP BY 1")
_add("log_query", lambda s, d: records.page(records.log_records(_logs(s, d)).where((F.col("level") == "ERROR") & F.contains("message", F.lit("7"))), [F.desc("line")], 50).select("line", "module"), _LOG + "SELECT line, module FROM logs WHERE level = 'ERROR' AND contains(message, '7') ORDER BY line DESC LIMIT 50")

_RATES = """CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn, round(CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END, 4) AS precision, round(CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END, 4) AS recall,
  round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp::DOUBLE / (2 * tp + fp + fn) ELSE 0 END, 4) AS f1, round(CASE WHEN tp + fp + fn + tn > 0 THEN (tp + tn)::DOUBLE / (tp + fp + fn + tn) ELSE 0 END, 4) AS accuracy"""
_add("confusion_metrics", lambda s, d: evaluate.confusion(table(s, d, "labels"), F.col("quality") == 1, F.col("toxic") == 1), f"""
SELECT {_RATES} FROM (SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS tp, count(*) FILTER (quality <> 1 AND toxic = 1) AS fp, count(*) FILTER (quality = 1 AND toxic <> 1) AS fn, count(*) FILTER (quality <> 1 AND toxic <> 1) AS tn FROM labels)""")


def _window_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _windows(spark, sf_dir)
    flagged = _deviations(spark, sf_dir).join(found.select("window_index", "bucket"), "window_index")
    return evaluate.window_evaluation(found, flagged, found.where("syn >= 7"))


_add("window_level_eval", _window_eval, _B + f""",
cal AS (SELECT unnest(generate_series((SELECT min(bucket) FROM windows), (SELECT max(bucket) FROM windows))) AS bucket),
f AS (SELECT DISTINCT bucket FROM deviations JOIN windows USING (window_index)), g AS (SELECT bucket FROM windows WHERE syn >= 7),
m AS (SELECT bucket IN (SELECT bucket FROM f) AS p, bucket IN (SELECT bucket FROM g) AS t FROM cal),
c AS (SELECT count(*) FILTER (t AND p) AS tp, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (t AND NOT p) AS fn, count(*) FILTER (NOT t AND NOT p) AS tn FROM m)
SELECT {_RATES} FROM c""")
_add("ip_level_eval", lambda s, d: evaluate.set_comparison(rules.RULES["rule_syn_flood"](_packets(s, d), SCALED).select(F.col("subject").alias("ip")), rules.RULES["rule_rst_storm"](_packets(s, d), SCALED).select(F.col("subject").alias("ip")), "ip"), _A + """,
p AS (SELECT subject AS ip FROM alerts WHERE type = 'SYN_FLOOD_SUSPECTED'), t AS (SELECT subject AS ip FROM alerts WHERE type = 'RST_STORM')
SELECT (SELECT count(*) FROM p WHERE ip IN (SELECT ip FROM t)) AS both, (SELECT count(*) FROM p WHERE ip NOT IN (SELECT ip FROM t)) AS only_predicted, (SELECT count(*) FROM t WHERE ip NOT IN (SELECT ip FROM p)) AS only_truth""")
_add("mixed_sample_shift", lambda s, d: evaluate.mixed_sample(_packets(s, d).where("protocol <> 'UDP'").select("pkt_seq", "ts_ms"), _packets(s, d).where("protocol = 'UDP'").select("pkt_seq", "ts_ms"), 30000), _with(PACKETS) + """
SELECT pkt_seq, ts_ms, 'base' AS part FROM packets WHERE protocol <> 'UDP' UNION ALL
SELECT pkt_seq, ts_ms - (SELECT min(ts_ms) FROM packets WHERE protocol = 'UDP') + (SELECT max(ts_ms) FROM packets WHERE protocol <> 'UDP') + 30000, 'attack' FROM packets WHERE protocol = 'UDP'""")
_add("mitigates_two_hop", lambda s, d: evaluate.two_hops(
    table(s, d, "supplier").select(F.col("s_suppkey").alias("course_id"), F.col("s_name").alias("course")), table(s, d, "supplier").select(F.col("s_suppkey").alias("source"), F.col("s_nationkey").alias("target")),
    table(s, d, "nation").select(F.col("n_nationkey").alias("pattern_id"), F.col("n_name").alias("pattern"))), "SELECT n_name AS pattern, string_agg(DISTINCT s_name, ',' ORDER BY s_name) AS courses, count(DISTINCT s_name) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")


CAPTURE_DAYS = 10  # captures are days; the first ten train
_SET = engines.EngineSettings(window_sec=HOUR, sigma=SIGMA)
_PER_DAY = replace(SCALED, syn_flood_min=3, syn_flood_high=12, port_scan_min=2, port_scan_high=9, dns_tunnel_min=2, dns_tunnel_high=6, rst_storm_min=3, udp_flood_min=4, udp_flood_high=15, dns_amp_responses=2, quic_connections=2, quic_long_flow=2)


def _days(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Column]:
    """Packets with the day as their capture, and which captures train."""
    packets = _packets(spark, sf_dir).withColumn("capture_id", F.date_format("ts", "yyyy-MM-dd"))
    first = F.date_format(F.date_add(F.lit(packets.agg(F.min("ts")).first()[0]).cast("date"), CAPTURE_DAYS), "yyyy-MM-dd")
    return packets, F.col("capture_id") < first


def _features(spark: SparkSession, sf_dir: str, with_forest: bool = False) -> DataFrame:
    """Thirteen features of every day; without the forest its features are 0."""
    return engines.features(*_days(spark, sf_dir), _PER_DAY, _SET, with_forest)


def _day_sql(sql: str) -> str:
    """A rule's SQL with the day (cap) as a part of every key."""
    for old, new in (
        ("SELECT 7 AS rule_ord", "SELECT r.cap AS cap, 7 AS rule_ord"), ("FROM (SELECT src_ip,", "FROM (SELECT cap, src_ip,"), ("(SELECT dst_ip,", "(SELECT cap, dst_ip,"), ("JOIN (SELECT src_ip,", "JOIN (SELECT cap, src_ip,"), ("(SELECT s.src_ip,", "(SELECT s.cap, s.src_ip,"),
        ("(SELECT src_ip ||", "(SELECT cap, src_ip ||"), ("(SELECT count(*) AS n, count(*) FILTER", "(SELECT cap, count(*) AS n, count(*) FILTER"), ("dst_port = 443) WHERE n > 0", "dst_port = 443 GROUP BY cap) WHERE n > 0"), ("GROUP BY 1)", "GROUP BY ALL)"),
        ("ON s.src_ip = a.dst_ip", "ON s.src_ip = a.dst_ip AND s.cap = a.cap"), ("ON r.dst_ip = q.src_ip", "ON r.dst_ip = q.src_ip AND r.cap = q.cap"), ("(SELECT list(DISTINCT ver)", "(SELECT cap, list(DISTINCT ver)"), ("'ff00001d')) WHERE len(v)", "'ff00001d') GROUP BY cap) WHERE len(v)"),
    ):
        sql = sql.replace(old, new)
    return re.sub(r"^\s*SELECT (\d+) AS rule_ord", r"SELECT cap, \1 AS rule_ord", sql)


def _rule_day_sql() -> str:
    found, shared = [], traffic.rule_sql(_PER_DAY)
    for sql in shared.values():
        found.append(f"SELECT cap, type, severity FROM ({_day_sql(sql)})")
    return " UNION ALL ".join(found)


_DAY_PACKETS = PACKETS.replace("SELECT event_id AS pkt_seq, ts,", "SELECT strftime(ts, '%Y-%m-%d') AS cap, event_id AS pkt_seq, ts,").replace("packets AS (", "every AS (") + f""",
split AS (SELECT strftime(CAST(min(ts) AS DATE) + INTERVAL {CAPTURE_DAYS} DAY, '%Y-%m-%d') AS first FROM every),
packets AS (SELECT every.* FROM every, split WHERE cap >= first)"""
_DAY_FLOWS = traffic.FLOWS.replace("SELECT protocol, least", "SELECT cap, protocol, least").replace("PARTITION BY protocol, lo, hi", "PARTITION BY cap, protocol, lo, hi").replace("SELECT protocol, lo, hi, CAST(sum(n)", "SELECT cap, protocol, lo, hi, CAST(sum(n)").replace("GROUP BY protocol, lo, hi", "GROUP BY cap, protocol, lo, hi")
_UNPIVOT = " UNION ALL ".join(f"SELECT cap, window_index, {i} AS dim_ord, '{d}' AS dimension, CAST({d} AS DOUBLE) AS value FROM dayw" for i, d in enumerate(engines.DIMS))
_DAYS = "WITH " + _DAY_PACKETS + "," + _DAY_FLOWS + f""",
ruled AS ({_rule_day_sql()}),
anchors AS (SELECT cap, min_by(ts_ms, pkt_seq) AS t0 FROM every GROUP BY 1),
dayb AS (SELECT e.cap, CAST(floor((ts_ms - t0) / ({HOUR} * 1000)) AS BIGINT) AS bucket, count(*) AS packets, CAST(sum(length) AS BIGINT) AS bytes, count(*) FILTER ({traffic._SYN}) AS syn, count(DISTINCT CASE WHEN dst_port > 0 THEN dst_port END) AS dports FROM every e JOIN anchors a ON e.cap = a.cap GROUP BY 1, 2),
dayw AS (SELECT *, row_number() OVER (PARTITION BY cap ORDER BY bucket) - 1 AS window_index FROM dayb),
alld AS ({_UNPIVOT}),
traind AS (SELECT alld.* FROM alld, split WHERE cap < first), ours AS (SELECT alld.* FROM alld, split WHERE cap >= first),
m0 AS (SELECT dimension, median(value) AS m FROM traind GROUP BY 1), a0 AS (SELECT t.dimension, any_value(m) AS m, median(abs(value - m)) AS a FROM traind t JOIN m0 USING (dimension) GROUP BY 1),
bad AS (SELECT DISTINCT cap, window_index FROM traind JOIN a0 USING (dimension) WHERE a > 0 AND value > m + 3 * a / 0.6745),
clean AS (SELECT * FROM traind t WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE b.cap = t.cap AND b.window_index = t.window_index)),
m1 AS (SELECT dimension, median(value) AS median FROM clean GROUP BY 1),
prof AS (SELECT c.dimension, any_value(median) AS median, greatest(median(abs(value - median)), 1.0, any_value(median) * CASE c.dimension WHEN 'packets' THEN 0.30::DOUBLE ELSE 0.50::DOUBLE END) AS mad FROM clean c JOIN m1 USING (dimension) GROUP BY 1),
devs AS (SELECT o.*, (value - median) * 0.6745::DOUBLE / mad AS z FROM ours o JOIN prof USING (dimension)), dev AS (SELECT *, CASE WHEN z > 2 * {SIGMA}::DOUBLE THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM devs WHERE z > {SIGMA}::DOUBLE),
multi AS (SELECT cap, window_index, count(*) AS n, max(z) AS z FROM dev GROUP BY 1, 2 HAVING count(*) >= 2),
dayalerts AS (
  SELECT * FROM ruled UNION ALL
  SELECT cap, 'BASELINE_DEVIATION', severity FROM (SELECT *, row_number() OVER (PARTITION BY cap, dimension ORDER BY z DESC, window_index) AS r FROM dev) WHERE r <= 3 UNION ALL
  SELECT cap, 'BASELINE_MULTI_DIM', CASE WHEN n >= 3 OR z > 6 THEN 'CRITICAL' ELSE 'HIGH' END FROM multi),
lastw AS (SELECT *, dense_rank() OVER (PARTITION BY cap ORDER BY window_index DESC) AS r FROM ours), recent AS (SELECT * FROM lastw WHERE r <= 10), caps AS (SELECT cap, count(DISTINCT window_index) AS n2 FROM recent GROUP BY 1 HAVING count(DISTINCT window_index) >= 5),
pool AS (SELECT caps.cap, dimension, value, 1 AS x, 0 AS y FROM caps, traind UNION ALL SELECT recent.cap, dimension, value, 0, 1 FROM recent JOIN caps USING (cap)),
vals AS (SELECT cap, dimension, value, sum(x) AS x, sum(y) AS y FROM pool GROUP BY 1, 2, 3),
runs AS (SELECT cap, dimension, sum(x) OVER w AS cx, sum(y) OVER w AS cy, sum(x) OVER (PARTITION BY cap, dimension) AS n1, sum(y) OVER (PARTITION BY cap, dimension) AS n2 FROM vals WINDOW w AS (PARTITION BY cap, dimension ORDER BY value)),
ks AS (SELECT cap, dimension, CAST(max(abs(cx * n2 - cy * n1)) AS BIGINT) AS numerator, CAST(any_value(n1) AS BIGINT) AS n1, CAST(any_value(n2) AS BIGINT) AS n2 FROM runs GROUP BY 1, 2),
worst AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cap ORDER BY numerator DESC, CASE dimension WHEN 'packets' THEN 0 WHEN 'bytes' THEN 1 WHEN 'syn' THEN 2 ELSE 3 END) AS r FROM ks) WHERE r = 1),
drifts AS (SELECT cap, dimension, numerator, n1, n2, numerator::DOUBLE / (n1 * n2) > 1.36 * sqrt((n1 + n2)::DOUBLE / (n1 * n2)) AS detected FROM worst),
byalert AS (SELECT cap, count(*) AS n, max(CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END) AS sev, count(DISTINCT type) AS types FROM dayalerts GROUP BY 1),
bywin AS (SELECT cap, count(DISTINCT window_index) AS k FROM dev GROUP BY 1),
feat AS (
  SELECT c.cap AS capture_id, CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE 0 END AS rule_has_alert, least(coalesce(n, 0)::DOUBLE / 10, 1.0) AS rule_alert_count_norm, CAST(coalesce(sev, 0) AS DOUBLE) AS rule_max_severity, least(coalesce(types, 0)::DOUBLE / 5, 1.0) AS rule_triggered_rules,
         least(coalesce(k, 0)::DOUBLE / 10, 1.0) AS baseline_deviation_count, CASE WHEN c.cap IN (SELECT cap FROM multi) THEN 1.0::DOUBLE ELSE 0 END AS baseline_multi_dim_triggered, CASE WHEN detected THEN 1.0::DOUBLE ELSE 0 END AS baseline_drifted,
         {", ".join(f"0.0::DOUBLE AS {f}" for f in fusion.FOREST)}
  FROM (SELECT DISTINCT cap FROM ours) c LEFT JOIN byalert USING (cap) LEFT JOIN bywin USING (cap) LEFT JOIN drifts USING (cap))"""
WEIGHTS = {f: w / 8 for f, w in zip(fusion.FEATURES, (9, 5, 3, -2, 7, 4, 1, -3, 6, 2, -1, 5, 8))}
_add("fusion_features", _features, _DAYS + " SELECT * FROM feat")
_add("capture_drift", lambda s, d: engines.drift(engines.prepare(*_days(s, d), _SET), _SET), _DAYS + " SELECT cap AS capture_id, dimension, numerator, n1, n2, detected FROM drifts")
_add("capture_baseline_alerts", lambda s, d: engines.baseline_alerts(engines.deviations(engines.prepare(*_days(s, d), _SET), _SET), _SET).groupBy("capture_id", "type", "severity").agg(F.count(F.lit(1)).alias("n")), _DAYS + " SELECT cap AS capture_id, type, severity, count(*) AS n FROM dayalerts WHERE starts_with(type, 'BASELINE') GROUP BY ALL")


#: Every prefix of a day as a capture of its own, its windows counted from the day's first packet.
_PREFIXES = _DAYS.replace("every AS (", "every0 AS (").replace("split AS (SELECT", f"""t0s AS (SELECT cap, min_by(ts_ms, pkt_seq) AS t0 FROM every0 GROUP BY 1),
eb AS (SELECT e.*, CAST(floor((ts_ms - t0) / ({HOUR} * 1000)) AS BIGINT) AS bk FROM every0 e JOIN t0s USING (cap)),
split0 AS (SELECT strftime(CAST(min(ts) AS DATE) + INTERVAL {CAPTURE_DAYS} DAY, '%Y-%m-%d') AS first FROM every0),
pre AS (SELECT DISTINCT cap, bk AS pb FROM eb, split0 WHERE cap >= first),
every AS (SELECT eb.* EXCLUDE (bk) REPLACE (eb.cap || '#' || lpad(CAST(pb + 1000 AS VARCHAR), 5, '0') AS cap) FROM eb JOIN pre ON pre.cap = eb.cap AND bk <= pb UNION ALL SELECT eb.* EXCLUDE (bk) FROM eb, split0 WHERE cap < first),
split AS (SELECT""", 1).replace("anchors AS (SELECT cap, min_by(ts_ms, pkt_seq) AS t0 FROM every GROUP BY 1)", "anchors AS (SELECT DISTINCT e.cap, t.t0 FROM every e JOIN t0s t ON t.cap = split_part(e.cap, '#', 1))")
_add("prefix_features", lambda s, d: engines.prefix_features(*_days(s, d), _PER_DAY, _SET), _PREFIXES + f" SELECT split_part(capture_id, '#', 1) AS capture_id, row_number() OVER (PARTITION BY split_part(capture_id, '#', 1) ORDER BY capture_id) - 1 AS window_index, {', '.join(fusion.RULE + fusion.BASELINE)} FROM feat")


def _forest_days(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, engines.Found]:
    found = engines.prepare(*_days(spark, sf_dir), _SET)
    judged = engines.forest_windows(found, _SET)
    return judged[0], found


#: The day's forest beside the other two engines, with its alerts among theirs.
_FOREST_DAYS = _DAYS.replace("WITH ", "WITH RECURSIVE ", 1) + f""",
ftrain AS MATERIALIZED (SELECT dayw.* FROM dayw, split WHERE cap < first), fours AS MATERIALIZED (SELECT dayw.* FROM dayw, split WHERE cap >= first),{forest_sql("ftrain", "fours", engines.DIMS)},{strange_sql("fours", engines.DIMS, ["cap", "window_index"], _SET.clearly)},
flowest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cap ORDER BY score, window_index) AS r FROM fstrange) WHERE r <= {_SET.lowest}),
ftop AS (SELECT cap, arg_max(dimension, {{'n': n, 'f': -f, 'd': dimension}}) AS top_dimension FROM (SELECT cap, dimension, count(*) AS n, min(window_index) AS f FROM fstrange GROUP BY 1, 2) GROUP BY 1),
fprofile AS (SELECT capture_id, coalesce(anomaly_windows, 0) AS anomaly_windows, total_windows, coalesce(mean_score, 0.0::DOUBLE) AS mean_score, coalesce(min_score, 0.0::DOUBLE) AS min_score, coalesce(top_dimension, '') AS top_dimension
  FROM (SELECT cap AS capture_id, count(*) AS total_windows FROM fours GROUP BY 1) LEFT JOIN (SELECT cap AS capture_id, count(*) AS anomaly_windows, round(avg(score) + 1e-9::DOUBLE, 4) AS mean_score, min(score) AS min_score FROM fstrange GROUP BY 1) USING (capture_id) LEFT JOIN (SELECT cap AS capture_id, top_dimension FROM ftop) USING (capture_id)),
alert3 AS (SELECT * FROM dayalerts UNION ALL SELECT cap, 'ML_ANOMALY', severity FROM flowest WHERE direction = 'high'),
byalert3 AS (SELECT cap AS capture_id, count(*) AS n, max(CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END) AS sev, count(DISTINCT type) AS types FROM alert3 GROUP BY 1),
fscale AS (SELECT CASE WHEN abs(cut) > 1e-6::DOUBLE THEN abs(cut) ELSE 1.0::DOUBLE END AS scale FROM fcut),
feat3 AS (
  SELECT capture_id, CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE 0 END AS rule_has_alert, least(coalesce(n, 0)::DOUBLE / 10, 1.0) AS rule_alert_count_norm, CAST(coalesce(sev, 0) AS DOUBLE) AS rule_max_severity, least(coalesce(types, 0)::DOUBLE / 5, 1.0) AS rule_triggered_rules,
         {", ".join(fusion.BASELINE)}, 1.0::DOUBLE AS {fusion.FOREST[0]}, least(anomaly_windows::DOUBLE / 10, 1.0) AS {fusion.FOREST[1]}, least(anomaly_windows::DOUBLE / total_windows, 1.0) AS {fusion.FOREST[2]},
         least(abs(mean_score) / scale, 1.0::DOUBLE) AS {fusion.FOREST[3]}, least(abs(min_score) / scale, 1.0::DOUBLE) AS {fusion.FOREST[4]},
         CASE WHEN top_dimension IN ('syn', 'dports') THEN 1.0::DOUBLE WHEN top_dimension IN ('packets', 'bytes') THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS {fusion.FOREST[5]}
  FROM feat LEFT JOIN byalert3 USING (capture_id) JOIN fprofile USING (capture_id), fscale)"""
_add("forest_profile", lambda s, d: engines.forest_profile(*_forest_days(s, d)), _FOREST_DAYS + " SELECT * FROM fprofile")
_add("forest_alerts", lambda s, d: engines.forest_alerts(_forest_days(s, d)[0], _SET), _FOREST_DAYS + """
SELECT cap AS capture_id, window_index, dimension, direction, ratio, score, severity, 'ML_ANOMALY' AS type, dimension || '@' || window_index AS subject, direction = 'high' AS alert FROM flowest""")
_add("fusion_features_three_engines", lambda s, d: _features(s, d, True), _FOREST_DAYS + " SELECT * FROM feat3")
_FALL = """0.4::DOUBLE * least(rule_has_alert * 0.5 + rule_alert_count_norm * 0.2 + rule_max_severity / 4.0 * 0.2 + rule_triggered_rules * 0.1, 1.0)
  + 0.3::DOUBLE * least(baseline_deviation_count * 0.6 + baseline_multi_dim_triggered * 0.25 + baseline_drifted * 0.15, 1.0)
  + 0.3::DOUBLE * least(isolation_anomaly_count * 0.35 + isolation_anomaly_ratio * 0.25 + isolation_mean_score * 0.15 + isolation_max_score * 0.15 + isolation_top_dim_risk * 0.10, 1.0)"""
_add("fusion_fallback", lambda s, d: _features(s, d).select("capture_id", F.round(fusion.weighted_score(), 6).alias("score")), _DAYS + f" SELECT capture_id, round({_FALL}, 6) AS score FROM feat")
_LIN = " + ".join(f"{f} * {w}::DOUBLE" for f, w in WEIGHTS.items())
_add("fusion_logistic", lambda s, d: _features(s, d).select("capture_id", F.round(fusion.logistic_score(WEIGHTS, -3.0), 6).alias("p"), (fusion.logistic_score(WEIGHTS, -3.0) >= 0.5).cast("long").alias("attack")), _DAYS + f"""
SELECT capture_id, round(1 / (1 + exp(-(-3.0 + {_LIN}))), 6) AS p, CAST(1 / (1 + exp(-(-3.0 + {_LIN}))) >= 0.5 AS BIGINT) AS attack FROM feat""")
_PART = {e: " + ".join(f"abs({f} * {WEIGHTS[f]}::DOUBLE)" for f in fs) for e, fs in fusion.ENGINES.items()}
_add("fusion_attribution", lambda s, d: _features(s, d).select("capture_id", *[c.alias(e) for e, c in fusion.attribution(WEIGHTS).items()]), _DAYS + f"""
SELECT capture_id, {", ".join(f"CASE WHEN {' + '.join(_PART.values())} <= 1e-12 THEN 0 ELSE round(({p}) / ({' + '.join(_PART.values())}), 4) END AS {e}" for e, p in _PART.items())} FROM feat""")
_add("dedup_training_rows", lambda s, d: fusion.distinct_training_rows(_features(s, d).withColumn("y", F.col("rule_has_alert") > 0).withColumn("g", F.substring("capture_id", 1, 7)), "g", "y").agg(F.count(F.lit(1)).alias("n")),
     _DAYS + f" SELECT count(*) AS n FROM (SELECT DISTINCT capture_id[1:7], {', '.join(fusion.FEATURES)} FROM feat)")
_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_add("feature_correlation", lambda s, d: fusion.strong_pairs(table(s, d, "lineitem"), _COLS, 0.001), "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for i, a in enumerate(_COLS) for b in _COLS[i + 1 :]) + ") WHERE abs(r) > 0.001")
_add("constant_columns", lambda s, d: fusion.constant_columns(_features(s, d), fusion.FEATURES), _DAYS + " SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{f}' AS \"column\", min({f}) IS NOT DISTINCT FROM max({f}) AS constant FROM feat" for f in fusion.FEATURES) + ")")


def _judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every day's verdict by rules, baseline and both, against days with more than a twelfth of answered resets."""
    packets, training = _days(spark, sf_dir)
    truth = packets.where(~training).groupBy("capture_id").agg((F.count_if(F.contains("flags", F.lit("RST"))) * 12 > F.count(F.lit(1))).alias("truth"))
    f = _features(spark, sf_dir).join(truth, "capture_id")
    engines_ = {"rules": F.col("rule_triggered_rules") >= 0.8, "baseline": F.col("baseline_deviation_count") > 0.4, "fused": fusion.weighted_score() >= 0.5, "every day": F.lit(True)}
    return f.select("capture_id", "truth", F.explode(F.array(*[F.struct(F.lit(n).alias("engine"), p.alias("p")) for n, p in engines_.items()])).alias("x")).select("truth", "x.*")


_JUDGED = _DAYS + f""",
truths AS (SELECT cap AS capture_id, count(*) FILTER (contains(flags, 'RST')) * 12 > count(*) AS t FROM packets GROUP BY 1),
e AS (SELECT t, unnest([{{'engine': 'rules', 'p': rule_triggered_rules >= 0.8}}, {{'engine': 'baseline', 'p': baseline_deviation_count > 0.4}}, {{'engine': 'fused', 'p': {_FALL} >= 0.5}}, {{'engine': 'every day', 'p': true}}]) AS x FROM feat JOIN truths USING (capture_id)),
c AS (SELECT x.engine AS engine, count(*) FILTER (t AND x.p) AS tp, count(*) FILTER (NOT t AND x.p) AS fp, count(*) FILTER (t AND NOT x.p) AS fn, count(*) FILTER (NOT t AND NOT x.p) AS tn FROM e GROUP BY 1)
SELECT engine, {_RATES} FROM c"""
_add("engine_comparison", lambda s, d: evaluate.confusion(_judgements(s, d), F.col("truth"), F.col("p"), "engine"), _JUDGED)


def _attacked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Column]:
    """Days with a scan in the fourth hour of the even ones that don't train."""
    packets, training = _days(spark, sf_dir)
    even = F.substring("capture_id", 9, 2).cast("int") % 2 == 0
    return evaluate.injected(packets, ~training & even, F.col("pkt_seq") % 4 == 0, F.unix_millis(F.date_trunc("day", "ts").cast("timestamp")) + 3 * 3_600_000), training


def _judged_attacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every day's verdict by each engine, by all and by two trivial ones, against the days that were attacked."""
    packets, training = _attacked(spark, sf_dir)
    truth = packets.where(~training).groupBy("capture_id").agg(F.max("injected").alias("truth"))
    f = engines.features(packets.drop("injected"), training, _PER_DAY, _SET).join(truth, "capture_id")
    votes = {"rules": F.col("rule_max_severity") >= 4, "baseline": (F.col("baseline_multi_dim_triggered") > 0) | (F.col("baseline_drifted") > 0), "forest": F.col("isolation_anomaly_count") > 0.25, "fused": fusion.weighted_score() >= 0.7, "every day": F.lit(True), "no day": F.lit(False)}
    return f.select("truth", F.explode(F.array(*[F.struct(F.lit(n).alias("engine"), p.alias("p")) for n, p in votes.items()])).alias("x")).select("truth", "x.*")


_ATTACKED = """split0 AS (SELECT strftime(CAST(min(ts) AS DATE) + INTERVAL 10 DAY, '%Y-%m-%d') AS first FROM every0),
every AS (SELECT *, false AS injected FROM every0 UNION ALL BY NAME
  SELECT every0.* REPLACE (pkt_seq + 1000000000000 AS pkt_seq, epoch_ms(date_trunc('day', ts)) + 10800000 + pkt_seq % 3600 * 1000 AS ts_ms, 'TCP' AS protocol, '10.9.9.9' AS src_ip, 41000 AS src_port, '10.9.0.1' AS dst_ip, 1 + pkt_seq % 997 AS dst_port,
    60 AS length, 6 AS payload_size, 'SYN' AS flags, '' AS dns_query, '' AS dns_response, '' AS raw_summary), true AS injected FROM every0, split0 WHERE cap >= first AND CAST(cap[9:10] AS INT) % 2 = 0 AND pkt_seq % 4 = 0),
split AS (SELECT"""
_add("attacked_days_by_engine", lambda s, d: evaluate.confusion(_judged_attacks(s, d), F.col("truth"), F.col("p"), "engine"), _FOREST_DAYS.replace("every AS (", "every0 AS (").replace("split AS (SELECT", _ATTACKED, 1) + f""",
truths AS (SELECT cap AS capture_id, bool_or(injected) AS t FROM packets GROUP BY 1),
e AS (SELECT t, unnest([{{'engine': 'rules', 'p': rule_max_severity >= 4}}, {{'engine': 'baseline', 'p': baseline_multi_dim_triggered > 0 OR baseline_drifted > 0}}, {{'engine': 'forest', 'p': isolation_anomaly_count > 0.25::DOUBLE}}, {{'engine': 'fused', 'p': {_FALL} >= 0.7}}, {{'engine': 'every day', 'p': true}}, {{'engine': 'no day', 'p': false}}]) AS x FROM feat3 JOIN truths USING (capture_id)),
c AS (SELECT x.engine AS engine, count(*) FILTER (t AND x.p) AS tp, count(*) FILTER (NOT t AND x.p) AS fp, count(*) FILTER (t AND NOT x.p) AS fn, count(*) FILTER (NOT t AND NOT x.p) AS tn FROM e GROUP BY 1)
SELECT engine, {_RATES} FROM c""")
_SWEPT = [2, 5, 10, 20, 40, 60, 80, 100, 200]


def _swept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four measures of every source and day, each with its cuts, against the sources that attacked on that day."""
    packets, training = _attacked(spark, sf_dir)
    by_port = packets.where(~training).groupBy("capture_id", "src_ip", "dst_port").agg(F.count(F.lit(1)).alias("n"), F.count_if(flows.initiator_syn()).alias("syn"), F.count_if(flows.has_flag("RST")).alias("rst"), F.max("injected").alias("t"))
    each = by_port.groupBy("capture_id", "src_ip").agg(F.sum("n").alias("packets"), F.sum("syn").alias("syn"), F.sum("rst").alias("rst"), F.count(F.lit(1)).alias("ports"), F.max("t").alias("t"))
    rows = each.unpivot(["t"], ["packets", "syn", "rst", "ports"], "measure", "value")
    return rules.threshold_sweep(rows, F.col("value"), F.col("t"), _SWEPT, "measure")


_add("attack_sweep", _swept, "WITH " + _DAY_PACKETS.replace("every AS (", "every0 AS (").replace("split AS (SELECT", _ATTACKED, 1) + f""",
k AS (SELECT cap, src_ip, count(*) AS packets, count(*) FILTER ({traffic._SYN}) AS syn, count(*) FILTER (contains(flags, 'RST')) AS rst, count(DISTINCT dst_port) AS ports, bool_or(injected) AS t FROM packets GROUP BY 1, 2),
r AS (SELECT t, unnest([{{'m': 'packets', 'v': packets}}, {{'m': 'syn', 'v': syn}}, {{'m': 'rst', 'v': rst}}, {{'m': 'ports', 'v': ports}}]) AS x FROM k),
c AS (SELECT x.m AS measure, cut::DOUBLE AS cut, count(*) FILTER (x.v >= cut AND t) AS tp, count(*) FILTER (x.v >= cut AND NOT t) AS fp, count(*) FILTER (x.v < cut AND t) AS fn, count(*) FILTER (x.v < cut AND NOT t) AS tn FROM r, (VALUES {", ".join(f"({c})" for c in _SWEPT)}) c(cut) GROUP BY 1, 2)
SELECT *, CASE WHEN tp + fn > 0 THEN CAST(floor(tp * 10000 / (tp + fn)) AS BIGINT) ELSE 0 END AS tpr_bp, CASE WHEN fp + tn > 0 THEN CAST(floor(fp * 10000 / (fp + tn)) AS BIGINT) ELSE 0 END AS fpr_bp,
       coalesce(cut = min(CASE WHEN fn = 0 AND fp = 0 AND tp > 0 THEN cut END) OVER (PARTITION BY measure), false) AS optimum FROM c""")
_DIM4 = ["packets", "bytes", "syn", "dports"]


def _forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = materialize(_windows(spark, sf_dir), "windows")
    train = found.where(F.col("window_index") < _TRAIN)
    model = forest.fit(train, _DIM4)
    cut = forest.threshold(forest.scored(train, _DIM4, model), 0.10)
    return forest.scored(found.where(F.col("window_index") >= _TRAIN), _DIM4, model).where(F.col("score") < cut).select("window_index", F.round("score", 6).alias("score"))


_add("forest_anomalies", _forest, _with(PACKETS, WINDOWS).replace("WITH ", "WITH RECURSIVE ", 1) + f""",
ftrain AS MATERIALIZED (SELECT * FROM windows WHERE window_index < {_TRAIN}), fours AS MATERIALIZED (SELECT * FROM windows WHERE window_index >= {_TRAIN}),{forest_sql("ftrain", "fours", _DIM4)}
SELECT window_index, round(score, 6) AS score FROM fours JOIN fscores USING ({", ".join(_DIM4)}), fcut WHERE score < cut""")
_add("forest_top_dimension", lambda s, d: forest.top_dimension(_DIM4, forest.upper_medians(_windows(s, d), _DIM4), _windows(s, d)).select("window_index", "dimension", "direction"), _with(PACKETS, WINDOWS) + """,
m AS (SELECT """ + ", ".join(f"(list({c}::DOUBLE ORDER BY {c}))[count(*) // 2 + 1] AS m_{c}" for c in _DIM4) + """ FROM windows),
x AS (SELECT window_index, unnest([""" + ", ".join(f"{{'d': '{c}', 'o': {i}, 'r': CASE WHEN m_{c} <> 0 THEN abs(({c} - m_{c}) / m_{c}) WHEN {c} > 0 THEN {c}::DOUBLE ELSE 0 END, 's': CASE WHEN {c} >= m_{c} THEN 'high' ELSE 'low' END}}" for i, c in enumerate(_DIM4)) + """]) AS v FROM windows, m)
SELECT window_index, v.d AS dimension, v.s AS direction FROM (SELECT *, row_number() OVER (PARTITION BY window_index ORDER BY v.r DESC, v.o) AS k FROM x) WHERE k = 1""")


def _day_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored profile for every day: medians of its hourly windows."""
    found = windows.by_dimension(windows.windows(_days(spark, sf_dir)[0], HOUR, "capture_id"), "capture_id")
    rows = found.groupBy(F.col("capture_id").alias("name"), "dimension").agg(F.median("value").alias("median"), F.count(F.lit(1)).alias("samples"))
    return rows.select("name", F.unix_millis(F.to_timestamp("name", "yyyy-MM-dd")).alias("updated_ms"), "dimension", "median", "samples")


def _two_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even days are in the first store; the second has all, with medians doubled."""
    rows = _day_profiles(spark, sf_dir)
    return store.with_fallback(rows.where(F.substring("name", 9, 2).cast("int") % 2 == 0), rows.withColumn("median", F.col("median") * 2))


_PROFILES = "WITH " + PACKETS.replace("SELECT event_id AS pkt_seq, ts,", "SELECT strftime(ts, '%Y-%m-%d') AS cap, event_id AS pkt_seq, ts,") + f""",
anchors AS (SELECT cap, min_by(ts_ms, pkt_seq) AS t0 FROM packets GROUP BY 1),
dayw AS (SELECT p.cap, CAST(floor((ts_ms - t0) / ({HOUR} * 1000)) AS BIGINT) AS window_index, count(*) AS packets, CAST(sum(length) AS BIGINT) AS bytes, count(*) FILTER ({traffic._SYN}) AS syn, count(DISTINCT CASE WHEN dst_port > 0 THEN dst_port END) AS dports FROM packets p JOIN anchors a ON p.cap = a.cap GROUP BY 1, 2),
prof AS (SELECT cap AS name, epoch_ms(CAST(cap AS TIMESTAMP)) AS updated_ms, dimension, median(value) AS median, count(*) AS samples FROM ({_UNPIVOT}) GROUP BY 1, 2, 3)"""
_add("baseline_lookup", _two_stores, _PROFILES + """
SELECT name, updated_ms, dimension, CASE WHEN CAST(name[9:10] AS INT) % 2 = 0 THEN median ELSE median * 2 END AS median, samples, CASE WHEN CAST(name[9:10] AS INT) % 2 = 0 THEN 'first' ELSE 'second' END AS source FROM prof""")
_add("baseline_list", lambda s, d: store.listed(_day_profiles(s, d)), _PROFILES + " SELECT name, any_value(updated_ms) AS updated_ms, count(*) AS dimensions, max(samples) AS samples FROM prof GROUP BY 1")
