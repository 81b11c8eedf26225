"""Assessment queries: labels, fingerprints, coerced numbers, checks of inputs, samples with expectations, rates; each with SQL that gives the same rows."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import assessment, engines, flows, retrieval, rules
from ..scratch import materialize
from ..sources.packets import table
from . import knowledge, records, traffic
from .traffic import _A, FLOWS, PACKETS, SCALED, _alerts, _packets, _with

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = sql


def _case(column: str, values: dict[str, str], other: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + f" ELSE {other} END"


_LABEL = _case("type", assessment.ALERT_LABELS, "type")
_QUERY = _case("type", {k: q for k, (q, _) in assessment.ALERT_PROFILES.items()}, "type")
_WORDS = _case("type", {k: ",".join(w) for k, (_, w) in assessment.ALERT_PROFILES.items()}, "''")
_add("alert_profiles", lambda s, d: assessment.alert_profiles(_alerts(s, d)).select("type", "subject", "label", "query", F.array_join("keywords", ",").alias("keywords")), _A + f"SELECT type, subject, {_LABEL} AS label, {_QUERY} AS query, {_WORDS} AS keywords FROM alerts")


def _threats(spark: SparkSession, sf_dir: str) -> DataFrame:
    alerts = _alerts(spark, sf_dir).withColumn("severity", F.col("severity"))
    return assessment.threat_types(alerts, "severity", ["rule_ord", "key_ord", "subject"])


_add("threat_types", _threats, _A + f""", f AS (SELECT severity, type, min(rule_ord) AS o FROM alerts GROUP BY 1, 2)
SELECT severity, string_agg({_LABEL}, ' ' ORDER BY o) AS threats FROM f GROUP BY 1""")
_add("detector_alerts", lambda s, d: assessment.by_detector(_alerts(s, d), "rule-based-port-scan").select("type", "subject", "value"), _A + "SELECT type, subject, value FROM alerts WHERE type = 'PORT_SCAN_SUSPECTED'")
_add("flow_packets", lambda s, d: flows.flow_packets(flows.flows(_packets(s, d)), flows.flow_flag_counts(_packets(s, d))), _with(PACKETS, FLOWS) + """,
k AS (SELECT protocol, least(src_ip || ':' || src_port, dst_ip || ':' || dst_port) AS lo, greatest(src_ip || ':' || src_port, dst_ip || ':' || dst_port) AS hi,
             bool_or(contains(flags, 'SYN')) AS syn, bool_or(contains(flags, 'ACK')) AS ack, bool_or(contains(flags, 'RST')) AS rst FROM packets GROUP BY 1, 2, 3)
SELECT protocol, dom_src_ip AS src_ip, dom_src_port AS src_port, dom_dst_ip AS dst_ip, dom_dst_port AS dst_port, first_ms AS ts_ms, bytes AS length, bytes AS payload_size,
       CASE WHEN protocol = 'TCP' THEN concat_ws(',', CASE WHEN syn THEN 'SYN' END, CASE WHEN ack THEN 'ACK' END, CASE WHEN rst THEN 'RST' END) ELSE '' END AS flags FROM flows JOIN k USING (protocol, lo, hi)""")

_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_returnflag"]
_LANES = ", ".join(f"CAST(sum(('0x' || h[{1 + 12 * k}:{12 + 12 * k}])::HUGEINT) AS HUGEINT)::VARCHAR AS l{k}" for k in range(4))
_add("table_fingerprint", lambda s, d: assessment.fingerprint(table(s, d, "lineitem"), _KEYS), f"""
WITH h AS (SELECT sha256(concat_ws('|', {", ".join(f"coalesce({c}::VARCHAR, 'null')" for c in _KEYS)})) AS h FROM lineitem), s AS (SELECT count(*) AS rows, {_LANES} FROM h)
SELECT rows, sha256(concat_ws(':', rows::VARCHAR, l0, l1, l2, l3))[1:16] AS fingerprint FROM s""")


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A confidence for every order as a report may write it."""
    k = F.col("o_orderkey") % 6
    token = F.when(k == 0, (F.col("o_orderkey") % 100 / 100).cast("string")).when(k == 1, F.concat(F.lit('" '), (F.col("o_orderkey") % 10).cast("string"), F.lit('.5"'))).when(k == 2, F.lit("true")).when(k == 3, F.lit("null")).when(k == 4, F.concat(F.lit('"'), "o_orderpriority", F.lit('"')))
    return table(spark, sf_dir, "orders").select("o_orderkey", token.alias("token"))


_add("coerced_numbers", lambda s, d: _tokens(s, d).select("o_orderkey", assessment.coerced(F.col("token"))["value"].alias("value"), assessment.coerced(F.col("token"))["raw"].alias("raw"), assessment.shown_confidence(F.col("token")).alias("shown")), """
WITH t AS (SELECT o_orderkey, o_orderkey % 6 AS k, CASE o_orderkey % 6 WHEN 0 THEN (o_orderkey % 100)::DOUBLE / 100 WHEN 1 THEN (o_orderkey % 10)::DOUBLE + 0.5 ELSE 0 END AS value,
  CASE o_orderkey % 6 WHEN 2 THEN 'True' WHEN 3 THEN 'None' WHEN 4 THEN o_orderpriority WHEN 5 THEN 'None' END AS raw FROM orders)
SELECT o_orderkey, value, raw, printf('%.2f', value) || CASE WHEN raw IS NOT NULL THEN '（原始值不可解析: ' || raw || '）' ELSE '' END AS shown FROM t""")


def _inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, sizes, keys and addresses of the customers' own."""
    k = F.col("c_custkey")
    name = F.concat(F.lit("cap.v1"), F.element_at(F.array(*[F.lit(x) for x in (".pcap", ".PCAPNG", ".exe", "", ".pcap.gz")]), (k % 5 + 1).cast("int")))
    url = F.concat(F.when(k % 7 == 0, "http://").otherwise("https://"), F.element_at(F.array(*[F.lit(x) for x in ("api.example.com/v1", "10.0.0.1", "localhost", "8.8.8.8:443/x", "user@192.168.1.1", "db.internal", "example.com:8443")]), (k % 7 + 1).cast("int")))
    rows = table(spark, sf_dir, "customer").select("c_custkey", name.alias("name"), (k * 100_000).alias("size"), F.concat("c_name", F.when(k % 3 == 0, "?").otherwise("")).alias("base"), F.substring(F.concat(F.when(k % 4 == 0, "XXXX").otherwise(""), "c_name"), F.lit(1), (k % 20).cast("int")).alias("key"), url.alias("url"))
    c = F.col
    return rows.select("c_custkey", assessment.upload_error(c("name"), c("size")).alias("upload"), assessment.name_error(c("base")).alias("base"), assessment.key_error(c("key")).alias("key"), assessment.safe_endpoint(c("url")).alias("safe"))


_add("input_checks", _inputs, """
WITH x AS (SELECT c_custkey, c_custkey % 5 AS e, c_custkey * 100000 AS size, c_name || CASE WHEN c_custkey % 3 = 0 THEN '?' ELSE '' END AS base, substring(CASE WHEN c_custkey % 4 = 0 THEN 'XXXX' ELSE '' END || c_name, 1, c_custkey % 20) AS key FROM customer)
SELECT c_custkey, CASE WHEN e IN (2, 3, 4) THEN '不支持的文件类型 ' || CASE e WHEN 2 THEN '.exe' WHEN 3 THEN '.v1' ELSE '.gz' END || '，仅允许: .cap, .pcap, .pcap.gz, .pcapng' WHEN size > 200 * 1024 * 1024 THEN '文件超过大小限制（200MB）' END AS upload,
       CASE WHEN contains(base, '?') THEN '基线名称包含非法字符（\\ / : * ? " < > |）' END AS base,
       CASE WHEN length(key) = 0 THEN 'API Key 不能为空' WHEN contains(lower(key), 'xxxx') THEN 'API Key 仍是占位符，请填写真实 Key' WHEN length(key) < 10 THEN 'API Key 长度过短（' || length(key) || ' 字符），可能不完整' END AS key,
       c_custkey % 7 = 3 AS safe FROM x""")
_add("technique_lookup", lambda s, d: assessment.by_technique(_techniques(s, d), "t1007").unionByName(assessment.by_tactic(_techniques(s, d), "ASIA")), """
WITH t AS (SELECT 'T' || (1000 + n_nationkey) AS technique, n_name AS name, r_name AS tactic FROM nation JOIN region ON n_regionkey = r_regionkey) SELECT * FROM t WHERE technique = 'T1007' UNION ALL SELECT * FROM t WHERE tactic = 'ASIA'""")


def _techniques(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat(F.lit("T"), (F.col("n_nationkey") + 1000).cast("string")).alias("technique"), F.col("n_name").alias("name"), F.col("r_name").alias("tactic"))


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report for every conversation: its turns are the attacks, its numbers of characters the facts."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("t"))
    attack = F.struct("turn", F.concat(F.substring("t", 1, 60), F.lit(" "), F.when(F.col("turn") % 2 == 0, F.length("t").cast("string")).otherwise("")).alias("evidence"), F.array(F.substring("t", 1, 80), F.when(F.col("turn") % 3 == 0, "Block it").otherwise("wait")).alias("recommended_actions"))
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(attack)).alias("attacks"), F.collect_list(F.length("t").cast("string")).alias("numbers"), F.count(F.lit(1)).alias("n"))  # a conversation's turns
    k = F.col("conv_id")
    return grouped.select("conv_id", F.when(k % 3 > 0, "overview").alias("overview"), F.when(k % 4 > 0, 0.5).alias("overall_confidence"), "attacks", F.array(F.lit("monitor")).alias("recommended_actions"), (F.col("n") + k % 2).alias("n_alerts"), F.array(F.lit("")).alias("ips"), "numbers")


_ACT = " OR ".join(f"contains(a, '{w}')" for w in assessment.ACTIONS)
_add("report_scores", lambda s, d: assessment.report_scores(_reports(s, d)).select("conv_id", "completeness", "evidence_accuracy", "actionability"), rf"""
WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations),
e AS (SELECT conv_id, turn, t[1:60] || ' ' || CASE WHEN turn % 2 = 0 THEN length(t)::VARCHAR ELSE '' END AS ev, unnest([t[1:80], CASE WHEN turn % 3 = 0 THEN 'Block it' ELSE 'wait' END]) AS a FROM t),
c AS (SELECT conv_id, count(*) AS n FROM t GROUP BY 1),
h AS (SELECT DISTINCT e.conv_id, e.turn, ev FROM e), nums AS (SELECT conv_id, length(t)::VARCHAR AS x FROM t),
hit AS (SELECT conv_id, count(*) FILTER (EXISTS (SELECT 1 FROM nums WHERE nums.conv_id = h.conv_id AND length(x) >= 2 AND contains(ev, x))) AS hits, count(*) FILTER (ev <> '') AS cited FROM h GROUP BY 1),
acts AS (SELECT conv_id, count(*) FILTER ({_ACT} OR regexp_matches(a, '(?i)\b(block|deny|drop|isolate|quarantine|disable|limit)\b')) + 1 AS named, count(*) + 1 AS n FROM e GROUP BY 1)
SELECT conv_id, round(((CASE WHEN conv_id % 3 > 0 THEN 1 ELSE 0 END + CASE WHEN conv_id % 4 > 0 THEN 1 ELSE 0 END)::DOUBLE / 2 + c.n::DOUBLE / greatest(1, c.n + conv_id % 2)) / 2, 4) AS completeness, round(hits::DOUBLE / cited, 4) AS evidence_accuracy, round(named::DOUBLE / acts.n, 4) AS actionability
FROM c JOIN hit USING (conv_id) JOIN acts USING (conv_id)""")


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        (k % 7 > 0).alias("structured_ok"), (k % 11 == 0).alias("degraded"), (F.col("o_orderstatus") == "F").alias("judged"), F.when(k % 13 > 0, k % 2 == 0).alias("expected"), (k % 4).alias("knowledge_refs"), (k % 100 / 8).alias("seconds"))


_add("judgement_rates", lambda s, d: assessment.judgement_rates(_results(s, d)), """
SELECT count(*) AS cases, round(avg((o_orderkey % 7 > 0)::INT), 4) AS structured_success_rate, round(avg((o_orderkey % 11 = 0)::INT), 4) AS degradation_rate,
       round(avg(((o_orderstatus = 'F') IS NOT DISTINCT FROM CASE WHEN o_orderkey % 13 > 0 THEN o_orderkey % 2 = 0 END)::INT), 4) AS threat_judgment_accuracy, round(avg((o_orderkey % 4 > 0)::INT), 4) AS reference_usage, round(avg((o_orderkey % 100)::DOUBLE / 8), 2) AS avg_latency_s FROM orders""")


def _golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days as samples: every third must be clean, the others must show a scan or a flood of UDP packets."""
    packets, training = records._days(spark, sf_dir)
    later = packets.where(~training)
    alerts = rules.unsorted_alerts(later, replace(records._PER_DAY, udp_flood_min=9, port_scan_min=7), captures=True)
    day = F.substring("capture_id", 9, 2).cast("int")
    expected = later.select("capture_id").distinct().withColumn("expected", F.when(day % 3 == 1, "PORT_SCAN_SUSPECTED").when(day % 3 == 2, "UDP_FLOOD_SUSPECTED"))
    return assessment.sample_status(alerts, expected, "capture_id")


_GOLDEN = "WITH " + records._DAY_PACKETS + "," + records._DAY_FLOWS + ", ruled AS (" + " UNION ALL ".join(f"SELECT cap, type FROM ({records._day_sql(q)})" for q in traffic.rule_sql(replace(records._PER_DAY, udp_flood_min=9, port_scan_min=7)).values()) + """),
g AS (SELECT cap, count(*) AS alerts, array_to_string(list_sort(list(DISTINCT type)), ',') AS types FROM ruled GROUP BY 1),
x AS (SELECT DISTINCT cap, CASE CAST(cap[9:10] AS INT) % 3 WHEN 1 THEN 'PORT_SCAN_SUSPECTED' WHEN 2 THEN 'UDP_FLOOD_SUSPECTED' END AS expected FROM packets),
s AS (SELECT cap AS capture_id, expected, coalesce(alerts, 0) AS alerts, coalesce(types, '') AS types, CASE WHEN expected IS NULL AND coalesce(alerts, 0) = 0 THEN 'TN' WHEN expected IS NULL THEN 'FP' WHEN contains(types, expected) THEN 'TP' ELSE 'FN' END AS status FROM x LEFT JOIN g USING (cap))"""
_add("golden_samples", lambda s, d: _golden(s, d).withColumn("types", F.array_join("types", ",")), _GOLDEN + " SELECT * FROM s")
_add("golden_rates", lambda s, d: assessment.sample_rates(_golden(s, d)), _GOLDEN + """, c AS (SELECT count(*) FILTER (status = 'TP') AS tp, count(*) FILTER (status = 'FP') AS fp, count(*) FILTER (status = 'FN') AS fn, count(*) FILTER (status = 'TN') AS tn FROM s)
SELECT *, CASE WHEN tp + fp > 0 THEN round(tp::DOUBLE / (tp + fp), 4) ELSE 0 END AS "precision", CASE WHEN tp + fn > 0 THEN round(tp::DOUBLE / (tp + fn), 4) ELSE 0 END AS recall, CASE WHEN tp + fp + fn > 0 THEN round(2.0::DOUBLE * tp / (2 * tp + fp + fn), 4) ELSE 0 END AS f1 FROM c""")


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten days' windows are normal: four fifths train, the last fifth and the other days test."""
    packets, training = records._days(spark, sf_dir)
    found = records.windows.windows(packets, traffic.HOUR, "capture_id")
    normal = assessment.first_share(found.where(training), ["capture_id", "window_index"], 0.8)
    train = normal.where("first").withColumn("window_index", F.xxhash64("capture_id", "window_index"))
    tested, attacks = normal.where("not first").drop("first"), found.where(~training)
    profile = engines.baseline.learn(train)
    deviating = engines.deviations(engines.Found(tested.unionByName(attacks), train, profile), records._SET)
    return assessment.split_rates(tested, attacks, deviating, "capture_id")


_add("split_rates", _split, records._DAYS.replace("traind AS (SELECT alld.* FROM alld, split WHERE cap < first)", """nn AS (SELECT cap, window_index, row_number() OVER (ORDER BY cap, window_index) - 1 AS i FROM dayw, split WHERE cap < first), nk AS (SELECT CAST(floor(count(*) * 0.8::DOUBLE) AS BIGINT) AS k FROM nn),
traind AS (SELECT alld.* FROM alld JOIN nn USING (cap, window_index), nk WHERE i < k)""").replace("ours AS (SELECT alld.* FROM alld, split WHERE cap >= first)", "ours AS (SELECT alld.* FROM alld LEFT JOIN nn USING (cap, window_index), nk WHERE i IS NULL OR i >= k)") + """,
w AS (SELECT DISTINCT cap, window_index, cap < first AS normal FROM ours, split), h AS (SELECT DISTINCT cap, window_index FROM dev),
n AS (SELECT count(*) AS test_windows, count(*) FILTER (EXISTS (SELECT 1 FROM h WHERE h.cap = w.cap AND h.window_index = w.window_index)) AS false_alarms FROM w WHERE normal),
a AS (SELECT count(*) AS attacks, count(*) FILTER (EXISTS (SELECT 1 FROM h WHERE h.cap = c.cap)) AS caught FROM (SELECT DISTINCT cap FROM w WHERE NOT normal) c)
SELECT test_windows, false_alarms, attacks, caught, round(false_alarms::DOUBLE / greatest(test_windows, 1), 4) AS fpr, round(caught::DOUBLE / greatest(attacks, 1), 4) AS tpr FROM n, a""")


def _modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of four modes of retrieval over comparison questions: whole or cut, by BM25 alone or fused with the overlap of terms."""
    subs = knowledge._questions(spark, sf_dir).select((F.col("query_id") * 4 + F.col("sub")).alias("query_id"), "text")
    whole = knowledge._queries(spark, sf_dir).select((F.col("query_id") * 4 + 2).alias("query_id"), "text")
    titles = knowledge._chunks(spark, sf_dir).select("chunk_id", F.coalesce("source", F.lit("")).alias("title"))
    lists = materialize(retrieval.ranked(retrieval.ask(knowledge._chunks(spark, sf_dir), whole.unionByName(subs))), "ranked")  # 20 of each list
    every = None
    for mode, split in (("bm25", False), ("bm25+overlap", False), ("bm25+cut", True), ("full", True)):
        own = lists.where(F.col("query_id") % 4 < 2 if split else F.col("query_id") % 4 == 2)
        found = own.where("list = 'bm25'") if mode in ("bm25", "bm25+cut") else retrieval.top(retrieval.fuse([own]), 5)
        found = found.where("rank <= 5").select(F.floor(F.col("query_id") / 4).alias("query_id"), "chunk_id", "rank", F.lit(mode).alias("mode"))
        every = found if every is None else every.unionByName(found)
    wanted = knowledge._queries(spark, sf_dir).select("query_id", F.concat(F.lit("src"), (F.col("query_id") % 10).cast("string")).alias("keyword"))
    return assessment.title_recall(every.join(titles, "chunk_id"), wanted)


def _modes_sql() -> str:
    cut = knowledge._SUB_INDEX.replace("listed AS", "listed2 AS").replace("FROM listed", "FROM listed2").replace("posts AS", "posts2 AS").replace("stats AS", "stats2 AS").replace("df AS", "df2 AS").replace("FROM posts GROUP", "FROM posts2 GROUP").replace("asked AS", "asked2 AS")
    bm2 = knowledge._bm25_sql("bmc").replace("FROM asked JOIN df USING (term) JOIN posts USING (term), stats", "FROM asked2 JOIN df2 USING (term) JOIN posts2 USING (term), stats2")
    over2 = knowledge._OVERLAP.replace("over AS", "over2 AS").replace("FROM posts JOIN asked", "FROM posts2 JOIN asked2")
    fused2 = knowledge._FUSED.replace("fused AS", "fused2 AS").replace("FROM bm UNION", "FROM bmc UNION").replace("FROM over)", "FROM over2)")
    top = lambda t: f"(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM {t})"
    return f"WITH {knowledge._INDEX},{knowledge._bm25_sql('bm')},{knowledge._OVERLAP},{knowledge._FUSED},{knowledge._QUESTIONS},{cut},{bm2},{over2},{fused2}" + f""",
every AS (
  SELECT 'bm25' AS mode, query_id, chunk_id FROM bm WHERE rank <= 5 UNION ALL SELECT 'bm25+overlap', query_id, chunk_id FROM {top("fused")} WHERE rank <= 5
  UNION ALL SELECT 'bm25+cut', query_id // 2, chunk_id FROM bmc WHERE rank <= 5 UNION ALL SELECT 'full', query_id // 2, chunk_id FROM {top("fused2")} WHERE rank <= 5),
q AS (SELECT item_id AS query_id, 'src' || (item_id % 10) AS keyword, m.mode FROM benchmark, (SELECT DISTINCT mode FROM every) m),
found AS (SELECT q.mode, q.query_id, coalesce(max(contains(coalesce(d.source, ''), keyword)), false) AS hit FROM q LEFT JOIN every e ON e.mode = q.mode AND e.query_id = q.query_id LEFT JOIN documents d ON d.doc_id = e.chunk_id GROUP BY 1, 2)
SELECT mode, count(*) AS queries, count(*) FILTER (hit) AS hits, round(count(*) FILTER (hit)::DOUBLE / count(*), 4) AS recall FROM found GROUP BY 1"""


_add("retrieval_ablation", _modes, _modes_sql())

#: Rules over the line items as packets, for volume.
_LINES = replace(SCALED, syn_flood_min=60, syn_flood_high=4000, port_scan_min=100, port_scan_high=700, dns_tunnel_min=20, rst_storm_min=50, udp_flood_min=100, udp_flood_high=800, dns_amp_responses=20, quic_connections=20, quic_long_flow=6, large_flow_mb=0.5)


def _line_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, p, s, o = F.col("l_linenumber") % 4, F.col("l_partkey"), F.col("l_suppkey"), F.col("l_orderkey")
    quic = (n == 0) & (p % 3 == 0)
    length = F.floor("l_extendedprice").cast("long")
    return table(spark, sf_dir, "lineitem").select(
        ((o * 8 + F.col("l_linenumber")) * 100_000 + p).alias("pkt_seq"), F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("ts_ms"), F.when(n == 0, "UDP").when(n == 1, "DNS").otherwise("TCP").alias("protocol"),
        F.concat(F.lit("10.1.0."), (s % 20).cast("string")).alias("src_ip"), (40000 + o % 50).cast("int").alias("src_port"), F.concat(F.lit("10.1.0."), (p % 20).cast("string")).alias("dst_ip"), F.when(quic, 443).otherwise(p % 1000 + 1).cast("int").alias("dst_port"),
        length.alias("length"), F.greatest(length - 54, F.lit(0)).alias("payload_size"),
        F.when(n <= 1, "").when(F.col("l_returnflag") == "R", "ACK,RST").when(F.col("l_returnflag") == "A", "SYN").when(o % 2 == 0, "SYN,ACK").otherwise("ACK,PSH").alias("flags"),
        F.when(n == 1, F.concat(F.expr("repeat('a', cast(l_suppkey % 50 as int))"), F.lit(".example.com"))).otherwise("").alias("dns_query"), F.when((n == 1) & (o % 2 == 0), "10.0.0.1").otherwise("").alias("dns_response"),
        F.when(quic, F.concat(F.lit("UDP QUIC Version=0x"), F.when(o % 6 == 0, "00000001").when(o % 6 == 2, "ff00001d").otherwise("deadbeef"))).otherwise("").alias("raw_summary"),
    )


_LINE_PACKETS = """
packets AS (
  SELECT (l_orderkey * 8 + l_linenumber) * 100000 + l_partkey AS pkt_seq, epoch_ms(l_shipdate::TIMESTAMP) AS ts_ms, CASE l_linenumber % 4 WHEN 0 THEN 'UDP' WHEN 1 THEN 'DNS' ELSE 'TCP' END AS protocol, '10.1.0.' || (l_suppkey % 20) AS src_ip, CAST(40000 + l_orderkey % 50 AS INT) AS src_port,
         '10.1.0.' || (l_partkey % 20) AS dst_ip, CAST(CASE WHEN l_linenumber % 4 = 0 AND l_partkey % 3 = 0 THEN 443 ELSE l_partkey % 1000 + 1 END AS INT) AS dst_port, CAST(floor(l_extendedprice) AS BIGINT) AS length, greatest(CAST(floor(l_extendedprice) AS BIGINT) - 54, 0) AS payload_size,
         CASE WHEN l_linenumber % 4 <= 1 THEN '' WHEN l_returnflag = 'R' THEN 'ACK,RST' WHEN l_returnflag = 'A' THEN 'SYN' WHEN l_orderkey % 2 = 0 THEN 'SYN,ACK' ELSE 'ACK,PSH' END AS flags,
         CASE WHEN l_linenumber % 4 = 1 THEN repeat('a', l_suppkey % 50) || '.example.com' ELSE '' END AS dns_query, CASE WHEN l_linenumber % 4 = 1 AND l_orderkey % 2 = 0 THEN '10.0.0.1' ELSE '' END AS dns_response,
         CASE WHEN l_linenumber % 4 = 0 AND l_partkey % 3 = 0 THEN 'UDP QUIC Version=0x' || CASE l_orderkey % 6 WHEN 0 THEN '00000001' WHEN 2 THEN 'ff00001d' ELSE 'deadbeef' END ELSE '' END AS raw_summary FROM lineitem)"""
_LINE_ALERTS = "\nalerts AS (" + "\nUNION ALL BY NAME\n".join(f"SELECT * FROM ({x})" for x in traffic.rule_sql(_LINES).values()) + ")"
_add("lineitem_alerts", lambda s, d: rules.all_alerts(_line_packets(s, d), _LINES), _with(_LINE_PACKETS, FLOWS, _LINE_ALERTS) + "SELECT * REPLACE (CAST(rule_ord AS BIGINT) AS rule_ord) FROM alerts")
