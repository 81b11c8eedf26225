"""What surrounds a capture: labelled times, reports of indicators, captures without times."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import indicators, intervals, windows
from ..sources.packets import packets_from_events, table
from .traffic import _SYN, PACKETS, _with

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = sql


_MIN = 60_000


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets_from_events(table(spark, sf_dir, "events")).withColumn("capture_id", F.date_format("ts", "yyyy-MM-dd"))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarters of an hour of every day against incidents: each reset starts one of 0 to 45 minutes (to whole minutes, so some touch)."""
    packets = _days(spark, sf_dir)
    start = F.floor(F.col("ts_ms") / (15 * _MIN)) * 15 * _MIN
    found = packets.select("capture_id", start.alias("start_ms")).distinct().withColumn("end_ms", F.col("start_ms") + 15 * _MIN)
    begin = F.floor(F.col("ts_ms") / _MIN) * _MIN
    incidents = packets.where(F.contains("flags", F.lit("RST"))).select("capture_id", begin.alias("start_ms"), (begin + F.col("pkt_seq") % 4 * 15 * _MIN).alias("end_ms"))
    return intervals.window_labels(found, incidents, "capture_id", 15 * _MIN).withColumn("label", F.coalesce(F.col("label").cast("string"), F.lit("across")))


_DAY = _with(PACKETS) + ", p AS (SELECT *, strftime(ts, '%Y-%m-%d') AS capture_id FROM packets)"
_add("window_labels", _labelled, _DAY + f""",
w AS (SELECT DISTINCT capture_id, ts_ms // {15 * _MIN} * {15 * _MIN} AS start_ms FROM p), v AS (SELECT *, start_ms + {15 * _MIN} AS end_ms FROM w),
i AS (SELECT capture_id, ts_ms // {_MIN} * {_MIN} AS a, ts_ms // {_MIN} * {_MIN} + pkt_seq % 4 * {15 * _MIN} AS b FROM p WHERE contains(flags, 'RST')),
c AS (SELECT v.capture_id, v.start_ms, unnest(range(v.start_ms, v.end_ms, {_MIN})) AS m FROM v),
h AS (SELECT c.capture_id, c.start_ms, count(*) FILTER (EXISTS (SELECT 1 FROM i WHERE i.capture_id = c.capture_id AND i.a <= c.m AND c.m < i.b)) AS n FROM c GROUP BY 1, 2)
SELECT v.capture_id, v.start_ms, v.end_ms, CASE n WHEN 0 THEN '0' WHEN 15 THEN '1' ELSE 'across' END AS label FROM v JOIN h USING (capture_id, start_ms)""")


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains of a report: a name for every nation, written in several ways, and some that only look like a suffix."""
    k = F.col("n_nationkey")
    name = F.concat(F.expr("repeat('A', cast(n_nationkey as int) + 1)"), F.when(k % 2 == 0, ".Example.COM.").otherwise(".example.com"))
    return table(spark, sf_dir, "nation").select(F.when(k % 5 == 4, "ample.com").otherwise(name).alias("domain"))


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets whose queried names lie below another label for every other packet."""
    packets = packets_from_events(table(spark, sf_dir, "events"))
    return packets.withColumn("dns_query", F.when((F.col("dns_query") != "") & (F.col("pkt_seq") % 2 == 1), F.concat(F.lit("w3."), "dns_query", F.lit("."))).otherwise(F.col("dns_query")))


def _addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.concat(F.lit("10.0.1."), F.col("n_nationkey").cast("string")).alias("ip"))


_IOC = _with(PACKETS) + """,
n AS (SELECT DISTINCT CASE WHEN n_nationkey % 5 = 4 THEN 'ample.com' ELSE repeat('a', n_nationkey + 1) || '.example.com' END AS indicator FROM nation),
q AS (SELECT CASE WHEN pkt_seq % 2 = 1 THEN 'w3.' || dns_query ELSE dns_query END AS domain, count(*) AS packets FROM packets WHERE dns_query <> '' GROUP BY 1),
hit AS (SELECT indicator, domain, packets FROM q JOIN n ON domain = indicator OR ends_with(domain, '.' || indicator))"""
_add("report_domains", lambda s, d: indicators.domains_in_capture(_names(s, d), _listed(s, d)), _IOC + " SELECT * FROM hit")
_add("report_cross_check", lambda s, d: indicators.cross_check(_names(s, d), _listed(s, d), _addresses(s, d)), _IOC + """
SELECT (SELECT count(*) FROM n) AS listed_domains, (SELECT count(*) FROM nation) AS listed_ips, (SELECT count(*) FROM q) AS seen_domains, (SELECT count(DISTINCT dst_ip) FROM packets WHERE dst_ip <> '') AS seen_ips,
       (SELECT count(DISTINCT indicator) FROM hit) AS hit_domains, (SELECT count(DISTINCT dst_ip) FROM packets JOIN nation ON dst_ip = '10.0.1.' || n_nationkey) AS hit_ips""")


def _untimed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days as captures; on even days a third of the packets have lost their time."""
    lost = (F.substring("capture_id", 9, 2).cast("int") % 2 == 0) & (F.col("pkt_seq") % 3 == 0)
    return windows.untimed_windows(_days(spark, sf_dir).withColumn("ts_ms", F.when(~lost, F.col("ts_ms"))), 60, "capture_id")


_add("untimed_windows", _untimed, _DAY + f""",
l AS (SELECT *, CASE WHEN CAST(capture_id[9:10] AS INT) % 2 = 0 AND pkt_seq % 3 = 0 THEN NULL ELSE ts_ms END AS t FROM p),
c AS (SELECT capture_id, min_by(ts_ms, pkt_seq) AS t0, bool_or(t IS NULL) AS missing FROM l GROUP BY 1),
r AS (SELECT l.*, CASE WHEN missing THEN (row_number() OVER (PARTITION BY l.capture_id ORDER BY pkt_seq) - 1) * 1000 ELSE t - t0 END AS rel FROM l JOIN c USING (capture_id))
SELECT capture_id, CAST(floor(rel / 60000) AS BIGINT) AS bucket, count(*) AS packets, CAST(sum(length) AS BIGINT) AS bytes, count(*) FILTER ({_SYN}) AS syn, count(DISTINCT CASE WHEN dst_port > 0 THEN dst_port END) AS dports FROM r GROUP BY 1, 2""")
