"""What is written and read again: flow exports, log files, stored baselines, knowledge of several sources; seasons of many captures."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import baseline, records, seasonal, store, windows
from ..scratch import materialize, shared_dir
from ..sources import files
from ..sources.packets import packets_from_events, table
from .traffic import _SYN, _TRAIN, DIMS, HOUR, PACKETS, PROFILE, WINDOWS, _train, _with

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, query, sql: str) -> None:
    QUERIES[name] = query
    ORACLE_SQL[name] = sql


def _packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets_from_events(table(spark, sf_dir, "events"))


def _folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def _exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets written as a flow export (padded header names, every tenth port no number) and read again."""
    has = lambda f: F.contains("flags", F.lit(f)).cast("int")
    number = F.when(F.col("protocol") == "TCP", 6).when(F.col("protocol") == "UDP", 17).otherwise(47)
    columns = {
        " Timestamp": F.date_format("ts", "d/M/yyyy H:mm:ss"), " Protocol": number, " Source IP": F.col("src_ip"), " Source Port": F.when(F.col("pkt_seq") % 10 == 0, "none").otherwise(F.col("src_port").cast("string")),
        " Destination IP": F.col("dst_ip"), " Destination Port": F.col("dst_port"), "Total Length of Fwd Packets": F.col("length").cast("double"), " Total Length of Bwd Packets": F.col("payload_size"),
        " Total Fwd Packets": F.lit(1), " Total Backward Packets": F.col("pkt_seq") % 3, "SYN Flag Count": has("SYN"), " ACK Flag Count": has("ACK"), " RST Flag Count": has("RST"),
        " Label": F.when(F.col("length") > 1000, "Large ").otherwise("BENIGN"),
    }
    path = _folder(spark, "flow-export")
    _packets(spark, sf_dir).select(*[c.alias(name) for name, c in columns.items()]).write.csv(path, header=True)
    return files.flow_export(spark, path)


_add("flow_export_rows", lambda s, d: _exported(s, d).withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")), _with(PACKETS) + """
SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, CASE protocol WHEN 'TCP' THEN 'TCP' WHEN 'UDP' THEN 'UDP' ELSE 'GRE' END AS protocol, src_ip, src_port, dst_ip, dst_port,
       concat_ws(',', CASE WHEN contains(flags, 'SYN') THEN 'SYN' END, CASE WHEN contains(flags, 'ACK') THEN 'ACK' END, CASE WHEN contains(flags, 'RST') THEN 'RST' END) AS flags,
       length + payload_size AS length, 1 + pkt_seq % 3 AS packets, CASE WHEN length > 1000 THEN 'Large' ELSE 'BENIGN' END AS label FROM packets WHERE pkt_seq % 10 <> 0""")


def _logged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as log lines, every seventh one broken, and read again."""
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("value") > 100, "WARNING").otherwise("INFO")
    whole = F.concat_ws(" | ", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.rpad(level, 8, " "), F.concat("event_type", F.lit(" - "), "props", F.lit(" | user "), F.col("user_id").cast("string")))
    path = _folder(spark, "logs")
    table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 7 == 0, F.lit("Traceback: no line of a log")).otherwise(whole).alias("value")).write.text(path)
    lines = files.log_lines(spark, path)
    return records.log_records(lines)


_add("log_files", lambda s, d: _logged(s, d).select("time", "level", "module", "message"), """
SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS time, CASE WHEN event_type = 'error' THEN 'ERROR' WHEN value > 100 THEN 'WARNING' ELSE 'INFO' END AS level, event_type AS module, props || ' | user ' || user_id AS message FROM events WHERE event_id % 7 <> 0""")


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two names saved three times and loaded: profiles of the latest saves with the number of windows that came with them."""
    train = materialize(_train(spark, sf_dir), "windows")
    path, profile = _folder(spark, "baselines"), baseline.learn(train)
    store.save(profile.withColumn("median", F.lit(0.0)), train.limit(0), "office", 1, path)  # superseded
    store.save(profile, train, "office", 2, path)
    store.save(profile, train.where("window_index % 2 = 0"), "lab", 5, path)
    profiles, training = store.load(spark, path)
    counts = training.groupBy("name").agg(F.count(F.lit(1)).alias("windows"), F.sum("bytes").alias("bytes"))
    return profiles.join(counts, "name").select("name", "updated_ms", "dimension", "median", "mad", "raw_mad", "samples", "windows", "bytes")


_add("stored_baselines", _stored, _with(PACKETS, WINDOWS, DIMS, PROFILE) + f""",
n AS (SELECT 'office' AS name, 2::BIGINT AS updated_ms, count(*) AS windows, CAST(sum(bytes) AS BIGINT) AS bytes FROM windows WHERE window_index < {_TRAIN} UNION ALL
      SELECT 'lab', 5::BIGINT, count(*), CAST(sum(bytes) AS BIGINT) FROM windows WHERE window_index < {_TRAIN} AND window_index % 2 = 0)
SELECT name, updated_ms, dimension, median, mad, raw_mad, samples, windows, bytes FROM n, profile""")


def _knowledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by language, and those of even ids again as notes: the first source of equal items stays."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("title"), F.col("text").alias("content"), "lang")
    sources = {"english": docs.where("lang = 'en'"), "notes": docs.where("doc_id % 2 = 0"), "rest": docs.where("lang <> 'en'")}
    return store.united(sources).groupBy("category", "title").agg(F.count(F.lit(1)).alias("items"), F.sum(F.length("content")).alias("chars"))


_add("knowledge_union", _knowledge, """
WITH every AS (SELECT source AS title, text AS content, 0 AS o, 'english' AS category FROM documents WHERE lang = 'en' UNION ALL SELECT source, text, 1, 'notes' FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT source, text, 2, 'rest' FROM documents WHERE lang <> 'en'),
one AS (SELECT title, content, arg_min(category, o) AS category FROM every GROUP BY 1, 2)
SELECT category, title, count(*) AS items, CAST(sum(length(content)) AS BIGINT) AS chars FROM one GROUP BY 1, 2""")


def _series(spark: SparkSession, sf_dir: str, capture) -> DataFrame:
    found = windows.windows(_packets(spark, sf_dir).withColumn("capture_id", capture), HOUR, "capture_id")
    return materialize(found.select("capture_id", F.col("window_index").alias("idx"), F.col("packets").cast("double").alias("value")), "series")


def _series_sql(capture: str) -> str:
    return _with(PACKETS) + f""",
p AS (SELECT *, {capture} AS capture_id FROM packets), t0s AS (SELECT capture_id, min_by(ts_ms, pkt_seq) AS t0 FROM p GROUP BY 1),
b AS (SELECT capture_id, floor((ts_ms - t0) / ({HOUR} * 1000)) AS bucket, count(*)::DOUBLE AS value FROM p JOIN t0s USING (capture_id) GROUP BY 1, 2),
s AS (SELECT capture_id, row_number() OVER (PARTITION BY capture_id ORDER BY bucket) - 1 AS idx, value FROM b),
tr AS (SELECT *, avg(value) OVER (PARTITION BY capture_id ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS trend FROM s)"""


#: The first day is too short for two periods; the rest isn't.
_add("seasonal_alerts", lambda s, d: seasonal.seasonal_alerts(_series(s, d, F.when(F.date_format("ts", "yyyy-MM-dd") == "2024-01-01", "short").otherwise("long")), 24, 1.5, "capture_id"), _series_sql("CASE WHEN ts < TIMESTAMP '2024-01-02' THEN 'short' ELSE 'long' END") + """,
r AS (SELECT *, value - trend - avg(value - trend) OVER (PARTITION BY capture_id, idx % 24) AS residual, avg(value) OVER (PARTITION BY capture_id) AS mean, count(*) OVER (PARTITION BY capture_id) AS n FROM tr),
x AS (SELECT *, CASE WHEN n < 48 THEN value - mean ELSE residual END AS x FROM r), st AS (SELECT capture_id, avg(x) AS m, CASE WHEN stddev_pop(x) > 0 THEN stddev_pop(x) ELSE 1 END AS sd FROM x GROUP BY 1)
SELECT capture_id, 'SEASONAL_ANOMALY' AS type, idx AS window_index, value, round(abs(x - m) / sd, 2) AS z, CASE WHEN x > m THEN 'high' ELSE 'low' END AS direction,
       CASE WHEN abs(x - m) / sd > 5 THEN 'CRITICAL' WHEN abs(x - m) / sd > 4 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, CASE WHEN n < 48 THEN 'zscore_fallback' ELSE 'moving_average' END AS method
FROM x JOIN st USING (capture_id) WHERE abs(x - m) / sd > 1.5""")
_add("seasonal_auto_period", lambda s, d: seasonal.auto_seasonal(_series(s, d, F.date_format("ts", "yyyy-MM-dd")), 2.0, "capture_id"), _series_sql("strftime(ts, '%Y-%m-%d')") + """,
per AS (SELECT greatest(6, least(48, max(n) // 4)) AS period FROM (SELECT count(*) AS n FROM s GROUP BY capture_id)),
r AS (SELECT tr.*, value - trend - avg(value - trend) OVER (PARTITION BY capture_id, idx % period) AS residual FROM tr, per),
st AS (SELECT capture_id, avg(residual) AS m, CASE WHEN stddev_pop(residual) > 0 THEN stddev_pop(residual) ELSE 1 END AS sd FROM r GROUP BY 1)
SELECT capture_id, idx, value, CASE WHEN residual > m THEN 'high' ELSE 'low' END AS direction FROM r JOIN st USING (capture_id) WHERE abs(residual - m) > 2 * sd""")
