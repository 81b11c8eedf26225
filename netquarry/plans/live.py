"""Streaming queries over the events table, replayed in parts; windows and flows are compared where they are closed."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rules
from ..operators.windows import epoch_windows
from ..scratch import shared_dir
from ..sources.packets import packets_from_events, table
from ..streaming import live
from .traffic import _A, _SYN, HOUR, PACKETS, SCALED, _with

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _scratch(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly windows by a file stream; the last hour and a half stays open behind the watermark."""
    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parq*")
    packets = packets_from_events(events).withColumn("ts", F.col("ts").cast("timestamp"))
    folder = _scratch(spark)
    return live.run_to_end(live.stream_windows(packets, HOUR), f"{folder}/out", f"{folder}/state")


QUERIES["stream_windows"] = stream_windows
ORACLE_SQL["stream_windows"] = _with(PACKETS) + f"""
SELECT * FROM (
  SELECT ts_ms // ({HOUR} * 1000) * ({HOUR} * 1000) AS start_ms, count(*) AS packets, CAST(sum(length) AS BIGINT) AS bytes, count(*) FILTER ({_SYN}) AS syn, count(DISTINCT CASE WHEN dst_port > 0 THEN dst_port END) AS dports
  FROM packets GROUP BY 1)
WHERE start_ms + {HOUR} * 1000 <= (SELECT max(ts_ms) - 600000 FROM packets)"""


REPLAYS = 3  # parts of the events, in order of time


def _replayed(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """A packet stream of the events, written as parts that a stream takes one by one."""
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    ends = events.agg(F.min("ts").cast("double").alias("a"), F.max("ts").cast("double").alias("b")).first()
    part = F.least(F.floor((F.col("ts").cast("double") - ends.a) * REPLAYS / max(ends.b - ends.a, 1e-9)), F.lit(REPLAYS - 1))
    for k in range(REPLAYS):
        events.where(part == k).coalesce(1).write.mode("append").parquet(f"{folder}/events")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/events")
    return packets_from_events(stream)


def stream_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules on a stream: the report at its end is that of the batch."""
    folder = _scratch(spark)
    counts = live.stream_signals(_replayed(spark, sf_dir, folder), SCALED, f"{folder}/signals", f"{folder}/state")
    return rules.in_order(rules.alerts_of(counts, SCALED))


QUERIES["stream_alerts"] = stream_alerts
ORACLE_SQL["stream_alerts"] = _A + "SELECT * REPLACE (CAST(rule_ord AS BIGINT) AS rule_ord) FROM alerts"

IDLE = 6 * HOUR


def stream_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows that were idle for six hours, each once; those that may go on are still state."""
    folder = _scratch(spark)
    return live.run_to_end(live.stream_flows(_replayed(spark, sf_dir, folder), IDLE), f"{folder}/out", f"{folder}/state")


QUERIES["stream_flows"] = stream_flows
ORACLE_SQL["stream_flows"] = _with(PACKETS) + f""",
k AS (SELECT protocol, least(src_ip || ':' || src_port, dst_ip || ':' || dst_port) AS lo, greatest(src_ip || ':' || src_port, dst_ip || ':' || dst_port) AS hi, ts, ts_ms, length
      FROM packets WHERE protocol IN ('TCP', 'UDP') AND src_ip <> '' AND dst_ip <> ''),
g AS (SELECT *, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER w) > {IDLE} * 1000000::BIGINT, true) AS fresh FROM k WINDOW w AS (PARTITION BY protocol, lo, hi ORDER BY ts)),
n AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY protocol, lo, hi ORDER BY ts) AS s FROM g),
f AS (SELECT protocol, lo, hi, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms, count(*) AS packets, CAST(sum(length) AS BIGINT) AS bytes, max(ts) AS last FROM n GROUP BY protocol, lo, hi, s)
SELECT protocol, lo, hi, first_ms, last_ms, packets, bytes FROM f WHERE epoch_us(last) + {IDLE} * 1000000::BIGINT <= (SELECT (max(ts_ms) - 600000) * 1000 FROM packets)"""

TRAIN_DAYS = 10


def _captured(packets: DataFrame) -> DataFrame:
    return packets.withColumn("capture_id", F.date_format("ts", "yyyy-MM-dd"))


def stream_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drift at every hour that is closed, a day being a capture and the first ten training."""
    folder = _scratch(spark)
    packets = _captured(packets_from_events(table(spark, sf_dir, "events")))
    first = F.date_add(F.lit(packets.agg(F.min("ts")).first()[0]).cast("date"), TRAIN_DAYS).cast("string")
    steps = live.training_steps(epoch_windows(packets.where(F.col("capture_id") < first), HOUR, "capture_id"))
    stream = live.stream_windows(_captured(_replayed(spark, sf_dir, folder)), HOUR, by="capture_id")
    with live.rocksdb(spark):
        return live.run_to_end(live.stream_drift(stream.where(F.col("capture_id") >= first), steps), f"{folder}/out", f"{folder}/state")


QUERIES["stream_drift"] = stream_drift
ORACLE_SQL["stream_drift"] = _with(PACKETS) + f""",
p AS (SELECT *, strftime(ts, '%Y-%m-%d') AS cap FROM packets),
w AS (SELECT cap, ts_ms // ({HOUR} * 1000) * ({HOUR} * 1000) AS start_ms, count(*) AS packets, sum(length) AS bytes, count(*) FILTER ({_SYN}) AS syn, count(DISTINCT CASE WHEN dst_port > 0 THEN dst_port END) AS dports FROM p GROUP BY 1, 2),
d AS (SELECT cap, start_ms, unnest([{{'o': 0, 'dimension': 'packets', 'v': packets::DOUBLE}}, {{'o': 1, 'dimension': 'bytes', 'v': bytes::DOUBLE}}, {{'o': 2, 'dimension': 'syn', 'v': syn::DOUBLE}}, {{'o': 3, 'dimension': 'dports', 'v': dports::DOUBLE}}], recursive := true) FROM w),
split AS (SELECT strftime(CAST(min(ts) AS DATE) + INTERVAL {TRAIN_DAYS} DAY, '%Y-%m-%d') AS first FROM packets),
t AS (SELECT dimension, v FROM d, split WHERE cap < first), n AS (SELECT dimension, count(*) AS n1 FROM t GROUP BY 1),
o AS (SELECT d.*, row_number() OVER (PARTITION BY cap, dimension ORDER BY start_ms) AS i FROM d, split WHERE cap >= first),
r AS (SELECT a.cap, a.start_ms, a.o, a.dimension, b.v FROM o a JOIN o b ON a.cap = b.cap AND a.dimension = b.dimension AND b.i BETWEEN a.i - 9 AND a.i),
m AS (SELECT cap, start_ms, dimension, count(*) AS n2 FROM r GROUP BY ALL),
x AS (SELECT DISTINCT cap, start_ms, o, dimension, v FROM (SELECT cap, start_ms, o, dimension, v FROM r UNION ALL SELECT r.cap, r.start_ms, r.o, r.dimension, t.v FROM (SELECT DISTINCT cap, start_ms, o, dimension FROM r) r JOIN (SELECT DISTINCT dimension, v FROM t) t USING (dimension))),
ct AS (SELECT x.*, (SELECT count(*) FROM t WHERE t.dimension = x.dimension AND t.v <= x.v) AS cx, (SELECT count(*) FROM r WHERE r.cap = x.cap AND r.start_ms = x.start_ms AND r.dimension = x.dimension AND r.v <= x.v) AS cy FROM x),
ks AS (SELECT ct.cap, ct.start_ms, ct.o, ct.dimension, CAST(max(abs(cx * n2 - cy * n1)) AS BIGINT) AS numerator, any_value(n1) AS n1, any_value(n2) AS n2 FROM ct JOIN n USING (dimension) JOIN m ON m.cap = ct.cap AND m.start_ms = ct.start_ms AND m.dimension = ct.dimension GROUP BY 1, 2, 3, 4)
SELECT cap AS capture_id, start_ms, dimension, numerator, n1, n2, numerator::DOUBLE / (n1 * n2) > 1.36 * sqrt((n1 + n2)::DOUBLE / (n1 * n2)) AS detected
FROM (SELECT *, row_number() OVER (PARTITION BY cap, start_ms ORDER BY numerator DESC, o) AS k FROM ks) WHERE k = 1 AND n2 >= 5 AND start_ms + {HOUR} * 1000 <= (SELECT max(ts_ms) - 600000 FROM packets)"""


def stream_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running counters by source at the end of a replayed stream."""
    folder = _scratch(spark)
    stream = live.stream_counters(_replayed(spark, sf_dir, folder), "src_ip")

    def keep(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{folder}/out/batch={batch}")

    stream.writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    every = spark.read.schema(stream.schema.add("batch", "long")).parquet(f"{folder}/out")
    return every.where(F.col("batch") == every.agg(F.max("batch")).first()[0]).drop("batch")


QUERIES["stream_counters"] = stream_counters
ORACLE_SQL["stream_counters"] = _with(PACKETS) + f"SELECT src_ip, count(*) AS packets, CAST(sum(length) AS BIGINT) AS bytes, count(*) FILTER ({_SYN}) AS syn FROM packets GROUP BY 1"
