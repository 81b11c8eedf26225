"""Packet views over tables that are not captures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packets_from_events(events: DataFrame) -> DataFrame:
    """Events as packets: the event's number is its order of arrival, its user and property the end points."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    quic = (F.col("event_type") == "purchase") & (F.col("k") % 2 == 0)
    rows = events.withColumns({"k": k, "rev": F.col("event_id") % 3 == 0}).withColumns({
        "a_ip": F.concat(F.lit("10.0.0."), (F.col("user_id") % 16).cast("string")), "a_port": (40000 + F.col("user_id") % 5).cast("int"),
        "b_ip": F.concat(F.lit("10.0.1."), (F.col("k") % 8).cast("string")), "b_port": F.when(quic, 443).otherwise(1000 + F.col("k") % 20).cast("int"),
        "length": (60 + F.floor(F.col("value") * 10)).cast("long"),
    })
    side = lambda a, b: F.when(F.col("rev"), F.col(b)).otherwise(F.col(a))
    kind = F.col("event_type")
    return rows.select(
        F.lit("events").alias("capture_id"), F.col("event_id").alias("pkt_seq"), "ts", F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"),
        F.when(kind == "signup", "DNS").when(kind == "purchase", "UDP").otherwise("TCP").alias("protocol"),
        side("a_ip", "b_ip").alias("src_ip"), side("a_port", "b_port").alias("src_port"), side("b_ip", "a_ip").alias("dst_ip"), side("b_port", "a_port").alias("dst_port"),
        "length", F.greatest(F.col("length") - 54, F.lit(0)).alias("payload_size"),
        F.when(kind == "click", "SYN").when((kind == "view") & (F.col("k") % 4 == 0), "SYN,ACK").when(kind == "view", "ACK,PSH").when(kind == "error", "ACK,RST").otherwise("").alias("flags"),
        F.when(kind == "signup", F.concat(F.expr("repeat('a', k % 50)"), F.lit(".example.com"))).otherwise("").alias("dns_query"),
        F.when((kind == "signup") & F.col("rev"), "10.0.0.1").otherwise("").alias("dns_response"),
        F.when(quic, F.concat(F.lit("UDP QUIC Version=0x"), F.when(F.col("k") % 6 == 0, "00000001").when(F.col("k") % 6 == 2, "ff00001d").otherwise("deadbeef"))).otherwise("").alias("raw_summary"),
    )


def packets_from_lineitem(lineitem: DataFrame, hosts: int = 20) -> DataFrame:
    """Line items as packets, for volume: no order of arrival, so only order-free operators apply."""
    forward = F.col("l_returnflag") != "R"
    a = F.concat(F.lit("10.1.0."), (F.col("l_suppkey") % hosts).cast("string"))
    b = F.concat(F.lit("10.1.0."), (F.col("l_partkey") % hosts).cast("string"))
    length = F.floor("l_extendedprice").cast("long")
    return lineitem.select(
        F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("ts_ms"),
        F.when(F.col("l_linenumber") % 4 == 0, "UDP").otherwise("TCP").alias("protocol"),
        F.when(forward, a).otherwise(b).alias("src_ip"), F.when(forward, 41000).otherwise(80).alias("src_port"),
        F.when(forward, b).otherwise(a).alias("dst_ip"), F.when(forward, 80).otherwise(41000).alias("dst_port"),
        length.alias("length"), F.greatest(length - 54, F.lit(0)).alias("payload_size"), F.lit("").alias("flags"),
    )
