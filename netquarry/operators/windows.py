"""Fixed windows anchored at the first packet to arrive.

``window_index`` numbers the windows that hold packets; empty ones don't exist. Packets that
arrive first but carry a later time give earlier ones negative buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import if_small, materialize
from .flows import initiator_syn
from .ordered import numbered, running_sums


def bucketed(packets: DataFrame, window_sec: int, by: str | None = None) -> DataFrame:
    """``packets`` with ``bucket``, the number of their window from the capture's first packet to arrive."""
    keys = [by] if by else []
    anchor = packets.groupBy(*keys).agg(F.min_by("ts_ms", "pkt_seq").alias("t0"))
    rows = packets.join(if_small(materialize(anchor, "anchors")), by) if by else packets.crossJoin(F.broadcast(anchor))  # one row
    return rows.withColumn("bucket", F.floor((F.col("ts_ms") - F.col("t0")) / (window_sec * 1000))).drop("t0")


def windows(packets: DataFrame, window_sec: int, by: str | None = None) -> DataFrame:
    """window_index, bucket, packets, bytes, syn, dports; ``by`` keeps captures apart.

    Two aggregations: (bucket, port) first, so distinct ports need no set, then the bucket.
    """
    keys = [by] if by else []
    rows = bucketed(packets, window_sec, by)
    port = F.when(F.col("dst_port") > 0, F.col("dst_port"))
    fine = rows.groupBy(*keys, "bucket", port.alias("port")).agg(
        F.count(F.lit(1)).alias("packets"), F.sum("length").alias("bytes"), F.count_if(initiator_syn()).alias("syn")
    )
    found = fine.groupBy(*keys, "bucket").agg(F.sum("packets").alias("packets"), F.sum("bytes").alias("bytes"), F.sum("syn").alias("syn"), F.count("port").alias("dports"))
    order = Window.partitionBy(*keys).orderBy("bucket")
    return found.withColumn("window_index", F.row_number().over(order).cast("long") - 1)


def timed(packets: DataFrame, by: str) -> DataFrame:
    """``packets`` with ``rel_ms``, the time since the capture's first packet; in a capture where any time is missing, the number of the
    packet in order of arrival stands for seconds."""
    known = packets.groupBy(F.col(by).alias("__by")).agg(F.min_by("ts_ms", "pkt_seq").alias("t0"), F.count_if(F.col("ts_ms").isNull()).alias("missing"))
    rows = packets.join(known, F.col(by) == F.col("__by")).drop("__by")
    whole = rows.where("missing = 0").withColumn("rel_ms", F.col("ts_ms") - F.col("t0"))
    counted = numbered(rows.where("missing > 0"), [by], ["pkt_seq"]).withColumn("rel_ms", F.col("number") * 1000).drop("number")
    return whole.unionByName(counted).drop("t0", "missing")


def untimed_windows(packets: DataFrame, window_sec: int, by: str) -> DataFrame:
    """Windows of every capture by ``timed``: bucket, packets, bytes, syn, dports."""
    bucket = F.floor(F.col("rel_ms") / (window_sec * 1000))
    return timed(packets, by).groupBy(by, bucket.alias("bucket")).agg(
        F.count(F.lit(1)).alias("packets"), F.sum("length").alias("bytes"), F.count_if(initiator_syn()).alias("syn"), F.count_distinct(F.when(F.col("dst_port") > 0, F.col("dst_port"))).alias("dports")
    )


def epoch_windows(packets: DataFrame, window_sec: int, by: str) -> DataFrame:
    """Windows of every capture, aligned to the epoch: window_index is the window's start in milliseconds."""
    start = F.floor(F.col("ts_ms") / (window_sec * 1000)) * (window_sec * 1000)
    return packets.groupBy(by, start.alias("window_index")).agg(
        F.count(F.lit(1)).alias("packets"), F.sum("length").alias("bytes"), F.count_if(initiator_syn()).alias("syn"), F.count_distinct(F.when(F.col("dst_port") > 0, F.col("dst_port"))).alias("dports")
    )


def epoch_slices(packets: DataFrame, window_sec: int) -> DataFrame:
    """Windows aligned to the epoch."""
    bucket = F.floor(F.col("ts_ms") / (window_sec * 1000))
    return packets.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("packets"), F.sum("length").alias("bytes"), F.count_if(initiator_syn()).alias("syn"))


def prefix_cumulative(packets: DataFrame, window_sec: int, by: str = "capture_id") -> DataFrame:
    """State of every capture up to and with every window: running sums, and sources counted at their first window. Running sums go
    over ranges of windows, so no task holds a capture."""
    found = windows(packets, window_sec, by)
    anchor = packets.groupBy(F.col(by).alias("__by")).agg(F.min_by("ts_ms", "pkt_seq").alias("t0"))
    known = packets.join(anchor, F.col(by) == F.col("__by"))
    firsts = known.groupBy(by, "src_ip").agg(F.min(F.floor((F.col("ts_ms") - F.col("t0")) / (window_sec * 1000))).alias("bucket"))
    fresh = firsts.groupBy(by, "bucket").agg(F.count(F.lit(1)).alias("fresh"))
    rows = found.join(fresh, [by, "bucket"], "left")
    sums = {f"cum_{c}": F.col(c) for c in ("packets", "bytes", "syn")} | {"cum_sources": F.coalesce("fresh", F.lit(0))}
    return running_sums(rows, [by], ["bucket"], sums).select(by, "window_index", *sums)


def by_dimension(found: DataFrame, *keep: str) -> DataFrame:
    """One row per window and dimension, value as double."""
    from ..schemas import DIMENSIONS

    every = F.array(*[F.struct(F.lit(i).alias("dim_ord"), F.lit(d).alias("dimension"), F.col(d).cast("double").alias("value")) for i, d in enumerate(DIMENSIONS)])
    return found.select(*keep, "window_index", F.explode(every).alias("x")).select(*keep, "window_index", "x.*")
