"""Windows against labelled intervals, met by bucket of time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def islands(intervals: DataFrame, by: str) -> DataFrame:
    """Intervals [start_ms, end_ms) of every capture put together where they overlap or touch; empty ones are left out."""
    rows = intervals.where("start_ms < end_ms").select(by, "start_ms", "end_ms")
    before = Window.partitionBy(by).orderBy("start_ms", "end_ms").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(by).orderBy("start_ms", "end_ms").rowsBetween(Window.unboundedPreceding, 0)
    reach = F.max("end_ms").over(before)
    numbered = rows.withColumn("fresh", (reach.isNull() | (F.col("start_ms") > reach)).cast("int")).withColumn("island", F.sum("fresh").over(upto))
    return numbered.groupBy(by, "island").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")).drop("island")


def window_labels(found: DataFrame, intervals: DataFrame, by: str, bucket_ms: int) -> DataFrame:
    """``found`` (windows with ``by``, start_ms, end_ms) with ``label``: 1 inside the intervals, 0 outside, null where a window lies across a border.

    Both sides are cut at multiples of ``bucket_ms`` and meet by capture and bucket, as an equi-join; a bucket of about a window's
    length keeps both short. How much of a window its pieces cover is summed, so a window over several buckets or islands is one row.
    """
    def pieces(rows: DataFrame, start: str, end: str) -> DataFrame:
        bucket = F.explode(F.sequence(F.floor(F.col(start) / bucket_ms), F.floor((F.col(end) - 1) / bucket_ms)))
        return rows.withColumn("bucket", bucket).withColumns({start: F.greatest(start, F.col("bucket") * bucket_ms), end: F.least(end, (F.col("bucket") + 1) * bucket_ms)})

    keys = found.select(by, "start_ms", "end_ms").where("start_ms < end_ms").distinct()
    ours = pieces(keys.select(by, F.col("start_ms").alias("w_start"), F.col("end_ms").alias("w_end"), F.col("start_ms").alias("a"), F.col("end_ms").alias("b")), "a", "b")
    theirs = pieces(islands(intervals, by).withColumnRenamed(by, "__by"), "start_ms", "end_ms").withColumnRenamed("bucket", "__bucket")
    met = ours.join(theirs, (F.col(by) == F.col("__by")) & (F.col("bucket") == F.col("__bucket")) & (F.col("a") < F.col("end_ms")) & (F.col("start_ms") < F.col("b")))
    covered = met.groupBy(F.col(by).alias("__by"), F.col("w_start").alias("__start"), F.col("w_end").alias("__end")).agg(F.sum(F.least("b", "end_ms") - F.greatest("a", "start_ms")).alias("covered"))
    same = F.col(by).eqNullSafe(F.col("__by")) & (F.col("start_ms") == F.col("__start")) & (F.col("end_ms") == F.col("__end"))
    whole = F.col("end_ms") - F.col("start_ms")
    label = F.when(F.col("covered").isNull(), 0).when(F.col("covered") == whole, 1)
    return found.join(covered, same, "left").withColumn("label", label).drop("__by", "__start", "__end", "covered")
