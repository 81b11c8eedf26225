"""Evaluation: confusion counts and rates, windows against truth, samples and mixtures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion(rows: DataFrame, truth: Column, predicted: Column, *by: str) -> DataFrame:
    """tp, fp, fn, tn and their rates to 4 places; a rate over nothing is 0."""
    counts = rows.groupBy(*by).agg(
        F.count_if(truth & predicted).alias("tp"), F.count_if(~truth & predicted).alias("fp"), F.count_if(truth & ~predicted).alias("fn"), F.count_if(~truth & ~predicted).alias("tn")
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    rate = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 4)
    return counts.select(*by, "tp", "fp", "fn", "tn", rate(tp, tp + fp).alias("precision"), rate(tp, tp + fn).alias("recall"), rate(2 * tp, 2 * tp + fp + fn).alias("f1"), rate(tp + tn, tp + fp + fn + tn).alias("accuracy"))


def calendar(found: DataFrame, bucket: str = "bucket") -> DataFrame:
    """Every bucket from the first to the last, empty ones too."""
    ends = found.agg(F.min(bucket).alias("a"), F.max(bucket).alias("b"))
    return ends.where("a is not null").select(F.explode(F.sequence("a", "b")).alias(bucket))


def window_evaluation(found: DataFrame, flagged: DataFrame, truth: DataFrame) -> DataFrame:
    """Window-level confusion over the whole calendar (all by bucket)."""
    rows = calendar(found).join(flagged.select("bucket", F.lit(True).alias("p")).distinct(), "bucket", "left").join(truth.select("bucket", F.lit(True).alias("t")).distinct(), "bucket", "left")
    return confusion(rows, F.coalesce("t", F.lit(False)), F.coalesce("p", F.lit(False)))


def set_comparison(predicted: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    """Sizes of the intersection and of both differences of two key sets."""
    both = predicted.select(key, F.lit(1).alias("p")).distinct().join(truth.select(key, F.lit(1).alias("t")).distinct(), key, "full")
    return both.agg(F.count_if(F.col("p").isNotNull() & F.col("t").isNotNull()).alias("both"), F.count_if(F.col("t").isNull()).alias("only_predicted"), F.count_if(F.col("p").isNull()).alias("only_truth"))


def mixed_sample(base: DataFrame, attack: DataFrame, offset_ms: int) -> DataFrame:
    """An attack's packets moved to begin ``offset_ms`` after the base ends."""
    end = base.agg(F.max("ts_ms").alias("__end"))
    start = attack.agg(F.min("ts_ms").alias("__start"))
    moved = attack.crossJoin(F.broadcast(end)).crossJoin(F.broadcast(start))  # one row each
    moved = moved.withColumn("ts_ms", F.col("ts_ms") - F.col("__start") + F.col("__end") + offset_ms).drop("__end", "__start")
    return base.withColumn("part", F.lit("base")).unionByName(moved.withColumn("part", F.lit("attack")))


def injected(packets: DataFrame, captures: Column, model: Column, start_ms: Column, attacker: str = "10.9.9.9", target: str = "10.9.0.1", ports: int = 997, span_sec: int = 3600) -> DataFrame:
    """``packets`` with a scan put into ``captures``, so that truth doesn't come from what a detector reads: for each packet that ``model``
    picks, a SYN of ``attacker`` to another port of ``target`` within ``span_sec`` from ``start_ms`` on. They arrive after all others; ``injected`` marks them."""
    moved = {
        "pkt_seq": F.col("pkt_seq") + 1_000_000_000_000, "ts_ms": start_ms + F.col("pkt_seq") % span_sec * 1000, "protocol": F.lit("TCP"), "src_ip": F.lit(attacker), "src_port": F.lit(41000), "dst_ip": F.lit(target),
        "dst_port": (1 + F.col("pkt_seq") % ports).cast("int"), "length": F.lit(60).cast("long"), "payload_size": F.lit(6).cast("long"), "flags": F.lit("SYN"), "dns_query": F.lit(""), "dns_response": F.lit(""), "raw_summary": F.lit(""),
    }
    scan = packets.where(captures & model).select(*[moved.get(c, F.col(c)).alias(c) for c in packets.columns])
    return packets.withColumn("injected", F.lit(False)).unionByName(scan.withColumn("injected", F.lit(True)))


def two_hops(courses: DataFrame, relations: DataFrame, patterns: DataFrame) -> DataFrame:
    """What mitigates each pattern: pattern <- relation <- course, names joined in order."""
    joined = relations.join(courses, relations["source"] == courses["course_id"]).join(patterns, relations["target"] == patterns["pattern_id"])
    return joined.groupBy("pattern").agg(F.array_join(F.array_sort(F.collect_set("course")), ",").alias("courses"), F.count_distinct("course").alias("n"))
