"""Robust baselines over windows: medians and absolute deviations, online smoothing, drift."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import DIMENSIONS, MAD_SCALE
from .windows import by_dimension


def spread(rows: DataFrame, key: str = "dimension") -> DataFrame:
    """Exact median and median absolute deviation of ``value`` by key (few keys, few windows)."""
    middle = rows.groupBy(key).agg(F.median("value").alias("median"))
    return rows.join(F.broadcast(middle), key).groupBy(key).agg(
        F.first("median").alias("median"), F.median(F.abs(F.col("value") - F.col("median"))).alias("mad"), F.count(F.lit(1)).alias("samples")
    )


def trimmed(found: DataFrame) -> DataFrame:
    """Windows at or below median + 3 deviations in every dimension (upper side only)."""
    stats = spread(by_dimension(found))
    limits = stats.withColumn("upper", F.when(F.col("mad") > 0, F.col("median") + 3 * F.col("mad") / MAD_SCALE)).select("dimension", "upper")
    over = by_dimension(found).join(F.broadcast(limits), "dimension").where(F.col("value") > F.col("upper")).select("window_index").distinct()
    return found.join(over, "window_index", "left_anti")


def learn(found: DataFrame) -> DataFrame:
    """Profile of the trimmed windows; ``mad`` never falls below the dimension's share of the median or 1."""
    stats = spread(by_dimension(trimmed(found)))
    share = F.lit(None).cast("double")
    for d, s in DIMENSIONS.items():
        share = F.when(F.col("dimension") == d, F.lit(s)).otherwise(share)
    least = F.greatest(F.lit(1.0), F.col("median") * share)
    return stats.select("dimension", "median", F.greatest("mad", least).alias("mad"), F.col("mad").alias("raw_mad"), "samples")


def deviations(found: DataFrame, profile: DataFrame, sigma: float) -> DataFrame:
    """Windows whose value lies more than sigma above the frozen profile (one-sided)."""
    z = (F.col("value") - F.col("median")) * MAD_SCALE / F.col("mad")
    rows = by_dimension(found).join(F.broadcast(profile.select("dimension", "median", "mad")), "dimension").withColumn("z", z)
    return rows.where(F.col("z") > sigma).select(
        "window_index", "dim_ord", "dimension", "value", "median", "mad", "z", F.when(F.col("z") > 2 * sigma, "HIGH").otherwise("MEDIUM").alias("severity")
    )


def multi_dimension(found: DataFrame) -> DataFrame:
    """Windows that deviate in two dimensions or more."""
    keyed = found.groupBy("window_index").agg(F.array_sort(F.collect_list(F.struct("dim_ord", "dimension"))).alias("d"), F.max("z").alias("max_z"))
    n = F.size("d")
    return keyed.where(n >= 2).select(
        "window_index", F.array_join(F.transform("d", lambda x: x["dimension"]), ",").alias("dimensions"), n.cast("long").alias("dimension_count"),
        F.when((n >= 3) | (F.col("max_z") > 6), "CRITICAL").otherwise("HIGH").alias("severity"),
    )


def top_per_dimension(found: DataFrame, k: int = 3) -> DataFrame:
    order = Window.partitionBy("dimension").orderBy(F.desc("z"), "window_index")
    return found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k).select("dimension", "rank", "window_index", "value", "severity")


def smoothed(found: DataFrame, profile: DataFrame, sigma: float, alpha: float, by: str | None = None) -> DataFrame:
    """Online detection: each window is held against the profile, which it moves only if it deviates nowhere: (by, window_index, dimensions,
    calm, and the profile after it). Values are rounded to 4 places at every step.

    A conditional recurrence, so a capture's windows pass in order through one task, which holds a batch of them and eight numbers; captures run side by side.
    """
    dims = list(DIMENSIONS)
    start = {r.dimension: (r["median"], r.mad) for r in profile.collect()}  # a row per dimension
    key = F.col(by).cast("string") if by else F.lit("")
    rows = found.select(key.alias("key"), "window_index", *[F.col(d).cast("double").alias(d) for d in dims]).repartition("key").sortWithinPartitions("key", "window_index")

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, state = None, {}
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if r.key != of:
                    of, state = r.key, dict(start)
                over = [d for d in dims if (getattr(r, d) - state[d][0]) * MAD_SCALE / state[d][1] > sigma]
                if not over:
                    for d in dims:
                        x, (m, a) = getattr(r, d), state[d]
                        middle = alpha * x + (1 - alpha) * m
                        state[d] = _places(middle), _places(max(alpha * abs(x - m) + (1 - alpha) * a, 1.0, middle * DIMENSIONS[d]))
                out.append((r.key, r.window_index, ",".join(over), not over, *(v for d in dims for v in state[d])))
            yield pd.DataFrame(out, columns=["key", "window_index", "dimensions", "calm", *(f"{d}_{v}" for d in dims for v in ("median", "mad"))])

    if len(start) < len(dims):
        rows = rows.limit(0)
    made = rows.mapInPandas(step, "key string, window_index long, dimensions string, calm boolean, " + ", ".join(f"{d}_median double, {d}_mad double" for d in dims))
    return made.withColumnRenamed("key", by) if by else made.drop("key")


def _places(x: float) -> float:
    """To 4 places, halves up."""
    return math.floor(x * 1e4 + 0.5) / 1e4


def smoothed_windows(state: DataFrame) -> DataFrame:
    return state.select("window_index", "dimensions", F.col("calm").cast("long").alias("calm"))


def ks_distance(a: DataFrame, b: DataFrame) -> DataFrame:
    """Largest distance of two empirical distributions by dimension, ties counted at once; as exact counts n1, n2
    and the numerator over n1 * n2."""
    both = a.select("dimension", "value", F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(b.select("dimension", "value", F.lit(0).alias("x"), F.lit(1).alias("y")))
    at = both.groupBy("dimension", "value").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    upto = Window.partitionBy("dimension").orderBy("value")
    whole = Window.partitionBy("dimension")
    rows = at.select("dimension", F.sum("x").over(upto).alias("cx"), F.sum("y").over(upto).alias("cy"), F.sum("x").over(whole).alias("n1"), F.sum("y").over(whole).alias("n2"))
    return rows.groupBy("dimension").agg(F.max(F.abs(F.col("cx") * F.col("n2") - F.col("cy") * F.col("n1"))).alias("numerator"), F.first("n1").alias("n1"), F.first("n2").alias("n2"))


def drift(train: DataFrame, recent: DataFrame, factor: float = 1.36, least: int = 5) -> DataFrame:
    """Dimensions whose recent windows differ in distribution from the training windows."""
    d = ks_distance(by_dimension(train), by_dimension(recent))
    critical = factor * F.sqrt((F.col("n1") + F.col("n2")) / (F.col("n1") * F.col("n2")))
    return d.select("dimension", "numerator", "n1", "n2", (F.col("numerator") / (F.col("n1") * F.col("n2")) > critical).cast("long").alias("detected")).where(F.col("n2") >= least)


def sensitivity(found: DataFrame, profile: DataFrame, sigmas: list[float]) -> DataFrame:
    """Deviations at every sigma, in one pass."""
    rows = deviations(found, profile, min(sigmas)).withColumn("sigma", F.explode(F.array(*[F.lit(float(s)) for s in sigmas])))
    return rows.where(F.col("z") > F.col("sigma")).groupBy("sigma").agg(F.count(F.lit(1)).alias("deviations"), F.count_distinct("window_index").alias("windows"))
