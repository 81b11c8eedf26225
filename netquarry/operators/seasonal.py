"""Seasonal decomposition of a window series by moving averages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def decompose(series: DataFrame, period: int, trend_window: int = 5, by: str | None = None) -> DataFrame:
    """idx, value -> trend (centred average, cut at the ends), seasonal (mean by idx modulo period), residual; ``by`` keeps captures apart.

    The trend comes from a window within stretches of 4096 places, each given its neighbours' edges, so no task holds a series.
    """
    keys = [by] if by else []
    period, half = max(2, period), max(3, trend_window) // 2
    size = 4096
    at = F.floor(F.col("idx") / size)
    # a row also goes to the stretch before or after whose edge averages it
    stretch = F.array_distinct(F.array(at, F.floor((F.col("idx") - half) / size), F.floor((F.col("idx") + half) / size)))
    rows = series.select(*keys, "idx", "value", F.explode(stretch).alias("stretch"))
    around = Window.partitionBy(*keys, "stretch").orderBy("idx").rowsBetween(-half, half)
    rows = rows.withColumn("trend", F.avg("value").over(around)).where(F.col("stretch") == at)
    rows = rows.withColumn("flat", F.col("value") - F.col("trend"))
    phase = rows.groupBy(*keys, (F.col("idx") % period).alias("phase")).agg(F.avg("flat").alias("seasonal"))
    rows = rows.withColumn("phase", F.col("idx") % period).join(phase, [*keys, "phase"])
    return rows.select(*keys, "idx", "value", "trend", "seasonal", (F.col("flat") - F.col("seasonal")).alias("residual"))


def anomalies(parts: DataFrame, sigma: float = 3.0) -> DataFrame:
    """Residuals more than sigma deviations from their mean (a deviation of 0 counts as 1)."""
    stats = parts.agg(F.avg("residual").alias("m"), F.stddev_pop("residual").alias("s")).withColumn("s", F.when(F.col("s") > 0, F.col("s")).otherwise(1.0))
    off = F.col("residual") - F.col("m")
    z = F.abs(off) / F.col("s")
    return parts.crossJoin(F.broadcast(stats)).where(F.abs(off) > sigma * F.col("s")).select(
        "idx", "value", F.when(off > 0, "high").otherwise("low").alias("direction"), F.when(z > 5, "CRITICAL").when(z > 4, "HIGH").otherwise("MEDIUM").alias("severity")
    )


def statistics(parts: DataFrame) -> DataFrame:
    """Shares of the variance in trend, season and residual, the season's amplitude, the trend's slope."""
    total = F.var_pop("value")
    share = lambda c: F.when(total > 0, F.var_pop(c) / total).otherwise(0.0)
    return parts.agg(
        F.count(F.lit(1)).alias("n"), *[share(c).alias(f"{c}_explained") for c in ("trend", "seasonal", "residual")],
        (F.max("seasonal") - F.min("seasonal")).alias("amplitude"), ((F.max_by("trend", "idx") - F.min_by("trend", "idx")) / F.count(F.lit(1))).alias("slope"),
    )


def auto_period(n: int) -> int:
    return max(6, min(48, n // 4))


def seasonal_alerts(series: DataFrame, period: int, sigma: float = 3.0, by: str | None = None) -> DataFrame:
    """Alerts of a window series: window_index, value, z (2 places), direction, severity and ``method``.

    Residuals of the decomposition, or plain deviations from the mean where a capture has fewer than two periods.
    """
    keys = [by] if by else []
    sizes = series.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.avg("value").alias("__mean"))
    parts = decompose(series, period, by=by)
    known = parts.join(sizes, keys) if by else parts.crossJoin(F.broadcast(sizes))  # one row
    plain = F.col("__n") < 2 * max(2, period)
    known = known.withColumns({"__x": F.when(plain, F.col("value") - F.col("__mean")).otherwise(F.col("residual")), "method": F.when(plain, "zscore_fallback").otherwise("moving_average")})
    stats = known.groupBy(*keys).agg(F.avg("__x").alias("__m"), F.stddev_pop("__x").alias("__s"))
    scored = known.join(stats, keys) if by else known.crossJoin(F.broadcast(stats))  # one row
    off = F.col("__x") - F.col("__m")
    z = F.abs(off) / F.when(F.col("__s") > 0, F.col("__s")).otherwise(1.0)
    return scored.where(z > sigma).select(
        *keys, F.lit("SEASONAL_ANOMALY").alias("type"), F.col("idx").alias("window_index"), "value", F.round(z, 2).alias("z"), F.when(off > 0, "high").otherwise("low").alias("direction"),
        F.when(z > 5, "CRITICAL").when(z > 4, "HIGH").otherwise("MEDIUM").alias("severity"), "method",
    )


def auto_seasonal(series: DataFrame, sigma: float = 3.0, by: str | None = None) -> DataFrame:
    """Anomalies with a period from the longest capture's length (captures of one length have one period)."""
    keys = [by] if by else []
    longest = series.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    return anomalies_by(decompose(series, auto_period(longest), by=by), sigma, by)


def anomalies_by(parts: DataFrame, sigma: float, by: str | None) -> DataFrame:
    """``anomalies`` of every capture by its own residuals."""
    if not by:
        return anomalies(parts, sigma)
    stats = parts.groupBy(by).agg(F.avg("residual").alias("m"), F.stddev_pop("residual").alias("s")).withColumn("s", F.when(F.col("s") > 0, F.col("s")).otherwise(1.0))
    off = F.col("residual") - F.col("m")
    return parts.join(stats, by).where(F.abs(off) > sigma * F.col("s")).select(by, "idx", "value", F.when(off > 0, "high").otherwise("low").alias("direction"))
