"""Running sums and numbers over a whole order, without one task that holds it.

Rows are dealt to ranges of the order, summed inside each, and each range starts from what the
ranges before it sum to: one row per range and group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialize


def running_sums(rows: DataFrame, by: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """``rows`` with, for every entry of ``sums``, its sum over the rows of the group up to this one, itself included.
    ``by`` must not be null; the order within a group should be total (rows that tie are taken in any order)."""
    own = {f"__v_{name}": value for name, value in sums.items()}
    ranged = rows.withColumns(own).repartitionByRange(*by, *order).withColumn("__dealt_to", F.spark_partition_id())
    ranged = materialize(ranged, "ranges")
    upto = Window.partitionBy("__dealt_to", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = ranged.withColumns({name: F.sum(f"__v_{name}").over(upto) for name in sums})
    totals = ranged.groupBy("__dealt_to", *by).agg(*[F.sum(v).alias(v) for v in own])
    before = Window.partitionBy(*by).orderBy("__dealt_to").rowsBetween(Window.unboundedPreceding, -1)  # a row per range that the group reaches into
    starts = totals.select(F.col("__dealt_to").alias("__at"), *[F.col(c).alias(f"__{c}") for c in by], *[F.coalesce(F.sum(f"__v_{name}").over(before), F.lit(0)).alias(f"__s_{name}") for name in sums])
    same = F.col("__dealt_to") == F.col("__at")
    for c in by:
        same = same & (F.col(c) == F.col(f"__{c}"))
    return inside.join(starts, same).select(*[F.col(f"`{c}`") for c in rows.columns], *[(F.col(name) + F.col(f"__s_{name}")).alias(name) for name in sums])


def numbered(rows: DataFrame, by: list[str], order: list[str], name: str = "number") -> DataFrame:
    """``rows`` with their place in the group, from 0."""
    return running_sums(rows, by, order, {name: F.lit(1).cast("long")}).withColumn(name, F.col(name) - 1)
