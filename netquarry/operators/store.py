"""Stored baselines: profiles by name, with the windows they were learnt from, so that drift works after a reload."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PROFILES = "name string, updated_ms long, save_id string, dimension string, median double, mad double, raw_mad double, samples long"
TRAINING = "name string, updated_ms long, save_id string, window_index long, packets long, bytes long, syn long, dports long"
_ONLY_TRAINING = ", window_index long, packets long, bytes long, syn long, dports long"


def save(profile: DataFrame, training: DataFrame, name: str, updated_ms: int, path: str) -> None:
    """Append a profile and its training windows as JSON lines, in one write under one id: a reader finds both or neither."""
    save_id = uuid.uuid4().hex
    parts = [rows.select(F.lit(part).alias("part"), F.lit(name).alias("name"), F.lit(updated_ms).cast("long").alias("updated_ms"), F.lit(save_id).alias("save_id"), *[c.split()[0] for c in schema.split(", ")[3:]]) for rows, part, schema in ((profile, "profile", PROFILES), (training, "training", TRAINING))]
    parts[0].unionByName(parts[1], allowMissingColumns=True).write.mode("append").json(f"{path}/saves")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(profiles, training windows) of a store, the latest save of every name (of one millisecond, one of them). A name counts as learnt if it has a profile."""
    rows = spark.read.schema("part string, " + PROFILES + _ONLY_TRAINING).json(f"{path}/saves")
    newest = rows.groupBy("name").agg(F.max(F.struct("updated_ms", "save_id")).alias("last")).select("name", "last.updated_ms", "last.save_id")
    latest = rows.join(newest, ["name", "updated_ms", "save_id"], "left_semi")
    return tuple(latest.where(F.col("part") == part).select(*[c.split()[0] for c in schema.split(", ") if not c.startswith("save_id")]) for part, schema in (("profile", PROFILES), ("training", TRAINING)))


def with_fallback(first: DataFrame, second: DataFrame) -> DataFrame:
    """Profiles of the first store, and those of the second whose names the first doesn't have; ``source`` tells which."""
    rest = second.join(first.select("name").distinct(), "name", "left_anti")
    return first.withColumn("source", F.lit("first")).unionByName(rest.withColumn("source", F.lit("second")))


def listed(profiles: DataFrame) -> DataFrame:
    """Names with their dimensions and samples, the latest first: place, name, updated_ms, dimensions, samples."""
    rows = profiles.groupBy("name").agg(F.max("updated_ms").alias("updated_ms"), F.count(F.lit(1)).alias("dimensions"), F.max("samples").alias("samples"))
    return rows.orderBy(F.desc("updated_ms"), "name")


def united(sources: dict[str, DataFrame]) -> DataFrame:
    """Knowledge items (title, content) of several sources, each with its category; the first of equal titles and contents stays."""
    every = None
    for place, (category, items) in enumerate(sources.items()):
        own = items.select("title", "content", F.lit(category).alias("category"), F.lit(place).alias("__place"))
        every = own if every is None else every.unionByName(own)
    order = Window.partitionBy("title", "content").orderBy("__place")
    return every.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r", "__place")
