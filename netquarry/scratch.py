"""Tables written on the way, in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Where it is unset, a local session uses a folder of its own (driver and executors are one
    machine); on a cluster that is an error, for executors would not see each other's files.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "/tmp/checkpoints/netquarry"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialize(df: DataFrame, label: str, codec: str | None = None) -> DataFrame:
    """Cut lineage by a written table in the shared folder; lost executors can't lose it. ``codec``: for tables that hold whole texts."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing reads any more (others are left alone)."""
    for table in tables:
        path = vars(table).get("written_at")
        if path:
            jvm = table.sparkSession._jvm
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def if_small(table: DataFrame, most: int = 100_000) -> DataFrame:
    """``table``, to be broadcast where it has ``most`` rows at most (narrow ones, counted here); else joined as it is."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table
