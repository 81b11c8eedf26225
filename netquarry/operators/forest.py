"""Isolation forest: trees from small hashed samples, scores by column of arrays inside tasks.

Trees are trained from at most ``samples`` rows each (a documented bound of the method), so
the sample reaches the driver and the model is small; scoring is independent by row.

Every choice (the rows of a tree, the feature and cut of a node) is a hash of the seed, the tree
and the node's number, so the forest is a function of the rows alone and SQL can grow it too.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ForestSettings:
    trees: int = 100
    samples: int = 256
    contamination: float = 0.10
    seed: int = 42


def _average_path(n: int) -> float:
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def _draw(seed: int, tree: int, what: str, at: int) -> int:
    """48 even bits for a choice."""
    return int(hashlib.md5(f"{seed}:{tree}:{what}:{at}".encode(), usedforsecurity=False).hexdigest()[:12], 16)


def _grow(x: np.ndarray, seed: int, tree: int, limit: int) -> list[tuple]:
    """Nodes as (feature, cut, left, right, path length); feature -1 is a leaf. A node's number is 1 at the root, then twice its parent's, or one more."""
    nodes: list = []

    def add(rows: np.ndarray, depth: int, number: int) -> int:
        at = len(nodes)
        nodes.append(None)
        low, high = (x[rows].min(axis=0), x[rows].max(axis=0)) if len(rows) else (np.zeros(0), np.zeros(0))
        spread = np.flatnonzero(low < high)
        if depth >= limit or not len(spread):
            nodes[at] = (-1, 0.0, -1, -1, depth + _average_path(len(rows)))
            return at
        f = int(spread[_draw(seed, tree, "feature", number) % len(spread)])
        cut = float(low[f] + (high[f] - low[f]) * ((_draw(seed, tree, "cut", number) + 0.5) / 2**48))
        left = x[rows, f] < cut
        nodes[at] = (f, cut, add(rows[left], depth + 1, 2 * number), add(rows[~left], depth + 1, 2 * number + 1), 0.0)
        return at

    add(np.arange(len(x)), 0, 1)
    return nodes


def fit(rows: DataFrame, columns: list[str], settings: ForestSettings | None = None) -> tuple[list, int]:
    """Trees from a sample of the rows with the smallest hashes (trees x samples at most reach the driver, 8 sets). Hashes are of the columns as text."""
    settings = settings or ForestSettings()
    own = [F.col(c).cast("double") for c in columns]
    order = F.md5(F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns], F.lit(str(settings.seed))))
    pool = rows.select(order.alias("__order"), *own).orderBy("__order", *columns).limit(settings.samples * 8).drop("__order").toPandas().to_numpy(float)
    n = min(settings.samples, len(pool))
    limit = int(np.ceil(np.log2(max(n, 2))))
    trees = []
    for t in range(settings.trees if n else 0):
        places = sorted(range(len(pool)), key=lambda i: (_draw(settings.seed, t, "row", i), i))[:n]
        trees.append(_grow(pool[places], settings.seed, t, limit))
    return trees, n


def scored(rows: DataFrame, columns: list[str], model: tuple[list, int]) -> DataFrame:
    """``rows`` with ``score``: 0.5 less the anomaly score, so lower is stranger; to nine places, so that it doesn't hang on the order of a sum."""
    trees, n = model
    packed = [tuple(np.array(z) for z in zip(*t)) for t in trees]
    unit = _average_path(n) or 1.0

    @F.pandas_udf("double")
    def score(*cols: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(float) for c in cols])
        total = np.zeros(len(x))
        for feature, cut, left, right, length in packed:
            at = np.zeros(len(x), int)
            while (inner := feature[at] >= 0).any():
                f = np.where(inner, feature[at], 0)
                goes = x[np.arange(len(x)), f] < cut[at]
                at = np.where(inner, np.where(goes, left[at], right[at]), at)
            total += length[at]
        return pd.Series(np.round(0.5 - 2.0 ** (-(total / max(len(packed), 1)) / unit), 9))

    return rows.withColumn("score", score(*[F.col(c).cast("double") for c in columns]))


def _at_place(rows: DataFrame, column: str, place: int) -> float:
    """The value at a place (from 0) of the sorted column: from counts of values, so no task sorts or holds all rows."""
    counts = rows.groupBy(F.col(column).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    low = high = None
    while True:
        part = counts if low is None else counts.where((F.col("v") >= low) & (F.col("v") <= high))
        ends = part.agg(F.min("v"), F.max("v"), F.count(F.lit(1))).first()
        if ends[2] <= 4096 or ends[0] == ends[1]:
            for r in sorted(part.collect()):
                if place < r.n:
                    return r.v
                place -= r.n
        step = (ends[1] - ends[0]) / 256
        binned = part.groupBy(F.least(F.floor((F.col("v") - ends[0]) / step), F.lit(255)).alias("b")).agg(F.sum("n").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        for r in sorted(binned.collect(), key=lambda r: r.b):  # 256 rows
            if place < r.n:
                low, high = r.low, r.high
                break
            place -= r.n


def threshold(train: DataFrame, contamination: float) -> float:
    """Score at place ``int(n * contamination) - 1`` (0 at least) of the sorted training scores."""
    return _at_place(train, "score", max(0, int(train.count() * contamination) - 1))


def top_dimension(columns: list[str], medians: DataFrame, rows: DataFrame, *keep: str) -> DataFrame:
    """The dimension farthest from its (upper) median in proportion, the first of equals, how far, and the side it lies on."""
    joined = rows.crossJoin(F.broadcast(medians))  # one row

    def ratio(c: str) -> Column:
        x, m = F.col(c).cast("double"), F.col(f"m_{c}")
        return F.when(m != 0, F.abs((x - m) / m)).when(x > 0, x).otherwise(0.0)

    def side_of(c: str) -> Column:
        m = F.col(f"m_{c}")
        return F.when(F.when(m > 0, F.col(c) >= m).otherwise(F.col(c) > 0), "high").otherwise("low")

    best = F.greatest(*[F.struct(ratio(c).alias("r"), F.lit(-i).alias("o")) for i, c in enumerate(columns)])
    name, side = F.lit(columns[0]), side_of(columns[0])
    for i, c in enumerate(columns[1:], 1):
        name = F.when(best["o"] == -i, c).otherwise(name)
        side = F.when(best["o"] == -i, side_of(c)).otherwise(side)
    return joined.select(*keep, "window_index", name.alias("dimension"), best["r"].alias("ratio"), side.alias("direction"))


def upper_medians(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Element n // 2 of the sorted values of each column; no row where there are none."""
    n = rows.count()
    spark = rows.sparkSession
    schema = ", ".join(f"m_{c} double" for c in columns)
    return spark.createDataFrame([tuple(_at_place(rows, c, n // 2) for c in columns)] if n else [], schema)
