"""Nearest neighbours by few stable projections and a kd-tree, stopped by a chi-square test.

Largest inner product becomes nearest point once every vector gets one more component that
brings all to the largest norm M: the squared distance to a query q is then
``|q|^2 + M^2 - 2 q.x``. A Gaussian (2-stable) projection to ``width`` dimensions turns a
squared distance d into d times a chi-square variable of ``width`` degrees of freedom. A
candidate is verified on the original vectors, in double precision, only while its
projected distance is at most the ``confidence`` quantile times the k-th best distance so
far: a true neighbour fails that with probability 1 - ``confidence``, so the recall to
expect is ``confidence``, whatever the data.

The kd-tree has two parts. Its upper levels, cut at medians of a bounded sample of
projections (``sample`` rows), deal all rows to cells of about ``shard_rows``; a cell with
more (equal vectors, say) is dealt on to several shards by a hash. Its lower levels are built
from all rows of a shard inside the shard's task, where leaves are visited nearest first. A
query is answered in its own shard first; the k-th score found there goes with it to those
other shards only whose box the test still allows. Rows are moved to their shard and never
copied; what is copied are queries, which stream through a shard in blocks, so a task holds one
shard and one block.

Defined cases: vectors that are null, all zero, or hold null or non-finite components take no
part; of several lengths the commonest takes part (the shortest of equally common ones);
rows that repeat a vec_id count as one (its smallest vector), null ids take no part; fewer than k
candidates are all returned; equal scores are ranked by vec_id (scores are summed in one fixed
order, so equal vectors tie exactly); an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize


@dataclass(frozen=True)
class SearchSettings:
    """``max_cells`` bounds the upper tree and the boxes that reach the driver and every task."""

    k: int = 20
    width: int = 16
    confidence: float = 0.93
    leaf: int = 128
    wave: int = 4096
    shard_rows: int = 20_000
    sample: int = 20_000
    max_cells: int = 65_536
    query_block: int = 128
    seed: int = 5


def chi_square_cdf(x: float, even: int) -> float:
    """P(chi-square with an even number of degrees of freedom <= x), in closed form."""
    half, term, total = x / 2, 1.0, 0.0
    for i in range(even // 2):
        total += term
        term *= half / (i + 1)
    return 1 - math.exp(-half) * total


def chi_square_quantile(p: float, even: int) -> float:
    low, high = 0.0, 1.0
    while chi_square_cdf(high, even) < p:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_cdf(middle, even) < p else (low, middle)
    return high


@dataclass(frozen=True)
class Projection:
    """What every task needs: the largest norm, the Gaussian matrix, the test's limit."""

    most: float
    matrix: np.ndarray
    limit: float
    settings: SearchSettings

    def rows(self, vectors: np.ndarray) -> np.ndarray:
        lift = np.sqrt(np.maximum(0, self.most**2 - (vectors**2).sum(axis=1)))
        return self.queries(vectors) + lift[:, None] * self.matrix[-1]

    def queries(self, vectors: np.ndarray) -> np.ndarray:
        """Queries are not lifted: their extra component is 0."""
        return vectors @ self.matrix[:-1]

    def reach(self, squares: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """Largest squared projected distance that the test allows where ``scores`` are the k-th best."""
        return self.limit * np.maximum(0.0, squares + self.most**2 - 2 * scores)


@dataclass(frozen=True)
class Cells:
    """Upper kd-tree: (dimension, cut, left, right) of every node; a negative child is cell ``-1 - child``."""

    dim: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray

    def of(self, points: np.ndarray) -> np.ndarray:
        at = np.zeros(len(points), np.int64) - (len(self.dim) == 0)
        while (inner := at >= 0).any():
            i = at[inner]
            at[inner] = np.where(points[inner, self.dim[i]] < self.cut[i], self.left[i], self.right[i])
        return -1 - at


def upper_tree(points: np.ndarray, cells: int) -> Cells:
    """Median cuts of the sample on the widest dimension, the fullest part first, until there are ``cells`` parts."""
    nodes: list[list] = []
    leaves = [(np.arange(len(points)), -1, 0)]  # rows, parent node, side
    while len(leaves) < cells:
        leaves.sort(key=lambda x: len(x[0]))
        rows, parent, side = leaves.pop()
        own = points[rows]
        if len(rows) < 2 or not (own.max(axis=0) > own.min(axis=0)).any():
            leaves.append((rows, parent, side))
            break
        d = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
        values = np.sort(own[:, d])
        cut = values[len(values) // 2]
        if cut == values[0]:
            cut = values[np.searchsorted(values, cut, side="right")]
        if parent >= 0:
            nodes[parent][2 + side] = len(nodes)
        nodes.append([d, float(cut), 0, 0])
        low = own[:, d] < cut
        leaves += [(rows[low], len(nodes) - 1, 0), (rows[~low], len(nodes) - 1, 1)]
    for i, (_, parent, side) in enumerate(leaves):
        if parent >= 0:
            nodes[parent][2 + side] = -1 - i
    columns = list(zip(*nodes)) or [(), (), (), ()]
    return Cells(np.array(columns[0], np.int64), np.array(columns[1], float), np.array(columns[2], np.int64), np.array(columns[3], np.int64))


def box_distance(low: np.ndarray, high: np.ndarray, points: np.ndarray) -> np.ndarray:
    """(points x boxes) least squared distance."""
    out = np.zeros((len(points), len(low)))
    for d in range(points.shape[1]):
        p = points[:, d, None]
        away = np.maximum(np.maximum(low[:, d] - p, p - high[:, d]), 0)
        out += away * away
    return out


class Shard:
    """Rows of one shard in the order of a kd-tree's leaves (median cuts on the widest dimension)."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, projection: Projection):
        self.projection, settings = projection, projection.settings
        points = projection.rows(vectors)
        order, bounds, todo = np.arange(len(points)), [], [(0, len(points))]
        while todo:
            a, b = todo.pop()
            if b - a <= settings.leaf:
                bounds.append((a, b))
                continue
            own = points[order[a:b]]
            dim = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
            middle = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(own[:, dim], middle)]
            todo += [(a, a + middle), (a + middle, b)]
        self.ids, self.vectors, self.points = ids[order], vectors[order], points[order]
        self.bounds = np.array(bounds)
        self.low = np.stack([self.points[a:b].min(axis=0) for a, b in bounds])
        self.high = np.stack([self.points[a:b].max(axis=0) for a, b in bounds])
        self.squares = (self.points**2).sum(axis=1)

    def answer(self, query_ids: np.ndarray, queries: np.ndarray, floor: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
        """(query, vec_ids, scores, rows verified): the k best of this shard, none under ``floor``."""
        p, k = self.projection, self.projection.settings.k
        own = p.queries(queries)
        own_square, square = (own**2).sum(axis=1), (queries**2).sum(axis=1)
        slack = 1e-12 * np.maximum(1.0, p.most * np.sqrt(square))  # matrix products round in another order than the score
        near = box_distance(self.low, self.high, own)
        order = np.argsort(near.min(axis=0), kind="stable")
        sizes = np.diff(self.bounds, axis=1)[:, 0][order]
        steps = [p.settings.wave >> max(0, 3 - i) for i in range(4 + len(self.ids) // p.settings.wave)]  # short waves first: they set the bound
        turn = np.searchsorted(np.cumsum(steps), np.cumsum(sizes))
        best = [(np.zeros(0, np.int64), np.zeros(0))] * len(queries)
        kth, verified = floor.astype(float), np.zeros(len(queries), np.int64)
        for w in np.unique(turn):
            leaves = order[turn == w]
            reach = p.reach(square, kth)
            active = np.flatnonzero((near[:, leaves] <= reach[:, None]).any(axis=1))
            if not len(active):
                if (near[:, order[turn >= w]] > reach[:, None]).all():
                    break
                continue
            rows = np.concatenate([np.arange(a, b) for a, b in self.bounds[leaves]])
            far = own_square[active, None] + self.squares[rows] - 2 * own[active] @ self.points[rows].T
            allowed = (far <= reach[active, None] + 1e-9) & (self.ids[rows] != query_ids[active, None])
            verified[active] += allowed.sum(axis=1)
            vectors = self.vectors[rows]
            scores = np.where(allowed, queries[active] @ vectors.T, -np.inf)
            if scores.shape[1] > k:
                least = np.partition(scores, -k, axis=1)[:, -k]
            else:
                least = np.full(len(active), -np.inf)
            hit = (scores >= np.maximum(least, kth[active])[:, None] - slack[active, None]) & allowed
            for j, i in enumerate(active.tolist()):
                at = np.flatnonzero(hit[j])
                if not len(at):
                    continue
                ids = np.concatenate([best[i][0], self.ids[rows[at]]])
                exact = np.concatenate([best[i][1], (vectors[at] * queries[i]).sum(axis=1)])
                top = np.lexsort((ids, -exact))[:k]
                best[i] = ids[top], exact[top]
                if len(top) == k:
                    kth[i] = max(kth[i], exact[top[-1]])
        for i, q in enumerate(query_ids.tolist()):
            yield q, *best[i], int(verified[i])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(len(column), -1)


_FOUND = "shard int, query_id long, vec_id long, score double, verified long, box array<double>"
_FOUND_ARROW = pa.schema([("shard", pa.int32()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()), ("verified", pa.int64()), ("box", pa.list_(pa.float64()))])


def _answers(shard: int, index: Shard, ids: np.ndarray, vectors: np.ndarray, floor: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Answers in blocks of queries; a query's first row carries the rows verified for it."""
    block = index.projection.settings.query_block
    for a in range(0, len(ids), block):
        found = list(index.answer(ids[a : a + block], vectors[a : a + block], floor[a : a + block]))
        q, v, s, n = [], [], [], []
        for query, near, scores, verified in found:
            m = max(1, len(near))  # a query without an answer still reports its count
            q.append(np.full(m, query))
            v.append(near if len(near) else np.full(1, -1))
            s.append(scores if len(near) else np.full(1, np.nan))
            n.append(np.concatenate([[verified], np.zeros(m - 1)]))
        rows = np.concatenate(v)
        none = np.isnan(np.concatenate(s))
        yield pa.RecordBatch.from_arrays([
            pa.array(np.full(len(rows), shard), pa.int32()), pa.array(np.concatenate(q), pa.int64()), pa.array(rows, pa.int64(), mask=none),
            pa.array(np.concatenate(s), pa.float64(), mask=none), pa.array(np.concatenate(n), pa.int64()), pa.nulls(len(rows), pa.list_(pa.float64())),
        ], schema=_FOUND_ARROW)


def _runs(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])
    return zip(cuts[:-1].tolist(), cuts[1:].tolist())


def _at_home(shared, query_every: int):
    """Rows sorted by shard -> a shard's box, and the answers of the queries that lie in it."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        projection: Projection = shared.value
        shard, held = None, []

        def close() -> Iterator[pa.RecordBatch]:
            ids, vectors = (np.concatenate(x) for x in zip(*held))
            index = Shard(ids, vectors, projection)
            box = [*index.low.min(axis=0), *index.high.max(axis=0)]
            yield pa.RecordBatch.from_pylist([{"shard": shard, "box": box}], schema=_FOUND_ARROW)
            asks = np.flatnonzero(ids % query_every == 0)
            yield from _answers(shard, index, ids[asks], vectors[asks], np.full(len(asks), -np.inf))

        for batch in batches:
            shards, ids, vectors = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2)) if batch.num_rows else None
            for a, b in _runs(shards) if len(shards) else ():
                if held and shards[a] != shard:
                    yield from close()
                    held = []
                shard = int(shards[a])
                held.append((ids[a:b], vectors[a:b]))
        if held:
            yield from close()

    return search


def _away(shared):
    """Rows and then queries of every shard -> answers of the queries."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, index = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            shards, asks, ids, vectors = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(), _matrix(batch.column(3))
            floor = batch.column(4).to_numpy(zero_copy_only=False)
            for a, b in _runs(shards.astype(np.int64) * 2 + asks):
                if shards[a] != shard:
                    shard, held, index = int(shards[a]), [], None
                if not asks[a]:
                    held.append((ids[a:b], vectors[a:b]))
                    continue
                if index is None:
                    if not held:
                        continue
                    index = Shard(*(np.concatenate(x) for x in zip(*held)), shared.value)
                    held = []
                yield from _answers(shard, index, ids[a:b], vectors[a:b], floor[a:b])

    return search


def _router(shared, boxes):
    """A query -> itself for every shard but its own that the test allows."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        projection: Projection = shared.value
        names, low, high = boxes.value
        block = max(1, (1 << 22) // max(1, len(names)))  # queries whose distances to all boxes are held at once: 32 MB
        for whole in batches:
            for start in range(0, whole.num_rows, block):
                batch = whole.slice(start, block)
                vectors, floor = _matrix(batch.column(2)), batch.column(3).to_numpy(zero_copy_only=False)
                near = box_distance(low, high, projection.queries(vectors))
                go = near <= projection.reach((vectors**2).sum(axis=1), floor)[:, None]
                go &= names[None, :] != batch.column(0).to_numpy()[:, None]
                q, s = np.nonzero(go)
                rows = batch.take(pa.array(q))
                yield pa.RecordBatch.from_arrays([pa.array(names[s], pa.int32()), rows.column(1), rows.column(2), rows.column(3)], names=["shard", "vec_id", "v", "floor"])

    return route


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, v (doubles) of the rows that take part."""
    v = F.col(embedding)
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    rows = rows.where(finite & F.exists("v", lambda x: x != 0))
    rows = rows.groupBy("vec_id").agg(F.min("v").alias("v"))
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).select(F.col("n").alias("__n"))
    return rows.join(F.broadcast(lengths), F.size("v") == F.col("__n")).select("vec_id", F.col("v").cast("array<double>").alias("v"))  # one row


def _dealt(rows: DataFrame, n: int, projection: Projection) -> tuple[DataFrame, int]:
    """``rows`` with their shard (0 and on), and the number of shards."""
    settings, spark = projection.settings, rows.sparkSession
    size = max(settings.shard_rows, math.ceil(n / settings.max_cells))
    if n <= size:
        return rows.select(F.lit(0).alias("shard"), "vec_id", "v"), 1
    # about half as many again as the sample needs pass the filter, so few rows meet in the sort
    picked = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(settings.seed)), F.lit(n)) < int(1.5 * settings.sample)).orderBy(F.xxhash64("vec_id"), "vec_id").limit(settings.sample)
    points = projection.rows(np.array([r.v for r in picked.select("v").collect()], float))
    tree = spark.sparkContext.broadcast(upper_tree(points, math.ceil(n / size)))
    shared = spark.sparkContext.broadcast(projection)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = tree.value.of(shared.value.rows(_matrix(b.column(1)))) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), b.column(0), b.column(1)], names=["cell", "vec_id", "v"])

    placed = materialize(rows.mapInArrow(place, "cell int, vec_id long, v array<double>"), "cells")
    # a row per cell (``max_cells`` at most): cells over the size are dealt on by a hash
    counts = sorted((r.cell, r["count"]) for r in placed.groupBy("cell").count().collect())
    parts = [max(1, math.ceil(c / size)) for _, c in counts]
    first = np.concatenate([[0], np.cumsum(parts)])
    table = spark.createDataFrame([(cell, int(first[i]), parts[i]) for i, (cell, _) in enumerate(counts)], "c int, first int, parts int")
    known = placed.join(F.broadcast(table), F.col("cell") == F.col("c"))
    return known.select((F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("parts"))).cast("int").alias("shard"), "vec_id", "v"), int(first[-1])


def nearest(vectors: DataFrame, query_every: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", settings: SearchSettings | None = None) -> DataFrame:
    """query_id, rank, vec_id and score of the k best candidates of every query, and ``verified``: rows whose inner product the query's test asked for."""
    settings = settings or SearchSettings()
    spark = vectors.sparkSession
    rows = materialize(usable(vectors, vec_id, embedding), "vectors")
    known = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("m"), F.max(F.size("v")).alias("d")).first()
    matrix = np.random.default_rng(settings.seed).normal(size=((known.d or 0) + 1, settings.width))
    projection = Projection(math.sqrt(known.m or 0.0), matrix, chi_square_quantile(settings.confidence, settings.width), settings)
    dealt, shards = _dealt(rows, known.n, projection)
    dealt = materialize(dealt, "dealt")
    shared = spark.sparkContext.broadcast(projection)
    home = dealt.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "vec_id").mapInArrow(_at_home(shared, query_every), _FOUND)
    home = materialize(home, "home")
    found = home.where("box is null")
    if shards > 1:
        boxes = home.where("box is not null").select("shard", "box").orderBy("shard").collect()  # a row per shard: twice ``max_cells`` at most
        box = np.array([r.box for r in boxes])
        kept = spark.sparkContext.broadcast((np.array([r.shard for r in boxes]), box[:, : settings.width], box[:, settings.width :]))
        floor = found.groupBy("query_id").agg(F.when(F.count("score") == settings.k, F.min("score")).otherwise(F.lit(float("-inf"))).alias("floor"))
        asked = dealt.where(F.col("vec_id") % query_every == 0).join(floor, F.col("vec_id") == F.col("query_id")).select("shard", "vec_id", "v", "floor")
        sent = asked.mapInArrow(_router(shared, kept), "shard int, vec_id long, v array<double>, floor double")
        both = dealt.select("shard", F.lit(0).alias("ask"), "vec_id", "v", F.lit(0.0).alias("floor")).unionByName(sent.withColumn("ask", F.lit(1)))
        both = both.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "ask", "vec_id")
        found = found.unionByName(both.mapInArrow(_away(shared), _FOUND))
    whole = Window.partitionBy("query_id")
    order = whole.orderBy(F.desc_nulls_last("score"), "vec_id")
    ranked = found.withColumns({"rank": F.row_number().over(order), "verified": F.sum("verified").over(whole)})
    return ranked.where((F.col("rank") <= settings.k) & F.col("vec_id").isNotNull()).select("query_id", "rank", "vec_id", "score", "verified")
