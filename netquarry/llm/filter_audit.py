"""Audit of filters that act in turn, by count-weighted decision diagrams.

Every document has a failure mask: which of the filters reject it, each judged alone. A part's
documents are counted by mask (with how many of them are good or toxic), at most 2**k counts for k filters,
whatever the part's size. From those a decision diagram is built for each part: a level
per filter, each node with an edge for passing and one for failing, equal nodes shared, every node
weighing the counts below it. The path of passes from the top says what each filter leaves when it
acts in the diagram's order; the fail edges along it are what each one takes. Swapping two
neighbouring levels touches those two levels alone, and a chain of such swaps visits all k!
orders, so no order is counted anew.

Filters that look at other documents (copies) are judged on the whole table, once.

Defined cases: null and blank texts are empty ones; a null source is the part with the empty
name, as is an empty one; rows repeat as they are given; rows of equal id and text count each and don't fail as copies (no id is
smaller), null ids are the largest; a document is good or toxic if any row of the labels with its
id says so; texts of any length are judged whole (in memory one at a time); an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, materialize, text_or_empty

Node = tuple  # (weight, pass child, fail child); of a terminal (weight,)

FILTERS = "ABCDE"

#: If a document fails, by its text and its words.
Filter = Callable[[Column, Column], Column]


class Diagram:
    """Ordered, shared diagram over failure masks; ``order`` holds the filter of each level, top first."""

    def __init__(self, counts: np.ndarray):
        """``counts``: a row of weights for every mask, bit i standing for filter i."""
        self.order = list(range(int(math.log2(len(counts)))))
        self._known: list[dict[Node, Node]] = [{} for _ in range(len(self.order) + 1)]
        self.top = self._built(counts, 0, 0)

    def _built(self, counts: np.ndarray, level: int, mask: int) -> Node:
        if level == len(self.order):
            return self._shared(level, (tuple(counts[mask].tolist()),))
        return self._node(level, self._built(counts, level + 1, mask), self._built(counts, level + 1, mask | 1 << level))

    def _shared(self, level: int, node: Node) -> Node:
        return self._known[level].setdefault(node, node)

    def _node(self, level: int, passes: Node, fails: Node) -> Node:
        return self._shared(level, (tuple(a + b for a, b in zip(passes[0], fails[0])), passes, fails))

    def swap(self, level: int) -> None:
        """Exchange the filters of ``level`` and the one below it; nodes under both stay as they are."""
        done: dict[int, Node] = {}
        self._known[level], self._known[level + 1] = {}, {}

        def exchanged(node: Node) -> Node:
            (_, pp, pf), (_, fp, ff) = node[1], node[2]
            return self._node(level, self._node(level + 1, pp, fp), self._node(level + 1, pf, ff))

        def rebuilt(node: Node, at: int) -> Node:
            if id(node) not in done:
                done[id(node)] = exchanged(node) if at == level else self._node(at, rebuilt(node[1], at + 1), rebuilt(node[2], at + 1))
            return done[id(node)]

        above = self.top  # kept, so that ids stay apart while nodes are replaced
        for at in range(level):
            self._known[at] = {}
        self.top = rebuilt(above, 0)
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def steps(self) -> Iterator[tuple[int, tuple, tuple]]:
        """(filter, weight that passes it, weight that it takes) along the path of passes."""
        node = self.top
        for name in self.order:
            yield name, node[1][0], node[2][0]
            node = node[1]


def neighbour_swaps(k: int) -> Iterator[int]:
    """Levels whose swaps with the next one lead through all orders of ``k`` filters, each once (plain changes)."""
    if k < 2:
        return
    last = k - 1
    inner = neighbour_swaps(k - 1)
    down = True
    while True:
        yield from (range(last - 1, -1, -1) if down else range(last))
        step = next(inner, None)
        if step is None:
            return
        yield step + 1 if down else step  # the last filter now stands in front of the others, or behind them
        down = not down


def audit_steps(counts: np.ndarray, letters: str) -> list[tuple]:
    """(order, step, filter, kept, removed, redundant, unique fails, further weights removed..., sum over orders) of all orders."""
    k = len(letters)
    diagram = Diagram(counts)
    fails = [int(sum(counts[m][0] for m in range(1 << k) if m >> i & 1)) for i in range(k)]
    alone = [int(counts[1 << i][0]) for i in range(k)]
    taken, rows = [0] * k, []

    def read() -> None:
        order = "".join(letters[i] for i in diagram.order)
        for step, (i, passing, removed) in enumerate(diagram.steps(), 1):
            taken[i] += removed[0]
            rows.append((order, step, i, passing[0], removed[0], fails[i] - removed[0], alone[i], *removed[1:]))

    read()
    for level in neighbour_swaps(k):
        diagram.swap(level)
        read()
    return [(*row, taken[row[2]]) for row in rows]


def failure_masks(docs: DataFrame, filters: list[Filter], text: str, doc_id: str, part: str) -> DataFrame:
    """(part, doc_id, digest, mask, n): rows of equal id, text and part counted together; bit i is set where filter i rejects."""
    bits = [F.when(fails(F.col("__t"), F.col("__w")), 1 << i).otherwise(0) for i, fails in enumerate(filters)]
    rows = docs.select(F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("__t"))
    rows = rows.withColumn("__w", F.regexp_extract_all("__t", F.lit(WORD), F.lit(0)))  # once for all filters
    rows = rows.select("part", "doc_id", F.sha2("__t", 256).alias("digest"), reduce(lambda a, b: a + b, bits).alias("mask"))
    return rows.groupBy("part", "doc_id", "digest", "mask").agg(F.count(F.lit(1)).alias("n"))


def with_copies(rows: DataFrame, bit: int) -> DataFrame:
    """``rows`` with ``bit`` set in the masks of those whose text is that of a smaller id.

    The smallest id of a text is found by sums on the map side, and met by (text, id), not by text: of a text with very many
    copies a task gets no more rows than the ids that it has.
    """
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"))
    first = rows.groupBy("digest").agg(F.min(key).alias("first")).select(F.col("digest").alias("fd"), F.col("first.doc_id").alias("fi"), F.lit(True).alias("is_first"))
    met = rows.join(first, (F.col("digest") == F.col("fd")) & F.col("doc_id").eqNullSafe(F.col("fi")), "left")
    return met.withColumn("mask", F.col("mask") + F.when(F.col("is_first"), 0).otherwise(1 << bit)).drop("fd", "fi", "is_first")


def contract_filters() -> list[Filter]:
    """Filters A to D of the audit, by text and words."""
    return [
        lambda t, w: F.size(w) < 200,
        lambda t, w: 100 * F.size(F.array_distinct(w)) < 50 * F.size(w),
        lambda t, w: 100 * F.length(F.regexp_replace(t, "[^A-Z]", "")) > 2 * F.length(t),
        lambda t, w: t.rlike("[#$%&*|]"),
    ]


def _auditor(letters: str):
    schema = pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()), ("filter", pa.string()), *[
        (c, pa.int64()) for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    ]])

    def audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, masks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts = np.zeros((1 << len(letters), 3), np.int64)
                for m in masks:
                    counts[m["mask"]] = m["n"], m["good"], m["toxic"]
                columns = list(zip(*audit_steps(counts, letters)))
                columns[2] = [letters[i] for i in columns[2]]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(columns[0])), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:]))], schema=schema)

    return audit


def mask_counts(docs: DataFrame, labels: DataFrame, filters: list[Filter] | None = None, text: str = "text", doc_id: str = "doc_id", part: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): documents of every part by failure mask, the last bit standing for copies."""
    filters = filters or contract_filters()
    rows = materialize(failure_masks(docs, filters, text, doc_id, part), "failure-masks")
    known = labels.groupBy(F.col("doc_id").cast("long").alias("ld")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")).where("good or toxic")
    marked = with_copies(rows, len(filters)).join(known, F.col("doc_id") == F.col("ld"), "left")
    of = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0))
    return marked.groupBy("part", "mask").agg(F.sum("n").alias("n"), of("good").alias("good"), of("toxic").alias("toxic"))


def filter_audit(docs: DataFrame, labels: DataFrame, filters: list[Filter] | None = None, letters: str = FILTERS, text: str = "text", doc_id: str = "doc_id", part: str = "source") -> DataFrame:
    """A row per part, order of the filters and step. ``filters`` are judged by text and words, in order of ``letters``; the last letter is that of copies."""
    counts = mask_counts(docs, labels, filters, text, doc_id, part)
    listed = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))  # 2**k at most
    return listed.mapInArrow(
        _auditor(letters), "part string, filter_order string, step int, filter string, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
    )
