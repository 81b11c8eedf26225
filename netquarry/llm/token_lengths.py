"""Exact histogram of encoded lengths, with suffix sums for every context limit.

Documents are encoded where they lie and counted by length (map-side sums, so what is
shuffled is one row a task and distinct length). Suffix sums run inside blocks of lengths
and are then offset by the sums of the later blocks, so no task sees all lengths.

Defined cases: null text counts as empty (length 0); repeated rows count once each; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, slices, text_or_empty
from .tokens import encoder, vocabulary_path

_BLOCK_SHARE = 1024


def _counter(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for part in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([pa.array([len(encode(t)) for t in part.column(0).to_pylist()], pa.int64())], names=["length"])

    return count


def length_histogram(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """length, n_docs: how many documents have each encoded length."""
    lengths = docs.select(text_or_empty(text).alias("text")).mapInArrow(_counter(path or vocabulary_path()), "length long")
    return lengths.groupBy("length").agg(F.count(F.lit(1)).alias("n_docs"))


def context_limits(histogram: DataFrame) -> DataFrame:
    """For every length L: documents and tokens of at least L, those beyond it, the total once texts are
    cut at L, and the share of documents not longer than L (so the p-quantile is the first L that reaches p)."""
    rows = histogram.withColumn("block", F.floor(F.col("length") / _BLOCK_SHARE))
    inside = Window.partitionBy("block").orderBy(F.desc("length"))
    tokens = F.col("length") * F.col("n_docs")
    rows = rows.withColumns({"d": F.sum("n_docs").over(inside), "t": F.sum(tokens).over(inside)})
    blocks = histogram.groupBy(F.floor(F.col("length") / _BLOCK_SHARE).alias("block")).agg(
        F.sum("n_docs").alias("bd"), F.sum(tokens).alias("bt"), F.min("length").alias("least")
    )
    # one row per 1024 lengths: a few hundred even for texts of a million tokens
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(
        "block", F.coalesce(F.sum("bd").over(later), F.lit(0)).alias("od"), F.coalesce(F.sum("bt").over(later), F.lit(0)).alias("ot")
    )
    total = histogram.agg(F.sum("n_docs").alias("all_docs"), F.sum(tokens).alias("all_tokens"))
    full = rows.join(F.broadcast(offsets), "block").crossJoin(F.broadcast(total))  # one row
    docs_from, tokens_from = F.col("d") + F.col("od"), F.col("t") + F.col("ot")
    longer_docs, longer_tokens = docs_from - F.col("n_docs"), tokens_from - tokens
    return full.select(
        "length", "n_docs", docs_from.alias("docs_from"), tokens_from.alias("tokens_from"),
        longer_docs.alias("docs_beyond"),
        (F.col("all_tokens") - longer_tokens + longer_docs * F.col("length")).alias("tokens_cut_here"),
        (longer_tokens - longer_docs * F.col("length")).alias("tokens_lost_here"),
        ((F.col("all_docs") - longer_docs) / F.col("all_docs")).alias("quantile"),
        F.col("all_docs").alias("total_docs"), F.col("all_tokens").alias("total_tokens"),
    )


def limits_at(table: DataFrame, limits: list[int]) -> DataFrame:
    """Totals at any context limits, also between lengths: the last length at or below each limit answers."""
    wanted = table.sparkSession.createDataFrame([(int(x),) for x in limits], "limit long")
    at = table.join(F.broadcast(wanted), F.col("length") <= F.col("limit")).groupBy("limit").agg(
        F.max_by(F.struct("length", "tokens_cut_here", "docs_beyond"), "length").alias("x")
    )
    return at.select("limit", F.col("x.docs_beyond").alias("docs_beyond"), (F.col("x.tokens_cut_here") + F.col("x.docs_beyond") * (F.col("limit") - F.col("x.length"))).alias("tokens_kept"))


def token_lengths(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    return context_limits(materialize(length_histogram(docs, text, path), "lengths"))
