"""Packing by power-of-two decomposition.

A document of n tokens is cut, from its start, into ``n // longest`` pieces of the longest
sequence and one piece for every binary digit of the rest, longest first. Every piece is a
sequence by itself, and sequences of equal length form a bucket, so none crosses a document
and none is padded. A task keeps a bucket open for each length and closes a batch whenever the bucket
holds ``batch_tokens``, so a batch is a full rectangle of one length but for the last of a task and
bucket; ``batches`` gathers them as such.

Cutting needs only the document itself: no shuffle, and a task holds one slice of texts.

Defined cases: null text counts as empty (one token, the end id); a null doc_id stays null;
repeated rows are packed once each; a text of any length is encoded whole (memory is a few times the
longest text); an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_or_empty
from .tokens import encode, vocabulary_path

LONGEST = 2048
END_ID = 1
BATCH_TOKENS = 1 << 16


def piece_lengths(n: int, longest: int) -> list[int]:
    """Powers of two, at most ``longest`` each, that sum to n; falling."""
    if longest & (longest - 1):
        raise ValueError("the longest sequence must be a power of two")
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def _packer(path: str, longest: int, end: int | None, with_ids: bool, batch_tokens: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        bucket = dict.fromkeys((1 << b for b in range(longest.bit_length())), (-1, 0))  # length -> open batch of the task, its sequences
        batches_made = 0
        for part in slices(batches, "text"):
            ids_of, of, start, length, crc, total, batch, pieces = part.column(0), [], [], [], [], [], [], []
            for i, text in enumerate(part.column(1).to_pylist()):
                ids = encode(text, path, end)
                at = 0
                for n in piece_lengths(len(ids), longest):
                    piece = ids[at : at + n]
                    of.append(i)
                    start.append(at)
                    length.append(n)
                    crc.append(zlib.crc32(piece.tobytes()))
                    total.append(len(ids))
                    open_, held = bucket[n]
                    if open_ < 0 or (held + 1) * n > batch_tokens:
                        open_, held, batches_made = batches_made, 0, batches_made + 1
                    bucket[n] = open_, held + 1
                    batch.append(task + open_)
                    if with_ids:
                        pieces.append(piece.astype(np.int32))
                    at += n
            columns = [ids_of.take(pa.array(of, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total, batch))]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "batch"]
            if with_ids:
                columns.append(pa.array(pieces, pa.list_(pa.int32())))
                names.append("input_ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return pack


def pack(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", path: str | None = None, longest: int = LONGEST, end: int | None = END_ID, with_ids: bool = False, batch_tokens: int = BATCH_TOKENS) -> DataFrame:
    """Sequences of ``docs``: one row a piece, with its place in document and sequence.

    ``bucket`` is the sequence's length and ``batch`` the batch of that bucket which takes it; sequence and batch ids are
    unique, and stable while the scan's splits are. ``with_ids`` adds the token ids themselves.
    """
    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, batch long" + ", input_ids array<int>" * with_ids
    pieces = given.mapInArrow(_packer(path or vocabulary_path(), longest, end, with_ids, max(longest, batch_tokens)), schema)
    return pieces.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long"), "bucket": F.col("length")})


def batches(pieces: DataFrame) -> DataFrame:
    """A row per batch of ``pack(..., with_ids=True)``: batch, bucket and ``sequences``, rows of equal length (``batch_tokens`` ids at most)."""
    return pieces.groupBy("batch", "bucket").agg(F.transform(F.array_sort(F.collect_list(F.struct("sequence_id", "input_ids"))), lambda x: x["input_ids"]).alias("sequences"))
