"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import discard, materialize, shared_dir  # noqa: F401

#: Word separators of every contract here: space and the ASCII controls 9-13.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def if_small(table: DataFrame, most: int = 100_000) -> DataFrame:
    """``table``, to be broadcast where it has ``most`` rows at most (narrow ones, counted here); else joined as it is."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], text: str, max_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each slice holds about ``max_bytes`` of text (one row at least).

    Numpy temporaries are several times the text, so this bounds a worker's memory
    whatever the rows' lengths; a single long text is one slice of its own.
    """
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int32 if pa.types.is_string(column.type) or pa.types.is_binary(column.type) else np.int64)
        offsets = offsets[column.offset : column.offset + n + 1].astype(np.int64)
        start = 0
        while start < n:
            end = int(np.searchsorted(offsets, offsets[start] + max_bytes, side="right")) - 1
            end = min(n, max(end, start + 1))
            yield batch.slice(start, end - start)
            start = end


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a null-free string column as one array, and row offsets into it."""
    wide = not (pa.types.is_string(column.type) or pa.types.is_binary(column.type))
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]
    return raw, offsets - offsets[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser over uint64 arrays."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ODD = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd 64-bit number and of its inverse modulo 2**64."""
    have = _powers.get("up")
    if have is None or len(have) < n:
        size = max(n, 1 << 21)
        up = np.full(size, _ODD, np.uint64)
        up[0] = 1
        down = np.full(size, pow(_ODD, -1, 1 << 64), np.uint64)
        down[0] = 1
        _powers["up"], _powers["down"] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers["up"][:n], _powers["down"][:n]


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the number of words in each row."""
    n = len(raw)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets) - 1, np.int64)
    space = _SPACE[raw]
    first = np.empty(n, bool)
    first[0] = True
    first[1:] = space[:-1]
    cut = offsets[:-1]
    first[cut[cut < n]] = True
    first &= ~space
    last = np.empty(n + 1, bool)
    last[n] = True
    last[:n] = space
    last[cut] = True
    starts = np.flatnonzero(first)
    stops = np.flatnonzero(last)
    ends = stops[np.searchsorted(stops, starts, side="right")]
    counts = np.searchsorted(starts, offsets[1:]) - np.searchsorted(starts, offsets[:-1])
    return starts, ends, counts


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of every word, from one prefix sum over all bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _power_table(len(raw) + 1)
    letters = mix64(np.arange(256, dtype=np.uint64) + np.uint64((seed * 1000 + 1) * _ODD & 0xFFFFFFFFFFFFFFFF))
    prefix = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(letters[raw] * up[: len(raw)], out=prefix[1:])
    return mix64((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))
