"""Removal of repeated byte strings by suffix buckets that are refined step by step.

Every string of ``length`` bytes that also starts in a document of a smaller id is removed, with
all bytes that it covers. Suffixes are sorted as far as that question needs, by bucket-pointer refinement:
they start in buckets of their first q bytes, and a bucket is refined by the bucket identifiers that its suffixes
have at a later offset, so the depth to which buckets agree doubles with each round; new identifiers take the old ones' places and
serve the next round, and a suffix that is alone in its bucket, or whose later suffix is alone in its own, is settled.

Across the cluster the same is done with few suffixes. Of the q-grams inside a string of
``length`` bytes, the one with the smallest hash is its sample: equal strings have equal samples at
equal offsets, so strings that may be equal are those of one sample's bucket. Neighbouring strings mostly share a sample, and such
a run of strings is one item, its bytes sent once.

1. Texts are written as chunks of about ``chunk_bytes``.
2. Each chunk asks, for the distinct buckets of its samples, which of them hold a second document anywhere.
   Others are settled (most of a corpus). A bucket with very many different items is marked as hot.
3. Items of open buckets go, bytes and smallest id, to the group that their bucket hashes to. There suffixes are
   refined down to ``length`` bytes, exactly, and each string of an item is told if a smaller id has it.
   Strings of a hot bucket are items of their own, dealt by a hash of their whole length, so no bucket meets in one task.
4. Chunks read the answers: a bit for each string of each distinct item.

A chunk sends an item once, however many of its documents hold it; a bucket's copies are never paired.
Hashes only deal items out and tell apart items of one chunk (by 128 bits); whether strings are equal is decided on their bytes.

Defined cases: null text is empty; texts shorter than ``length`` lose nothing; rows of equal id don't
remove from each other (no id is smaller), a null id counts as the largest; bytes are removed whether or not they cut a
character, so what is kept is binary; texts of any length are taken whole (a task's memory is a few
dozen times its chunk, or the longest text); an empty table gives an empty result; extra columns don't matter.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, mix64, slices, text_buffer, text_or_empty, word_hashes

GRAM = 16
FIRST = 4  # bytes of the buckets that refinement starts from
_NULL_ID = np.iinfo(np.int64).max
_LOW = np.uint64(0xFF)
_MANY = 127


@dataclass(frozen=True)
class SuffixSettings:
    """``length``: bytes of a string that counts as repeated, 16 at least; ``hot_items``: different items from which a bucket's
    strings are dealt one by one; ``group_bytes``: text for each group of a shuffle, so groups follow the data's size."""

    length: int = 50
    chunk_bytes: int = 2 << 20
    group_bytes: int = 1 << 20
    hot_items: int = 4096


# refinement -------------------------------------------------------------------


def _named(first: np.ndarray, later: np.ndarray | None, bound: int) -> tuple[np.ndarray, int]:
    """Identifiers 0, 1, ... of equal (first, later) pairs of numbers below ``bound``; -1 for what is alone. And how many there are."""
    n = len(first)
    key = first.astype(np.uint64) if later is None else first.astype(np.uint64) * np.uint64(bound) + later.astype(np.uint64)
    top = bound if later is None else bound * bound
    width = max(1, int(n - 1).bit_length())
    if top << width <= 1 << 64:  # a sort of numbers alone is several times faster than one that returns places
        packed = np.sort(key << np.uint64(width) | np.arange(n, dtype=np.uint64))
        order, key = (packed & np.uint64((1 << width) - 1)).astype(np.int64), packed >> np.uint64(width)
    else:
        order = np.argsort(key)
        key = key[order]
    fresh = np.ones(n, bool)
    fresh[1:] = key[1:] != key[:-1]
    alone = fresh.copy()
    alone[:-1] &= fresh[1:]
    group = np.cumsum(fresh & ~alone) - 1
    names = np.empty(n, np.int64)
    names[order] = np.where(alone, -1, group)
    return names, int(group[-1]) + 1 if n else 0


def refined(text: np.ndarray, ends: np.ndarray, depth: int) -> np.ndarray:
    """Bucket identifier of every suffix of ``text`` (strings that end at ``ends``): equal where the next ``depth`` bytes
    are, -1 where they are like no other's or fewer are left."""
    n = len(text)
    left = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(n)
    at = np.flatnonzero(left >= FIRST)
    start = np.zeros(len(at), np.uint64)
    for j in range(FIRST):
        start = start << np.uint64(8) | text[at + j]
    bucket = np.full(n, -1, np.int64)
    names, count = _named(start, None, 1 << (8 * FIRST))
    bucket[at] = names
    reached = FIRST
    while reached < depth:
        step = min(reached, depth - reached)
        enough = left[at] >= reached + step
        go = at[enough & (names >= 0)]
        later = bucket[go + step]  # read before anything is settled in this round
        bucket[at[~enough]] = -1
        settled = later < 0
        bucket[go[settled]] = -1
        at, later = go[~settled], later[~settled]
        names, count = _named(bucket[at], later, max(count, 1))
        bucket[at] = names
        reached += step
    return bucket


# items of a chunk ---------------------------------------------------------------


def _gram_hashes(raw: np.ndarray) -> np.ndarray:
    n = len(raw) - GRAM + 1
    words = np.ascontiguousarray(np.ndarray((len(raw) - 7,), "<u8", raw.tobytes(), strides=(1,)))
    return mix64(words[:n] * np.uint64(0x9E3779B97F4A7C15) + words[8 : 8 + n] * np.uint64(0xD1B54A32D192ED03))


def runs(raw: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First string, number of strings and bucket (56 bits) of every run of strings that have one sample."""
    count = len(raw) - length + 1
    sizes = np.diff(ends, prepend=0)
    if not (sizes >= length).any():
        z = np.zeros(0, np.int64)
        return z, z, z.astype(np.uint64)
    hashes = _gram_hashes(raw)
    best = (hashes >> np.uint64(32) << np.uint64(32)) | np.arange(len(hashes), dtype=np.uint64)
    width, span = length - GRAM + 1, 1
    while span * 2 <= width:
        best = np.minimum(best[:-span], best[span:])
        span *= 2
    if span < width:
        best = np.minimum(best[: span - width], best[width - span :])
    sample = (best & np.uint64(0xFFFFFFFF)).astype(np.int64)
    starts = np.maximum(sizes - length + 1, 0)  # strings of each text
    whole = np.repeat(np.tile([True, False], len(sizes)), np.stack([starts, sizes - starts], axis=1).ravel())[:count]
    head = whole.copy()
    head[1:] &= ~whole[:-1] | (sample[1:] != sample[:-1])
    first = np.flatnonzero(head)
    text = np.searchsorted(ends, first, side="right")
    strings = np.minimum(np.append(first[1:], count), (ends - sizes + starts)[text]) - first
    return first, strings, hashes[sample[first]] >> np.uint64(8)


def _grouped(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts of groups of equal keys in it)."""
    mixed = np.zeros(len(keys[0]), np.uint64)
    for key in keys:
        mixed = mix64(mixed ^ key.astype(np.uint64)) + np.uint64(1)
    order = np.argsort(mixed)
    fresh = np.ones(len(order), bool)
    if len(order):
        fresh[1:] = False
        for key in keys:
            k = key[order]
            fresh[1:] |= k[1:] != k[:-1]
    return order, np.flatnonzero(fresh)


def _numbers(order: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The group of each row."""
    out = np.empty(len(order), np.int64)
    out[order] = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(order))))
    return out


def _stretches(keys: np.ndarray) -> list[tuple[int, int]]:
    """Borders of the stretches of equal numbers (0 or more) in sorted ``keys``."""
    at = np.flatnonzero(np.diff(keys, prepend=-1)).tolist()
    return list(zip(at, [*at[1:], len(keys)]))


@dataclass
class Chunk:
    """Texts side by side, their runs, and the distinct items among these."""

    raw: np.ndarray
    ends: np.ndarray
    ids: np.ndarray
    settings: SuffixSettings

    def __post_init__(self) -> None:
        self.first, self.strings, bucket = runs(self.raw, self.ends, self.settings.length)
        self.run_id = self.ids[np.searchsorted(self.ends, self.first, side="right")]
        hashes = word_hashes(self.raw, self.first, self.first + self.strings - 1 + self.settings.length)
        order, starts = _grouped(bucket, hashes)
        self.item = _numbers(order, starts)
        self.at, self.items_bucket = order[starts], bucket[order[starts]]
        self.low, self.high = (f.reduceat(self.run_id[order], starts) if len(starts) else self.run_id for f in (np.minimum, np.maximum))

    def buckets(self, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct buckets in order of part, their parts, and how items stand in them: the item's place in that order."""
        names, place = np.unique(self.items_bucket, return_inverse=True)
        part = (names % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return names[order], part[order], back[place]

    def asked(self, parts: int) -> tuple[np.ndarray, np.ndarray]:
        """(requests, their parts): a bucket in 56 bits, its different items up to 127, and if it has two ids already."""
        names, part, place = self.buckets(parts)
        if not len(names):
            return names, part
        items = np.bincount(place, minlength=len(names))
        low, high = np.full(len(names), _NULL_ID), np.full(len(names), np.iinfo(np.int64).min)
        np.minimum.at(low, place, self.low)
        np.maximum.at(high, place, self.high)
        return names << np.uint64(8) | (np.minimum(items, _MANY) << 1 | (low < high)).astype(np.uint64), part

    def sent(self, parts: int, groups: int, answers: list[bytes]) -> Sent:
        names, part, place = self.buckets(parts)
        open_, hot = np.zeros(len(names), bool), np.zeros(len(names), bool)
        for (a, b), bits in zip(_stretches(part), answers, strict=True):
            both = np.unpackbits(np.frombuffer(bits, np.uint8)).reshape(2, -1)[:, : b - a].astype(bool)
            open_[a:b], hot[a:b] = both
        return Sent(self, open_[place] if len(place) else np.zeros(0, bool), hot[place] if len(place) else np.zeros(0, bool), groups)


class Sent:
    """What a chunk sends of its items: start, strings, smallest id and group of each, in order of group."""

    def __init__(self, chunk: Chunk, open_: np.ndarray, hot: np.ndarray, groups: int):
        self.chunk, length = chunk, chunk.settings.length
        kept = np.flatnonzero(open_ & ~hot)
        # strings of hot buckets, each for itself
        run = np.flatnonzero((open_ & hot)[chunk.item])
        n = chunk.strings[run]
        self.hot_start = np.repeat(chunk.first[run] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        self.hot_id = np.repeat(chunk.run_id[run], n)
        a, b = (word_hashes(chunk.raw, self.hot_start, self.hot_start + length, seed) for seed in (1, 2))
        order, starts = _grouped(a, b)
        hot_item = _numbers(order, starts)
        low = np.minimum.reduceat(self.hot_id[order], starts) if len(starts) else np.zeros(0, np.int64)
        start = np.concatenate([chunk.first[chunk.at[kept]], self.hot_start[order[starts]]])
        strings = np.concatenate([chunk.strings[chunk.at[kept]], np.ones(len(starts), np.int64)])
        ids = np.concatenate([chunk.low[kept], low])
        group = (mix64(np.concatenate([chunk.items_bucket[kept], a[order[starts]]])) % np.uint64(groups)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        self.start, self.strings, self.ids, self.group = start[order], strings[order], ids[order], group[order]
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        of_item = np.full(len(chunk.at), -1)
        of_item[kept] = back[: len(kept)]
        self.run_place = of_item[chunk.item]
        self.hot_place = back[len(kept) + hot_item]

    def parcels(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(group, ids, strings, bytes) for every group."""
        sizes = self.strings - 1 + self.chunk.settings.length
        ends = np.cumsum(sizes)
        for a, b in _stretches(self.group):
            n = sizes[a:b]
            base = ends[a] - n[0]
            place = np.repeat(self.start[a:b] - (ends[a:b] - n - base), n) + np.arange(ends[b - 1] - base)
            yield int(self.group[a]), self.ids[a:b], self.strings[a:b], self.chunk.raw[place]

    def covered(self, answers: list[bytes]) -> np.ndarray:
        """Bytes that a repeated string covers. ``answers``: bits of every group's strings, in order of group."""
        chunk, length = self.chunk, self.chunk.settings.length
        bits = [np.unpackbits(np.frombuffer(x, np.uint8))[: self.strings[a:b].sum()] for (a, b), x in zip(_stretches(self.group), answers, strict=True)]
        smaller = np.concatenate(bits).astype(bool) if bits else np.zeros(0, bool)
        bit_at = np.cumsum(self.strings) - self.strings
        run = np.flatnonzero(self.run_place >= 0)
        item, n = self.run_place[run], chunk.strings[run]
        offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        gone = smaller[np.repeat(bit_at[item], n) + offset] | np.repeat(chunk.run_id[run] > self.ids[item], n)
        hot_gone = smaller[bit_at[self.hot_place]] | (self.hot_id > self.ids[self.hot_place])
        starts = np.concatenate([(np.repeat(chunk.first[run], n) + offset)[gone], self.hot_start[hot_gone]])
        depth = np.bincount(starts, minlength=len(chunk.raw) + 1) - np.bincount(starts + length, minlength=len(chunk.raw) + 1)
        return np.cumsum(depth[: len(chunk.raw)]) > 0


# tasks ------------------------------------------------------------------------------


def _chunker(settings: SuffixSettings):
    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", settings.chunk_bytes):
            raw, offsets = text_buffer(part.column(1))
            one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            name = int.from_bytes(os.urandom(8), "little") >> 1  # the written rows keep it
            packed = pa.Codec("zstd", 1).compress(raw.tobytes(), asbytes=True)  # chunks cross the network twice
            yield pa.RecordBatch.from_arrays(
                [pa.array([name]), one(pa.array(part.column(0).to_pylist(), pa.int64())), one(pa.array(offsets[1:])), pa.array([packed], pa.binary())], names=["chunk", "ids", "ends", "packed"]
            )

    return chunks


def _loaded(batches: Iterator[pa.RecordBatch], settings: SuffixSettings) -> Iterator[tuple[pa.RecordBatch, int, Chunk]]:
    for batch in batches:
        for i in range(batch.num_rows):
            ids = batch.column("ids")[i].values.fill_null(_NULL_ID).to_numpy(zero_copy_only=False)
            ends = batch.column("ends")[i].values.to_numpy()
            raw = pa.Codec("zstd").decompress(batch.column("packed")[i].as_buffer(), int(ends[-1]))
            yield batch, i, Chunk(np.frombuffer(raw, np.uint8), ends, ids, settings)


def _answers(batch: pa.RecordBatch, i: int, name: str) -> list[bytes]:
    found = batch.column(name)[i].as_py() or []
    return [x["bits"] for x in sorted(found, key=lambda x: x["part"])]


def _asker(settings: SuffixSettings, parts: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, chunk in _loaded(batches, settings):
            requests, part = chunk.asked(parts)
            rows = [(int(part[a]), requests[a:b].tobytes()) for a, b in _stretches(part)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in rows], pa.int64()), pa.array([batch.column("chunk")[i].as_py()] * len(rows), pa.int64()), pa.array([x[1] for x in rows], pa.binary())], names=["part", "chunk", "asked"]
            )

    return ask


def _replier(settings: SuffixSettings):
    def reply(table: pa.Table) -> pa.Table:
        blobs = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("asked")]
        sizes = np.array([len(x) for x in blobs])
        every = np.concatenate(blobs)
        order = np.argsort(every)
        name, items, two = (every >> np.uint64(8))[order], ((every & _LOW) >> np.uint64(1)).astype(np.int64)[order], (every & np.uint64(1)).astype(np.int64)[order]
        starts = np.flatnonzero(np.append(True, name[1:] != name[:-1]))
        counts = np.diff(np.append(starts, len(name)))
        open_ = (counts > 1) | (np.maximum.reduceat(two, starts) > 0)
        hot = open_ & ((np.add.reduceat(items, starts) >= settings.hot_items) | (np.maximum.reduceat(items, starts) >= _MANY))
        states = np.empty((2, len(every)), bool)
        states[:, order] = np.repeat(np.stack([open_, hot]), counts, axis=1)
        ends = np.cumsum(sizes)
        bits = [np.packbits(np.pad(states[:, b - n : b], ((0, 0), (0, -n % 8))), axis=1).tobytes() for b, n in zip(ends.tolist(), sizes.tolist())]
        return pa.table({"chunk": table.column("chunk"), "part": table.column("part"), "bits": pa.array(bits, pa.binary())})

    return reply


def _sender(settings: SuffixSettings, parts: int, groups: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, chunk in _loaded(batches, settings):
            rows = [(g, ids.tobytes(), n.astype(np.uint32).tobytes(), raw.tobytes()) for g, ids, n, raw in chunk.sent(parts, groups, _answers(batch, i, "opened")).parcels()]
            name = batch.column("chunk")[i].as_py()
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in rows], pa.int64()), pa.array([name] * len(rows), pa.int64()), *(pa.array([x[k] for x in rows], pa.binary()) for k in (1, 2, 3))], names=["part", "chunk", "low", "strings", "items"]
            )

    return send


def _refiner(settings: SuffixSettings):
    length = settings.length

    def refine(table: pa.Table) -> pa.Table:
        ids = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in table.column("low")])
        per_row = [np.frombuffer(x.as_buffer(), np.uint32).astype(np.int64) for x in table.column("strings")]
        strings = np.concatenate(per_row)
        offsets = np.concatenate([[0], np.cumsum(strings - 1 + length)])
        items = pa.Array.from_buffers(pa.large_binary(), len(strings), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(b"".join(x.as_buffer() for x in table.column("items")))])
        coded = items.dictionary_encode()  # equal items are one
        code, own = coded.indices.to_numpy(), coded.dictionary
        low = np.full(len(own), _NULL_ID)
        np.minimum.at(low, code, ids)
        text, ends = text_buffer(own)
        ends = ends[1:]
        bucket = refined(text, ends, length)
        n = np.diff(ends, prepend=0) - length + 1
        at = np.cumsum(n) - n
        place = np.repeat(ends - (n + length - 1) - at, n) + np.arange(n.sum())
        name, of = bucket[place], np.repeat(low, n)
        least = np.full(int(name.max(initial=-1)) + 1, _NULL_ID)
        shared = name >= 0
        np.minimum.at(least, name[shared], of[shared])
        of[shared] = least[name[shared]]
        # a bit for each string of each item that came, by what its distinct item was told
        string = np.repeat(at[code] - (np.cumsum(strings) - strings), strings) + np.arange(strings.sum())
        smaller = of[string] < np.repeat(ids, strings)
        ends = np.cumsum([x.sum() for x in per_row]).tolist()
        bits = [np.packbits(smaller[a:b]).tobytes() for a, b in zip([0, *ends], ends)]
        return pa.table({"chunk": table.column("chunk"), "part": table.column("part"), "bits": pa.array(bits, pa.binary())})

    return refine


def _remover(settings: SuffixSettings, parts: int, groups: int):
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, chunk in _loaded(batches, settings):
            covered = chunk.sent(parts, groups, _answers(batch, i, "opened")).covered(_answers(batch, i, "told"))
            sizes = np.diff(chunk.ends, prepend=0)
            begins = chunk.ends - sizes
            edge = np.zeros(len(chunk.raw) + 1, bool)
            edge[begins], edge[-1] = True, True
            before = np.append(False, covered)
            after = np.append(covered, False)
            first = np.flatnonzero(after & (~before | edge))
            last = np.flatnonzero(before & (~after | edge))
            at = np.searchsorted(first, np.append(begins, len(chunk.raw) + 1))
            at[:-1] = np.where(sizes > 0, at[:-1], np.searchsorted(first, chunk.ends))
            doc = np.repeat(np.arange(len(sizes)), np.diff(at))
            spans = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays([pa.array(first - begins[doc]), pa.array(last - begins[doc])], fields=list(span)))
            kept_at = np.append(0, np.cumsum(~covered))[np.append(0, chunk.ends)]
            kept = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(kept_at.astype(np.int64)), pa.py_buffer(chunk.raw[~covered].tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("ids")[i].values, pa.array(sizes), spans, kept], names=["doc_id", "n_bytes", "spans", "kept"])

    return remove


def _per_chunk(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy(F.col("chunk").alias(f"{name}_chunk")).agg(F.collect_list(F.struct("part", "bits")).alias(name))


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", settings: SuffixSettings | None = None) -> DataFrame:
    """A row per row of ``docs``: doc_id, n_bytes, ``spans`` (maximal removed runs of bytes, end exclusive) and ``kept``, the bytes that are left."""
    settings = settings or SuffixSettings()
    if settings.length < GRAM:
        raise ValueError(f"strings of {GRAM} bytes at least")
    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    chunks = materialize(given.mapInArrow(_chunker(settings), "chunk long, ids array<long>, ends array<long>, packed binary"), "text-chunks")
    total = chunks.agg(F.sum(F.element_at("ends", -1))).first()[0] or 0
    groups = max(1, math.ceil(total / settings.group_bytes))
    parts = max(1, groups // 16)
    asked = chunks.mapInArrow(_asker(settings, parts), "part long, chunk long, asked binary")
    opened = materialize(asked.groupBy("part").applyInArrow(_replier(settings), "chunk long, part long, bits binary"), "open-buckets")
    known = chunks.join(_per_chunk(opened, "opened"), F.col("chunk") == F.col("opened_chunk"), "left")
    items = known.select("chunk", "ids", "ends", "packed", "opened").mapInArrow(_sender(settings, parts, groups), "part long, chunk long, low binary, strings binary, items binary")
    told = materialize(items.groupBy("part").applyInArrow(_refiner(settings), "chunk long, part long, bits binary"), "smaller-ids")
    whole = known.join(_per_chunk(told, "told"), F.col("chunk") == F.col("told_chunk"), "left")
    removed = whole.select("ids", "ends", "packed", "opened", "told").mapInArrow(_remover(settings, parts, groups), "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
    return removed


def removal_report(removed: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of ``remove_repeats``' result."""
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return removed.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
