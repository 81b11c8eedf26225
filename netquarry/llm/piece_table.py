"""Fill-in-middle by piece tables.

A document is a list of descriptors (buffer, start, end) over two immutable buffers: the bytes
of its text, and the marks. Cutting a document splits its one descriptor in three (prefix,
middle, suffix) at line borders; an arrangement permutes descriptors and puts marks between
them; the output is streamed from the descriptors, and so are its hashes, so no text is copied to be
hashed. Restoring is a piece table of its own, over the output: marks are found in it (a
text that holds one stays plain, so each mark is there once), the stretches between them
become descriptors, the form's inverse permutation puts them in order.

Where a document is cut and which form it takes follow from the sha256 of the seed and its
id, so every run repeats them.

Defined cases: a null or empty text is plain, with n = 0 units; a text of one line or without
line ends is one unit, which prefix, middle or suffix takes whole; null ids are hashed as "null"; rows of equal ids are
cut by the same hash; a text of any length is one row, whole (memory is a small multiple of the longest one, while
outputs are made); an empty table gives an empty result; extra columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_buffer, text_or_empty

#: Fixed marks and forms.
MARKS = {"prefix": b"<P>", "suffix": b"<S>", "middle": b"<M>"}
ARRANGEMENTS = {"psm": ("prefix", "suffix", "middle"), "spm": ("suffix", "prefix", "middle")}
TEXT_ORDER = ("prefix", "middle", "suffix")


@dataclass(frozen=True)
class FimSettings:
    """``rate``: percent of documents that are rearranged; ``spm_rate``: percent of those with the suffix first."""

    rate: int = 100
    spm_rate: int = 50
    seed: str = "7:"


class Piece(NamedTuple):
    buffer: memoryview
    start: int
    end: int

    def view(self) -> memoryview:
        return self.buffer[self.start : self.end]


Table = list[Piece]


def cut(table: Table, at: int) -> tuple[Table, Table]:
    """Split a table at an offset; at most one descriptor is split in two."""
    left: Table = []
    for i, piece in enumerate(table):
        n = piece.end - piece.start
        if at < n:
            return left + [piece._replace(end=piece.start + at)] * (at > 0), [piece._replace(start=piece.start + at), *table[i + 1 :]]
        left.append(piece)
        at -= n
    return left, []


def arrange(parts: dict[str, Table], form: str) -> Table:
    """Descriptors of the output: every part behind its mark, in the form's order."""
    out: Table = []
    for name in ARRANGEMENTS[form]:
        mark = memoryview(MARKS[name])
        out += [Piece(mark, 0, len(mark)), *parts[name]]
    return out


def restore(output: bytes, form: str) -> Table:
    """Descriptors, over ``output``, of the text that it was made from."""
    whole = memoryview(output)
    if form == "plain":
        return [Piece(whole, 0, len(whole))]
    order = ARRANGEMENTS[form]
    places = [output.index(MARKS[name]) for name in order]
    ends = [*places[1:], len(output)]
    found = {name: Piece(whole, place + len(MARKS[name]), end) for name, place, end in zip(order, places, ends)}
    return [found[name] for name in TEXT_ORDER]


def content(table: Table) -> bytes:
    return b"".join(piece.view() for piece in table)


def digest(table: Table) -> str:
    """sha256 of a table's content, descriptor by descriptor."""
    state = hashlib.sha256()
    for piece in table:
        state.update(piece.view())
    return state.hexdigest()


def unit_ends(raw: np.ndarray) -> np.ndarray:
    """Byte offsets at which the lines of a text end; the last line needs no line end."""
    ends = np.flatnonzero(raw == 10) + 1
    return ends if not len(raw) or len(ends) and ends[-1] == len(raw) else np.append(ends, len(raw))


def _code_points(raw: np.ndarray) -> int:
    return int(np.count_nonzero((raw & 0xC0) != 0x80))


def _numbers(doc_id: int | None, seed: str) -> list[int]:
    found = hashlib.sha256(f"{seed}{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(found[k : k + 8], 16) for k in (0, 8, 16, 24)]


def transformed(raw: np.ndarray, doc_id: int | None, settings: FimSettings) -> tuple[int, str, Table, int | None, int | None]:
    """(units, form, output descriptors, code points of prefix and of middle) of one text."""
    text = memoryview(raw.tobytes())
    whole = [Piece(text, 0, len(text))]
    ends = unit_ends(raw)
    h1, h2, h3, h4 = _numbers(doc_id, settings.seed)
    if not len(raw) or any(mark in text.obj for mark in MARKS.values()) or h3 % 100 >= settings.rate:
        return len(ends), "plain", whole, None, None
    form = "spm" if h4 % 100 < settings.spm_rate else "psm"
    borders = np.concatenate([[0], ends])
    first, last = sorted((h1 % (len(ends) + 1), h2 % (len(ends) + 1)))
    a, b = int(borders[first]), int(borders[last])
    prefix, rest = cut(whole, a)
    middle, suffix = cut(rest, b - a)
    table = arrange({"prefix": prefix, "middle": middle, "suffix": suffix}, form)
    return len(ends), form, table, _code_points(raw[:a]), _code_points(raw[a:b])


_SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()),
    ("output_sha256", pa.string()), ("restored_sha256", pa.string()), ("output", pa.string()),
])


def _transformer(settings: FimSettings, with_output: bool):
    schema = _SCHEMA if with_output else pa.schema(list(_SCHEMA)[:-1])

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            raw, offsets = text_buffer(part.column(1))
            rows = []
            for doc_id, a, b in zip(part.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                n, form, table, prefix, middle = transformed(raw[a:b], doc_id, settings)
                output = content(table)
                rows.append((doc_id, n, form, prefix, middle, digest(table), digest(restore(output, form)), output))
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(columns[i], pa.binary()).cast(pa.string()) if f.name == "output" else pa.array(columns[i], f.type) for i, f in enumerate(schema)], schema=schema)

    return transform


def fill_in_middle(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", settings: FimSettings | None = None, with_output: bool = True) -> DataFrame:
    """A row per row of ``docs``: doc_id, n, form, prefix_chars, middle_chars, the digests of the output and of the text that
    is rebuilt from it, and (``with_output``) the output. Each row is made in the task that reads it: nothing is shuffled."""
    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string" + ", output string" * with_output
    return given.mapInArrow(_transformer(settings or FimSettings(), with_output), schema)


def restored(outputs: DataFrame) -> DataFrame:
    """doc_id and text of every row of ``fill_in_middle``'s result."""

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "output"):
            texts = [content(restore(output.encode(), form)) for form, output in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "text"])

    return outputs.select("doc_id", "form", "output").mapInArrow(rebuild, "doc_id long, text string")
