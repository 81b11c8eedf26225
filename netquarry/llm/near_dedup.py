"""Near-duplicate classes by DartMinHash signatures, banding and verified links.

Every element (a word shingle) weighs what it counts in its text. One of weight w owns the region ``[0, w) x time``. Darts fall
on it as a Poisson process that is a pure function of the element: cells of the region
(unit strips of weight, doubling slabs of time) draw their number of darts, times and
coordinates from a hash. A signature keeps the earliest dart of each of its coordinates, so
two texts agree in a coordinate with probability equal to their weighted Jaccard
similarity (sum of the smaller counts over sum of the larger ones). Texts whose bands agree
are candidates; links are verified on all counted shingles, so banding decides speed and recall
only. The i-th occurrence of a shingle is an element of its own there, which makes weighted
similarity that of plain sets.

No bucket is expanded into all its pairs. Every candidate carries a bitmap in which each
shingle flips one bit, so the bits in which two bitmaps differ are at most the shingles in
which the texts differ: pairs that this rules out are never made, and none that is a link is
lost by it. A bucket's members are held against a leader, linked texts are contracted to
components, and after a second leader only members of different components that the
bitmaps still allow are held against each other: a bucket is cut into bounded chunks, every pair of
chunks is a group of its own (so one bucket is many tasks), and a group returns the links of a
forest that joins its components, never its pairs.

Defined cases: a text of one to four words is one shingle; null, empty and blank texts have
no shingles and stand alone (class_key null); texts with equal word sequences are one text; class_id is
the smallest doc_id of the class (null only if all ids are null), and as ids may repeat over
different texts, class_key names a class by that id and the fingerprint of its first text;
repeated rows are all returned; texts of any length are taken whole (memory is a few times the
longest one); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, mix64, slices, text_buffer, text_or_empty, word_hashes, words

SHINGLE_WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 4

BITMAP = 1024

_BASE_SLAB = 0.125


def shingles(raw: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes (sorted in each row), their rows and counts, and a 128-bit fingerprint of each row's words."""
    starts, ends, counts = words(raw, offsets)
    h = word_hashes(raw, starts, ends)
    rows = len(counts)
    stop = np.cumsum(counts)
    place = np.arange(len(h)) - np.repeat(stop - counts, counts)
    print_a, print_b = np.zeros(rows, np.uint64), np.zeros(rows, np.uint64)
    some = counts > 0
    if len(h):
        at = (stop - counts)[some]
        p = place.astype(np.uint64)
        print_a[some] = np.add.reduceat(mix64(h ^ mix64(p + np.uint64(11))), at)
        print_b[some] = np.add.reduceat(mix64(h + mix64(p ^ np.uint64(0x5BF03635))), at)
    per_row = np.where(some, np.maximum(counts - size + 1, 1), 0)
    row = np.repeat(np.arange(rows), per_row)
    first = np.arange(len(row)) - np.repeat(np.cumsum(per_row) - per_row, per_row) + np.repeat(stop - counts, per_row)
    out = np.zeros(len(row), np.uint64)
    limit = stop[row]
    for j in range(size):
        at = first + j
        inside = at < limit
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + np.where(inside, h[np.minimum(at, len(h) - 1)] if len(h) else 0, np.uint64(j)))
    order = np.lexsort((out, row))
    out, row = out[order], row[order]
    fresh = np.ones(len(out), bool)
    fresh[1:] = (out[1:] != out[:-1]) | (row[1:] != row[:-1])
    counted = np.diff(np.flatnonzero(np.append(fresh, True)))
    return out[fresh], row[fresh], counted, print_a, print_b


def occurrences(element: np.ndarray, row: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An element for each occurrence of a shingle, sorted in each row."""
    turn = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    out, rows = np.repeat(element, count) ^ (mix64(turn.astype(np.uint64)) * (turn > 0).astype(np.uint64)), np.repeat(row, count)
    order = np.lexsort((out, rows))
    return out[order], rows[order]


def _poisson_steps(mean: float) -> np.ndarray:
    term, total, steps = np.exp(-mean), 0.0, []
    for n in range(1, 24):
        total += term
        steps.append(total)
        term *= mean / n
    return np.array(steps)


def dart_signatures(elements: np.ndarray, rows: np.ndarray, n_rows: int, coordinates: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Signature (``coordinates`` 64-bit dart ids) of each row; zeros where a row has no elements.

    ``rows`` must be sorted. Weights may be any positive numbers (1 where not given): whole
    units of weight are strips of their own, and the last strip drops darts above its part.
    """
    part, thin = np.ones(len(rows)), False
    if weights is not None:
        many = np.ceil(weights).astype(np.int64)
        strip = (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)).astype(np.uint64)
        elements, rows = np.repeat(elements, many), np.repeat(rows, many)
        part = np.minimum(np.repeat(weights, many) - strip, 1.0)
        thin = bool((part < 1).any())
        elements = elements ^ (strip * np.uint64(0xD1B54A32D192ED03))
    signature = np.zeros(n_rows * coordinates, np.uint64)
    filled = np.zeros(n_rows * coordinates, bool)
    todo = np.zeros(n_rows, bool)
    todo[rows] = True
    live = np.arange(len(rows))
    low, width, slab = 0.0, _BASE_SLAB, 0
    while len(live):
        cells = max(1, int(width))
        steps = _poisson_steps(width / cells)
        e, r, top = elements[live], rows[live], part[live]
        cell = np.zeros(len(e), np.uint64)
        if cells > 1:
            cell = np.tile(np.arange(cells, dtype=np.uint64), len(e))
            e, r, top = np.repeat(e, cells), np.repeat(r, cells), np.repeat(top, cells)
        seed = mix64(e ^ mix64(cell * np.uint64(4096) + np.uint64(slab + 1)))
        u = (seed >> np.uint64(11)) * (2.0**-53)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for n, step in enumerate(steps):
            hit = np.flatnonzero(u >= step)
            if not len(hit):
                break
            seed, u, r, cell, top = seed[hit], u[hit], r[hit], cell[hit], top[hit]
            dart = mix64(seed + np.uint64((n + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            time = low + (cell + (dart & np.uint64(0xFFFFFFFF)) * 2.0**-32) * (width / cells)
            spot = ((dart >> np.uint64(32)) * np.uint64(coordinates)) >> np.uint64(32)
            kept = slice(None)
            if thin:
                kept = (mix64(dart) >> np.uint64(11)) * 2.0**-53 < top
            found.append((r[kept] * coordinates + spot[kept].astype(np.int64), time[kept], dart[kept]))
        if found:
            slot, time, dart = (np.concatenate(x) for x in zip(*found))
            open_ = ~filled[slot]
            slot, time, dart = slot[open_], time[open_], dart[open_]
            order = np.argsort(-time, kind="stable")
            signature[slot[order]] = dart[order]  # the last, and so the earliest dart stays
            filled[slot] = True
        low += width
        width = low
        slab += 1
        todo &= ~filled.reshape(n_rows, coordinates).all(axis=1)
        live = live[todo[rows[live]]]
    return signature.reshape(n_rows, coordinates)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F), (len(signature), bands))
    parts = signature.reshape(len(signature), bands, rows)
    for j in range(rows):
        out = mix64(out ^ parts[:, :, j])
    return out


def _signer(size: int, bands: int, rows: int):
    schema = pa.schema([("doc_id", pa.int64()), ("t", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            element, row, count, a, b = shingles(*text_buffer(part.column(1)), size)
            n = part.num_rows
            keys = band_keys(dart_signatures(element, row, n, bands * rows, count), bands, rows)
            has = np.zeros(n, bool)
            has[row] = True
            at = np.concatenate([[0], np.cumsum(has * bands)]).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(at), pa.array(keys[has].ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), listed], schema=schema)

    return sign


def _set_maker(size: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            element, row, count, _, _ = shingles(*text_buffer(part.column(1)), size)
            element, row = occurrences(element, row, count)
            ends = np.searchsorted(row, np.arange(part.num_rows + 1))
            blobs = [element[i:j].tobytes() for i, j in zip(ends[:-1], ends[1:])]
            flips = np.zeros((part.num_rows, BITMAP), np.uint8)
            np.bitwise_xor.at(flips, (row, (element % np.uint64(BITMAP)).astype(np.int64)), 1)
            maps = np.packbits(flips, axis=1).view(np.int64)
            listed = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1) * maps.shape[1], pa.int32()), pa.array(maps.ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(ends), pa.int64()), listed, pa.array(blobs, pa.binary())], names=["node", "n", "map", "shingles"])

    return sets


def _similar(p: np.ndarray, q: np.ndarray, threshold: float) -> bool:
    """If two sorted sets share ``threshold`` of their union."""
    if min(len(p), len(q)) < threshold * max(len(p), len(q)) - 1e-9:
        return False
    at = np.searchsorted(q, p)
    common = int((q[np.minimum(at, len(q) - 1)] == p).sum())
    return common >= threshold * (len(p) + len(q) - common) - 1e-9


def _verifier(threshold: float):
    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                if _similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), threshold):
                    keep.append(i)
            yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))

    return similar


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in ``links`` (u, v), component being its smallest node.

    Each round hooks nodes to their smallest neighbour, shortens the paths twice, and goes on
    with the contracted edges; a table is written each round, so lineage stays short.
    """
    edges = materialize(links.where("u <> v").select("u", "v").distinct(), "edges")
    total = None
    while True:
        old = [edges, total]
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        nearest = parent = materialize(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("p")), "parents")
        for _ in range(2):
            up = parent.select(F.col("u").alias("p"), F.col("p").alias("pp"))
            parent = parent.join(up, "p", "left").select("u", F.coalesce("pp", "p").alias("p"))
        parent = materialize(parent, "parents")
        step = parent.select(F.col("u").alias("component"), "p")
        total = parent.select(F.col("u").alias("node"), F.col("p").alias("component")) if total is None else (
            total.join(step, "component", "left").select("node", F.coalesce("p", "component").alias("component"))
        )
        pu, pv = parent.select("u", F.col("p").alias("pu")), parent.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        edges = materialize(
            edges.join(pu, "u").join(pv, "v").where("pu <> pv").select(F.col("pu").alias("u"), F.col("pv").alias("v")).distinct(), "edges"
        )
        total = materialize(total, "components")
        discard(nearest, parent, *[x for x in old if x is not None])
        if edges.isEmpty():
            discard(edges)
            return total


def _row_key(doc_id: Column) -> Column:
    """Order of rows by id (nulls last), then by the hash of their text."""
    return F.struct(doc_id.isNull().alias("none"), doc_id.alias("doc_id"), F.col("t").alias("t"))


def classified(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD, size: int = SHINGLE_WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, t (hash of the text) and ``first``, the (none, doc_id, t) of the first row of its class, of every
    row; null for a text without words. Equal (doc_id, t) are equal rows but for other columns."""
    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text")).withColumn("t", F.xxhash64("text"))
    signed = materialize(given.mapInArrow(_signer(size, bands, rows), "doc_id long, t long, a long, b long, bands array<long>"), "signatures")
    texts = materialize(
        signed.where(F.size("bands") > 0).groupBy("a", "b").agg(F.min(_row_key(F.col("doc_id"))).alias("first"), F.any_value("bands").alias("bands"))
        .withColumn("node", F.monotonically_increasing_id()), "texts",
    )
    keyed = texts.select("node", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    members = materialize(keyed.join(shared, "key"), "buckets")
    shapes = _candidate_sets(texts, members, given, size)
    buckets = materialize(members.join(shapes.select("node", "n", "map"), "node").select("key", "node", "n", "map"), "buckets")
    # a leader, another one, then whatever may still join two components
    links = materialize(_checked(_leader_pairs(buckets.withColumn("component", F.col("node")), 0, threshold), shapes, threshold), "links")
    found = components(links)
    apart = _apart(buckets, found)
    for more_of in (lambda rows: _checked(_leader_pairs(rows, 1, threshold), shapes, threshold), lambda rows: _remaining(rows, shapes, threshold)):
        more = materialize(more_of(apart), "links")
        if not more.isEmpty():
            links = links.unionByName(more)
            discard(found, apart)
            found = components(links)
            apart = _apart(buckets, found)
    discard(members, buckets, shapes, apart)
    classes = texts.join(found, "node", "left").select("a", "b", "first", F.coalesce("component", "node").alias("component"))
    names = classes.groupBy("component").agg(F.min("first").alias("first"))
    named = classes.select("a", "b", "component").join(names, "component").select("a", "b", "first")
    return signed.drop("bands").join(named, ["a", "b"], "left").select("doc_id", "t", "first")


def near_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """doc_id, class_id and class_key of every row of ``docs``; rows of one class are near duplicates, linked step by step."""
    found = classified(docs, text, doc_id, **options)
    key = F.concat_ws(":", F.coalesce(F.col("first.doc_id").cast("string"), F.lit("null")), F.hex("first.t"))
    return found.select(
        "doc_id", F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_id"), F.when(F.col("first").isNotNull(), key).alias("class_key")
    )


def _candidate_sets(texts: DataFrame, buckets: DataFrame, given: DataFrame, size: int) -> DataFrame:
    """Shingle sets of texts that share a bucket (few of all): (node, shingles)."""
    wanted = texts.join(buckets.select("node").distinct(), "node").select("node", "first.doc_id", "first.t")
    same = given["doc_id"].eqNullSafe(wanted["doc_id"]) & (given["t"] == wanted["t"])
    found = given.join(wanted, same).select(wanted["node"], wanted["t"], "text").dropDuplicates(["node", "t"])
    return materialize(found.select("node", "text").mapInArrow(_set_maker(size), "node long, n long, map array<long>, shingles binary"), "shingle-sets")


def _apart(buckets: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of the buckets that hold more than one component."""
    known = buckets.join(found, "node", "left").select("key", "node", "n", "map", F.coalesce("component", "node").alias("component"))
    mixed = known.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
    return materialize(known.join(mixed, "key"), "apart")


_MEMBER = ("node", "n", "map", "component")


def _possible(x: str, y: str, threshold: float) -> Column:
    """If two texts may reach the threshold: they differ in as many shingles as bits at least."""
    apart = reduce(lambda a, b: a + b, [F.bit_count(F.get(f"map_{x}", F.lit(i)).bitwiseXOR(F.get(f"map_{y}", F.lit(i)))) for i in range(BITMAP // 64)])
    return apart <= (F.col(f"n_{x}") + F.col(f"n_{y}")) * F.lit((1 - threshold) / (1 + threshold)) + 1e-9


CHUNK, CHUNK_SHINGLES = 1024, 1 << 23


def _joined_apart(threshold: float):
    """Links that join the components of two chunks of a bucket: pairs in order of their bitmaps' distance, each
    verified unless its sides are joined already, so what comes out is a forest and not all pairs."""

    def compare(table: pa.Table) -> pa.Table:
        t = table.combine_chunks()
        chunk, node, component, n = (t.column(c).to_numpy() for c in ("chunk", "node", "component", "n"))
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("shingles")]
        maps = np.asarray(t.column("map").combine_chunks().flatten()).view(np.uint64).reshape(len(node), -1)
        parent = {int(c): int(c) for c in component}

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        within = bool((chunk == chunk[0]).all())
        links = []
        for i in range(len(node)):
            others = np.flatnonzero((chunk > chunk[i]) | (within & (np.arange(len(node)) > i)))
            apart = np.bitwise_count(maps[others] ^ maps[i]).sum(axis=1)
            allowed = np.flatnonzero((apart <= (n[others] + n[i]) * ((1 - threshold) / (1 + threshold)) + 1e-9) & (component[others] != component[i]))
            for j in others[allowed[np.argsort(apart[allowed], kind="stable")]].tolist():
                a, b = root(int(component[i])), root(int(component[j]))
                if a != b and _similar(sets[i], sets[j], threshold):
                    parent[a] = b
                    links.append((int(min(node[i], node[j])), int(max(node[i], node[j]))))
        return pa.table({"u": pa.array([x[0] for x in links], pa.int64()), "v": pa.array([x[1] for x in links], pa.int64())})

    return compare


def _remaining(members: DataFrame, shapes: DataFrame, threshold: float) -> DataFrame:
    """Links between the components that share a bucket still. A bucket is cut into chunks by a hash, bounded in members
    and in shingles, and each pair of chunks is a group of its own: a member is copied once per chunk, and no pair is a row."""
    sizes = members.groupBy("key").agg(F.ceil(F.greatest(F.count(F.lit(1)) / CHUNK, F.sum("n") / CHUNK_SHINGLES)).cast("int").alias("chunks"))
    rows = members.join(sizes, "key").withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(2)), F.col("chunks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.join(shapes.select("node", "shingles"), "node")
    groups = rows.select("key", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "chunk", "node", "component", "n", "map", "shingles")
    return groups.groupBy("key", "low", "high").applyInArrow(_joined_apart(threshold), "u long, v long").distinct()


def _leader_pairs(members: DataFrame, turn: int, threshold: float) -> DataFrame:
    """Each member with its bucket's leader, where they are not of one component yet and a link is possible."""
    # the first leader is one text for all its buckets, later ones differ by bucket
    order = F.struct((F.xxhash64("node", F.lit(turn), "key") if turn else F.xxhash64("node")).alias("h"), *[F.col(c).alias(c) for c in _MEMBER])
    leaders = members.groupBy("key").agg(F.min(order).alias("leader")).select(
        F.col("key").alias("leader_key"), *[F.col(f"leader.{c}").alias(f"{c}_y") for c in _MEMBER]
    )
    x = members.select("key", *[F.col(c).alias(f"{c}_x") for c in _MEMBER])
    joined = x.join(leaders, (F.col("key") == F.col("leader_key")) & (F.col("component_x") != F.col("component_y")) & _possible("x", "y", threshold))
    return joined.select(F.least("node_x", "node_y").alias("u"), F.greatest("node_x", "node_y").alias("v")).distinct()


def _checked(pairs: DataFrame, shapes: DataFrame, threshold: float) -> DataFrame:
    u = shapes.select(F.col("node").alias("u"), F.col("shingles").alias("x"))
    v = shapes.select(F.col("node").alias("v"), F.col("shingles").alias("y"))
    return pairs.join(u, "u").join(v, "v").select("u", "v", "x", "y").mapInArrow(_verifier(threshold), "u long, v long")


def keep_first(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """Rows of ``docs`` less all but one of each class, with exactly its columns.

    Rows are told apart by id and text, so ids may repeat or be null: the first row of a class stays (by
    id, nulls last, then by the text's hash; one of them where the whole row key repeats), texts without words stay.
    """
    classes = materialize(classified(docs, text, doc_id, **options), "classes")
    own = classes.where("first is not null").select("doc_id", "t", (F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.t") == F.col("t"))).alias("is_first"))
    keys = own.groupBy("doc_id", "t").agg(F.max("is_first").alias("is_first"), F.count(F.lit(1)).alias("n"))
    keys = materialize(keys.where("not is_first or n > 1").select(F.col("doc_id").alias("__k_id"), F.col("t").alias("__k_t"), "is_first"), "row-keys")
    mark = docs.withColumn("__t", F.xxhash64(text_or_empty(text)))
    id_ = F.col(f"`{doc_id}`").cast("long")

    def on(table: DataFrame) -> Column:
        return (F.col("__t") == F.col("__k_t")) & id_.eqNullSafe(F.col("__k_id"))

    others, again = keys.where("not is_first").drop("is_first"), keys.where("is_first").drop("is_first")
    if again.isEmpty():
        return mark.join(others, on(others), "left_anti").drop("__t")
    once = mark.join(keys.drop("is_first"), on(keys), "left_anti").drop("__t")
    # equal row keys: one row of each, whichever of its other columns
    repeated = mark.join(again, on(again), "left_semi").withColumn("__id", id_).dropDuplicates(["__id", "__t"]).drop("__id", "__t")
    return once.unionByName(repeated)
