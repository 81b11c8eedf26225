"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages (``passage`` words each, whole texts). Every passage is
encoded from its text alone: shares of character classes, word shapes, repetition, and a
signed hash of its words; a learned layer makes an embedding of that. Gated attention,
``softmax(w . (tanh(V h) * sigmoid(U h)))``, weighs the passages, and the weighted embedding is
scored by a logistic unit. Document labels are all that training sees.

Training takes at most ``sample`` labelled documents (half of each label where there are as
many), the ones with the smallest hash of their id, and of each ``train_passages`` passages at
most, evenly spread over the document: a documented bound on what the one task that fits gets. They
are sorted there, so runs give the same weights however rows are dealt; the weights go to the driver. Encoding and scoring
are independent by row and cover all passages of all rows, whatever a text's length.

Defined cases: null text counts as empty, and an empty text is one empty passage; labels
other than 0 and 1 and null ids are ignored, of several labels of an id the smallest counts, of
several texts of an id the one of the smallest hash trains; without both labels every score is 0.5; repeated rows are scored alike; an empty table
gives an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, text_buffer, text_or_empty, word_hashes, words

HASHED = 64
SHAPES = 14
FEATURES = SHAPES + HASHED


@dataclass(frozen=True)
class AttentionSettings:
    """``passage``: words; ``sample``: labelled documents that training may take at most; ``train_passages``: of each of them."""

    passage: int = 100
    sample: int = 4000
    train_passages: int = 64
    width: int = 16
    epochs: int = 250
    rate: float = 0.02
    decay: float = 1e-4
    seed: int = 11


def held_out(doc_id: Column) -> Column:
    """True for rows whose labels training never sees."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "symbol": b"#*$%&|<>", "exclaim": b"!?", "stop": b".,;:", "other": b"\"'()[]{}+=/\\_-~^@`",
}


def encode_passages(raw: np.ndarray, offsets: np.ndarray, passage: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of all passages, and the first passage of each text (every text has one at least)."""
    starts, ends, counts = words(raw, offsets)
    per_row = np.maximum(1, -(-counts // passage))
    first = np.concatenate([[0], np.cumsum(per_row)])
    n = int(first[-1])
    x = np.zeros((n, FEATURES), np.float32)
    if not len(starts):
        return x, first
    place = np.arange(len(starts)) - np.repeat(np.cumsum(counts) - counts, counts)
    owner = np.repeat(first[:-1], counts) + place // passage
    size = np.bincount(owner, minlength=n).astype(float)
    held = np.maximum(size, 1)
    # bytes of a passage run from its first word to the next passage's first (or the text's end)
    length = (ends - starts).astype(float)
    chars = np.maximum(np.bincount(owner, weights=length, minlength=n), 1)
    begins = np.searchsorted(owner, np.arange(n))
    some = size > 0
    from_ = np.where(some, starts[np.minimum(begins, len(starts) - 1)], 0)
    to = np.where(some, ends[np.maximum(np.searchsorted(owner, np.arange(n), side="right") - 1, 0)], 0)

    def share(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask)])
        return (sums[to] - sums[from_]) / chars

    for i, kind in enumerate(_CLASSES.values()):
        table = np.zeros(256, bool)
        table[list(kind)] = True
        x[:, i] = share(table[raw])
    x[:, 6] = share(raw >= 128)
    x[:, 7] = share(raw == 10)
    x[:, 8] = np.log1p(size) / np.log1p(passage)
    x[:, 9] = np.where(some, chars / held / 10, 0)  # an empty passage is all zeros, whatever comes with it
    x[:, 10] = np.sqrt(np.maximum(np.bincount(owner, weights=length**2, minlength=n) / held - (chars / held) ** 2, 0)) / 10
    x[:, 11] = np.bincount(owner, weights=length <= 3, minlength=n) / held
    h = word_hashes(raw, starts, ends, seed=3)
    order = np.lexsort((h, owner))
    same = (h[order][1:] == h[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    x[:, 12] = np.bincount(owner[order][1:], weights=same, minlength=n) / held
    near = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    x[:, 13] = np.bincount(owner[1:], weights=near, minlength=n) / held
    slot = owner * HASHED + (h % np.uint64(HASHED)).astype(np.int64)
    sign = np.where((h >> np.uint64(32)) & np.uint64(1), 1.0, -1.0)
    x[:, SHAPES:] = (np.bincount(slot, weights=sign, minlength=n * HASHED).reshape(n, HASHED) / np.sqrt(held)[:, None])
    return x, first


@dataclass
class AttentionModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def bags(self, x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Probability of label 1 for every bag, and what the gradient needs."""
        w = self.weights
        at, sizes = first[:-1], np.diff(first)
        z = (x - self.mean) / self.scale
        h = np.tanh(z @ w["E"] + w["e"])
        tv, su = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        a = (tv * su) @ w["w"]
        a = np.exp(a - np.repeat(np.maximum.reduceat(a, at), sizes))
        a /= np.repeat(np.add.reduceat(a, at), sizes)
        pooled = np.add.reduceat(a[:, None] * h, at, axis=0)
        p = 1 / (1 + np.exp(-np.clip(pooled @ w["c"] + w["b"], -30, 30)))
        return p, {"z": z, "h": h, "tv": tv, "su": su, "a": a, "pooled": pooled}

    def gradient(self, x: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        p, k = self.bags(x, first)
        sizes = np.diff(first)
        g = (p - y) * weight / weight.sum()
        spread = np.repeat(g[:, None] * w["c"], sizes, axis=0)
        da = (spread * k["h"]).sum(axis=1)
        da = k["a"] * (da - np.repeat(np.add.reduceat(k["a"] * da, first[:-1]), sizes))
        dg = da[:, None] * w["w"]
        dv, du = dg * k["su"] * (1 - k["tv"] ** 2), dg * k["tv"] * k["su"] * (1 - k["su"])
        dh = (k["a"][:, None] * spread + dv @ w["V"].T + du @ w["U"].T) * (1 - k["h"] ** 2)
        return {
            "c": k["pooled"].T @ g, "b": np.array(g.sum()), "w": (k["tv"] * k["su"]).T @ da, "V": k["h"].T @ dv, "U": k["h"].T @ du, "E": k["z"].T @ dh, "e": dh.sum(axis=0),
        }


def fit(x: np.ndarray, first: np.ndarray, y: np.ndarray, settings: AttentionSettings) -> AttentionModel:
    """Adam on the class-balanced log loss of whole bags."""
    rng, d, n = np.random.default_rng(settings.seed), settings.width, x.shape[1]
    model = AttentionModel(x.mean(axis=0), x.std(axis=0) + 1e-3, {
        "E": rng.normal(0, 1 / np.sqrt(n), (n, d)), "e": np.zeros(d), "V": rng.normal(0, 0.3, (d, d)), "U": rng.normal(0, 0.3, (d, d)),
        "w": rng.normal(0, 0.3, d), "c": rng.normal(0, 0.3, d), "b": np.array(0.0),
    })
    share = y.mean()
    weight = np.where(y == 1, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9))
    m = {k: np.zeros_like(v) for k, v in model.weights.items()}
    s = {k: np.zeros_like(v) for k, v in model.weights.items()}
    for step in range(1, settings.epochs + 1):
        for k, g in model.gradient(x, first, y, weight).items():
            g = g + settings.decay * model.weights[k]
            m[k] = 0.9 * m[k] + 0.1 * g
            s[k] = 0.999 * s[k] + 0.001 * g * g
            model.weights[k] = model.weights[k] - settings.rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
    return model


def _passages(passage: int, most: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            x, first = encode_passages(*text_buffer(part.column(3)), passage)
            blobs = [x[np.unique(np.linspace(i, j - 1, min(j - i, most)).astype(int))].tobytes() for i, j in zip(first[:-1], first[1:])]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(blobs, pa.binary())], names=["id", "t", "y", "passages"])

    return make


def _fitter(settings: AttentionSettings):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(x for b in batches for x in zip(*(c.to_pylist() for c in b.columns)))
        y = np.array([r[1] for r in rows], float)
        if len(y) and y.min() < y.max():
            bags = [np.frombuffer(r[2], np.float32).reshape(-1, FEATURES) for r in rows]
            first = np.concatenate([[0], np.cumsum([len(b) for b in bags])])
            model = fit(np.concatenate(bags).astype(float), first, y, settings)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    return make


def _scorer(shared, passage: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for part in slices(batches, "text"):
            if model is None:
                p = np.full(part.num_rows, 0.5)
            else:
                p, _ = model.bags(*encode_passages(*text_buffer(part.column(2)), passage))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(p, pa.float64())], names=["doc_id", "held_out", "score"])

    return score


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", settings: AttentionSettings | None = None) -> AttentionModel | None:
    settings = settings or AttentionSettings()
    lab = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("y"))
    half = settings.sample // 2
    picked = [lab.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(half) for y in (0, 1)]
    chosen = picked[0].unionByName(picked[1]).withColumnRenamed("doc_id", "__id")
    value = text_or_empty(text)
    texts = docs.join(F.broadcast(chosen), F.col(f"`{doc_id}`") == chosen["__id"]).select(F.col("__id").alias("id"), F.xxhash64(value).alias("t"), F.col("y").cast("int").alias("y"), value.alias("text"))  # ``sample`` ids at most
    encoded = texts.mapInArrow(_passages(settings.passage, settings.train_passages), "id long, t long, y int, passages binary")
    once = encoded.groupBy("id").agg(F.min(F.struct("t", "y", "passages")).alias("r")).select("id", "r.y", "r.passages").repartition(1)
    found = once.mapInArrow(_fitter(settings), "model binary").first()  # ``sample`` rows at most come together
    return pickle.loads(found.model) if found else None


def quality_scores(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", settings: AttentionSettings | None = None) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``."""
    settings = settings or AttentionSettings()
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, text, doc_id, settings))
    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), text_or_empty(text).alias("text"))
    scored = given.mapInArrow(_scorer(shared, settings.passage), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
