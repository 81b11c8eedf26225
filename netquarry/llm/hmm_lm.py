"""Language-model scores from a hidden Markov model over word classes.

Text is a sequence of lower-cased (A-Z) words and one end token. A word's class is itself
for the most frequent words and a hash of its last bytes for the rest, so the number of
classes is a parameter while the vocabulary is not bounded. The model is
``P(text) = P(classes under the HMM) * prod P(word | class)``, with add-one estimates of
``P(word | class)`` and one unknown word in every class of rarer words.

Training is Baum-Welch: each task runs the scaled forward and backward recursions over its
whole texts and returns expected counts, one row per model cell and task; their sums give the
next model. Scores run the exact forward recursion over whole texts, too. Long texts run as
stretches side by side: their transfer matrices are chained, which gives each stretch what comes
before it (and, in training, what comes after), so a step across a border counts like any other.

Word counts are one aggregation over all training words. The most frequent
``local_words`` are looked up inside tasks; every other word meets its count by a join, so
no table grows with the vocabulary outside Spark. A text sends each of its rarer words once, with its count.

Defined cases: null text counts as empty (an end token only); a null doc_id is in training;
repeated rows count once each; a text of any length is one sequence; without training rows every word is unknown; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, slices, text_or_empty


@dataclass(frozen=True)
class HmmSettings:
    """``own_words`` and ``suffix_classes`` make the classes; ``local_words`` counts are sent to tasks
    (a bound, whatever the vocabulary); ``rounds`` of Baum-Welch over all training texts."""

    states: int = 5
    own_words: int = 2000
    suffix_classes: int = 512
    local_words: int = 100_000
    rounds: int = 5
    stretch: int = 512
    smoothing: float = 0.5
    seed: int = 7


def held_out(doc_id: Column) -> Column:
    """True for the rows that training leaves out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))


END = ""  # no word is empty
_SLICE = 1 << 21  # bytes of text that a task looks at together


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased words of all texts in a row, and how many each text has (Arrow's kernels: only A-Z and the ASCII blanks)."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    offsets, flat = lists.offsets.to_numpy(), lists.flatten()  # blanks at either end of a text leave empty words
    filled = pc.greater(pc.binary_length(flat), 0)
    upto = np.concatenate([[0], np.cumsum(filled.to_numpy(zero_copy_only=False))])
    return flat.filter(filled), np.diff(upto[offsets - offsets[0]])


def _word_counter(batches: Iterator[pa.RecordBatch], most: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Counts of words, flushed whenever the table of a task has more than ``most``."""

    def merged() -> pa.Table:
        return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")]).select(["word", "n_sum"]).rename_columns(["word", "n"])

    held, size = [], 0
    for part in slices(batches, "text", _SLICE):
        words, _ = _words(part.column(0))
        found = words.value_counts()
        held.append(pa.table([found.field(0), found.field(1)], names=["word", "n"]))
        held.append(pa.table([pa.array([END], words.type), pa.array([part.num_rows], pa.int64())], names=["word", "n"]))
        size += len(found) + 1
        if size > 2 * most:
            held = [merged()]
            size = held[0].num_rows
            if size > most:
                yield from held[0].to_batches()
                held, size = [], 0
    if held:
        yield from merged().to_batches()


def word_counts(texts: DataFrame) -> DataFrame:
    """word, c over all rows (column text); the end token is the empty word."""
    return texts.select("text").mapInArrow(_word_counter, "word string, n long").groupBy("word").agg(F.sum("n").alias("c"))


def _most_frequent(counts: DataFrame, most: int) -> list:
    """The words whose count is above the least that lets ``most`` of them at most through, most frequent first.

    The limit comes from how many words have each count, so no task sends its own top words.
    """
    steps = counts.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    # a row per distinct count: k of them take k^2/2 tokens at least, so ten trillion tokens have under five million
    steps = steps.withColumn("upto", F.sum("n").over(Window.orderBy(F.desc("c"))))
    least = steps.where(F.col("upto") <= most).agg(F.min("c")).first()[0]
    if least is None:
        return []
    return sorted(counts.where(F.col("c") >= least).collect(), key=lambda r: (-r.c, r.word))


_TAIL = 3  # bytes


def _suffix_class(word: bytes, classes: int) -> int:
    return zlib.crc32(word[-_TAIL:]) % classes


@dataclass
class Vocabulary:
    """What tasks need: local words with class and log10(c + 1), and the log sizes of the suffix classes."""

    words: pa.Array
    code: np.ndarray
    log_count: np.ndarray
    log_size: np.ndarray  # by class: log10 of the class's words and types, 0 for a word's own class
    own: int
    suffixes: int

    @property
    def classes(self) -> int:
        return self.own + self.suffixes


def _encoder(shared, schema: pa.Schema):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = shared.value
        for part in slices(batches, "text", _SLICE):
            words, lengths = _words(part.column(3))
            coded = words.dictionary_encode()
            # everything is looked up once a distinct word; the end token is the last of them
            distinct = pa.concat_arrays([coded.dictionary, pa.array([END], words.type)])
            at = pc.index_in(distinct, value_set=v.words.cast(words.type)).fill_null(-1).to_numpy()
            hit = at >= 0
            code = v.code[at] if len(v.code) else np.zeros(len(at), np.uint16)
            tails = pc.binary_slice(distinct.filter(pa.array(~hit)).cast(pa.binary()), -_TAIL).dictionary_encode()
            classes = np.array([v.own + _suffix_class(tail, v.suffixes) for tail in tails.dictionary.to_pylist()], np.uint16)
            code[~hit] = classes[tails.indices.to_numpy()]
            log_c = np.where(hit, v.log_count[at], 0.0) if len(v.code) else np.zeros(len(at))
            # within its class: log10(c + 1) of words without a class of their own, less the class's size
            log_n = np.where(code >= v.own, log_c, 0.0) - v.log_size[code]
            ends = np.cumsum(lengths + 1)
            tokens, inner = np.full(ends[-1], len(distinct) - 1), np.ones(ends[-1], bool)
            inner[ends - 1] = False
            tokens[inner] = coded.indices.to_numpy()
            starts = ends - lengths - 1
            by_text = lambda values: np.add.reduceat(values[tokens], starts)
            out = np.flatnonzero(~hit[tokens])
            text = np.searchsorted(ends, out, side="right")
            pairs, times = np.unique(text * len(distinct) + tokens[out], return_counts=True)
            rare = distinct.take(pa.array(pairs % len(distinct)))
            upto = np.searchsorted(pairs, np.arange(part.num_rows + 1) * len(distinct))
            codes = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(np.concatenate([[0], ends * 2]).astype(np.int32)), pa.py_buffer(code[tokens].astype("<u2"))])
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), part.column(2), *(pa.array(x, pa.int64()) for x in (lengths + 1, by_text(hit.astype(np.int64)))), *(pa.array(by_text(x), pa.float64()) for x in (log_c, log_n)),
                 codes, *(pa.ListArray.from_arrays(pa.array(upto, pa.int32()), x) for x in (rare.cast(pa.string()), pa.array(times, pa.int64())))],
                schema=schema,
            )

    return encode


_ENCODED = "uid long, doc_id long, held_out boolean, n_tokens long, known long, log_c double, log_n double, codes binary, rare array<string>, times array<long>"
_ENCODED_ARROW = pa.schema([
    ("uid", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()),
    ("log_c", pa.float64()), ("log_n", pa.float64()), ("codes", pa.binary()), ("rare", pa.list_(pa.string())), ("times", pa.list_(pa.int64())),
])


@dataclass
class Hmm:
    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray


def _time_major(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the tokens of sequences (longest first) by place, and where each place starts."""
    active = np.searchsorted(-lengths, -np.arange(1, lengths.max() + 1), side="right")
    at = np.concatenate([[0], np.cumsum(active)])
    sequence = np.arange(at[-1]) - np.repeat(at[:-1], active)
    order = (np.cumsum(lengths) - lengths)[sequence] + np.repeat(np.arange(len(active)), active)
    return order, active, at


def _stretches(sequences: list[np.ndarray], stretch: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Stretches of all sequences in order, the sequence of each, and if it is that sequence's first."""
    pieces, owner, lead = [], [], []
    for i, s in enumerate(sequences):
        for j in range(0, len(s), stretch):
            pieces.append(s[j : j + stretch])
            owner.append(i)
            lead.append(j == 0)
    return pieces, np.array(owner), np.array(lead, bool)


_RESCALE = 8  # a step weighs 1e-12 at least, so nothing vanishes in between


def _sweep(pieces: list[np.ndarray], before: np.ndarray, hmm: Hmm) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the states after each piece, scaled by one number a piece, and the natural log of that.

    ``before`` (k, or m x k) holds what comes before a first token: a law of the state that emits it, or m of them, whose
    weights stay apart. States are rows here, so that numpy's inner loops run over pieces.
    """
    k = len(hmm.start)
    lengths = np.array([len(p) for p in pieces])
    rank = np.argsort(-lengths, kind="stable")
    order, active, at = _time_major(lengths[rank])
    e = hmm.emit.take(np.concatenate([pieces[i] for i in rank])[order], axis=1)
    back = np.ascontiguousarray(hmm.step.T)
    state, logs = before.reshape(-1, k)[:, :, None] * e[:, : at[1]], np.zeros(len(pieces))
    for t in range(1, len(active)):
        n = active[t]
        a = back @ state[:, :, :n]
        a *= e[:, at[t] : at[t + 1]]
        if t % _RESCALE == 0:
            s = a.sum(axis=(0, 1))
            a /= s
            logs[:n] += np.log(s)
        state[:, :, :n] = a
    place = np.empty(len(pieces), np.int64)
    place[rank] = np.arange(len(pieces))
    return state.transpose(2, 0, 1)[place], logs[place]


def _messages(pieces: list[np.ndarray], owner: np.ndarray, lead: np.ndarray, hmm: Hmm) -> tuple[np.ndarray, np.ndarray]:
    """For each stretch: the state's law before it given what came before, and the weight of each state after it by what follows (up to scale)."""
    k = len(hmm.start)
    before, after = np.zeros((len(pieces), k)), np.ones((len(pieces), k))
    later = np.flatnonzero(~lead)
    if len(later):
        first = later[lead[later - 1]] - 1
        end, moves = np.zeros((len(pieces), k)), np.zeros((len(pieces), k, k))
        end[first] = _sweep([pieces[i] for i in first], hmm.start, hmm)[0][:, 0]
        moves[later] = _sweep([pieces[i] for i in later], hmm.step, hmm)[0]
        for i in later.tolist():
            belief = end[i - 1] if lead[i - 1] else before[i - 1] @ moves[i - 1]
            before[i] = belief / belief.sum()
        for i in reversed(later.tolist()):
            weight = moves[i] @ after[i]
            after[i - 1] = weight / weight.sum()
    return before, after


def expected_counts(sequences: list[np.ndarray], hmm: Hmm, stretch: int = 512) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch counts of starts, steps and emissions over whole sequences, and the natural log-likelihood."""
    pieces, owner, lead = _stretches(sequences, stretch)
    before, after = _messages(pieces, owner, lead, hmm)
    rank = np.argsort([-len(p) for p in pieces], kind="stable")
    lengths, first = np.array([len(pieces[i]) for i in rank]), lead[rank]
    order, active, at = _time_major(lengths)
    codes = np.concatenate([pieces[i] for i in rank])[order]
    before, after = before[rank].T, after[rank].T
    # states are rows, so that numpy's inner loops run over stretches
    e, back = hmm.emit.take(codes, axis=1), np.ascontiguousarray(hmm.step.T)
    alpha, scales = np.empty_like(e), {}
    np.multiply(np.where(first, hmm.start[:, None], back @ before), e[:, : at[1]], out=alpha[:, : at[1]])
    for t in range(1, len(active)):
        a = back @ alpha[:, at[t - 1] : at[t - 1] + active[t]]
        a *= e[:, at[t] : at[t + 1]]
        if t % _RESCALE == 0:
            scales[t] = a.sum(axis=0)
            a /= scales[t]
        alpha[:, at[t] : at[t + 1]] = a
    # a stretch's last token starts the way back, with what follows the stretch scaled to belief 1
    beta = np.empty_like(e)
    last = at[lengths - 1] + np.arange(len(lengths))
    ends = alpha[:, last]
    beta[:, last] = after / (ends * after).sum(axis=0)
    steps = np.zeros_like(hmm.step)
    for t in range(len(active) - 1, -1, -1):
        w = e[:, at[t] : at[t + 1]]  # from here on: what a step into this place weighs
        w *= beta[:, at[t] : at[t + 1]]
        if t in scales:
            w /= scales[t]
        if t:
            previous = slice(at[t - 1], at[t - 1] + active[t])
            beta[:, previous] = hmm.step @ w
            steps += alpha[:, previous] @ w.T
    across = np.flatnonzero(~first)
    steps = (steps + before[:, across] @ e[:, across].T) * hmm.step
    alpha *= beta
    emits = np.stack([np.bincount(codes, weights=row, minlength=hmm.emit.shape[1]) for row in alpha])
    log = np.log(ends.sum(axis=0)).sum() + sum(np.log(s).sum() for s in scales.values())
    return alpha[:, : at[1]][:, first].sum(axis=1), steps, emits, float(log)


def log_likelihoods(sequences: list[np.ndarray], hmm: Hmm, stretch: int = 512) -> np.ndarray:
    """Natural log-likelihood of every sequence, exactly, by the scaled forward recursion.

    Sequences over ``stretch`` run as stretches from every state at once, and the resulting
    transfer matrices are multiplied in order.
    """
    pieces, owner, lead = _stretches(sequences, stretch)
    first, later = np.flatnonzero(lead), np.flatnonzero(~lead)
    ends, logs = _sweep([pieces[i] for i in first], hmm.start, hmm)
    total = ends[:, 0].sum(axis=1)
    out, beliefs = logs + np.log(total), ends[:, 0] / total[:, None]
    if len(later):
        moves, logs = _sweep([pieces[i] for i in later], hmm.step, hmm)
        for move, log, i in zip(moves, logs, owner[later].tolist()):
            mixed = beliefs[i] @ move
            total = mixed.sum()
            out[i] += log + math.log(total)
            beliefs[i] = mixed / total
    return out


def _groups(batches: Iterator[pa.RecordBatch], column: int, tokens: int) -> Iterator[tuple[list[int], list[np.ndarray], pa.RecordBatch]]:
    """Rows' code sequences, about ``tokens`` at a time."""
    for batch in batches:
        rows, found, n = [], [], 0
        for i, blob in enumerate(batch.column(column)):
            s = np.frombuffer(blob.as_buffer(), "<u2")
            rows.append(i)
            found.append(s)
            n += len(s)
            if n >= tokens:
                yield rows, found, batch
                rows, found, n = [], [], 0
        if rows:
            yield rows, found, batch


def _trainer(shared, stretch: int):
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hmm: Hmm = shared.value
        totals = None
        for _, found, _ in _groups(batches, 0, 150_000):
            start, step, emit, log = expected_counts(found, hmm, stretch)
            flat = np.concatenate([start, step.ravel(), emit.ravel(), [log]])
            totals = flat if totals is None else totals + flat
        if totals is not None:
            cells = np.flatnonzero(totals)
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(totals[cells], pa.float64())], names=["cell", "value"])

    return train


def _scorer(shared):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, found, batch in _groups(batches, 1, 100_000):
            logs = log_likelihoods(found, shared.value) / math.log(10)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(logs, pa.float64())], names=["uid", "log_classes"])

    return score


def train(encoded: DataFrame, classes: int, settings: HmmSettings) -> Hmm:
    """Baum-Welch over all rows of ``encoded`` (column codes)."""
    context, k = encoded.sparkSession.sparkContext, settings.states
    rng = np.random.default_rng(settings.seed)
    emit = rng.dirichlet(np.full(classes, 0.5), size=k) * 0.5 + 0.5 / classes
    step = np.full((k, k), 0.1 / max(1, k - 1))
    np.fill_diagonal(step, 0.9 if k > 1 else 1.0)
    hmm = Hmm(np.full(k, 1 / k), step, emit)
    for _ in range(settings.rounds):
        shared = context.broadcast(hmm)
        # one row per model cell and task comes in, one per cell goes to the driver: states x classes, a parameter
        summed = encoded.select("codes").mapInArrow(_trainer(shared, settings.stretch), "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value"))
        totals = np.zeros(k + k * k + k * classes + 1)
        for r in summed.collect():
            totals[r.cell] = r.value
        shared.unpersist()
        start, step, emit = totals[:k] + 1, totals[k : k + k * k].reshape(k, k) + 1, totals[k + k * k : -1].reshape(k, classes)
        overall = (emit.sum(axis=0) + 1) / (emit.sum() + classes)
        emit = emit + settings.smoothing * classes * overall
        hmm = Hmm(start / start.sum(), step / step.sum(axis=1, keepdims=True), emit / emit.sum(axis=1, keepdims=True))
    return hmm


def hmm_scores(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", settings: HmmSettings | None = None) -> DataFrame:
    """Base and HMM log10 probability of every row of ``docs``."""
    settings = settings or HmmSettings()
    spark = docs.sparkSession
    given = docs.select(
        F.monotonically_increasing_id().alias("uid"), F.col(doc_id).cast("long").alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), text_or_empty(text).alias("text")
    )
    counts = materialize(word_counts(given.where("not held_out")), "word-counts")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    local = _most_frequent(counts, settings.local_words)
    own = min(settings.own_words, len(local))
    g = settings.suffix_classes
    top = spark.createDataFrame([(r.word,) for r in local[:own]], "word string")
    rest = counts.join(F.broadcast(top), "word", "left_anti")  # at most own_words rows
    of_class = F.crc32(F.substring(F.col("word").cast("binary"), -3, 3)) % g
    sizes = np.zeros(own + g)
    sizes[own:] = math.log10(1)
    for r in rest.groupBy(of_class.alias("g")).agg((F.sum("c") + F.count(F.lit(1)) + 1).alias("size")).collect():  # a row per class
        sizes[own + r.g] = math.log10(r["size"])
    words = [r.word.encode() for r in local]
    vocabulary = Vocabulary(
        pa.array([r.word for r in local], pa.string()),
        np.array([i if i < own else own + _suffix_class(w, g) for i, w in enumerate(words)], np.uint16),
        np.log10(np.array([r.c for r in local], float) + 1), sizes, own, g,
    )
    shared = spark.sparkContext.broadcast(vocabulary)
    ordered = given.select("uid", "doc_id", "held_out", "text")
    encoded = materialize(ordered.mapInArrow(_encoder(shared, _ENCODED_ARROW), _ENCODED), "encoded")
    hmm = train(encoded.where("not held_out"), vocabulary.classes, settings)
    scored = encoded.select("uid", "codes").mapInArrow(_scorer(spark.sparkContext.broadcast(hmm)), "uid long, log_classes double")
    rare = encoded.select("uid", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("uid", F.col("r.rare").alias("word"), F.col("r.times").alias("times")).join(counts, "word")
    rare = rare.groupBy("uid").agg(F.sum("times").alias("rare_known"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("rare_log"))
    full = encoded.select("uid", "doc_id", "held_out", "n_tokens", "known", "log_c", "log_n").join(scored, "uid").join(rare, "uid", "left")
    rare_log = F.coalesce("rare_log", F.lit(0.0))
    return full.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(int(total.n)).cast("long").alias("train_tokens"),
        (F.col("log_c") + rare_log - F.col("n_tokens") * math.log10(total.n + total.v + 1)).alias("base_score"),
        (F.col("log_classes") + F.col("log_n") + rare_log).alias("score"),
    )
