"""Many logistic models in one pass over the rows: folds, groups left out, subsets of the features.

All models are fitted side by side by Newton steps. A pass over the rows sums, for each model, gradient and
Hessian of the rows that train it (a block of p + 1 by p + 1 numbers, whatever the rows' number); sums are added up on the
map side, the steps are taken on the driver from one row per model. Rows say in ``held`` which fold tests them, so a
row trains every model but its fold's.

The objective is that of balanced logistic regression with an L2 penalty: rows of a class weigh
n / (2 * rows of the class), the intercept is free. Models are taken ``at_once`` a time, so what is held stays bounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import discard, materialize
from .ordered import numbered


@dataclass(frozen=True)
class TrainSettings:
    """``c``: inverse of the penalty; ``most_folds``: folds at most; ``steps``: Newton steps at most; ``at_once``: models fitted together."""

    c: float = 1.0
    most_folds: int = 5
    steps: int = 50
    close: float = 1e-10
    at_once: int = 256


ALL = -1  # the fold of models that every row trains


def group_folds(rows: DataFrame, group: str, label: str, settings: TrainSettings | None = None) -> DataFrame:
    """(group, n, fold): whole groups to folds, in falling order of size (then by name) and dealt in turn. As many folds as the
    smaller class has rows and as there are groups, ``most_folds`` at most and two at least."""
    settings = settings or TrainSettings()
    sizes = materialize(rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("positive")), "groups")
    known = sizes.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("positive"), F.lit(0)).alias("positive"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    folds = max(2, min(settings.most_folds, known.positive, known.n - known.positive, known.groups))
    placed = numbered(sizes.withColumn("less", -F.col("n")), [], ["less", group])
    return placed.select(group, "n", (F.col("number") % folds).cast("int").alias("fold"))


def group_numbers(rows: DataFrame, group: str) -> DataFrame:
    """(group, fold): every group a fold of its own, for models that leave one group out."""
    return numbered(rows.select(group).distinct(), [], [group]).select(group, F.col("number").cast("int").alias("fold"))


def _prepared(rows: DataFrame, features: list[str], label: str, held: str) -> DataFrame:
    return rows.select(F.array(*[F.col(f).cast("double") for f in features]).alias("x"), F.col(label).cast("int").alias("y"), F.col(held).cast("int").alias("held"))


def _summer(models: list[tuple[int, np.ndarray]], weights: np.ndarray, balance: np.ndarray):
    """``models``: (fold, mask of features). Sums per model: loss, gradient, upper triangle of the Hessian."""
    p = weights.shape[1]
    upper = np.triu_indices(p)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(models), 1 + p + len(upper[0])))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.column_stack([np.asarray(batch.column(0).flatten(), float).reshape(batch.num_rows, -1), np.ones(batch.num_rows)])
            y, held = batch.column(1).to_numpy().astype(float), batch.column(2).to_numpy()
            for m, (fold, mask) in enumerate(models):
                own = held != fold
                xm, ym = x[own] * mask, y[own]
                s = np.where(ym > 0, balance[m, 1], balance[m, 0])
                z = xm @ weights[m]
                q = 1 / (1 + np.exp(-z))
                h = (xm * (s * q * (1 - q))[:, None]).T @ xm
                total[m] += np.concatenate([[(s * (np.logaddexp(0, z) - ym * z)).sum()], xm.T @ (s * (q - ym)), h[upper]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(models)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["model", "sums"])

    return sums


def _fitted(table: DataFrame, models: list[tuple[int, np.ndarray]], counts: np.ndarray, settings: TrainSettings) -> np.ndarray:
    p = len(models[0][1])
    width, upper = 1 + p + p * (p + 1) // 2, np.triu_indices(p)
    n = counts.sum(axis=1, keepdims=True)
    balance = np.divide(n, 2 * counts, out=np.zeros_like(counts), where=counts > 0)
    free = np.append(np.ones(p - 1), 0.0)  # the intercept isn't penalised
    weights, trial = np.zeros((len(models), p)), np.zeros((len(models), p))
    best, step, open_ = np.full(len(models), np.inf), np.zeros((len(models), p)), counts.min(axis=1) > 0
    for _ in range(settings.steps):
        live = np.flatnonzero(open_)
        if not len(live):
            break
        made = table.mapInArrow(_summer([models[m] for m in live], trial[live], balance[live]), "model int, sums array<double>")
        found = made.groupBy("model").agg(*[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(width)]).collect()  # a row per model
        for r in found:
            m, s = int(live[r["model"]]), np.array(r[1:], float)
            penalty = 0.5 * (free * trial[m] ** 2).sum()
            loss = settings.c * s[0] + penalty
            if loss > best[m] + 1e-9 * abs(best[m]):  # too far: half the step
                step[m] /= 2
                trial[m] = weights[m] + step[m]
                open_[m] = np.abs(step[m]).max() > settings.close
                continue
            weights[m], best[m] = trial[m], loss
            hessian = np.zeros((p, p))
            hessian[upper] = s[1 + p :]
            hessian = settings.c * (hessian + np.triu(hessian, 1).T) + np.diag(free)
            gradient = settings.c * s[1 : 1 + p] + free * weights[m]
            step[m] = -np.linalg.lstsq(hessian, gradient, rcond=None)[0]
            trial[m] = weights[m] + step[m]
            open_[m] = np.abs(step[m]).max() > settings.close
    return np.where((counts.min(axis=1) > 0)[:, None], trial, np.nan)


def fit_many(rows: DataFrame, features: list[str], label: str, held: str, subsets: dict[str, list[str]] | None = None, with_all: bool = False, settings: TrainSettings | None = None) -> DataFrame:
    """(subset, fold, weights, bias) of a model for every subset of the features and every fold, trained on the rows of the others (with ``with_all`` also of
    fold -1, trained on all). ``weights`` are in order of ``features``, 0 outside the subset; null where training has one class only."""
    settings, spark = settings or TrainSettings(), rows.sparkSession
    table = materialize(_prepared(rows, features, label, held), "training-rows")
    sizes = {(r.held, r.y): r.n for r in table.groupBy("held", "y").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows per fold
    folds = sorted({h for h, _ in sizes}) + [ALL] * with_all
    whole = {y: sum(n for (_, k), n in sizes.items() if k == y) for y in (0, 1)}
    masks = {name: np.array([float(f in own) for f in features] + [1.0]) for name, own in (subsets or {"all": features}).items()}
    wanted = [(name, fold) for name in masks for fold in folds]
    out = []
    for at in range(0, len(wanted), settings.at_once):
        some = wanted[at : at + settings.at_once]
        counts = np.array([[whole[y] - sizes.get((fold, y), 0) for y in (0, 1)] for _, fold in some], float)
        found = _fitted(table, [(fold, masks[name]) for name, fold in some], counts, settings)
        out += [(name, fold, None if np.isnan(w).any() else [float(v) for v in w[:-1]], None if np.isnan(w).any() else float(w[-1])) for (name, fold), w in zip(some, found)]
    discard(table)
    return spark.createDataFrame(out, "subset string, fold int, weights array<double>, bias double")


def predictions(rows: DataFrame, features: list[str], held: str, models: DataFrame) -> DataFrame:
    """``rows`` with ``subset`` and ``p``, by the models that their fold didn't train (no row where there is none)."""
    own = models.where("weights is not null").select("subset", F.col("fold").alias("__fold"), "weights", "bias")
    z = F.aggregate(F.zip_with(F.array(*[F.col(f).cast("double") for f in features]), F.col("weights"), lambda a, b: a * b), F.col("bias"), lambda a, b: a + b)
    met = rows.join(F.broadcast(own), F.col(held) == F.col("__fold"))  # a row per model, which fit_many made on the driver
    return met.withColumn("p", 1 / (1 + F.exp(-z))).drop("__fold", "weights", "bias")


def fold_rates(found: DataFrame, label: str, held: str) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1 and false-alarm rate of every subset and fold, to 4 places; a rate over nothing is 0."""
    truth, hit = F.col(label).cast("int") == 1, F.col("p") >= 0.5
    counts = found.groupBy("subset", F.col(held).alias("fold")).agg(
        F.count_if(truth & hit).alias("tp"), F.count_if(~truth & hit).alias("fp"), F.count_if(truth & ~hit).alias("fn"), F.count_if(~truth & ~hit).alias("tn")
    )
    rate = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 4)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select("subset", "fold", "tp", "fp", "fn", "tn", rate(tp, tp + fp).alias("precision"), rate(tp, tp + fn).alias("recall"), rate(2 * tp, 2 * tp + fp + fn).alias("f1"), rate(fp, fp + tn).alias("fpr"))


def summary(rates: DataFrame) -> DataFrame:
    """Means and deviations over the folds of every subset, with all misses and false alarms."""
    of = lambda c: (F.round(F.avg(c), 4).alias(f"{c}_mean"), F.round(F.stddev_pop(c), 4).alias(f"{c}_std"))
    return rates.groupBy("subset").agg(F.count(F.lit(1)).alias("folds"), *of("f1"), *of("precision"), *of("recall"), *of("fpr"), F.sum("fn").alias("total_fn"), F.sum("fp").alias("total_fp"))


_LIMB, _LIMBS, _ROWS = 19, 4, 1 << 14  # products of limbs over so many rows stay below 2**53, so a product of matrices is exact


def _gram(pairs: list[tuple[int, int]], tops: list[int]):
    """``tops``: every finite value of a column is below 2**top. Sums per pair and place, as integers: what is missing from 2**-76 of a
    column's largest value on is left out. Place -2 counts the pair's rows, -1 those of them that aren't finite; then come
    ``_LIMBS`` places of each column's sum and the places of the sum of products."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, total = len(tops), 0
        for whole in batches:
            for start in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(start, _ROWS)
                z = np.zeros((p, _LIMBS + 2, batch.num_rows))
                for c in range(p):
                    x = batch.column(c).to_numpy(zero_copy_only=False)
                    z[c, -1] = known = np.asarray(batch.column(c).is_valid())
                    z[c, -2] = odd = known & ~np.isfinite(x)
                    rest = np.ldexp(np.where(known & ~odd, x, 0.0), -tops[c])
                    for i in range(_LIMBS):
                        rest = rest * 2.0**_LIMB
                        z[c, i] = np.rint(rest)
                        rest -= z[c, i]
                z = z.reshape(-1, batch.num_rows)
                total = total + (z @ z.T).astype(np.int64).astype(object)  # integers of any length
        if isinstance(total, int):
            return
        g, out = total.reshape(p, _LIMBS + 2, p, _LIMBS + 2), []
        for k, (a, b) in enumerate(pairs):
            out += [(k, -2, g[a, -1, b, -1]), (k, -1, g[a, -2, b, -1] + g[a, -1, b, -2])]
            out += [(k, i, g[a, i, b, -1]) for i in range(_LIMBS)] + [(k, _LIMBS + i, g[a, -1, b, i]) for i in range(_LIMBS)]
            out += [(k, 2 * _LIMBS + d, sum(g[a, i, b, d - i] for i in range(_LIMBS) if 0 <= d - i < _LIMBS)) for d in range(2 * _LIMBS - 1)]
        pair, place, value = zip(*out)
        yield pa.RecordBatch.from_arrays([pa.array(pair, pa.int32()), pa.array(place, pa.int32()), pa.array([Decimal(v) for v in value], pa.decimal128(28, 0))], names=["pair", "place", "value"])

    return sums


def moments(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, covariance) of every pair of columns, itself too, over the rows that have both (null: no such row; NaN: one isn't finite).

    Sums are integers, so rows give the same in whatever order and parts they come: the exact covariance, rounded once, where
    no value has bits below 2**-76 of its column's largest.
    """
    spark, pairs = rows.sparkSession, [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    if not pairs:
        return spark.createDataFrame([], "a string, b string, covariance double")
    own = rows.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
    size = lambda i: F.abs(f"x{i}")
    largest = own.agg(*[F.max(F.when(size(i) < float("inf"), size(i))).alias(f"m{i}") for i in range(len(columns))]).first()
    tops = [int(np.frexp(m or 0.0)[1]) for m in largest]
    place_of = {c: i for i, c in enumerate(columns)}
    made = own.mapInArrow(_gram([(place_of[a], place_of[b]) for a, b in pairs], tops), "pair int, place int, value decimal(28,0)")
    found = {(r.pair, r.place): int(r.value) for r in made.groupBy("pair", "place").agg(F.sum("value").alias("value")).collect()}  # some 20 rows a pair
    out = []
    for k, (a, b) in enumerate(pairs):
        n = found.get((k, -2), 0)
        if not n or found[k, -1]:
            out.append((a, b, float("nan") if n else None))
            continue
        total = lambda first, places, shift: sum(found[k, first + i] << _LIMB * (shift - i) for i in range(places))
        x, y, xy = total(0, _LIMBS, _LIMBS - 1), total(_LIMBS, _LIMBS, _LIMBS - 1), total(2 * _LIMBS, 2 * _LIMBS - 1, 2 * _LIMBS - 2)
        up = Fraction(2) ** (tops[place_of[a]] + tops[place_of[b]] - 2 * _LIMB * _LIMBS)
        exact = Fraction(n * xy - x * y, n * n) * up
        try:
            out.append((a, b, float(exact)))
        except OverflowError:
            out.append((a, b, float("inf") if exact > 0 else float("-inf")))
    return spark.createDataFrame(out, "a string, b string, covariance double")


def vif(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, vif): how far each column is a mix of the others, from the moments alone (a row per pair of columns); null for a constant column."""
    found = {(r.a, r.b): r.covariance for r in moments(rows, columns).collect()}
    c = np.array([[found.get((a, b), found.get((b, a))) for b in columns] for a in columns], float)
    constant = ~(np.sqrt(np.maximum(np.diag(c), 0)) >= 1e-12)
    out = []
    for i, name in enumerate(columns):
        if constant[i]:
            out.append((name, None))
            continue
        others = [j for j in range(len(columns)) if j != i and not constant[j]]
        part = np.linalg.lstsq(c[np.ix_(others, others)], c[others, i], rcond=None)[0] if others else np.zeros(0)
        r2 = min(max(float(part @ c[others, i] / c[i, i]), 0.0), 1 - 1e-12)
        out.append((name, 1 / (1 - r2)))
    return rows.sparkSession.createDataFrame(out, "column string, vif double")
