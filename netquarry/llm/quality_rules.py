"""Risk-controlled quality rules (DataFrame functions only).

Every rule compares one ratio of a document with a cutoff from a fixed grid. Labelled
documents choose the cutoffs: on the good ones of a stratum, the number a cutoff would
reject is binomial, and the exact tail ``P(Bin(n, a) <= k)`` is the p-value of "this cutoff
rejects more than a share ``a`` of good documents". Each grid is tested from its most
lenient end until the first p-value above ``delta / (strata * rules)`` (fixed sequence
inside a grid, Bonferroni across grids), so with probability ``1 - delta`` no stratum loses
more than ``alpha`` of its good documents to all rules together.

Defined cases: null text counts as empty; a null stratum is a stratum of its own; labels
other than 0 and 1 and null ids are ignored; of several labels of a document the
smallest counts, and of repeated documents each row counts; a stratum with too few good
rows gets no cutoff, so nothing is rejected there beyond the base rules; an empty table
gives an empty result. A text of any length is counted whole.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, materialize, text_or_empty

SYMBOLS = "[#*$%&|<>]"

#: Strata (rows under 200 bytes) up to which their cutoffs are broadcast.
FEW_STRATA = 10_000

_RATIO_GRID = (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02)


@dataclass(frozen=True)
class RuleSettings:
    """``alpha``: share of good documents that all rules together may reject in a stratum;
    ``delta``: probability that this fails somewhere; ``grids``: cutoffs of each rule, lenient first."""

    alpha: float = 0.03
    delta: float = 0.05
    grids: dict[str, tuple[float, ...]] = field(
        default_factory=lambda: {
            "symbol_ratio": _RATIO_GRID,
            "exclaim_ratio": _RATIO_GRID,
            "upper_ratio": tuple(x for x in _RATIO_GRID if x >= 0.1),
            "dup_line_ratio": tuple(x for x in _RATIO_GRID if x >= 0.1),
            "repeat_ratio": tuple(x for x in _RATIO_GRID if x <= 0.5 and x >= 0.1),
            "mean_word": (40.0, 30.0, 25.0, 20.0, 18.0, 16.0, 14.0, 12.0, 11.0, 10.0, 9.0, 8.0),
        }
    )


def _count_of(text: Column, kind: str) -> Column:
    """Characters of a regex class (``translate`` would take many times as long)."""
    return F.length(text) - F.length(F.regexp_replace(text, kind, ""))


def _covered(starts: Column) -> Column:
    """Number of positions in 3-word windows at ``starts`` (sorted, distinct)."""
    return F.aggregate(
        starts,
        F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
        lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )


def _bind(value: Column, use) -> Column:
    """``use`` sees ``value`` as a lambda variable, so it is computed once a row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _repeated_by_text(w: Column) -> Column:
    """Words in repeated windows, by sorting the windows' texts: the plain way, slower."""
    n = F.size(w)
    grams = F.transform(
        F.slice(w, 1, F.greatest(n - 2, F.lit(0))),
        lambda x, i: F.struct(F.concat_ws(" ", x, F.get(w, i + 1), F.get(w, i + 2)).alias("g"), i.alias("i")),
    )

    def covered(s: Column) -> Column:
        hits = F.filter(
            s,
            lambda x, k: ((k > 0) & (F.get(s, k - 1)["g"] == x["g"])) | ((k < F.size(s) - 1) & (F.get(s, k + 1)["g"] == x["g"])),
        )
        return _covered(F.sort_array(F.transform(hits, lambda x: x["i"])))

    return _bind(F.sort_array(grams), covered)


_PLACE_BITS = 24


def _repeated_words(w: Column) -> Column:
    """Words inside 3-word windows that occur twice or more.

    Windows sort as longs (hash above, place below), so equal ones are neighbours. Every
    pair of neighbours is compared word by word; a text where two different windows share
    a hash, or of 2**24 words, takes the plain way.
    """
    n = F.size(w)
    packed = F.sort_array(F.transform(
        F.slice(w, 1, F.greatest(n - 2, F.lit(0))),
        lambda x, i: F.shiftleft(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)), _PLACE_BITS).bitwiseOR(i.cast("long")),
    ))
    place = F.lit((1 << _PLACE_BITS) - 1).cast("long")

    def from_packed(s: Column) -> Column:
        twins = F.filter(
            F.transform(s, lambda x, k: _bind(F.get(s, k + 1), lambda y: F.when(
                F.shiftright(x, _PLACE_BITS) == F.shiftright(y, _PLACE_BITS),
                F.struct(x.bitwiseAND(place).cast("int").alias("a"), y.bitwiseAND(place).cast("int").alias("b")),
            ))),
            lambda p: p.isNotNull(),
        )

        def from_twins(pairs: Column) -> Column:
            same = F.forall(pairs, lambda p: (
                (F.get(w, p["a"]) == F.get(w, p["b"])) & (F.get(w, p["a"] + 1) == F.get(w, p["b"] + 1)) & (F.get(w, p["a"] + 2) == F.get(w, p["b"] + 2))
            ))
            starts = F.sort_array(F.array_distinct(F.concat(F.transform(pairs, lambda p: p["a"]), F.transform(pairs, lambda p: p["b"]))))
            return F.when(F.size(pairs) == 0, F.lit(0)).when(same, _covered(starts)).otherwise(_repeated_by_text(w))

        return _bind(twins, from_twins)

    return F.when(n < 4, F.lit(0)).when(n >= 1 << _PLACE_BITS, _repeated_by_text(w)).otherwise(_bind(packed, from_packed))


def base_features(df: DataFrame, text: str = "text") -> Column:
    """Struct of the base counts of one text (longs)."""
    t = text_or_empty(text)

    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def from_words(w: Column) -> Column:
        n = F.size(w)
        return _bind(lines, lambda ls: F.struct(
            n.cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _count_of(t, SYMBOLS).cast("long").alias("n_symbols"),
            (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
            _repeated_words(w).cast("long").alias("n_repeat_words"),
            F.size(ls).cast("long").alias("n_lines"),
            _count_of(t, "[!?]").cast("long").alias("n_exclaim"),
            _count_of(t, "[A-Z]+").cast("long").alias("n_upper"),
        ))

    return _bind(F.regexp_extract_all(t, F.lit(WORD), F.lit(0)), from_words)


def _ratios(f: Column) -> dict[str, Column]:
    chars, n = F.greatest(f["word_chars"], F.lit(1)), F.greatest(f["n_words"], F.lit(1))
    return {
        "symbol_ratio": f["n_symbols"] / chars,
        "exclaim_ratio": f["n_exclaim"] / chars,
        "upper_ratio": f["n_upper"] / chars,
        "dup_line_ratio": f["n_dup_lines"] / F.greatest(f["n_lines"], F.lit(1)),
        "repeat_ratio": f["n_repeat_words"] / n,
        "mean_word": f["word_chars"] / n,
    }


def base_failed(f: Column) -> Column:
    return (f["n_words"] < 50) | (100 * f["n_repeat_words"] > 50 * f["n_words"])


def _log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series after a shift by eight; exact to about 1e-13."""
    x = n.cast("double") + 9
    inv = 1 / x
    series = inv / 12 - F.pow(inv, 3) / 360 + F.pow(inv, 5) / 1260 - F.pow(inv, 7) / 1680
    shifted = (x - 0.5) * F.log(x) - x + F.lit(0.9189385332046727) + series
    return shifted - reduce(lambda a, b: a + b, [F.log(n.cast("double") + i) for i in range(1, 9)])


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """Exact ``P(Bin(n, p) <= k)`` for k below n*p (1.0 above): the largest term is in closed
    form, and the terms below it shrink by a known ratio, so they are folded until they vanish."""
    head = _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k)
    head = head + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p))
    odds = (1 - p) / p
    # terms beyond 12 standard deviations below the mean are under 1e-30 of the tail
    reach = F.least(k, F.ceil(12 * F.sqrt(n * p) + 60))
    ratio = F.aggregate(
        F.sequence(F.lit(0).cast("long"), F.greatest(reach - 1, F.lit(0)).cast("long")),
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total")),
        lambda acc, j: F.struct(
            (acc["term"] * F.greatest(k - j, F.lit(0)) / (n - k + j + 1) * odds).alias("term"),
            (acc["total"] + acc["term"] * F.greatest(k - j, F.lit(0)) / (n - k + j + 1) * odds).alias("total"),
        ),
        lambda acc: acc["total"],
    )
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.exp(head) * ratio))


def select_cutoffs(good: DataFrame, stratum: str, features: str, settings: RuleSettings) -> DataFrame:
    """One row per stratum: a cutoff per rule (null where none can be guaranteed).

    ``good`` holds one row per labelled good document. Counting is one aggregation with
    map-side partial sums; its result has one row per stratum and grid point.
    """
    ratios = _ratios(F.col(features))
    points = [(r, i, c) for r, grid in settings.grids.items() for i, c in enumerate(grid)]
    failing = base_failed(F.col(features))
    counts = good.groupBy(F.col(stratum).alias("__stratum")).agg(
        F.count(F.lit(1)).alias("__n"), *[F.count_if(~failing & (ratios[r] > c)).alias(f"__{r}_{i}") for r, i, c in points]
    )
    strata = counts.agg(F.count(F.lit(1)).alias("__strata"))
    tests = counts.select(
        "__stratum", "__n",
        F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(i).alias("step"), F.lit(c).alias("cutoff"), F.col(f"__{r}_{i}").alias("rejected")) for r, i, c in points])).alias("t"),
    ).crossJoin(F.broadcast(strata))  # one row on the broadcast side
    share = settings.alpha / len(settings.grids)
    level = settings.delta / (len(settings.grids) * F.col("__strata"))
    passed = tests.select("__stratum", "t.*", (binomial_tail(F.col("t.rejected"), F.col("__n"), share) <= level).alias("ok"))
    # rejections only grow along a grid, so the steps that pass are those before the first failure
    chosen = passed.groupBy("__stratum", "rule").agg(
        F.min(F.when(~F.col("ok"), F.col("step"))).alias("stop"),
        F.array_sort(F.collect_list(F.struct("step", "cutoff"))).alias("grid"),
    )
    cut = F.get(F.col("grid"), F.coalesce(F.col("stop"), F.size("grid")) - 1)["cutoff"]
    return chosen.groupBy("__stratum").agg(*[F.max(F.when(F.col("rule") == r, cut)).alias(f"__cut_{r}") for r in settings.grids])


def quality_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", text: str = "text", settings: RuleSettings | None = None, keep_columns: bool = False) -> DataFrame:
    """Apply the risk-controlled rules to every document.

    With ``keep_columns`` the rows that stay are returned with exactly the columns of
    ``docs``; otherwise doc_id, the counts, ``base_failed`` and ``kept`` of every row.
    The counts are made once and written for both passes, beside the rows where those are returned.
    """
    settings = settings or RuleSettings()
    lab = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
        .groupBy(F.col("doc_id").alias("__label_id")).agg(F.min("quality").alias("__quality"))
    )
    made = {"__s": F.col(stratum).cast("string"), "__f": base_features(docs, text)}
    rows = materialize(docs.withColumns(made) if keep_columns else docs.select("doc_id", *[c.alias(n) for n, c in made.items()]), "quality-features")
    narrow = rows.select("doc_id", "__s", "__f")
    good = narrow.join(lab.where("__quality = 1"), F.col("doc_id") == F.col("__label_id")).select("__s", "__f")
    cuts = select_cutoffs(good, "__s", "__f", settings)
    # a row per stratum: broadcast while there are few, so that no text is dealt by stratum
    cuts = materialize(cuts, "cutoffs")
    if cuts.count() <= FEW_STRATA:
        cuts = F.broadcast(cuts)
    joined = rows.join(cuts, F.col("__s").eqNullSafe(F.col("__stratum")), "left")
    ratios = _ratios(F.col("__f"))
    over = reduce(lambda a, b: a | b, [F.coalesce(ratios[r] > F.col(f"__cut_{r}"), F.lit(False)) for r in settings.grids])
    failed = base_failed(F.col("__f"))
    if keep_columns:
        return joined.where(~failed & ~over).select(*[F.col(f"`{c}`") for c in docs.columns])
    f = F.col("__f")
    return joined.select(
        "doc_id", *[f[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        failed.alias("base_failed"), (~failed & ~over).alias("kept"),
    )
