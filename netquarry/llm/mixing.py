"""Mix of sources to target weights, dealt to output shards by a splitting tree.

Targets: sources, ordered by name, weigh 5, 2, 1 and so on in turn; together they get a share of
all words, and a source whose part passes ``max_epochs`` times its size stops there, its
excess going to the others by weight (water filling, one small aggregation a round).

Quotas: a block is a document in one pass over its source. A source gives all its blocks of whole
passes and, of the last pass, the first in a permuted order (by a hash, so every run repeats
it) up to the words that are left; the block at that border is cut at a word, so a source's words
meet the rounded target exactly. That makes an exact quota of blocks for every source.

Tree: a binary tree over the output shards splits the vector of quotas; every node draws its left
half's share by a multivariate hypergeometric law, seeded by the node, so any part of the tree can be drawn anywhere. It is cut
into subtrees of ``subtree`` shards: the driver draws what lies above them over groups of ``source_group`` sources
(a total per subtree and group is all that it holds), a task for each group of sources splits these down to the subtrees, and a task for
each group and subtree does the rest. Shards are equal in blocks to
one. A shard draws a stretch of every source's permuted blocks, the one next to the stretches of
the shards before it, so draws are disjoint and leave nothing out, and shuffles what it drew.
What a document gives is the sum of its draws.

No task holds a source: ranks in the permuted order are found by counts of ranges of the hash (4096, or more where there are more
shards, so that a range holds few borders), then inside a range.

Defined cases: null text has no words; a null source is a source of its own, last in order;
documents of no words are never taken; a mix of no words takes nothing; rows with equal ids (null
ones too) are blocks of their own, placed by id, text and then by row; texts of any length are blocks as others are; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordered import running_sums
from .common import WORD, discard, if_small, materialize, text_or_empty

_RANGE_DIGITS = 3  # 4096 ranges of the hash
_SAMPLER_BLOCKS = 10**9  # the library's sampler takes fewer; larger nodes are drawn colour by colour below


@dataclass(frozen=True)
class MixSettings:
    """``shard_words``: size of an output shard, so their number follows the data."""

    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    share: float = 1.5
    max_epochs: float = 2.0
    shard_words: int = 2_000_000
    source_group: int = 65_536
    subtree: int = 8192
    seed: int = 20240607


def even_totals(total: int, shards: int) -> np.ndarray:
    return np.diff([total * k // shards for k in range(shards + 1)])


def _log_ratio(x: int, d: int) -> float:
    """ln((x + d)! / x!) for large x, without the loss of subtracting two large logarithms."""
    if x < 100 or x + d < 100:
        return math.lgamma(x + d + 1) - math.lgamma(x + 1)
    a, b = x + 1.0, x + d + 1.0
    tail = lambda z: 1 / (12 * z) - 1 / (360 * z**3)
    return (a - 0.5) * math.log1p(d / a) + d * (math.log(b) - 1) + tail(b) - tail(a)


def large_hypergeometric(good: int, bad: int, sample: int, rng: np.random.Generator) -> int:
    """How many of ``good`` are in a ``sample`` of ``good + bad``, for numbers of any size: rejection from the
    flat-topped exponential hat that covers every log-concave law, around its mode."""
    low, high = max(0, sample - bad), min(good, sample)
    if low == high:
        return low
    mode = min(high, max(low, (sample + 1) * (good + 1) // (good + bad + 2)))

    def height(x: int) -> float:
        """ln p(x) / p(mode)."""
        d = x - mode
        return -(_log_ratio(mode, d) + _log_ratio(good - mode, -d) + _log_ratio(sample - mode, -d) + _log_ratio(bad - sample + mode, d))

    choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    spread = math.sqrt(max(sample * (good / (good + bad)) * (bad / (good + bad)) * (good + bad - sample) / max(good + bad - 1, 1), 1e-12))
    # a lower bound of p(mode) makes the hat wider, never wrong; beyond double precision of the factorials the normal height is used
    top = math.exp(choose(good, mode) + choose(bad, sample - mode) - choose(good + bad, sample)) if good + bad < 1 << 40 else 0.3989 / spread
    top = min(1.0, top) * 0.99
    w = 1 + top / 2
    while True:
        u, v, sign = rng.random(), rng.random(), 1 if rng.random() < 0.5 else -1
        if u <= w / (1 + w):
            y = rng.random() * w / top
        else:
            y = (w + rng.exponential()) / top
        x = mode + sign * round(y)
        if low <= x <= high and math.log(v) + min(0.0, w - top * y) <= height(x):
            return x


def _drawn(quota: np.ndarray, sample: int, rng: np.random.Generator) -> np.ndarray:
    """A multivariate hypergeometric draw: by the library's sampler where it reaches, else colour after colour."""
    rest = int(quota.sum())
    if rest < _SAMPLER_BLOCKS:
        return rng.multivariate_hypergeometric(quota, sample, method="marginals")
    out = np.zeros(len(quota), np.int64)
    for i, good in enumerate(quota.tolist()):
        rest -= good
        out[i] = large_hypergeometric(good, rest, sample, rng)
        sample -= int(out[i])
    return out


def split_node(places: np.ndarray, quota: np.ndarray, low: int, high: int, end_of: Callable[[int], int], seed: list[int], stop: int = 1) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(low, high, places, quotas) of the tree's nodes of ``stop`` shards at most, below the node (low, high) that holds ``quota`` of
    ``places``. ``end_of``: blocks of all shards before one."""
    if high - low <= stop:
        yield low, high, places, quota
        return
    middle = (low + high) // 2
    left = _drawn(quota, end_of(middle) - end_of(low), np.random.default_rng([*seed, low, high]))
    for part, a, b in ((left, low, middle), (quota - left, middle, high)):
        some = part > 0
        if some.any():
            yield from split_node(places[some], part[some], a, b, end_of, seed, stop)


def split_tree(quotas: np.ndarray, totals: np.ndarray, seed: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, places in ``quotas``, blocks drawn of each): ``totals`` holds the blocks of every shard."""
    ends, quotas = np.concatenate([[0], np.cumsum(totals)]), np.asarray(quotas, np.int64)
    some = np.flatnonzero(quotas)
    if len(some):
        for low, _, places, n in split_node(some, quotas[some], 0, len(totals), lambda k: int(ends[k]), seed):
            yield low, places, n


def _place(seed: int, doc_id: Column, text: Column) -> Column:
    """Hash of a block, its place in the permuted order of its source; equal rows are told apart by their number."""
    row = F.lpad(F.hex(F.monotonically_increasing_id()), 16, "0")
    return F.concat_ws(":", F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("null")), F.md5(text))), row)


def _sized(docs: DataFrame, text: str, source: str, doc_id: str, seed: int) -> DataFrame:
    """``docs`` with ``__size``, ``__source`` and ``__place`` (to be written before it is read twice)."""
    size = F.size(F.regexp_extract_all(text_or_empty(text), F.lit(WORD), F.lit(0))).cast("long")
    return docs.withColumns({"__size": size, "__source": F.col(source).cast("string"), "__place": _place(seed, F.col(doc_id), text_or_empty(text))})


def _numbered(sources: DataFrame) -> DataFrame:
    """``sources`` with ``number``, their place by name (nulls last): sorted in ranges, each numbered from where the ranges before it end."""
    order = [F.col("s").isNull(), F.col("s")]
    sorted_ = sources.repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    ranged = materialize(sorted_.withColumns({"part": F.shiftright(at, 33), "at": at.bitwiseAND(F.lit((1 << 33) - 1))}), "sources")
    counts = {r.part: r.n for r in ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per partition
    first = np.cumsum([0] + [counts[p] for p in sorted(counts)]).tolist()
    starts = sources.sparkSession.createDataFrame([(p, first[i]) for i, p in enumerate(sorted(counts))], "p long, first long")
    return ranged.join(F.broadcast(starts), F.col("part") == F.col("p")).select("s", "n", (F.col("first") + F.col("at")).alias("number"))


def with_targets(sources: DataFrame, settings: MixSettings) -> DataFrame:
    """``sources`` (s, n, number) with ``target`` by water filling: each round fills the sources that the level passes."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in settings.weights]), (F.col("number") % len(settings.weights) + 1).cast("int"))
    rows = materialize(sources.withColumns({"w": weight, "cap": settings.max_epochs * F.col("n")}), "weights")
    total = settings.share * (rows.agg(F.sum("n")).first()[0] or 0)
    levels: list[tuple[float, float]] = []
    known = -1
    while True:
        full = reduce(lambda a, b: a | b, [F.lit(left) * F.col("w") / F.lit(open_) >= F.col("cap") for left, open_ in levels], F.lit(False))
        r = rows.where("n > 0").agg(F.sum(F.when(full, F.col("cap"))).alias("caps"), F.sum(F.when(~full, F.col("w"))).alias("open"), F.count_if(full).alias("full")).first()
        left, open_ = max(0.0, total - (r.caps or 0.0)), r.open or 0.0
        if r.full == known or not open_:
            break
        known = r.full
        levels.append((left, open_))
    part = F.when(full, F.col("cap")).otherwise(F.lit(left) * F.col("w") / F.lit(open_ or 1.0))
    return rows.withColumn("target", F.when(F.col("n") == 0, 0.0).otherwise(part))


def draw(rows: DataFrame, settings: MixSettings) -> DataFrame:
    """Recipe of a mix of ``rows`` (__source, __size, __place): a row per source with number, target, whole passes and
    the border block of the last pass."""
    sources = rows.groupBy(F.col("__source").alias("s")).agg(F.sum("__size").alias("n"))
    words = F.floor(F.col("target") + 0.5)
    whole = F.when(F.col("n") > 0, F.floor(words / F.col("n"))).otherwise(0).cast("long")
    recipe = with_targets(_numbered(sources), settings).select("s", "number", F.col("n").alias("source_size"), "target", whole.alias("passes"), (words - whole * F.col("n")).cast("long").alias("rest"))
    recipe = materialize(recipe, "targets")
    # the border of the last pass: first by ranges of the hash, then inside one range
    ranged = rows.select("__source", "__size", "__place", F.substring("__place", 1, _RANGE_DIGITS).alias("range"))
    sums = ranged.groupBy("__source", "range").agg(F.sum("__size").alias("words"))
    sums = sums.join(if_small(recipe), sums["__source"].eqNullSafe(recipe["s"]))
    upto = Window.partitionBy("__source").orderBy("range")
    border = sums.withColumn("before", F.sum("words").over(upto) - F.col("words")).where("rest > before and rest <= before + words")
    border = materialize(border.select(F.col("__source").alias("bs"), F.col("range").alias("br"), F.col("before"), F.col("rest")), "border-ranges")
    near = ranged.join(if_small(border), ranged["__source"].eqNullSafe(border["bs"]) & (ranged["range"] == border["br"]))
    blocks = near.groupBy("__source", "__place", "before", "rest").agg(F.sum("__size").alias("words"))
    upto = Window.partitionBy("__source").orderBy("__place")
    blocks = blocks.withColumn("start", F.col("before") + F.sum("words").over(upto) - F.col("words")).where("rest > start and rest <= start + words")
    cut = blocks.select(F.col("__source").alias("cs"), F.col("__place").alias("border"), (F.col("rest") - F.col("start")).alias("part"), F.col("words").alias("whole"))
    return materialize(recipe.join(cut, recipe["s"].eqNullSafe(cut["cs"]), "left").drop("cs", "rest"), "recipe")


def _taken(rows: DataFrame, recipe: DataFrame) -> DataFrame:
    """A row per block that the mix takes: ``rows`` with number, ``words`` and ``spot``, its place among the source's blocks."""
    known = rows.join(if_small(recipe), rows["__source"].eqNullSafe(recipe["s"]))
    last = (
        F.when(F.col("__place") < F.col("border"), F.col("__size"))
        .when(F.col("__place") == F.col("border"), F.floor(F.col("part") * F.col("__size") / F.col("whole")))
        .otherwise(F.lit(0))
    )
    every = F.transform(
        F.sequence(F.lit(1), F.col("passes").cast("int") + 1),
        lambda p: F.struct(p.alias("pass"), F.when(p <= F.col("passes"), F.col("__size")).otherwise(F.col("__last")).alias("words")),
    )
    takes = known.withColumn("__last", last.cast("long")).withColumn("__take", F.explode(F.filter(every, lambda x: x["words"] > 0)))
    spot = F.md5(F.concat_ws(":", "__place", F.col("__take.pass")))
    return takes.withColumns({"__words": F.col("__take.words"), "__spot": spot})


def split_quotas(quotas: DataFrame, shards: int, settings: MixSettings) -> DataFrame:
    """``quotas`` (number, blocks) -> (number, shard, blocks), by the tree."""
    spark, width, seed, stop = quotas.sparkSession, settings.source_group, [settings.seed], settings.subtree
    grouped = quotas.withColumn("part", F.floor(F.col("number") / width))
    sums = sorted(grouped.groupBy("part").agg(F.sum("blocks").alias("n")).collect(), key=lambda r: r.part)  # a row per ``source_group`` sources
    whole = sum(r.n for r in sums)
    even = lambda k: whole * k // shards
    parts = [int(r.part) for r in sums]
    tops = [(low, high, places.tolist(), n.tolist()) for low, high, places, n in split_node(np.arange(len(parts)), np.array([r.n for r in sums], np.int64), 0, shards, even, seed, stop)] if whole else []
    upto = {p: [(0, 0)] for p in range(len(parts))}  # for each part, (end of a subtree, its blocks up to there)
    for _, high, places, n in sorted(tops):
        for p, x in zip(places, n):
            upto[p].append((high, upto[p][-1][1] + x))

    def before(ends: np.ndarray, totals: np.ndarray):
        return lambda k: int(totals[np.searchsorted(ends, k, side="right") - 1])

    def down(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        """A part's sources from the root to the subtrees."""
        at = parts.index(int(key[0]))
        own = own.sort_values("number")
        ends, totals = np.array(upto[at]).T
        found = list(split_node(np.arange(len(own)), own.blocks.to_numpy(), 0, shards, before(ends, totals), [*seed, parts[at]], stop))
        numbers, sizes = own.number.to_numpy(), [len(p) for _, _, p, _ in found]
        return pd.DataFrame({
            "part": key[0], "low": np.repeat([x[0] for x in found], sizes), "high": np.repeat([x[1] for x in found], sizes), "number": np.concatenate([numbers[p] for _, _, p, _ in found]), "blocks": np.concatenate([n for *_, n in found]),
        })

    def rest(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        """A part's sources from the root of a subtree to its shards; the parts' own split of the subtree is drawn again, from its seeds."""
        part, low, high = (int(x) for x in key)
        places, n = own.top_places.iloc[0], own.top_blocks.iloc[0]
        totals = np.zeros(high - low, np.int64)
        for a, _, p, m in split_node(np.asarray(places), np.asarray(n), low, high, even, seed):
            totals[a - low] = m[p == parts.index(part)].sum()
        own = own.sort_values("number")
        found = list(split_node(np.arange(len(own)), own.blocks.to_numpy(), low, high, before(np.arange(low, high + 1), np.concatenate([[0], np.cumsum(totals)])), [*seed, part]))
        numbers, sizes = own.number.to_numpy(), [len(p) for _, _, p, _ in found]
        return pd.DataFrame({"number": np.concatenate([numbers[p] for _, _, p, _ in found]), "shard": np.repeat([x[0] for x in found], sizes), "blocks": np.concatenate([n for *_, n in found])})

    subtrees = grouped.groupBy("part").applyInPandas(down, "part long, low int, high int, number long, blocks long")
    known = spark.createDataFrame(tops, "top_low int, top_high int, top_places array<int>, top_blocks array<long>")
    joined = subtrees.join(known, (F.col("low") == F.col("top_low")) & (F.col("high") == F.col("top_high"))).drop("top_low", "top_high")
    return joined.groupBy("part", "low", "high").applyInPandas(rest, "number long, shard int, blocks long")


def stretches(blocks: DataFrame, settings: MixSettings) -> tuple[DataFrame, int, int]:
    """Borders (bn, br, ends) of the shards' stretches in every range of a source's blocks, the number of shards, and the digits of a range.

    ``blocks``: number, __spot and __words of every block. ``ends`` lists (last spot, shard).
    """
    words = blocks.agg(F.coalesce(F.sum("__words"), F.lit(0)).alias("words")).first().words
    shards = max(1, math.ceil(words / settings.shard_words))
    digits = max(_RANGE_DIGITS, math.ceil(math.log(shards, 16)))  # a shard's border or so in a range of a source
    ranged = blocks.withColumn("__range", F.substring("__spot", 1, digits))
    counts = materialize(ranged.groupBy("number", "__range").agg(F.count(F.lit(1)).alias("n")), "ranges")
    split = materialize(split_quotas(counts.groupBy("number").agg(F.sum("n").alias("blocks")), shards, settings), "draws")
    drawn = running_sums(split, ["number"], ["shard"], {"end": F.col("blocks")}).select(F.col("number").alias("dn"), "shard", (F.col("end") - F.col("blocks")).alias("start"), "end")
    placed = running_sums(counts, ["number"], ["__range"], {"upto": F.col("n")}).withColumn("before", F.col("upto") - F.col("n"))
    meet = (F.col("number") == F.col("dn")) & (F.col("start") < F.col("upto")) & (F.col("end") > F.col("before"))
    inside = F.col("end") < F.col("upto")
    pieces = materialize(placed.join(drawn, meet).select("number", "__range", "shard", F.when(inside, F.col("end") - F.col("before")).alias("nth")), "stretches")
    used = materialize(pieces.where("nth is not null").select(F.col("number").alias("un"), F.col("__range").alias("ur")).distinct(), "used-ranges")
    near = ranged.join(if_small(used), (F.col("number") == F.col("un")) & (F.col("__range") == F.col("ur")), "left_semi").select("number", "__range", "__spot")
    near = near.withColumn("nth", F.row_number().over(Window.partitionBy("number", "__range").orderBy("__spot")).cast("long"))
    ends = pieces.join(near, ["number", "__range", "nth"], "left")
    borders = ends.groupBy(F.col("number").alias("bn"), F.col("__range").alias("br")).agg(F.sort_array(F.collect_list(F.struct(F.coalesce("__spot", F.lit("~")).alias("end"), "shard"))).alias("ends"))
    out = materialize(borders, "borders")
    discard(counts, split, pieces, used)
    return out, shards, digits


def _dealt(blocks: DataFrame, borders: DataFrame, digits: int) -> DataFrame:
    """``blocks`` with the shard that draws them."""
    own = F.filter("ends", lambda e: e["end"] >= F.col("__spot"))
    met = (F.col("number") == F.col("bn")) & (F.substring("__spot", 1, digits) == F.col("br"))
    return blocks.join(if_small(borders), met).withColumn("__shard", F.get(own, F.lit(0))["shard"])  # a row has a border or so, whatever the shards' number


def mix_draws(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", settings: MixSettings | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, recipe, draws): a row per document (uid, doc_id, __source, __size, __place), per source, and per block drawn (uid, number, shard, words)."""
    settings = settings or MixSettings()
    rows = _sized(docs, text, source, doc_id, settings.seed).select(F.monotonically_increasing_id().alias("uid"), F.col(doc_id).alias("doc_id"), "__source", "__size", "__place")
    rows = materialize(rows, "sizes")
    recipe = draw(rows, settings)
    blocks = materialize(_taken(rows, recipe).select("uid", "number", "__spot", "__words"), "blocks")
    borders, _, digits = stretches(blocks, settings)
    return rows, recipe, _dealt(blocks, borders, digits).select("uid", "number", F.col("__shard").alias("shard"), F.col("__words").alias("words"))


def mix_plan(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", settings: MixSettings | None = None) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document, ``taken`` being the sum of what the shards draw of it."""
    rows, recipe, draws = mix_draws(docs, text, source, doc_id, settings)
    taken = draws.groupBy(F.col("uid").alias("tu")).agg(F.sum("words").alias("taken"))
    known = rows.join(taken, F.col("uid") == F.col("tu"), "left").join(if_small(recipe), rows["__source"].eqNullSafe(recipe["s"]))
    return known.select("doc_id", F.col("__size").alias("size"), "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def _first_words(t: Column, n: Column) -> Column:
    pairs = F.arrays_zip(F.slice(F.split(t, WORD, -1), 1, n.cast("int")).alias("gap"), F.slice(F.regexp_extract_all(t, F.lit(WORD), F.lit(0)), 1, n.cast("int")).alias("word"))
    return F.array_join(F.transform(pairs, lambda x: F.concat(x["gap"], x["word"])), "")


def mix_documents(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", settings: MixSettings | None = None) -> DataFrame:
    """The mix itself, with exactly the columns of ``docs``: a row per document and pass, each shard a
    partition shuffled inside. The border block keeps its first words, and ``n_chars`` is counted anew."""
    settings = settings or MixSettings()
    own = [F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(docs.columns)]
    sized = materialize(_sized(docs, text, source, doc_id, settings.seed).select(*own, "__size", "__source", "__place"), "mix-input", "zstd")  # rows keep their places
    rows = sized.select("__source", "__size", "__place")
    recipe = draw(rows, settings)
    blocks = materialize(_taken(rows, recipe).select("number", "__spot", "__words"), "blocks")
    borders, shards, digits = stretches(blocks, settings)
    discard(blocks)
    dealt = _dealt(_taken(sized, recipe), borders, digits)
    cut = F.col("__words") < F.col("__size")
    given = {c: F.col(f"__c{i}") for i, c in enumerate(docs.columns)}
    # bound to a name first: the text is cut once, for itself and its length
    dealt = dealt.withColumn("__kept", F.when(cut, _first_words(F.coalesce(given[text].cast("string"), F.lit("")), F.col("__words"))).otherwise(given[text]))
    columns = []
    for c, value in given.items():
        if c == text:
            value = F.col("__kept")
        elif c == "n_chars":
            value = F.when(cut, F.length("__kept").cast(docs.schema[c].dataType)).otherwise(value)
        columns.append(value.alias(c))
    dealt = dealt.select(*columns, F.col("__shard"), F.md5(F.concat("__spot", F.lit("shuffle"))).alias("__shuffled"))
    return dealt.repartitionById(shards, F.col("__shard")).sortWithinPartitions("__shard", "__shuffled").drop("__shard", "__shuffled")
