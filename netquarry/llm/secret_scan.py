"""Secret scan (DataFrame functions only): fixed patterns, plus strings that look drawn at random.

Two character Markov models, one of random strings and one of ordinary identifiers, score
every long token by the log-likelihood ratio of its transitions. Both are trained from
samples labelled by the corpus itself: values that the patterns find are random, other long
tokens are ordinary. A token counts once, however often it or its document is copied, so
copies of a bare secret don't teach the ordinary model, and a token of over 64 characters teaches as much as
one of 64, so a single huge token doesn't make its model. The random model backs off to a uniform choice of the next character
(chance has no favourites), the ordinary one to how often ordinary tokens use a character,
so a secret without a label that counted as ordinary doesn't vouch for itself.

Spans count code points, end exclusive. Kinds, in the order that breaks ties: assign,
access, hex, markov. An added span never touches a base span.

Work is about linear in a text's length and in its number of spans: positions come from running
sums in two levels of 256, spans are held against each other in sorted order, and a token's characters
are an array. A text is one row, so memory is several times the longest text.

Defined cases: null text counts as empty (no spans, the digest of the empty string);
without samples of either label the ratio is 0 and nothing is added; repeated rows are
scanned alike; texts and tokens of any length are read whole; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_or_empty

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{14,}"  # AKIA[A-Z0-9]+ of 18 characters: a shorter match holds no longer one
HEX = "[0-9a-f]{16,}"  # likewise, a run of 16
KINDS = ("assign", "access", "hex", "markov")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
STATES = len(ALPHABET) + 1  # and the start of a token


@dataclass(frozen=True)
class SecretSettings:
    """``min_token``: length from which a token is scored; ``min_ratio``: nats of evidence for chance;
    ``random_prior`` and ``ordinary_prior``: pseudo-counts of a row of each model."""

    min_token: int = 16
    min_ratio: float = 12.0
    random_prior: float = 200.0
    ordinary_prior: float = 500.0


def _bind(value: Column, use) -> Column:
    return F.get(F.transform(F.array(value), use), F.lit(0))


_LEVEL = 256


def _running(values: Column, step, start: Column) -> Column:
    """Running fold (the element itself counts) of an int array by an associative ``step``.

    Chunks are folded by themselves and then from where the chunks before them end, so no array
    grows element by element beyond a chunk, or a list of chunks.
    """
    none = F.expr("cast(array() as array<int>)")

    def grown(x: Column, at: Column, listed) -> Column:
        first = F.struct(at.alias("at"), none.alias("out"))
        return F.aggregate(x, first, lambda acc, v: F.struct(step(acc["at"], v).alias("at"), F.array_append(acc["out"], listed(acc["at"], v)).alias("out")), lambda acc: acc["out"])

    def from_chunks(chunks: Column) -> Column:
        heads = grown(F.transform(chunks, lambda c: F.aggregate(c, start, step)), start, lambda at, _: at)
        return F.flatten(F.zip_with(chunks, heads, lambda c, head: grown(c, head, step)))

    def chunked(x: Column) -> Column:
        last = F.floor((F.greatest(F.size(x), F.lit(1)) - 1) / _LEVEL).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda c: F.slice(x, c * _LEVEL + 1, F.lit(_LEVEL)))

    return _bind(_bind(values, chunked), from_chunks)


def _sums(values: Column) -> Column:
    return _running(values, lambda a, b: a + b, F.lit(0))


def _matches(t: Column, pattern: str, group: int | None = None) -> Column:
    """array<struct<start, end, value>> of all matches: lengths of the gaps and matches, summed."""
    p = F.lit(pattern)
    gaps, found = F.split(t, pattern, -1), F.regexp_extract_all(t, p, F.lit(0))
    values = found if group is None else F.regexp_extract_all(t, p, F.lit(group))
    empty = F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)")

    def placed(m: Column) -> Column:
        steps = F.zip_with(F.slice(m["gaps"], 1, F.size(m["found"])), m["found"], lambda gap, match: F.length(gap) + F.length(match))
        return F.transform(
            F.arrays_zip(_sums(steps).alias("end"), m["found"].alias("match"), m["values"].alias("value")),
            lambda x: F.struct((x["end"] - F.length(x["match"])).alias("start"), x["end"].alias("end"), x["value"].alias("value")),
        )

    made = _bind(F.struct(gaps.alias("gaps"), found.alias("found"), values.alias("values")), placed)
    return F.when(t.rlike(pattern), made).otherwise(empty)


_TOKEN = 9  # beside the kinds of spans, while both are in one list
_FAR = (1 << 31) - 1


def _apart(tokens: Column, base: Column) -> Column:
    """Tokens that no base span touches: in order of start, against the farthest end before and the nearest start after."""
    every = F.sort_array(F.concat(
        F.transform(base, lambda b: F.struct(b["start"].alias("start"), b["kind"].alias("kind"), b["end"].alias("end"), F.lit("").alias("value"))),
        F.transform(tokens, lambda x: F.struct(x["start"].alias("start"), F.lit(_TOKEN).alias("kind"), x["end"].alias("end"), x["value"].alias("value"))),
    ))

    def merged(spans: Column) -> Column:
        is_base = lambda x: x["kind"] < _TOKEN
        before = _running(F.transform(spans, lambda x: F.when(is_base(x), x["end"]).otherwise(0)), lambda a, b: F.greatest(a, b), F.lit(0))
        after = F.reverse(_running(F.reverse(F.transform(spans, lambda x: F.when(is_base(x), x["start"]).otherwise(_FAR))), lambda a, b: F.least(a, b), F.lit(_FAR)))
        rows = F.filter(F.arrays_zip(spans.alias("x"), before.alias("before"), after.alias("after")), lambda r: ~is_base(r["x"]) & (r["before"] <= r["x"]["start"]) & (r["after"] >= r["x"]["end"]))
        return F.transform(rows, lambda r: F.struct(r["x"]["start"].alias("start"), r["x"]["end"].alias("end"), r["x"]["value"].alias("value")))

    return F.when((F.size(base) == 0) | (F.size(tokens) == 0), tokens).otherwise(_bind(every, merged))


def _as_spans(found: Column, kind: int) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))


def scanned(text: str, settings: SecretSettings) -> Column:
    """struct<base: spans, secrets: their values, others: long tokens beside them> of one text."""
    t = text_or_empty(text)
    token = f"[A-Za-z0-9+/_=-]{{{settings.min_token},}}"

    def parts(m: Column) -> Column:
        kept = F.filter(m["assign"], lambda x: F.length(x["value"]) >= 12)
        every = F.concat(*[_as_spans(found, k) for k, found in enumerate((kept, m["access"], m["hex"]))])
        values = F.concat(*[F.transform(found, lambda x: x["value"]) for found in (kept, m["access"], m["hex"])])

        def beside(base: Column) -> Column:
            return F.struct(base.alias("base"), values.alias("secrets"), _apart(m["tokens"], base).alias("others"))

        return _bind(F.sort_array(every), beside)

    found = F.struct(
        _matches(t, ASSIGN, 2).alias("assign"), _matches(t, ACCESS).alias("access"), _matches(t, HEX).alias("hex"), _matches(t, token).alias("tokens")
    )
    return _bind(found, parts)


def _pairs(token: Column) -> Column:
    """(state before, state) of every character as one number; state 0 is the start and any character beyond the alphabet."""
    states = F.transform(F.split(token, ""), lambda c: F.call_function("locate", c, F.lit(ALPHABET)))
    return _bind(states, lambda s: F.transform(s, lambda x, i: F.coalesce(F.get(s, i - 1), F.lit(0)) * STATES + x))


_UNIT, _TEACHES = 1000, 64


def train_models(found: DataFrame, scan: str, settings: SecretSettings) -> DataFrame:
    """One row: ``ratio``, array of ln P_random - ln P_ordinary for every pair of states.

    Distinct tokens and then transitions are counted with map-side sums; what is gathered is one row per pair of
    states and label, whatever the input's size.
    """
    tokens = found.select(
        F.explode(F.concat(
            F.transform(F.col(scan)["secrets"], lambda v: F.struct(F.lit(1).alias("random"), v.alias("token"))),
            F.transform(F.col(scan)["others"], lambda x: F.struct(F.lit(0).alias("random"), x["value"].alias("token"))),
        )).alias("s")
    ).select("s.random", "s.token").distinct()
    weight = F.when(F.length("token") <= _TEACHES, F.lit(_UNIT)).otherwise(F.greatest(F.lit(1), F.floor(_UNIT * _TEACHES / F.length("token")))).cast("long")
    # the weight is bound before the explode: beside it, a token would be carried along with each of its characters
    weighed = tokens.select("random", "token", weight.alias("weight"))
    pairs = weighed.select("random", "weight", F.explode(_pairs(F.col("token"))).alias("pair"))
    counts = pairs.groupBy("pair").agg(F.sum(F.col("random") * F.col("weight")).alias("r"), F.sum((1 - F.col("random")) * F.col("weight")).alias("o"))
    counts = materialize(counts.select("pair", (F.col("r") / _UNIT).alias("r"), (F.col("o") / _UNIT).alias("o")), "transitions")
    spark = found.sparkSession
    grid = spark.range(STATES * STATES).select(F.col("id").cast("int").alias("pair"), F.floor(F.col("id") / STATES).cast("int").alias("row"), (F.col("id") % STATES).cast("int").alias("next"))
    full = grid.join(counts, "pair", "left").select("pair", "row", "next", F.coalesce("r", F.lit(0.0)).alias("r"), F.coalesce("o", F.lit(0.0)).alias("o"))
    totals = full.groupBy("row").agg(F.sum("r").alias("rt"), F.sum("o").alias("ot"))
    single = full.groupBy("next").agg(F.sum("o").alias("on")).crossJoin(F.broadcast(full.agg(F.sum("o").alias("all"))))  # one row
    single = single.select("next", ((F.col("on") + 0.5) / (F.col("all") + 0.5 * STATES)).alias("share"))
    rp, op = settings.random_prior, settings.ordinary_prior
    known = full.join(totals, "row").join(single, "next").select(
        "pair", "r", "o",
        (F.log((F.col("r") + rp / STATES) / (F.col("rt") + rp)) - F.log((F.col("o") + op * F.col("share")) / (F.col("ot") + op))).alias("x"),
    )
    return known.agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pair", "x"))), lambda p: p["x"]).alias("x"), F.sum("r").alias("r"), F.sum("o").alias("o")
    ).select(F.when((F.col("r") > 0) & (F.col("o") > 0), F.col("x")).otherwise(F.transform("x", lambda x: F.lit(0.0))).alias("ratio"))


def log_ratio(token: Column, ratio: Column) -> Column:
    return F.aggregate(_pairs(token), F.lit(0.0), lambda acc, pair: acc + F.get(ratio, pair))


def _all_spans(scan: Column, ratio: Column, settings: SecretSettings) -> Column:
    added = F.filter(scan["others"], lambda x: log_ratio(x["value"], ratio) >= settings.min_ratio)
    return F.sort_array(F.concat(scan["base"], _as_spans(added, 3)))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def secret_spans(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", settings: SecretSettings | None = None) -> DataFrame:
    """Counts, digest and spans of every row of ``docs``."""
    settings = settings or SecretSettings()
    found = materialize(docs.select(F.col(doc_id).alias("doc_id"), scanned(text, settings).alias("scan")), "secret-matches")
    model = train_models(found, "scan", settings)
    scan = F.col("scan")
    rows = found.crossJoin(F.broadcast(model)).withColumn("found", _all_spans(scan, F.col("ratio"), settings))  # the model is one row
    of_kind = lambda k: F.size(F.filter(scan["base"], lambda s: s["kind"] == k)).cast("long")
    return rows.select(
        "doc_id", of_kind(0).alias("n_assign"), of_kind(1).alias("n_access"), of_kind(2).alias("n_hex"),
        F.sha2(_joined(scan["base"]), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"),
    )


_BLOCK = 1024


def _without(t: Column, spans: Column, mark: str) -> Column:
    """The text with ``mark`` for every span, or for several that overlap. Pieces come from blocks of the text, for a
    substring counts its characters from the start of what it cuts."""

    def joined(x: Column) -> Column:
        reach, blocks = x["reach"], x["blocks"]

        def piece(a: Column, b: Column) -> Column:
            first, last = F.floor(a / _BLOCK).cast("int"), F.floor(b / _BLOCK).cast("int")
            head = F.substring(F.coalesce(F.get(blocks, first), F.lit("")), a % _BLOCK + 1, F.when(first == last, b - a).otherwise(F.lit(_BLOCK)))
            middle = F.when(last - first > 1, F.array_join(F.transform(F.sequence(first + 1, last - 1), lambda k: F.get(blocks, k)), "")).otherwise(F.lit(""))
            return F.when(first == last, head).otherwise(F.concat(head, middle, F.substring(F.coalesce(F.get(blocks, last), F.lit("")), 1, b % _BLOCK)))

        gaps = F.filter(
            F.transform(spans, lambda s, i: F.struct(F.coalesce(F.get(reach, i - 1), F.lit(0)).alias("from"), s["start"].alias("to"))), lambda g: g["from"] <= g["to"]
        )
        tail = piece(F.coalesce(F.get(reach, F.size(spans) - 1), F.lit(0)), F.length(t))
        return F.concat(F.array_join(F.transform(gaps, lambda g: F.concat(piece(g["from"], g["to"]), F.lit(mark))), ""), tail)

    reach = _running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b), F.lit(0))
    return _bind(F.struct(reach.alias("reach"), F.regexp_extract_all(t, F.lit(f"(?s).{{1,{_BLOCK}}}"), F.lit(0)).alias("blocks")), joined)


def redact_secrets(docs: DataFrame, text: str = "text", mark: str = "[SECRET]", settings: SecretSettings | None = None) -> DataFrame:
    """``docs`` with every span replaced by ``mark`` (overlapping spans by one) and ``n_chars``, if there, counted anew."""
    settings = settings or SecretSettings()
    found = materialize(docs.withColumn("__scan", scanned(text, settings)), "secret-matches", "zstd")  # rows and finds once, for both passes
    model = train_models(found, "__scan", settings).withColumnRenamed("ratio", "__ratio")
    rows = found.crossJoin(F.broadcast(model))  # one row
    rows = rows.withColumn("__spans", _all_spans(F.col("__scan"), F.col("__ratio"), settings))
    rows = rows.withColumn("__clean", F.when(F.size("__spans") > 0, _without(text_or_empty(text), F.col("__spans"), mark)).otherwise(F.col(text)))
    columns = []
    for c in docs.columns:
        if c == text:
            columns.append(F.col("__clean").alias(c))
        elif c == "n_chars":
            columns.append(F.when(F.size("__spans") > 0, F.length("__clean").cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c))
        else:
            columns.append(F.col(f"`{c}`"))
    return rows.select(*columns)
