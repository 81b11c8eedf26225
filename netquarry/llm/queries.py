"""Queries of the training-data operators: production parameters, whole tables, full results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .attention_quality import quality_scores
from .common import read_table
from .filter_audit import filter_audit
from .hmm_lm import hmm_scores
from .mixing import MixSettings, mix_plan
from .near_dedup import near_dedup
from .packing import pack
from .personal_data import personal_data
from .piece_table import fill_in_middle
from .projected_search import nearest
from .quality_rules import RuleSettings, quality_rules
from .secret_scan import secret_spans
from .suffix_dedup import remove_repeats, removal_report
from .token_lengths import token_lengths


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(read_table(spark, sf_dir, "documents"))


def op2_binary_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))


def op3_projected_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read_table(spark, sf_dir, "embeddings"))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(read_table(spark, sf_dir, "documents"))


def op5_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_scores(read_table(spark, sf_dir, "documents"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(read_table(spark, sf_dir, "documents"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(read_table(spark, sf_dir, "documents"))


def op8_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op10_token_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_lengths(read_table(spark, sf_dir, "documents"))


def op11_piece_table_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle(read_table(spark, sf_dir, "documents"), with_output=False)


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_report(remove_repeats(read_table(spark, sf_dir, "documents")))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


_SEED = MixSettings().seed

OP6_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('{_SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))) AS place
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS DOUBLE) AS n,
         [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w
  FROM d GROUP BY source),
f AS (
  SELECT *, 1.5 * sum(n) OVER () AS total, 2 * n AS cap FROM s WHERE n > 0),
o AS (
  SELECT *, total - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest_total,
         sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_w,
         row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS k
  FROM f),
stop AS (SELECT min(k) AS k0 FROM o WHERE rest_total * w / rest_w < cap),
lam AS (SELECT rest_total AS rt, rest_w AS rw FROM o, stop WHERE k = k0),
t AS (
  SELECT o.source, o.n, CASE WHEN k0 IS NULL OR k < k0 THEN cap ELSE rt * w / rw END AS target
  FROM o CROSS JOIN stop LEFT JOIN lam ON true
  UNION ALL SELECT source, n, 0.0 FROM s WHERE n = 0),
p AS (
  SELECT *, CASE WHEN n > 0 THEN floor(floor(target + 0.5) / n) ELSE 0 END AS passes,
         CASE WHEN n > 0 THEN floor(target + 0.5) - n * floor(floor(target + 0.5) / n) ELSE 0 END AS rest FROM t),
c AS (
  SELECT d.*, p.n, p.target, p.passes, p.rest,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(n AS BIGINT) AS source_size, target,
       CAST(passes * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken
FROM c
"""

_RULES = RuleSettings()
_RATIO = {
    "symbol_ratio": "n_symbols / greatest(word_chars, 1)", "exclaim_ratio": "n_exclaim / greatest(word_chars, 1)", "upper_ratio": "n_upper / greatest(word_chars, 1)",
    "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)", "repeat_ratio": "n_repeat_words / greatest(n_words, 1)", "mean_word": "word_chars / greatest(n_words, 1)",
}
_POINTS = ", ".join(f"('{r}', {i}, {c}::DOUBLE)" for r, grid in _RULES.grids.items() for i, c in enumerate(grid))
_LONG = " UNION ALL ".join(f"SELECT rid, s, '{r}' AS rule, ({x})::DOUBLE AS v, base_failed FROM f" for r, x in _RATIO.items())
_SHARE, _GRIDS = _RULES.alpha / len(_RULES.grids), len(_RULES.grids)

OP9_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, lang AS s, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM (SELECT rid, w, unnest(generate_series(1, len(w) - 2)) AS i FROM d WHERE len(w) > 2)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM g) WHERE n > 1),
cover AS (SELECT rid, count(DISTINCT i + j) AS n FROM twice, (VALUES (0), (1), (2)) x(j) GROUP BY 1),
l AS (SELECT rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
f AS (
  SELECT rid, doc_id, s, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(cover.n, 0) AS n_repeat_words, len(lines) AS n_lines,
         length(t) - length(regexp_replace(t, '[!?]', '', 'g')) AS n_exclaim, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper,
         len(w) < 50 OR 100 * coalesce(cover.n, 0) > 50 * len(w) AS base_failed
  FROM d JOIN l USING (rid) LEFT JOIN cover USING (rid)),
ratios AS ({_LONG}),
good AS (SELECT f.rid FROM f JOIN (SELECT doc_id FROM labels WHERE quality IN (0, 1) GROUP BY doc_id HAVING min(quality) = 1) USING (doc_id)),
strata AS (SELECT s, count(*) AS n FROM f JOIN good USING (rid) GROUP BY s),
points(rule, step, cutoff) AS (VALUES {_POINTS}),
tests AS (
  SELECT strata.s, strata.n, p.rule, p.step, p.cutoff, count(*) FILTER (r.v > p.cutoff AND NOT r.base_failed) AS k
  FROM points p JOIN ratios r ON p.rule = r.rule JOIN good USING (rid) JOIN strata ON strata.s IS NOT DISTINCT FROM r.s GROUP BY ALL),
tails AS (
  SELECT *, CASE WHEN k >= n * {_SHARE}::DOUBLE THEN 1 ELSE list_sum(list_transform(generate_series(0, k), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({_SHARE}::DOUBLE) + (n - i) * ln(1 - {_SHARE}::DOUBLE)))) END AS p
  FROM tests),
stops AS (SELECT s, rule, min(CASE WHEN p > {_RULES.delta}::DOUBLE / ({_GRIDS} * (SELECT count(*) FROM strata)) THEN step END) AS stop, max(step) + 1 AS steps FROM tails GROUP BY 1, 2),
cuts AS (SELECT stops.s, stops.rule, cutoff FROM stops JOIN points ON points.rule = stops.rule AND points.step = coalesce(stop, steps) - 1),
over AS (SELECT DISTINCT r.rid FROM ratios r JOIN cuts c ON c.rule = r.rule AND c.s IS NOT DISTINCT FROM r.s WHERE r.v > c.cutoff)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND rid NOT IN (SELECT rid FROM over) AS kept FROM f
"""

OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents),
n AS (
  SELECT doc_id, t, u, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
f AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM n),
p AS (SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:n], '') AS suffix FROM f)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""

OP13_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
firsts AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
g AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, (len(w) < 200) AS fa, (100 * len(list_distinct(w)) < 50 * len(w)) AS fb, (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t)) AS fc,
         regexp_matches(t, '[#$%&*|]') AS fd, first IS NOT NULL AND (d.doc_id IS NULL OR d.doc_id > first) AS fe, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM d JOIN firsts USING (t) LEFT JOIN g ON d.doc_id = g.doc_id),
h AS (SELECT part, map {'A': fa, 'B': fb, 'C': fc, 'D': fd, 'E': fe} AS fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY ALL),
orders(o) AS (SELECT '' UNION ALL SELECT o || x FROM orders, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(x) WHERE NOT contains(o, x)),
steps AS (SELECT o AS filter_order, k AS step, o[k] AS filter, o[:k - 1] AS before FROM orders, range(1, 6) r(k) WHERE len(o) = 5),
x AS (
  SELECT part, filter_order, step, filter, n, good, toxic, fails[filter] AS fail, len(list_filter(string_split(before, ''), lambda c: c <> '' AND fails[c])) > 0 AS gone,
         len(list_filter(['A', 'B', 'C', 'D', 'E'], lambda c: fails[c])) = 1 AS single
  FROM h, steps),
y AS (
  SELECT part, filter_order, step, filter, coalesce(sum(n) FILTER (NOT gone AND NOT fail), 0) AS kept, coalesce(sum(n) FILTER (NOT gone AND fail), 0) AS removed, coalesce(sum(n) FILTER (gone AND fail), 0) AS redundant,
         coalesce(sum(n) FILTER (single AND fail), 0) AS unique_fails, coalesce(sum(good) FILTER (NOT gone AND fail), 0) AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND fail), 0) AS toxic_lost
  FROM x GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, filter, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, sum(removed) OVER (PARTITION BY part, filter)::BIGINT AS shapley
FROM y
"""

QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_binary_packing": op2_binary_packing,
    "op3_projected_neighbours": op3_projected_neighbours,
    "op4_minhash_dedup": op4_minhash_dedup,
    "op5_hmm_scores": op5_hmm_scores,
    "op6_mix_sources": op6_mix_sources,
    "op7_personal_data": op7_personal_data,
    "op8_attention_quality": op8_attention_quality,
    "op9_quality_rules": op9_quality_rules,
    "op10_token_lengths": op10_token_lengths,
    "op11_piece_table_fim": op11_piece_table_fim,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_filter_audit": op13_filter_audit,
}
ORACLE_SQL: dict[str, str] = {"op6_mix_sources": OP6_SQL, "op9_quality_rules": OP9_SQL, "op11_piece_table_fim": OP11_SQL, "op13_filter_audit": OP13_SQL}
