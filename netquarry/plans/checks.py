"""Scalar, consensus and sensitivity queries, each with SQL that gives the same rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import consensus, windows
from ..sources.packets import table
from .knowledge import _bm25, _bm25_sql, _chunks, _INDEX
from .traffic import _SYN, PACKETS, _packets, _with

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = sql


_add("scalar_formats", lambda s, d: table(s, d, "orders").select("o_orderkey", scalars.byte_size(F.col("o_orderkey") * F.col("o_custkey") * 64 + 3).alias("size"), scalars.duration(((F.col("o_orderkey") * 4 + 1) / 8.0)).alias("took")), """
WITH x AS (SELECT o_orderkey, o_orderkey * o_custkey * 64 + 3 AS n, (o_orderkey * 4 + 1) / 8.0::DOUBLE AS sec FROM orders)
SELECT o_orderkey, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KB', n / 1024.0::DOUBLE) WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576.0::DOUBLE) ELSE printf('%.2f GB', n / 1073741824.0::DOUBLE) END AS size,
       CASE WHEN sec < 60 THEN printf('%.1fs', sec) WHEN sec < 3600 THEN printf('%.1fmin', sec / 60) ELSE printf('%.2fh', sec / 3600) END AS took FROM x""")


def _addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    first = F.element_at(F.array(*[F.lit(x) for x in ("10", "172", "192", "8", "300", "169")]), (k % 6 + 1).cast("int"))
    text = F.concat_ws(".", first, (k % 260).cast("string"), (k % 7).cast("string"), (k % 256).cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.alias("ip"))


_add("address_kinds", lambda s, d: _addresses(s, d).select("o_orderkey", scalars.is_ipv4(F.col("ip")).alias("valid"), scalars.is_private_ipv4(F.col("ip")).alias("private"), scalars.indicator_type(F.col("ip")).alias("kind")), """
WITH a AS (SELECT o_orderkey, CAST(['10', '172', '192', '8', '300', '169'][o_orderkey % 6 + 1] AS INT) AS p, o_orderkey % 260 AS q FROM orders),
v AS (SELECT *, p <= 255 AND q <= 255 AS valid FROM a)
SELECT o_orderkey, valid, valid AND (p = 10 OR (p = 172 AND q BETWEEN 16 AND 31) OR (p = 192 AND q = 168) OR (p = 169 AND q = 254)) AS private, CASE WHEN valid THEN 'ip' ELSE 'domain' END AS kind FROM v""")


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(k % 3 == 0, "attack").when(k % 3 == 1, "normal").otherwise("unknown").alias("verdict"), (F.col("o_custkey") % 4).alias("alerts"), F.when(k % 11 == 0, 1).otherwise(0).alias("critical"),
        F.when(k % 7 > 0, k % 2 == 0).alias("fused"), (k % 100 / 100).alias("confidence"), F.when(k % 5 == 0, "fail").when(k % 5 == 1, "warning").otherwise("pass").alias("level"),
    )


def _consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    rows = consensus.consensus(_verdicts(spark, sf_dir), c("verdict"), c("alerts"), c("critical"), c("fused"), c("confidence"))
    return rows.select("o_orderkey", "consensus", "agreement_m", "confidence_m", "contradictions", "needs_review", consensus.review_priority(c("level"), c("needs_review"), c("agreement_m"), c("critical")).alias("priority"))


_add("consensus", _consensus, """
WITH v AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'attack' WHEN 1 THEN 'normal' ELSE 'unknown' END AS verdict, o_custkey % 4 AS alerts, CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END AS critical,
  CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey % 2 = 0 END AS fused, (o_orderkey % 100)::DOUBLE / 100 AS confidence, CASE o_orderkey % 5 WHEN 0 THEN 'fail' WHEN 1 THEN 'warning' ELSE 'pass' END AS level FROM orders),
n AS (SELECT *, CASE WHEN verdict = 'attack' THEN 1 ELSE 0 END + CASE WHEN alerts > 0 THEN 1 ELSE 0 END + CASE WHEN fused THEN 1 ELSE 0 END AS a, CASE WHEN verdict = 'normal' THEN 1 ELSE 0 END + CASE WHEN alerts <= 0 THEN 1 ELSE 0 END + CASE WHEN NOT fused THEN 1 ELSE 0 END AS b,
  CASE WHEN verdict = 'attack' AND NOT fused AND confidence > 0.8::DOUBLE THEN 1 ELSE 0 END + CASE WHEN verdict = 'normal' AND alerts > 0 AND critical > 0 THEN 1 ELSE 0 END + CASE WHEN fused AND alerts <= 0 AND confidence > 0.9::DOUBLE THEN 1 ELSE 0 END AS x FROM v),
m AS (SELECT *, CAST(greatest(a, b) * 1000 // (a + b) AS BIGINT) AS am FROM n),
r AS (SELECT *, x > 0 OR am < 600 AS review FROM m)
SELECT o_orderkey, CASE WHEN a > b THEN 'attack' WHEN b > a THEN 'normal' ELSE 'split' END AS consensus, am AS agreement_m, CAST(am * (10 - 3 * x) // 10 AS BIGINT) AS confidence_m, CAST(x AS BIGINT) AS contradictions, review AS needs_review,
  CASE WHEN level = 'fail' OR (review AND am < 500) THEN 'high' WHEN level = 'warning' OR review OR critical > 0 THEN 'medium' ELSE 'low' END AS priority FROM r""")


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as alerts, against the documents that BM25 finds for them."""
    t = F.col("text")
    alerts = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("alert_id"), F.array_distinct(F.split(t, " ")).alias("keywords"), consensus.numeric_fields(F.col("item_id") + 10, F.lit(443)).alias("numbers"), consensus.alert_tokens(F.concat(F.regexp_replace(t, r"[^\x00-\x7f]", " "), F.lit(" 10.0.0.1 tcp example.com"))).alias("tokens"))
    docs = _chunks(spark, sf_dir)
    found = _bm25(spark, sf_dir).where("rank <= 3").join(docs, "chunk_id")
    hits = found.select(F.col("query_id").alias("alert_id"), "rank", F.concat(F.coalesce("source", F.lit("")), F.lit(" port "), F.col("chunk_id") + 10).alias("title"), F.col("text").alias("content"), F.when(F.col("chunk_id") % 3 > 0, F.col("score") / 100).alias("similarity"))
    return consensus.matched_evidence(alerts, hits)


_add("evidence_match", _evidence, f"WITH {_INDEX},{_bm25_sql('bm')}," + r"""
a AS (SELECT item_id AS alert_id, list_distinct(string_split(text, ' ')) AS keywords, list_filter([item_id + 10, 443], lambda x: x BETWEEN 1 AND 65535) AS numbers,
        list_distinct(regexp_extract_all(regexp_replace(text, '[^\x00-\x7f]', ' ', 'g') || ' 10.0.0.1 tcp example.com', '\b(?:\d{1,3}\.){3}\d{1,3}\b') || regexp_extract_all(regexp_replace(text, '[^\x00-\x7f]', ' ', 'g') || ' 10.0.0.1 tcp example.com', '\b[a-zA-Z0-9][a-zA-Z0-9.-]*\.[a-zA-Z]{2,}\b') || regexp_extract_all(regexp_replace(text, '[^\x00-\x7f]', ' ', 'g') || ' 10.0.0.1 tcp example.com', '(?i)\b(?:TCP|UDP|DNS|HTTP|HTTPS|ICMP|RST|SYN|ACK)\b')) AS tokens FROM benchmark),
h AS (SELECT query_id AS alert_id, rank, text AS content, CASE WHEN doc_id % 3 > 0 THEN score / 100 END AS sim, list_transform(list_distinct(regexp_extract_all(regexp_replace(text, '[^\x00-\x7f\p{P}\p{S}\p{Z}\p{C}]', 'x', 'g') || ' ' || coalesce(source, '') || ' port ' || (doc_id + 10), '\b(\d{2,5})\b', 1)), lambda x: CAST(x AS BIGINT)) AS known FROM bm JOIN documents ON doc_id = chunk_id WHERE rank <= 3),
b AS (SELECT alert_id, rank, sim, 0.45::DOUBLE * CASE WHEN len(keywords) > 0 THEN len(list_filter(keywords, lambda w: contains(content, w)))::DOUBLE / len(keywords) ELSE 0 END
        + 0.30::DOUBLE * CASE WHEN len(known) > 0 THEN len(list_intersect(list_distinct(known), numbers))::DOUBLE / len(list_distinct(known)) ELSE 0 END + 0.10::DOUBLE * least(1.0::DOUBLE, len(list_filter(tokens, lambda w: contains(content, w)))::DOUBLE / 3) AS base FROM a LEFT JOIN h USING (alert_id)),
s AS (SELECT alert_id, rank, CASE WHEN rank IS NULL THEN 0 ELSE round(least(CASE WHEN sim IS NULL THEN base / 0.85::DOUBLE ELSE base + 0.25::DOUBLE * least(1.0, sim) END, 1.0) + 1e-9, 4) END AS score FROM b)
SELECT alert_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY alert_id ORDER BY score DESC, rank) AS k FROM s) WHERE k = 1""")


def _risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    rows = consensus.consensus(_verdicts(spark, sf_dir), c("verdict"), c("alerts"), c("critical"), c("fused"), c("confidence"))
    rows = rows.withColumn("priority", consensus.review_priority(c("level"), c("needs_review"), c("agreement_m"), c("critical")))
    return consensus.overall_risk(rows, c("o_orderkey") % 13 > 0, c("o_orderkey") % 1001, c("confidence_m"), c("needs_review"), c("priority")).select("o_orderkey", "overall_m", "risk")


_add("overall_risk", _risks, ORACLE_SQL["consensus"].replace("SELECT o_orderkey, CASE WHEN a > b THEN 'attack'", ", f AS (SELECT o_orderkey, CASE WHEN a > b THEN 'attack'") + """)
SELECT o_orderkey, CASE WHEN o_orderkey % 13 > 0 THEN CAST((o_orderkey % 1001 * 4 + confidence_m * 4) // 10 + CASE WHEN needs_review THEN 0 ELSE 200 END AS BIGINT) ELSE 0 END AS overall_m, CASE WHEN o_orderkey % 13 = 0 THEN 'unavailable' ELSE priority END AS risk FROM f""")


def _votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("turn") % 3 == 0).alias("threat"), F.when(F.col("turn") % 2 == 0, F.col("conv_id") % 8 / 8).alias("confidence"), F.concat(F.lit("step "), (F.col("turn") % 4).cast("string")).alias("action"))


_add("vote_majority", lambda s, d: consensus.vote_majority(_votes(s, d), "conv_id"), """
WITH v AS (SELECT conv_id, turn % 3 = 0 AS t, CASE WHEN turn % 2 = 0 THEN (conv_id % 8)::DOUBLE / 8 END AS c FROM conversations),
g AS (SELECT conv_id, count(*) AS n, count(*) FILTER (t) AS y, avg(coalesce(nullif(c, 0), 0.5)) AS m FROM v GROUP BY 1)
SELECT conv_id, y * 2 > n AS is_threat, round(y::DOUBLE / n, 3) AS agreement, round(m * (0.5 + y::DOUBLE / n / 2) + 1e-9, 3) AS confidence FROM g""")
_add("vote_union", lambda s, d: consensus.first_distinct(_votes(s, d), "conv_id", "action", "turn"), """
WITH v AS (SELECT conv_id, 'step ' || (turn % 4) AS action, min(turn) AS f FROM conversations GROUP BY 1, 2)
SELECT conv_id, place, action FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY f, action) AS place FROM v) WHERE place <= 12""")
_SIZES = (1800, 3600, 7200)


def _window_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows and their busiest packet count at several window lengths."""
    each = [windows.windows(_packets(spark, sf_dir), w).agg(F.lit(w).cast("long").alias("window_sec"), F.count(F.lit(1)).alias("windows"), F.max("packets").alias("most"), F.sum("syn").alias("syn")) for w in _SIZES]
    return reduce(DataFrame.unionByName, each)


_add("window_size_sensitivity", _window_sizes, _with(PACKETS) + f""",
t AS (SELECT min_by(ts_ms, pkt_seq) AS t0 FROM packets),
w AS (SELECT s AS window_sec, floor((ts_ms - t0) / (s * 1000.0::DOUBLE)) AS b, count(*) AS n, count(*) FILTER ({_SYN}) AS syn FROM packets, t, (VALUES {", ".join(f"({w}::BIGINT)" for w in _SIZES)}) x(s) GROUP BY 1, 2)
SELECT window_sec, count(*) AS windows, max(n) AS most, CAST(sum(syn) AS BIGINT) AS syn FROM w GROUP BY 1""")
