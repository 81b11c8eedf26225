"""Lexical and vector retrieval for batches of queries, rank fusion and reranking."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import if_small, materialize

#: English words that are never terms.
STOP_WORDS = ["the", "a", "an", "of", "to", "in", "on", "for", "and", "or", "with", "is", "are", "was", "were", "be", "been", "how", "what", "which", "why"]

_HAN = r"[\x{4e00}-\x{9fff}]+"


def terms(text: Column) -> Column:
    """ASCII words of two letters or more that are no stop words, then pairs of neighbouring Han characters (or a lone one)."""
    latin = F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-zA-Z0-9_]+"), F.lit(0)), lambda w: (F.length(w) > 1) & ~w.isin(STOP_WORDS))
    runs = F.regexp_extract_all(text, F.lit(_HAN), F.lit(0))
    pairs = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(
        F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, 2)))))
    return F.when(text.rlike(_HAN), F.concat(latin, pairs)).otherwise(latin)


def postings(chunks: DataFrame) -> DataFrame:
    """term, chunk_id, tf and dl (terms of the chunk, repeats counted)."""
    listed = chunks.select("chunk_id", terms(F.col("text")).alias("t"))
    return listed.select("chunk_id", F.size("t").cast("long").alias("dl"), F.explode("t").alias("term")).groupBy("term", "chunk_id", "dl").agg(F.count(F.lit(1)).alias("tf"))


@dataclass(frozen=True)
class Asked:
    """Query terms by number (query_id, word), and for every chunk of ``dl`` terms its count ``tf`` of each of them; the null word counts the chunk itself."""

    terms: DataFrame
    counts: DataFrame


def ask(chunks: DataFrame, queries: DataFrame) -> Asked:
    """One pass over the texts: terms that no query asks only count for the length."""
    asked = queries.select("query_id", F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    words = materialize(asked.select("term").distinct().withColumn("word", F.monotonically_increasing_id()), "words")
    listed = chunks.select("chunk_id", F.coalesce(terms(F.col("text")), F.expr("cast(array() as array<string>)")).alias("t"))
    each = listed.select("chunk_id", F.size("t").cast("long").alias("dl"), F.concat("t", F.array(F.lit(None).cast("string"))).alias("t")).select("chunk_id", "dl", F.explode("t").alias("term"))
    known = each.join(if_small(words), "term", "left").where("word is not null or term is null")
    counts = known.groupBy("chunk_id", "dl", "word").agg(F.count(F.lit(1)).alias("tf"))
    return Asked(materialize(asked.join(words, "term").select("query_id", "word"), "asked"), materialize(counts, "term-counts"))


def _best(value: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns and rows of the k greatest values of every column, of those that tie at the k-th place the first; -inf is none."""
    far = -value.T
    kept = np.isfinite(far)
    if far.shape[1] > k:
        last = np.partition(far, k - 1, axis=1)[:, k - 1 : k]
        nearer, tied = far < last, kept & (far == last)
        kept = nearer | (tied & (np.cumsum(tied, axis=1, dtype=np.int32) <= k - nearer.sum(axis=1, keepdims=True)))
    return np.nonzero(kept)


def _best_of_shard(k: int, lists: tuple[str, ...], block: int):
    """Query terms (query_id, word, idf) and counts (chunk_id, word, weight) of a shard, in any order -> the k best chunks of the shard for each query and list."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows, schema = pa.Table.from_batches(held), held[0].schema
        asks = rows["query_id"].is_valid()
        part = lambda mask, *names: [rows[c].filter(mask).to_numpy() for c in names]
        q_id, q_word, idf = part(asks, "query_id", "word", "weight")
        c_id, c_word, weight = part(pc.invert(asks), "chunk_id", "word", "weight")
        if not len(q_id) or not len(c_id):
            return
        order = np.argsort(q_word, kind="stable")
        (queries, q), q_word, idf = np.unique(q_id[order], return_inverse=True), q_word[order], idf[order]
        order = np.argsort(c_id, kind="stable")
        (chunks, at), c_word, weight = np.unique(c_id[order], return_inverse=True), c_word[order], weight[order]
        low = np.searchsorted(q_word, c_word, "left")
        times = np.searchsorted(q_word, c_word, "right") - low  # queries that ask a count's word
        cost = np.cumsum(np.bincount(at, times) + len(queries))  # by chunk: products and cells
        first = np.searchsorted(cost // block, np.unique(cost // block))  # chunks that begin a block
        found = {name: [] for name in lists}
        for a, z in zip(first.tolist(), [*first[1:].tolist(), len(chunks)]):
            lo, hi = np.searchsorted(at, [a, z])
            of = np.repeat(np.arange(lo, hi), times[lo:hi])
            end = np.cumsum(times[lo:hi])
            to = np.arange(len(of)) - np.repeat(end - times[lo:hi] - low[lo:hi], times[lo:hi])
            cell = (at[of] - a) * len(queries) + q[to]
            shape = (z - a, len(queries))
            shared = np.bincount(cell, minlength=shape[0] * shape[1]).reshape(shape)
            for name in lists:
                value = shared if name == "overlap" else np.round(np.bincount(cell, idf[to] * weight[of], minlength=shape[0] * shape[1]).reshape(shape), 6)
                value = np.where(shared > 0, value, -np.inf)
                column, row = _best(value, k)
                found[name].append((column, row + a, value[row, column]))
        for name in lists:
            column, row, value = (np.concatenate(x) for x in zip(*found[name]))
            order = np.lexsort((row, -value, column))
            column, row, value = column[order], row[order], value[order]
            kept = np.arange(len(column)) - np.searchsorted(column, column) < k
            yield pa.RecordBatch.from_arrays(
                [pa.array(queries[column[kept]], schema.field("query_id").type), pa.array([name] * int(kept.sum()), pa.string()), pa.array(chunks[row[kept]], schema.field("chunk_id").type), pa.array(value[kept])],
                names=["query_id", "list", "chunk_id", "score"])

    return search


def ranked(index: Asked, lists: tuple[str, ...] = ("bm25", "overlap"), k: int = 20, k1: float = 1.5, b: float = 0.75, within: DataFrame | None = None, shard_rows: int = 400_000, block: int = 1_000_000) -> DataFrame:
    """query_id, list, chunk_id, score, rank of the best chunks of every query: by BM25, and by ``overlap``, the number of distinct query terms they hold.

    Counts lie in shards of about ``shard_rows`` and are moved once; query terms are sent to every shard. Products of terms and chunks, which are
    many times the counts, stay in the shard (``block`` at once), and k chunks a query leave it. ``within`` (chunk_id) filters chunks, not statistics.
    """
    chunk = F.col("word").isNull()
    whole = index.counts.agg(F.sum(F.when(chunk, F.col("tf"))).alias("chunks"), F.sum(F.when(chunk, F.col("tf") * F.col("dl"))).alias("terms"), F.count("word").alias("hits")).first()
    n, shards = whole.chunks or 0, max(1, -(-whole.hits // shard_rows))
    hits = index.counts.where(~chunk)
    df = hits.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    if within is not None:
        hits = hits.join(within.select("chunk_id"), "chunk_id", "left_semi")
    norm = F.col("tf") + k1 * (1 - b + b * F.col("dl") / ((whole.terms or 1) / max(n, 1)))
    own = hits.where("chunk_id is not null").select(F.pmod(F.xxhash64("chunk_id"), F.lit(shards)).cast("int").alias("shard"), F.lit(None).cast(index.terms.schema["query_id"].dataType).alias("query_id"), "chunk_id", "word", (F.col("tf") * (k1 + 1) / norm).alias("weight"))
    idf = F.log1p((n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = index.terms.join(df, "word").where("query_id is not null").select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "query_id", F.lit(None).cast(hits.schema["chunk_id"].dataType).alias("chunk_id"), "word", idf.alias("weight"))
    placed = own.unionByName(asked).repartitionById(shards, F.col("shard")).drop("shard")
    kind = lambda df_, c: df_.schema[c].dataType.simpleString()
    best = placed.mapInArrow(_best_of_shard(k, lists, block), f"query_id {kind(index.terms, 'query_id')}, list string, chunk_id {kind(hits, 'chunk_id')}, score double")
    return top(best, k, "list")


def bm25(index: Asked, k: int = 20, k1: float = 1.5, b: float = 0.75, within: DataFrame | None = None) -> DataFrame:
    """query_id, rank, chunk_id, score of the best chunks of every query; ``within`` (chunk_id) filters chunks, not statistics."""
    return ranked(index, ("bm25",), k, k1, b, within).drop("list")


def having(chunks: DataFrame, **values) -> DataFrame:
    """Chunks whose columns have all of the given values."""
    return chunks.where(reduce(lambda x, y: x & y, [F.col(c) == F.lit(v) for c, v in values.items()], F.lit(True)))


def top(scored: DataFrame, k: int, *by: str) -> DataFrame:
    """The k best of every query (and of each value of ``by``)."""
    order = Window.partitionBy("query_id", *by).orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def overlap(index: Asked, k: int = 20) -> DataFrame:
    """Chunks by the number of distinct query terms they hold."""
    return ranked(index, ("overlap",), k).drop("list")


def fuse(lists: list[DataFrame], k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (query_id, chunk_id, rank from 1)."""
    every = lists[0].select("query_id", "chunk_id", "rank")
    for x in lists[1:]:
        every = every.unionByName(x.select("query_id", "chunk_id", "rank"))
    return every.groupBy("query_id", "chunk_id").agg(F.round(F.sum(1 / (k + F.col("rank"))), 9).alias("score"))


def normalised(v: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(v, lambda x: x / F.when(length > 0, length).otherwise(1.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _unit(rows: np.ndarray) -> np.ndarray:
    length = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return rows / np.where(length > 0, length, 1.0)


def _nearest_of_shard(k: int, block: int):
    """Rows (in order of id) and then queries of every shard -> the k nearest rows of the shard for each query, by distance to 6 places and then by id."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            shards, asks, ids = (batch.column(i).to_numpy() for i in range(3))
            vectors = _unit(np.asarray(batch.column(3).flatten(), float).reshape(batch.num_rows, -1))
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(shards.astype(np.int64) * 2 + asks)) + 1, [len(ids)]])
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if shards[a] != shard:
                    shard, held = shards[a], []
                if not asks[a]:
                    held.append((ids[a:b], vectors[a:b]))
                    continue
                if len(held) > 1:
                    held = [tuple(np.concatenate(x) for x in zip(*held))]
                if not held:
                    continue
                rows, matrix = held[0]
                for start in range(a, b, block):
                    own = slice(start, min(b, start + block))
                    score = vectors[own] @ matrix.T
                    score[rows[None, :] == ids[own][:, None]] = -np.inf
                    far = np.round(1 - score, 6)
                    if far.shape[1] > k:  # of rows that tie at the k-th place, the first
                        last = np.partition(far, k - 1, axis=1)[:, k - 1 : k]
                        nearer, tied = far < last, far == last
                        kept = nearer | (tied & (np.cumsum(tied, axis=1, dtype=np.int32) <= k - nearer.sum(axis=1, keepdims=True)))
                    else:
                        kept = np.ones(far.shape, bool)
                    q, r = np.nonzero(kept & np.isfinite(far))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[own][q]), pa.array(rows[r]), pa.array(far[q, r])], names=["query_id", "chunk_id", "distance"])

    return search


def vector_top(vectors: DataFrame, queries: DataFrame, k: int, shard_rows: int = 50_000, block: int = 256) -> DataFrame:
    """Nearest vectors by cosine distance, exactly (to 6 places, ties by id): a stated query set against all rows, in blocks.

    Rows lie in shards and are moved once; queries are sent to every shard and stream through it.
    """
    rows = vectors.where("vec_id is not null and embedding is not null").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    shards = max(1, -(-rows.count() // shard_rows))
    own = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("ask"), "vec_id", "v")
    asked = queries.where("vec_id is not null and embedding is not null").select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("ask"), "vec_id", F.col("embedding").cast("array<double>").alias("v"))
    both = own.unionByName(asked).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "ask", "vec_id")
    near = both.mapInArrow(_nearest_of_shard(k, block), "query_id long, chunk_id long, distance double")
    order = Window.partitionBy("query_id").orderBy("distance", "chunk_id")
    return near.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def distances(pairs: DataFrame, vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """``pairs`` (query_id, chunk_id) with their exact cosine distance; null where either has no vector."""
    unit = lambda df, name: df.select(F.col("vec_id").alias(name), normalised(F.col("embedding").cast("array<double>")).alias(f"v_{name}"))
    known = pairs.join(unit(vectors, "chunk_id"), "chunk_id", "left").join(unit(queries, "query_id"), "query_id", "left")
    return known.withColumn("distance", F.round(1 - dot(F.col("v_chunk_id"), F.col("v_query_id")), 6)).drop("v_chunk_id", "v_query_id")


#: Abbreviations and what a query that names one also asks for.
TERM_SYNONYMS = {
    "BGP": "边界网关协议 BGP", "OSPF": "开放最短路径优先 OSPF", "RIP": "路由信息协议 RIP",
    "T1046": "T1046 网络服务扫描", "T1110": "T1110 暴力破解", "T1498": "T1498 网络拒绝服务", "T1572": "T1572 协议隧道", "T1071": "T1071 应用层协议",
    "T1048": "T1048 数据渗出", "T1090": "T1090 代理", "T1021": "T1021 远程服务", "T1005": "T1005 本地数据窃取", "T1082": "T1082 系统信息发现",
    "XSS": "跨站脚本 XSS", "CSRF": "跨站请求伪造 CSRF", "SQLi": "SQL注入 SQLi",
    "SSH": "SSH 安全外壳", "RDP": "RDP 远程桌面", "FTP": "FTP 文件传输", "HTTP": "HTTP 超文本传输", "HTTPS": "HTTPS 超文本传输安全", "DNS": "DNS 域名系统",
    "DHCP": "DHCP 动态主机配置", "NTP": "NTP 网络时间协议", "SNMP": "SNMP 简单网络管理",
    "Wireshark": "Wireshark 网络封包分析", "Nmap": "Nmap 网络扫描", "Tcpdump": "Tcpdump 命令行抓包", "Snort": "Snort 入侵检测",
    "SSL": "SSL 安全套接层", "TLS": "TLS 传输层安全", "IPsec": "IPsec 互联网协议安全", "VPN": "VPN 虚拟专用网络",
}

#: Core terms of the domain that reranking looks for.
CORE_TERMS = [
    "dns", "http", "https", "tcp", "udp", "icmp", "arp", "ospf", "bgp", "rip",
    "ip", "ssl", "tls", "ipsec", "ftp", "ssh", "rdp", "smb", "dhcp", "vlan",
    "sql", "xss", "csrf", "syn", "ack", "端口", "登录", "登陆", "数据包", "流量",
    "带宽", "密码", "暴力", "注入", "钓鱼", "勒索", "木马", "病毒", "恶意", "隧道",
    "代理", "横向", "持久化", "侦察", "扫描", "渗出", "泄露", "防火墙", "路由", "交换",
    "连接", "会话", "证书", "加密", "认证", "权限", "命令", "脚本", "进程",
]


def expanded(text: Column) -> Column:
    """A query with its abbreviations written out, longest first, where they stand alone."""
    for short in sorted(TERM_SYNONYMS, key=len, reverse=True):
        text = F.regexp_replace(text, rf"(?<![A-Za-z0-9]){short}(?![A-Za-z0-9])", TERM_SYNONYMS[short])
    return text


#: What marks a question as a comparison, what stands between the two things compared, and endings that ask nothing more.
COMPARISONS = ("有什么区别", "有什么不同", "有什么关系", "有何区别", "有什么区别吗", "的区别", "的差异", "的不同", "的对比")
BETWEEN = ("和", "与", "及", "、", "vs", "VS")
ASKS_NOTHING = ("是什么", "什么意思", "什么", "有何区别", "有哪些区别", "")


def sub_queries(text: Column) -> Column:
    """A comparison as two questions, one for each thing, both with what else is asked; any other text as itself."""
    t = F.trim(F.coalesce(text, F.lit("")))
    cut = F.split(t, "的?(?:" + "|".join(COMPARISONS) + ")", 2)
    sides = F.split(F.trim(cut[0]), "(?:" + "|".join(b + r"\.?" if b.isascii() else b for b in BETWEEN) + ")", 2)
    tail = F.trim(F.coalesce(F.get(cut, F.lit(1)), F.lit("")))
    bare = F.regexp_replace(tail, r"^[？?，,。. 　]+|[？?，,。. 　]+$", "")
    more = F.when(bare.isin(*ASKS_NOTHING), "是什么").when(tail.rlike("^[，,？?。.]"), tail).otherwise(F.concat(F.lit("，"), tail))
    a, b = F.trim(sides[0]), F.trim(F.coalesce(F.get(sides, F.lit(1)), F.lit("")))
    return F.when((F.size(cut) == 2) & (F.size(sides) == 2) & (a != "") & (b != ""), F.array(F.concat(a, more), F.concat(b, more))).otherwise(F.array(F.coalesce(text, F.lit(""))))


def compared(found: DataFrame, k: int = 5) -> DataFrame:
    """Hits of sub-queries (query_id, sub, chunk_id, rank) as one list of k a query: the first sub-query's hits in their order, then what the next adds."""
    seen = found.groupBy("query_id", "chunk_id").agg(F.min(F.struct("sub", "rank")).alias("at"))
    order = Window.partitionBy("query_id").orderBy("at", "chunk_id")
    return seen.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k).select("query_id", "chunk_id", "rank", F.col("at.sub").alias("sub"))


def core_terms(text: Column) -> Column:
    """Core terms that a query names; the whole query where it names none."""
    low = F.lower(text)
    hits = F.filter(F.array(*[F.lit(t) for t in CORE_TERMS]), lambda t: F.contains(low, t))
    return F.when(F.size(hits) > 0, hits).otherwise(F.array(low))


def titled(title: Column, content: Column) -> Column:
    """A knowledge item as the text that is indexed."""
    return F.when(F.length(F.coalesce(title, F.lit(""))) > 0, F.concat(F.lit("【"), title, F.lit("】\n"), content)).otherwise(content)


def hybrid(index: Asked, chunks: DataFrame, queries: DataFrame, vectors: DataFrame, query_vectors: DataFrame, k: int = 5, pool: int = 20) -> DataFrame:
    """Hybrid search: query_id, chunk_id, similarity and rerank_score of the k best of every query, in order of ``rank``.

    The ``pool`` best by BM25 (an index of the expanded queries) and by vectors are fused by reciprocal ranks; where they are fewer than k, the
    next nearest vectors (3k) fill up. The k that lead are given their exact distance and reranked.
    ``chunks``: chunk_id, title, content, meta; ``queries``: query_id, text.
    """
    near = vector_top(vectors, query_vectors, max(pool, 3 * k))
    fused = top(fuse([bm25(index, pool), near.where(F.col("rank") <= pool)]), k).select("query_id", "chunk_id", F.col("rank").alias("place"))
    have = fused.groupBy("query_id").agg(F.count(F.lit(1)).alias("have"))
    spare = near.where(F.col("rank") <= 3 * k).join(fused, ["query_id", "chunk_id"], "left_anti").join(have, "query_id", "left")
    spare = spare.where(F.coalesce("have", F.lit(0)) < k).select("query_id", "chunk_id", (F.lit(pool) + F.col("rank")).alias("place"))
    order = Window.partitionBy("query_id").orderBy("place")
    led = fused.unionByName(spare).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    known = distances(led, vectors, query_vectors).join(chunks, "chunk_id").withColumn("similarity", F.round(similarity(F.col("distance")), 7))
    scored = rerank(known, queries.select("query_id", core_terms(F.col("text")).alias("cores")))
    rows = known.select("query_id", "chunk_id", "place", "similarity").join(scored, ["query_id", "chunk_id"])
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "place")).cast("long")).drop("place")


def rendered(rank: Column, title: Column, content: Column, similarity_: Column, longest: int = 500) -> Column:
    """A hit as a block of a prompt; an unknown similarity says so."""
    sim = F.coalesce(F.when(similarity_.isNotNull(), F.format_string("%.2f", F.bround(similarity_, 2))), F.lit("未知"))
    return F.concat(F.lit("["), rank.cast("string"), F.lit("] "), title, F.lit(" ("), sim, F.lit(")\n"), F.substring(content, 1, longest))


def similarity(distance: Column) -> Column:
    return 1 - F.least(F.greatest(distance, F.lit(0.0)), F.lit(2.0)) / 2


def rerank(hits: DataFrame, cores: DataFrame) -> DataFrame:
    """Hits (query_id, chunk_id, similarity or null, title, content, meta) by similarity and core terms in their parts.

    ``cores``: query_id and ``cores`` (array of terms). Similarities are spread to 0..1 within a
    query; a hit without one, or a query whose hits are equal, gets 0.5.
    """
    whole = Window.partitionBy("query_id")
    rows = hits.join(cores, "query_id", "left").withColumns({"lo": F.min("similarity").over(whole), "hi": F.max("similarity").over(whole)})
    spread = F.col("hi") - F.col("lo")
    base = F.when(F.col("similarity").isNull() | (spread < 1e-9), 0.5).otherwise((F.col("similarity") - F.col("lo")) / spread)
    held = F.coalesce("cores", F.expr("cast(array() as array<string>)"))
    n = F.greatest(F.size(held), F.lit(1))
    count = lambda c: F.size(F.filter(held, lambda x: F.contains(F.lower(c), x)))
    t = count(F.col("title"))
    score = base * 0.45 + t / n * 0.25 + count(F.col("content")) / n * 0.15 + count(F.col("meta")) / n * 0.05
    bonus = F.when((t >= 2) | ((t >= 1) & (F.length("title") <= 20)), 0.10).otherwise(0.0)
    return rows.select("query_id", "chunk_id", F.round(score + bonus + 1e-9, 4).alias("rerank_score"))  # halves go up however the sum was added


def recall_at(found: DataFrame, relevant: Column, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Queries whose first relevant rank is within k, and the sum of 1/rank in millionths."""
    first = found.groupBy("query_id").agg(F.min(F.when(relevant, F.col("rank"))).alias("r"))
    return first.agg(F.count(F.lit(1)).alias("queries"), *[F.count_if(F.col("r") <= k).alias(f"hits_at_{k}") for k in ks], F.sum(F.coalesce(F.floor(1_000_000 / F.col("r")), F.lit(0))).cast("long").alias("mrr_millionths"))


#: Where texts may be cut, the first that occurs first; the empty one cuts anywhere.
SEPARATORS = ("\n\n", "\n", "。", "！", "？", ".", "!", "?", " ", "")


def _joined(parts: list[str], size: int, lap: int) -> list[str]:
    """Parts put together up to ``size``; the next text begins with the last parts of ``lap`` characters at most."""
    out, held, total = [], [], 0
    for part in parts:
        if total + len(part) > size and held:
            out.append("".join(held).strip())
            while total > lap or (total and total + len(part) > size):
                total -= len(held.pop(0))
        held.append(part)
        total += len(part)
    return [x for x in [*out, "".join(held).strip()] if x]


def cut_text(text: str, size: int = 1000, lap: int = 50, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Recursive splitting; a separator stays with what follows it."""
    at = next((i for i, x in enumerate(separators) if x == "" or x in text), len(separators) - 1)
    sep, finer = separators[at], separators[at + 1 :]
    head, *tail = text.split(sep) if sep else [text]
    parts = ([head] if head else []) + [sep + x for x in tail] if sep else list(text)
    out, short = [], []
    for part in parts:
        if len(part) < size:
            short.append(part)
            continue
        out += _joined(short, size, lap)
        short = []
        out += cut_text(part, size, lap, finer) if finer else [part]
    return out + _joined(short, size, lap)


def split_text(texts: DataFrame, size: int = 1000, lap: int = 50, separators: tuple[str, ...] = SEPARATORS) -> DataFrame:
    """(doc_id, text) -> doc_id, chunk_no, text. Rows are independent; a null text has no chunks, a null id stays null."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, n, c) for i, t in enumerate(b.column(1).to_pylist()) for n, c in enumerate(cut_text(t or "", size, lap, separators))]
            of, no, text = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of, pa.int64())), pa.array(no, pa.int64()), pa.array(text, pa.string())], names=["doc_id", "chunk_no", "text"])

    return texts.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(make, "doc_id long, chunk_no long, text string")


def keyword_recall(found: DataFrame, golden: DataFrame, k: int = 5) -> DataFrame:
    """For every query: if a hit up to k holds any of its keywords, and if one holds them all. ``golden``: query_id, keywords."""
    rows = golden.join(found.where(F.col("rank") <= k), "query_id", "left")
    has = lambda w: F.contains(F.lower(F.coalesce("content", F.lit(""))), F.lower(w))
    return rows.groupBy("query_id").agg(F.max(F.exists("keywords", has)).alias("any_hit"), F.max(F.forall("keywords", has)).alias("all_hit"))
