"""Checks and scores around results: inputs, numbers of a report, technique look-ups, judgements, samples with expected findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import numbered
from .rules import detector

#: What an alert's type is called, and what retrieval and matching look for.
ALERT_LABELS = {
    "SYN_FLOOD_SUSPECTED": "SYN洪水 DDoS", "PORT_SCAN_SUSPECTED": "端口扫描", "DNS_TUNNEL_SUSPECTED": "DNS隧道", "LARGE_DATA_TRANSFER": "数据渗出",
    "RST_STORM": "RST风暴", "BASELINE_DEVIATION": "时序基线偏差", "ML_ANOMALY": "机器学习异常",
}
ALERT_PROFILES = {
    "SYN_FLOOD_SUSPECTED": ("SYN洪水 拒绝服务 洪泛攻击 检测", ["SYN", "洪水", "洪泛", "DDoS", "拒绝服务", "半开"]),
    "PORT_SCAN_SUSPECTED": ("端口扫描 网络服务扫描 侦察 T1046", ["扫描", "SYN", "端口", "侦察", "探测"]),
    "DNS_TUNNEL_SUSPECTED": ("DNS隧道 命令与控制 异常DNS查询", ["DNS", "隧道", "查询", "命令控制", "编码"]),
    "LARGE_DATA_TRANSFER": ("数据渗出 数据外传 大流量传输 DLP", ["渗出", "数据", "传输", "外传", "DLP", "出站"]),
    "RST_STORM": ("RST 连接重置 扫描 异常流量", ["RST", "重置", "扫描", "连接"]),
    "BASELINE_DEVIATION": ("流量异常 统计基线 时序偏差 检测", ["基线", "异常", "偏差", "统计", "时序"]),
    "ML_ANOMALY": ("无监督异常检测 流量异常 机器学习", ["异常", "检测", "机器学习", "无监督"]),
}
NO_THREAT = "网络异常"
#: Words by which a recommendation names an action.
ACTIONS = ["封禁", "隔离", "阻断", "过滤", "限制", "升级", "查杀", "监控", "告警", "通知", "分析", "调查", "检查", "关闭", "修复", "加固", "block", "isolate", "quarantine", "disable", "monitor", "patch"]
ACTION_PATTERN = r"(?i)\b(?:block|deny|drop|isolate|quarantine|disable|limit)\b"
#: Files that may be uploaded, and characters that a name may not hold.
UPLOADS = (".pcap", ".pcapng", ".cap", ".pcap.gz")
FORBIDDEN = r'[\\/:*?"<>|]'
INNER_HOSTS = ("localhost", "metadata", "metadata.google.internal")


def _map(values: dict[str, Column | str]) -> Column:
    return F.create_map(*[x if isinstance(x, Column) else F.lit(x) for kv in values.items() for x in kv])


def alert_label(kind: Column) -> Column:
    """What a type is called; the type itself where it has no name."""
    return F.coalesce(F.try_element_at(_map(ALERT_LABELS), kind), kind)


def alert_profiles(alerts: DataFrame) -> DataFrame:
    """``alerts`` with ``label``, and ``query`` and ``keywords`` that knowledge is asked with (the type and no keywords where there is no profile)."""
    query = F.try_element_at(_map({k: q for k, (q, _) in ALERT_PROFILES.items()}), F.col("type"))
    words = F.try_element_at(_map({k: F.array(*[F.lit(w) for w in ws]) for k, (_, ws) in ALERT_PROFILES.items()}), F.col("type"))
    return alerts.withColumns({"label": alert_label(F.col("type")), "query": F.coalesce(query, F.col("type")), "keywords": F.coalesce(words, F.expr("cast(array() as array<string>)"))})


def threat_types(alerts: DataFrame, by: str, order: list[str]) -> DataFrame:
    """The labels of every group's types, each once in the order of its first alert: (by, threats)."""
    first = alerts.where("type is not null and type <> ''").groupBy(by, "type").agg(F.min(F.struct(*order)).alias("at"))
    listed = first.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("at", alert_label(F.col("type")).alias("label")))).alias("x"))
    every = alerts.select(by).distinct().join(listed, by, "left")
    return every.select(by, F.coalesce(F.array_join(F.transform("x", lambda r: r["label"]), " "), F.lit(NO_THREAT)).alias("threats"))


def by_detector(alerts: DataFrame, name: str) -> DataFrame:
    """Alerts that a detector raised."""
    return alerts.where(detector(F.col("type")) == name)


def fingerprint(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: ``rows`` and ``fingerprint``, 16 digits that depend on the rows' values and how often they occur, not on their order.

    Digests of rows are added up in four lanes, so nothing is sorted or gathered.
    """
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns])
    digest = F.sha2(text, 256)
    lanes = [F.sum(F.conv(F.substring(digest, 1 + 12 * k, 12), 16, 10).cast("decimal(20,0)")) for k in range(4)]
    one = rows.agg(F.count(F.lit(1)).alias("rows"), *[lane.alias(f"l{k}") for k, lane in enumerate(lanes)])
    return one.select("rows", F.substring(F.sha2(F.concat_ws(":", F.col("rows").cast("string"), *[F.coalesce(F.col(f"l{k}"), F.lit(0)).cast("decimal(38,0)").cast("string") for k in range(4)]), 256), 1, 16).alias("fingerprint"))


def coerced(token: Column, default: float = 0.0) -> Column:
    """struct<value, raw> of a JSON value's text: a number, or a string that reads as one; for anything else the default, and what stood there."""
    t = F.trim(token)
    quoted = t.rlike('^".*"$')
    inner = F.when(quoted, F.substring(t, F.lit(2), F.length(t) - 2)).otherwise(t)
    number = F.when(F.trim(inner).rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), F.trim(inner).cast("double"))
    raw = F.when(token.isNull() | (t == "null"), "None").when(~quoted & (t == "true"), "True").when(~quoted & (t == "false"), "False").otherwise(inner)
    return F.struct(F.coalesce(number, F.lit(default)).alias("value"), F.when(number.isNull(), raw).alias("raw"))


def shown_confidence(token: Column) -> Column:
    """A confidence to two places, with what stood there if it is no number."""
    c = coerced(token)
    return F.concat(F.format_string("%.2f", c["value"]), F.when(c["raw"].isNotNull(), F.concat(F.lit("（原始值不可解析: "), c["raw"], F.lit("）"))).otherwise(""))


def by_technique(techniques: DataFrame, number: str) -> DataFrame:
    """The technique of a number, in either case."""
    return techniques.where(F.upper("technique") == number.upper())


def by_tactic(techniques: DataFrame, tactic: str) -> DataFrame:
    return techniques.where(F.col("tactic") == tactic)


def upload_error(name: Column, size: Column, ends: tuple[str, ...] = UPLOADS, most_mb: int = 200) -> Column:
    """Why a file may not be uploaded: its end, then its size; null where it may. Only the last end counts."""
    end = F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"[^./\\]+(\.[^./\\]*)$", 1))
    listed = ", ".join(sorted(ends))
    return F.when(~end.isin(*ends), F.concat(F.lit("不支持的文件类型 "), end, F.lit(f"，仅允许: {listed}"))).when(size > most_mb * 1024 * 1024, f"文件超过大小限制（{most_mb}MB）")


def name_error(name: Column, longest: int = 50) -> Column:
    """Why a baseline may not have a name: none, too long, forbidden characters; null where it may."""
    n = F.length(name)
    return (
        F.when(F.coalesce(n, F.lit(0)) == 0, "基线名称不能为空").when(n > longest, F.concat(F.lit("基线名称过长（"), n.cast("string"), F.lit(f" 字符，上限 {longest}）")))
        .when(name.rlike(FORBIDDEN), '基线名称包含非法字符（\\ / : * ? " < > |）')
    )


def key_error(key: Column, shortest: int = 10) -> Column:
    """Why a key can't be one: none, a placeholder, too short; null where it can."""
    n = F.length(key)
    return (
        F.when(F.coalesce(n, F.lit(0)) == 0, "API Key 不能为空").when(F.contains(F.lower(key), F.lit("xxxx")), "API Key 仍是占位符，请填写真实 Key")
        .when(n < shortest, F.concat(F.lit("API Key 长度过短（"), n.cast("string"), F.lit(" 字符），可能不完整")))
    )


def safe_endpoint(url: Column) -> Column:
    """If a URL may be sent a key: https on its own port, a named host outside, no private, loopback, link-local or reserved IPv4 address."""
    u = F.trim(F.coalesce(url, F.lit("")))
    # one pattern for the whole authority, so that user names and ports can't hide the host
    host = F.lower(F.regexp_extract(u, r"(?i)^https://(?:[^/?#@]*@)?([^/?#@:]+)(?::443)?(?:[/?#]|$)", 1))
    inner = host.isin(*INNER_HOSTS) | host.rlike(r"\.(local|internal|localhost)$")
    address = host.rlike(r"^\d+\.\d+\.\d+\.\d+$")
    own = host.rlike(r"^(0|10|127|22[4-9]|2[34]\d|25[0-5])\.|^169\.254\.|^192\.168\.|^172\.(1[6-9]|2\d|3[01])\.|^100\.(6[4-9]|[7-9]\d|1[01]\d|12[0-7])\.|^192\.0\.[02]\.|^198\.(1[89]|51)\.|^203\.0\.113\.")
    return (host != "") & ~inner & ~(address & own)


def report_scores(reports: DataFrame) -> DataFrame:
    """``reports`` with completeness, evidence_accuracy and actionability.

    Columns: overview, overall_confidence, attacks (array of evidence and recommended_actions), recommended_actions, and of the alerts that
    were given ``n_alerts``, ``ips`` and ``numbers`` (texts). Null reports (no overview, confidence or attacks) score 0.
    """
    attacks = F.coalesce("attacks", F.expr("slice(attacks, 1, 0)"))
    count = F.coalesce(F.when(F.col("attacks").isNotNull(), F.size("attacks")), F.lit(0))
    parts = F.when(F.coalesce("overview", F.lit("")) != "", 1).otherwise(0) + F.when(F.col("overall_confidence").isNotNull(), 1).otherwise(0)
    cited = F.filter(attacks, lambda a: F.coalesce(a["evidence"], F.lit("")) != "")
    true = lambda e: F.exists("ips", lambda ip: (ip != "") & F.contains(e, ip)) | F.exists("numbers", lambda n: (F.length(n) >= 2) & F.contains(e, n))
    hits = F.size(F.filter(cited, lambda a: true(a["evidence"])))
    none = F.expr("cast(array() as array<string>)")
    actions = F.concat(F.coalesce("recommended_actions", none), F.coalesce(F.flatten(F.transform(attacks, lambda a: F.coalesce(a["recommended_actions"], none))), none))
    named = F.size(F.filter(actions, lambda a: F.exists(F.array(*[F.lit(w) for w in ACTIONS]), lambda w: F.contains(a, w)) | F.rlike(a, F.lit(ACTION_PATTERN))))
    share = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 4)
    return reports.withColumns({
        "completeness": F.round((parts / 2 + count / F.greatest(F.lit(1), F.col("n_alerts"))) / 2, 4), "evidence_accuracy": share(F.coalesce(hits, F.lit(0)), F.size(F.coalesce(cited, attacks))),
        "actionability": share(named, F.size(actions)),
    })


def judgement_rates(results: DataFrame) -> DataFrame:
    """One row of rates over results (structured_ok, degraded, judged, expected, knowledge_refs, seconds)."""
    rate = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 4)
    return results.agg(
        F.count(F.lit(1)).alias("cases"), rate(F.col("structured_ok")).alias("structured_success_rate"), rate(F.col("degraded")).alias("degradation_rate"),
        rate(F.col("judged").eqNullSafe(F.col("expected"))).alias("threat_judgment_accuracy"), rate(F.col("knowledge_refs") > 0).alias("reference_usage"), F.round(F.avg("seconds"), 2).alias("avg_latency_s"),
    )


def sample_status(alerts: DataFrame, expected: DataFrame, by: str) -> DataFrame:
    """Every sample of ``expected`` (by, expected: the alert type that must come, null for none) with its alerts: (by, expected, alerts, types, status)."""
    found = alerts.groupBy(by).agg(F.count(F.lit(1)).alias("alerts"), F.array_sort(F.collect_set("type")).alias("types"))  # a handful of types
    rows = expected.join(found, by, "left").select(by, "expected", F.coalesce("alerts", F.lit(0)).alias("alerts"), F.coalesce("types", F.expr("cast(array() as array<string>)")).alias("types"))
    clean = F.col("expected").isNull()
    status = F.when(clean & (F.col("alerts") == 0), "TN").when(clean, "FP").when(F.array_contains("types", F.col("expected")), "TP").otherwise("FN")
    return rows.withColumn("status", status)


def sample_rates(status: DataFrame) -> DataFrame:
    """tp, fp, fn, tn of ``sample_status`` with precision, recall and f1."""
    one = status.agg(*[F.count_if(F.col("status") == s.upper()).alias(s) for s in ("tp", "fp", "fn", "tn")])
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    rate = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 4)
    return one.select("tp", "fp", "fn", "tn", rate(tp, tp + fp).alias("precision"), rate(tp, tp + fn).alias("recall"), rate(2 * tp, 2 * tp + fp + fn).alias("f1"))


def split_rates(tested: DataFrame, attacks: DataFrame, deviating: DataFrame, by: str) -> DataFrame:
    """One row: the share of ``tested`` windows (the last fifth of normal ones) that deviate, and of ``attacks`` captures with any window that does."""
    hit = deviating.select(by, "window_index").distinct().withColumn("hit", F.lit(True))
    normal = tested.select(by, "window_index").join(hit, [by, "window_index"], "left").agg(F.count(F.lit(1)).alias("test_windows"), F.count_if("hit").alias("false_alarms"))
    caught = attacks.select(by).distinct().join(hit.select(by, "hit").distinct(), by, "left").agg(F.count(F.lit(1)).alias("attacks"), F.count_if("hit").alias("caught"))
    rate = lambda a, b: F.round(F.col(a) / F.greatest(F.col(b), F.lit(1)), 4)
    return normal.crossJoin(F.broadcast(caught)).select("test_windows", "false_alarms", "attacks", "caught", rate("false_alarms", "test_windows").alias("fpr"), rate("caught", "attacks").alias("tpr"))  # one row each


def first_share(rows: DataFrame, order: list[str], share: float) -> DataFrame:
    """``rows`` with ``first``: if they are among the first ``share`` of all in order."""
    n = rows.count()
    return numbered(rows, [], order).withColumn("first", F.col("number") < int(n * share)).drop("number")


def title_recall(found: DataFrame, wanted: DataFrame, k: int = 5) -> DataFrame:
    """(mode, queries, hits, recall): queries of every mode of retrieval with a hit up to ``k`` whose title holds what is wanted (query_id, keyword)."""
    top = found.where(F.col("rank") <= k).groupBy("mode", "query_id").agg(F.collect_list("title").alias("titles"))  # k at most
    modes = found.select("mode").distinct()
    rows = wanted.crossJoin(F.broadcast(modes)).join(top, ["mode", "query_id"], "left")  # a row per mode
    hit = F.coalesce(F.exists("titles", lambda t: F.contains(t, F.col("keyword"))), F.lit(False))
    return rows.groupBy("mode").agg(F.count(F.lit(1)).alias("queries"), F.count_if(hit).alias("hits")).withColumn("recall", F.round(F.col("hits") / F.col("queries"), 4))
