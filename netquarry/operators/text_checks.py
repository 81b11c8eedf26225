"""Checks on generated and untrusted text, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

#: Phrases by which a text claims more than evidence gives.
ABSOLUTE = ["毫无疑问", "绝对是", "100%", "完全确定", "铁证如山", "肯定是", "必然是"]
#: How a failed model call begins.
FAILURE_MARKERS = ["[大模型调用失败]", "[错误]", "[LLM"]
#: Phrases of prompt injection.
INJECTION = ["ignore previous", "ignore all previous", "disregard", "system prompt", "system prompt:", "忽略以上", "忽略之前", "无视以上", "新的指令", "you are now", "act as", "developer mode", "jailbreak"]
#: Clauses of denial, and words for normal and for attack.
DENIALS = ["未发现", "未检测到", "未观察到", "未见", "未能发现", "没有发现", "没有检测到", "无异常", "无可疑", "无恶意", "不存在攻击", "不构成攻击", "并非攻击", "非攻击", "no anomaly", "no anomalies", "not detected", "no evidence", "no suspicious", "no malicious", "nothing malicious"]
NORMAL = ["正常", "无异常", "误报", "benign", "normal", "no anomaly", "not detected", "false positive"]
ATTACK = ["攻击", "恶意", "入侵", "威胁", "可疑", "attack", "malicious", "intrusion", "suspicious", "exploit"]


def any_of(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def failed(text: Column) -> Column:
    head = F.ltrim(text)
    return reduce(lambda a, b: a | b, [F.startswith(head, F.lit(m)) for m in FAILURE_MARKERS])


def validation_points(text: Column, shortest: int = 20, longest: int = 10_000, contradictions: Column | None = None) -> Column:
    """Score in thousandths: 1000 less 200 if short, 100 if long, 150 for every absolute phrase, 100 for every contradiction and
    for doubtful techniques; 0 if empty or failed."""
    absolute = reduce(lambda a, b: a + b, [F.when(F.contains(text, F.lit(p)), 150).otherwise(0) for p in ABSOLUTE])
    points = 1000 - F.when(F.length(text) < shortest, 200).otherwise(0) - F.when(F.length(text) > longest, 100).otherwise(0) - absolute
    points = points - F.when(doubtful_techniques(text), 100).otherwise(0) - (100 * contradictions if contradictions is not None else F.lit(0))
    return F.when((F.length(text) == 0) | failed(text), 0).otherwise(F.greatest(points, F.lit(0)))


def validation_level(text: Column, points: Column) -> Column:
    return F.when((F.length(text) == 0) | failed(text), "unavailable").when(points >= 800, "pass").when(points >= 500, "warning").otherwise("fail")


#: What a text may name as a technique without being doubted.
KNOWN_TECHNIQUES = [
    "SYN Flood", "SYN flood", "端口扫描", "Port Scan", "port scan",
    "DNS 隧道", "DNS Tunneling", "RST 风暴", "RST Storm",
    "暴力破解", "Brute Force", "SQL 注入", "SQL Injection",
    "XSS", "跨站脚本", "DDoS", "勒索软件", "Ransomware",
    "钓鱼", "Phishing", "中间人攻击", "MITM", "零日漏洞", "0day",
    "木马", "Trojan", "后门", "Backdoor", "蠕虫", "Worm",
    "Shellcode",
]
#: Techniques in mixed case that are looked for by name.
NAMED_TECHNIQUES = ["SYN Flood", "DNS Tunneling", "RST Storm", "Port Scan", "Brute Force", "SQL Injection"]


def techniques(text: Column, most: int = 10) -> Column:
    """Names of techniques in a text (words in title case side by side, then the known mixed ones), each once; none in a failed text."""
    titles = F.regexp_extract_all(text, F.lit(r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)"), F.lit(1))
    named = F.regexp_extract_all(text, F.lit("(" + "|".join(NAMED_TECHNIQUES) + ")"), F.lit(1))
    found = F.slice(F.array_distinct(F.filter(F.concat(titles, named), lambda x: F.length(x) > 3)), 1, most)
    return F.when((F.length(text) == 0) | failed(text), F.array().cast("array<string>")).otherwise(found)


def doubtful_techniques(text: Column) -> Column:
    """If a text names more than two techniques that nobody knows."""
    return F.size(F.filter(techniques(text), lambda x: ~x.isin(KNOWN_TECHNIQUES))) > 2


#: Words by which a text speaks of an attack, kinds of attack it may assert, and hedges before them.
ATTACK_WORDS = ["攻击", "恶意", "入侵", "威胁", "attack", "malicious", "intrusion"]
ASSERTED = ["SYN Flood", "SYN洪水", "端口扫描", "DNS 隧道", "DNS隧道", "RST 风暴", "RST风暴"]
HEDGES = ["可能", "疑似", "或许", "不排除", "may", "might", "possibly"]


def inconsistencies(text: Column, fused_attack: Column, confidence: Column, alerts: Column) -> Column:
    """How often a text contradicts the engines: an attack where fusion is sure there is none, and an unhedged kind of attack without any alert."""
    against = F.coalesce(~fused_attack & (confidence > 0.8), F.lit(False)) & any_of(F.lower(text), ATTACK_WORDS)

    def asserted(kind: str) -> Column:
        at = F.locate(kind, text)
        before = F.substring(text, F.greatest(at - 12, F.lit(1)), F.least(at - 1, F.lit(12)))
        return (at > 0) & ~any_of(before, HEDGES)

    bare = reduce(lambda a, b: a | b, [asserted(k) for k in ASSERTED])
    return F.when(against, 1).otherwise(0) + F.when(F.coalesce(alerts == 0, F.lit(False)) & bare, 1).otherwise(0)


def verdict(text: Column) -> Column:
    """attack, normal or unknown by clauses: a denial counts half for normal and hides the rest of its clause."""
    clauses = F.filter(F.split(F.lower(text), r"[。；;，,！!？?]|\.\s*|\n", -1), lambda c: F.length(F.trim(c)) > 0)
    score = F.aggregate(clauses, F.lit(0), lambda a, c: a + F.when(any_of(c, DENIALS), -1).otherwise(F.when(any_of(c, ATTACK), 2).otherwise(0) - F.when(any_of(c, NORMAL), 2).otherwise(0)))
    return F.when(score > 0, "attack").when(score < 0, "normal").otherwise("unknown")


def sanitised(text: Column, longest: int = 200) -> Column:
    """Without control and zero-width characters, trimmed, cut, and marked if it reads like an injection."""
    clean = F.trim(F.regexp_replace(text, r"[\x00-\x1f\x7f\x{200b}-\x{200f}\x{2028}-\x{202f}\x{feff}]", ""))
    cut = F.when(F.length(clean) > longest, F.concat(F.substring(clean, 1, longest), F.lit("…[截断]"))).otherwise(clean)
    mark = F.lit("[警告:该数据疑似包含指令注入特征，仅作背景参考] ")
    return F.when(F.length(text) == 0, "").when(any_of(F.lower(cut), INJECTION), F.concat(mark, cut)).otherwise(cut)


def sanitised_struct(value: Column, kind: DataType, longest: int = 200) -> Column:
    """``value`` of type ``kind`` with every text in it sanitised, however deep in structs, arrays and map values; map keys and other values stay.
    The expression follows the schema, so nothing leaves the JVM."""
    if isinstance(kind, StringType):
        return F.when(value.isNotNull(), sanitised(value, longest))
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: sanitised_struct(x, kind.elementType, longest)) if _holds_text(kind) else value
    if isinstance(kind, MapType):
        return F.transform_values(value, lambda k, x: sanitised_struct(x, kind.valueType, longest)) if _holds_text(kind.valueType) else value
    if isinstance(kind, StructType) and _holds_text(kind):
        return F.when(value.isNotNull(), F.struct(*[sanitised_struct(value.getField(f.name), f.dataType, longest).alias(f.name) for f in kind.fields]))
    return value


def _holds_text(kind: DataType) -> bool:
    if isinstance(kind, ArrayType):
        return _holds_text(kind.elementType)
    if isinstance(kind, MapType):
        return _holds_text(kind.valueType)
    if isinstance(kind, StructType):
        return any(_holds_text(f.dataType) for f in kind.fields)
    return isinstance(kind, StringType)


def token_estimate(text: Column) -> Column:
    """Han characters over 1.7 and the rest over 4, cut to a whole number."""
    han = F.length(text) - F.length(F.regexp_replace(text, r"[\x{4e00}-\x{9fff}]", ""))
    return F.floor(han / 1.7 + (F.length(text) - han) / 4).cast("long")


def json_object(text: Column) -> Column:
    """The outermost braces of a text, where fences or prose surround a JSON report."""
    return F.regexp_extract(text, r"(?s)\{.*\}", 0)


def parsed_reports(rows: DataFrame, text: str = "text") -> DataFrame:
    """Structured reports with their confidence, valid only inside 0..1."""
    report = F.from_json(json_object(F.col(text)), "is_threat boolean, overall_confidence double, attacks array<struct<alert_type:string,is_true_positive:boolean,confidence:double,evidence:string>>")
    valid = F.coalesce(report["is_threat"].isNotNull() & report["overall_confidence"].between(0, 1), F.lit(False))
    return rows.withColumns({"report": report, "valid": valid})


def merged_votes(votes: DataFrame) -> DataFrame:
    """Votes (alert_type, evidence, seq, positive, confidence) by type and start of the evidence: strict majority,
    mean confidence (0.5 where missing) by half to full weight of the share of positives, and the middle vote as reference.

    The middle comes from counts of stretches of ``seq`` and a rank inside one stretch, so no group is gathered.
    """
    keys = ["alert_type", "evidence40"]
    rows = votes.withColumns({"evidence40": F.substring("evidence", 1, 40), "stretch": F.floor(F.col("seq") / 4096)})
    parts = rows.groupBy(*keys, "stretch").agg(F.count(F.lit(1)).alias("n"), F.count_if("positive").alias("tp"), F.sum(F.coalesce(F.nullif("confidence", F.lit(0.0)), F.lit(0.5))).alias("c"))
    grouped = parts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("tp").alias("tp"), F.sum("c").alias("c"))
    upto = Window.partitionBy(*keys).orderBy("stretch")
    placed = parts.select(*keys, "stretch", F.col("n").alias("m"), (F.sum("n").over(upto) - F.col("n")).alias("before")).join(grouped, keys)
    middle = F.floor(F.col("n") / 2)
    at = placed.where((middle >= F.col("before")) & (middle < F.col("before") + F.col("m"))).select(*keys, "stretch", "n", "tp", "c", (middle - F.col("before") + 1).alias("nth"))
    ranked = rows.join(at, [*keys, "stretch"]).withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("seq")))
    return ranked.where(F.col("r") == F.col("nth")).select(
        *keys, "n", "tp", (F.col("tp") * 2 > F.col("n")).alias("is_true_positive"), F.round(F.col("c") / F.col("n") * (0.5 + F.col("tp") / F.col("n") / 2), 3).alias("confidence"), F.col("seq").alias("reference"),
    )
