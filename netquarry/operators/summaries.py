"""Text summaries of an analysis as lines, and short lists that reports print."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import half_even, summary_size
from .rules import SEVERITIES


def most_common(rows: DataFrame, column: str, k: int, order: str) -> DataFrame:
    """The k commonest values, the one seen first (by ``order``) among equals: column, n."""
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("__first")).orderBy(F.desc("n"), "__first").limit(k).drop("__first")


def traffic_lines(totals: DataFrame, protocols: DataFrame) -> DataFrame:
    """Lines (section, place, line) of one capture: ``totals`` is a row of packets, flows, bytes, start, end; ``protocols`` has protocol, packets and first_seq.

    Shares are of all packets, to one place; protocols come in order of appearance, and not at all where there are no packets.
    """
    head = F.array(
        F.concat(F.lit("📦 总数据包数: "), F.coalesce("packets", F.lit(0)).cast("string")), F.concat(F.lit("🔀 网络流数量: "), F.coalesce("flows", F.lit(0)).cast("string")),
        F.concat(F.lit("📈 总流量: "), summary_size(F.col("bytes"))), F.concat(F.lit("⏰ 时间范围: "), F.coalesce("start", F.lit("")), F.lit(" ~ "), F.coalesce("end", F.lit(""))),
    )
    first = totals.select(F.lit(0).alias("section"), F.posexplode(head).alias("place", "line")).select("section", F.col("place").cast("long").alias("place"), "line")
    whole = protocols.join(F.broadcast(totals.select(F.col("packets").alias("__all"))), F.col("packets") > 0)  # one row
    share = F.format_string("%.1f", F.bround(F.col("packets") / F.col("__all") * 100, 1))
    line = F.concat(F.lit("  • "), "protocol", F.lit(": "), F.col("packets").cast("string"), F.lit(" 包 ("), share, F.lit("%)"))
    return first.unionByName(whole.select(F.lit(1).alias("section"), F.col("first_seq").cast("long").alias("place"), line.alias("line")))


def alert_lines(alerts: DataFrame) -> DataFrame:
    """The number of alerts, then of every severity that has some, the gravest first."""
    counts = alerts.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])
    each = F.array(F.struct(F.concat(F.lit("🚨 异常检测: 共 "), F.col("n").cast("string"), F.lit(" 条告警")).alias("line"), F.lit(True).alias("shown")), *[
        F.struct(F.concat(F.lit(f"  • {s}: "), F.col(s).cast("string"), F.lit(" 条")).alias("line"), (F.col(s) > 0).alias("shown")) for s in SEVERITIES])
    return counts.select(F.posexplode(each).alias("place", "x")).where("x.shown").select(F.lit(3).alias("section"), F.col("place").cast("long").alias("place"), "x.line")


def verdict_lines(score: Column, by_model: Column) -> Column:
    """Lines of a fused verdict: attack from one half on, its confidence, and if a model or the fixed weights gave it."""
    attack = score >= 0.5
    return F.array(
        F.concat(F.lit("🎯 三引擎融合判定: "), F.when(attack, "🔴 攻击").otherwise("🟢 正常")), F.concat(F.lit("  • 置信度: "), F.format_string("%.2f", half_even(F.greatest(score, 1 - score), 2))),
        F.concat(F.lit("  • 攻击概率: "), F.format_string("%.4f", half_even(score, 4))), F.concat(F.lit("  • 元学习器: "), F.when(by_model, "已使用").otherwise("未加载（固定权重回退）")),
    )


def report_indicators(alerts: DataFrame, *order: str) -> DataFrame:
    """What a report lists of alerts (src_ip, dst_ip, dst_port, type): each value once with its kind and the type of the alert that showed it first."""
    kind = lambda c: F.when(F.contains(c, F.lit(".")) | F.contains(c, F.lit(":")), "IP").otherwise("域名")
    address = lambda c: F.when(F.length(c) > 0, F.struct(F.col(c).alias("value"), kind(F.col(c)).alias("kind")))
    port = F.when(F.col("dst_port") > 0, F.struct(F.col("dst_port").cast("string").alias("value"), F.lit("端口").alias("kind")))
    each = alerts.select(*order, "type", F.posexplode(F.array_compact(F.array(address("src_ip"), address("dst_ip"), port))).alias("__n", "x"))
    return each.groupBy("x.value").agg(F.min_by(F.struct("x.kind", "type"), F.struct(*order, "__n")).alias("f")).select("value", "f.kind", "f.type")
