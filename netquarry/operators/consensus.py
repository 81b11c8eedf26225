"""Agreement of the engines' verdicts with a generated one, contradictions, and what needs review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def consensus(rows: DataFrame, verdict: Column, alerts: Column, critical: Column, fused: Column, confidence: Column) -> DataFrame:
    """Votes of text, rules and fusion (a null fusion or an unknown text doesn't vote), agreement and confidence in thousandths."""
    attack = F.when(verdict == "attack", 1).otherwise(0) + F.when(alerts > 0, 1).otherwise(0) + F.when(fused, 1).otherwise(0)
    normal = F.when(verdict == "normal", 1).otherwise(0) + F.when(alerts <= 0, 1).otherwise(0) + F.when(~fused, 1).otherwise(0)
    against = (
        F.when((verdict == "attack") & ~fused & (confidence > 0.8), 1).otherwise(0)
        + F.when((verdict == "normal") & (alerts > 0) & (critical > 0), 1).otherwise(0) + F.when(fused & (alerts <= 0) & (confidence > 0.9), 1).otherwise(0)
    )
    rows = rows.withColumns({"attack_votes": attack.cast("long"), "normal_votes": normal.cast("long"), "contradictions": against.cast("long")})
    a, n = F.col("attack_votes"), F.col("normal_votes")
    share = F.floor(F.greatest(a, n) * 1000 / (a + n))
    return rows.withColumns({
        "consensus": F.when(a > n, "attack").when(n > a, "normal").otherwise("split"), "agreement_m": share.cast("long"),
        "confidence_m": F.floor(share * (10 - 3 * F.col("contradictions")) / 10).cast("long"), "needs_review": (F.col("contradictions") > 0) | (share < 600),
    })


def review_priority(level: Column, needs_review: Column, agreement_m: Column, critical: Column) -> Column:
    """high for a failed text or little agreement; medium for a warning, a contradiction or a critical alert; else low."""
    first = F.when(level == "fail", 2).when(level == "warning", 1).otherwise(0)
    second = F.when(needs_review & (agreement_m < 500), 2).when(needs_review & (first == 0), 1).otherwise(0)
    third = F.when(critical > 0, 1).otherwise(0)
    rank = F.greatest(first, second, third)
    return F.when(rank == 2, "high").when(rank == 1, "medium").otherwise("low")


def numeric_fields(*values: Column) -> Column:
    """Numbers of an alert that could be ports or counts: whole parts from 1 to 65535."""
    return F.filter(F.array_compact(F.array(*[v.cast("long") for v in values])), lambda x: x.between(1, 65535))


#: Protocol and flag names that count as tokens of an alert.
PROTOCOL_WORDS = ["TCP", "UDP", "DNS", "HTTP", "HTTPS", "ICMP", "RST", "SYN", "ACK"]


def alert_tokens(text: Column) -> Column:
    """Addresses, domain names and protocol words of a text, each once."""
    words = "|".join(PROTOCOL_WORDS)
    patterns = [r"\b(?:\d{1,3}\.){3}\d{1,3}\b", r"\b[a-zA-Z0-9][a-zA-Z0-9.-]*\.[a-zA-Z]{2,}\b", rf"(?i)\b(?:{words})\b"]
    return F.array_distinct(F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in patterns]))


def named_numbers(text: Column) -> Column:
    """Distinct numbers of two to five digits that stand alone in a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\b(\d{2,5})\b"), F.lit(1)), lambda x: x.cast("long")))


def matched_evidence(alerts: DataFrame, hits: DataFrame) -> DataFrame:
    """Best hit of every alert by 45 points for the share of its keywords that the hit holds, 30 for the share of the hit's numbers that the
    alert names, 10 for the alert's tokens in it (three are all), 25 for similarity; without a similarity the others count for all.
    Earlier hits win ties; an alert without hits has score 0.

    ``alerts``: alert_id, keywords, numbers, tokens (arrays); ``hits``: alert_id, rank, title, content, similarity.
    """
    h = hits.select("alert_id", "rank", "content", "similarity", named_numbers(F.concat_ws(" ", "content", "title")).alias("known"))
    rows = alerts.join(h, "alert_id", "left")
    held = lambda c: F.size(F.filter(c, lambda w: F.contains(F.col("content"), w)))
    words = F.when(F.size("keywords") > 0, held("keywords") / F.size("keywords")).otherwise(0.0)
    ports = F.when(F.size("known") > 0, F.size(F.array_intersect("known", "numbers")) / F.size("known")).otherwise(0.0)
    base = 0.45 * words + 0.30 * ports + 0.10 * F.least(F.lit(1.0), held("tokens") / 3)
    score = F.when(F.col("similarity").isNull(), base / 0.85).otherwise(base + 0.25 * F.least(F.lit(1.0), F.col("similarity")))
    scored = rows.select("alert_id", "rank", F.when(F.col("rank").isNull(), 0.0).otherwise(F.round(F.least(score, F.lit(1.0)) + 1e-9, 4)).alias("score"))
    best = scored.groupBy("alert_id").agg(F.max(F.struct("score", (-F.col("rank")).alias("r"))).alias("b"))
    return best.select("alert_id", F.col("b.score").alias("score"), (-F.col("b.r")).alias("rank"))


def overall_risk(rows: DataFrame, available: Column, points: Column, confidence_m: Column, needs_review: Column, priority: Column) -> DataFrame:
    """``overall_m`` in thousandths: four tenths each of the text's points and of the confidence, and two tenths where nothing needs review;
    nothing, and an unavailable risk, where the text isn't available. ``risk`` follows the priority of review."""
    total = F.floor((points * 4 + confidence_m * 4) / 10) + F.when(needs_review, 0).otherwise(200)
    return rows.withColumns({"overall_m": F.when(available, total).otherwise(0).cast("long"), "risk": F.when(~available, "unavailable").otherwise(priority)})


def vote_majority(votes: DataFrame, key: str) -> DataFrame:
    """Votes (key, threat, confidence) by key: strict majority, agreement, and the mean confidence (0.5 where missing) by half to full weight of it."""
    grouped = votes.where("threat is not null").groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_if("threat").alias("yes"), F.avg(F.coalesce(F.nullif("confidence", F.lit(0.0)), F.lit(0.5))).alias("c"))
    share = F.col("yes") / F.col("n")
    return grouped.select(key, (F.col("yes") * 2 > F.col("n")).alias("is_threat"), F.round(share, 3).alias("agreement"), F.round(F.col("c") * (0.5 + share / 2) + 1e-9, 3).alias("confidence"))


def first_distinct(rows: DataFrame, key: str, value: str, order: str, k: int = 12) -> DataFrame:
    """The first k distinct values of every key, in the order they are first seen: key, place, value."""
    firsts = rows.where(F.length(value) > 0).groupBy(key, value).agg(F.min(order).alias("__at"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("__at", value))
    return firsts.withColumn("place", place.cast("long")).where(F.col("place") <= k).select(key, "place", value)
