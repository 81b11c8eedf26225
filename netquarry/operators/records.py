"""Stored results: history, trends, related samples, audit, chats, logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def page(rows: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page of ordered rows; limit is held to 1..500 and offset to 0 or more."""
    return rows.orderBy(*order).offset(max(0, offset)).limit(min(500, max(1, limit)))


def latest(rows: DataFrame, order: list[Column], n: int, by: list[str] | None = None) -> DataFrame:
    """The newest n rows (of each group); without groups a top-n, which needs no full sort in one task."""
    if not by:
        return rows.orderBy(*order).limit(n)
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__r") <= n).drop("__r")


def upserted(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Latest row of every key after an update."""
    both = old.unionByName(new)
    return latest(both, [F.desc(order)], 1, [key])


def deleted(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return rows.join(keys.select(key), key, "left_anti")


def daily_trend(history: DataFrame) -> DataFrame:
    """day, analyses, alerts, attacks, reviews."""
    return history.groupBy("day").agg(
        F.count(F.lit(1)).alias("analyses"), F.sum("alerts").alias("alerts"), F.count_if("is_attack").alias("attacks"), F.count_if("needs_review").alias("reviews")
    )


def severity_by_day(history: DataFrame) -> DataFrame:
    """Sum of the counts in the severity map (JSON text) of every day."""
    each = history.select("day", F.explode(F.from_json("severity", "map<string,bigint>")).alias("severity", "n"))
    return each.groupBy("day", "severity").agg(F.sum("n").alias("n"))


def verdict_by_day(history: DataFrame) -> DataFrame:
    return history.groupBy("day").agg(F.count_if("is_attack").alias("attack"), F.count_if(~F.col("is_attack")).alias("normal"))


def _rate(a: Column, b: Column, places: int) -> Column:
    return F.coalesce(F.round(F.try_divide(a, b), places), F.lit(0.0))


def trend_summary(history: DataFrame) -> DataFrame:
    """Totals and rates of all records in one row, zeros where there are none."""
    n, attacks = F.count(F.lit(1)), F.count_if("is_attack")
    total = F.coalesce(F.sum("alerts"), F.lit(0))
    high = F.count_if(F.map_contains_key(F.from_json("severity", "map<string,bigint>"), "HIGH"))
    return history.agg(
        n.alias("total_records"), attacks.alias("attack_records"), (n - attacks).alias("normal_records"), _rate(attacks, n, 3).alias("attack_rate"), total.alias("total_alerts"), _rate(total, n, 2).alias("avg_alerts"),
        F.count_if("needs_review").alias("needs_review"), high.alias("high_risk"),
    )


def stored_alerts(history: DataFrame) -> DataFrame:
    """Alerts inside the stored reports (JSON text ``raw``); a report that doesn't parse has none."""
    shape = "anomaly_detection struct<alerts:array<struct<type:string,src_ip:string,dst_port:bigint>>>"
    return history.select("id", F.explode(F.from_json("raw", shape)["anomaly_detection"]["alerts"]).alias("a")).select("id", F.coalesce("a.type", F.lit("unknown")).alias("type"), "a.src_ip", "a.dst_port")


def top_attack_types(history: DataFrame, k: int = 10) -> DataFrame:
    return stored_alerts(history).groupBy("type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "type").limit(k)


def record_indicators(history: DataFrame) -> DataFrame:
    """Addresses and ports that the stored alerts name, repeats kept: id, kind, value, source."""
    both = F.array(
        F.when(F.length("src_ip") > 0, F.struct(F.lit("IP").alias("kind"), F.col("src_ip").alias("value"))), F.when(F.col("dst_port") > 0, F.struct(F.lit("Port").alias("kind"), F.col("dst_port").cast("string").alias("value"))),
    )
    return stored_alerts(history).select("id", F.col("type").alias("source"), F.explode(F.array_compact(both)).alias("x")).select("id", "x.kind", "x.value", "source")


def by_id(rows: DataFrame, key: int | str, column: str = "id") -> DataFrame:
    return rows.where(F.col(column) == key)


def updated(rows: DataFrame, changes: DataFrame, key: str, allowed: list[str]) -> DataFrame:
    """Rows with the non-null values of ``changes`` by key, in the allowed columns only; other columns of it are ignored."""
    own = [c for c in allowed if c in changes.columns and c in rows.columns and c != key]
    new = changes.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__new_{c}") for c in own])
    joined = rows.join(new, rows[key] == new["__key"], "left")
    return joined.select(*[F.coalesce(f"__new_{c}", c).alias(c) if c in own else F.col(c) for c in rows.columns])


def evidence_timeline(alerts: DataFrame, k: int = 20) -> DataFrame:
    """The first k alerts in time, each as one line of evidence."""
    order = [F.col(c) for c in ("first_ms", "key_ord", "rule_ord", "subject")]
    line = F.concat_ws(" ", "severity", "subject", F.lit("="), F.col("value").cast("long").cast("string"))
    first = alerts.orderBy(*order).limit(k)
    return first.withColumns({"place": F.row_number().over(Window.orderBy(*order)).cast("long"), "evidence": line})  # k rows


def imported(spark, path: str) -> DataFrame:
    """Exported records: a JSON list of objects, or an object with such a list under ``records``."""
    text = spark.read.text(path, wholetext=True).select(F.trim("value").alias("v"))
    listed = F.when(F.startswith("v", F.lit("{")), F.get_json_object("v", "$.records")).otherwise(F.col("v"))
    return text.select(F.explode(F.from_json(listed, "array<map<string,string>>")).alias("record"))


def listed(history: DataFrame, limit: int = 60, offset: int = 0) -> DataFrame:
    """A page of analyses, the newest first, with ``severity`` as a map and ``raw`` as a map of its parts (texts); what doesn't parse is empty."""
    decoded = lambda c, of: F.coalesce(F.from_json(c, of, {"mode": "PERMISSIVE"}), F.expr(f"cast(map() as {of})"))
    return page(history, [F.desc("ts_ms"), F.col("id")], limit, offset).withColumns({"severity": decoded("severity", "map<string,bigint>"), "raw": decoded("raw", "map<string,string>")})


def session_messages(chat: DataFrame, session: int, limit: int = 100) -> DataFrame:
    """The first messages of a conversation, in order."""
    return chat.where(F.col("conv_id") == session).orderBy("turn").limit(limit)


def knowledge_base_stats(history: DataFrame, chat: DataFrame, k: int = 10) -> DataFrame:
    """One row: sizes of the tables, the rate of attacks, the commonest alert types (type=n), records to review and of high risk."""
    top = top_attack_types(history, k).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "type"))), lambda x: F.concat_ws("=", x["type"], (-x["o"]).cast("string"))), ",").alias("top_attack_types"))  # k rows
    rows = trend_summary(history).select(F.col("total_records").alias("history"), "attack_rate", "needs_review", "high_risk")
    return rows.crossJoin(F.broadcast(chat.agg(F.count(F.lit(1)).alias("chat")))).crossJoin(F.broadcast(top))  # one row each


def related(history: DataFrame, target: int, pool: int = 100, k: int = 5) -> DataFrame:
    """Records most like one: 3 points each for the same verdict and for alerts within a fifth, 2 for each
    severity in common and for a week's distance; over 3 points of the newest ``pool`` records."""
    own = history.where(F.col("id") == target).select(*[F.col(c).alias(f"t_{c}") for c in ("is_attack", "alerts", "severity", "ts_ms")])
    rest = latest(history, [F.desc("ts_ms"), F.col("id")], pool).where(F.col("id") != target).crossJoin(F.broadcast(own))  # one row
    keys = lambda c: F.map_keys(F.from_json(c, "map<string,bigint>"))
    days = F.abs(F.floor((F.col("t_ts_ms") - F.col("ts_ms")) / 86_400_000))
    points = (
        F.when(F.col("is_attack") == F.col("t_is_attack"), 3).otherwise(0)
        + F.when((F.col("t_alerts") > 0) & (F.abs(F.col("alerts") - F.col("t_alerts")) / F.col("t_alerts") < 0.2), 3).otherwise(0)
        + 2 * F.size(F.array_intersect(keys("severity"), keys("t_severity"))) + F.when(days <= 7, 2).otherwise(0)
    )
    return rest.select("id", points.cast("long").alias("points")).where("points > 3").orderBy(F.desc("points"), "id").limit(k)


def audit_stats(audit: DataFrame) -> DataFrame:
    return audit.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status_code") >= 400).alias("errors"), F.round(F.avg("duration_ms"), 1).alias("avg_ms")).orderBy(F.desc("n"), "path").limit(10)


def audit_totals(audit: DataFrame) -> DataFrame:
    n, errors = F.count(F.lit(1)), F.count_if(F.col("status_code") >= 400)
    return audit.agg(n.alias("total"), errors.alias("errors"), _rate(errors, n, 4).alias("error_rate"), F.coalesce(F.round(F.avg("duration_ms"), 2), F.lit(0.0)).alias("avg_ms"))


def audit_query(audit: DataFrame, status: int | None = None, path: str | None = None) -> DataFrame:
    if status is not None:
        audit = audit.where(F.col("status_code") == status)
    if path is not None:
        audit = audit.where(F.contains("path", F.lit(path)))
    return audit


def chat_context(chat: DataFrame, n: int = 10) -> DataFrame:
    """The last n messages of every conversation, less system and empty ones."""
    return latest(chat, [F.desc("turn")], n, ["conv_id"]).where((F.col("role") != "system") & (F.length(F.trim("text")) > 0))


def log_records(lines: DataFrame) -> DataFrame:
    """``time | LEVEL | module - message`` lines as columns; other lines are dropped."""
    parts = F.split("value", r"\s\|\s", 3)
    rows = lines.withColumn("p", parts).where(F.size("p") == 3)
    rest = F.get("p", F.lit(2))
    return rows.select("line", F.get("p", F.lit(0)).alias("time"), F.trim(F.get("p", F.lit(1))).alias("level"), F.substring_index(rest, " - ", 1).alias("module"), F.regexp_extract(rest, r"^.*? - (?s)(.*)$", 1).alias("message"))


def level_counts(logs: DataFrame, newest: int = 1000) -> DataFrame:
    return logs.orderBy(F.desc("line")).limit(newest).groupBy("level").agg(F.count(F.lit(1)).alias("n"))


def by_file_hash(history: DataFrame, digest: str) -> DataFrame:
    """Stored analysis of a file, by exact equality of the hash inside its JSON."""
    return history.where(F.get_json_object("raw", "$.file_hash") == digest)
