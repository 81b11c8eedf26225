"""Fusion of the three engines: thirteen features, logistic or weighted verdict, attribution."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULE = ["rule_has_alert", "rule_alert_count_norm", "rule_max_severity", "rule_triggered_rules"]
BASELINE = ["baseline_deviation_count", "baseline_multi_dim_triggered", "baseline_drifted"]
FOREST = ["isolation_available", "isolation_anomaly_count", "isolation_anomaly_ratio", "isolation_mean_score", "isolation_max_score", "isolation_top_dim_risk"]
FEATURES = RULE + BASELINE + FOREST
ENGINES = {"rule_based": RULE, "baseline": BASELINE, "isolation_forest": FOREST}
#: Weights of the engines where no model is trained.
FALLBACK = {"rule_based": 0.4, "baseline": 0.3, "isolation_forest": 0.3}


def _sum(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def rule_features(alerts: DataFrame, by: str) -> DataFrame:
    """Rule features of every group of alerts (type, severity): all engines' alerts count."""
    rank = F.when(F.col("severity") == "CRITICAL", 4).when(F.col("severity") == "HIGH", 3).when(F.col("severity") == "MEDIUM", 2).otherwise(1)
    n = F.count(F.lit(1))
    return alerts.groupBy(by).agg(
        F.lit(1.0).alias(RULE[0]), F.least(n / 10, F.lit(1.0)).alias(RULE[1]), F.max(rank).cast("double").alias(RULE[2]), F.least(F.count_distinct("type") / 5, F.lit(1.0)).alias(RULE[3])
    )


def weighted_score() -> Column:
    """Verdict by fixed weights, where no trained model is at hand."""
    c = F.col
    one = F.lit(1.0)
    rule = F.least(c(RULE[0]) * 0.5 + c(RULE[1]) * 0.2 + c(RULE[2]) / 4.0 * 0.2 + c(RULE[3]) * 0.1, one)
    base = F.least(c(BASELINE[0]) * 0.6 + c(BASELINE[1]) * 0.25 + c(BASELINE[2]) * 0.15, one)
    forest = F.least(c(FOREST[1]) * 0.35 + c(FOREST[2]) * 0.25 + c(FOREST[3]) * 0.15 + c(FOREST[4]) * 0.15 + c(FOREST[5]) * 0.10, one)
    return FALLBACK["rule_based"] * rule + FALLBACK["baseline"] * base + FALLBACK["isolation_forest"] * forest


def logistic_score(weights: dict[str, float], bias: float) -> Column:
    return 1 / (1 + F.exp(-(F.lit(bias) + _sum([F.col(f) * w for f, w in weights.items()]))))


def attribution(weights: dict[str, float]) -> dict[str, Column]:
    """Each engine's share of the absolute contributions; zeros where nothing contributes."""
    parts = {e: _sum([F.abs(F.col(f) * weights[f]) for f in fs]) for e, fs in ENGINES.items()}
    total = _sum(list(parts.values()))
    return {e: F.when(total <= 1e-12, 0.0).otherwise(F.round(p / total, 4)) for e, p in parts.items()}


def train(rows: DataFrame, label: str, c: float = 1.0):
    """Class-balanced logistic regression over the thirteen features (pyspark.ml)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("pos")).first()
    weight = F.when(F.col(label) == 1, stats.n / (2.0 * max(stats.pos, 1))).otherwise(stats.n / (2.0 * max(stats.n - stats.pos, 1)))
    ready = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows.withColumn("weight", weight))
    return LogisticRegression(labelCol=label, weightCol="weight", regParam=1.0 / (c * max(stats.n, 1)), elasticNetParam=0.0, standardization=False).fit(ready)


def distinct_training_rows(rows: DataFrame, group: str, label: str) -> DataFrame:
    return rows.dropDuplicates([group, label, *FEATURES])


def strong_pairs(rows: DataFrame, columns: list[str], least: float = 0.8) -> DataFrame:
    """Pairs of columns whose correlation is over ``least`` in size; all pairs in one aggregation."""
    names = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = rows.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}|{b}") for a, b in names])
    long = one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r")) for a, b in names])).alias("x")).select("x.*")
    return long.where(F.abs("r") > least).select("a", "b", F.round("r", 6).alias("r"))


def constant_columns(rows: DataFrame, columns: list[str]) -> DataFrame:
    one = rows.agg(*[F.min(c).eqNullSafe(F.max(c)).alias(c) for c in columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("constant")) for c in columns])).alias("x")).select("x.*")
