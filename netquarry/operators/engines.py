"""The engines over many captures side by side: rules, frozen baseline and forest, and what fusion reads of them.

Baseline and forest learn from the windows of training captures; every other capture is held
against them by itself. Nothing here gathers a capture: windows are rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import MAD_SCALE, Thresholds
from ..scratch import materialize
from . import baseline, forest, rules
from .fusion import BASELINE, FOREST, RULE
from .ordered import running_sums
from .windows import bucketed, by_dimension, windows

CAPTURE = "capture_id"
DIMS = ["packets", "bytes", "syn", "dports"]


@dataclass(frozen=True)
class EngineSettings:
    window_sec: int = 10
    sigma: float = 3.0
    per_dimension: int = 3
    recent: int = 10
    least_recent: int = 5
    factor: float = 1.36
    contamination: float = 0.10
    least_training: int = 10
    lowest: int = 5
    clearly: float = 0.05


@dataclass(frozen=True)
class Found:
    """Windows of the captures to judge, of training, and the profile learnt from the latter."""

    windows: DataFrame
    training: DataFrame
    profile: DataFrame


def prepare(packets: DataFrame, training: Column, settings: EngineSettings) -> Found:
    every = materialize(windows(packets, settings.window_sec, CAPTURE), "windows")
    train = every.where(training)
    # windows are told apart by (capture, index); training pools them under one running name
    pooled = materialize(train.withColumn("window_index", F.xxhash64(CAPTURE, "window_index")), "training")
    return Found(every.where(~training), pooled, materialize(baseline.learn(pooled), "profile"))


def deviations(found: Found, settings: EngineSettings) -> DataFrame:
    """Windows that lie over the frozen profile: capture_id, window_index, dimension, value, z, severity."""
    z = (F.col("value") - F.col("median")) * MAD_SCALE / F.col("mad")
    rows = by_dimension(found.windows, CAPTURE).join(F.broadcast(found.profile.select("dimension", "median", "mad")), "dimension").withColumn("z", z)  # a row per dimension
    severity = F.when(F.col("z") > 2 * settings.sigma, "HIGH").otherwise("MEDIUM")
    return rows.where(F.col("z") > settings.sigma).select(CAPTURE, "window_index", "dim_ord", "dimension", "value", "z", severity.alias("severity"))


def baseline_alerts(deviating: DataFrame, settings: EngineSettings) -> DataFrame:
    """The highest windows of every dimension, then windows that deviate in two dimensions or more: capture_id, type, severity, subject."""
    order = Window.partitionBy(CAPTURE, "dimension").orderBy(F.desc("z"), "window_index")
    top = deviating.withColumn("r", F.row_number().over(order)).where(F.col("r") <= settings.per_dimension)
    single = top.select(CAPTURE, F.lit("BASELINE_DEVIATION").alias("type"), "severity", F.concat_ws("@", "dimension", F.col("window_index").cast("string")).alias("subject"))
    grouped = deviating.groupBy(CAPTURE, "window_index").agg(F.count(F.lit(1)).alias("n"), F.max("z").alias("z")).where("n >= 2")
    several = grouped.select(
        CAPTURE, F.lit("BASELINE_MULTI_DIM").alias("type"), F.when((F.col("n") >= 3) | (F.col("z") > 6), "CRITICAL").otherwise("HIGH").alias("severity"), F.col("window_index").cast("string").alias("subject")
    )
    return single.unionByName(several)


def _ranked(values: DataFrame, training: DataFrame) -> DataFrame:
    """Distinct (dimension, value) of ``values`` with ``le`` and ``lt``, the training windows at or below and below the value, and ``n1``, all
    of them. Values of both meet in one order, by ranges."""
    base = by_dimension(training).groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("x"))
    wanted = values.select("dimension", "value").distinct().withColumn("x", F.lit(0).cast("long"))
    at = base.unionByName(wanted.withColumn("w", F.lit(True)), allowMissingColumns=True).groupBy("dimension", "value").agg(F.sum("x").alias("x"), F.max("w").alias("w"))
    upto = running_sums(at, ["dimension"], ["value"], {"le": F.col("x")}).where("w")
    n1 = base.groupBy("dimension").agg(F.sum("x").alias("n1"))
    return upto.join(F.broadcast(n1), "dimension").select("dimension", "value", "le", (F.col("le") - F.col("x")).alias("lt"), "n1")  # a row per dimension


def _distance(own: Column, n1: Column) -> Column:
    """Largest distance of the few values ``own`` (value, le, lt) to training, times both counts: it lies at one of them or just before it."""
    n2 = F.size(own)

    def at(x: Column) -> Column:
        here = F.abs(x["le"] * n2 - F.size(F.filter(own, lambda y: y["value"] <= x["value"])) * n1)
        before = F.abs(x["lt"] * n2 - F.size(F.filter(own, lambda y: y["value"] < x["value"])) * n1)
        return F.greatest(here, before)

    return F.array_max(F.transform(own, at))


def _judged_drift(each: DataFrame, keys: list[str], settings: EngineSettings) -> DataFrame:
    """The worst dimension (the first of equals) of every key, from rows with ``own`` and ``n1``."""
    order = F.array_position(F.array(*[F.lit(d) for d in DIMS]), F.col("dimension"))
    rows = each.select(*keys, "dimension", "n1", F.size("own").cast("long").alias("n2"), _distance(F.col("own"), F.col("n1")).alias("numerator")).where(F.col("n2") >= settings.least_recent)
    worst = rows.groupBy(*keys).agg(F.max(F.struct("numerator", (-order).alias("o"), "dimension", "n1", "n2")).alias("w")).select(*keys, "w.dimension", "w.numerator", "w.n1", "w.n2")
    critical = settings.factor * F.sqrt((F.col("n1") + F.col("n2")) / (F.col("n1") * F.col("n2")))
    return worst.withColumn("detected", F.col("numerator") / (F.col("n1") * F.col("n2")) > critical)


def drift(found: Found, settings: EngineSettings) -> DataFrame:
    """capture_id, dimension, numerator, n1, n2, detected: the capture's last windows against training, its worst dimension (the first of
    equals); no row where it has too few windows or training has none."""
    last = Window.partitionBy(CAPTURE).orderBy(F.desc("window_index"))
    recent = found.windows.withColumn("r", F.row_number().over(last)).where(F.col("r") <= settings.recent).drop("r")
    ours = materialize(by_dimension(recent, CAPTURE), "recent-windows")
    each = ours.join(_ranked(ours, found.training), ["dimension", "value"]).groupBy(CAPTURE, "dimension").agg(F.first("n1").alias("n1"), F.collect_list(F.struct("value", "le", "lt")).alias("own"))
    return _judged_drift(each, [CAPTURE], settings)


def window_drift(found: Found, settings: EngineSettings) -> DataFrame:
    """``drift`` at every window: it and the windows before it, ``recent`` at most (capture_id, window_index and drift's columns)."""
    ours = materialize(by_dimension(found.windows, CAPTURE), "capture-windows")
    upto = Window.partitionBy(CAPTURE, "dimension").orderBy("window_index").rowsBetween(1 - settings.recent, 0)
    ranked = ours.join(_ranked(ours, found.training), ["dimension", "value"])
    each = ranked.select(CAPTURE, "window_index", "dimension", "n1", F.collect_list(F.struct("value", "le", "lt")).over(upto).alias("own"))
    return _judged_drift(each, [CAPTURE, "window_index"], settings)


def forest_windows(found: Found, settings: EngineSettings) -> tuple[DataFrame, float] | None:
    """Windows that the forest finds strange, with score, dimension, ratio, direction and severity, and the threshold; None where training is too short."""
    if found.training.limit(settings.least_training).count() < settings.least_training:
        return None
    model = forest.fit(found.training, DIMS)
    cut = float(forest.threshold(forest.scored(found.training, DIMS, model), settings.contamination))
    medians = materialize(forest.upper_medians(found.training, DIMS), "medians")
    strange = materialize(forest.scored(found.windows, DIMS, model).where(F.col("score") < cut), "strange")
    return judged(strange, medians, cut, settings), cut


def judged(strange: DataFrame, medians: DataFrame, cut: float, settings: EngineSettings) -> DataFrame:
    """Strange windows (with ``score``) with what makes them so: a high side is HIGH or MEDIUM by score, a low side is INFO.
    Rounded halves go up, whatever the last bit."""
    named = forest.top_dimension(DIMS, medians, strange, CAPTURE)
    rows = strange.join(named, [CAPTURE, "window_index"])
    severity = F.when(F.col("direction") == "low", "INFO").when(F.col("score") < cut - settings.clearly, "HIGH").otherwise("MEDIUM")
    return rows.select(CAPTURE, "window_index", "dimension", "direction", F.round(F.col("ratio") + 1e-9, 2).alias("ratio"), F.round("score", 4).alias("score"), severity.alias("severity"))


def forest_alerts(strange: DataFrame, settings: EngineSettings) -> DataFrame:
    """The lowest scores of every capture: ``alert`` for the high side, an observation for the low one."""
    order = Window.partitionBy(CAPTURE).orderBy("score", "window_index")
    top = strange.withColumn("r", F.row_number().over(order)).where(F.col("r") <= settings.lowest).drop("r")
    return top.withColumns({"type": F.lit("ML_ANOMALY"), "subject": F.concat_ws("@", "dimension", F.col("window_index").cast("string")), "alert": F.col("direction") == "high"})


def forest_profile(strange: DataFrame, found: Found) -> DataFrame:
    """capture_id, anomaly_windows, total_windows, mean_score, min_score, top_dimension (commonest, the one seen first among equals)."""
    counts = strange.groupBy(CAPTURE, "dimension").agg(F.count(F.lit(1)).alias("n"), F.min("window_index").alias("first"))
    top = counts.groupBy(CAPTURE).agg(F.max(F.struct("n", (-F.col("first")).alias("f"), "dimension")).alias("t")).select(CAPTURE, F.col("t.dimension").alias("top_dimension"))
    scores = strange.groupBy(CAPTURE).agg(F.count(F.lit(1)).alias("anomaly_windows"), F.round(F.avg("score") + 1e-9, 4).alias("mean_score"), F.min("score").alias("min_score"))
    totals = found.windows.groupBy(CAPTURE).agg(F.count(F.lit(1)).alias("total_windows"))
    rows = totals.join(scores, CAPTURE, "left").join(top, CAPTURE, "left")
    return rows.select(
        CAPTURE, F.coalesce("anomaly_windows", F.lit(0)).alias("anomaly_windows"), "total_windows", F.coalesce("mean_score", F.lit(0.0)).alias("mean_score"),
        F.coalesce("min_score", F.lit(0.0)).alias("min_score"), F.coalesce("top_dimension", F.lit("")).alias("top_dimension"),
    )


def engine_alerts(packets: DataFrame, training: Column, thresholds: Thresholds, settings: EngineSettings, with_forest: bool = True) -> tuple[DataFrame, Found, DataFrame, DataFrame | None, float]:
    """(alerts, windows and profile, deviations, strange windows, the forest's threshold) of every capture that isn't training."""
    found = prepare(packets, training, settings)
    by_rule = rules.unsorted_alerts(packets.where(~training), thresholds, captures=True).select(CAPTURE, "type", "severity", "subject")
    deviating = materialize(deviations(found, settings), "deviations")
    alerts = by_rule.unionByName(baseline_alerts(deviating, settings))
    strange, cut = None, 0.0
    if with_forest and (judged_ := forest_windows(found, settings)):
        strange, cut = materialize(judged_[0], "judged"), judged_[1]
        alerts = alerts.unionByName(forest_alerts(strange, settings).where("alert").select(CAPTURE, "type", "severity", "subject"))
    return materialize(alerts, "alerts"), found, deviating, strange, cut


def features(packets: DataFrame, training: Column, thresholds: Thresholds, settings: EngineSettings, with_forest: bool = True) -> DataFrame:
    """The thirteen features of every capture that isn't training. Rule features count the alerts of all engines; drift is 1 only where it
    is detected; without a forest its six features are 0."""
    alerts, found, deviating, strange, cut = engine_alerts(packets, training, thresholds, settings, with_forest)
    rank = F.when(F.col("severity") == "CRITICAL", 4).when(F.col("severity") == "HIGH", 3).when(F.col("severity") == "MEDIUM", 2).otherwise(1)
    by_alert = alerts.groupBy(CAPTURE).agg(F.count(F.lit(1)).alias("n"), F.max(rank).alias("severity"), F.count_distinct("type").alias("types"))
    by_window = deviating.groupBy(CAPTURE).agg(F.count_distinct("window_index").alias("deviating"))
    several = deviating.groupBy(CAPTURE, "window_index").count().where("count >= 2").select(CAPTURE, F.lit(True).alias("several")).distinct()
    rows = found.windows.select(CAPTURE).distinct()
    for part in (by_alert, by_window, several, drift(found, settings).select(CAPTURE, "detected")):
        rows = rows.join(part, CAPTURE, "left")
    n, one, zero = F.coalesce("n", F.lit(0)), F.lit(1.0), F.lit(0.0)
    out = {
        RULE[0]: F.when(n > 0, one).otherwise(zero), RULE[1]: F.least(n / 10, one), RULE[2]: F.coalesce(F.col("severity").cast("double"), zero), RULE[3]: F.least(F.coalesce("types", F.lit(0)) / 5, one),
        BASELINE[0]: F.least(F.coalesce("deviating", F.lit(0)) / 10, one), BASELINE[1]: F.when(F.col("several"), one).otherwise(zero), BASELINE[2]: F.when(F.col("detected"), one).otherwise(zero),
    }
    if strange is None:
        return rows.select(CAPTURE, *[c.alias(k) for k, c in out.items()], *[F.lit(0.0).alias(k) for k in FOREST])
    rows = rows.join(forest_profile(strange, found), CAPTURE, "left")
    k, scale = F.col("anomaly_windows"), abs(cut) if abs(cut) > 1e-6 else 1.0
    share = lambda c: F.when(k > 0, F.least(F.abs(c) / scale, one)).otherwise(zero)
    out |= {
        FOREST[0]: one, FOREST[1]: F.least(k / 10, one), FOREST[2]: F.least(k / F.col("total_windows"), one), FOREST[3]: share(F.col("mean_score")), FOREST[4]: share(F.col("min_score")),
        FOREST[5]: F.when(F.col("top_dimension").isin("syn", "dports"), one).when(F.col("top_dimension").isin("packets", "bytes"), 0.5).otherwise(zero),
    }
    return rows.select(CAPTURE, *[c.alias(name) for name, c in out.items()])


def _level_changes(packets: DataFrame, thresholds: Thresholds, settings: EngineSettings) -> DataFrame:
    """(capture_id, bucket, measure, before, level): windows at which a key's alert comes, goes or changes its severity.

    Every key's sums run over its own windows; second keys (ports, versions) count in the window that shows them first.
    """
    found = rules.signals(bucketed(packets, settings.window_sec, CAPTURE), thresholds, captures=True, also=("bucket",))
    versions = F.col("measure") == "version"  # all unknown versions are one alert
    found = found.withColumns({"b": F.when(versions, F.col("a")).otherwise(F.col("b")), "a": F.when(versions, "all").otherwise(F.col("a"))})
    found = materialize(found.select(CAPTURE, "bucket", "measure", "a", "b", "n", "other", "bytes", "other_bytes"), "window-signals")
    fresh = found.where(F.col("measure").isin("scan", "quic", "version") & (F.col("n") > 0)).groupBy(CAPTURE, "measure", "a", "b").agg(F.min("bucket").alias("bucket"))
    fresh = fresh.groupBy(CAPTURE, "measure", "a", "bucket").agg(F.count(F.lit(1)).alias("keys"))
    sums = [F.sum(c).alias(c) for c in ("n", "other", "bytes", "other_bytes")]
    each = found.groupBy(CAPTURE, "measure", "a", "bucket").agg(*sums).join(fresh, [CAPTURE, "measure", "a", "bucket"], "left")
    whole = found.where("measure = 'quic'").groupBy(CAPTURE, F.lit("quic_all").alias("measure"), F.lit("all").alias("a"), "bucket").agg(*sums).withColumn("keys", F.lit(0).cast("long"))
    rows = each.unionByName(whole).withColumn("keys", F.coalesce("keys", F.lit(0)))
    order = Window.partitionBy(CAPTURE, "measure", "a").orderBy("bucket")  # a key's windows
    running = rows.select(CAPTURE, "measure", "a", "bucket", *[F.sum(c).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias(c) for c in ("n", "other", "bytes", "other_bytes", "keys")])
    level = F.lit(0)
    for measure, (_, own) in rules.levels(thresholds).items():
        level = F.when(F.col("measure") == measure, own).otherwise(level)
    judged = running.withColumn("level", level)
    return judged.withColumn("before", F.lag("level", 1, 0).over(order)).where("level <> before").select(CAPTURE, "bucket", "measure", "before", "level")


def prefix_features(packets: DataFrame, training: Column, thresholds: Thresholds, settings: EngineSettings) -> DataFrame:
    """The features of rules and baseline for every prefix of every capture that isn't training: (capture_id, window_index) and what ``features``
    says of the capture's windows up to and with that one.

    No prefix is judged anew. Alerts are changes of level of their keys, summed over the windows; deviations, windows of several and their
    severities are sums too (of the highest three of a dimension, three at most and a HIGH one if there was any); drift is judged at every window.
    """
    found = prepare(packets, training, settings)
    changes = _level_changes(packets.where(~training), thresholds, settings)
    measures = list(rules.levels(thresholds))
    alive = lambda c: (F.col(c) > 0).cast("long")
    at = lambda c, s: (F.col(c) == s).cast("long")
    steps = {f"m_{m}": F.sum(F.when(F.col("measure") == m, alive("level") - alive("before")).otherwise(0)) for m in measures} | {f"s_{s}": F.sum(at("level", s) - at("before", s)) for s in (1, 2, 3)}
    by_rule = changes.groupBy(CAPTURE, "bucket").agg(*[c.alias(k) for k, c in steps.items()])
    deviating = deviations(found, settings)
    high = F.col("severity") == "HIGH"
    of_window = {f"d_{d}": F.count_if(F.col("dimension") == d) for d in DIMS} | {"d_high": F.count_if(high), "d_any": F.lit(1).cast("long")}
    by_window = deviating.groupBy(CAPTURE, "window_index").agg(*[c.alias(k) for k, c in of_window.items()], F.count(F.lit(1)).alias("n"), F.max("z").alias("z"))
    several = F.col("n") >= 2
    by_window = by_window.withColumns({"d_multi": several.cast("long"), "d_critical": (several & ((F.col("n") >= 3) | (F.col("z") > 6))).cast("long")}).drop("n", "z")
    names = [*steps, *of_window, "d_multi", "d_critical"]
    rows = found.windows.select(CAPTURE, "window_index", "bucket").join(by_rule, [CAPTURE, "bucket"], "left").join(by_window, [CAPTURE, "window_index"], "left")
    rows = running_sums(rows.select(CAPTURE, "window_index", *[F.coalesce(c, F.lit(0)).alias(f"x_{c}") for c in names]), [CAPTURE], ["window_index"], {c: F.col(f"x_{c}") for c in names})
    rows = rows.join(window_drift(found, settings).select(CAPTURE, "window_index", "detected"), [CAPTURE, "window_index"], "left")
    total = lambda cs: reduce(lambda a, b: a + b, cs)
    n = total([F.col(f"m_{m}") for m in measures] + [F.least(F.col(f"d_{d}"), F.lit(settings.per_dimension)) for d in DIMS] + [F.col("d_multi")])
    types = total([alive(f"m_{m}") for m in measures] + [alive("d_any"), alive("d_multi")])
    severity = F.when(F.col("d_critical") > 0, 4).when((F.col("s_3") > 0) | (F.col("d_high") > 0) | (F.col("d_multi") > 0), 3).when((F.col("s_2") > 0) | (F.col("d_any") > 0), 2).when(F.col("s_1") > 0, 1).otherwise(0)
    one, zero = F.lit(1.0), F.lit(0.0)
    out = {
        RULE[0]: F.when(n > 0, one).otherwise(zero), RULE[1]: F.least(n / 10, one), RULE[2]: severity.cast("double"), RULE[3]: F.least(types / 5, one),
        BASELINE[0]: F.least(F.col("d_any") / 10, one), BASELINE[1]: F.when(F.col("d_multi") > 0, one).otherwise(zero), BASELINE[2]: F.when(F.col("detected"), one).otherwise(zero),
    }
    return rows.select(CAPTURE, "window_index", *[c.alias(k) for k, c in out.items()])
