"""Structured Streaming versions of rules, windows, flows, the online baseline and drift.

Late packets within the watermark still count; later ones are dropped, and a window or flow is
emitted once the watermark has passed its end. Rules are reported at the end of a stream (or at any
time before) from counts that the stream keeps by key.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import rules
from ..operators.flows import end_point, initiator_syn
from ..operators.windows import by_dimension
from ..schemas import DIMENSIONS, MAD_SCALE, Thresholds


def stream_windows(packets: DataFrame, window_sec: int, late: str = "10 minutes", by: str | None = None) -> DataFrame:
    """Tumbling windows of a packet stream (``ts`` a timestamp): packets, bytes, initiator SYNs, distinct ports; ``by`` keeps captures apart."""
    span, keys = F.window("ts", f"{window_sec} seconds"), [by] if by else []
    return packets.withWatermark("ts", late).groupBy(span.alias("w"), *keys).agg(
        F.count(F.lit(1)).alias("packets"), F.sum("length").alias("bytes"), F.count_if(initiator_syn()).alias("syn"), F.size(F.collect_set(F.when(F.col("dst_port") > 0, F.col("dst_port")))).cast("long").alias("dports"),
    ).select(*keys, F.unix_millis("w.start").alias("start_ms"), "packets", "bytes", "syn", "dports")


def stream_counters(packets: DataFrame, key: str) -> DataFrame:
    """Running counters by key, for update or complete output."""
    return packets.groupBy(key).agg(F.count(F.lit(1)).alias("packets"), F.sum("length").alias("bytes"), F.count_if(initiator_syn()).alias("syn"))


STATE = ", ".join(f"{d}_median double, {d}_mad double" for d in DIMENSIONS)
OUTPUT = "capture_id string, start_ms long, dimensions string, calm boolean"


def smoothing(start: dict[str, tuple[float, float]], sigma: float, alpha: float):
    """Stateful function for ``applyInPandasWithState`` by capture: the profile is the state, and each window
    is held against it and moves it only where no dimension deviates."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        values = list(state.get) if state.exists else [x for d in DIMENSIONS for x in start[d]]
        rows = pd.concat(list(batches)).sort_values("start_ms")
        out = []
        for r in rows.itertuples(index=False):
            over = [d for i, d in enumerate(DIMENSIONS) if (getattr(r, d) - values[2 * i]) * MAD_SCALE / values[2 * i + 1] > sigma]
            if not over:
                for i, (d, share) in enumerate(DIMENSIONS.items()):
                    x, m, a = float(getattr(r, d)), values[2 * i], values[2 * i + 1]
                    middle = alpha * x + (1 - alpha) * m
                    values[2 * i], values[2 * i + 1] = round(middle, 4), round(max(alpha * abs(x - m) + (1 - alpha) * a, 1.0, middle * share), 4)
            out.append((key[0], int(r.start_ms), ",".join(over), not over))
        state.update(tuple(values))
        yield pd.DataFrame(out, columns=["capture_id", "start_ms", "dimensions", "calm"])

    return step


def stream_smoothed(found: DataFrame, start: dict[str, tuple[float, float]], sigma: float, alpha: float) -> DataFrame:
    """Online baseline over a stream of windows (capture_id, start_ms, the four dimensions)."""
    return found.groupBy("capture_id").applyInPandasWithState(smoothing(start, sigma, alpha), OUTPUT, STATE, "append", "NoTimeout")


def run_to_end(stream: DataFrame, target: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now and read what it wrote (file sink, so only in append mode)."""
    spark: SparkSession = stream.sparkSession
    query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(target)


# rules ---------------------------------------------------------------------------


def once_each(packets: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Packets of a source that may send some again: each (capture_id, pkt_seq) once, while the watermark remembers it."""
    return packets.withWatermark("ts", late).dropDuplicatesWithinWatermark(["capture_id", "pkt_seq"])


def stream_signals(packets: DataFrame, t: Thresholds, target: str, checkpoint: str, captures: bool = False) -> DataFrame:
    """Run a packet stream over what is there now, keeping the rules' counts by key as state, and return them as they stand.

    Every batch writes the keys that it changed to a folder of its own number, so a batch that is run again
    replaces what it wrote; of a key the row of the last batch counts. ``rules.alerts_of`` makes the report.
    """
    spark = packets.sparkSession
    counts = rules.signals(packets, t, captures)

    def keep(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{target}/batch={batch}")

    query = counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    keys = [c for c in ("capture_id", "measure", "a", "b") if c in counts.columns]
    values = [c for c in counts.columns if c not in keys]
    written = spark.read.schema(counts.schema.add("batch", "long")).parquet(target)
    return written.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("last")).select(*keys, "last.*")


# flows ---------------------------------------------------------------------------


def stream_flows(packets: DataFrame, idle_sec: int, late: str = "10 minutes") -> DataFrame:
    """Flows of a packet stream, cut where they are idle for ``idle_sec``: each is emitted once, when the watermark
    has passed its end, and forgotten then, so state holds flows that may go on and no others."""
    src, dst = end_point("src"), end_point("dst")
    rows = packets.where(F.col("protocol").isin("TCP", "UDP") & (F.col("src_ip") != "") & (F.col("dst_ip") != "")).withWatermark("ts", late)
    ends = ("protocol", F.least(src, dst).alias("lo"), F.greatest(src, dst).alias("hi"))
    found = rows.groupBy(F.session_window("ts", f"{idle_sec} seconds").alias("w"), *ends).agg(
        F.count(F.lit(1)).alias("packets"), F.sum("length").alias("bytes"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms")
    )
    return found.select("protocol", "lo", "hi", "first_ms", "last_ms", "packets", "bytes")


# drift -----------------------------------------------------------------------------


def training_steps(training: DataFrame, most: int = 1_000_000) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Training's distribution as a step table of each dimension: its distinct values, sorted, and how many windows lie at or
    below each. It is sent to every task, so more than ``most`` rows are refused."""
    counted = by_dimension(training).groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n"))
    rows = counted.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"training holds more than {most} distinct values: train on fewer or longer windows")
    steps = {}
    for d in DIMENSIONS:
        own = sorted((r.value, r.n) for r in rows if r.dimension == d)
        steps[d] = np.array([v for v, _ in own]), np.cumsum([0] + [n for _, n in own])
    return steps


def distance(values: np.ndarray, steps: tuple[np.ndarray, np.ndarray]) -> int:
    """Largest distance of ``values`` to the step table, times both counts."""
    at, upto = steps
    n1, n2 = int(upto[-1]), len(values)
    own = np.sort(values)
    numerator = 0
    for side in ("right", "left"):  # at every value, and just before it
        theirs = upto[np.searchsorted(at, own, side=side)]
        mine = np.searchsorted(own, own, side=side)
        numerator = max(numerator, int(np.abs(theirs * n2 - mine * n1).max()))
    return numerator


class DriftProcessor(StatefulProcessor):
    """Keeps the last windows of every capture as a list, and holds each new window and those before it against training."""

    WINDOW = "start_ms long, " + ", ".join(f"{d} double" for d in DIMENSIONS)

    def __init__(self, steps: dict[str, tuple[np.ndarray, np.ndarray]], recent: int, least: int, factor: float):
        self.steps, self.recent, self.least, self.factor = steps, recent, least, factor

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.windows = handle.getListState("recent", self.WINDOW)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        kept = [tuple(w) for w in self.windows.get()]
        out = []
        for r in pd.concat(list(rows)).sort_values("start_ms").itertuples(index=False):
            kept = [*kept, (int(r.start_ms), *(float(getattr(r, d)) for d in DIMENSIONS))][-self.recent :]
            if len(kept) < self.least:
                continue
            table = np.array([w[1:] for w in kept])
            found = [(distance(table[:, i], self.steps[d]), -i, d) for i, d in enumerate(DIMENSIONS)]
            numerator, _, name = max(found)
            n1, n2 = int(self.steps[name][1][-1]), len(kept)
            out.append((key[0], int(r.start_ms), name, numerator, n1, n2, bool(numerator / (n1 * n2) > self.factor * ((n1 + n2) / (n1 * n2)) ** 0.5)))
        self.windows.put(kept)
        yield pd.DataFrame(out, columns=["capture_id", "start_ms", "dimension", "numerator", "n1", "n2", "detected"])

    def close(self) -> None:
        pass


DRIFT = "capture_id string, start_ms long, dimension string, numerator long, n1 long, n2 long, detected boolean"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """The state store that state of several variables needs, for queries that start inside."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stream_drift(found: DataFrame, steps: dict[str, tuple[np.ndarray, np.ndarray]], recent: int = 10, least: int = 5, factor: float = 1.36) -> DataFrame:
    """Drift at every window of a stream of windows (capture_id, start_ms, the four dimensions), the worst dimension of each.
    Its query must start inside ``rocksdb``."""
    return found.groupBy("capture_id").transformWithStateInPandas(DriftProcessor(steps, recent, least, factor), DRIFT, "Append", "None")
