"""Streams replayed in parts against the batch operators, with late, repeated and idle rows."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from netquarry.operators import engines, rules, windows
from netquarry.plans import live as plans
from netquarry.schemas import PACKET_SCHEMA, Thresholds
from netquarry.sources.packets import packets_from_events
from netquarry.streaming import live

from .conftest import SF

LOW = Thresholds(syn_flood_min=3, port_scan_min=2, dns_tunnel_min=2, large_flow_mb=0.0001, rst_storm_min=2, udp_flood_min=2, dns_amp_responses=1, quic_connections=1, quic_long_flow=1, quic_large_share=0.0)
T0 = dt.datetime(2024, 1, 1)


def packets_of(spark, rows):
    """Rows of (seq, seconds, source, port) as packets to one host."""
    made = [("c", n, T0 + dt.timedelta(seconds=s), int((T0 + dt.timedelta(seconds=s)).timestamp() * 1000), "TCP", a, 40000, "10.0.0.9", p, 60, "SYN", 0, 0, "", "", "") for n, s, a, p in rows]
    return spark.createDataFrame(made, PACKET_SCHEMA)


def parts_of(spark, folder, *parts):
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def test_streamed_rules_end_with_the_batch_alerts(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    stream = parts_of(spark, tmp_path, *[events.where(F.col("event_id") % 3 == k) for k in (2, 0, 1)])  # out of order
    counts = live.stream_signals(packets_from_events(stream), LOW, f"{tmp_path}/out", f"{tmp_path}/state")
    got, want = rules.alerts_of(counts, LOW), rules.all_alerts(packets_from_events(events), LOW)
    assert want.count() > 20 and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_repeated_rows_count_once_and_late_ones_count(spark, tmp_path):
    first = [(n, n, "10.0.0.1", 80 + n) for n in range(20)]
    again = first[5:15] + [(30, 4, "10.0.0.1", 7000), (31, 25, "10.0.0.2", 80)]  # sent again, late, in time
    stream = parts_of(spark, tmp_path, packets_of(spark, first), packets_of(spark, again), packets_of(spark, again))
    counts = live.stream_signals(live.once_each(stream), LOW, f"{tmp_path}/out", f"{tmp_path}/state")
    whole = packets_of(spark, first + again[10:])
    want = rules.signals(whole, LOW)
    assert counts.exceptAll(want).isEmpty() and want.exceptAll(counts).isEmpty()
    assert counts.where("measure = 'syn' and a = '10.0.0.1'").first().n == 21


def test_a_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    one, two = packets_of(spark, [(n, n, "10.0.0.1", 80) for n in range(5)]), packets_of(spark, [(n, n, "10.0.0.1", 81) for n in range(5, 9)])
    live.stream_signals(parts_of(spark, tmp_path, one), LOW, f"{tmp_path}/out", f"{tmp_path}/state")
    counts = live.stream_signals(parts_of(spark, tmp_path, two), LOW, f"{tmp_path}/out", f"{tmp_path}/state")
    want = rules.signals(one.unionByName(two), LOW)
    assert counts.exceptAll(want).isEmpty() and want.exceptAll(counts).isEmpty()


def test_idle_flows_are_emitted_once_and_forgotten(spark, tmp_path):
    host = [f"10.0.1.{k}" for k in range(30)]
    early = packets_of(spark, [(k, k, h, 80) for k, h in enumerate(host)] + [(100 + k, k + 40, h, 80) for k, h in enumerate(host[:10])])
    later = packets_of(spark, [(200, 5000, "10.0.2.1", 80)])
    last = packets_of(spark, [(300, 9000, host[0], 80), (301, 9050, "10.0.2.2", 80)])
    flows = live.stream_flows(parts_of(spark, tmp_path, early, later, last), 60, late="10 seconds")
    query = flows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out")
    query.awaitTermination()
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(rows) >= 30 and rows[-1] <= 3
    out = spark.read.schema(flows.schema).parquet(f"{tmp_path}/out").collect()
    assert len(out) == 31 and sorted(r.packets for r in out) == [1] * 21 + [2] * 10
    assert not any("10.0.1.0:40000" in (r.lo, r.hi) and r.first_ms > early.agg(F.max("ts_ms")).first()[0] for r in out)  # its second flow may go on


def test_idle_gap_is_cut_beyond_the_limit_only(spark, tmp_path):
    rows = packets_of(spark, [(1, 0, "10.0.0.1", 80), (2, 60, "10.0.0.1", 80), (3, 121, "10.0.0.1", 80)])
    end = packets_of(spark, [(9, 5000, "10.0.0.2", 80)])
    flows = live.stream_flows(parts_of(spark, tmp_path, rows, end, packets_of(spark, [(10, 5001, "10.0.0.2", 80)])), 60, late="1 second")
    got = sorted(r.packets for r in live.run_to_end(flows, f"{tmp_path}/out", f"{tmp_path}/state").collect())
    assert got == [1, 2]


def test_distance_by_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(200):
        train, own = rng.integers(0, 8, rng.integers(1, 12)).astype(float), rng.integers(0, 8, rng.integers(1, 6)).astype(float)
        at, n = np.unique(train, return_counts=True)
        want = max(abs((train <= v).sum() * len(own) - (own <= v).sum() * len(train)) for v in [*train, *own])
        assert live.distance(own, (at, np.cumsum([0, *n]))) == want


def test_streamed_drift_is_the_batch_fold(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    packets = plans._captured(packets_from_events(events))
    days = [r[0] for r in packets.select("capture_id").distinct().orderBy("capture_id").collect()]
    training = F.col("capture_id") < days[10]
    every = windows.epoch_windows(packets, 3600, "capture_id")
    found = engines.Found(every.where(~training), every.where(training), None)
    want = {(r.capture_id, r.window_index): (r.dimension, r.numerator, r.n1, r.n2, r.detected) for r in engines.window_drift(found, engines.EngineSettings()).collect()}
    table = every.where(~training).withColumnRenamed("window_index", "start_ms")
    stream = parts_of(spark, tmp_path, *[table.where(F.substring("capture_id", 9, 2).cast("int") % 2 == k) for k in (0, 1)])
    with live.rocksdb(spark):
        out = live.run_to_end(live.stream_drift(stream, live.training_steps(every.where(training))), f"{tmp_path}/out", f"{tmp_path}/state")
    got = {(r.capture_id, r.start_ms): (r.dimension, r.numerator, r.n1, r.n2, r.detected) for r in out.collect()}
    assert got == want and len(got) > 50


def test_a_step_table_is_bounded(spark):
    rows = spark.range(50).selectExpr("id as window_index", "id as packets", "id as bytes", "id as syn", "id as dports")
    with pytest.raises(ValueError):
        live.training_steps(rows, most=100)
