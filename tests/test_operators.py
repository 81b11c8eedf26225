"""Unit numbers on packets made by hand, identities, and round trips."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from netquarry.operators import baseline, consensus, engines, evaluate, flows, forest, fusion, records, retrieval, rules, seasonal, store, text_checks, windows
from netquarry.plans.live import stream_windows
from netquarry.schemas import Thresholds
from netquarry.sources import files, pcap

from . import simulated

COLUMNS = "pkt_seq long, ts_ms long, protocol string, src_ip string, src_port int, dst_ip string, dst_port int, length long, flags string, payload_size long, dns_query string, dns_response string, raw_summary string"


def packets(spark, rows):
    full = [(i, ms, p, s, sp, d, dp, n, f, 0, q, "", "") for i, (ms, p, s, sp, d, dp, n, f, q) in enumerate(rows)]
    return spark.createDataFrame(full, COLUMNS)


def test_dominant_direction_ties_take_the_larger_tuple_with_numeric_ports(spark):
    rows = packets(spark, [(0, "TCP", "1.1.1.1", 9, "2.2.2.2", 80, 10, "", ""), (1, "TCP", "2.2.2.2", 80, "1.1.1.1", 9, 20, "", ""), (2, "TCP", "1.1.1.1", 10, "2.2.2.2", 80, 5, "", "")])
    found = {r.lo + "|" + r.hi: r for r in flows.flows(rows).collect()}
    assert len(found) == 2
    tied = found["1.1.1.1:9|2.2.2.2:80"]
    assert (tied.packets, tied.bytes, tied.dom_src_ip, tied.dom_bytes) == (2, 30, "2.2.2.2", 20)


def test_dns_is_in_no_flow_and_no_udp_flood(spark):
    rows = packets(spark, [(i, "DNS", "1.1.1.1", 5, "2.2.2.2", 53, 80, "", "a.b") for i in range(200)])
    assert flows.flows(rows).count() == 0
    assert rules.RULES["rule_udp_flood"](rows, Thresholds()).count() == 0


@pytest.mark.parametrize(("kind", "n", "rule"), [("synflood", 200, "SYN_FLOOD_SUSPECTED"), ("portscan", 50, "PORT_SCAN_SUSPECTED"), ("dnstunnel", 10, "DNS_TUNNEL_SUSPECTED"), ("rststorm", 80, "RST_STORM"), ("udpflood", 400, "UDP_FLOOD_SUSPECTED"), ("quicflood", 80, "QUIC_CONNECTION_FLOOD")])
def test_attacks_raise_their_alert(spark, kind, n, rule):
    alerts = rules.all_alerts(simulated.attack(spark, kind, n), Thresholds()).collect()
    assert rule in {a.type for a in alerts}


def test_mixed_traffic_raises_only_its_own(spark):
    quiet = simulated.traffic_mix(spark, 400).where("flags <> 'SYN'")
    assert rules.all_alerts(quiet, Thresholds()).count() == 0


def test_minimum_is_met_and_high_is_passed(spark):
    rows = packets(spark, [(i, "TCP", "1.1.1.1", 1, "2.2.2.2", 80, 60, "SYN", "") for i in range(80)])
    assert [a.severity for a in rules.RULES["rule_syn_flood"](rows, Thresholds(syn_flood_high=80)).collect()] == ["MEDIUM"]
    assert [a.severity for a in rules.RULES["rule_syn_flood"](rows, Thresholds(syn_flood_high=79)).collect()] == ["HIGH"]
    assert rules.RULES["rule_syn_flood"](rows, Thresholds(syn_flood_min=81)).count() == 0


def test_windows_start_at_the_first_arrival_and_skip_empty_ones(spark):
    rows = packets(spark, [(t, "TCP", "1.1.1.1", 1, "2.2.2.2", 80, 60, "SYN", "") for t in (25_000, 26_000, 5_000, 99_000)])
    found = windows.windows(rows, 10).orderBy("bucket").collect()
    assert [(r.bucket, r.window_index, r.packets) for r in found] == [(-2, 0, 1), (0, 1, 2), (7, 2, 1)]


def test_baseline_is_one_sided_and_never_too_narrow(spark):
    flat = spark.createDataFrame([(i, 100, 1000, 5, 3) for i in range(30)], "window_index long, packets long, bytes long, syn long, dports long")
    profile = {r.dimension: r for r in baseline.learn(flat).collect()}
    assert profile["packets"].mad == 30.0 and profile["dports"].mad == 1.5
    odd = spark.createDataFrame([(0, 100, 1000, 5, 3), (1, 1, 1, 0, 0), (2, 400, 9000, 5, 3)], flat.schema)
    found = baseline.deviations(odd, baseline.learn(flat), 3.0).collect()
    assert {(r.window_index, r.dimension) for r in found} == {(2, "packets"), (2, "bytes")}


def test_smoothing_moves_only_on_calm_windows(spark):
    flat = spark.createDataFrame([(i, 100, 1000, 5, 3) for i in range(30)], "window_index long, packets long, bytes long, syn long, dports long")
    later = spark.createDataFrame([(0, 110, 1000, 5, 3), (1, 900, 9000, 5, 3)], flat.schema)
    state = baseline.smoothed(later, baseline.learn(flat), 3.0, 0.1).orderBy("window_index").collect()
    assert [s.packets_median for s in state] == [101.0, 101.0]
    assert [(s.dimensions, s.calm) for s in state] == [("", True), ("packets,bytes", False)]
    two = later.withColumn("c", F.lit("a")).unionByName(later.withColumn("c", F.lit("b")))
    assert [(s.c, s.calm) for s in baseline.smoothed(two, baseline.learn(flat), 3.0, 0.1, by="c").orderBy("c", "window_index").collect()] == [("a", True), ("a", False), ("b", True), ("b", False)]


def test_ks_distance_counts_ties_at_once(spark):
    a = spark.createDataFrame([("packets", float(x)) for x in (1, 1, 2, 2)], "dimension string, value double")
    b = spark.createDataFrame([("packets", float(x)) for x in (1, 1, 2, 3)], "dimension string, value double")
    r = baseline.ks_distance(a, b).first()
    assert r.numerator / (r.n1 * r.n2) == 0.25


def test_decomposition_adds_up(spark):
    series = spark.range(60).select(F.col("id").alias("idx"), (F.col("id") % 6 + F.col("id") / 10).alias("value"))
    parts = seasonal.decompose(series, 6)
    assert parts.where("abs(trend + seasonal + residual - value) > 1e-9").count() == 0
    assert seasonal.auto_period(8) == 6 and seasonal.auto_period(100) == 25 and seasonal.auto_period(1000) == 48


def test_attribution_sums_to_one_and_vanishes_without_signal(spark):
    weights = {f: (i - 6) / 3 for i, f in enumerate(fusion.FEATURES)}
    rows = spark.createDataFrame([tuple([1.0] * 13), tuple([0.0] * 13)], ", ".join(f"{f} double" for f in fusion.FEATURES))
    out = rows.select(*[c.alias(e) for e, c in fusion.attribution(weights).items()]).collect()
    assert abs(sum(out[0]) - 1) < 3e-4 and sum(out[1]) == 0


def test_training_separates(spark):
    rng = np.random.default_rng(0)
    data = [(*map(float, rng.normal(2.0 * y, 0.5, 13)), y) for y in (0, 1) for _ in range(30)]
    rows = spark.createDataFrame(data, ", ".join(f"{f} double" for f in fusion.FEATURES) + ", y int")
    model = fusion.train(rows, "y")
    weights = dict(zip(fusion.FEATURES, map(float, model.coefficients)))
    hits = rows.where((fusion.logistic_score(weights, float(model.intercept)) >= 0.5) == (F.col("y") == 1)).count()
    assert hits == 60


def test_forest_ranks_outliers_first(spark):
    rows = spark.createDataFrame([(i, 10 + i % 5, 100 + i % 7, 1, 2) for i in range(200)] + [(900, 500, 9000, 90, 60)], "window_index long, packets long, bytes long, syn long, dports long")
    model = forest.fit(rows, ["packets", "bytes", "syn", "dports"])
    first = forest.scored(rows, ["packets", "bytes", "syn", "dports"], model).orderBy("score").first()
    assert first.window_index == 900
    again = forest.fit(rows.repartition(7).orderBy("bytes"), ["packets", "bytes", "syn", "dports"])
    assert again == model  # a function of the rows, not of their order


def test_forest_of_few_and_equal_rows(spark):
    dims = ["packets", "bytes"]
    none = spark.createDataFrame([], "window_index long, packets long, bytes long")
    assert forest.fit(none, dims) == ([], 0)
    equal = spark.createDataFrame([(i, 3, 4) for i in range(40)], none.schema)
    trees, n = forest.fit(equal, dims)
    assert n == 40 and all(len(t) == 1 and t[0][0] == -1 for t in trees)  # no cut parts equal rows
    assert {r.score for r in forest.scored(equal, dims, (trees, n)).collect()} == {0.0}
    pair = spark.createDataFrame([(0, 1, 1), (1, 5, 1)], none.schema)
    assert {t[0][0] for t in forest.fit(pair, dims)[0]} == {0}  # only the first column differs


def test_terms_pair_han_characters(spark):
    got = spark.createDataFrame([("The SYN flood 网络安全 of 中 x",)], "t string").select(retrieval.terms(F.col("t"))).first()[0]
    assert got == ["syn", "flood", "网络", "络安", "安全", "中"]


def test_verdicts_and_checks(spark):
    rows = [("该主机发起恶意扫描；未见其他问题", "attack"), ("没有发现入侵，流量正常", "normal"), ("共 12 个流", "unknown"), ("", "unknown"), ("nothing malicious here, benign", "normal")]
    got = spark.createDataFrame(rows, "t string, want string").select(text_checks.verdict(F.col("t")).alias("v"), "want").collect()
    assert all(r.v == r.want for r in got)


def test_zero_divisions_are_zero(spark):
    r = evaluate.confusion(spark.createDataFrame([(False, False)], "t boolean, p boolean"), F.col("t"), F.col("p")).first()
    assert (r.precision, r.recall, r.f1, r.accuracy) == (0.0, 0.0, 0.0, 1.0)


def test_capture_round_trip(spark, tmp_path):
    frames = [(1_700_000_000_000 + i, simulated.frame_of("TCP", "10.0.0.1", 1000 + i, "10.0.0.2", 80, "SYN,ACK", b"x" * i)) for i in range(5)]
    frames.append((1_700_000_000_010, simulated.frame_of("DNS", "10.0.0.1", 5000, "8.8.8.8", 53, query="host.example.com")))
    path = tmp_path / "a.pcap"
    path.write_bytes(simulated.pcap_bytes(frames) + b"\0\0broken")
    (tmp_path / "b.pcap").write_bytes(b"no capture")
    spark.dataSource.register(pcap.PcapSource)
    own = spark.read.format("pcap").option("paths", f"{path},{tmp_path}/b.pcap").load().orderBy("pkt_seq").collect()
    assert len(own) == 6 and own[3].flags == "SYN,ACK" and own[3].payload_size == 3 and own[5].protocol == "DNS" and own[5].dns_query == "host.example.com"
    assert pcap.packets_from_files(spark, str(tmp_path)).count() == 6


def test_flow_export_and_logs(spark, tmp_path):
    (tmp_path / "f.csv").write_text(" Timestamp, Source IP, Source Port, Destination IP, Destination Port, Protocol, SYN Flag Count, ACK Flag Count, RST Flag Count, Total Length of Fwd Packets, Total Length of Bwd Packets, Total Fwd Packets, Total Backward Packets, Label\n"
                                    "03/07/2017 08:55:58,1.1.1.1,80.0,2.2.2.2,443,6,1,0,0,10,20.0,1,2,BENIGN\nbad,1.1.1.1,x,2.2.2.2,1,6,0,0,0,0,0,0,0,X\n")
    rows = files.flow_export(spark, str(tmp_path / "f.csv")).collect()
    assert [(r.protocol, r.src_port, r.length, r.packets, r.flags, r.label) for r in rows] == [("TCP", 80, 30, 3, "SYN", "BENIGN")]
    (tmp_path / "x.log").write_text("2024-01-01 12:00:00 | INFO     | m:f:1 - hello - you\nbroken\n")
    from netquarry.operators.records import log_records

    got = log_records(files.log_lines(spark, str(tmp_path / "x.log"))).collect()
    assert [(r.line, r.level, r.module, r.message) for r in got] == [(1, "INFO", "m:f:1", "hello - you")]


def test_online_stream_equals_batch_fold(spark, tmp_path):
    from netquarry.streaming import live

    flat = spark.createDataFrame([(i, 100, 1000, 5, 3) for i in range(30)], "window_index long, packets long, bytes long, syn long, dports long")
    profile = baseline.learn(flat)
    later = spark.createDataFrame([("c", i, 100 + 7 * (i % 9) + 400 * (i == 11), 1000 + i, 5, 3) for i in range(20)], "capture_id string, start_ms long, packets long, bytes long, syn long, dports long")
    later.coalesce(1).write.parquet(str(tmp_path / "in"))
    start = {r.dimension: (r.median, r.mad) for r in profile.collect()}
    stream = live.stream_smoothed(spark.readStream.schema(later.schema).parquet(str(tmp_path / "in")), start, 3.0, 0.1)
    got = live.run_to_end(stream, str(tmp_path / "out"), str(tmp_path / "state")).orderBy("start_ms").collect()
    fold = baseline.smoothed_windows(baseline.smoothed(later.withColumnRenamed("start_ms", "window_index"), profile, 3.0, 0.1)).orderBy("window_index").collect()
    assert [(r.start_ms, r.dimensions) for r in got] == [(r.window_index, r.dimensions) for r in fold]


def test_stream_windows_have_rows(spark):
    assert stream_windows(spark, "/root/testdata/sf0.001").count() > 100


def test_scalars_and_consensus(spark):
    from netquarry.functions import scalars
    from netquarry.operators import consensus

    rows = spark.createDataFrame([(500, 59.94, "10.0.0.1"), (2048, 90.0, "172.31.0.1"), (5 * 1024**2, 7200.0, "8.8.8.8"), (3 * 1024**3, 1.0, "1.2.3.256")], "n long, s double, ip string")
    got = rows.select(scalars.byte_size(F.col("n")).alias("n"), scalars.duration(F.col("s")).alias("s"), scalars.is_private_ipv4(F.col("ip")).alias("p")).collect()
    assert [tuple(r) for r in got] == [("500 B", "59.9s", True), ("2.0 KB", "1.5min", True), ("5.0 MB", "2.00h", False), ("3.00 GB", "1.0s", False)]
    v = spark.createDataFrame([("attack", 0, 0, False, 0.9), ("attack", 3, 0, True, 0.7), ("unknown", 0, 0, None, None)], "v string, a int, c int, f boolean, p double")
    out = consensus.consensus(v, F.col("v"), F.col("a"), F.col("c"), F.col("f"), F.col("p")).collect()
    assert [(r.consensus, r.contradictions, r.needs_review) for r in out] == [("normal", 1, True), ("attack", 0, False), ("normal", 0, False)]


# captures side by side ----------------------------------------------------------------


def day_packets(spark, days=6, busy=5):
    """Six quiet days and one that floods; each day a capture of 40 windows of ten seconds."""
    rng = np.random.default_rng(3)
    rows, seq = [], 0
    for day in range(days + 1):
        for w in range(40):
            for k in range(int(rng.integers(6, 25)) + (300 if day == days and 20 <= w < 20 + busy else 0)):
                flood = k >= 25
                rows.append((f"d{day}", seq, day * 10_000_000 + w * 10_000 + k, "TCP", "9.9.9.9" if flood else f"10.0.0.{k % 4}", 1000 + k, "10.0.0.9", k % 600 + 1 if flood else int(rng.integers(80, 90)), 60 if flood else int(rng.integers(200, 1400)), "SYN" if flood or rng.random() < 0.3 else "ACK", 0, "", "", ""))
                seq += 1
    return spark.createDataFrame(rows, "capture_id string, " + COLUMNS)


@pytest.fixture(scope="module")
def captures(spark):
    rows = day_packets(spark)
    settings = engines.EngineSettings()
    training = F.col("capture_id") < "d4"
    return engines.engine_alerts(rows, training, Thresholds(), settings), engines.features(rows, training, Thresholds(), settings), rows


def test_captures_are_judged_by_themselves(captures):
    (alerts, found, deviating, strange, cut), features, rows = captures
    per_day = {r.capture_id: r for r in features.collect()}
    assert set(per_day) == {"d4", "d5", "d6"}
    flooded, quiet = per_day["d6"], per_day["d4"]
    types = {(a.capture_id, a.type) for a in alerts.collect()}
    assert {("d6", "SYN_FLOOD_SUSPECTED"), ("d6", "PORT_SCAN_SUSPECTED"), ("d6", "BASELINE_MULTI_DIM")} <= types
    assert {(20 + i, "high") for i in range(5)} <= {(r.window_index, r.direction) for r in strange.where("capture_id = 'd6'").collect()}
    assert not any(c == "d4" and t.endswith("SUSPECTED") for c, t in types)
    assert flooded.rule_max_severity == 4.0 and flooded.baseline_multi_dim_triggered == 1.0 and flooded.isolation_anomaly_count >= 0.5
    assert quiet.baseline_multi_dim_triggered == 0.0 and quiet.baseline_drifted == 0.0
    # a capture alone gives what it gives beside the others
    alone = {a.subject: a.severity for a in rules.all_alerts(rows.where("capture_id = 'd6'"), Thresholds()).collect()}
    assert alone == {a.subject: a.severity for a in alerts.where("capture_id = 'd6' and type like '%SUSPECTED'").collect()}


def test_features_by_plain_python(captures):
    (alerts, found, deviating, strange, cut), features, _ = captures
    rank = {"CRITICAL": 4, "HIGH": 3, "MEDIUM": 2}
    every, devs, odd = alerts.collect(), deviating.collect(), strange.collect()
    totals = {r.capture_id: r.n for r in found.windows.groupBy("capture_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    for f in features.collect():
        own = [a for a in every if a.capture_id == f.capture_id]
        assert f.rule_alert_count_norm == min(len(own) / 10, 1) and f.rule_triggered_rules == min(len({a.type for a in own}) / 5, 1)
        assert f.rule_max_severity == max((rank.get(a.severity, 1) for a in own), default=0)
        assert f.baseline_deviation_count == min(len({d.window_index for d in devs if d.capture_id == f.capture_id}) / 10, 1)
        mine = sorted((o for o in odd if o.capture_id == f.capture_id), key=lambda o: o.window_index)
        assert f.isolation_anomaly_ratio == pytest.approx(len(mine) / totals[f.capture_id])
        if mine:
            dims = [o.dimension for o in mine]
            top = max(dict.fromkeys(dims), key=lambda d: (dims.count(d), -dims.index(d)))
            assert f.isolation_top_dim_risk == (1.0 if top in ("syn", "dports") else 0.5)
            assert f.isolation_mean_score == pytest.approx(min(abs(round(sum(o.score for o in mine) / len(mine), 4)) / abs(cut), 1), abs=1e-3)


def test_strange_windows_have_a_side_and_a_severity(spark):
    medians = spark.createDataFrame([(10.0, 1000.0, 0.0, 3.0)], "m_packets double, m_bytes double, m_syn double, m_dports double")
    rows = spark.createDataFrame([("c", 0, 50, 1000, 0, 3, -0.2), ("c", 1, 1, 1000, 0, 3, -0.2), ("c", 2, 10, 1000, 4, 3, -0.11), ("c", 3, 10, 1000, 0, 3, -0.11)], "capture_id string, window_index long, packets long, bytes long, syn long, dports long, score double")
    got = {r.window_index: (r.dimension, r.direction, r.severity) for r in engines.judged(rows, medians, -0.1, engines.EngineSettings()).collect()}
    assert got == {0: ("packets", "high", "HIGH"), 1: ("packets", "low", "INFO"), 2: ("syn", "high", "MEDIUM"), 3: ("packets", "high", "MEDIUM")}


def test_places_by_counts_of_values(spark):
    values = [float(x) for x in np.random.default_rng(5).integers(0, 50, 3000)] + list(np.random.default_rng(6).normal(size=9000))
    rows = spark.createDataFrame([(float(v),) for v in values], "v double")
    for place in (0, 17, 6000, len(values) - 1):
        assert forest._at_place(rows, "v", place) == sorted(values)[place]


# retrieval and text ----------------------------------------------------------------


def test_texts_are_cut_at_the_first_separator_that_occurs():
    assert retrieval.cut_text("a" * 10, 4, 0) == ["aaaa", "aaaa", "aa"]
    assert retrieval.cut_text("one two. three four", 12, 0) == ["one two", ". three four"]
    assert retrieval.cut_text("甲乙。丙丁！戊", 4, 0) == ["甲乙", "。丙丁", "！戊"] and retrieval.cut_text("   ", 4, 0) == []
    text = "\n\n".join(" ".join(f"w{i}x{j}" for j in range(i * 7 % 90)) for i in range(60))
    cut = retrieval.cut_text(text, 200, 20)
    assert all(0 < len(c) <= 200 for c in cut) and set(" ".join(cut).split()) == set(text.split())


def test_split_text_keeps_null_ids(spark):
    got = retrieval.split_text(spark.createDataFrame([(None, "a b"), (1, None), (2, "x" * 2500)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.chunk_no, len(r.text)) for r in got) == [(0, 0, 3), (2, 0, 1000), (2, 1, 1000), (2, 2, 600)]


def test_hybrid_search_by_plain_python(spark):
    rng = np.random.default_rng(8)
    words = [f"t{i}" for i in range(60)]
    docs = [(i, f"T{i}", " ".join(rng.choice(words, 30)) + (" dns" if i % 7 == 0 else ""), "m") for i in range(80)]
    queries = [(i, " ".join(rng.choice(words, 4)) + " dns") for i in (0, 20, 40)]
    vectors = rng.normal(size=(80, 8))
    chunks = spark.createDataFrame(docs, "chunk_id long, title string, content string, meta string")
    asked = spark.createDataFrame(queries, "query_id long, text string")
    own = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    index = retrieval.ask(chunks.withColumnRenamed("content", "text"), asked)
    got = retrieval.hybrid(index, chunks, asked, own, own.where("vec_id % 20 = 0")).collect()
    bm = {}
    for r in retrieval.bm25(index).collect():
        bm.setdefault(r.query_id, {})[r.chunk_id] = r["rank"]
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    for q, text in queries:
        d = np.round(1 - unit @ unit[q], 6)
        near = [i for i in np.lexsort((np.arange(80), d)) if i != q][:20]
        score = {}
        for ranks in (bm.get(q, {}), {int(i): k + 1 for k, i in enumerate(near)}):
            for c, k in ranks.items():
                score[c] = score.get(c, 0) + 1 / (60 + k)
        lead = sorted(score, key=lambda c: (-round(score[c], 9), c))[:5]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert {r.chunk_id for r in mine} == set(lead) and len(mine) == 5
        assert all(abs(r.similarity - (1 - min(max(d[r.chunk_id], 0), 2) / 2)) < 1e-6 for r in mine)
        assert [r.rerank_score for r in mine] == sorted((r.rerank_score for r in mine), reverse=True)


def _moved(spark, run):
    """Rows that the stages of ``run`` write for a shuffle, and its result."""
    sc = spark.sparkContext
    stages = lambda: {(x.stageId(), x.attemptId()): x.shuffleWriteRecords() for x in _listed(sc)}
    before = stages()
    out = run()
    return sum(n for k, n in stages().items() if k not in before), out


def _listed(sc):
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    found = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return [found.apply(i) for i in range(found.size())]


def test_products_of_query_terms_and_chunks_are_not_shuffled(spark):
    chunks = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(20)) + f" own{i}") for i in range(400)], "chunk_id long, text string")
    queries = spark.createDataFrame([(q, " ".join(f"w{j}" for j in range(20)) + f" own{q}") for q in range(60)], "query_id long, text string")
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables of size
    try:
        moved, found = _moved(spark, lambda: retrieval.bm25(retrieval.ask(chunks, queries)).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
    assert {(r.query_id, r.chunk_id) for r in found if r["rank"] == 1} == {(q, q) for q in range(60)} and len(found) == 60 * 20
    assert moved < 60_000  # the counts are 8 400 rows, their products with the queries 480 000


def test_ranked_in_small_shards_and_blocks(spark):
    rng = np.random.default_rng(3)
    words = [f"t{i}" for i in range(30)]
    texts = {i: " ".join(rng.choice(words, rng.integers(1, 40))) for i in range(90)} | {90: None, 91: "", 92: "the of", 93: "nothing asked"}
    texts |= {100 + i: texts[i] for i in range(20)}  # copies tie
    asked = {int(q): " ".join(rng.choice(words, 5)) for q in range(6)} | {9: "absent", 10: None}
    chunks = spark.createDataFrame(list(texts.items()), "chunk_id long, text string")
    index = retrieval.ask(chunks, spark.createDataFrame(list(asked.items()), "query_id long, text string"))
    listed = {i: [w for w in (t or "").split() if w not in ("the", "of")] for i, t in texts.items()}
    mean = sum(map(len, listed.values())) / len(listed)
    want = set()
    for q, text in asked.items():
        own = set((text or "").split())
        shared = {i: len(own & set(t)) for i, t in listed.items() if own & set(t)}
        df = {w: sum(w in t for t in listed.values()) for w in own}
        score = {i: round(sum(np.log1p((len(listed) - df[w] + 0.5) / (df[w] + 0.5)) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / mean)) for w in own if w in t), 6) for i, t in listed.items() if i in shared}
        for name, values in (("bm25", score), ("overlap", shared)):
            want |= {(q, name, i, float(values[i]), k) for k, i in enumerate(sorted(values, key=lambda i: (-values[i], i))[:7], 1)}
    for shard_rows, block in ((10_000, 1_000_000), (50, 40), (7, 1)):
        got = retrieval.ranked(index, k=7, shard_rows=shard_rows, block=block).collect()
        assert {(r.query_id, r.list, r.chunk_id, r.score, r["rank"]) for r in got} == want and len(got) == len(want)
    none = retrieval.ask(chunks.limit(0), spark.createDataFrame(list(asked.items()), "query_id long, text string"))
    assert retrieval.ranked(none).count() == 0


def test_match_scores_are_rates(spark):
    alerts = spark.createDataFrame([(1, ["SYN", "flood"], [443, 80], ["1.1.1.1", "TCP", "x.com"]), (2, [], [], [])], "alert_id long, keywords array<string>, numbers array<long>, tokens array<string>")
    hits = spark.createDataFrame([(1, 1, "title 443", "SYN and 1024 of 80", None), (1, 2, "", "flood SYN TCP", 2.0)], "alert_id long, rank long, title string, content string, similarity double")
    got = {r.alert_id: (r.score, r["rank"]) for r in consensus.matched_evidence(alerts, hits).collect()}
    assert got[1] == (round(0.45 + 0.1 / 3 + 0.25, 4), 2) and got[2] == (0.0, None)
    assert spark.range(1).select(consensus.named_numbers(F.lit("port 443 and 443, 8 1234567 22")).alias("n")).first().n == [443, 22]


def test_contradictions_and_techniques(spark):
    rows = [("这是恶意攻击", False, 0.9, 3, 1), ("可能存在端口扫描", None, None, 0, 0), ("确认为端口扫描", None, None, 0, 1), ("all calm", False, 0.9, 0, 0), ("a malicious SYN Flood", False, 0.9, 0, 2)]
    got = spark.createDataFrame(rows, "t string, f boolean, c double, a int, want int").select(text_checks.inconsistencies(F.col("t"), F.col("f"), F.col("c"), F.col("a")).alias("n"), "want").collect()
    assert all(r.n == r.want for r in got)
    names = spark.range(1).select(text_checks.techniques(F.lit("Lateral Movement, then Port Scan and Port Scan. SYN Flood")).alias("x")).first().x
    assert names == ["Lateral Movement", "Port Scan", "SYN Flood"]


def test_records_update_only_allowed_columns(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 2), (2, "b", 3)], "id long, name string, n int")
    changes = spark.createDataFrame([(1, "z", 9, 5)], "id long, name string, n int, other int")
    assert sorted(tuple(r) for r in records.updated(rows, changes, "id", ["name", "id", "absent"]).collect()) == [(1, "z", 2), (2, "b", 3)]
    (tmp_path / "a.json").write_text('[{"id": "1"}, {"id": "2"}]')
    (tmp_path / "b.json").write_text('{"records": [{"id": "3"}]}')
    assert sorted(r.record["id"] for r in records.imported(spark, str(tmp_path)).collect()) == ["1", "2", "3"]
    empty = records.trend_summary(spark.createDataFrame([], "is_attack boolean, alerts long, needs_review boolean, severity string")).first()
    assert tuple(empty) == (0, 0, 0, 0.0, 0, 0.0, 0, 0)


def test_seasonal_falls_back_to_plain_deviations(spark):
    short = spark.createDataFrame([("a", i, 10.0 + (90 if i == 5 else i % 2)) for i in range(30)], "capture_id string, idx long, value double")
    got = seasonal.seasonal_alerts(short, 24, 3.0, by="capture_id").collect()
    assert [(r.capture_id, r.type, r.window_index, r.direction, r.severity, r.method) for r in got] == [("a", "SEASONAL_ANOMALY", 5, "high", "CRITICAL", "zscore_fallback")]
    long = short.unionByName(spark.createDataFrame([("b", i, float(i % 4) + (50 if i == 40 else 0)) for i in range(96)], short.schema))
    found = {(r.capture_id, r.window_index): r.method for r in seasonal.seasonal_alerts(long, 24, 3.0, by="capture_id").collect()}
    assert found[("b", 40)] == "moving_average" and found[("a", 5)] == "zscore_fallback"
    assert seasonal.auto_seasonal(long, by="capture_id").where("capture_id = 'b' and idx = 40").count() == 1


def _pcapng(frames):
    import struct

    block = lambda kind, body: struct.pack("<II", kind, 12 + len(body)) + body + struct.pack("<I", 12 + len(body))
    out = [block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)), block(1, struct.pack("<HHI", 1, 0, 0))]
    for ms, f in frames:
        pad = f + b"\0" * (-len(f) % 4)
        out.append(block(6, struct.pack("<IIIII", 0, ms * 1000 >> 32, ms * 1000 & 0xFFFFFFFF, len(f), len(f)) + pad))
    return b"".join(out)


def test_captures_raise_the_alerts_of_their_packets(spark, tmp_path):
    frames = [(1_700_000_000_000 + i, simulated.frame_of("TCP", "10.0.0.1", 1000 + i, "10.0.0.2", 1 + i % 40, "SYN")) for i in range(120)]
    frames += [(1_700_000_001_000 + i, simulated.frame_of("UDP", "10.0.0.3", 2000 + i, "10.0.0.4", 443, payload=bytes([0xC3]) + bytes.fromhex("deadbeef") + b"x" * 1300)) for i in range(60)]
    (tmp_path / "a.pcap").write_bytes(simulated.pcap_bytes(frames))
    (tmp_path / "b.pcapng").write_bytes(_pcapng(frames) + b"\x06\0\0\0broken")
    spark.dataSource.register(pcap.PcapSource)
    by_source = spark.read.format("pcap").option("paths", f"{tmp_path}/a.pcap,{tmp_path}/b.pcapng").load()
    by_reader = pcap.packets_from_files(spark, str(tmp_path))
    columns = [c for c in by_source.columns if c != "capture_id"]
    assert sorted(map(tuple, by_source.select(*columns).collect())) == sorted(map(tuple, by_reader.select(*columns).collect())) and by_source.count() == 360
    one = by_source.where("capture_id like '%a.pcap'")
    types = {a.type: a.detail for a in rules.all_alerts(one, Thresholds()).collect()}
    assert {"SYN_FLOOD_SUSPECTED", "PORT_SCAN_SUSPECTED", "QUIC_CONNECTION_FLOOD", "QUIC_INITIAL_RATIO_ANOMALY", "QUIC_UNKNOWN_VERSION"} <= set(types) and types["QUIC_UNKNOWN_VERSION"] == "deadbeef"
    both = rules.unsorted_alerts(by_source, Thresholds(), captures=True).groupBy("capture_id").count().collect()
    assert len({r["count"] for r in both}) == 1 and len(both) == 2


def test_stored_baselines_still_find_drift(spark, tmp_path):
    schema = "window_index long, packets long, bytes long, syn long, dports long"
    train = spark.createDataFrame([(i, 100 + i % 7, 1000 + i, 5, 3) for i in range(30)], schema)
    for at in (1, 2):  # the second save of a name replaces the first
        store.save(baseline.learn(train), train, "office", at, str(tmp_path))
    store.save(baseline.learn(train.limit(20)), train.limit(20), "lab", 5, str(tmp_path))
    profiles, training = store.load(spark, str(tmp_path))
    assert profiles.count() == 8 and training.where("name = 'office'").count() == 30
    assert [r.name for r in store.listed(profiles).collect()] == ["lab", "office"]
    moved = spark.createDataFrame([(i, 500, 9000, 50, 30) for i in range(10)], schema)
    found = baseline.drift(training.where("name = 'office'"), moved).collect()
    assert len(found) == 4 and all(r.detected for r in found)
    both = store.with_fallback(profiles.where("name = 'lab'"), profiles)
    assert {(r.name, r.source) for r in both.collect()} == {("lab", "first"), ("office", "second")}
    items = spark.createDataFrame([("a", "x")], "title string, content string")
    assert [(r.title, r.category) for r in store.united({"one": items, "two": items.unionByName(items.select(F.lit("b").alias("title"), "content"))}).orderBy("title").collect()] == [("a", "one"), ("b", "two")]
