"""Assessment helpers and file sources on rows and files made by hand."""

import json

import pytest
from pyspark.sql import functions as F

from netquarry.operators import assessment, engines, store
from netquarry.schemas import Thresholds
from netquarry.sources import files

from . import simulated


def one(spark, value, use, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(use(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize("token, want", [
    ("0.9", (0.9, None)), ('"0.9"', (0.9, None)), ('" 7 "', (7.0, None)), ('"high"', (0.0, "high")), ("true", (0.0, "True")), ("false", (0.0, "False")), ("null", (0.0, "None")), (None, (0.0, "None")), ('"true"', (0.0, "true")), ("-1e-3", (-0.001, None)), ('""', (0.0, "")), ("[1]", (0.0, "[1]")),
])
def test_numbers_are_coerced(spark, token, want):
    assert tuple(one(spark, token, assessment.coerced)) == want


@pytest.mark.parametrize("name, size, bad", [
    ("a.pcap", 10, False), ("A.PCAPNG", 10, False), ("a.exe", 10, True), ("noend", 10, True), (None, 10, True), ("a.pcap", 201 * 1024 * 1024, True), ("a.pcap", 200 * 1024 * 1024, False), (".pcap", 1, True), ("dir.pcap/x", 1, True),
])
def test_uploads(spark, name, size, bad):
    row = spark.createDataFrame([(name, size)], "n string, s long").select(assessment.upload_error(F.col("n"), F.col("s")).alias("r")).first()
    assert (row.r is not None) == bad


def test_names_and_keys(spark):
    assert one(spark, "", assessment.name_error) == one(spark, None, assessment.name_error) == "基线名称不能为空"
    assert one(spark, "x" * 51, assessment.name_error) == "基线名称过长（51 字符，上限 50）" and one(spark, "x" * 50, assessment.name_error) is None
    assert all(one(spark, f"a{c}b", assessment.name_error) for c in '\\/:*?"<>|')
    assert one(spark, "sk-XxXx0000000", assessment.key_error) == "API Key 仍是占位符，请填写真实 Key" and one(spark, "short", assessment.key_error) and one(spark, "0123456789", assessment.key_error) is None


@pytest.mark.parametrize("url, safe", [
    ("https://api.example.com/v1", True), ("https://api.example.com:443", True), ("https://api.example.com:8443", False), ("http://api.example.com", False), ("https://127.0.0.1/", False), ("https://10.1.2.3", False), ("https://172.20.0.1", False),
    ("https://172.32.0.1", True), ("https://192.168.0.1", False), ("https://169.254.169.254/latest", False), ("https://u:p@localhost/", False), ("https://x.internal", False), ("https://8.8.8.8", True), ("https://good.com@10.0.0.1/", False), ("", False), (None, False), ("https://", False),
])
def test_endpoints(spark, url, safe):
    assert one(spark, url, assessment.safe_endpoint) is safe


def test_labels_and_threats(spark):
    rows = [("c", 1, "PORT_SCAN_SUSPECTED"), ("c", 2, "OTHER"), ("c", 3, "PORT_SCAN_SUSPECTED"), ("d", 1, None)]
    alerts = spark.createDataFrame(rows, "cap string, n int, type string")
    assert {r.cap: r.threats for r in assessment.threat_types(alerts, "cap", ["n"]).collect()} == {"c": "端口扫描 OTHER", "d": "网络异常"}
    got = assessment.alert_profiles(alerts.where("n = 2")).first()
    assert (got.label, got.query, got.keywords) == ("OTHER", "OTHER", [])


def test_fingerprint_is_of_the_rows_not_their_order(spark):
    rows = [(1, "a"), (2, None), (2, None), (3, "b")]
    of = lambda r, n=1: tuple(assessment.fingerprint(spark.createDataFrame(r, "k int, v string").repartition(n), ["k", "v"]).first())
    assert of(rows) == of(rows[::-1], 3) and of(rows)[0] == 4
    assert len({of(rows), of(rows[1:]), of([(1, "a"), (2, None), (3, "b"), (3, "b")]), of([])}) == 4


def test_report_scores_by_hand(spark):
    kind = "id int, overview string, overall_confidence double, attacks array<struct<evidence:string,recommended_actions:array<string>>>, recommended_actions array<string>, n_alerts int, ips array<string>, numbers array<string>"
    rows = [
        (1, "o", 0.5, [("from 10.0.0.9", ["please Block x"]), ("80 of 5", None), ("nothing", ["wait"]), ("", [])], ["封禁"], 4, ["10.0.0.9", ""], ["80", "5"]),
        (2, None, None, None, None, 3, [], []), (3, "o", None, [], [], 0, ["1"], ["22"]),
    ]
    got = {r.id: (r.completeness, r.evidence_accuracy, r.actionability) for r in assessment.report_scores(spark.createDataFrame(rows, kind)).collect()}
    assert got == {1: (1.0, 0.6667, 0.6667), 2: (0.0, 0.0, 0.0), 3: (0.25, 0.0, 0.0)}


def test_samples_and_splits(spark):
    alerts = spark.createDataFrame([("a", "X"), ("a", "Y"), ("c", "X")], "s string, type string")
    expected = spark.createDataFrame([("a", "Y"), ("b", "X"), ("c", None), ("d", None)], "s string, expected string")
    status = assessment.sample_status(alerts, expected, "s")
    assert {r.s: r.status for r in status.collect()} == {"a": "TP", "b": "FN", "c": "FP", "d": "TN"}
    assert tuple(assessment.sample_rates(status).first()) == (1, 1, 1, 1, 0.5, 0.5, 0.5)
    rows = spark.range(10).select(F.lit("n").alias("cap"), F.col("id").alias("window_index"))
    split = assessment.first_share(rows, ["window_index"], 0.8)
    assert sorted(r.window_index for r in split.where("first").collect()) == list(range(8))
    bad = spark.createDataFrame([("n", 9), ("x", 1)], "cap string, window_index long")
    attacks = spark.createDataFrame([("x", 1), ("y", 1)], "cap string, window_index long")
    assert tuple(assessment.split_rates(split.where("not first"), attacks, bad, "cap").first()) == (2, 1, 2, 1, 0.5, 0.5)


def test_prefixes_are_judged_as_captures_of_their_own(spark):
    hour = 3_600_000
    quiet = [simulated.traffic_mix(spark, 120).withColumns({"capture_id": F.lit(f"d{k}"), "ts_ms": F.lit(k * 24 * hour) + F.col("pkt_seq") * (12 * hour // 120)}) for k in range(3)]
    loud = simulated.attack(spark, "synflood", 200).withColumns({"capture_id": F.lit("d2"), "pkt_seq": F.col("pkt_seq") + 1000, "ts_ms": F.lit(2 * 24 * hour + 3 * hour) + F.col("pkt_seq") * 60_000})
    packets = quiet[0].unionByName(quiet[1]).unionByName(quiet[2]).unionByName(loud)
    settings, training = engines.EngineSettings(window_sec=3600), F.col("capture_id") < "d1"
    got = {(r.capture_id, r.window_index): tuple(r)[2:] for r in engines.prefix_features(packets, training, Thresholds(), settings).collect()}
    assert len(got) == 24
    for cap, start in (("d1", 24 * hour), ("d2", 48 * hour)):
        for i in (0, 3, 5, 11):
            part = packets.where(training | ((F.col("capture_id") == cap) & (F.col("ts_ms") < start + (i + 1) * hour)))
            want = engines.features(part, training, Thresholds(), settings, with_forest=False).first()
            assert got[cap, i] == tuple(want)[1:8], (cap, i)
    assert got["d2", 2][0] == 0.0 and got["d2", 11][2] >= 2


def test_two_saves_in_one_millisecond_keep_one_whole(spark, tmp_path):
    schema = "window_index long, packets long, bytes long, syn long, dports long"
    for n in (10, 20):
        train = spark.createDataFrame([(i, 100 + i, 1000, 5, 3) for i in range(n)], schema)
        store.save(engines.baseline.learn(train), train, "office", 7, str(tmp_path))
    profiles, training = store.load(spark, str(tmp_path))
    assert profiles.count() == 4 and training.count() in (10, 20) and profiles.first().samples == training.count()


def test_knowledge_files_patterns_and_digests(spark, tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "long one.md").write_text("x" * 250)
    (docs / "short.txt").write_text("too short")
    assert [(r.title, len(r.content)) for r in files.knowledge_files(spark, str(docs)).collect()] == [("long one", 250)]
    ref = [{"source_name": "other", "external_id": "X"}, {"source_name": "mitre-attack", "external_id": "T1046"}]
    bundle = {"objects": [
        {"type": "attack-pattern", "name": "Scan", "external_references": ref, "kill_chain_phases": [{"phase_name": "discovery"}, {"phase_name": "x"}]}, {"type": "attack-pattern", "name": "Old", "revoked": True, "external_references": ref},
        {"type": "malware", "name": "M", "external_references": ref}, {"type": "attack-pattern", "name": "None", "external_references": ref[:1]},
    ]}
    (tmp_path / "stix.json").write_text(json.dumps(bundle, indent=1))
    assert [tuple(r) for r in files.attack_patterns(spark, str(tmp_path / "stix.json")).collect()] == [("T1046", "Scan", "discovery,x")]
    import hashlib

    digest = hashlib.sha256(b"x" * 250).hexdigest()
    got = files.file_digests(spark, str(docs / "long one.md")).first()
    assert got.sha256 == digest and got.case_id == f"PCAP-{digest[:16]}"
