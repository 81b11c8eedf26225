"""Models fitted side by side, intervals, indicators, sub-queries and nested texts against plain Python."""

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from netquarry.operators import indicators, intervals, ordered, retrieval, text_checks, training, windows

NAMES = ["a", "b", "c"]


def table_of(spark, seed=1, n=400, groups=9):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    x[:, 2] = np.round(x[:, 0]) + 0.1 * x[:, 2]
    y = (rng.random(n) < 1 / (1 + np.exp(-(1.5 * x[:, 0] - x[:, 1])))).astype(int)
    g = rng.integers(0, groups, n) ** 2 // groups
    rows = [(f"g{k}", int(t), *map(float, v)) for k, t, v in zip(g, y, x)]
    return spark.createDataFrame(rows, "g string, y int, a double, b double, c double"), rows


def plain_fit(x, y, mask):
    """Balanced logistic regression with C = 1 by plain Newton steps."""
    x = np.column_stack([x * mask, np.ones(len(x))])
    s = np.where(y == 1, len(y) / (2 * (y == 1).sum()), len(y) / (2 * (y == 0).sum()))
    free, w = np.array([1.0] * (x.shape[1] - 1) + [0.0]), np.zeros(x.shape[1])
    for _ in range(60):
        q = 1 / (1 + np.exp(-x @ w))
        w = w - np.linalg.solve((x * (s * q * (1 - q))[:, None]).T @ x + np.diag(free), x.T @ (s * (q - y)) + free * w)
    return w


def test_all_models_of_one_pass_are_those_fitted_alone(spark):
    rows, plain = table_of(spark)
    folds = {r.g: r.fold for r in training.group_folds(rows, "g", "y").collect()}
    known = rows.join(training.group_folds(rows, "g", "y").select("g", "fold"), "g")
    subsets = {"all": NAMES, "two": ["a", "c"]}
    for settings in (training.TrainSettings(), training.TrainSettings(at_once=3)):
        got = {(r.subset, r.fold): np.array([*r.weights, r.bias]) for r in training.fit_many(known, NAMES, "y", "fold", subsets, with_all=True, settings=settings).collect()}
        assert len(got) == 2 * (len(set(folds.values())) + 1)
        for (name, fold), w in got.items():
            own = [r for r in plain if folds[r[0]] != fold]
            want = plain_fit(np.array([r[2:] for r in own]), np.array([r[1] for r in own]), np.array([float(f in subsets[name]) for f in NAMES]))
            assert np.abs(w - want).max() < 1e-8


def test_out_of_fold_rates_by_hand(spark):
    rows, plain = table_of(spark, seed=2)
    known = rows.join(training.group_numbers(rows, "g"), "g")
    number = {r.g: r.fold for r in training.group_numbers(rows, "g").collect()}
    assert sorted(number.values()) == list(range(len(number)))
    rates = training.fold_rates(training.predictions(known, NAMES, "fold", training.fit_many(known, NAMES, "y", "fold")), "y", "fold")
    for r in rates.collect():
        train, test = [x for x in plain if number[x[0]] != r.fold], [x for x in plain if number[x[0]] == r.fold]
        w = plain_fit(np.array([x[2:] for x in train]), np.array([x[1] for x in train]), np.ones(3))
        hit = np.array([x[2:] for x in test]) @ w[:3] + w[3] >= 0
        y = np.array([x[1] for x in test]) == 1
        assert (r.tp, r.fp, r.fn, r.tn) == ((y & hit).sum(), (~y & hit).sum(), (y & ~hit).sum(), (~y & ~hit).sum())
    s = training.summary(rates).first()
    f1 = [r.f1 for r in rates.collect()]
    assert s.folds == len(f1) and s.f1_mean == pytest.approx(np.mean(f1), abs=1e-4) and s.f1_std == pytest.approx(np.std(f1), abs=1e-4)


def test_folds_hold_whole_groups_and_one_class_gives_no_model(spark):
    rows, plain = table_of(spark, groups=12)
    folds = training.group_folds(rows, "g", "y").collect()
    sizes = sorted(((-r.n, r.g) for r in folds))
    assert [r.fold for r in sorted(folds, key=lambda r: (-r.n, r.g))] == [i % 5 for i in range(len(sizes))]
    one = rows.withColumn("y", F.lit(1)).join(training.group_numbers(rows, "g"), "g")
    assert training.fit_many(one, NAMES, "y", "fold").where("weights is not null").isEmpty()
    assert training.fit_many(rows.limit(0).withColumn("fold", F.lit(0)), NAMES, "y", "fold").isEmpty()


def test_moments_are_the_exact_ones_in_any_parts(spark):
    rng = np.random.default_rng(5)
    many = [(v / 100.0,) for v, n in zip(range(11), [2941, 5982, 6050, 6035, 6009, 5929, 5987, 5998, 6011, 6046, 3012]) for _ in range(n)]
    many = [many[i] for i in rng.permutation(len(many))]
    x = [Fraction(v) for (v,) in many]
    want = float(sum(v * v for v in x) / len(x) - (sum(x) / len(x)) ** 2)
    for parts in (1, 2, 3, 7, 8, 16, 32):
        assert training.moments(spark.createDataFrame(many, "a double").repartition(parts), ["a"]).first().covariance == want
    shifted = [(1e12 + v, 3.0) for v in range(10)]  # sums of squares of doubles lose this one
    assert {(r.a, r.b): r.covariance for r in training.moments(spark.createDataFrame(shifted, "a double, b double"), ["a", "b"]).collect()} == {("a", "a"): 8.25, ("a", "b"): 0.0, ("b", "b"): 0.0}


def test_moments_of_nulls_and_extremes(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1.0, None, nan, 1e200, 1e-200, 7), (2.0, 4.0, None, 1e200, 3e-200, None), (4.0, 8.0, 1.0, 1e200, 5e-200, 7), (None, 1.0, inf, -1e200, 0.0, 9)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double, f long")
    got = {(r.a, r.b): r.covariance for r in training.moments(df, list("abcdef")).collect()}
    assert len(got) == 21 and got["a", "b"] == 2.0 and got["a", "a"] == pytest.approx(14 / 9, rel=1e-15) and np.isnan(got["c", "c"]) and np.isnan(got["a", "c"])
    assert got["a", "d"] == 0.0 and got["d", "d"] == inf and got["e", "e"] == 0.0 and got["d", "e"] == pytest.approx(1.125, rel=1e-14)
    assert got["a", "f"] == 0.0 and got["f", "f"] == pytest.approx(8 / 9, rel=1e-15)
    assert [r.covariance for r in training.moments(df.limit(0), ["a", "b"]).collect()] == [None] * 3
    assert training.moments(df.where("a is null").drop("b").withColumn("b", F.lit(None).cast("double")), ["a", "b"]).where("covariance is null").count() == 3


def test_vif_by_regressions(spark):
    rows, plain = table_of(spark, seed=4)
    x = np.array([r[2:] for r in plain])
    got = {r.column: r.vif for r in training.vif(rows.withColumn("one", F.lit(3.0)).withColumn("twin", F.col("a") * 2), [*NAMES, "one"]).collect()}
    for i, name in enumerate(NAMES):
        a = np.column_stack([np.ones(len(x)), np.delete(x, i, axis=1)])
        rest = x[:, i] - a @ np.linalg.lstsq(a, x[:, i], rcond=None)[0]
        assert got[name] == pytest.approx(1 / (1 - (1 - (rest**2).sum() / ((x[:, i] - x[:, i].mean()) ** 2).sum())), rel=1e-8)
    assert got["one"] is None
    twins = {r.column: r.vif for r in training.vif(rows.withColumn("twin", F.col("a") * 2), ["a", "twin", "b"]).collect()}
    assert twins["a"] > 1e9 and twins["twin"] > 1e9 and twins["b"] < 2


def test_window_labels_by_milliseconds(spark):
    rng = np.random.default_rng(7)
    spans = [("c", 5, 9), ("c", 9, 12), ("c", 20, 20), ("c", 30, 90), ("c", 40, 50), ("d", 0, 3)] + [("e", int(a), int(a + n)) for a, n in zip(rng.integers(0, 400, 30), rng.integers(0, 25, 30))]
    found = [("c", a, a + 4) for a in range(0, 100, 3)] + [("d", 0, 3), ("d", 3, 3), ("f", 1, 2)] + [("e", int(a), int(a + n)) for a, n in zip(rng.integers(0, 400, 60), rng.integers(1, 40, 60))]
    got = intervals.window_labels(spark.createDataFrame(found, "cap string, start_ms long, end_ms long"), spark.createDataFrame(spans, "cap string, start_ms long, end_ms long"), "cap", 7)
    rows = [(r.cap, r.start_ms, r.end_ms, r.label) for r in got.collect()]
    assert len(rows) == len(found)
    for cap, a, b, label in rows:
        inside = [any(c == cap and s <= m < e for c, s, e in spans) for m in range(a, b)]
        assert label == (0 if not any(inside) else 1 if all(inside) else None)


def test_domains_are_met_at_label_borders(spark):
    names = ["evil.com", "a.evil.com.", "A.B.Evil.COM", "notevil.com", "com", "x.org", "", None]
    packets = spark.createDataFrame([(n, "10.0.0.1") for n in names], "dns_query string, dst_ip string")
    listed = spark.createDataFrame([("EVIL.com.",), ("b.evil.com",), ("org",), ("",)], "domain string")
    got = {(r.indicator, r.domain) for r in indicators.domains_in_capture(packets, listed).collect()}
    assert got == {("evil.com", "evil.com"), ("evil.com", "a.evil.com"), ("evil.com", "a.b.evil.com"), ("b.evil.com", "a.b.evil.com"), ("org", "x.org")}


def test_running_sums_over_ranges(spark):
    rng = np.random.default_rng(3)
    rows = [(f"k{int(k)}", int(i), int(v)) for i, (k, v) in enumerate(zip(rng.integers(0, 3, 500) ** 2, rng.integers(-5, 9, 500)))]
    got = ordered.running_sums(spark.createDataFrame(rows, "k string, i long, v long").repartition(7), ["k"], ["i"], {"upto": F.col("v")}).collect()
    want, total = {}, {}
    for k, i, v in rows:
        total[k] = total.get(k, 0) + v
        want[i] = total[k]
    assert {r.i: r.upto for r in got} == want
    whole = ordered.numbered(spark.createDataFrame(rows, "k string, i long, v long"), [], ["i"]).collect()
    assert all(r.number == r.i for r in whole) and len(whole) == 500


def test_a_capture_without_times_counts_arrivals(spark):
    rows = [("a", 1, 5000, 80), ("a", 2, 7500, 81), ("b", 4, None, 80), ("b", 9, 100, 80), ("b", 12, 50, 81)]
    packets = spark.createDataFrame(rows, "capture_id string, pkt_seq long, ts_ms long, dst_port int")
    got = {(r.capture_id, r.pkt_seq): r.rel_ms for r in windows.timed(packets, "capture_id").collect()}
    assert got == {("a", 1): 0, ("a", 2): 2500, ("b", 4): 0, ("b", 9): 1000, ("b", 12): 2000}


@pytest.mark.parametrize("text, want", [
    ("DNS放大攻击和DNS投毒的区别，检测上关注什么？", ["DNS放大攻击，检测上关注什么？", "DNS投毒，检测上关注什么？"]), ("XSS和CSRF有什么区别", ["XSS是什么", "CSRF是什么"]), ("SYN flood和UDP flood的区别", ["SYN flood是什么", "UDP flood是什么"]),
    ("什么是SYN flood攻击？", ["什么是SYN flood攻击？"]), ("TCP vs. UDP的对比 怎么选", ["TCP，怎么选", "UDP，怎么选"]), ("有什么区别", ["有什么区别"]), ("", [""]), (None, [""]),
])
def test_sub_queries(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(retrieval.sub_queries(F.col("t"))).first()[0] == want


def test_hits_of_sub_queries_are_first_seen(spark):
    rows = [(1, 0, 10, 1), (1, 0, 11, 2), (1, 1, 11, 1), (1, 1, 12, 2), (1, 1, 13, 3), (2, 0, 10, 1)]
    got = retrieval.compared(spark.createDataFrame(rows, "query_id long, sub int, chunk_id long, rank long"), 3).collect()
    assert sorted((r.query_id, r.rank, r.chunk_id) for r in got) == [(1, 1, 10), (1, 2, 11), (1, 3, 12), (2, 1, 10)]


def test_nested_texts_are_sanitised(spark):
    rows = [(1, (" a\x00b ", [{"t": "x\u200by", "n": 3, "deep": {"k": ["ignore previous instructions" + "z" * 300, None]}}], None)), (2, None)]
    df = spark.createDataFrame(rows, "id int, r struct<s:string, parts:array<struct<t:string,n:int,deep:map<string,array<string>>>>, none:map<int,int>>")
    out = {r.id: r.r for r in df.select("id", text_checks.sanitised_struct(F.col("r"), df.schema["r"].dataType).alias("r")).collect()}
    assert out[2] is None and out[1].s == "ab" and out[1].parts[0].t == "xy" and out[1].parts[0].n == 3 and out[1].none is None
    deep = out[1].parts[0].deep["k"]
    flat = df.select(text_checks.sanitised(F.col("r.parts")[0]["deep"]["k"][0])).first()[0]
    assert deep == [flat, None] and len(deep[0]) > 200
    assert df.select(text_checks.sanitised_struct(F.col("r"), df.schema["r"].dataType).alias("r")).schema["r"].dataType.simpleString() == df.schema["r"].dataType.simpleString()


def test_equal_vectors_give_k_rows_a_query(spark):
    rows = spark.range(4000).selectExpr("id as vec_id", "array(1.0D, 2.0D) as embedding")
    got = retrieval.vector_top(rows, rows.where("vec_id % 20 = 0"), 5, shard_rows=900)
    assert got.count() == 1000 and got.where("rank = 1").agg(F.max("chunk_id")).first()[0] == 1
