"""Piece tables, suffix buckets and filter diagrams against brute force; the pipeline as a whole against a plain Python run."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings as hyp, strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from netquarry.llm import common, filter_audit, packing, piece_table, queries, suffix_dedup, tokens

from .test_training_data import ODD, SF, brute_classes, clashing, docs_of, documents, markov_spans, prose  # noqa: F401

# fill-in-middle ---------------------------------------------------------------------


def plain_fim(doc_id, text, rate=100, spm=50):
    t = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", t)
    n = len(units)
    h = hashlib.sha256(f"7:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, t
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(units[i:j]) for i, j in ((0, a), (a, b), (b, n)))
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < spm else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def test_fim_by_plain_strings_and_back(spark, documents):
    hand = ["\n", "\n\n", "a\n", "a\nb", "é\n\nü\n", "has <S> inside\nx", "<P>", "<P", "ends <\nS>\nM>\n<", "line\r\nline\r", "x" * 100_000 + "\n" + "ö" * 50_000, "\n" * 5000]
    rows = documents.unionByName(docs_of(spark, [(9000 + i, t, "en", "s", 0) for i, t in enumerate(hand * 3)] + ODD))
    got = piece_table.fill_in_middle(clashing(rows))
    want = Counter()
    for r in rows.collect():
        n, form, p, m, out = plain_fim(r.doc_id, r.text)
        want[r.doc_id, n, form, p, m, sha(out), sha(r.text or ""), out] += 1
    assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256, r.output) for r in got.collect()) == want
    assert {f for _, _, f, *_ in want} == {"plain", "psm", "spm"}
    assert Counter(map(tuple, piece_table.restored(got).collect())) == Counter((r.doc_id, r.text or "") for r in rows.collect())
    assert piece_table.fill_in_middle(docs_of(spark, [])).count() == 0


def test_rates_of_forms(spark):
    rows = docs_of(spark, [(i, "a\nb\nc", "en", "s", 0) for i in range(2000)])
    forms = Counter(r.form for r in piece_table.fill_in_middle(rows, settings=piece_table.FimSettings(rate=60, spm_rate=25)).select("form").collect())
    assert abs(forms["plain"] - 800) < 120 and abs(forms["spm"] - 300) < 90 and sum(forms.values()) == 2000


@given(st.lists(st.binary(max_size=6), min_size=1, max_size=5), st.integers(0, 40))
@hyp(max_examples=200, deadline=None)
def test_a_cut_splits_descriptors_and_copies_nothing(parts, at):
    table = [piece_table.Piece(memoryview(b), 0, len(b)) for b in parts]
    left, right = piece_table.cut(table, at)
    whole = b"".join(parts)
    assert piece_table.content(left) == whole[:at] and piece_table.content(right) == whole[at:]
    assert piece_table.digest(left + right) == sha(whole) and len(left) + len(right) <= len(table) + 1


@given(st.text(alphabet="<>PSM\na", max_size=30), st.integers(0, 50))
@hyp(max_examples=300, deadline=None)
def test_marks_at_the_borders_of_parts(text, doc_id):
    raw = np.frombuffer(text.encode(), np.uint8)
    n, form, table, p, m = piece_table.transformed(raw, doc_id, piece_table.FimSettings())
    assert (n, form, p, m, piece_table.content(table).decode()) == plain_fim(doc_id, text)
    assert piece_table.content(piece_table.restore(piece_table.content(table), form)).decode() == text


# suffix buckets -----------------------------------------------------------------------


def plain_removal(rows, length):
    low = {}
    ids = [2**63 - 1 if i is None else i for i, _ in rows]
    texts = [(t or "").encode() for _, t in rows]
    for i, b in zip(ids, texts):
        for p in range(len(b) - length + 1):
            low[b[p : p + length]] = min(i, low.get(b[p : p + length], i))
    out = []
    for (doc_id, _), i, b in zip(rows, ids, texts):
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if low[b[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        spans = [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(gone))]
        out.append((doc_id, len(b), tuple(spans), bytes(x for x, g in zip(b, gone) if not g)))
    return Counter(out)


def repeats(rng, n=150):
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    said = lambda k: " ".join(rng.choice(words) for _ in range(k))
    base, line, rows = [said(rng.randint(5, 120)) for _ in range(25)], said(9), []
    for i in range(n):
        text = rng.choice(base).split()
        kind = rng.random()
        if kind > 0.3:
            text[rng.randrange(len(text))] = "zz"
        if kind > 0.6:
            text = [said(rng.randint(1, 60)), line, said(rng.randint(1, 60))]  # a common line in texts of their own
        rows.append((rng.choice([i, i, i // 2]), " ".join(text)))
    rows += [(None, base[0]), (None, base[1]), (700, None), (701, ""), (702, "a" * 400), (703, "a" * 120), (-4, "ab" * 100), (704, "ba" * 200), (5, base[2]), (5, base[2]), (6, "x" * 49), (7, "x" * 49), (8, "y" * 50), (9, "y" * 50)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("chosen", [
    suffix_dedup.SuffixSettings(), suffix_dedup.SuffixSettings(chunk_bytes=3000, group_bytes=500, hot_items=4), suffix_dedup.SuffixSettings(length=20, chunk_bytes=2000, group_bytes=3000, hot_items=6),
    suffix_dedup.SuffixSettings(length=16, chunk_bytes=5000, group_bytes=900),
])
def test_removed_bytes_by_brute_force(spark, chosen):
    rows = repeats(random.Random(5))
    given_ = clashing(docs_of(spark, [(i, t, "en", "s", 0) for i, t in rows]).repartition(5))
    got = Counter((r.doc_id, r.n_bytes, tuple(map(tuple, r.spans)), bytes(r.kept)) for r in suffix_dedup.remove_repeats(given_, settings=chosen).collect())
    assert got == plain_removal(rows, chosen.length)


def test_removal_of_all_documents_of_a_table(spark, documents):
    rows = documents.select("doc_id", "text").collect()
    got = Counter(map(tuple, queries.op12_suffix_dedup(spark, SF).collect()))
    assert got == Counter((i, n, sum(b - a for a, b in spans), len(spans), sha(kept)) for i, n, spans, kept in plain_removal([(r.doc_id, r.text) for r in rows], 50).elements())


def test_removal_of_odd_rows(spark):
    out = suffix_dedup.remove_repeats(docs_of(spark, ODD)).collect()
    assert Counter((r.doc_id, bytes(r.kept).decode()) for r in out) == Counter((r[0], r[1] or "") for r in ODD)
    assert suffix_dedup.remove_repeats(docs_of(spark, [])).count() == 0
    long = "".join(random.Random(1).choice("abcdefghij \n") for _ in range(3_000_000))
    two = suffix_dedup.removal_report(suffix_dedup.remove_repeats(docs_of(spark, [(1, long, "en", "s", 0), (2, long[1_000_000:2_000_000] + "!" + long[:49], "en", "s", 0)]))).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in two} == {1: (3_000_000, 0, 0), 2: (1_000_050, 1_000_000, 1)}
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(docs_of(spark, ODD), settings=suffix_dedup.SuffixSettings(length=8))


def test_refined_buckets_are_those_of_the_strings():
    rng = np.random.default_rng(3)
    for _ in range(40):
        ends = np.cumsum(rng.integers(0, 60, 20))
        text, depth = rng.integers(97, 99, ends[-1]).astype(np.uint8), int(rng.integers(5, 40))
        bucket, strings = suffix_dedup.refined(text, ends, depth), {}
        for i in range(len(text)):
            whole = i + depth <= ends[np.searchsorted(ends, i, side="right")]
            strings.setdefault(text[i : i + depth].tobytes() if whole else i, []).append(int(bucket[i]))
        assert all(len(set(v)) == 1 and (len(v) > 1) == (v[0] >= 0) for v in strings.values())
        names = [v[0] for v in strings.values() if v[0] >= 0]
        assert len(names) == len(set(names))


# filter diagrams ----------------------------------------------------------------------


@pytest.mark.parametrize("k", [1, 2, 3, 4, 5])
def test_every_order_is_visited_once_and_counted_right(k):
    rng, letters = np.random.default_rng(k), "ABCDE"[:k]
    counts = rng.integers(0, 6, (1 << k, 3)) * rng.integers(0, 2, (1 << k, 1))
    rows = filter_audit.audit_steps(counts, letters)
    assert sorted({r[0] for r in rows}) == sorted("".join(p) for p in itertools.permutations(letters)) and len(rows) == k * math.factorial(k)
    for order, step, i, kept, removed, redundant, alone, good, toxic, shapley in rows:
        left = [m for m in range(1 << k) if not any(m >> letters.index(x) & 1 for x in order[: step - 1])]
        mine = [m for m in left if m >> i & 1]
        assert letters[i] == order[step - 1] and (removed, good, toxic) == tuple(counts[mine].sum(axis=0)) and kept == counts[left, 0].sum() - removed
        assert alone == counts[1 << i, 0] and redundant == sum(counts[m, 0] for m in range(1 << k) if m >> i & 1) - removed
        assert shapley == sum(r[4] for r in rows if r[2] == i)


def test_a_swap_shares_equal_nodes():
    diagram = filter_audit.Diagram(np.ones((32, 3), np.int64))
    for level in filter_audit.neighbour_swaps(5):
        diagram.swap(level)
        assert all(len(known) == 1 for known in diagram._known)  # equal counts everywhere: one node a level


def plain_audit(rows, labels):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    texts = [t or "" for _, t, _ in rows]
    ids = [math.inf if i is None else i for i, _, _ in rows]
    first = {}
    for i, t in zip(ids, texts):
        first[t] = min(first.get(t, i), i)
    fails, parts = [], [s or "" for *_, s in rows]
    for i, t in zip(ids, texts):
        w = words(t)
        f = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), bool(re.search(r"[#$%&*|]", t)), first[t] < i]
        fails.append({x for x, y in zip("ABCDE", f) if y})
    good, toxic = ({d for d, q, x in labels if d is not None and (q, x)[k] == 1} for k in (0, 1))
    out, taken = [], Counter()
    for part in set(parts):
        own = [(i, f) for (i, _, _), f, p in zip(rows, fails, parts) if p == part]
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, x in enumerate(order, 1):
                gone = [d for d in left if x in d[1]]
                left = [d for d in left if x not in d[1]]
                taken[part, x] += len(gone)
                out.append((part, "".join(order), step, x, len(left), len(gone), sum(x in f for _, f in own) - len(gone), sum(f == {x} for _, f in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)))
    return Counter((*r, taken[r[0], r[3]]) for r in out)


def test_audit_by_brute_force(spark):
    rng, rows = random.Random(4), []
    for i in range(60):
        text = " ".join(prose(rng, rng.choice([3, 150, 250]), rng.choice([20, 400]))) + rng.choice(["", " #", " ABC" * 40])
        rows += [(i * 10 + k, text, rng.choice(["en", None]), rng.choice(["a", "b", "", None]), 0) for k in range(rng.choice([1, 1, 3]))]
    rows += [*ODD, (0, rows[0][1], "en", "a", 0), (None, rows[0][1], "en", "b", 0), (None, rows[3][1], "en", "b", 0)]
    labels = [(i * 10, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(60)] + [(0, 1, 0), (0, 0, 1), (None, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("mask", F.lit("x"))
    got = Counter(map(tuple, filter_audit.filter_audit(clashing(docs_of(spark, rows)).withColumns({"part": F.lit(1), "digest": F.lit(2)}), table).collect()))
    assert got == plain_audit([(i, t, s) for i, t, _, s, _ in rows], labels)
    assert filter_audit.filter_audit(docs_of(spark, []), table).count() == 0


# pipeline -----------------------------------------------------------------------------


def test_pipeline_by_a_plain_run(spark):
    con = duckdb.connect()
    con.execute(f"create view labels as select * from '{SF}/labels.parquet'")
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]

    def by_sql(sql):
        table = docs_of(spark, [(*r, 0) for r in rows]).toPandas()
        con.register("documents", table)
        return {r["doc_id"]: r for r in con.execute(sql).df().to_dict("records")}

    kept = by_sql(queries.OP9_SQL)
    rows = [r for r in rows if kept[r[0]]["kept"]]
    first = {min(g, key=lambda i: rows[i][0]) for g in brute_classes([(r[0], r[1]) for r in rows])}
    rows = [r for i, r in enumerate(rows) if i in first]
    clean = []
    for r, spans in zip(rows, markov_spans([r[1] for r in rows])):
        marked, covered = list(r[1] or ""), [False] * len(r[1] or "")
        for a, b in (map(int, x.split(":")[1:]) for x in spans.split(",") if x):
            covered[a:b] = [True] * (b - a)
        cuts = [tuple(map(int, x.split(":")[1:])) for x in spans.split(",") if x]
        starts = {a for a, b in cuts if not any(c < a < d for c, d in cuts)}
        text = "".join("[SECRET]" * (i in starts) + ("" if covered[i] else c) for i, c in enumerate(marked))
        clean.append((r[0], text, *r[2:]))
    rows = clean
    mix = by_sql(queries.OP6_SQL)
    texts = []
    for doc_id, text, *_ in rows:
        ends = [m.end() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
        if ends:
            whole, part = divmod(int(mix[doc_id]["taken"]), len(ends))
            texts += [(doc_id, text)] * whole + [(doc_id, text[: ends[part - 1]])] * (part > 0)
    want = Counter()
    for doc_id, text in texts:
        ids, at = tokens.encode(text, tokens.vocabulary_path(), 1), 0
        for n in packing.piece_lengths(len(ids), 2048):
            want[doc_id, at, n, zlib.crc32(ids[at : at + n].tobytes()), len(ids)] += 1
            at += n
    got = corpus_pipeline.run(spark, SF).select("doc_id", "start", "length", "ids_crc32", "doc_tokens").collect()
    assert Counter(map(tuple, got)) == want and len(got) > 500


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls, empty texts, repeated rows and an empty table pass through every stage."""
    rng = random.Random(9)
    clean = [(i, ". ".join(" ".join(prose(rng, 9)) for _ in range(12)), "en", "s", 0) for i in (None, None, 3, 4)]
    for rows in (ODD + clean + clean[2:], ODD, []):
        docs = docs_of(spark, rows)
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = common.materialize(stage(spark, docs, SF), "odd-stage")
            assert k == 4 or docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert {r.doc_id for r in docs.select("doc_id").collect()} == ({None, 3, 4} if len(rows) > len(ODD) else set())  # the others are too short or repeat themselves
