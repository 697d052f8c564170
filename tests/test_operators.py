import datetime
import difflib
import hashlib
import os
import random
import re
import statistics
import zipfile
from itertools import pairwise
from xml.etree import ElementTree

import numpy as np
import pytest
from pyspark.sql import functions as F

from caselight import plans
from caselight.functions import text
from caselight.operators import aggregates, events, evidence, fusion, graph, joins, quality, tables, vectors, windows
from caselight.sources import readers, sinks

DAY = datetime.datetime


def test_interval_link(spark):
    v = spark.createDataFrame([("p", "v1", DAY(2024, 3, 1, 10), DAY(2024, 3, 2, 8)), ("p", "v2", DAY(2024, 4, 1), None), ("q", "a", DAY(2024, 3, 1), DAY(2024, 3, 5)), ("q", "b", DAY(2024, 3, 3), DAY(2024, 3, 9))], "patient string, visit string, adm timestamp_ntz, dis timestamp_ntz")
    i = spark.createDataFrame([(1, "p", DAY(2024, 3, 2)), (2, "p", DAY(2024, 4, 2)), (3, "q", DAY(2024, 3, 4)), (4, "none", DAY(2024, 3, 4))], "id int, patient string, d timestamp_ntz")
    got = {r.id: (r.status, r.visit) for r in joins.interval_link(i, v, "id", "patient", "d", "visit", "adm", "dis").collect()}
    assert got == {1: ("matched", "v1"), 2: ("no_visit_on_study_date", None), 3: ("ambiguous", None), 4: ("no_visit_on_study_date", None)}


def brute_votes(lists, top):
    held = {}
    for source, rows in lists.items():
        low, high = min(s for _, _, s in rows), max(s for _, _, s in rows)
        for c, r, s in rows:
            held.setdefault(c, []).append((r, (s - low) / (high - low) if high > low else 0.5))
    scored = [(-len(v), sum(r for r, _ in v) / len(v) if len(v) > 1 else -v[0][1], c) for c, v in held.items()]
    return [c for _, _, c in sorted(scored)][:top]


@pytest.mark.parametrize("seed", range(4))
def test_vote_against_brute_force(spark, seed):
    r = random.Random(seed)
    lists = {}
    for source in "abcd"[: 2 + seed % 3]:
        names = r.sample([f"c{i:03d}" for i in range(45)], 20)
        scores = sorted((r.choice([0.1, 0.2, 0.3, 0.4, 0.5, 0.9]) for _ in names), reverse=True) if seed else [0.7] * 20
        lists[source] = [(c, i + 1, s) for i, (c, s) in enumerate(zip(names, scores, strict=True))]
    frames = {k: spark.createDataFrame([("q", *x) for x in v], "query_id string, candidate_id string, rank int, score double") for k, v in lists.items()}
    got = fusion.vote(frames).orderBy("rank").collect()
    assert [x.candidate_id for x in got] == brute_votes(lists, 20) and [x.rank for x in got] == list(range(1, 21))


def test_faulty_lists(spark):
    def faults(rows, size=3):
        df = spark.createDataFrame([("q", c, r, s) for c, r, s in rows], "query_id string, candidate_id string, rank int, score double")
        return {r.reason for r in fusion.list_violations(df, size).collect()}

    good = [("a", 1, 0.9), ("b", 2, 0.5), ("c", 3, 0.5)]
    assert faults(good) == set() and faults(good[:2]) == {"size", "ranks"}
    assert faults([("q", 1, 0.9), *good[1:]]) == {"self"} and faults([("b", 1, 0.9), *good[1:]]) == {"repeated"}
    assert faults([("a", 1, 0.4), *good[1:]]) == {"rising"} and faults([("a", 1, None), *good[1:]]) == {"not_finite"} and faults([("a", 0, 0.9), *good[1:]]) == {"ranks"}


def test_min_max_constant(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 0.5)], "k int, s double")
    assert [r.normalised for r in windows.min_max(df, ["k"], "s").collect()] == [0.5, 0.5]


def test_group_tail_against_brute_force(spark):
    r = random.Random(3)
    rows = [(r.choice("pqr"), r.choice([1.0, 1.5, 2.0, 3.25, 4.0, 8.0, 9.5]) if r.random() < 0.7 else None, r.choice([0.5, 1.5, 2.0, 3.0, 9.5, 20.0]) if r.random() < 0.3 else None) for _ in range(120)]
    df = spark.createDataFrame(rows, "k string, x double, b double")
    want = {}
    for k, _, b in rows:
        above = [x - b for k2, x, _ in rows if k2 == k and b is not None and x is not None and x > b]
        if above:
            want[k, b] = statistics.median(above)
    got = {(x.k, x.bound): x.tail for x in aggregates.group_tail_median(df, ["k"], "x", "b").collect()}
    assert got == pytest.approx(want) and set(got) == set(want)


def test_right_censored_proxies(spark):
    rows = [("a", "sodium", ">= 150", "mM"), ("b", "Sodium", "151", "mm"), ("c", "sodium", "2 x 10^2 mM", None), ("d", "sodium", "170", "g"), ("e", "sodium", "150", "mM"), ("f", "iron", ">40", "u"), ("g", "iron", "30-50", "u"), ("h", "sodium", "> 150", "g"), ("i", "sodium", "< 8", "g")]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "visit string, name string, result string, unit string, source_row long").withColumn("time", F.lit(None).cast("timestamp_ntz"))
    out = tables.assign_tail_proxies(tables.build_observations(df, None, "visit", "name", "result", "time", unit="unit"))
    got = {r.visit_id: (r.value_proxy, r.proxy_method) for r in out.collect()}
    assert got["a"] == (150 + (1 + 50) / 2, "threshold_plus_group_tail_median") and got["h"] == (170.0, "threshold_plus_group_tail_median")
    assert got["f"] == (40.0, "lower_bound_fallback") and got["i"] == (4.0, "half_upper_bound_nonnegative") and got["e"] == (150.0, "exact_value")


def test_node_buckets(spark):
    df = spark.createDataFrame([("v", "m", 1.0, 1.0), ("v", "m", 25.0, 2.0), ("v", "m", 26.0, 4.0)], "visit string, token string, hours double, q double")
    nodes = graph.node_events(df, "visit", F.col("token"), "hours", None, "q", 24).orderBy("bucket")
    assert [(r.n, r.quantity) for r in nodes.collect()] == [(1, 1.0), (2, 6.0)]
    chains = graph.temporal_chains(graph.indexed(nodes, "visit", ["bucket"]), "visit", "token", ["bucket"])
    assert sorted((r.source, r.target, r.relation) for r in chains.collect()) == [(1, 2, "next"), (2, 1, "prev")]


def test_suffix_budget(spark):
    df = spark.createDataFrame([("p", i, c, d) for i, c, d in [(0, 3, True), (1, 5, False), (2, 4, False), (3, 2, False)]], "p string, t int, cost int, demo boolean")
    kept = windows.suffix_within_budget(df, ["p"], ["t"], "cost", 9, F.col("demo"))
    assert sorted(r.t for r in kept.collect()) == [0, 2, 3]


def test_cohort(spark):
    v = spark.createDataFrame([("p1", "v1"), ("p1", "v2"), ("p2", "v3")], "patient string, visit string")
    d = {k: spark.createDataFrame([("v1", "a"), ("v2", "b"), ("v3", "a")], "visit string, token string") for k in ("x", "y")}
    assert sorted(r.visit for r in graph.select_cohort(d, v, "visit", "patient", "token", {}, 2).collect()) == ["v1", "v2"]


def test_timelines(spark):
    v = spark.createDataFrame([("v1", "p", DAY(2024, 1, 1), DAY(2024, 1, 2)), ("v2", "p", DAY(2024, 2, 1), DAY(2024, 2, 2))], "visit_id string, patient_id string, admission_time timestamp_ntz, discharge_time timestamp_ntz")
    raw = spark.createDataFrame([("p", "v1", DAY(2024, 1, 1), "A"), ("p", "v2", DAY(2024, 2, 1), "B"), ("p", "v2", DAY(2024, 3, 1), "LATE")], "p string, v string, t timestamp_ntz, c string")
    ev = events.build_events([events.project(raw, "diagnoses", "p", "v", "t", F.col("c"))])
    goals = events.targets(v, ev)
    codes = lambda mode: sorted(r.code for r in events.timelines(ev, goals, mode).where("target_visit_id = 'v2'").collect())
    assert codes("history") == ["A", "B"] and codes("visit_only") == ["B"]
    assert {r.code: r.temporal_status for r in events.place(ev, v).collect()} == {"A": "within_visit", "B": "within_visit", "LATE": "after_discharge"}


def test_cosine(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None), (6, [3.0, 0.0])], "id long, v array<double>")
    top = vectors.topk_cosine(df.where("id = 1"), df, "id", "v", 2).orderBy("rank")
    assert [(r.candidate_id, r.score) for r in top.collect()] == [(2, 1.0), (6, 1.0)]
    assert vectors.topk_cosine(df.where("id = 4"), df, "id", "v", 2).count() == 0
    assert abs(vectors.matrix_statistics(df, "v").first().effective_rank - 1.2) < 0.2


def test_shared_terms(spark):
    rows = [
        ("Lý do", "đau ngực trái lan vai", " lý DO", "lan vai và đau ngực"), ("Lý do", "đau ngực", "Tiền sử", "đau ngực"), ("t", "alpha beta", "t", "beta gamma"), ("t", "one two x", "t", "two one"),
        ("t", "the patient normal", "t", "the patient normal"), ("t", " ".join(f"w{i:02d}" for i in range(20)), "t", " ".join(f"w{i:02d}" for i in range(20))), ("t", None, "t", "a b"),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, lt string, l string, rt string, r string")
    df = df.select("i", "lt", "rt", evidence.terms_of(F.col("l")).alias("a"), evidence.terms_of(F.col("r")).alias("b"))
    got = {r.i: r for r in evidence.shared_terms(df, "a", "b", "lt", "rt").collect()}
    assert set(got) == {0, 3, 5}
    assert (got[0].terms, got[0].phrases, got[0].score) == (["ngực", "lan", "vai", "đau"], ["đau ngực", "lan vai"], 3 + 4 + 6 + 6)
    assert (got[3].terms, got[3].phrases, got[3].score) == (["one", "two"], [], 5)
    assert len(got[5].terms) == 8 and got[5].phrases == [f"w{i:02d} w{i + 1:02d} w{i + 2:02d}" for i in range(4)] and got[5].score == 3 + 20 + 9 * 18 + 6 * 19


def brute_phrases(t, least, most, chars, content, generic, negators):
    out = []
    for run in re.finditer(r"\w+(?:\s+\w+)*", t):
        w = [(m.group().casefold(), run.start() + m.start(), run.start() + m.end()) for m in re.finditer(r"\w+", run.group())]
        for i in range(len(w)):
            for n in range(least, most + 1):
                part = w[i : i + n]
                if len(part) == n and sum(x not in generic and not x.isdigit() for x, _, _ in part) >= content and part[-1][2] - part[0][1] >= chars and not any(x in negators for x, _, _ in w[: i + n]):
                    out.append((" ".join(x for x, _, _ in part), part[0][1], part[-1][2]))
    return out


def test_phrase_spans(spark):
    texts = ["sốt cao kéo dài, không ho ra máu; đau  bụng\n12 34", "Viêm phổi nặng. chưa rõ", "a b", "", "(x) viêm-phổi thùy dưới phải điều trị ngoại trú lâu ngày rồi"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(9, None)], "i int, t string")
    for args in ((2, 6, 6, 2), (2, 3, 8, 1), (1, 2, 1, 1)):
        for no in ((), evidence.NEGATORS):
            got = {r.i: [tuple(x) for x in r.s] for r in df.select("i", evidence.phrase_spans(F.col("t"), *args, negators=no).alias("s")).collect()}
            want = {i: brute_phrases(t, *args, set(evidence.GENERIC), set(no)) for i, t in enumerate(texts)}
            assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in (want | {9: []}).items()}


def test_marked_evidence(spark):
    left, right = "J18.9 & viêm phổi thùy <dưới>, i10", "ho; I10 Viêm  phổi thùy trên"
    df = spark.createDataFrame([(left, right)], "l string, r string")
    for side in "lr":
        df = df.withColumn(f"icd_{side}", evidence.icd_spans(F.col(side))).withColumn(f"ph_{side}", evidence.phrase_spans(F.col(side), chars=8))
    spans = evidence.apart(F.concat(evidence.shared_spans(F.col("icd_l"), F.col("icd_r"), 0), evidence.shared_spans(F.col("ph_l"), F.col("ph_r"), 1)))
    row = df.select("icd_l", evidence.marked(F.col("l"), spans).alias("html"), evidence.marked(F.lit("a<b"), F.array().cast("array<struct<start:int,end:int,priority:int>>")).alias("none")).first()
    assert [(x.key, left[x.start : x.end]) for x in row.icd_l] == [("J18.9", "J18.9"), ("I10", "i10")]
    assert row.html == 'J18.9 &amp; <mark class="match-diagnosis">viêm phổi thùy</mark> &lt;dưới&gt;, <mark class="match-icd">i10</mark>' and row.none == "a&lt;b"
    spans = [(2, 0, 9), (1, 5, 7), (2, 10, 12), (0, 8, 11), (1, 1, 4), (1, 2, 6)]
    chosen = []
    for p, s, e in sorted(spans, key=lambda x: (x[0], x[1] - x[2], x[1])):
        if all(e <= s2 or s >= e2 for s2, e2 in chosen):
            chosen.append((s, e))
    df = spark.createDataFrame([([dict(zip(("priority", "start", "end"), x, strict=True)) for x in spans],)], "s array<struct<priority:int,start:int,end:int>>")
    assert [(x.start, x.end) for x in df.select(evidence.apart(F.col("s")).alias("x")).first().x] == sorted(chosen)


def test_quality(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "x int")
    assert quality.repeated_keys(a, ["x"]).collect()[0].n == 2
    assert quality.same_rows(a, a).count() == 0 and quality.same_rows(a, a.distinct()).count() == 1
    assert quality.orphans(a, a.where("x = 1"), "x").collect()[0].x == 2
    assert {r.check: r.n for r in quality.violations(a, {"small": F.col("x") < 2}).collect()} == {"small": 1}


def test_evidence_link(spark):
    e = spark.createDataFrame([("o1", "v1"), ("o2", "v1"), ("o2", "v2"), ("o3", "v9")], "k string, v string")
    keys = spark.createDataFrame([("o1",), ("o2",), ("o3",), ("o4",)], "k string")
    c = spark.createDataFrame([("v1",), ("v2",)], "v string")
    got = {r.k: (r.reason, r.v, r.candidates) for r in joins.evidence_link(keys, e, c, "k", "v").collect()}
    assert got == {"o1": ("linked", "v1", ["v1"]), "o2": ("ambiguous", None, ["v1", "v2"]), "o3": ("outside_cohort", None, ["v9"]), "o4": ("no_evidence", None, [])}


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([("=1+1", 1, "[0.5, 1]"), ("x", 2, None)], "name string, n int, embedding string")
    sinks.write_csv(df.select("name", "n"), f"{tmp_path}/out")
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("*.csv"))
    assert "'=1+1" in text
    assert [r.embedding for r in readers.embeddings(df, "n").orderBy("n").collect()] == [[0.5, 1.0], None]
    wide = spark.createDataFrame([(1, 0.25, 0.75)], "id int, embedding_1 double, embedding_0 double")
    assert readers.embeddings(wide, "id").first().embedding == [0.75, 0.25]
    sinks.write_missing(df.select("name", "n"), f"{tmp_path}/shards", "n", spark)
    sinks.write_missing(df.select("name", "n"), f"{tmp_path}/shards", "n", spark)
    assert spark.read.parquet(f"{tmp_path}/shards").count() == 2
    assert sinks.safe_name("Bệnh án (1)") == "benh_an_1"


def test_checked_join(spark):
    import pytest

    left, right = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(Exception, match="repeated key"):
        joins.checked(left, right, ["k"]).collect()
    out = joins.checked(left, right.where("v = 'a'"), ["k"], matched="m").orderBy("k").collect()
    assert [(r.v, r.m) for r in out] == [("a", True), (None, False)]


def test_allocate():
    out = windows.allocate([("a", 5), ("b", 3), ("c", 3)], ["r1", "r2"])
    assert out == {"a": "r1", "b": "r2", "c": "r2"}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables")
def test_shared_labs_of_every_next_user(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "event_type", "ts", "value").collect()
    tests = {}
    for r in rows:
        tests.setdefault(r.user_id, {}).setdefault(r.event_type.strip().lower(), []).append((-r.ts.timestamp(), r.value))
    tests = {u: {n: [v for _, v in sorted(x)[:3]] for n, x in t.items()} for u, t in tests.items()}
    users = sorted(tests)
    want = sorted((a, b, n, tests[a][n], tests[b][n], any(v > 50 for v in tests[a][n]) and any(v > 50 for v in tests[b][n])) for a, b in pairwise(users) for n in tests[a].keys() & tests[b].keys())
    numbers = lambda x: [float(v) for v in x.split(";")]
    got = sorted((r.left, r.right, r.name, numbers(r.left_values), numbers(r.right_values), r.both_flagged) for r in plans.queries()["shared_labs_evidence"](spark, sf).collect())
    assert got == want and len({r[0] for r in got}) == len(users) - 1


def test_next_user_over_gaps(spark, tmp_path):
    ids = [0, 7, 999, 1000, 5001, 5002, 123456]
    df = spark.createDataFrame([(i, "A", "2026-01-01", 60.0) for i in ids], "user_id long, event_type string, ts string, value double")
    df.withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{tmp_path}/events.parquet")
    got = sorted((r.left, r.right) for r in plans.queries()["shared_labs_evidence"](spark, str(tmp_path)).collect())
    assert got == list(pairwise(ids))


@pytest.mark.parametrize("least", [0.8, 0.92, 0.5])
def test_close_names_against_brute_force(spark, least):
    names = ["cold rod", "old rod", "xabcdefghijklmno", "abcdefghijklmno", "Ünder pan", "nder pan", "red bolt", "red-bolt", "Red bolts", "blue bolt", "rod", "rid", "!!", "a"]
    names += [f"{c}{w}" for c in ("", "s", "th") for w in ("pring coil", "ring coils", "in washer large", "hin washer large")]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    keys = {r.v: r.k for r in df.select(text.clean(F.col("name")).alias("v"), text.entity_key(F.col("name")).alias("k")).distinct().collect()}
    want = set()
    for v in keys:
        for m in difflib.get_close_matches(v, sorted(keys), n=2, cutoff=least):
            if m != v and keys[m] != keys[v]:
                want.add((v, m, round(difflib.SequenceMatcher(None, v.casefold(), m.casefold()).ratio(), 9)))
    got = {(r.value, r.suggested, round(r.similarity, 9)) for r in tables.close_names(df, "name", least).collect()}
    assert got == want and want


def test_digests_count_repeats(spark):
    digest = lambda *x: quality.manifest({"t": spark.createDataFrame([(v, "s") for v in x], "x int, y string")}, {}).first().digest
    assert digest(1, 1, 2) != digest(3, 3, 2) and digest(1, 2, 1) == digest(2, 1, 1) != digest(1, 2) and digest() == "0:0"


def test_file_inventory(spark, tmp_path):
    for name, raw in (("a.bin", b"\x00\x01"), ("sub/b.txt", "é".encode()), ("sub/c", b"")):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(raw)
    found = quality.file_inventory(spark, f"{tmp_path}/in")
    rows = {r.path: (r.bytes, r.sha256) for r in found.collect()}
    assert rows == {"a.bin": (2, hashlib.sha256(b"\x00\x01").hexdigest()), "sub/b.txt": (2, hashlib.sha256("é".encode()).hexdigest()), "sub/c": (0, hashlib.sha256(b"").hexdigest())}
    assert quality.inventory_differences(found, found).count() == 0
    other = spark.createDataFrame([("a.bin", 2, "0"), ("sub/b.txt", *rows["sub/b.txt"]), ("new", 1, "1")], "path string, bytes long, sha256 string")
    assert {(r.path, r.reason) for r in quality.inventory_differences(found, other).collect()} == {("a.bin", "mismatch"), ("sub/c", "missing"), ("new", "extra")}
    moved = quality.relocated(spark.createDataFrame([("/old/x/y",), ("/older/z",)], "p string"), "p", "/old/", "/new")
    assert [r.p for r in moved.collect()] == ["/new/x/y", "/older/z"]


def test_one_to_one(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "profile int"), spark.createDataFrame([("x",), ("y",)], "raw string")
    pairs = lambda *x: joins.one_to_one(a, b, "profile", "raw", spark.createDataFrame(list(x), "profile int, raw string"))
    assert sorted(map(tuple, pairs((1, "y"), (2, "x")).collect())) == [(1, "y"), (2, "x")]
    for wrong in ([(1, "x")], [(1, "x"), (2, "x")], [(1, "x"), (1, "y")], [(1, "x"), (2, "y"), (3, "z")]):
        with pytest.raises(Exception, match="not one-to-one"):
            pairs(*wrong).collect()


def test_returned_and_code_only(spark):
    m = spark.createDataFrame([("v", "drug", None), ("v", "drug", " "), ("v", "drug", "allergy"), ("w", "drug", None)], "visit_id string, name string, why string")
    v = spark.createDataFrame([("v",)], "visit_id string")
    every = {(r.status, r.source_row_count) for r in tables.build_medicines(m, v, ["name"], return_reason="why").collect()}
    assert every == {("prescribed", 2), ("returned", 1)}
    assert [r.status for r in tables.build_medicines(m, v, ["name"], return_reason="why", include_returned=False).collect()] == ["prescribed"]
    d = spark.createDataFrame([("v", "J18"), ("v", " "), ("", "J18"), ("v", None), (None, "x")], "visit_id string, code string")
    assert [tuple(r) for r in tables.code_only(d).collect()] == [("v", "J18")]


def test_sheet_rows(spark, tmp_path):
    """source_row is the row of the sheet, also where it comes in several files."""
    (tmp_path / "s.csv").mkdir()
    for i in range(3):
        (tmp_path / "s.csv" / f"part-{i}.csv").write_text("a,b\n" + "".join(f"{10 * i + k},\"x\ny\"\n" for k in range(4)))
    df = readers.read_sheets(spark, str(tmp_path), ["s"])["s"]
    rows = {int(r.a): r.source_row for r in df.collect()}
    assert [rows[k] for k in sorted(rows)] == list(range(2, 14))


def test_workbook_file(spark, tmp_path):
    df = spark.createDataFrame([(1, "a<b & \u0001c", 0.5), (2, None, -3.0)], "n int, t string, x double")
    sinks.write_workbook({"One": df, "Two & more": df.limit(0)}, f"{tmp_path}/w.xlsx")
    with zipfile.ZipFile(tmp_path / "w.xlsx") as z:
        assert z.testzip() is None
        parts = {n: ElementTree.fromstring(z.read(n)) for n in z.namelist()}
    space = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    assert [x.get("name") for x in parts["xl/workbook.xml"].iterfind(".//m:sheet", space)] == ["One", "Two & more"]
    cells = {c.get("r"): "".join(c.itertext()) for c in parts["xl/worksheets/sheet1.xml"].iterfind(".//m:c", space)}
    assert cells == {"A1": "n", "B1": "t", "C1": "x", "A2": "1", "B2": "a<b & c", "C2": "0.5", "A3": "2", "C3": "-3.0"}
    with pytest.raises(Exception, match="exist"):
        sinks.write_workbook({"One": df}, f"{tmp_path}/w.xlsx")


def test_sheets_are_listed(spark, tmp_path):
    df = spark.createDataFrame([(1, "é")], "n int, t string")
    assert sinks.write_sheets({"Bệnh án": df, "B": df}, f"{tmp_path}/out") == {"Bệnh án": "benh_an", "B": "b"}
    lines = (tmp_path / "out" / "manifest.jsonl").read_text().splitlines()
    assert lines[0] == '{"columns": ["n", "t"], "file": "benh_an", "rows": 1, "sheet": "Bệnh án"}' and len(lines) == 2
    with pytest.raises(ValueError, match="collide"):
        sinks.write_sheets({"A b": df, "a_B": df}, f"{tmp_path}/other")


def test_arrays_and_calls_in_folders(spark, tmp_path):
    for name, a in (("p1/v1/CT/a.npy", np.arange(6.0).reshape(2, 3)), ("p1/v2/CT/b.npy", np.float32([0.5, -1.0]))):
        (tmp_path / name).parent.mkdir(parents=True)
        np.save(tmp_path / name, a)
    for name in ("r/calls/2.json", "r/calls/1.json", "r/calls/attempts.json", "r/other/3.json", "r/a/b/c/d/e/calls/4.json", "r/a/b/c/d/calls/5.json", "r/calls/6.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("{}")
    rows = {(r.patient, r.visit): (r.shape, r["values"]) for r in readers.read_arrays(spark, str(tmp_path), ("patient", "visit", "kind")).collect()}
    assert rows == {("p1", "v1"): ([2, 3], [0, 1, 2, 3, 4, 5]), ("p1", "v2"): ([2], [0.5, -1.0])}
    names = lambda **k: [r.path.rsplit("/", 1)[1] for r in readers.discover_calls(spark, f"{tmp_path}/r", **k).collect()]
    assert names() == ["5.json", "4.json", "1.json", "2.json"] and names(depth=2) == ["1.json", "2.json"] and names(most=1) == ["5.json"]


def test_numbers_in_csv_cells(spark):
    values = [-0.0, 0.0, -1.5, None, float("nan"), 1e7, -12345678.9, 0.0001, -0.00001, float("-inf"), 123456789012.55, 1e16, 1e-300]
    found = [r.c for r in spark.createDataFrame([(v,) for v in values], "v double").coalesce(1).select(sinks.csv_number(F.col("v")).alias("c")).collect()]
    assert found == [None if v is None else ("'" if v < 0 else "") + repr(v) for v in values]


def test_many_shards_take_few_tasks(spark, tmp_path):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        df = spark.range(200).withColumn("v", F.col("id") * 2)
        tracker = spark.sparkContext.statusTracker()
        spark.sparkContext.setJobGroup("shards", "shards")
        wrote = sinks.write_shards(df, f"{tmp_path}/s", "id", 5)
        stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("shards") for s in tracker.getJobInfo(j).stageIds]
        assert max(s.numTasks for s in stages if s) < 20
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    files = [f for d, _, names in os.walk(f"{tmp_path}/s") for f in names if f.endswith(".parquet")]
    assert len(files) == len(wrote) > 20 and spark.read.parquet(f"{tmp_path}/s").count() == 200
    assert sinks.write_shards(df, f"{tmp_path}/s", "id", 5) == []


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["concept_inventory", "artifact_checks", "sampled_graph_nodes", "build_medicines", "target_timelines", "build_diagnoses", "incidence_verified"])
def test_rows_are_dealt_to_tasks_that_are_not_merged(spark, name):
    assert "REPARTITION_BY_NUM" in plan(plans.queries()[name](spark, "/root/testdata/sf0.001"))


def test_inventory_counts_without_sorting_sums(spark):
    rows = [("a", 1, 1, "y"), ("a", 1, 1, "x"), ("a", None, 2, "z"), (None, 3, None, "w")]
    df = spark.createDataFrame(rows, "k string, v int, p int, e string")
    out = aggregates.concept_inventory(df, ["k"], "v", "p", "e", "e")
    assert {tuple(r) for r in out.collect()} == {("a", 3, 1, 2, "x"), (None, 1, 1, 0, "w")}
    assert not [line for line in plan(out).splitlines() if "SortAggregate" in line and "v#" in line]


def test_only_censored_rows_meet_tails(spark):
    rows = [("a", ">10", DAY(2024, 1, 1), 1), ("a", "12", DAY(2024, 1, 1), 2), ("a", "see note", DAY(2024, 1, 1), 3)]
    df = spark.createDataFrame(rows, "name string, result string, time timestamp, source_row int").withColumn("visit", F.lit(1))
    out = tables.assign_tail_proxies(tables.build_observations(df, None, "visit", "name", "result", "time"))
    assert out._jdf.queryExecution().optimizedPlan().nodeName() == "Union"
    assert {r.source_row: (r.value_proxy, r.proxy_method) for r in out.collect() if r.source_row < 3} == {1: (12.0, "threshold_plus_group_tail_median"), 2: (12.0, "exact_value")}
