"""Mismatched nulls, weighted removal, audits, packed parts, proposed pairs, model output and the changed quantiles, against brute force."""

import collections
import json
import math
import random
import tracemalloc
import types

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from caselight.functions import text
from caselight.operators import aggregates, events, evidence, fusion, graph, quality, vectors, windows
from caselight.plans import retrieval


@pytest.mark.parametrize("n", [0, 1, 2, 37])
def test_mismatched_has_no_fixed_point(spark, n):
    rows = {r.id: r.other for r in vectors.mismatched(spark.range(n).withColumnRenamed("id", "k"), "k", 3).collect()}
    assert len(rows) == (n if n > 1 else 0) and sorted(rows) == sorted(rows.values()) and all(a != b for a, b in rows.items())


def test_ranks_of_partners_and_blocks(spark, monkeypatch):
    r = np.random.default_rng(5)
    x = r.normal(size=(60, 8))
    df = spark.createDataFrame([(i, v.tolist(), (v + r.normal(size=8)).tolist()) for i, v in enumerate(x)], "k long, a array<double>, b array<double>")
    partners = vectors.mismatched(df, "k", 1)
    a, b = (np.array([row[c] for row in df.orderBy("k").collect()]) for c in ("a", "b"))
    s = np.round(a @ b.T, 9)
    other = dict(map(tuple, partners.collect()))
    for size in (32_000_000, 3000):  # one block, then several
        monkeypatch.setattr(vectors, "QUERY_BLOCK_BYTES", size)
        own = {q.query_id: q.rank for q in vectors.ranks_of_own(df, df, "k", "a", "b").collect()}
        null = {q.query_id: q.rank for q in vectors.ranks_of_own(df, df, "k", "a", "b", partners=partners).collect()}
        assert own == {i: 1 + int((s[i] > s[i, i]).sum()) for i in range(60)}
        assert null == {i: 1 + int((s[i] > s[i, other[i]]).sum()) for i in range(60)}
        top = {(t.query_id, t.rank): t.candidate_id for t in vectors.topk_cosine(df, df, "k", "a", 3).collect()}
        u = a / np.linalg.norm(a, axis=1, keepdims=True)
        c = u @ u.T - 2 * np.eye(60)
        assert top == {(i, j + 1): int(np.argsort(-c[i], kind="stable")[j]) for i in range(60) for j in range(3)}
    ranks = spark.createDataFrame([(i, v) for i, v in own.items()], "query_id long, rank long")
    m = fusion.rank_metrics(ranks).first()
    assert m.median_rank == float(np.median(list(own.values()))) and m.recall_at_5 == pytest.approx(np.mean([v <= 5 for v in own.values()]))


def test_topk_of_copies_goes_by_id(spark):
    r = np.random.default_rng(2)
    base = r.normal(size=(17, 64))
    rows = [(i, "abc"[i % 3], base[i % 17].tolist()) for i in range(1003)] + [(None, "d", base[0].tolist())]
    df = spark.createDataFrame(rows, "k long, label string, a array<double>").repartition(2, "k")
    x = np.array([v for i, _, v in rows if i is not None])
    u = x / np.sqrt(np.add.accumulate(x * x, axis=1)[:, -1:])
    s = np.array([np.add.accumulate(v * u, axis=1)[:, -1] for v in u])  # added from the left, as SQL does
    ids = np.arange(len(u))
    for exclude in (None, "label"):
        apart = ids[:, None] != ids if exclude is None else ids[:, None] % 3 != ids % 3
        want = {(i, n + 1): int(j) for i in ids.tolist() for n, j in enumerate(np.lexsort((ids, np.where(apart[i], -s[i], np.inf)))[:5])}
        top = vectors.topk_cosine(df.where("k IS NOT NULL"), df, "k", "a", 5, exclude=exclude).collect()
        assert {(t.query_id, t.rank): t.candidate_id for t in top} == want


def test_topk_by_label_without_unknown_labels(spark, tmp_path):
    r = np.random.default_rng(4)
    rows = [(i, None if i % 7 == 0 and i != 700 else i % 3, r.normal(size=4).tolist()) for i in range(0, 1000, 5)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    top = retrieval.topk_cosine_label_excluded(spark, str(tmp_path)).collect()
    label = {i: x for i, x, _ in rows}
    assert {t.query_id for t in top} == set(range(100, 1000, 100)) and len(top) == 90
    assert all(label[t.candidate_id] not in (None, label[t.query_id]) for t in top)


def test_topk_in_tiles(monkeypatch):
    r = np.random.default_rng(3)
    x = r.integers(-2, 3, size=(40, 3)).astype(float)
    ids, labels = [f"r{i:02d}" for i in range(40)], [None if i % 7 == 0 else "abc"[i % 3] for i in range(40)]
    held = types.SimpleNamespace(value={"id": pa.array(ids[:11]), "x": pa.array(labels[:11]), "v": x[:11]})
    batches = [pa.RecordBatch.from_arrays([pa.array(ids[a:b]), pa.array(labels[a:b], pa.string()), pa.array(x[a:b].tolist())], names=["id", "x", "v"]) for a, b in ((0, 16), (16, 16), (16, 17), (17, 40))]
    apart = lambda i, j: i != j and (labels[i] is None or labels[i] != labels[j])
    want = {i: sorted((-float(x[i] @ x[j]), ids[j]) for j in range(40) if apart(i, j))[:4] for i in range(11)}
    for scores, queries in ((1, 1), (7, 3), (30, 20), (500_000, 1000)):
        monkeypatch.setattr(vectors, "SCORES", scores)
        monkeypatch.setattr(vectors, "TILE_QUERIES", queries)
        assert max((a.stop - a.start) * (b.stop - b.start) for a, b in vectors._tiles(11, 40)) <= scores
        got = [t for batch in vectors._local_topk(held, 4)(iter(batches)) for t in batch.to_pylist()]
        assert {i: sorted((-t["score"], t["candidate_id"]) for t in got if t["query_id"] == ids[i]) for i in range(11)} == want


def test_topk_holds_few_scores(spark, monkeypatch):
    peak, local = spark.sparkContext.accumulator(0), vectors._local_topk

    def traced(held, k):
        work = local(held, k)

        def run(batches):
            tracemalloc.start()
            yield from work(batches)
            peak.add(tracemalloc.get_traced_memory()[1])
            tracemalloc.stop()

        return run

    monkeypatch.setattr(vectors, "_local_topk", traced)
    a = F.array(*(F.randn(i) for i in range(8)))
    df = spark.range(0, 6000, 1, 1).select(F.col("id").alias("k"), (F.col("id") % 10).alias("label"), a.alias("a"))
    assert vectors.topk_cosine(df.where("k < 3000"), df, "k", "a", 5, exclude="label").count() == 15_000
    assert 0 < peak.value < 50_000_000


def test_gram_of_several_lengths(spark):
    rows = [[1.0, 2.0, 3.0], [0.5, -1.0], [2.0, 0.0, 1.0], None, [float("nan"), 1.0]]
    got = {(r.i, r.j): r.g for r in vectors.gram(spark.createDataFrame([(v,) for v in rows], "v array<double>").repartition(3), "v").collect()}
    x = np.array([[1, 2, 3], [0.5, -1, 0], [2, 0, 1]])
    assert got == {(i, j): pytest.approx((x.T @ x)[i, j]) for i in range(3) for j in range(i, 3)}


def test_quantiles_by_weight_read_their_input_once(spark):
    seen = spark.sparkContext.accumulator(0)
    r = random.Random(1)
    values = [(g, r.randint(0, 20), r.randint(1, 4)) for g in "ab" for _ in range(50)]
    df = spark.createDataFrame(values, "g string, v int, w int").rdd.map(lambda x: (seen.add(1), x)[1]).toDF("g string, v int, w int")
    got = {q.g: (q.m, q.p) for q in aggregates.exact_quantiles(df, ["g"], "v", {"m": 0.5}, {"p": 0.9}, weight="w").collect()}
    for g in "ab":
        every = sorted(v for k, v, w in values if k == g for _ in range(w))
        assert got[g] == (float(np.quantile(every, 0.5)), float(every[math.ceil(len(every) * 0.9) - 1]))
    assert seen.value == len(values)


def test_evenly_spaced_against_brute_force(spark):
    rows = [(k, i) for k, n in (("a", 1), ("b", 4), ("c", 23), (None, 7)) for i in range(n)]
    got = sorted(map(tuple, windows.evenly_spaced(spark.createDataFrame(rows, "k string, i int").repartition(4), ["k"], ["i"], 5).collect()), key=str)
    want = []
    for k in ("a", "b", "c", None):
        n = sum(x == k for x, _ in rows)
        want += [(k, i) for i in range(n) if i == 0 or i * 5 // n != (i - 1) * 5 // n]
    assert got == sorted(want, key=str)


def test_weighted_removal_bounds_and_chances(spark):
    nodes = [(g, kind, f"{kind}{i}", w) for g in range(300) for kind, n in (("core", 4), ("core2", 1), ("free", 1), ("many", 10)) for i, w in zip(range(n), [1.0, 8.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 0.0, 1.0], strict=False)]
    df = spark.createDataFrame(nodes, "g int, kind string, node string, w double")
    out = graph.weighted_removal(df, "g", "kind", "node", "w", 0.5, 9, ["core", "core2"])
    count = collections.Counter((r.g, r.kind) for r in out.collect())
    assert {k: {count[g, k] for g in range(300)} for k in ("core", "core2", "free", "many")} == {"core": {2}, "core2": {0}, "free": {1}, "many": {5}}
    drawn = collections.Counter(r.node for r in out.collect() if r.kind == "many")
    assert drawn["many1"] > 280 and drawn["many8"] < 5 and 90 < drawn["many0"] < 190
    assert graph.weighted_removal(df, "g", "kind", "node", "w", 0.99, 9, ["core"]).where("kind = 'core'").count() == 900
    assert graph.weighted_removal(df, "g", "kind", "node", "w", 0.0, 9, []).count() == 0
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, graph.weighted_removal(df.repartition(7), "g", "kind", "node", "w", 0.5, 9, ["core", "core2"]).collect()))


def test_permutation_keeps_values_within_their_keys(spark):
    df = spark.createDataFrame([(i % 3, i, None if i == 4 else f"v{i}") for i in range(20)], "k int, node int, v string")
    rows = graph.permuted(df, ["k"], "v", "node", 2).collect()
    for k in range(3):
        assert sorted((r.v for r in rows if r.k == k), key=str) == sorted((r.v_permuted for r in rows if r.k == k), key=str)
    assert all(r.v != r.v_permuted for r in rows)


def test_audits_come_from_the_pass_that_writes(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)
    rows = [("a", "within_visit", True, 1.0), ("b", "strange", False, None), ("zz", None, None, 2.0)]
    schema = "source_table string, temporal_status string, time_imputed boolean, numeric_value double"
    df = spark.createDataFrame(rows, schema).rdd.map(lambda x: (seen.add(1), x)[1]).toDF(schema).withColumn("time", F.lit("2024-01-02").cast("timestamp_ntz"))
    got = events.write_audited(df, str(tmp_path / "e"), events.audits(["a", "b"], ["within_visit"], F.when(F.col("source_table") == "a", "x")))
    assert seen.value == 3 and spark.read.parquet(str(tmp_path / "e")).count() == 3
    assert got == {"n_events": 3, "n_imputed": 1, "n_mapped": 1, "n_values": 2, "n_without_time": 0, "source:a": 1, "source:b": 1, "source:other": 1, "status:within_visit": 1, "status:other": 2, "first_day": 19724, "last_day": 19724}


@pytest.mark.parametrize("budget", [60, 200, 1000, 100_000])
def test_no_part_is_over_the_budget(spark, budget):
    r = random.Random(budget)
    rows = [(f"g{r.randint(0, 80)}", "é" * r.choice([0, 1, 5, 30, 90])) for _ in range(300)] + [(None, "x"), ("lone", None)]
    df = spark.createDataFrame(rows, "g string, t string").repartition(3)
    out = quality.packed_parts(df, "g", budget).collect()
    size = collections.Counter()
    for g, t in rows:
        size[g] += len(json.dumps({"g": g, "t": t}, ensure_ascii=False, separators=(",", ":")).encode()) + 1
    assert {x.g: x.bytes for x in out} == size
    parts, members = collections.Counter(), collections.Counter()
    for x in out:
        parts[x.part] += x.bytes
        members[x.part] += 1
    assert all(parts[x.part] <= budget or (x.over and members[x.part] == 1) for x in out) and {x.over for x in out if x.bytes <= budget} <= {False}
    small = [p for p in parts if p.startswith("small")]
    assert len(small) <= 2 * sum(parts[p] for p in small) / budget + 2


def test_proposed_pairs_are_all_that_share_enough(spark):
    r = random.Random(8)
    words = ["fever", "cough", "naïve", "chest", "pain", "left", "arm"]
    fields = [(f"p{p}", f, r.choice(["Title", " title ", "Other"]), " ".join(r.choice(words) for _ in range(r.randint(0, 5)))) for p in range(6) for f in range(4)]
    df = spark.createDataFrame(fields, "who string, f int, title string, t string").withColumn("own", evidence.terms_of(F.col("t"), ()))
    pairs = spark.createDataFrame([("p0", "p1"), ("p0", "p2"), ("p3", "p3"), ("p4", "nobody"), ("p0", "p1")], "left string, right string")
    got = {tuple(x) for x in evidence.proposed_pairs(pairs, "left", "right", df, "who", "f", "title", "own").select("left", "right", "left_field", "right_field").collect()}

    def enough(a, b):
        a, b = a.split(), b.split()
        grams = lambda w: {tuple(w[i : i + k]) for k in (2, 3) for i in range(len(w) - k + 1)}
        return len(set(a) & set(b)) >= 2 or bool(grams(a) & grams(b))

    want = {(p, q, x[1], y[1]) for p, q in {("p0", "p1"), ("p0", "p2"), ("p3", "p3")} for x in fields for y in fields if x[0] == p and y[0] == q and x[2].strip().lower() == y[2].strip().lower() and enough(x[3], y[3])}
    assert got == want and got


def call(*texts):
    return json.dumps({"response": {"candidates": [{"content": {"parts": [{"text": t} for t in texts]}}]}})


def test_model_output(spark):
    good = {"need": {"code": "A10", "why": 'says "{x}" ```'}, "ranking": [1, 2]}
    plain = json.dumps(good, ensure_ascii=False)
    cases = [
        (call(plain), None), (call(f"```json\n{plain}\n```"), None), (call(f"```\n{plain}\n```"), None), (call("", f"words before {plain} and after"), None), (call(json.dumps(plain)), None), (call(json.dumps(f"```json\n{plain}\n```")), None),
        (call("no object", plain), None), (call("{broken", "[1]"), "not json"), (call(""), "no text"), (call(), "no text"), ('{"response": {}}', "no text"), ('{"response": {"candidates": []}}', "no text"), ("{", "payload"), ("", "payload"), (None, "payload"),
        (call(json.dumps({"need": 1})), "missing ranking"), (call("{}"), "missing need,ranking"), (call(json.dumps({"need": None, "ranking": []})), None),
    ]
    df = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(cases)], "i int, p string").withColumn("o", text.model_output(F.col("p"), ["need", "ranking"]))
    got = {r.i: (r.error, r.code) for r in df.select("i", "o.error", F.try_variant_get("o.output", "$.need.code", "string").alias("code")).collect()}
    for i, (p, error) in enumerate(cases):
        assert got[i] == (error, "A10" if error is None and "A10" in (p or "") else None), (p, got[i])


def test_header_rows_like_single_lists(spark):
    rows = [["id", None, " id ", "N/A", "name", "id"], [], ["a  b", "a b", "NaN", "nan", "unnamed_column_3"]]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, h array<string>")
    got = {r.i: r.x for r in df.select("i", text.unique_header_row(F.col("h")).alias("x")).collect()}
    assert got == {i: text.unique_headers(r) for i, r in enumerate(rows)}


def test_visit_timelines_by_equality(spark):
    import datetime

    day = lambda d: d and datetime.datetime(2024, 1, d)
    e = spark.createDataFrame([(f"e{i}", "p", v, day(d), 0, "c", "s") for i, (v, d) in enumerate([("v1", 1), ("v2", 2), ("", 3), ("v1", 9), ("", None)])], "event_id string, patient_id string, visit_id string, time timestamp_ntz, priority int, code string, source_table string")
    t = spark.createDataFrame([("v1", "p", day(5)), ("v2", "p", day(2)), ("v3", "q", day(5))], "visit_id string, patient_id string, cutoff timestamp_ntz")
    got = {(r.target_visit_id, r.event_id, r.is_current) for r in events.timelines(e, t, "visit_only").collect()}
    assert got == {("v1", "e0", True), ("v1", "e2", False), ("v2", "e1", True)}


def test_proposed_pairs_broadcast_no_index(spark):
    from caselight.operators import evidence

    fields = spark.createDataFrame([(k, f, "t", f"w{k} common words stay") for k in range(3) for f in range(2)], "k int, f int, t string, text string").withColumn("own", evidence.terms_of(F.col("text")))
    pairs = spark.createDataFrame([(0, 1), (1, 2)], "left int, right int")
    out = evidence.proposed_pairs(pairs, "left", "right", fields, "k", "f", "t", "own")
    assert "BroadcastExchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 8


def test_reviews_broadcast_no_candidates(spark):
    from caselight.operators import quality

    reviews = spark.createDataFrame([(1, False), (2, True), (3, None), (4, False)], "review_id int, none_similar boolean")
    candidates = spark.createDataFrame([(r, c) for r in (1, 2, 3) for c in (1, 2)], "review_id int, candidate_id int")
    picked = spark.createDataFrame([(1, 1), (2, 2), (3, 9), (3, None), (9, 1)], "review_id int, candidate_id int")
    out = quality.review_violations(reviews, picked, candidates, size=2)
    assert "BroadcastExchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, out.collect())) == [(2, "none_with_selections"), (3, "not_a_candidate"), (4, "candidates"), (4, "selections")]


def test_spans_are_made_a_few_texts_at_a_time(spark):
    df = spark.createDataFrame([(1, "viêm phổi thùy I10")], "i int, t string").select(evidence.icd_spans(F.col("t")).alias("c"), evidence.phrase_spans(F.col("t")).alias("p"))
    planned = df._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in planned and "ArrowEvalPython" not in planned
    assert [tuple(x) for x in df.first().c] == [("I10", 15, 18)]


def test_header_rows_of_groups(spark):
    from caselight.operators import tables

    names = [" a  b", "A", None, "a b", "n/a", "a b", ""]
    df = spark.createDataFrame([(g, i, n) for g in (1, 2) for i, n in enumerate(names[g - 1 :])], "g int, i int, n string")
    out = tables.header_rows(df, ["g"], "i", "n")
    assert "collect_list" not in out._jdf.queryExecution().executedPlan().toString()
    for g in (1, 2):
        assert [r.header for r in out.where(F.col("g") == g).orderBy("place").collect()] == text.unique_headers(names[g - 1 :])
