"""Windows by length, commits, stages and verification, with planted failures."""

import datetime
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from caselight.operators import lengths, stages, verify
from caselight.sources.commits import ConflictError, Store

DAY = datetime.datetime(2024, 1, 1)
EVENTS = "patient_id string, visit_id string, time timestamp_ntz, priority int, event_id string, line string, always boolean"
TARGETS = "visit_id string, patient_id string, cutoff timestamp_ntz"


def ids_of(texts):
    """Numbers of ids of a byte-level BPE: lengths that don't add up over lines."""
    import public_tokenizers
    import tokenizers

    t = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]


def different_words(texts):
    return [len(set(t.split())) for t in texts]


def window(rows, target, length, limit):
    """The longest suffix that fits, by trying each."""
    visit, patient, cutoff = target
    always = [r[5] for r in sorted((r for r in rows if r[0] == patient and r[6]), key=lambda r: (r[3], r[4]))]
    mine = sorted((r for r in rows if r[0] == patient and not r[6] and r[2] is not None), key=lambda r: (r[2], r[3], r[4]))
    own = [r for r in mine if cutoff is not None and r[2] <= cutoff]
    text = lambda s: "\n".join([*always, *(r[5] for r in own[s:])])
    current = sum(r[1] == visit for r in own)
    for s in range(len(own) + (not own)):
        if (n := length([text(s)])[0]) <= limit:
            picked = own[s:]
            return visit, len(own), len(picked), current, sum(r[1] == visit for r in picked), s + 1 if picked else None, picked[0][2] if picked else None, n, True, hashlib.sha256(text(s).encode()).hexdigest()
    return visit, len(own), 0, current, 0, None, None, None, False, None


@pytest.mark.parametrize(("length", "limit", "held"), [(ids_of, 40, 4096), (ids_of, 9, 4096), (different_words, 9, 5), (different_words, 2, 4096), (ids_of, 100_000, 3)])
def test_windows_against_brute_force(spark, monkeypatch, length, limit, held):
    monkeypatch.setattr(lengths, "HELD", held)
    r = random.Random(limit + held)
    rows, goals = [], []
    for p in "abcde":
        rows += [(p, "", None, i, f"d{i}", f"born {p}", True) for i in range(r.randint(0, 2))]
        for i in range(r.choice([0, 1, 40, 120])):
            at = None if r.random() < 0.05 else DAY + datetime.timedelta(days=r.randint(0, 50))
            rows.append((p, f"{p}{r.randint(0, 5)}", at, r.randint(0, 2), f"e{i}", " ".join(r.choice(["fever", "naïve", "x1", "日本", "code:A10.1"]) for _ in range(r.randint(0, 4))), False))
        goals += [(f"{p}{i}", p, None if i == 5 else DAY + datetime.timedelta(days=10 * i)) for i in range(7)]
    goals.append(("lone", "nobody", DAY))
    events = spark.createDataFrame(rows, EVENTS).repartition(3)
    out = lengths.recent_windows(events, spark.createDataFrame(goals, TARGETS), F.col("line"), F.col("always"), length, limit)
    got = {x.target_visit_id: tuple(x) for x in out.collect()}
    assert got == {g[0]: window(rows, g, length, limit) for g in goals}


def test_lengths_of_null_texts_and_nothing(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, "")], "id int, text string")
    assert [tuple(r) for r in lengths.measured(df, "text", different_words, "n").orderBy("id").collect()] == [(1, "a b", 2), (2, None, None), (3, "", 0)]
    nothing = lengths.recent_windows(spark.createDataFrame([], EVENTS), spark.createDataFrame([], TARGETS), F.col("line"), F.col("always"), different_words, 3)
    assert nothing.count() == 0


def rows(spark, *r):
    return spark.createDataFrame(list(r), "key string, at int, value string")


def state(store, version=None):
    return {t: sorted(map(tuple, store.read(t, version).collect())) for t in ("latest", "history")}


def test_a_failed_commit_leaves_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.version() == 0 and not store.has("latest")
    with pytest.raises(KeyError):
        store.read("latest")
    assert store.upsert(rows(spark, ("a", 1, "x"), ("b", 1, "y")), "key", "at") == 1
    before = state(store)
    boom = F.udf(lambda v: 1 // 0, "int")
    with pytest.raises(Exception):  # noqa: B017
        store.commit({"latest": rows(spark, ("z", 9, "z"))}, {"history": rows(spark, ("z", 9, "z")).withColumn("at", boom("value"))})
    assert store.version() == 1 and state(store) == before and store.leftovers() == []
    assert store.upsert(rows(spark, ("a", 2, "new"), ("b", 0, "old"), ("c", 1, None)), "key", "at") == 2
    assert state(store)["latest"] == [("a", 2, "new"), ("b", 1, "y"), ("c", 1, None)] and len(state(store)["history"]) == 5
    assert state(store, 1) == before


def test_of_two_writers_one_fails(spark, tmp_path):
    store, other = Store(spark, str(tmp_path / "s")), Store(spark, str(tmp_path / "s"))
    one = rows(spark, ("a", 1, "x"))
    base = store.version()
    store.commit({"t": one}, base=base)
    with pytest.raises(ConflictError):
        other.commit({"t": one}, base=base)
    assert store.version() == 1 and store.read("t").count() == 1 and store.leftovers() == []
    with pytest.raises(ValueError, match="twice"):
        store.commit({"t": one}, {"t": one})
    (tmp_path / "s" / "data" / "killed").mkdir()
    assert store.leftovers() == ["killed"]


def doubled(t):
    return t.select("k", (F.col("v") * 2).alias("v"))


def clipped(t, most):
    return t.select("k", F.least("v", F.lit(most)).alias("v"))


def test_stages_run_again_only_behind_a_change(spark, tmp_path):
    source = str(tmp_path / "in")
    frame = lambda *v: spark.createDataFrame(list(enumerate(v)), "k int, v int")
    frame(1, 2, 30).write.parquet(source)
    runner = stages.Runner(spark, str(tmp_path / "store"), {"in": source})
    plan = [stages.Stage("doubled", doubled, ("in",)), stages.Stage("clipped", clipped, ("doubled",), {"most": 10}), stages.Stage("again", doubled, ("clipped",))]
    assert runner.run(plan) == {"doubled": "ran", "clipped": "ran", "again": "ran"}
    assert sorted(r.v for r in runner.store.read("again").collect()) == [4, 8, 20]
    # Unchanged: nothing is read, so a source whose files can't be read doesn't matter.
    made = [0]
    spying = [stages.Stage(s.name, s.make, s.inputs, s.settings) for s in plan]
    reader = runner._input
    runner._input = lambda *a: made.__setitem__(0, made[0] + 1) or reader(*a)
    assert runner.run(spying) == dict.fromkeys(("doubled", "clipped", "again"), "skipped") and made == [0]
    # A changed row runs the first stages; the last rests, as what it reads is equal.
    frame(1, 2, 40).write.mode("overwrite").parquet(source)
    with pytest.raises(stages.ChangedError, match="doubled: inputs"):
        runner.run(plan, "stop")
    assert runner.run(plan) == {"doubled": "ran", "clipped": "ran", "again": "skipped"}
    other = [plan[0], stages.Stage("clipped", clipped, ("doubled",), {"most": 3}), plan[2]]
    with pytest.raises(stages.ChangedError, match="settings"):
        runner.run(other, "stop")
    assert runner.run(other) == {"doubled": "skipped", "clipped": "ran", "again": "ran"}
    assert runner.run([stages.Stage("doubled", clipped, ("in",), {"most": 1})])["doubled"] == "ran"
    m = runner.manifest("clipped")
    assert m["rows"] == 3 and m["versions"]["spark"] and m["host"] and runner.manifests().count() == 8


def test_planted_faults_are_named_and_only_their_ranges_read(spark, tmp_path):
    good = spark.range(500).select(F.col("id").alias("k"), (F.col("id") % 7).alias("a"), F.when(F.col("id") % 11 > 0, F.col("id").cast("string")).alias("b"))
    bad = good.where("k <> 3").withColumn("a", F.when(F.col("k") == 20, F.lit(None)).otherwise(F.col("a"))).withColumn("b", F.when(F.col("k").isin(22, 20), "").otherwise(F.col("b"))).union(good.where("k = 9")).union(good.where("k = 1").withColumn("k", F.lit(900)))
    for name, df in (("good", good), ("same", good.repartition(5).orderBy(F.desc("k"))), ("bad", bad)):
        verify.write_artifact(df, str(tmp_path / name), ["k"], 64)
    path = lambda n: str(tmp_path / n)
    assert verify.differing_ranges(spark, path("good"), path("same")) == [] and verify.differences(spark, path("good"), path("same"), ["k"]).count() == 0
    assert len(verify.differing_ranges(spark, path("good"), path("bad"))) <= 5
    found = verify.differences(spark, path("good"), path("bad"), ["k"])
    assert {tuple(r) for r in found.collect()} == {(3, "missing", ""), (900, "extra", ""), (9, "count", ""), (20, "changed", "a,b"), (22, "changed", "b")}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [_range") >= 2 and "PartitionFilters: []" not in plan


def test_incidence_against_memberships(spark):
    nodes = spark.createDataFrame([("n0", 0), ("n1", 1)], "node string, index int")
    edges = spark.createDataFrame([("e0", 0), ("e1", 1)], "edge string, index int")
    members = spark.createDataFrame([("n0", "e0"), ("n1", "e1"), ("n1", "e1")], "node string, edge string")
    cells = lambda *c: spark.createDataFrame(list(c), "row int, col int")
    assert verify.incidence_differences(cells((0, 0), (1, 1)), members, nodes, edges).count() == 0
    bad = verify.incidence_differences(cells((0, 0), (0, 0), (0, 1), (5, 1)), members, nodes, edges)
    assert {tuple(r) for r in bad.collect()} == {("n0", "e0", "repeated"), ("n0", "e1", "no membership"), ("n1", "e1", "no cell"), (None, "e1", "outside")}


def test_diagnoses_of_several_fields(spark):
    from caselight.operators.diagnoses import Field, build

    day = lambda d: d and datetime.datetime(2024, 1, d)
    main = spark.createDataFrame([("1.0", " a10 ; B2|", "Flu", day(2)), ("1", "A10", "  flu ", None), ("2", "None", "", day(1)), ("gone", "A1", "x", day(1)), (None, "A1", "x", day(1))], "visit string, codes string, words string, t timestamp_ntz")
    more = spark.createDataFrame([("1", "FLU", day(1)), ("1", "FLU", day(1)), ("2", "Cough", day(3))], "visit string, words string, t timestamp_ntz")
    visits = spark.createDataFrame([("1", "p"), ("2", "q"), ("3", "q")], "visit_id string, patient_id string")
    fields = [Field("icd", "main", "codes", main, "visit", "codes", "t", True), Field("exam", "main", "words", main, "visit", "words", "t"), Field("order", "orders", "words", more, "visit", "words", "t")]
    got = {tuple(r)[2:] for r in build(fields, visits).collect()}
    assert got == {
        ("1", "a10", "", "icd", day(2), "main", "codes", 2), ("1", "B2", "", "icd", day(2), "main", "codes", 1),
        ("1", "", "FLU", "order; exam", day(1), "orders; main", "words", 4), ("2", "", "Cough", "order", day(3), "orders", "words", 1),
    }
    assert build(fields, visits.limit(0)).count() == 0


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_diagnoses_move_once(spark):
    from caselight.operators.diagnoses import Field, build

    v = spark.createDataFrame([("1", "p", "A1", " Flu", "flu", None, DAY), ("1", "p", "a1;B2", None, "None", None, None)], "visit_id string, patient_id string, code string, x string, y string, z string, t timestamp_ntz")
    out = build([Field("k", "s", c, v, "visit_id", c, "t", c == "code") for c in ("code", "x", "y", "z")], v)
    assert plan(out).count("Exchange hashpartitioning") == 2  # the values, and the known visits
    assert {(r.diagnosis_code, r.diagnosis_text, r.source_field, r.event_time, r.source_row_count) for r in out.collect()} == {("A1", "", "code", DAY, 2), ("B2", "", "code", None, 1), ("", "Flu", "x; y", DAY, 2)}


def test_audits_pair_no_targets_with_events(spark):
    from caselight.operators import events as E

    r = random.Random(7)
    rows = [(p, r.choice(["", f"{p}0", f"{p}1"]), None if r.random() < 0.1 else DAY + datetime.timedelta(days=r.randint(0, 9)), r.randint(0, 2), f"e{i}", " ".join(r.choice("abc") for _ in range(r.randint(0, 4))), False) for p in "xyz" for i in range(30)]
    goals = [(f"{p}{i}", p, None if i == 2 else DAY + datetime.timedelta(days=5 * i)) for p in "xyzw" for i in range(3)]
    ev, targets = spark.createDataFrame(rows, EVENTS), spark.createDataFrame(goals, TARGETS)
    out = lengths.audited_lengths(ev, targets, F.col("line"), different_words, 2)
    assert "Join" not in plan(out)
    pairs = E.timelines(ev.withColumn("code", F.col("line")).withColumn("source_table", F.lit("")), targets)
    want = lengths.view_lengths(pairs, F.col("code"), different_words, 2)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))
