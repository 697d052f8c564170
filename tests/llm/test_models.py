"""Classifiers, url filters, vectors and the pipeline."""

import collections
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from caselight.llm import quality, toxicity, urls, vector_dup

SF = "/root/testdata/sf0.01"


def held(i, k, r):
    return zlib.crc32(str(i).encode()) % k == r


def test_toxicity_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = toxicity.classify(docs, labels).collect()
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    assert len(rows) == docs.count() and all(r.held_out == held(r.doc_id, 4, 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    out = [r for r in rows if r.held_out and r.doc_id in truth]
    assert sum(r.predicted and not truth[r.doc_id] for r in out) <= 1
    assert sum(r.predicted for r in out if truth[r.doc_id]) >= 0.6 * sum(truth[r.doc_id] for r in out)


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "You IDIOT, you moron! stupid " * 3, 0), (3, "a clean text", 0), (None, "x", 0)], "doc_id long, text string, y int")
    labels = spark.createDataFrame([(1, None), (9, 1)], "doc_id long, toxic int")
    rows = toxicity.classify(docs, labels).collect()
    assert len(rows) == 5 and sorted(r.predicted for r in rows) == [0, 0, 0, 0, 1]
    assert toxicity.classify(docs.limit(0), labels.limit(0)).count() == 0


def brute_mask(text, stems):
    """The votes on a text, by plain loops."""
    whole = text or ""
    low = whole.lower()
    seeds = {w: g for g, words in enumerate(toxicity.SEED_GROUPS) for w in words}
    learned = {x: g for g, words in enumerate(stems) for x in words}
    hits, at = [], 0
    while at < len(low):  # matches don't overlap, and begin where no letter stands before
        found = ""
        if not (at and low[at - 1].isalpha()):
            whole_words = [w + e for w in seeds for e in ("s", "") if low.startswith(w + e, at) and not low[at + len(w + e) : at + len(w + e) + 1].isalpha()]
            found = max(whole_words, key=len, default="") or next((x for x in learned if low.startswith(x, at)), "")
        if found:
            hits.append(found)
        at += max(len(found), 1)
    if not hits:
        return 1 << (len(toxicity.VOTERS) - 4)
    seed_of = lambda h: seeds.get(h, seeds.get(h[:-1]) if h.endswith("s") else None)
    bits = [any(seed_of(h) == g for h in hits) for g in range(len(toxicity.SEED_GROUPS))] + [any(learned.get(h) == g for h in hits) for g in range(len(stems))]
    seeded, n = any(seed_of(h) is not None for h in hits), len(re.findall(r"[^\x00-\x20]+", low))
    bound = lambda x: rf"(?<![^\W\d_])(?:{x})(?![^\W\d_])"
    names, address = "|".join(map(re.escape, toxicity.SEEDS)), "|".join(map(re.escape, toxicity.ADDRESS))
    bits += [seeded and bool(re.search(bound(address) + r"[^.!?\n]{0,40}" + bound(names), low)), seeded and bool(re.search(bound(names.upper()), whole))]
    bits += [len(hits) >= 3, len(set(hits)) >= 2, len(set(hits)) >= 4, len(hits) * 100 >= n]
    bits += [False, len(hits) == 1 and n >= 400, len(hits) * 500 < n, seeded and bool(re.search(f"[\"'\u201c\u00ab](?:{names})[\"'\u201d\u00bb]", low))]
    return sum(1 << k for k, x in enumerate(bits) if x)


def test_votes_against_brute_force(spark):
    r = np.random.default_rng(4)
    stems = (("zorg", "blix"), ("quam",), (), (), (), ("ferd",))
    words = [*toxicity.SEEDS, "IDIOT", "Morons", "clowns", "idiotic", "zorgon", "blix", "quamquam", "aferd", "ferdé", "you", "tu", "the", "calm", "river", "\"loser\"", "n1", "été", "scum.", "\n", "«puta»"]
    texts = [" ".join(r.choice(words[-19:] if k % 2 else words, r.integers(0, 12)).tolist() + ["plain"] * int(r.choice([0, 0, 20, 450, 1200]))) for k in range(150)] + [None, "", "x" * 300_000, "idiot " * 20_000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {x.i: x.m for x in df.select("i", toxicity.votes(F.col("t"), stems).alias("m")).collect()}
    want = {k: brute_mask(t, stems) for k, t in enumerate(texts)}
    assert got == want and len(set(got.values())) > 30


def test_label_model_finds_accuracies_without_labels():
    """Votes drawn with known accuracies, two voters nearly copies of each other; no label is given."""
    r = np.random.default_rng(5)
    n, rates = 40_000, {1: [0.9, 0.8, 0.7, 0.6, 0.6, 0.05], 0: [0.03, 0.02, 0.05, 0.01, 0.02, 0.5]}
    y = (r.random(n) < 0.12).astype(int)
    votes = np.stack([r.random(n) < np.where(y, rates[1][j], rates[0][j]) for j in range(6)], 1)
    votes = np.c_[votes, np.where(r.random(n) < 0.95, votes[:, 3], r.random(n) < 0.5)].astype(int)
    masks, inverse, count = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    post, rate, factors = toxicity.label_model(masks.astype(float), count.astype(float), np.array([1, 1, 1, 1, 1, -1, 1], float))
    assert np.mean((post[inverse.ravel()] > 0.5) == y) > 0.98
    assert np.allclose(rate[1, :6], rates[1], atol=0.05) and np.allclose(rate[0, :6], rates[0], atol=0.05)
    assert {frozenset(f) for f in factors} >= {frozenset((3, 6))}


def test_classifier_and_calibration():
    bits = np.array([[0, 0], [1, 0], [0, 1], [1, 1]], float)
    w = toxicity.linear(bits, np.array([0.02, 0.9, 0.3, 0.97]), np.array([92, 21, 18, 15], float))
    assert w[0] > w[1] > 0
    logit = bits @ w[:-1] + w[-1]
    slope, offset = toxicity.calibration(logit, np.array([[90, 2], [5, 20], [15, 3], [1, 15]], float))
    share = 1 / (1 + np.exp(-(slope * logit + offset)))
    assert abs(share @ np.array([92, 25, 18, 16]) - 40) < 2 and toxicity.calibration(logit, np.array([[9, 0]] * 4, float)) == (1.0, 0.0)


def test_toxic_documents_leave_with_their_columns(spark):
    docs = spark.createDataFrame([(1, "you idiot, pathetic loser, scum and trash", 0.7, "a"), (2, "a calm river", 0.2, "b"), (None, None, None, None)], "doc_id long, text string, toxicity_score double, low string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert toxicity.keep_clean(docs, model).columns == docs.columns
    left = {r.doc_id: r.toxicity_score for r in docs.withColumn("s", toxicity.scored(F.col("text"), model)).orderBy("s").collect()}
    assert list(left)[-1] == 1 and left == {1: 0.7, 2: 0.2, None: None}


def test_quality_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality.classify(docs, labels).collect()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert len(rows) == docs.count() and all(r.held_out == held(r.doc_id, 3, 1) and r.predicted == (r.score >= 0.5) for r in rows)
    out = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert sum(p == t for p, t in out) >= 0.95 * len(out)


def plain_tokens(text):
    """Runs of word bytes or of other visible bytes, A-Z lowered."""
    return re.findall(rb"[0-9a-z\x80-\xff]+|[\x00-\x08\x0e-\x1f!-/:-@\x5b-\x60{-\x7f]+", (text or "").encode().lower())


def test_token_vectors_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(quality, "VOCABULARY", 6)
    monkeypatch.setattr(quality, "TAIL", 4)
    monkeypatch.setattr(quality, "HELD", 5)
    r = np.random.default_rng(1)
    words = ["the", "The", "of", "é", "x1", "--", "a,", "far", "(b)", "zz", "q"]
    texts = [" ".join(r.choice(words, r.integers(0, 30)).tolist()) for _ in range(40)] + [None, "", "the"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    held = quality.token_vectors(df)
    from caselight.llm.textbatch import span_string

    index = quality.index_vectors(quality.INDEX, 1).astype(int)
    number = lambda w: int(span_string(w.decode()))
    sums, count = collections.defaultdict(lambda: np.zeros(quality.DIM)), collections.Counter()
    for t in texts:
        tokens = plain_tokens(t)
        for i, w in enumerate(tokens):
            count[number(w)] += 1
            for j in range(max(0, i - quality.WINDOW), min(len(tokens), i + quality.WINDOW + 1)):
                if j != i:
                    sums[number(w)] += index[number(tokens[j]) % quality.INDEX]
    top = max(([h for h in count if count[h] >= n] for n in set(count.values())), key=lambda x: len(x) if len(x) <= 6 else -1)
    assert 0 < len(top) <= 6
    assert held.vocabulary.tolist() == sorted(top)
    groups = [[h] for h in sorted(top)] + [[h for h in count if h not in top and h % 4 == b] for b in range(4)]
    n = np.array([sum(count[h] for h in g) for g in groups])
    mean = np.array([sum((sums[h] for h in g), np.zeros(quality.DIM)) / max(k, 1) for g, k in zip(groups, n, strict=True)])
    mean = (mean - (mean * n[:, None]).sum(0) / n.sum()) * (n > 0)[:, None]
    assert np.allclose(held.vectors[: len(top) + 4], mean, atol=1e-5)
    data = np.frombuffer("".join(t or "" for t in texts).encode(), np.uint8)
    offs = np.r_[0, np.cumsum([len((t or "").encode()) for t in texts])]
    x = quality.pooled(data, offs, held)
    for t, row in zip(texts, x, strict=True):
        mine = [next(i for i, g in enumerate(groups) if number(w) in g) for w in plain_tokens(t)]
        v = held.vectors[mine].astype(float) if mine else np.zeros((1, quality.DIM))
        assert np.allclose(row[: 2 * quality.DIM], np.r_[v.mean(0), v.std(0)], atol=1e-5)


def test_network_is_calibrated():
    r = np.random.default_rng(3)
    x = r.normal(size=(6000, 5))
    chance = 1 / (1 + np.exp(-(2 * x[:, 0] - 1.5 * x[:, 1] * (x[:, 2] > 0))))
    y = (r.random(6000) < chance).astype(float)
    s = quality.Network(x[:4000], y[:4000]).score(x[4000:])
    bins = np.digitize(s, np.linspace(0.1, 0.9, 9))
    assert sum(abs(s[bins == b].mean() - y[4000:][bins == b].mean()) * (bins == b).mean() for b in set(bins)) < 0.05
    assert np.mean((s >= 0.5) == (y[4000:] == 1)) > 0.95 * np.mean((chance[4000:] >= 0.5) == (y[4000:] == 1))


def test_quality_of_long_texts_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "word " * 300_000, 0.1, 5), (2, "x", 0.2, 6), (None, None, None, None), (2, "x", 0.2, 6)], "doc_id long, text string, score double, k long")
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (2, 1, 0), (None, 1, 1)], "doc_id long, quality int, k int")
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == 4 and all(0 <= r.score <= 1 for r in rows) and len({r.score for r in rows if r.doc_id == 2}) == 1


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a b c"), (3, "!!! ###"), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(3, 1), (9, None)], "doc_id long, quality int")
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert quality.classify(docs.limit(0), labels.limit(0)).count() == 0


def test_urls(spark):
    made = [f"https://{h}.example.{t}/{p}/{i}" for i, (h, t, p) in enumerate([("good", "org", "fr"), ("bad", "com", "de")] * 40)]
    made += ["HTTP://A.Example.NET/en/x?y", "http://x.net/a#b", "http://netx/", "http://net", "http://net/", "no url", "", None, "://", "x://H/p://q", "http://bad.example.edu/de/9", "http://good.example.edu/fr/9"]
    df = spark.createDataFrame([(i, u, "w") for i, u in enumerate(made)], "page_id long, url string, w string")
    rows = {r.page_id: r for r in urls.judge(df).collect()}
    assert len(rows) == len(made)
    at = lambda u: rows[made.index(u)]
    assert (at(made[80]).host, at(made[80]).path, at(made[80]).rule, at(made[80]).verdict) == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert (at(made[81]).path, at(made[81]).rule, at(made[81]).verdict) == ("/a", "net/", "block")
    assert at("http://netx/").rule is None and at("http://net").rule is None and at("http://net/").rule == "net/"
    assert all((at(u).host, at(u).path) == ("", "") for u in ("no url", "", None, "://")) and (at("x://H/p://q").host, at("x://H/p://q").path) == ("h", "/p://q")
    assert rows[0].rule == "org/fr/" and rows[1].rule == "example.com/de/"
    assert at(made[-2]).verdict == "block" and at(made[-1]).verdict == "allow"
    assert urls.judge(df.limit(0)).count() == 0
    # Without urls of both classes the models know nothing and allow.
    assert {r.verdict for r in urls.judge(df.where("page_id = 82")).collect()} == {"allow"}


def brute_url_models(rows, made, held_out):
    """Weights by run of codes, longest runs that a character may use, from counts of all runs."""
    s, d = urls.SYMBOLS, urls.SMOOTHING

    def codes(u):
        text = u.split("://", 1)[1] if "://" in u else u
        return [urls.ALPHABET.find("0" if c.isdigit() else c) + 1 for c in text.translate(str.maketrans(urls._UPPER, urls._LOWER))]

    def places(u):
        c = [urls.START] * urls.ORDER + codes(u)
        return [tuple(c[i : i + urls.ORDER + 1]) for i in range(len(c) - urls.ORDER)]

    n = [collections.Counter(), collections.Counter()]
    for r in rows:
        if r.rule and not held_out[r.page_id]:
            for run in places(made[r.page_id]):
                for k in range(urls.ORDER + 1):
                    n[r.verdict == "allow"][run[urls.ORDER - k :]] += 1
                    n[r.verdict == "allow"]["context", run[urls.ORDER - k : -1]] += 1
    total = sum(n[0]["context", ()] + n[1]["context", ()] for _ in (0,))

    def p(k, run):
        shorter = p(k, run[1:]) if run else 1 / s
        return (n[k][run] + d * shorter) / (n[k]["context", run[:-1]] + d) if run else shorter

    def weight(run):
        for k in range(urls.ORDER, urls.BASE, -1):
            part = run[urls.ORDER - k :]
            if n[0]["context", part[:-1]] + n[1]["context", part[:-1]] >= urls.SHARE * total:
                break
        else:
            part = run[urls.ORDER - urls.BASE :]
        return np.log(p(1, part)) - np.log(p(0, part))

    return lambda u: float(np.mean([weight(x) for x in places(u)])) if u and codes(u) else 0.0


def test_url_scores_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(urls, "SHARE", 0.01)
    made = [f"https://h{i % 7}.example.{('org', 'com', 'edu')[i % 3]}/{'fr' if i % 2 else 'de'}/Page-{i * 37 % 91}" for i in range(90)] + ["http://x.net/é?q=1", "x", "http://Y.Z/", "a" * 5000]
    df = spark.createDataFrame([(i, u, 0.5) for i, u in enumerate(made)] + [(None, made[0], 0.1), (90, made[90], 0.2)], "page_id long, url string, score double")
    rows = urls.judge(df).collect()
    assert len(rows) == len(made) + 2
    held = {r.page_id: r.h == 0 for r in df.select("page_id", F.pmod(F.xxhash64("url"), F.lit(urls.HELD_OUT)).alias("h")).collect()}
    known = [r for r in rows if r.page_id is not None or r.rule]
    again = [made[0] if r.page_id is None else made[r.page_id] for r in known]
    copies = [type("R", (), {"page_id": i, "rule": r.rule, "verdict": r.verdict}) for i, r in enumerate(known)]
    score = brute_url_models(copies, again, [held[r.page_id] for r in known])
    for r in rows:
        assert abs(r.score - score(made[r.page_id or 0])) < 1e-8, made[r.page_id or 0]
    out = [(r.score, r.verdict) for r in rows if r.rule and held[r.page_id]]
    allow, block = [x for x, v in out if v == "allow"], [x for x, v in out if v == "block"]
    error = lambda t: sum(x < t for x in allow) / len(allow) + sum(x >= t for x in block) / len(block)
    said = [(r.score, r.verdict) for r in rows if not r.rule]
    low, high = max((x for x, v in said if v == "block"), default=-9), min((x for x, v in said if v == "allow"), default=9)
    assert low < high and min(error(t) for t in np.arange(low, high + 1e-9, 0.001)[1:]) <= min(error(t) for t in np.arange(-8, 8, 0.01)) + 1e-9


def test_urls_of_one_class_only(spark):
    df = spark.createDataFrame([(i, f"http://a{i}.net/") for i in range(20)] + [(50, "http://b.edu/"), (51, "")], "page_id long, url string")
    rows = urls.judge(df).collect()
    assert all(r.score == 0 for r in rows) and {r.verdict for r in rows if not r.rule} == {"allow"}


def brute_vectors(rows, cosine):
    ok = {i: np.array(v, float) / np.linalg.norm(np.array(v, float)) for i, (v, lab) in enumerate(rows) if lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    links = {i: set() for i in range(len(rows))}
    for a in ok:
        for b in ok:
            if a < b and rows[a][1] == rows[b][1] and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] >= cosine:
                links[a].add(b)
                links[b].add(a)
    comp = {}
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            for x in links[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        comp[i] = min(seen)
    return {i: (len(links[i]), comp[i]) for i in links}


def test_vectors(spark, monkeypatch):
    monkeypatch.setattr(vector_dup, "BLOCK", 8)
    r = np.random.default_rng(2)
    rows = []
    for lab in (0, 1):
        for _ in range(12):
            c = r.normal(size=64)
            rows += [((c + 0.2 * r.normal(size=64)).astype(np.float32).tolist(), lab) for _ in range(r.integers(1, 8))]
        hot = r.normal(size=64)
        rows += [((hot + 0.05 * r.normal(size=64)).astype(np.float32).tolist(), lab) for _ in range(40)] + [(hot.astype(np.float32).tolist(), lab)] * 5
    rows += [(None, 0), ([0.0] * 64, 0), ([float("nan")] * 64, 0), ([None] * 64, 0), (rows[0][0], None), ([1.0, 0.0], 0), ([1.0, 0.01], 0), ([], 0)]
    df = spark.createDataFrame([(i, v, lab, "k") for i, (v, lab) in enumerate(rows)], "vec_id long, embedding array<float>, label int, key string")
    got = {x.vec_id: (x.n_links, x.component_id) for x in vector_dup.near_duplicates(df).collect()}
    want = brute_vectors(rows, 0.93)
    assert set(got) == set(want) and all(got[i][0] <= want[i][0] for i in want)
    assert sum(n for n, _ in got.values()) >= 0.999 * sum(n for n, _ in want.values())
    assert sum(got[i] == want[i] for i in want) >= 0.99 * len(want)
    assert vector_dup.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("width", [64, 300, 768])
def test_pairs_at_the_threshold_share_a_bucket_at_any_width(width):
    r = np.random.default_rng(width)
    a, o = r.normal(size=(2, 1500, width))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    o -= (o * a).sum(1, keepdims=True) * a
    b = 0.93 * a + np.sqrt(1 - 0.93**2) * o / np.linalg.norm(o, axis=1, keepdims=True)
    x, y = vector_dup.bucket_codes(a), vector_dup.bucket_codes(b)
    assert x.shape[1] == vector_dup.tables(width) and (x[:, :, :, None] == y[:, :, None, :]).any((1, 2, 3)).mean() > 0.998


def test_vectors_with_repeated_and_null_ids(spark):
    a, b = [1.0, 0.0, 0.0, 0.1], [0.0, 1.0, 0.1, 0.0]
    rows = [(5, a, 0), (5, b, 0), (3, [x * 2 for x in a], 0), (1, [1.0, 0.05, 0.0, 0.1], 0), (2, [0.0, 1.0, 0.15, 0.0], 0), (9, b, 1), (None, a, 0), (None, None, 0), (7, None, 0), (7, b, 1), (8, a, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, n string")
    got = sorted(((x.vec_id, x.n_links, x.component_id, x.kept) for x in vector_dup.near_duplicates(df).collect()), key=str)
    want = [(5, 2, 1, False), (5, 1, 1, False), (3, 2, 1, False), (1, 2, 1, True), (2, 1, 1, False), (9, 1, 7, False), (None, 0, None, True), (None, 0, None, True), (7, 0, 7, True), (7, 1, 7, True), (8, 0, 8, True)]
    assert got == sorted(want, key=str)


def test_pipeline(spark):


    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids, before = {r.doc_id for r in docs.select("doc_id").collect()}, docs
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    from tests.llm.test_text_operators import base_spans, brute_components, brute_hits

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        texts = {r.doc_id: r.text for r in before.collect()}
        after = stage(spark, before, SF)
        assert after.columns == docs.columns, name
        kept = {r.doc_id: r.text for r in after.collect()}
        assert set(kept) <= set(texts)
        if name == "toxicity":
            gone = set(texts) - set(kept)
            known = [labels[d] for d in gone if d in labels]
            assert sum(known) >= 0.85 * len(known) and gone
        elif name == "near_duplicates":
            assert set(kept) == {d for d, (_, c) in brute_components(texts.items(), 5, 80).items() if c == d}
        elif name == "benchmark":
            assert set(kept) == {d for d, r in brute_hits(texts.items(), items).items() if not r[1]}
        else:
            assert set(kept) == set(texts) and not any("@mail" in t for t in kept.values())
            for d, t in texts.items():
                held = [t[a:b] for _, a, b in base_spans(t or "")]
                assert not any(x in kept[d] for x in held) and (held or kept[d] == t or re.search(r"\[(?:EMAIL|IP|PHONE|IBAN|IDENTITY|SECRET)\]", kept[d])), d
        before = after.persist()
    out = corpus_pipeline.STAGES[-1][1](spark, before, SF)
    assert all(r.decoded == kept[r.doc_id] for r in out.collect())
    assert set(kept) <= ids


@pytest.mark.parametrize("rows", [0, 3])
def test_pipeline_edges(spark, tmp_path, rows):
    docs = spark.createDataFrame([(1, None, "en", "s", 0), (None, "x", None, None, None), (2, "", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long").limit(rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == rows
    assert docs.where(F.lit(True)).count() == rows


def test_pipeline_with_clashing_columns_and_repeated_rows(spark, tmp_path):
    word = lambda n: " ".join(f"w{(n * 37 + i * i * 7) % 901}" for i in range(60))
    item = " ".join(f"q{i}" for i in range(15))
    texts = {1: word(1) + " mail a.b@c.org", 2: word(2), 3: word(2).upper() + " x", 4: word(4) + " " + item, 5: "you idiot, pathetic loser and scum, trash, moron " * 4, 6: word(6) + ' token = "' + "0af9" * 8 + '"', 7: None, 8: ""}
    rows = [(i, t, "en", "s", 1, i * 10, "k", 0.5, "g", [1], "b") for i, t in texts.items()]
    rows += [rows[0], rows[1], (None, word(2), "en", "s", 1, 0, "k", 0.5, "g", [1], "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id long, c string, toxicity_score double, component_id string, spans array<int>, base string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(5, 1), (1, 0), (2, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = [{None, 1, 2, 3, 4, 6, 7, 8}, {None, 1, 2, 4, 6, 7, 8}, {None, 1, 2, 6, 7, 8}, {None, 1, 2, 6, 7, 8}]
    before = docs
    for (name, stage), ids in zip(corpus_pipeline.STAGES[:-1], want, strict=True):
        after = stage(spark, before, str(tmp_path)).persist()
        assert after.columns == docs.columns and {r.doc_id for r in after.collect()} == ids, name
        assert name == "personal_data" or all(r.text == texts.get(r.doc_id, word(2)) and r.base == "b" and r.spans == [1] for r in after.collect())
        before = after
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id or 0) for r in out) == [0, 1, 2, 6, 7, 8]
    decoded = {r.doc_id: r.decoded for r in out}
    assert decoded[1] == word(1) + " mail [EMAIL]" and decoded[6] == word(6) + ' token = "[SECRET]"' and decoded[2] == decoded[None] == word(2) and decoded[7] == decoded[8] == ""
