"""Alignment, phrases and exact top-k against brute force, with nulls, ties, repeated rows, long texts and empty tables."""

import collections
import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from caselight.llm import alignment, exact_topk, phrases
from caselight.llm.bpe import byte_symbols

ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a b", "x\ty \n\nz", "▁", "a▁b", "<|endoftext|> <s> <0x41> <unk>", "é é", "日本 語", "😀😀 ok", "\x00a\x00 b",
    "don't we'll", "x" * 3000, "ab " * 2000, " x  y", "same text again", "same text again", "1234567 89.5,3", "tail space \n",
]


@pytest.fixture(scope="module")
def libraries():
    import public_tokenizers
    import sentencepiece
    import tokenizers

    a = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def grouped(text, a, b):
    """(A ids, B ids) of each group."""
    if not text:
        return []
    to_byte, own = {c: x for x, c in byte_symbols().items()}, {i: s for s, i in a.get_vocab().items()}
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    raw_a = [bytes(to_byte[c] for c in own[i]) for i in ids_a]
    raw_b = [bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if b"".join(raw_a) != (" " + text).encode() or b"".join(raw_b) != (" " + text).encode():
        return []

    def ends(raw):
        n, out = 0, []
        for x in raw:
            n += len(x)
            out.append(n)
        return out

    end_a, end_b = ends(raw_a), ends(raw_b)
    cuts = sorted(set(end_a) & set(end_b))
    return [([i for i, e in zip(ids_a, end_a, strict=True) if low < e <= high], [i for i, e in zip(ids_b, end_b, strict=True) if low < e <= high]) for low, high in zip([0, *cuts], cuts, strict=False)]


def aligned(texts, a, b):
    groups = [grouped(t, a, b) for t in texts]
    links = [collections.Counter((x, y) for ga, gb in g for x in ga for y in gb) for g in groups]
    count = collections.Counter(p for c in links for p in c)
    most = collections.Counter()
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    out = []
    for g, c in zip(groups, links, strict=True):
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        best = sum(m for p, m in c.items() if count[p] == most[p[0]])
        out.append((sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(c.values()), best, sum(m * count[p] for p, m in c.items()), hashlib.sha256(shown.encode()).hexdigest() if g else ""))
    return out, count


@pytest.mark.parametrize("small", [False, True])
def test_alignment(spark, texts, libraries, monkeypatch, small):
    if small:  # a full cache, one text a batch, ids in parts, sums flushed after each row
        for name, value in (("CACHE_PIECES", 20), ("BATCH_BYTES", 50), ("SALT_ENTRIES", 3), ("HELD", 2)):
            monkeypatch.setattr(alignment, name, value)
        alignment._aligner.cache_clear()
    rows = ODD + texts[:40]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(rows)], "doc_id long, text string, a string, n int").repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in alignment.align(df).collect()}
    want, count = aligned(rows, *libraries)
    for i, t in enumerate(rows):
        assert got[i] == want[i], (i, t and t[:50])
    assert {(r.a, r.b): r.n for r in alignment.pair_table(df).collect()} == count


def test_alignment_of_repeated_and_null_ids(spark, libraries):
    rows = [(1, "one two"), (1, "one two"), (None, "one three"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want, _ = aligned([t for _, t in rows], *libraries)
    got = [tuple(r) for r in alignment.align(df).collect()]
    assert sorted(got, key=str) == sorted([(i, *w) for (i, _), w in zip(rows, want, strict=True)], key=str)
    empty = alignment.align(df.limit(0))
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_wide_multiplicities(spark, libraries):
    t = "zz" + " and" * 70_000
    df = spark.createDataFrame([(1, t), (2, "and and")], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: tuple(r)[1:] for r in alignment.align(df).collect()}
    want, _ = aligned([t, "and and"], *libraries)
    assert [got[1], got[2]] == want


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def collocated(rows, least, first):
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    found = {p: c for p, c in f.items() if len(p[1]) > 1 and c >= least}
    out = collections.defaultdict(list)
    for (lang, w), a in found.items():
        longer = [c for (other, v), c in found.items() if other == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1))]
        if any(100 * c >= 80 * a for c in longer):
            continue
        score, k = min((2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w)))
        out[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, c in out.items() for i, (s, a, p, left, right) in enumerate(sorted(c)[:first]))


@pytest.mark.parametrize(("buckets", "first"), [(8, 2000), (1 << 17, 2000), (1 << 10, 7)])
def test_phrases(spark, monkeypatch, buckets, first):
    r = random.Random(3)
    words = [f"w{i}" for i in range(12)] + ["É", "日本", "a-b", "Ab", "\x00", "x y"]
    rows = []
    for i in range(160):
        t = "".join(r.choice(words) + r.choice([" ", " ", " ", " ", "\t", ". ", ",", "\n", "  "]) for _ in range(r.randint(0, 60)))
        rows.append((t + "New York City hall " * r.randint(0, 2), r.choice(["en", "de", None, "und"])))
    rows += [(None, "en"), ("", None), ("the end " * 4000, "long"), ("same", "en"), ("same", "en"), ("...", "fr")]
    monkeypatch.setattr(phrases, "NUMBERED", 10)
    monkeypatch.setattr(phrases, "BATCH_BYTES", 3000)
    df = spark.createDataFrame([(t, lang, "x", 1) for t, lang in rows], "text string, lang string, phrase string, n int").repartition(4)
    got = sorted(tuple(x) for x in phrases.collocations(df, 30, first, buckets).collect())
    assert got == collocated(rows, 30, first) and got


def test_phrases_of_large_counts_and_nothing(spark):
    df = spark.createDataFrame([("a b c d. " * 400, "en")], "text string, lang string")
    assert sorted(tuple(x) for x in phrases.collocations(df, 300, 10, 64).collect()) == collocated([("a b c d. " * 400, "en")], 300, 10)
    assert phrases.collocations(df.limit(0)).count() == 0


def test_scores_beyond_64_bits(spark):
    big = 1 << 60
    found = spark.createDataFrame([("en", "a", 1, big + 7), ("en", "b", 1, big + 9), ("en", "a b", 2, big + 5)], "lang string, phrase string, k int, n long")
    row = phrases._scored(found).first()
    assert row.score == 2000000 * (big + 5) // (2 * big + 16) and (row.l, row.r) == (big + 7, big + 9)


def test_buckets_prune_and_lose_nothing(spark):
    """Pairs of frequent words that are themselves rare aren't counted, those that reach the least count are."""
    r = random.Random(4)
    words = [f"v{i}" for i in range(300)]
    rows = [(" ".join(r.choice(words) for _ in range(400)) + " . " + "left right " * 2, "en") for _ in range(30)]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(3).select("text", F.col("lang"))
    first = phrases._pass(df, 1, 30, 1 << 18, None, None).cache()
    counts = first.where("phrase is not null").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    share = [spark.sparkContext.broadcast(b) for b in (phrases._bits(first, 30, 1 << 18), phrases._frequent_bits(counts, 1, 30, 1 << 18))]
    second = {x.phrase for x in phrases._pass(df, 2, 30, 1 << 18, *share).where("phrase is not null").collect()}
    assert {"left right", "right left"} & second and len(second) < 100


def dot(a, b):
    return sum(math.floor(256 * x) * math.floor(256 * y) for x, y in zip(a, b, strict=True))


def best(rows, k, every):
    """Rows (id, vector) to (query, rank, id, score), with ids of candidates after all others where they are null."""
    ok = [(n, i, v) for n, (i, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, v in ok:
        if i is not None and i % every == 0:
            scores = sorted((-max(min(dot(v, w), 2**63 - 1), -(2**63)), j is None, j or 0) for m, j, w in ok if m != n and len(w) == len(v))
            out += [(i, r + 1, None if null else j, -s) for r, (s, null, j) in enumerate(scores[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("small", [False, True])
def test_topk(spark, monkeypatch, small):
    if small:
        for name, value in (("QUERIES", 3), ("GROUP", 20), ("BINS", 4), ("SCORES", 30)):
            monkeypatch.setattr(exact_topk, name, value)
    r = random.Random(6)
    vector = lambda d: [r.choice([-1.0, -0.5, 0.25, 0.1, 0.7]) for _ in range(d)]
    rows = [(i, vector(4)) for i in range(120)] + [(200 + i, [1.0, 1.0, 0.0, 0.5]) for i in range(30)]
    rows += [(300, vector(2)), (305, vector(2)), (310, None), (315, [0.1, None, 0.2, 0.3]), (320, [float("nan")] * 4), (325, [float("inf")] + [0.0] * 3), (330, []), (335, []), (340, [0.0] * 4), (345, vector(7))]
    rows += [(None, [1.0, 1.0, 0.0, 0.5]), (5, vector(4)), (5, vector(4)), (10, rows[10][1])]
    rows += [(400, [1e9, -1e9, 1.0]), (401, [2e9, 1e9, 0.5]), (405, [1e300, 1.0, 0.0]), (402, [-1e300, 0.0, 3.0])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, rank int, score string").repartition(4)
    got = sorted((tuple(x) for x in exact_topk.search(df, F.col("vec_id") % 5 == 0, 5).collect()), key=str)
    assert got == best(rows, 5, 5)


def test_topk_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    out = exact_topk.search(df, F.col("vec_id") % 50 == 0)
    assert out.count() == 0 and out.columns == ["query_id", "rank", "vec_id", "score"]
    one = spark.createDataFrame([(0, [1.0]), (1, None)], "vec_id long, embedding array<float>")
    assert exact_topk.search(one, F.col("vec_id") % 50 == 0).count() == 0
