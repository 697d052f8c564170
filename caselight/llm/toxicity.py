"""Toxicity (9): weak supervision by lexicon and pattern voters, a generative label model, a linear classifier.

Each of VOTERS votes "toxic" or "clean" or abstains. Toxic: groups of a fixed seed lexicon (by meaning, and by
language), groups of up to LEXICON stems found in at most MAX_LABELLED labelled training rows (prefixes of STEM_LENGTHS
characters that occur in far more toxic than other texts, in both halves of the sample; equal texts fall in one half),
and patterns: direct address, shouting, hits that repeat, many different hits, hits that are dense. Clean: no hit at all,
one hit alone in a long text, hits in less than a share of words, hits only where a text quotes. A text's votes make
one bit mask, so all that the models need of the corpus is a count for each mask that occurs, gathered over every document.

The label model doesn't see labels. It gives each class a distribution over masks: a probability for each voter's vote (its
accuracy), and pairwise factors along the tree of voters whose votes agree or disagree most beyond what the classes
explain (their correlations). EM estimates all of it from how voters agree over the whole corpus, starting from the votes'
signs. A ridge logistic regression on the votes is fitted to its posterior labels. Labels of the sample then only set two
numbers, the slope and offset that calibrate its scores.

Scale: voting and scoring are built-in functions on the scan, without a shuffle; labels enter as a broadcast
of the bounded sample; the fit shuffles stem counts (map-side combined) and mask counts.

Defined results: null or empty texts have the score of texts without hits; null ids count as not held
out; labels of ids without documents, null labels and held-out rows are ignored, of an id labelled more than
once the largest label counts; without usable labels of both classes there are no stems and no calibration; empty tables
give empty results. Rows repeated in the documents each give a row; other columns aren't read, nor changed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselight.functions.binding import let
from caselight.session import ship_package

MAX_LABELLED = 20_000
LEXICON = 160
STEM_LENGTHS = (4, 5, 6, 7, 8, 9)
#: Groups of stems, each a voter.
STEM_GROUPS = 6
#: Mutual information from which a voter leans on another, in nats.
LEAST_INFORMATION = 1e-4
THRESHOLD = 0.3
#: The seed lexicon by group, whole words with or without a plural s.
SEED_GROUPS = (
    ("idiot", "moron", "stupid", "dumb", "imbecile", "fool", "brainless", "ignorant", "cretin", "dimwit"),
    ("pathetic", "worthless", "loser", "useless", "failure", "coward", "nobody"),
    ("disgusting", "trash", "scum", "clown", "garbage", "filth", "vermin", "pig", "rat"),
    ("bastard", "asshole", "bitch", "whore", "shit", "fuck", "fucking", "dickhead", "slut", "crap"),
    ("idiota", "estúpido", "imbécil", "inútil", "basura", "cabrón", "puta", "payaso"),
    ("connard", "crétin", "abruti", "salope", "ordure", "débile"),
    ("dummkopf", "arschloch", "abschaum", "schwachkopf", "vollidiot", "versager"),
)
SEEDS = tuple(w for g in SEED_GROUPS for w in g)
#: Words of direct address before a seed.
ADDRESS = ("you", "your", "you're", "du", "ihr", "tu", "vous", "eres", "usted")


@dataclass(frozen=True)
class Model:
    """Groups of stems, and the classifier's weights, the constant last."""

    stems: tuple[tuple[str, ...], ...]
    weights: tuple[float, ...]


def remainder(id_col: Column, k: int) -> Column:
    """CRC-32 of the id as text, modulo k."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(k))


def labelled(labels: DataFrame, label: str, id_col: str = "doc_id", held_out: tuple[int, int] = (4, 2), limit: int = MAX_LABELLED) -> DataFrame:
    """id, y of at most limit training rows, in the order of a hash of the id."""
    train = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & (remainder(F.col(id_col), held_out[0]) != held_out[1]))
    one = train.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    return one.orderBy(F.xxhash64("id"), "id").limit(limit)


def _stem_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    find = re.compile(r"[^\W\d_]{4,}").findall
    held: dict[str, list[int]] = {}

    def out():
        return pa.RecordBatch.from_pydict({"stem": list(held), "n": [v for v in held.values()]}, schema=pa.schema([("stem", pa.string()), ("n", pa.list_(pa.int64()))]))

    for batch in batches:
        for text, y, half in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            w = set(find((text or "").lower()))
            for stem in {x[:k] for x in w for k in STEM_LENGTHS if len(x) >= k} | {""}:
                held.setdefault(stem, [0, 0, 0, 0])[2 * half + y] += 1
        if len(held) > 100_000:
            yield out()
            held.clear()
    if held:
        yield out()


def find_stems(sample: DataFrame, most: int = LEXICON) -> tuple[tuple[str, ...], ...]:
    """Stems that tell toxic texts of the sample (text, y, half) from the rest, dealt to STEM_GROUPS in the order of their worth.

    No stem is a prefix of another or of a seed.
    """
    counts = sample.select("text", "y", "half").mapInArrow(_stem_counts, "stem string, n array<long>")
    n = counts.groupBy("stem").agg(*(F.sum(F.col("n")[i]).alias(c) for i, c in enumerate(("n0", "p0", "n1", "p1"))))
    total = n.where("stem = ''").first()
    if total is None or not total.p0 + total.p1:
        return ((),) * STEM_GROUPS
    pos, neg = total.p0 + total.p1, total.n0 + total.n1
    least = max(2, int(0.005 * pos))
    p, q = F.col("p0") + F.col("p1"), F.col("n0") + F.col("n1")
    good = n.where((F.col("stem") != "") & (F.col("p0") >= least) & (F.col("p1") >= least) & (p * max(neg, 1) >= 10.0 * (q + 0.5) * pos))
    best = good.withColumn("p", p).withColumn("q", q).withColumn("s", p - 4.0 * q * pos / max(neg, 1))
    kept: list[str] = []
    for r in best.orderBy(F.desc("s"), F.length("stem"), "stem").limit(40 * most).collect():
        if len(kept) < most and not any(r.stem.startswith(x) or x.startswith(r.stem) for x in (*kept, *SEEDS)):
            kept.append(r.stem)
    return tuple(tuple(sorted(kept[g::STEM_GROUPS])) for g in range(STEM_GROUPS))


def _branches(stems: list[str], depth: int = 3) -> str:
    """A pattern for any of the stems, branching on their first characters."""
    if depth == 0 or len(stems) < 3:
        return "|".join(map(re.escape, stems))
    heads: dict[str, list[str]] = {}
    for x in stems:
        heads.setdefault(x[0], []).append(x[1:])
    return "|".join(re.escape(c) + f"(?:{_branches(rest, depth - 1)})" for c, rest in sorted(heads.items()))


#: The sign of each voter's vote, toxic or clean, in the order of the bits that `votes` sets.
VOTERS = (*(1 for _ in SEED_GROUPS), *(1 for _ in range(STEM_GROUPS)), 1, 1, 1, 1, 1, 1, -1, -1, -1, -1)


def votes(text: Column, stems: tuple[tuple[str, ...], ...]) -> Column:
    """Bit mask of the voters that vote."""
    whole = F.coalesce(text, F.lit(""))
    seeds, address = "|".join(map(re.escape, SEEDS)), "|".join(map(re.escape, ADDRESS))
    every = sorted(x for g in stems for x in g)
    learned = f"|{_branches(every)}" if every else ""
    pattern = rf"(?<!\p{{L}})(?:(?:{seeds})s?(?!\p{{L}}){learned})"
    addressed = rf"(?<!\p{{L}})(?:{address})(?!\p{{L}})[^.!?\n]{{0,40}}(?<!\p{{L}})(?:{seeds})(?!\p{{L}})"
    shouted = rf"(?<!\p{{L}})(?:{seeds.upper()})(?!\p{{L}})"
    quoted = rf"[\"'\u201c\u00ab](?:{seeds})[\"'\u201d\u00bb]"

    def mask(low: Column, hits: Column, n: Column) -> Column:
        of = lambda words: F.exists(hits, lambda h: h.isin(*words)) if words else F.lit(False)
        bits = [of([*g, *(w + "s" for w in g)]) for g in SEED_GROUPS] + [of(g) for g in stems]
        seeded = F.exists(hits, lambda h: h.isin(*SEEDS, *(w + "s" for w in SEEDS)))
        kinds, size = F.size(F.array_distinct(hits)), F.size(hits)
        bits += [seeded & low.rlike(addressed), seeded & whole.rlike(shouted), size >= 3, kinds >= 2, kinds >= 4, size * 100 >= n]
        bits += [F.lit(False), (size == 1) & (n >= 400), size * 500 < n, seeded & low.rlike(quoted)]
        return sum((F.when(b, F.lit(1 << j)).otherwise(F.lit(0)) for j, b in enumerate(bits)), F.lit(0))

    # Bound values are worked out once a text, and only where the pattern occurs.
    words = lambda low: F.regexp_count(low, F.lit(r"[^\x00-\x20]+"))
    found = lambda low: let(F.regexp_extract_all(low, F.lit(pattern), F.lit(0)), lambda hits: let(words(low), lambda n: mask(low, hits, n)))
    nothing = F.lit(1 << (len(VOTERS) - 4))
    return let(F.lower(whole), lambda low: F.when(low.rlike(pattern), found(low)).otherwise(nothing))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _tree(joint: np.ndarray) -> list[tuple[int, int]]:
    """(voter, the one it leans on or -1) along a maximum spanning tree of the mutual information that joint (class, voter, voter, vote, vote) leaves within classes."""
    v = joint.shape[1]
    within = joint / joint.sum((3, 4), keepdims=True)
    own = np.einsum("yjjaa->yja", within)
    apart = own[:, :, None, :, None] * own[:, None, :, None, :]
    share = joint.sum((3, 4))[:, 0, 0] / joint.sum((3, 4))[:, 0, 0].sum()
    info = np.einsum("y,yjkab->jk", share, within * np.log(within / apart))
    out, best, lean, free = [], np.full(v, -1.0), np.full(v, -1), np.ones(v, bool)
    for _ in range(v):
        j = int(np.argmax(np.where(free, best, -np.inf)))
        out.append((j, int(lean[j])))
        free[j] = False
        closer = free & (info[j] > np.maximum(best, LEAST_INFORMATION))
        best[closer], lean[closer] = info[j][closer], j
    return out


def label_model(bits: np.ndarray, count: np.ndarray, signs: np.ndarray, rounds: int = 40) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """(posterior probability of "toxic" for each mask, each class's probability of each voter's vote, pairwise factors).

    A class's distribution is a product over voters, each given the voter it leans on, if any: pairwise factors along a tree. EM
    estimates votes, factors and the prior from weighted masks; the tree is chosen when the classes have taken shape, and again.
    """
    n, v = bits.shape
    b = bits.astype(int)
    one_hot = np.stack([1 - bits, bits], 2)
    # One imagined text a class, so that a handful of texts is read by the votes' signs.
    vote = np.stack([np.where(signs > 0, 0.03, 0.3), np.where(signs > 0, 0.3, 0.03)])
    belief = np.stack([1 - vote, vote], 2)
    post = _sigmoid(2.0 * (bits @ signs) - 4.0)  # at first, of more than two votes more than against it
    factors = [(j, -1) for j in range(v)]
    rate = np.zeros((2, v))
    for turn in range(rounds):
        share = np.stack([count * (1 - post), count * post])
        joint = np.einsum("yn,nja,nkb->yjkab", share, one_hot, one_hot) + np.einsum("yja,ykb->yjkab", belief, belief)
        for j in range(v):  # a voter with itself
            own = np.einsum("yn,na->ya", share, one_hot[:, j]) + belief[:, j]
            joint[:, j, j] = np.stack([np.diag(o) for o in own]) + 1e-12
        if turn in (rounds // 4, rounds // 2):
            factors = _tree(joint)
        logs = np.zeros((2, n))
        for j, k in factors:
            own = np.einsum("yaa->ya", joint[:, j, j])
            own = own / own.sum(1, keepdims=True)
            rate[:, j] = own[:, 1]
            if k < 0:
                logs += np.log(own)[:, b[:, j]]
            else:
                given = joint[:, j, k] / joint[:, j, k].sum(1, keepdims=True)
                logs += np.log(given)[:, b[:, j], b[:, k]]
        prior = np.log((share.sum(1) + 0.5) / (count.sum() + 1))
        post = _sigmoid(prior[1] - prior[0] + logs[1] - logs[0])
    return post, rate, [f for f in factors if f[1] >= 0]


def linear(bits: np.ndarray, target: np.ndarray, weight: np.ndarray, ridge: float = 0.3, rounds: int = 40) -> np.ndarray:
    """Weights and constant of a ridge logistic regression on soft targets, by Newton steps."""
    x = np.c_[bits, np.ones(len(bits))]
    w = np.zeros(x.shape[1])
    w[-1] = -2
    penalty = np.r_[np.full(x.shape[1] - 1, ridge), 1e-3]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (target - p)) - penalty * w
        h = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, g)
        w += step * min(1.0, 4 / max(np.abs(step).max(), 1e-9))
    return w


def calibration(logit: np.ndarray, known: np.ndarray) -> tuple[float, float]:
    """Slope and offset that fit the logits of masks to the counts of labels 0 and 1; 1 and 0 without both."""
    if not known[:, 0].sum() or not known[:, 1].sum():
        return 1.0, 0.0
    both = np.concatenate([logit, logit])[:, None]
    w = linear(both, np.r_[np.zeros(len(logit)), np.ones(len(logit))], np.r_[known[:, 0], known[:, 1]], 0.02)
    return (float(w[0]), float(w[1])) if w[0] > 0 else (1.0, 0.0)


def fit(documents: DataFrame, labels: DataFrame, label: str = "toxic", held_out: tuple[int, int] = (4, 2), id_col: str = "doc_id", text_col: str = "text", limit: int = MAX_LABELLED) -> Model:
    """The voters and the classifier; labels come only from rows that are not held out."""
    ship_package(documents.sparkSession)
    docs = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    lab = F.broadcast(labelled(labels, label, id_col, held_out, limit))  # at most limit rows of two numbers
    sample = docs.join(lab, "id").withColumn("half", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int"))
    stems = find_stems(sample)
    masks = docs.select("id", votes(F.col("text"), stems).alias("mask")).join(lab, "id", "left")
    rows = masks.groupBy("mask", "y").count().collect()  # three rows a mask at most, and a text has few of the masks' many bits
    held = sorted({r["mask"] for r in rows} | {1 << (len(VOTERS) - 4)})
    at = {m: i for i, m in enumerate(held)}
    known, count = np.zeros((len(held), 2)), np.zeros(len(held))
    for r in rows:
        count[at[r["mask"]]] += r["count"]
        if r["y"] is not None:
            known[at[r["mask"]], int(r["y"] > 0)] += r["count"]
    bits = np.array([[m >> j & 1 for j in range(len(VOTERS))] for m in held], float)
    post = label_model(bits, count, np.array(VOTERS, float))[0]
    w = linear(bits, post, np.maximum(count, 0.01) / max(count.sum() / 5000, 1.0))
    slope, offset = calibration(bits @ w[:-1] + w[-1], known)
    return Model(stems, (*(float(slope * x) for x in w[:-1]), float(slope * w[-1] + offset)))


def scored(text: Column, model: Model) -> Column:
    """The score from 0 to 1 of a text, as one expression, so that a filter on it works it out once."""

    def logistic(mask: Column) -> Column:
        logit = F.lit(model.weights[-1])
        for j, w in enumerate(model.weights[:-1]):
            logit = logit + F.when(mask.bitwiseAND(1 << j) != 0, F.lit(w)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-logit))

    return let(votes(text, model.stems), logistic)


def keep_clean(documents: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents, with all their columns, whose score is below the threshold."""
    return documents.where(scored(F.col(text_col), model) < threshold)


def classify(documents: DataFrame, labels: DataFrame, label: str = "toxic", held_out: tuple[int, int] = (4, 2), id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row a document: id, held_out, score, predicted."""
    model = fit(documents, labels, label, held_out, id_col, text_col)
    out = F.coalesce(remainder(F.col(id_col), held_out[0]) == held_out[1], F.lit(False))
    rows = documents.select(F.col(id_col), out.alias("held_out"), scored(F.col(text_col), model).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
