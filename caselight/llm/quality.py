"""Quality classifier (5): random-indexing vectors pooled per document, a two-layer network, a temperature.

A text becomes two streams of tokens: runs of word bytes or of other visible bytes, A-Z lowered, by their hash; and the
shape of each run (case, digits, length, whether it repeats the run before it). Every token has a fixed random index
vector of DIM components, NONZERO of them 1 or -1 (one of INDEX, by its hash). The vector of a token is the sum of the index
vectors of its neighbours up to WINDOW places away, over all documents, divided by its count and centred: sums are whole
numbers, so they don't depend on any order. The most frequent runs, up to VOCABULARY, have vectors of their own (runs of one
frequency all do or all don't), the others share TAIL vectors by hash. A document is the mean and spread of its run vectors and the mean of its shape vectors. A two-layer
network is fitted with numpy on at most MAX_LABELLED labelled training rows, in the order of a hash of their id; the last
CALIBRATION share of them sets the temperature that its scores are divided by.

Scale: one pass over the texts counts runs, and its shuffle moves a hash and a count for each different run of a task; a
second sums VOCABULARY + TAIL + SHAPES vectors in each task, and a third scores. The vocabulary and the vectors, of a fixed size,
go to the driver and to every executor. Documents are never shuffled, and labelled ones are picked by a broadcast of bounded size.

Defined results: null or empty texts pool to zeros and get the network's score of that; without usable labels of
both classes every score is the share of label 1 (0.5 if there are none); of an id labelled more than once the
largest label counts; null ids count as not held out; repeated rows each give a row; empty tables give empty results; other columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselight.llm.shared import Scratch
from caselight.llm.textbatch import ALNUM, prefix_hash, slices, span_hash
from caselight.llm.toxicity import labelled, remainder
from caselight.session import ship_package

MAX_LABELLED = 20_000
CALIBRATION = 0.2
VOCABULARY, TAIL, SHAPES = 1 << 15, 1 << 12, 128
INDEX = 1 << 14
#: Different runs that a task counts before it sends them on.
HELD = 1_000_000
DIM, NONZERO, WINDOW = 32, 4, 2
HIDDEN, EPOCHS = 32, 60

_KIND = np.where(ALNUM != 0, 1, 2).astype(np.uint8)
_KIND[[0x20, *range(9, 14)]] = 0
_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[65:91] += 32


def index_vectors(n: int, seed: int) -> np.ndarray:
    """The fixed sparse vectors of the numbers below n."""
    r = np.random.default_rng(seed)
    out = np.zeros((n, DIM), np.int8)
    spots = np.argsort(r.random((n, DIM)), axis=1)[:, :NONZERO]
    np.put_along_axis(out, spots, r.choice(np.array([-1, 1], np.int8), (n, NONZERO)), 1)
    return out


def streams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of runs, shape numbers, first run of each text and one past the last)."""
    kind = _KIND[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    new = np.ones(len(data), bool)
    new[1:] = kind[1:] != kind[:-1]
    new |= edge[: len(data)]
    runs = np.flatnonzero(new)
    ends = np.r_[runs[1:], len(data)]
    seen = kind[runs] > 0
    starts, ends = runs[seen], ends[seen]
    first = np.searchsorted(starts, offs)
    h = span_hash(prefix_hash(_LOWERED[data]), starts, ends)
    upper = np.r_[0, np.cumsum((data >= 65) & (data <= 90))]
    digit = np.r_[0, np.cumsum((data >= 48) & (data <= 57))]
    size, up, dig = ends - starts, upper[ends] - upper[starts], digit[ends] - digit[starts]
    head = (data[starts] >= 65) & (data[starts] <= 90) if len(starts) else np.zeros(0, bool)
    shape = np.select([kind[starts] == 2, dig > 0, (up == size) & (size > 1), head & (up == 1), up == 0], [0, 1, 2, 3, 4], 5)
    again = np.r_[False, h[1:] == h[:-1]] if len(h) else np.zeros(0, bool)
    again[first[:-1][first[:-1] < len(h)]] = False
    return h, shape * 16 + np.minimum(size // 3, 7) * 2 + again, first


def _pairs(first: np.ndarray, n: int):
    """(places, their neighbours' places) of tokens of one text, for each distance and side."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for o in range(1, WINDOW + 1):
        left = np.flatnonzero(doc[o:] == doc[:-o]) if n > o else np.zeros(0, np.int64)
        yield left, left + o
        yield left + o, left


_COLUMNS = [f"c{c}" for c in range(DIM + 1)]


def _counts(batches):
    """k, n: a task's different runs and how often they occur."""

    def out(held: list) -> pa.RecordBatch:
        keys, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        n = np.bincount(at.ravel(), np.concatenate([c for _, c in held]), len(keys)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["k", "n"])

    held: list = []
    for _, data, offs in slices(batches, "text", 500_000):
        held.append(np.unique(streams(data, offs)[0], return_counts=True))
        if sum(len(k) for k, _ in held) > HELD:
            yield out(held)
            held.clear()
    if held:
        yield out(held)


def _gather(vocabulary, tail: int):
    """k (row among the vectors), sums of neighbours' index vectors and count of a task's tokens."""

    def run(batches):
        index = index_vectors(INDEX, 1)
        spot = np.argsort(index == 0, axis=1, kind="stable")[:, :NONZERO]
        sign = np.take_along_axis(index, spot, 1).astype(float)
        of_shape = index_vectors(SHAPES, 2).astype(np.int64)
        held = Vectors(vocabulary.value, np.zeros((0, DIM), np.float32), tail)
        shape_at = len(held.vocabulary) + tail
        total = np.zeros((shape_at + SHAPES, DIM + 1), np.int64)
        for _, data, offs in slices(batches, "text", 2_000_000):
            runs, shapes, first = streams(data, offs)
            rows, numbers = held.rows(runs), (runs % np.uint64(INDEX)).astype(np.int64)
            sums, beside = np.zeros(shape_at * DIM), np.zeros(SHAPES * SHAPES, np.int64)
            for a, b in _pairs(first, len(runs)):
                if len(a):
                    near = numbers[b]
                    sums += np.bincount((rows[a, None] * DIM + spot[near]).ravel(), sign[near].ravel(), len(sums))
                    beside += np.bincount(shapes[a] * SHAPES + shapes[b], minlength=len(beside))
            total[:shape_at, :DIM] += sums.astype(np.int64).reshape(shape_at, DIM)
            total[:shape_at, DIM] += np.bincount(rows, minlength=shape_at)
            total[shape_at:, :DIM] += beside.reshape(SHAPES, SHAPES) @ of_shape
            total[shape_at:, DIM] += np.bincount(shapes, minlength=SHAPES)
        at = np.flatnonzero(total[:, DIM])
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(total[at, c]) for c in range(DIM + 1))], names=["k", *_COLUMNS])

    return run


class Vectors:
    """Vectors of the vocabulary, of the tail's buckets and of shapes, after one another; and where a run finds its own."""

    def __init__(self, vocabulary: np.ndarray, vectors: np.ndarray, tail: int):
        self.vocabulary, self.vectors, self.tail = vocabulary, vectors, tail  # hashes in order
        self.moments = np.concatenate([vectors, vectors.astype(float) ** 2], 1)

    def rows(self, runs: np.ndarray) -> np.ndarray:
        tail = len(self.vocabulary) + (runs % np.uint64(self.tail)).astype(np.int64)
        if not len(self.vocabulary):
            return tail
        at = np.minimum(np.searchsorted(self.vocabulary, runs), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == runs, at, tail)


def token_vectors(documents: DataFrame, text_col: str = "text") -> Vectors:
    """The vectors of all tokens, from all documents."""
    spark = documents.sparkSession
    ship_package(spark)
    texts = documents.select(F.col(text_col).alias("text"))
    counts = texts.mapInArrow(_counts, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))
    with Scratch(spark) as scratch:
        counts = scratch.write(counts)
        # How many runs occur how often: a row for each number of places that any run has.
        often = counts.groupBy("n").agg(F.count(F.lit(1)).alias("m")).orderBy(F.desc("n")).toPandas().to_numpy(np.int64).reshape(-1, 2)
        fits = int((np.cumsum(often[:, 1]) <= VOCABULARY).sum())
        least = int(often[fits - 1, 0]) if fits else 1 << 62
        top = counts.where(F.col("n") >= least).select("k").toPandas()["k"].to_numpy(np.int64)  # at most VOCABULARY rows
    vocabulary = np.sort(top.view(np.uint64))
    parts = texts.mapInArrow(_gather(spark.sparkContext.broadcast(vocabulary), TAIL), "k long, " + ", ".join(f"{c} long" for c in _COLUMNS))
    rows = parts.groupBy("k").agg(*(F.sum(c).alias(c) for c in _COLUMNS)).toPandas().to_numpy(np.int64)  # at most VOCABULARY + TAIL + SHAPES rows
    sums = np.zeros((len(vocabulary) + TAIL + SHAPES, DIM + 1), np.int64)
    sums[rows[:, 0]] = rows[:, 1:]
    n = sums[:, DIM:]
    out = sums[:, :DIM] / np.maximum(n, 1)
    for part in (slice(0, len(sums) - SHAPES), slice(len(sums) - SHAPES, None)):
        if n[part].sum():
            out[part] -= (out[part] * n[part]).sum(0) / n[part].sum()
            out[part] *= n[part] > 0
    return Vectors(vocabulary, out.astype(np.float32), TAIL)


def pooled(data: np.ndarray, offs: np.ndarray, held: Vectors) -> np.ndarray:
    """The features of each text: mean and spread of run vectors, mean of shape vectors."""
    runs, shapes, first = streams(data, offs)
    n = np.diff(first)
    out = np.zeros((len(n), 3 * DIM))
    rows, of_shape = held.rows(runs), held.vectors[len(held.vectors) - SHAPES :].astype(float)
    for d in np.flatnonzero(n):
        part = slice(first[d], first[d + 1])
        # A product with ones sums the rows of both moments.
        both = np.ones(n[d]) @ held.moments[rows[part]] / n[d]
        out[d, :DIM] = both[:DIM]
        out[d, DIM : 2 * DIM] = np.sqrt(np.maximum(both[DIM:] - both[:DIM] ** 2, 0))
        out[d, 2 * DIM :] = np.bincount(shapes[part], minlength=SHAPES) @ of_shape / n[d]
    return out


class Network:
    """Two layers and a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 3):
        r = np.random.default_rng(seed)
        self.constant = None
        cut = len(y) - int(CALIBRATION * len(y))
        if len(set(y[:cut].tolist())) < 2:
            self.constant = float(np.mean(y)) if len(y) else 0.5
            return
        self.mean, self.scale = x[:cut].mean(0), x[:cut].std(0) + 1e-6
        z = (x - self.mean) / self.scale
        p = [r.normal(0, z.shape[1] ** -0.5, (z.shape[1], HIDDEN)), np.zeros(HIDDEN), r.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        m, s, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        for _ in range(EPOCHS):
            order = r.permutation(cut)
            for i in range(0, cut, 128):
                b = order[i : i + 128]
                h = np.maximum(z[b] @ p[0] + p[1], 0)
                d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - y[b]) / len(b)
                dh = d[:, None] * p[2] * (h > 0)
                grad = [z[b].T @ dh + 1e-4 * p[0], dh.sum(0), h.T @ d + 1e-4 * p[2], d.sum(keepdims=True)]
                step += 1
                for k, g in enumerate(grad):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    s[k] = 0.999 * s[k] + 0.001 * g * g
                    p[k] = p[k] - 0.003 * m[k] / (1 - 0.9**step) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
        self.p, self.temperature = p, 1.0
        if cut < len(y):
            logit = self.logit(x[cut:])
            grid = np.exp(np.linspace(-1.5, 2.5, 81))
            loss = [np.mean(np.logaddexp(0, logit / t) - y[cut:] * logit / t) for t in grid]
            self.temperature = float(grid[int(np.argmin(loss))])

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.maximum(z @ self.p[0] + self.p[1], 0) @ self.p[2] + self.p[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -30, 30)))


def _pool(held):
    schema = pa.schema([("id", pa.int64()), ("x", pa.list_(pa.float64()))])

    def run(batches):
        for rows, data, offs in slices(batches, "text", 500_000):
            yield pa.RecordBatch.from_arrays([rows.column(0).cast(pa.int64()), pa.array(list(pooled(data, offs, held.value)), pa.list_(pa.float64()))], schema=schema)

    return run


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", held_out: tuple[int, int] = (3, 1), id_col: str = "doc_id", text_col: str = "text", limit: int = MAX_LABELLED):
    """(broadcast token vectors, network)."""
    spark = documents.sparkSession
    ship_package(spark)
    vectors = spark.sparkContext.broadcast(token_vectors(documents, text_col))
    lab = labelled(labels, label, id_col, held_out, limit)
    docs = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    picked = docs.join(F.broadcast(lab), "id", "left_semi").mapInArrow(_pool(vectors), "id long, x array<double>")
    rows = picked.join(F.broadcast(lab), "id").orderBy(F.xxhash64("id"), "id", "x").toPandas()  # at most limit ids
    x = np.array(rows["x"].tolist(), float).reshape(-1, 3 * DIM)
    return vectors, Network(x, rows["y"].to_numpy(float))


def classify(documents: DataFrame, labels: DataFrame, label: str = "quality", held_out: tuple[int, int] = (3, 1), id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row a document: id, held_out, score, predicted."""
    vectors, network = fit(documents, labels, label, held_out, id_col, text_col)
    held = documents.sparkSession.sparkContext.broadcast(network)
    schema = pa.schema([("doc", pa.int64()), ("score", pa.float64())])

    def run(batches):
        for rows, data, offs in slices(batches, "text", 500_000):
            yield pa.RecordBatch.from_arrays([rows.column(0).cast(pa.int64()), pa.array(held.value.score(pooled(data, offs, vectors.value)))], schema=schema)

    scored = documents.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).mapInArrow(run, "doc long, score double")
    out = F.coalesce(remainder(F.col("doc"), held_out[0]) == held_out[1], F.lit(False))
    return scored.select(F.col("doc").alias(id_col), out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
