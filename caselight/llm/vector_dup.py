"""Embedding near-duplicates (6): cross-polytope hashing after fast Hadamard rotations, multiprobe buckets.

Vectors of one label are compared by cosine. Equal vectors make one class, of which the smallest id stands for
all. A class is turned by pseudo-random signs and fast Hadamard transforms (three rounds), its nearest signed
axis is one hash; HASHES of them make a bucket, and each of TABLES tables (more for wide vectors) files a class under its PROBES best
buckets, by the squared loss against the nearest axes. Two classes are candidates if they share a bucket. In 64
dimensions and at cosine 0.93 a table misses a pair with probability 0.15, all tables with 7e-5; with their 8, 11 and 12 tables
vectors of 256, 768 and 1,536 components missed none of 6,000 such pairs (the tests measure recall against brute force).

Buckets are compared by matrix products in blocks of BLOCK classes, a task a pair of blocks, so a large bucket
is split over tasks and nothing is capped. A pair that shares several buckets counts in the first alone. Only
each class's number of links and an edge to the root of its tree within the block pair leave the task, never
the pairs, so what moves on grows with the classes and not with the square of a bucket.

Scale: the shuffles move a key of 8 bytes a class, table and probe, then the vectors of shared buckets.

Defined results: vectors that are null, zero, or hold null or non-finite components, and rows without a label,
link with nothing; vectors of different lengths don't link; rows of one id are one vertex, so their links join and they share
a component, each row counts as a vector, has its own number of links and gives a row; rows with a null id give a row each with
no links, a null component_id and kept = true, and count as nobody's links; empty tables give empty results; other columns aren't read.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselight.llm.shared import Scratch, components
from caselight.llm.textbatch import grouped, mix
from caselight.session import ship_package

COSINE = 0.93
TABLES, HASHES, PROBES = 5, 2, 4
#: Rows of a block; a bucket of n rows is moved n / BLOCK times.
BLOCK = 2048
#: Cosines of pairs that a task holds at once.
COSINES = 1 << 20


def hadamard(x: np.ndarray) -> np.ndarray:
    """The orthonormal Hadamard transform of each row; the width is a power of two."""
    n, half = x.shape[1], 1
    while half < n:
        y = x.reshape(len(x), n // (2 * half), 2, half)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), n)
        half *= 2
    return x / np.sqrt(n)


def _signs(width: int, table: int, k: int, turn: int) -> np.ndarray:
    seed = np.uint64(((table * HASHES + k) * 3 + turn) << 32)
    return 1.0 - 2.0 * (mix(np.arange(1, width + 1, dtype=np.uint64) + seed) & np.uint64(1))


def tables(components: int) -> int:
    """TABLES up to 64 components, one and a half more for each doubling, as nearest axes are the less stable the more there are."""
    return TABLES + 3 * max(0, (components - 1).bit_length() - 6) // 2


def bucket_codes(x: np.ndarray) -> np.ndarray:
    """The PROBES best buckets of each unit vector in each table: an array (rows, tables, PROBES)."""
    width, n = 1 << max(1, (x.shape[1] - 1).bit_length()), tables(x.shape[1])
    x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    out = np.empty((len(x), n, PROBES), np.int64)
    for table in range(n):
        axes, loss = [], []
        for k in range(HASHES):
            y = x
            for turn in range(3):
                y = hadamard(y * _signs(width, table, k, turn))
            near = np.argsort(-np.abs(y), axis=1, kind="stable")[:, : min(3, width)]
            v = np.take_along_axis(y, near, 1)
            axes.append(2 * near + (v < 0))
            loss.append((np.abs(v[:, :1]) - np.abs(v)) ** 2)
        choices = list(product(*(range(a.shape[1]) for a in axes)))
        cost = np.stack([sum(loss[k][:, c[k]] for k in range(HASHES)) for c in choices], 1)
        code = np.stack([sum(axes[k][:, c[k]] * (2 * width) ** k for k in range(HASHES)) for c in choices], 1)
        best = np.argsort(cost, axis=1, kind="stable")[:, :PROBES]
        found = np.take_along_axis(code, best, 1)
        out[:, table, :] = found if found.shape[1] == PROBES else np.pad(found, ((0, 0), (0, PROBES - found.shape[1])), mode="edge")
    return out


def _vectors(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1)


def _keys():
    """(k1, k2, id, n, label's hash, v) to (k1, k2, id, n, v as unit vector, keys). Keys hold label and length."""
    schema = pa.schema([*((c, pa.int64()) for c in ("k1", "k2", "id", "n")), ("v", pa.list_(pa.float64())), ("keys", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            length = batch.column(5).value_lengths().to_numpy()
            for d in np.unique(length):
                at = np.flatnonzero(length == d)
                rows = batch.take(pa.array(at))
                x = _vectors(rows.column(5))
                x /= np.abs(x).max(1, keepdims=True)  # keeps squares finite
                x /= np.sqrt((x * x).sum(1, keepdims=True))
                code = bucket_codes(x).astype(np.uint64)
                group = rows.column(4).to_numpy().view(np.uint64)
                with np.errstate(over="ignore"):
                    salt = mix(group[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(d) * np.uint64(64) + np.arange(code.shape[1], dtype=np.uint64)[None, :])
                    key = mix(code + salt[:, :, None])
                yield pa.RecordBatch.from_arrays([*(rows.column(c).cast(pa.int64()) for c in range(4)), pa.array(list(x), pa.list_(pa.float64())), pa.array(list(key.reshape(len(x), -1).view(np.int64)), pa.list_(pa.int64()))], schema=schema)

    return run


def _pairs(x: np.ndarray, left: np.ndarray, right: np.ndarray, cosine: float):
    """Places (a, b) of the pairs between left and right rows that reach the cosine, in parts of bounded size."""
    step = max(1, COSINES // max(len(right), 1))
    for at in range(0, len(left), step):
        part = left[at : at + step]
        a, b = np.nonzero(x[part] @ x[right].T >= cosine)
        yield part[a], right[b]


def _links(cosine: float):
    """Of groups (key, i, j): each class's links in the group, and the root of its tree there."""
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("root", pa.int64())])

    def group(key: int, i: int, j: int, block, ids, n, x, keys):
        left = np.flatnonzero(block == i)
        right = left if i == j else np.flatnonzero(block == j)
        count, root = np.zeros(len(ids)), ids.copy()
        for a, b in _pairs(x, left, right, cosine):
            if i == j:
                a, b = a[a < b], b[a < b]
            # A pair counts in its first shared bucket: the least common key of the first table that has one.
            first = np.zeros(len(a), bool)
            for s in range(0, len(a), 4096):
                p, q = keys[a[s : s + 4096]], keys[b[s : s + 4096]]
                same = p[:, :, :, None] == q[:, :, None, :]
                table = same.any((2, 3)).argmax(1)
                row = np.arange(len(p))
                shared = np.where(same[row, table].any(2), p[row, table], np.iinfo(np.int64).max)
                first[s : s + 4096] = shared.min(1) == key
            a, b = a[first], b[first]
            count += np.bincount(a, n[b], len(ids)) + np.bincount(b, n[a], len(ids))
            while True:
                low = np.minimum(root[a], root[b])
                before = root.copy()
                np.minimum.at(root, a, low)
                np.minimum.at(root, b, low)
                if (root == before).all():
                    break
        at = np.flatnonzero(count)
        return at, count[at].astype(np.int64), root[at]

    def run(batches):
        for t in grouped(batches, 3, rows=4 * BLOCK, size=64_000_000):
            t = t.combine_chunks()
            key, i, j, block, k1, k2, ids, n = (t.column(c).to_numpy() for c in range(8))
            cut = np.flatnonzero((np.diff(key) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1
            out = []
            for s, e in zip(np.r_[0, cut].tolist(), np.r_[cut, len(key)].tolist(), strict=True):
                if e - s < 2:
                    continue
                part = t.slice(s, e - s)
                keys = part.column(9).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(e - s, -1, PROBES)
                at, count, root = group(key[s], i[s], j[s], block[s:e], ids[s:e], n[s:e], _vectors(part.column(8).combine_chunks()), keys)
                out.append((k1[s:e][at], k2[s:e][at], ids[s:e][at], count, root))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([r[c] for r in out]) if out else np.zeros(0, np.int64)) for c in range(5)], schema=schema)

    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row a vector: id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    ship_package(spark)
    v = F.col("v")
    finite = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    usable = F.col("id").isNotNull() & F.col("label").isNotNull() & (F.coalesce(F.size(v), F.lit(0)) > 0) & finite & F.exists(v, lambda x: x != 0)
    rows = rows.withColumn("ok", F.coalesce(usable, F.lit(False)))
    rows = rows.withColumn("k1", F.when(F.col("ok"), F.xxhash64("label", "v"))).withColumn("k2", F.when(F.col("ok"), F.xxhash64("v", F.lit(1), "label")))
    both = ["k1", "k2"]
    with Scratch(spark) as scratch:
        member = scratch.write(rows.select("id", *both))
        classes = scratch.write(member.where("k1 IS NOT NULL").groupBy(*both).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")))
        reps = classes.join(rows.where("ok").select("id", *both, F.xxhash64("label").alias("g"), "v"), ["id", *both]).dropDuplicates(both)
        keyed = scratch.write(reps.select(*both, "id", "n", "g", "v").mapInArrow(_keys(), "k1 long, k2 long, id long, n long, v array<double>, keys array<long>"))
        filed = keyed.select(*both, F.explode(F.array_distinct("keys")).alias("key"))
        shared = scratch.write(filed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("key", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")))
        placed = filed.join(shared, "key").withColumn("block", F.pmod(F.xxhash64(*both), F.col("blocks")).cast("int"))
        dealt = placed.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("key", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", *both)
        full = dealt.join(keyed, both).select("key", "i", "j", "block", *both, "id", "n", "v", "keys")
        full = full.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
        found = scratch.write(full.mapInArrow(_links(cosine), "k1 long, k2 long, id long, n long, root long"))
        links = scratch.write(found.groupBy(*both).agg(F.sum("n").alias("links")))
        # Ids with rows of several classes tie those classes' first ids.
        several = scratch.write(member.where("id IS NOT NULL").select("id", F.coalesce(F.xxhash64(*both), F.lit(0)).alias("w")).groupBy("id").agg(F.min("w").alias("w0"), F.max("w").alias("w1")).where("w0 < w1").select("id"))
        tied = member.where("k1 IS NOT NULL").join(several, "id").join(classes.select(*both, F.col("id").alias("b")), both).select(F.col("id").alias("a"), "b")
        edges = scratch.write(found.select(F.col("id").alias("a"), F.col("root").alias("b")).union(tied).where("a <> b").distinct())
        if edges.limit(1).count():
            comp = components(scratch, edges)
        else:
            comp = scratch.write(edges.select(F.col("a").alias("id"), F.col("b").alias("component")))
        by_class = classes.select(*both, "id", "n").join(links, both, "left").join(comp, "id", "left")
        by_class = scratch.write(by_class.select(*both, (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component")))
        own = scratch.write(several.join(comp, "id").select("id", F.col("component").alias("own")))
        scratch.keep_only(member, by_class, own)
        out = member.join(by_class, both, "left").join(own, "id", "left")
        out = out.withColumn("component_id", F.when(F.col("id").isNotNull(), F.coalesce("own", "component", "id")))
        return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
