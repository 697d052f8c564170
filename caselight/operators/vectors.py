"""Vector operators: validity, normalisation and exact cosine search."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselight.functions.binding import let
from caselight.functions.ids import hash_order
from caselight.operators import windows as W
from caselight.operators.aggregates import exact_quantiles
from caselight.operators.joins import with_constants
from caselight.session import ship_package, work_folder

#: Bytes of query vectors that one block of a search sends to every executor.
QUERY_BLOCK_BYTES = 32_000_000
#: Scores that a task holds at once, of at most TILE_QUERIES queries.
SCORES = 500_000
TILE_QUERIES = 1000


def is_valid(v: Column, dim: int | None = None) -> Column:
    """A vector that is not null, has finite components, a norm over 1e-12 and, if given, that many components."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ok = v.isNotNull() & F.coalesce(finite, F.lit(False)) & (norm(v) > 1e-12)
    return ok & (F.size(v) == dim) if dim is not None else ok


def norm(v: Column) -> Column:
    """Euclidean norm, added from the left in double precision."""
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalize(v: Column) -> Column:
    """The vector over its norm; null where it is not valid. The norm is worked out once a vector."""
    return let(v, lambda w: F.when(is_valid(w), let(norm(w), lambda n: F.transform(w, lambda x: x.cast("double") / n))))


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, added from the left."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def prefix(v: Column, n: int) -> Column:
    """The first n components, normalised again."""
    return normalize(F.slice(v, 1, n))


def fuse(blocks: list[tuple[Column, float]]) -> Column:
    """Blocks normalised each, weighted, put one after another and normalised again."""
    return normalize(F.concat(*(F.transform(normalize(v), lambda x: x * F.lit(w)) for v, w in blocks)))


def mean_pool(df: DataFrame, key: str, vector: str) -> DataFrame:
    """The mean vector of each key, from all its valid vectors; partial sums by component are made before the shuffle."""
    parts = df.where(is_valid(F.col(vector))).select(key, F.posexplode(vector).alias("pos", "x"))
    means = parts.groupBy(key, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s.m).alias(vector))


def _matrix(lists: pa.Array) -> np.ndarray:
    """Lists of one length as the rows of a matrix."""
    size = lists.value_lengths().to_numpy()
    if (size != size[0]).any():
        raise ValueError("vectors of several lengths")
    return lists.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(size), size[0])


def _tiles(n: int, m: int) -> Iterator[tuple[slice, slice]]:
    """Slices of n queries and m candidates that make at most SCORES pairs each."""
    queries = max(1, min(n, TILE_QUERIES, SCORES))
    rows = max(1, SCORES // queries)
    for at in range(0, m, rows):
        for a in range(0, n, queries):
            yield slice(a, min(a + queries, n)), slice(at, min(at + rows, m))


def _query_blocks(queries: DataFrame, width: int) -> Iterator[dict]:
    """The stated queries in blocks of about QUERY_BLOCK_BYTES, dealt by hash: Arrow arrays by column, v as a matrix."""
    size = queries.agg(F.sum(F.size("v") * 8 + width)).first()[0] or 0
    n = int(size // QUERY_BLOCK_BYTES) + 1
    for b in range(n):
        part = queries if n == 1 else queries.where(F.pmod(F.xxhash64("id"), F.lit(n)) == b)
        if (held := part.toArrow()).num_rows:
            columns = {c: held[c].combine_chunks() for c in held.column_names}
            yield columns | {"v": _matrix(columns["v"])}


def _by_blocks(queries: DataFrame, width: int, rows: DataFrame, work: Callable, schema: str) -> DataFrame:
    """What work(held block) makes of the rows in mapInArrow, block by block.

    A block's result is written and its broadcast destroyed before the next block leaves the driver; a single block stays lazy.
    """
    spark = rows.sparkSession
    folder, part, held = None, None, None
    for n, block in enumerate(_query_blocks(queries, width)):
        if held is not None:
            folder = folder or work_folder(spark)
            part.write.parquet(f"{folder}/{n - 1}")
            held.destroy()
        held = spark.sparkContext.broadcast(block)
        part = rows.mapInArrow(work(held), schema)
    if held is None:
        return spark.createDataFrame([], schema)
    if folder is None:
        return part
    part.write.parquet(f"{folder}/{n}")
    held.destroy()
    return spark.read.schema(part.schema).parquet(*(f"{folder}/{i}" for i in range(n + 1)))


def topk_cosine(queries: DataFrame, candidates: DataFrame, id_col: str, vector: str, k: int, exclude: str | None = None, query_vector: str | None = None) -> DataFrame:
    """query_id, rank, candidate_id, score: the k best candidates of each query by exact cosine, ties by id.

    The queries go out in blocks of a checked size; each partition of candidates keeps k a query, so the
    shuffle holds k rows a query and partition at most. A query is not its own candidate; with exclude, nor
    is any row with the same (not null) value of that column. Rows without an id or a valid vector take no part.
    """
    spark = candidates.sparkSession
    ship_package(spark)
    extra = [F.col(exclude).cast("string").alias("x") if exclude else F.lit(None).cast("string").alias("x")]
    q = queries.where(F.col(id_col).isNotNull() & is_valid(F.col(query_vector or vector))).select(F.col(id_col).alias("id"), *extra, normalize(F.col(query_vector or vector)).alias("v"))
    c = candidates.where(F.col(id_col).isNotNull() & is_valid(F.col(vector))).select(F.col(id_col).alias("id"), *extra, normalize(F.col(vector)).alias("v"))
    kind = dict(c.dtypes)["id"]
    found = _by_blocks(q, 32, c, lambda held: _local_topk(held, k), f"query_id {kind}, candidate_id {kind}, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "candidate_id")
    ranked = found.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "candidate_id", F.round("score", 6).alias("score"))


def _added(q: np.ndarray, c: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of the rows x of q with the rows y of c, added from the left as dot() does."""
    out = np.empty(len(x))
    rows = max(1, SCORES // q.shape[1])
    for at in range(0, len(x), rows):
        out[at : at + rows] = np.add.accumulate(q[x[at : at + rows]] * c[y[at : at + rows]], axis=1)[:, -1] + 0.0
    return out


def _local_topk(held, k: int):
    """Keeps the k best of each query over a partition, from tiles of at most SCORES scores.

    The last bits of a matrix product depend on where in it a vector stands, so it only tells which candidates can be among
    the best. Their scores are added from the left, so that equal vectors have equal scores and ties go by id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = held.value
        qv, qid = q["v"], q["id"].to_numpy(zero_copy_only=False)
        labels = q["x"].to_pylist()
        known = {x: i for i, x in enumerate(dict.fromkeys(x for x in labels if x is not None))}
        qx = np.array([known.get(x, -1) for x in labels])
        slack = 4 * qv.shape[1] * np.finfo(float).eps
        best, ids, kind = np.full((len(qid), k), -np.inf), None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            cv, cid = _matrix(batch.column("v")), batch.column("id").to_numpy(zero_copy_only=False)
            cx = np.array([known.get(x, -2) for x in batch.column("x").to_pylist()])
            if ids is None:
                ids, kind = np.zeros(best.shape, cid.dtype), batch.column("id").type
            for a, at in _tiles(len(qid), len(cid)):
                s = qv[a] @ cv[at].T
                s[qid[a, None] == cid[None, at]] = -np.inf
                if known:
                    s[qx[a, None] == cx[None, at]] = -np.inf
                # All that can reach the k-th best score stay in play.
                least = best[a, -1]
                hit = s >= np.maximum(least - slack, np.finfo(float).min)[:, None]
                if s.shape[1] > k and np.count_nonzero(hit) > 2 * k * len(s):
                    least = np.maximum(least, np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k])
                    hit = s >= np.maximum(least - slack, np.finfo(float).min)[:, None]
                x, y = np.nonzero(hit)
                if not len(x):
                    continue
                # A query with new candidates is ranked anew among them and what it had.
                own_s, own_i = best[a], ids[a]
                again = np.zeros(len(s), bool)
                again[x] = True
                ox, oy = np.nonzero((own_s > -np.inf) & again[:, None])
                score = np.concatenate([own_s[ox, oy], _added(qv[a], cv[at], x, y)])
                found = np.concatenate([own_i[ox, oy], cid[at][y]])
                x = np.concatenate([ox, x])
                order = np.lexsort((found, -score, x))
                x, score, found = x[order], score[order], found[order]
                place = np.arange(len(x)) - np.searchsorted(x, x)
                kept = place < k
                own_s[x[kept], place[kept]], own_i[x[kept], place[kept]] = score[kept], found[kept]
        if ids is None:
            return
        for at in range(0, len(qid), TILE_QUERIES):
            x, y = np.nonzero(best[at : at + TILE_QUERIES] > -np.inf)
            x += at
            yield pa.RecordBatch.from_arrays([pa.array(qid[x], kind), pa.array(ids[x, y], kind), pa.array(best[x, y])], names=["query_id", "candidate_id", "score"])

    return run


def mismatched(df: DataFrame, id_col: str, seed: int) -> DataFrame:
    """id, other: a seeded permutation of a whole table's ids without a fixed point: each goes to the next in the order of a hash, the last to the first.

    A table of fewer than two ids has none. Places come from sorted ranges, so no task orders the table.
    """
    known = df.select(F.col(id_col).alias("id")).distinct()
    order = W.placed(known.withColumn("_h", hash_order(seed, F.col("id"))), ["_h", "id"], "_place")
    n = order.agg(F.count(F.lit(1)).alias("_n"))
    after = order.select(F.col("id").alias("other"), F.col("_place").alias("_at"))
    return with_constants(order, n).where("_n > 1").join(after, F.expr("(_place + 1) % _n = _at")).select("id", "other")


def ranks_of_own(queries: DataFrame, candidates: DataFrame, id_col: str, query_vector: str, vector: str, digits: int = 9, partners: DataFrame | None = None) -> DataFrame:
    """query_id, rank: the place of the candidate with the query's own id among all candidates' inner products; equal scores share the better place.

    With partners (id, other), the place of the candidate other. Scores are counted against the one asked for inside the tasks, so a task sends a number a query.
    Queries without such a candidate have no rank.
    """
    spark = candidates.sparkSession
    ship_package(spark)
    own = candidates.select(F.col(id_col).alias("id"), F.col(vector).alias("_own"))
    if partners is not None:
        own = partners.join(own.withColumnRenamed("id", "other"), "other").select("id", "_own")
    q = queries.select(F.col(id_col).alias("id"), F.col(query_vector).alias("v")).join(own, "id").select("id", "v", F.round(dot(F.col("v"), F.col("_own")), digits).alias("t"))
    c = candidates.select(F.col(vector).alias("v"))
    kind = dict(q.dtypes)["id"]

    def above(held):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            p = held.value
            v, t = p["v"], p["t"].to_numpy(zero_copy_only=False)
            n = np.zeros(len(t), np.int64)
            for batch in batches:
                if not batch.num_rows:
                    continue
                cv = _matrix(batch.column("v"))
                for a, at in _tiles(len(t), len(cv)):
                    n[a] += (np.round(v[a] @ cv[at].T, digits) > t[a, None]).sum(1)
            yield pa.RecordBatch.from_arrays([p["id"], pa.array(n)], names=["query_id", "n"])

        return run

    found = _by_blocks(q, 24, c, above, f"query_id {kind}, n long")
    return found.groupBy("query_id").agg((F.sum("n") + 1).alias("rank"))


def gram(df: DataFrame, vector: str) -> DataFrame:
    """i, j, g: the Gram matrix of the valid vectors, i <= j. A task adds up one matrix of products for each length of vectors, and sends its d * d / 2 numbers."""
    rows = df.where(is_valid(F.col(vector))).select(F.col(vector).cast("array<double>").alias("v"))
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(0)
            size = lists.value_lengths().to_numpy()
            x = np.zeros((batch.num_rows, int(size.max())))
            x[np.arange(x.shape[1])[None, :] < size[:, None]] = lists.flatten().to_numpy()
            g = x.T @ x
            if total is None or len(g) > len(total):
                total, g = g, np.zeros((0, 0)) if total is None else total
            total[: len(g), : len(g)] += g
        if total is not None:
            i, j = np.triu_indices(len(total))
            for at in range(0, len(i), 100_000):
                a, b = i[at : at + 100_000], j[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(total[a, b])], names=["i", "j", "g"])

    return rows.mapInArrow(run, "i int, j int, g double").groupBy("i", "j").agg(F.sum("g").alias("g"))


def matrix_statistics(df: DataFrame, vector: str, size: str | None = None) -> DataFrame:
    """One row on the valid vectors: n, norms, effective rank and its target, mean and deviation of all pairs' inner products.

    The effective rank is the exponential of the entropy of the centred vectors' squared singular values' shares, its target a quarter
    of the components. With size, also the correlation of each vector's mean product with the others and ln(1 + size). Pairs
    aren't formed: sums over them follow from the vectors' sum and Gram matrix, d * (d + 1) / 2 numbers.
    """
    spark = df.sparkSession
    ok = df.where(is_valid(F.col(vector)))
    cells = gram(ok, vector).collect()
    d = max((r["j"] for r in cells), default=-1) + 1
    if not d:
        return spark.createDataFrame([(0, *[None] * 3, 0.0, 0.0, *[None] * 3)], "n long, mean_norm double, norm_min double, norm_max double, effective_rank double, effective_rank_target double, pair_mean double, pair_sd double, size_correlation double")
    g = np.zeros((d, d))
    for r in cells:
        g[r["i"], r["j"]] = g[r["j"], r["i"]] = r["g"]
    total = np.zeros(d)
    for r in ok.select(F.posexplode(vector).alias("i", "x")).groupBy("i").agg(F.sum(F.col("x").cast("double")).alias("x")).collect():  # a row a component
        total[r["i"]] = r["x"]
    one = F.aggregate(F.transform(vector, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x)
    n, fourth = ok.select(one.alias("q")).agg(F.count(F.lit(1)), F.sum(F.col("q") * F.col("q"))).first()
    values = np.clip(np.linalg.eigvalsh(g - np.outer(total, total) / n), 0, None)
    share = values[values > 0] / max(values.sum(), 1e-300)
    pairs = n * (n - 1)
    mean = (total @ total - np.trace(g)) / pairs if pairs else None
    sd = float(np.sqrt(max(((g * g).sum() - fourth) / pairs - mean**2, 0.0))) if pairs else None
    own = (dot(F.col(vector), F.array(*map(F.lit, total.tolist()))) - one) / max(n - 1, 1)
    related = F.corr(own, F.log1p(F.col(size).cast("double"))) if size else F.lit(None).cast("double")
    length = norm(F.col(vector))
    out = ok.agg(F.count(F.lit(1)).alias("n"), F.avg(length).alias("mean_norm"), F.min(length).alias("norm_min"), F.max(length).alias("norm_max"), related.alias("size_correlation"))
    known = {"effective_rank": float(np.exp(-(share * np.log(share)).sum())), "effective_rank_target": 0.25 * d, "pair_mean": mean, "pair_sd": sd}
    return out.select("n", "mean_norm", "norm_min", "norm_max", *(F.lit(v).cast("double").alias(k) for k, v in known.items()), "size_correlation")


def hub_share(top: DataFrame) -> DataFrame:
    """One row: the share of queries whose nearest candidate is the most frequent one."""
    first = top.where("rank = 1").groupBy("candidate_id").agg(F.count(F.lit(1)).alias("n"))
    return first.agg((F.max("n") / F.sum("n")).alias("hub_share"))


def random_pair_cosines(df: DataFrame, id_col: str, vector: str, seed: int = 0) -> DataFrame:
    """a, b, cosine of rows paired by the order of a hash: each row with the next in its range of the hash."""
    rows = df.where(is_valid(F.col(vector))).select(F.col(id_col).alias("a"), normalize(F.col(vector)).alias("v"), hash_order(seed, F.col(id_col)).alias("h"))
    w = Window.partitionBy(F.substring("h", 1, 2)).orderBy("h", "a")
    return rows.withColumn("b", F.lead("a").over(w)).withColumn("u", F.lead("v").over(w)).where("b IS NOT NULL").select("a", "b", dot(F.col("v"), F.col("u")).alias("cosine"))


def nearest_cosines(df: DataFrame, id_col: str, vector: str, of: Column) -> DataFrame:
    """One row: number, mean, standard deviation and median of the cosines between the rows that the condition names and their nearest other rows."""
    top = topk_cosine(df.where(of), df, id_col, vector, 1)
    return cosine_statistics(top, "score")


def cosine_statistics(df: DataFrame, cosine: str) -> DataFrame:
    """One row: n, mean, sd and median of a column of cosines, which is written first and worked out once."""
    path = f"{work_folder(df.sparkSession)}/cosines"
    df.select(F.col(cosine).cast("double").alias("c")).write.parquet(path)
    kept = df.sparkSession.read.schema("c double").parquet(path)
    moments = kept.agg(F.count("c").alias("n"), F.avg("c").alias("mean"), F.stddev_pop("c").alias("sd"))
    return with_constants(moments, exact_quantiles(kept, [], "c", {"median": 0.5}))


def two_stage(queries: DataFrame, candidates: DataFrame, id_col: str, coarse: str, fine: str, wide: int, k: int) -> DataFrame:
    """The wide best by the coarse vectors, ranked again by the fine ones."""
    first = topk_cosine(queries, candidates, id_col, coarse, wide)
    q = queries.select(F.col(id_col).alias("query_id"), normalize(F.col(fine)).alias("_q"))
    c = candidates.select(F.col(id_col).alias("candidate_id"), normalize(F.col(fine)).alias("_c"))
    s = first.select("query_id", "candidate_id").join(q, "query_id").join(c, "candidate_id").withColumn("score", dot(F.col("_q"), F.col("_c")))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "candidate_id")
    return s.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k).select("query_id", "rank", "candidate_id", F.round("score", 6).alias("score"))


def overlap_gate(a: Column, b: Column, least: int = 3, coverage: float = 0.5) -> Column:
    """struct(shared, coverage, jaccard, ok): whether two sets of names share enough to be compared."""
    shared = F.size(F.array_intersect(a, b))
    cover = shared / F.nullif(F.least(F.size(a), F.size(b)), F.lit(0))
    return F.struct(shared.alias("shared"), cover.alias("coverage"), (shared / F.nullif(F.size(F.array_union(a, b)), F.lit(0))).alias("jaccard"), F.coalesce((shared >= least) & (cover >= coverage), F.lit(False)).alias("ok"))


def gated_neighbours(pairs: DataFrame, rows: DataFrame, key: str, name: str, least: int = 3, coverage: float = 0.5) -> DataFrame:
    """left, right, shared, coverage, jaccard: the pairs (left, right) of keys whose names overlap enough to be compared."""
    held = rows.where(F.col(name).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.collect_set(name).alias("_m"))
    side = lambda s: held.select(F.col("_k").alias(s), F.col("_m").alias(f"_{s}"))
    both = pairs.select("left", "right").join(side("left"), "left").join(side("right"), "right")
    return both.select("left", "right", overlap_gate(F.col("_left"), F.col("_right"), least, coverage).alias("_g")).where("_g.ok").select("left", "right", "_g.shared", "_g.coverage", "_g.jaccard")


def shape_counts(df: DataFrame, vector: str, *by: str) -> DataFrame:
    """How many vectors there are of each length, in all or by other columns; null vectors have none."""
    return df.groupBy(*by, F.size(vector).alias("length")).agg(F.count(F.lit(1)).alias("n")) if by else df.groupBy(F.size(vector).alias("length")).agg(F.count(F.lit(1)).alias("n"))
