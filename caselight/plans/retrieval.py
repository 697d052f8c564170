"""Queries on vectors, exact cosine retrieval and rank fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caselight.operators import fusion, vectors
from caselight.plans import query
from caselight.session import table

_UNIT = "list_transform({v}, lambda x: x::DOUBLE / sqrt(list_sum(list_transform({v}, lambda y: y::DOUBLE * y::DOUBLE))))"


def _unit(v: str) -> str:
    return _UNIT.format(v=v)


def _topk(units: str, extra: str = "", k: int = 20) -> str:
    return f"""
u AS ({units}),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS candidate_id, list_inner_product(q.v, c.v) AS s
      FROM u q, u c WHERE q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id {extra}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, candidate_id) AS rank FROM s)
"""


_SELECT = "SELECT query_id, CAST(rank AS BIGINT) AS rank, candidate_id, round(s, 6) AS score FROM r WHERE rank <= {k}"


@query("WITH " + _topk(f"SELECT vec_id, label, {_unit('embedding')} AS v FROM embeddings") + _SELECT.format(k=20))
def topk_cosine_self_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows by cosine for every hundredth id, the query itself excluded."""
    emb = table(spark, sf_dir, "embeddings")
    return vectors.topk_cosine(emb.where("vec_id % 100 = 0"), emb, "vec_id", "embedding", 20)


@query("WITH " + _topk(f"SELECT vec_id, label, {_unit('embedding')} AS v FROM embeddings", "AND q.label <> c.label", 10) + _SELECT.format(k=10))
def topk_cosine_label_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without candidates of the query's own label (patient); rows whose label isn't known take no part."""
    emb = table(spark, sf_dir, "embeddings").where("label IS NOT NULL")
    return vectors.topk_cosine(emb.where("vec_id % 100 = 0"), emb, "vec_id", "embedding", 10, exclude="label")


_BLOCKS = f"SELECT vec_id, {_unit('list_concat(' + _unit('embedding[1:32]') + ', list_transform(' + _unit('embedding[33:64]') + ', lambda z: z * 0.5))')} AS v FROM embeddings"


@query("WITH " + _topk(_BLOCKS) + _SELECT.format(k=10))
def fused_two_block_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two blocks normalised, weighted 1 and 0.5, joined and normalised again."""
    emb = table(spark, sf_dir, "embeddings")
    v = vectors.fuse([(F.slice("embedding", 1, 32), 1.0), (F.slice("embedding", 33, 32), 0.5)])
    emb = emb.select("vec_id", v.alias("v"))
    return vectors.topk_cosine(emb.where("vec_id % 100 = 0"), emb, "vec_id", "v", 10)


@query(f"""
WITH d AS (SELECT vec_id, {_unit('embedding[33:64]')} AS d, {_unit('embedding[1:32]')} AS q FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS candidate_id, list_inner_product(a.q, b.d) AS s FROM d a, d b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, candidate_id) AS rank FROM s)
SELECT query_id, CAST(rank AS BIGINT) AS rank, candidate_id, round(s, 6) AS score FROM r WHERE rank <= 10
""")
def asymmetric_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2: queries and candidates have different vectors."""
    emb = table(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", 1, 32).alias("q"), F.slice("embedding", 33, 32).alias("d"))
    return vectors.topk_cosine(emb.where("vec_id % 100 = 0"), emb, "vec_id", "d", 10, query_vector="q")


@query(f"SELECT vec_id, round(v, 6) AS x, CAST(i AS BIGINT) AS i FROM (SELECT vec_id, unnest({_unit('embedding[1:16]')}) AS v, generate_subscripts(embedding[1:16], 1) AS i FROM embeddings)")
def prefix_renormalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 16 components, normalised again."""
    emb = table(spark, sf_dir, "embeddings").select("vec_id", vectors.prefix(F.col("embedding"), 16).alias("v"))
    return emb.select("vec_id", F.posexplode("v").alias("i", "x")).select("vec_id", F.round("x", 6).alias("x"), (F.col("i") + 1).cast("long").alias("i"))


@query("""
SELECT label, CAST(i - 1 AS BIGINT) AS i, round(avg(x::DOUBLE), 6) AS x FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i
""")
def mean_pool_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean vector of each label."""
    pooled = vectors.mean_pool(table(spark, sf_dir, "embeddings"), "label", "embedding")
    return pooled.select("label", F.posexplode("embedding").alias("i", "x")).select("label", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


@query("SELECT vec_id, len(embedding) = 64 AND sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))) > 1e-12 AS valid FROM embeddings")
def vector_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10: finite, not zero, of the expected length."""
    return table(spark, sf_dir, "embeddings").select("vec_id", vectors.is_valid(F.col("embedding"), 64).alias("valid"))


def _three_lists(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    emb = table(spark, sf_dir, "embeddings")
    out = {}
    for name, start in (("a", 1), ("b", 22), ("c", 43)):
        part = emb.select("vec_id", F.slice("embedding", start, 21).alias("v"))
        out[name] = vectors.topk_cosine(part.where("vec_id % 100 = 0"), part, "vec_id", "v", 20)
    return out


_THREE = f"""
WITH e AS (SELECT vec_id, unnest([{{'n': 'a', 'v': {_unit('embedding[1:21]')}}}, {{'n': 'b', 'v': {_unit('embedding[22:42]')}}}, {{'n': 'c', 'v': {_unit('embedding[43:63]')}}}]) AS x FROM embeddings),
s AS (SELECT q.x.n AS source, q.vec_id AS query_id, c.vec_id AS candidate_id, list_inner_product(q.x.v, c.x.v) AS s FROM e q, e c
      WHERE q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND q.x.n = c.x.n),
r AS (SELECT source, query_id, candidate_id, round(s, 6) AS score, row_number() OVER (PARTITION BY source, query_id ORDER BY s DESC, candidate_id) AS rank FROM s),
t AS (SELECT *, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 0.5 END AS n
      FROM r WHERE rank <= 20 WINDOW w AS (PARTITION BY source, query_id)),
g AS (SELECT query_id, candidate_id, count(DISTINCT source) AS votes, avg(rank) AS mean_rank, max(n) AS best FROM t GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, CASE WHEN votes > 1 THEN mean_rank ELSE -best END, candidate_id) AS rank FROM g)
"""


@query(_THREE + "SELECT query_id, candidate_id, CAST(votes AS BIGINT) AS votes, round(mean_rank, 6) AS mean_rank, round(best, 6) AS best_normalised, CAST(rank AS BIGINT) AS rank FROM o WHERE rank <= 20")
def vote_fusion_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rankings fused by votes."""
    out = fusion.vote(_three_lists(spark, sf_dir))
    return out.select("query_id", "candidate_id", "votes", F.round("mean_rank", 6).alias("mean_rank"), F.round("best_normalised", 6).alias("best_normalised"), "rank")


@query("""
SELECT vec_id AS query_id, unnest(CASE (vec_id // 100) % 6 WHEN 1 THEN ['size', 'ranks'] WHEN 2 THEN ['self'] WHEN 3 THEN ['repeated'] WHEN 4 THEN ['not_finite'] WHEN 5 THEN ['rising'] ELSE [] END) AS reason FROM embeddings WHERE vec_id % 100 = 0
""")
def ranked_list_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked lists that break their contract, each sixth one in another way: one short, itself, one twice, a score that is null, one that rises."""
    top = topk_cosine_self_excluded(spark, sf_dir)
    m, r = F.col("query_id") / 100 % 6, F.col("rank")
    before = F.lag("candidate_id").over(Window.partitionBy("query_id").orderBy("rank"))
    other = F.when((m == 2) & (r == 3), F.col("query_id")).when((m == 3) & (r == 2), before).otherwise(F.col("candidate_id"))
    score = F.when((m == 4) & (r == 5), F.lit(None)).when((m == 5) & (r == 4), F.lit(2.0)).otherwise(F.col("score"))
    planted = top.select("query_id", "rank", other.alias("candidate_id"), score.alias("score")).where(~((m == 1) & (r == 20)))
    return fusion.list_violations(planted)


@query("""
SELECT vec_id AS query_id, CAST(r AS BIGINT) AS rank, CASE r WHEN 1 THEN 'candidate' WHEN 2 THEN 'score' WHEN 3 THEN 'missing' ELSE 'extra' END AS reason FROM embeddings, (SELECT unnest([1, 2, 3, 21]) AS r) WHERE vec_id % 200 = 100 OR (vec_id % 100 = 0 AND r = 21)
""")
def replayed_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packaged lists against computed ones, with faults in every second list and one rank too many in all."""
    top = topk_cosine_self_excluded(spark, sf_dir)
    odd, r = F.col("query_id") % 200 == 100, F.col("rank")
    packaged = top.select("query_id", "rank", F.when(odd & (r == 1), F.lit(-1)).otherwise(F.col("candidate_id")).alias("candidate_id"), F.when(odd & (r == 2), F.col("score") + 0.00001).otherwise(F.col("score")).alias("score")).where(~(odd & (r == 3)))
    more = top.where("rank = 20").select("query_id", F.lit(21).cast("long").alias("rank"), "candidate_id", "score")
    return fusion.replay_differences(packaged.unionByName(more), top)


@query("WITH " + _topk(f"SELECT vec_id, {_unit('embedding[1:16]')} AS v FROM embeddings") + f""",
f AS (SELECT vec_id, {_unit('embedding')} AS v FROM embeddings),
z AS (SELECT r.query_id, r.candidate_id, list_inner_product(a.v, b.v) AS s FROM r JOIN f a ON a.vec_id = r.query_id JOIN f b ON b.vec_id = r.candidate_id WHERE rank <= 50),
y AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, candidate_id) AS rank FROM z)
SELECT query_id, CAST(rank AS BIGINT) AS rank, candidate_id, round(s, 6) AS score FROM y WHERE rank <= 10
""")
def two_stage_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """50 candidates by a prefix, ranked again by the whole vector."""
    emb = table(spark, sf_dir, "embeddings").withColumn("coarse", F.slice("embedding", 1, 16))
    return vectors.two_stage(emb.where("vec_id % 100 = 0"), emb, "vec_id", "coarse", "embedding", 50, 10)


@query()
def effective_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of vectors, mean norm and effective rank of the embeddings."""
    return vectors.matrix_statistics(table(spark, sf_dir, "embeddings"), "embedding")


@query(f"""
WITH u AS (SELECT vec_id, {_unit('embedding')} AS v FROM embeddings), p AS (SELECT a.vec_id, list_inner_product(a.v, b.v) AS s FROM u a, u b WHERE a.vec_id <> b.vec_id), m AS (SELECT vec_id, avg(s) AS m FROM p GROUP BY 1)
SELECT (SELECT count(*) FROM u) AS n, round(avg(s), 6) AS pair_mean, round(stddev_pop(s), 6) AS pair_sd, (SELECT round(corr(m, ln(1 + vec_id % 9)), 6) FROM m) AS size_correlation FROM p
""")
def pair_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and deviation of all pairs' cosines, and how a vector's mean cosine goes with a size, without forming pairs."""
    e = table(spark, sf_dir, "embeddings").select(vectors.normalize(F.col("embedding")).alias("v"), (F.col("vec_id") % 9).alias("size"))
    return vectors.matrix_statistics(e, "v", "size").select("n", *(F.round(c, 6).alias(c) for c in ("pair_mean", "pair_sd", "size_correlation")))


@query("WITH " + _topk(f"SELECT vec_id, {_unit('embedding')} AS v FROM embeddings") + ", n AS (SELECT candidate_id, count(*) AS n FROM r WHERE rank = 1 GROUP BY 1) SELECT max(n) / sum(n) AS hub_share FROM n")
def hub_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the most frequent nearest neighbour is one."""
    return vectors.hub_share(topk_cosine_self_excluded(spark, sf_dir))


@query("WITH " + _topk(f"SELECT vec_id, label, {_unit('embedding')} AS v FROM embeddings") + ", n AS (SELECT round(s, 6) AS s FROM r WHERE rank = 1) SELECT count(*) AS n, round(avg(s), 6) AS mean, round(stddev_pop(s), 6) AS sd, round(quantile_cont(s, 0.5), 6) AS median FROM n")
def nearest_cosines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of the cosines between every hundredth row and its nearest other row."""
    out = vectors.nearest_cosines(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 100 == 0)
    return out.select("n", *(F.round(c, 6).alias(c) for c in ("mean", "sd", "median")))


@query(f"""
WITH h AS (SELECT vec_id, sha256('0:' || vec_id) AS h, {_unit('embedding')} AS v FROM embeddings), p AS (SELECT vec_id AS a, lead(vec_id) OVER w AS b, v, lead(v) OVER w AS u FROM h WINDOW w AS (PARTITION BY substr(h, 1, 2) ORDER BY h, vec_id))
SELECT a, b, round(list_inner_product(v, u), 6) AS cosine FROM p WHERE b IS NOT NULL
""")
def random_pair_cosines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosines of seeded random pairs."""
    return vectors.random_pair_cosines(table(spark, sf_dir, "embeddings"), "vec_id", "embedding").withColumn("cosine", F.round("cosine", 6))


@query(f"""
WITH u AS (SELECT vec_id, {_unit('embedding[1:32]')} AS a, {_unit('embedding')} AS b FROM embeddings),
s AS (SELECT q.vec_id AS q, c.vec_id AS c, list_inner_product(q.a, list_slice(c.b, 1, 32)) AS s FROM u q, u c WHERE q.vec_id % 100 = 0),
x AS (SELECT q, round(s, 9) AS s, c FROM s),
r AS (SELECT x.q, 1 + count(*) FILTER (WHERE x.s > t.s) AS rank FROM x JOIN x t ON t.q = x.q AND t.c = t.q GROUP BY x.q)
SELECT avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END) AS recall_at_1, avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END) AS recall_at_5, avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0.0 END) AS recall_at_10, quantile_cont(rank, 0.5) AS median_rank FROM r
""")
def cross_view_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall and median rank of the same row in another view."""
    emb = table(spark, sf_dir, "embeddings")
    whole = emb.select("vec_id", vectors.normalize(F.slice("embedding", 1, 32)).alias("a"), F.slice(vectors.normalize(F.col("embedding")), 1, 32).alias("b"))
    return fusion.rank_metrics(vectors.ranks_of_own(whole.where("vec_id % 100 = 0"), whole, "vec_id", "a", "b"))
