"""Rank fusion and checks of ranked lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caselight.operators.aggregates import exact_quantiles
from caselight.operators.joins import with_constants
from caselight.operators.windows import min_max
from caselight.session import work_folder


def union_candidates(lists: dict[str, DataFrame]) -> DataFrame:
    """query_id, candidate_id, rank, score, source of all lists."""
    parts = [df.select("query_id", "candidate_id", "rank", "score", F.lit(name).alias("source")) for name, df in sorted(lists.items())]
    return reduce(DataFrame.unionByName, parts)


def vote(lists: dict[str, DataFrame], top: int = 20) -> DataFrame:
    """query_id, rank, candidate_id, votes, mean_rank, best_normalised of the first top candidates.

    More sources win; among candidates of two or more the smaller mean rank, among those of one the larger
    normalised score; then the smaller id. Two or more lists.
    """
    if len(lists) < 2:
        raise ValueError("fusion takes two lists or more")
    scored = min_max(union_candidates(lists), ["query_id", "source"], "score")
    one = scored.groupBy("query_id", "candidate_id").agg(F.countDistinct("source").alias("votes"), F.avg("rank").alias("mean_rank"), F.max("normalised").alias("best_normalised"))
    second = F.when(F.col("votes") > 1, F.col("mean_rank")).otherwise(-F.col("best_normalised"))
    w = Window.partitionBy("query_id").orderBy(F.desc("votes"), second, "candidate_id")
    return one.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= top)


def list_violations(ranked: DataFrame, size: int = 20) -> DataFrame:
    """query_id, reason of lists that break the contract: size, ranks 1 to size, no self, no repeats, finite scores that don't rise."""
    w = Window.partitionBy("query_id").orderBy("rank")
    rows = ranked.withColumn("_up", F.coalesce(F.col("score") > F.lag("score").over(w), F.lit(False)))
    bad = rows.groupBy("query_id").agg(
        (F.count(F.lit(1)) != size).alias("size"),
        ((F.min("rank") != 1) | (F.max("rank") != size) | (F.countDistinct("rank") != size)).alias("ranks"),
        F.max(F.col("candidate_id") == F.col("query_id")).alias("self"),
        (F.countDistinct("candidate_id") != F.count(F.lit(1))).alias("repeated"),
        F.max(F.col("score").isNull() | F.isnan("score")).alias("not_finite"),
        F.max("_up").alias("rising"),
    )
    reasons = ["size", "ranks", "self", "repeated", "not_finite", "rising"]
    return bad.select("query_id", F.explode(F.filter(F.array(*(F.when(F.col(r), F.lit(r)) for r in reasons)), lambda x: x.isNotNull())).alias("reason"))


def rank_metrics(ranks: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """recall_at_k and median_rank of the true candidates' ranks, which are counted first and worked out once."""
    path = f"{work_folder(ranks.sparkSession)}/ranks"
    ranks.groupBy("rank").agg(F.count(F.lit(1)).alias("n")).write.parquet(path)
    counts = ranks.sparkSession.read.schema("rank long, n long").parquet(path)
    recalls = counts.agg(*((F.sum(F.when(F.col("rank") <= k, F.col("n")).otherwise(0)) / F.sum("n")).alias(f"recall_at_{k}") for k in ks))
    return with_constants(recalls, exact_quantiles(counts, [], "rank", {"median_rank": 0.5}, weight="n"))


def retrieval_metrics(scores: DataFrame, truth: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """recall_at_k and median_rank of the true candidate among each query's scores."""
    true = truth.join(scores, ["query_id", "candidate_id"]).select("query_id", F.col("score").alias("_t"))
    return rank_metrics(scores.join(true, "query_id").groupBy("query_id").agg((F.count_if(F.col("score") > F.col("_t")) + 1).alias("rank")), ks)


def replay_differences(packaged: DataFrame, computed: DataFrame, digits: int = 6) -> DataFrame:
    """query_id, rank, reason: places of packaged lists whose candidate or score (as a decimal of so many digits) differs from the computed list's, or that only one of them has."""
    left = packaged.select("query_id", "rank", F.col("candidate_id").alias("_pc"), F.col("score").cast(f"decimal(18,{digits})").alias("_ps"), F.lit(True).alias("_p"))
    right = computed.select("query_id", "rank", F.col("candidate_id").alias("_cc"), F.col("score").cast(f"decimal(18,{digits})").alias("_cs"), F.lit(True).alias("_c"))
    reason = F.when(F.col("_c").isNull(), "extra").when(F.col("_p").isNull(), "missing").when(F.col("_pc") != F.col("_cc"), "candidate").when(F.col("_ps") != F.col("_cs"), "score")
    return left.join(right, ["query_id", "rank"], "full_outer").select("query_id", "rank", reason.alias("reason")).where("reason IS NOT NULL")
