"""Independent checks of written artifacts (Q5): digests of key ranges, differing ranges read again, incidence against memberships."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caselight.session import dealt

RANGES = 256


def row_digest(columns: list[str]) -> Column:
    """SHA-256 of a row's values as text; a null isn't an empty text."""
    cells = F.concat(*(F.concat(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x1e")), F.lit("\x1f")) for c in columns))
    return F.sha2(cells.cast("binary"), 256)


def write_artifact(df: DataFrame, path: str, keys: list[str], ranges: int = RANGES) -> None:
    """The rows in folders by a hash of their key, and beside them a digest of each folder: counts and sums over row digests, so order doesn't matter and repeats count."""
    placed = df.withColumn("_range", F.pmod(F.xxhash64(*(F.col(f"`{k}`") for k in keys)), F.lit(ranges)).cast("int"))
    placed.repartition("_range").write.partitionBy("_range").mode("error").parquet(f"{path}/rows")
    stored = df.sparkSession.read.schema(placed.schema).parquet(f"{path}/rows")
    digest = row_digest(sorted(df.columns))
    sums = [F.sum(F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(20,0)")).cast("string").alias(f"_s{at}") for at in (1, 16)]
    stored.groupBy("_range").agg(F.count(F.lit(1)).alias("rows"), *sums).select("_range", "rows", F.concat_ws(":", "_s1", "_s16").alias("digest")).write.mode("error").parquet(f"{path}/digests")


def differing_ranges(spark: SparkSession, left: str, right: str) -> list[int]:
    """The ranges whose digests differ; reads a row a range of each artifact, at most as many as there are ranges."""
    a, b = (spark.read.parquet(f"{p}/digests") for p in (left, right))
    a, b = a.select("_range", F.struct("rows", "digest").alias("l")), b.select("_range", F.struct("rows", "digest").alias("r"))
    rows = a.join(b, "_range", "full_outer").where(~F.col("l").eqNullSafe(F.col("r"))).select("_range").collect()
    return sorted(r[0] for r in rows)


def differences(spark: SparkSession, left: str, right: str, keys: list[str]) -> DataFrame:
    """keys, reason, columns: rows that one artifact lacks or has more often, and rows of one key whose named columns differ. Only differing ranges are read.

    A key that stands several times on either side is compared by its rows as a multiset: "changed" names no columns then.
    """
    at = differing_ranges(spark, left, right)
    a, b = (spark.read.parquet(f"{p}/rows").where(F.col("_range").isin(at)).drop("_range") for p in (left, right))
    columns = [c for c in a.columns if c not in keys]
    if sorted(a.columns) != sorted(b.columns):
        raise ValueError("the artifacts have different columns")

    def gathered(df: DataFrame, side: str) -> DataFrame:
        values = F.struct(*(F.col(f"`{c}`").cast("string").alias(c) for c in columns)) if columns else F.struct(F.lit(1).alias("_one"))
        digest = row_digest(sorted(df.columns))
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"n{side}"), F.sum(F.conv(F.substring(digest, 1, 15), 16, 10).cast("decimal(20,0)")).alias(f"s{side}"), F.min(values).alias(f"v{side}"))

    same = reduce(lambda x, y: x & y, (F.col(f"_l.`{k}`").eqNullSafe(F.col(f"_r.`{k}`")) for k in keys))
    both = gathered(a, "l").alias("_l").join(gathered(b, "r").alias("_r"), same, "full_outer")
    reason = F.when(F.col("nr").isNull(), "missing").when(F.col("nl").isNull(), "extra").when(F.col("nl") != F.col("nr"), "count").when(~F.col("sl").eqNullSafe(F.col("sr")), "changed")
    single = (F.col("nl") == 1) & (F.col("nr") == 1)
    named = F.array_compact(F.array(*(F.when(single & ~F.col(f"vl.`{c}`").eqNullSafe(F.col(f"vr.`{c}`")), F.lit(c)) for c in sorted(columns)))) if columns else F.array().cast("array<string>")
    picked = [F.coalesce(F.col(f"_l.`{k}`"), F.col(f"_r.`{k}`")).alias(k) for k in keys]
    return both.select(*picked, reason.alias("reason"), F.when(reason == "changed", F.array_join(named, ",")).otherwise("").alias("columns")).where("reason IS NOT NULL")


def incidence_differences(incidence: DataFrame, memberships: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, edge, reason: cells (row, col) of an incidence matrix that no membership (node, edge) stands behind, memberships without a cell, and repeated cells.

    nodes: node, index and edges: edge, index name the rows and columns; names are null where a cell lies outside them.
    """
    cells = dealt(incidence, "row").groupBy("row", "col").agg(F.count(F.lit(1)).alias("n"))
    named = dealt(cells.join(nodes.select("node", F.col("index").alias("row")), "row", "left"), "col").join(edges.select("edge", F.col("index").alias("col")), "col", "left")
    want = dealt(memberships.select("node", "edge"), "node", "edge").distinct().withColumn("_m", F.lit(True))
    outside = named.where("node IS NULL OR edge IS NULL").select("node", "edge", F.lit("outside").alias("reason"))
    both = dealt(named.where("node IS NOT NULL AND edge IS NOT NULL"), "node", "edge").join(want, ["node", "edge"], "full_outer")
    reason = F.when(F.col("_m").isNull(), "no membership").when(F.col("n").isNull(), "no cell").when(F.col("n") > 1, "repeated")
    return both.select("node", "edge", reason.alias("reason")).where("reason IS NOT NULL").unionByName(outside)
