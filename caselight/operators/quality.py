"""Constraints, validation and lineage."""

from __future__ import annotations

import re
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caselight.functions import text
from caselight.operators.joins import with_constants


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once; empty if they are unique."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def orphans(df: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    """Different keys that the parent table lacks; empty if all are there."""
    right = parent.select(F.col(parent_key or key).alias(key))
    return df.select(key).where(F.col(key).isNotNull()).distinct().join(right, key, "left_anti")


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """check, n: rows that break each rule; one pass. Null counts as broken."""
    names = sorted(rules)
    one = df.agg(*(F.count_if(~F.coalesce(rules[n], F.lit(False))).alias(n) for n in names))
    return one.select(F.inline(F.array(*(F.struct(F.lit(n).alias("check"), F.col(n).alias("n")) for n in names))))


def constraint_report(parts: dict[str, DataFrame]) -> DataFrame:
    """check, n: the size of each table of violations."""
    counted = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check"), "n") for name, df in sorted(parts.items())]
    return reduce(DataFrame.unionByName, counted)


def leaking_keys(df: DataFrame, key: str, split: str) -> DataFrame:
    """Keys in more than one split."""
    return df.groupBy(key).agg(F.countDistinct(split).alias("n_splits")).where("n_splits > 1")


def forbidden_columns(df: DataFrame, names: list[str]) -> list[str]:
    """The columns that must not be there."""
    low = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() in low]


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """side, rows: what one table has more often than the other; empty if they are equal as multisets."""
    b = b.select(*a.columns)
    extra = a.exceptAll(b).withColumn("side", F.lit("left"))
    return extra.unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def contiguous(df: DataFrame, keys: list[str], index: str) -> DataFrame:
    """Groups whose index doesn't run from 0 without gaps."""
    g = df.groupBy(*keys) if keys else df.groupBy()
    return g.agg(F.min(index).alias("low"), F.max(index).alias("high"), F.countDistinct(index).alias("n")).where("low <> 0 OR high <> n - 1")


def asymmetric(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Edges whose reverse is missing."""
    back = edges.select(F.col(b).alias(a), F.col(a).alias(b))
    return edges.select(a, b).distinct().join(back, [a, b], "left_anti")


def manifest(tables: dict[str, DataFrame], config: dict[str, str]) -> DataFrame:
    """table, rows, digest: counts and order-free digests of the tables with the run's settings.

    A digest is the sums of two parts of each row's SHA-256, so rows that repeat count as often as they occur. A row is its columns
    in the order of their names, as text, a unit separator after each and a null as a lone record separator.
    """
    parts = []
    for name, df in sorted(tables.items()):
        cells = F.concat(*(F.concat(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x1e")), F.lit("\x1f")) for c in sorted(df.columns)))
        digest = F.sha2(cells.cast("binary"), 256)
        sums = [F.coalesce(F.sum(F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(20,0)")), F.lit(0)).cast("string") for at in (1, 16)]
        parts.append(df.agg(F.count(F.lit(1)).alias("rows"), F.concat_ws(":", *sums).alias("digest")).select(F.lit(name).alias("table"), "rows", "digest"))
    out = reduce(DataFrame.unionByName, parts)
    return out.withColumn("config", F.to_json(F.create_map(*(F.lit(x) for kv in sorted(config.items()) for x in kv))))


def fingerprint(stats: DataFrame) -> DataFrame:
    """fingerprint: SHA-256 of the rows' canonical JSON in order; for small tables of statistics."""
    rows = F.array_sort(F.collect_list(F.to_json(F.struct(*sorted(stats.columns)))))
    return stats.agg(F.sha2(F.array_join(rows, "\n").cast("binary"), 256).alias("fingerprint"))


def file_inventory(spark: SparkSession, root: str) -> DataFrame:
    """path (from the root on), bytes, sha256 of every file below a folder; each file is read in one piece by the task that hashes it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = re.sub(r"^[a-z]+:/*|^/+|/+$", "", root) + "/"
    inner = lambda c: F.replace(F.regexp_replace(c, r"^[a-z]+:/+", ""), F.lit(base), F.lit(""))
    found = files.select(inner(F.col("path")).alias("path"), F.col("length").alias("bytes"), text.file_sha256(F.col("content")).alias("sha256"))
    # Empty files are listed, but have no part that is read.
    listed = spark.createDataFrame([(unquote(f),) for f in files.inputFiles()], "path string").select(inner(F.col("path")).alias("path"))
    empty = listed.join(found.select("path"), "path", "left_anti").select("path", F.lit(0).cast("long").alias("bytes"), F.sha2(F.lit("").cast("binary"), 256).alias("sha256"))
    return found.unionByName(empty)


def inventory_differences(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """path, reason: files that are missing, extra, or differ in size or digest; empty if the folders agree."""
    e = expected.select("path", F.col("bytes").alias("_b"), F.col("sha256").alias("_s"), F.lit(True).alias("_e"))
    a = actual.select("path", "bytes", "sha256", F.lit(True).alias("_a"))
    reason = F.when(F.col("_a").isNull(), "missing").when(F.col("_e").isNull(), "extra").when((F.col("bytes") != F.col("_b")) | (F.col("sha256") != F.col("_s")), "mismatch")
    return e.join(a, "path", "full_outer").select("path", reason.alias("reason")).where("reason IS NOT NULL")


def relocated(paths: DataFrame, path: str, old_root: str, new_root: str) -> DataFrame:
    """The rows with the root of their paths exchanged; paths outside the old root stay."""
    inside = F.startswith(F.col(path), F.lit(old_root.rstrip("/") + "/"))
    return paths.withColumn(path, F.when(inside, F.concat(F.lit(new_root.rstrip("/")), F.substring(F.col(path), F.lit(len(old_root.rstrip("/")) + 1), F.length(path)))).otherwise(F.col(path)))


def late_events(events: DataFrame, cutoff: str, time: str = "time") -> DataFrame:
    """Events after their target's cutoff, or without a time: each is a leak."""
    return events.where(F.col(time).isNull() | (F.col(time) > F.col(cutoff)))


def embedding_gates(diagnostics: DataFrame) -> DataFrame:
    """gate, passed of one row of diagnostics of one split, and whether all gates are passed.

    The row holds n_not_finite, norm_min, norm_max, effective_rank, effective_rank_target, top1_hub, size_correlation and recall_delta.
    """
    c = F.col
    gates = {
        "finite": c("n_not_finite") == 0, "l2_norm": (c("norm_min") >= 1.0 - 1e-4) & (c("norm_max") <= 1.0 + 1e-4), "effective_rank": c("effective_rank") >= c("effective_rank_target"),
        "top1_hub": c("top1_hub") <= 0.05, "graph_size_correlation": F.abs("size_correlation") < 0.20, "cross_view_beats_shuffled_null": c("recall_delta") > 0.05,
    }
    known = {n: F.coalesce(g, F.lit(False)) for n, g in gates.items()}
    every = reduce(lambda a, b: a & b, known.values())
    return diagnostics.select(F.inline(F.array(*(F.struct(F.lit(n).alias("gate"), g.alias("passed")) for n, g in [*known.items(), ("all", every)]))))


def review_violations(reviews: DataFrame, selections: DataFrame, candidates: DataFrame, key: str = "review_id", least: int = 1, most: int = 19, size: int = 20) -> DataFrame:
    """key, reason: reviews with a wrong number of candidates or selections, selections that aren't candidates, or 'none' beside selections."""
    side = lambda df, c, s: df.select(key, "candidate_id", F.lit(c).alias("_c"), F.lit(s).alias("_s"))
    # Both tables move once, by review: a join would broadcast candidates whose number Spark can't tell before they are made.
    moved = side(candidates, 1, 0).unionByName(side(selections, 0, 1)).repartition(key)
    one = moved.groupBy(key, "candidate_id").agg(F.sum("_c").alias("_c"), F.sum("_s").alias("_s"))
    strange = F.when((F.col("_c") == 0) | F.col("candidate_id").isNull(), F.col("_s"))
    n = one.groupBy(key).agg(F.sum("_c").alias("n_candidates"), F.sum("_s").alias("n_selected"), F.sum(strange).alias("n_strange"))
    df = reviews.join(n.hint("merge"), key, "left").na.fill(0, ["n_candidates", "n_selected", "n_strange"])
    none = F.coalesce(F.col("none_similar"), F.lit(False))
    reasons = F.array(
        F.when(F.col("n_candidates") != size, "candidates"), F.when(~none & ~F.col("n_selected").between(least, most), "selections"),
        F.when(F.col("n_strange") > 0, "not_a_candidate"), F.when(none & (F.col("n_selected") > 0), "none_with_selections"),
    )
    return df.select(key, F.explode(F.filter(reasons, lambda x: x.isNotNull())).alias("reason"))


def valid_ratings(names: list[str], low: int = 1, high: int = 5) -> Column:
    """All ratings are whole numbers within the bounds."""
    out = F.lit(True)
    for n in names:
        out = out & F.coalesce(F.col(n).cast("double").between(low, high) & (F.col(n).cast("double") == F.floor(F.col(n).cast("double"))), F.lit(False))
    return out


def latest(log: DataFrame, key: str, at: str) -> DataFrame:
    """The newest row of each key of an append-only log."""
    values = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*values), F.struct(at, *(v for v in values if v != at))).alias("_r")).select(key, *(F.col(f"_r.{v}").alias(v) for v in values))


def export_join(ranking: DataFrame, reviews: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The ranking with the newest review of each row."""
    values = [c for c in reviews.columns if c not in keys]
    newest = reviews.groupBy(*keys).agg(F.max_by(F.struct(*values), at).alias("_r"))
    return ranking.join(newest, keys, "left").select(*ranking.columns, *(F.col(f"_r.{v}").alias(v) for v in values))


def packed_parts(df: DataFrame, key: str, budget: int) -> DataFrame:
    """key, bytes, part: whole groups packed into numbered parts of at most budget bytes of JSON lines; a group over the budget is a part of its own, with over true.

    Sizes are exact. Groups of more than half the budget are parts of their own; a smaller one goes to the part that its place in the running sum of the
    others falls in, half a budget each, which the last one of a part can pass by less than half a budget. Running sums are
    taken within BUCKETS buckets of a hash of the key and over the buckets' totals, so no task sums all groups.
    """
    line = F.octet_length(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)), {"ignoreNullFields": "false"})) + 1
    sizes = df.groupBy(key).agg(F.sum(line).alias("bytes")).withColumn("_h", F.sha2(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"), 256))
    sizes = sizes.withColumn("_b", F.substring("_h", 1, 3)).withColumn("_large", F.col("bytes") * 2 > budget)
    w = Window.partitionBy("_large", "_b").orderBy("_h", key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = sizes.withColumn("_sum", F.sum("bytes").over(w)).withColumn("_nth", F.count(F.lit(1)).over(w))
    totals = sizes.groupBy("_large", "_b").agg(F.sum("bytes").alias("_t"), F.count(F.lit(1)).alias("_c"))  # at most 2 * 4096 rows
    up = Window.partitionBy("_large").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("_large", "_b", F.coalesce(F.sum("_t").over(up), F.lit(0)).alias("_st"), F.coalesce(F.sum("_c").over(up), F.lit(0)).alias("_sc"))
    placed = own.join(before, ["_large", "_b"])
    halves = F.floor((F.col("_st") + F.col("_sum") - F.col("bytes")) * 2 / budget)
    part = F.when(F.col("_large"), F.concat(F.lit("large-"), (F.col("_sc") + F.col("_nth")).cast("string"))).otherwise(F.concat(F.lit("small-"), (halves + 1).cast("string")))
    return placed.select(key, "bytes", part.alias("part"), (F.col("bytes") > budget).alias("over"))


def estimated_bytes(df: DataFrame, share: float = 0.01, seed: int = 0) -> DataFrame:
    """n_rows and the estimated size as JSON lines, from a seeded sample."""
    size = df.sample(share, seed).agg(F.avg(F.octet_length(F.to_json(F.struct(*df.columns)))).alias("_a"))
    return with_constants(df.agg(F.count(F.lit(1)).alias("n_rows")), size).select("n_rows", (F.col("n_rows") * (F.coalesce("_a", F.lit(0.0)) + 1)).cast("long").alias("bytes"))
