"""Window operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselight.operators.joins import with_constants
from caselight.session import work_folder


def ordinal(df: DataFrame, keys: list[str], order: list[Column | str], name: str = "ordinal") -> DataFrame:
    """Place of each row in its group, from 0, by a total order."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def cumulative_share(df: DataFrame, keys: list[str], count: str, tie: str, name: str = "cumulative_share") -> DataFrame:
    """Running share of a group's total, largest counts first."""
    whole = Window.partitionBy(*keys)
    running = whole.orderBy(F.desc(count), tie).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(count).over(running) / F.sum(count).over(whole))


def chain(df: DataFrame, keys: list[str], order: list[str], node: str, both: bool = True) -> DataFrame:
    """source, target, relation between rows that follow one another in a group."""
    nxt = F.lead(node).over(Window.partitionBy(*keys).orderBy(*order))
    forward = df.select(F.col(node).alias("source"), nxt.alias("target")).where("target IS NOT NULL")
    edges = forward.withColumn("relation", F.lit("next"))
    return edges.unionByName(forward.select(F.col("target").alias("source"), F.col("source").alias("target"), F.lit("prev").alias("relation"))) if both else edges


def recent(df: DataFrame, keys: list[str], order: list[Column], n: int, name: str = "recency") -> DataFrame:
    """The first n rows of each group in order."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)


def first_of_group(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """One row a group, the first in order."""
    return recent(df, keys, order, 1, "_r").drop("_r")


def min_max(df: DataFrame, keys: list[str], score: str, name: str = "normalised") -> DataFrame:
    """Scores from 0 to 1 within their list, 0.5 where all are equal."""
    w = Window.partitionBy(*keys)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return df.withColumn(name, F.when(high > low, (F.col(score) - low) / (high - low)).otherwise(F.lit(0.5)))


def suffix_within_budget(df: DataFrame, keys: list[str], order: list[str], cost: str, budget: int, always: Column | None = None) -> DataFrame:
    """The rows that are always kept and the longest run of last others whose cost fits what is left of the budget."""
    keep = F.coalesce(always, F.lit(False)) if always is not None else F.lit(False)
    df = df.withColumn("_always", keep)
    fixed = F.sum(F.when(F.col("_always"), F.col(cost)).otherwise(0)).over(Window.partitionBy(*keys))
    back = Window.partitionBy(*keys, "_always").orderBy(*(F.desc(o) for o in order)).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("_fixed", fixed).withColumn("_used", F.sum(cost).over(back))
    return out.where(F.col("_always") | (F.col("_used") <= F.lit(budget) - F.col("_fixed"))).drop("_always", "_fixed", "_used")


def last_tokens(tokens: Column, n: int) -> Column:
    """The last n elements of an array."""
    return F.slice(tokens, F.greatest(F.lit(1), F.size(tokens) - n + 1), F.lit(n))


def nested(df: DataFrame, outer: str, inner_order: list[str], items: Column) -> DataFrame:
    """One row an outer key with its ordered list of items."""
    rows = F.array_sort(F.collect_list(F.struct(*(F.col(c).alias(f"_{i}") for i, c in enumerate(inner_order)), items.alias("_items"))))
    return df.groupBy(outer).agg(F.transform(rows, lambda r: r["_items"]).alias("nested"))


def sample_by_hash(df: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """n keys in the order of a hash; always the same."""
    from caselight.functions.ids import hash_order

    return df.orderBy(hash_order(seed, F.col(key)), key).limit(n)


def page(df: DataFrame, order: list[str], offset: int, limit: int) -> DataFrame:
    """Rows from offset on, 1 to 100 of them."""
    return df.orderBy(*order).offset(max(0, offset)).limit(min(100, max(1, limit)))


def evenly_spaced(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """n rows of each group at equal distances in its order; places come from sorted ranges, so no task orders a group."""
    rows = placed(df, [*keys, *order], "_place")
    ends = rows.groupBy(*keys).agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n"))
    same = reduce(lambda a, b: a & b, (F.col(f"_rows.`{k}`").eqNullSafe(F.col(f"_ends.`{k}`")) for k in keys))
    out = rows.alias("_rows").join(ends.alias("_ends"), same).withColumn("_i", F.col("_place") - F.col("_first"))
    taken = lambda i: F.floor(i * n / F.col("_n"))
    return out.where((F.col("_i") == 0) | (taken(F.col("_i")) != taken(F.col("_i") - 1))).select(*(F.col(f"_rows.`{c}`") for c in df.columns))


def shortest_middle_longest(df: DataFrame, length: str, key: str) -> DataFrame:
    """shortest, middle and longest key, ties by key."""
    from caselight.operators.aggregates import exact_quantiles

    median = exact_quantiles(df, [], length, {"_m": 0.5})
    rows = with_constants(df.select(key, length), median)
    return rows.agg(F.min_by(key, F.struct(length, key)).alias("shortest"), F.min_by(key, F.struct(F.abs(F.col(length) - F.col("_m")), key)).alias("middle"), F.min_by(key, F.struct(-F.col(length), key)).alias("longest"))


def placed(df: DataFrame, order: list[Column | str], name: str, first: int = 0) -> DataFrame:
    """The rows with their place, from first on, in one total order of the whole table.

    The table is sorted by ranges and written; a row's place is its place in its file after the rows of the files before it, so
    no task orders or counts more than its range. One count a file is with the driver.
    """
    spark = df.sparkSession
    path = work_folder(spark) + "/sorted"
    df.orderBy(*order).write.parquet(path)
    rows = spark.read.schema(df.schema).parquet(path).select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    start, starts = first, []
    for r in sorted(rows.groupBy("_file").agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: r["_file"]):  # names rise with the ranges
        starts.append((r["_file"], start))
        start += r["n"]
    before = F.broadcast(spark.createDataFrame(starts, "_file string, _start long"))
    return rows.join(before, "_file").select(*(F.col(f"`{c}`") for c in df.columns), (F.col("_start") + F.col("_row")).alias(name))


def last_values(df: DataFrame, keys: list[str], order: list[str], value: str, n: int, name: str) -> DataFrame:
    """One row a group: its last n values in order; other rows leave before they are gathered."""
    kept = recent(df, keys, [F.desc(o) for o in order], n, "_r")
    rows = F.array_sort(F.collect_list(F.struct((-F.col("_r")).alias("r"), F.col(value).alias("v"))))
    return kept.groupBy(*keys).agg(F.transform(rows, lambda x: x["v"]).alias(name))


def disjoint_split(df: DataFrame, key: str, seed: int) -> DataFrame:
    """key, split: two thirds train, one sixth test, one sixth validation, by the order of a hash of the key.

    The place of a key needs one total order; it is taken from ranges of the hash (places within a range by a
    window over it, ranges by their sizes), so no task orders all keys.
    """
    from caselight.functions.ids import hash_order

    keys = df.select(key).distinct().withColumn("_h", hash_order(seed, F.col(key))).withColumn("_b", F.substring("_h", 1, 3))
    sizes = keys.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))  # at most 4096 rows
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    before = before.withColumn("_total", F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    placed = keys.join(F.broadcast(before), "_b").withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy("_h", key)) - 1 + F.col("_before"))
    train, sixth = F.floor(F.col("_total") * 2 / 3), F.floor(F.col("_total") / 6)
    return placed.select(key, F.when(F.col("_r") < train, "train").when(F.col("_r") < train + sixth, "test").otherwise("validation").alias("split"))


def allocate(loads: list[tuple[str, float]], reviewers: list[str]) -> dict[str, str]:
    """Largest load first, each to the reviewer with the least so far; a plan for a few dozen items."""
    used = {r: 0.0 for r in reviewers}
    out = {}
    for item, load in sorted(loads, key=lambda x: (-x[1], x[0])):
        r = min(reviewers, key=lambda name: (used[name], name))
        out[item] = r
        used[r] += load
    return out
