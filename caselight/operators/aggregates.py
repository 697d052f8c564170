"""Aggregations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselight.operators import windows as W
from caselight.operators.joins import with_constants
from caselight.session import work_folder


def first_nonempty(value: str, *order: str) -> Column:
    """The first value in order that is neither null nor ''."""
    v = F.nullif(F.col(value), F.lit(""))
    return F.min_by(v, F.when(v.isNotNull(), F.struct(*order)))


def collapse(df: DataFrame, keys: list[str], count: str = "source_row_count") -> DataFrame:
    """Equal rows once, with their number; nulls are equal."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(count))


def ordered_concat(value: str, *order: str, sep: str = "; ", distinct: bool = True) -> Column:
    """Values in order joined by sep, each once without regard to case."""
    rows = F.array_sort(F.collect_list(F.when((F.coalesce(F.col(value), F.lit("")) != ""), F.struct(*order, F.col(value).alias("_v")))))
    texts = F.transform(rows, lambda r: r["_v"])
    if not distinct:
        return F.array_join(texts, sep)
    low = lambda a: F.transform(a, F.lower)
    kept = F.filter(F.transform(texts, lambda x, i: F.struct(x.alias("x"), (F.array_position(low(texts), F.lower(x)) == i + 1).alias("first"))), lambda s: s["first"])
    return F.array_join(F.transform(kept, lambda s: s["x"]), sep)


def note(section: str, text: str, *order: str) -> Column:
    """'[section]' and its text, the sections in order with an empty line between."""
    rows = F.array_sort(F.collect_list(F.struct(*order, F.concat(F.lit("["), F.col(section), F.lit("]\n"), F.col(text)).alias("_t"))))
    return F.array_join(F.transform(rows, lambda r: r["_t"]), "\n\n")


def json_records(columns: list[str], *order: str) -> Column:
    """A JSON array of the rows' columns in order."""
    rows = F.array_sort(F.collect_list(F.struct(*(F.col(o).alias(f"_o{i}") for i, o in enumerate(order)), F.struct(*columns).alias("_r"))))
    return F.to_json(F.transform(rows, lambda r: r["_r"]))


def mode(value: str) -> Column:
    """The most frequent value, the smallest of equals."""
    return F.mode(F.col(value), True)


def pivot_counts(df: DataFrame, key: str, column: str, values: list[str]) -> DataFrame:
    """Counts of the column's values side by side, 0 where there are none."""
    return df.groupBy(key).agg(*(F.count_if(F.col(column) == v).alias(f"n_{v}") for v in values))


def table_counts(visits: DataFrame, tables: dict[str, DataFrame], key: str) -> DataFrame:
    """Each visit with its number of rows in every table and whether it has any; one union and one aggregate."""
    rows = None
    for name, df in tables.items():
        part = df.select(key, F.lit(name).alias("_t"))
        rows = part if rows is None else rows.unionByName(part)
    counts = rows.groupBy(key).agg(*(F.count_if(F.col("_t") == n).alias(f"{n}_count") for n in tables))
    out = visits.join(counts, key, "left")
    for n in tables:
        out = out.withColumn(f"{n}_count", F.coalesce(f"{n}_count", F.lit(0))).withColumn(f"has_{n}", F.col(f"{n}_count") > 0)
    return out


def idf(df: DataFrame, group: str, token: str) -> DataFrame:
    """token, df, idf = ln((N + 1) / (df + 1)) + 1 over the groups."""
    n = df.agg(F.countDistinct(group).alias("n_groups"))
    # Distinct pairs are counted in a second stage, so that a frequent token's groups meet in many tasks.
    out = with_constants(df.select(group, token).distinct().groupBy(token).agg(F.count(group).alias("df")), n)
    return out.select(token, "df", (F.log((F.col("n_groups") + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def exact_quantiles(df: DataFrame, keys: list[str], value: str, linear: dict[str, float] | None = None, nearest: dict[str, float] | None = None, ranges: int = 64, weight: str | None = None) -> DataFrame:
    """keys and named quantiles of each group: linear ones interpolate between ranks, nearest ones are the ceil(n * share)-th smallest values.

    Equal values are counted first (with weight, a column of numbers of times, as often as that says) and the counts are written, so the
    input is read once. A sketch cuts each group's different values into ranges, sums of these tell which range holds a rank, and
    only such ranges are ordered, each on its own, so a group of any size is spread over tasks and the result is exact.
    """
    v = F.col(value).cast("double")
    rows = df.where(v.isNotNull() & ~F.isnan(v)).select(F.lit(0).alias("_g"), *keys, v.alias("_v"), (F.col(weight).cast("long") if weight else F.lit(1).cast("long")).alias("_n"))
    keys = ["_g", *keys]
    counts = rows.groupBy(*keys, "_v").agg(F.sum("_n").alias("_n"))
    path = f"{work_folder(df.sparkSession)}/counts"
    counts.write.parquet(path)
    counts = df.sparkSession.read.schema(counts.schema).parquet(path)
    cuts = counts.groupBy(*keys).agg(F.percentile_approx("_v", [i / ranges for i in range(1, ranges)], 1000).alias("_cuts"), F.sum("_n").alias("_total"))
    spread = counts.join(cuts.drop("_total"), keys).select(*keys, "_v", "_n", F.size(F.filter("_cuts", lambda c: c < F.col("_v"))).alias("_b"))
    sums = spread.groupBy(*keys, "_b").agg(F.sum("_n").alias("_m"))
    before = sums.withColumn("_end", F.sum("_m").over(Window.partitionBy(*keys).orderBy("_b"))).withColumn("_start", F.col("_end") - F.col("_m"))  # at most ranges rows a group
    asked = []
    for name, share in (linear or {}).items():
        place = (F.col("_total") - 1) * share
        asked += [F.struct(F.lit(name).alias("name"), (F.floor(place) + 1).alias("rank"), (1 - place + F.floor(place)).alias("weight")), F.struct(F.lit(name).alias("name"), (F.floor(place) + 2).alias("rank"), (place - F.floor(place)).alias("weight"))]
    for name, share in (nearest or {}).items():
        asked.append(F.struct(F.lit(name).alias("name"), F.greatest(F.ceil(F.col("_total") * share - 1e-9), F.lit(1)).alias("rank"), F.lit(1.0).alias("weight")))
    ranks = cuts.select(*keys, F.inline(F.array(*asked))).where("weight > 0")
    found = ranks.join(before, keys).where((F.col("_start") < F.col("rank")) & (F.col("rank") <= F.col("_end"))).select(*keys, "_b", "name", "weight", (F.col("rank") - F.col("_start")).alias("r"))
    ordered = spread.join(found.select(*keys, "_b").distinct(), [*keys, "_b"], "left_semi").withColumn("_up", F.sum("_n").over(Window.partitionBy(*keys, "_b").orderBy("_v")))
    hits = found.join(ordered, [*keys, "_b"]).where((F.col("_up") - F.col("_n") < F.col("r")) & (F.col("r") <= F.col("_up")))
    names = [*(linear or {}), *(nearest or {})]
    # The two terms of an interpolation, the smaller first, so that sums don't depend on their order.
    term = lambda n: F.array_sort(F.collect_list(F.when(F.col("name") == n, F.struct("_v", "weight"))))
    mixed = lambda n: F.aggregate(term(n), F.lit(0.0), lambda s, x: s + x["_v"] * x["weight"])
    return hits.groupBy(*keys).agg(*(mixed(n).alias(n) for n in names)).drop("_g")


def robust_stats(df: DataFrame, token: str, value: str) -> DataFrame:
    """token, median, iqr; a spread of 1e-8 or less becomes 1."""
    q = exact_quantiles(df, [token], value, {"low": 0.25, "median": 0.5, "high": 0.75})
    spread = F.col("high") - F.col("low")
    return q.select(token, "median", F.when(spread <= 1e-8, F.lit(1.0)).otherwise(spread).alias("iqr"))


def vocabulary(df: DataFrame, token: str, reserved: int = 3) -> DataFrame:
    """token, index: sorted different tokens numbered after the reserved ids."""
    known = df.select(token).where(F.col(token).isNotNull()).distinct()
    return W.placed(known, [token], "index", reserved).withColumn("index", F.col("index").cast("int"))


def ranked_vocabulary(df: DataFrame, group: str, token: str, top: int = 0) -> DataFrame:
    """token, frequency, index from 0: by number of groups, then token; only the first top if it isn't 0."""
    counts = df.select(group, token).distinct().groupBy(token).agg(F.count(group).alias("frequency"))
    order = [F.desc("frequency"), F.asc(token)]
    if top:  # the window orders top rows
        return counts.orderBy(*order).limit(top).withColumn("index", F.row_number().over(Window.orderBy(*order)) - 1)
    return W.placed(counts, order, "index").withColumn("index", F.col("index").cast("int"))


def concept_inventory(events: DataFrame, keys: list[str], visit: str, patient: str, example: str, order: str) -> DataFrame:
    """Each concept with its events, visits, patients and first example.

    Events are first summed by concept, visit and patient; the different visits and patients are counted from these sums, and each
    count is summed up by concept before the counts meet. Examples are picked apart from them, so that the sums need no sorting.
    """
    one = events.groupBy(*keys, visit, patient).agg(F.count(F.lit(1)).alias("_n"))
    parts = [one.groupBy(*keys).agg(F.sum("_n").alias("n_events")), events.groupBy(*keys).agg(F.min_by(example, order).alias("example"))]
    for name, column in (("n_visits", visit), ("n_patients", patient)):
        parts.append(one.where(F.col(column).isNotNull()).select(*keys, column).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias(name)))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    count = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return rows.groupBy(*keys).agg(count("n_events"), count("n_visits"), count("n_patients"), F.first("example", ignorenulls=True).alias("example"))


def group_tail_median(df: DataFrame, keys: list[str], exact: str, bound: str) -> DataFrame:
    """keys, bound, tail: the median of x - bound over the group's exact values x above it; bounds are made distinct first.

    Equal values are counted first, so a key's rows are its different values. Values and bounds go in one falling order,
    in which a bound's tail is what precedes it: with n values before it the median is at ranks (n + 1) / 2 and
    n / 2 + 1 from the bound's end. These ranks are joined back, so nothing is paired with all it precedes.
    """
    sides = F.array(*(F.struct(F.col(c).cast("double").alias("v"), F.lit(is_bound).alias("is_bound")) for c, is_bound in ((exact, False), (bound, True))))
    rows = df.select(*keys, F.inline(sides)).where("v IS NOT NULL").groupBy(*keys, "v", "is_bound").agg(F.count_if(~F.col("is_bound")).alias("n"))
    # A value that equals a bound is not above it, so bounds come first among equals.
    w = Window.partitionBy(*keys).orderBy(F.desc("v"), F.desc("is_bound")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = rows.withColumn("above", F.sum("n").over(w))
    bounds = ranked.where("is_bound AND above > 0").select(*keys, F.col("v").alias("bound"), "above")
    places = bounds.select(*keys, "bound", F.explode(F.array_distinct(F.array(F.floor((F.col("above") + 1) / 2), F.floor(F.col("above") / 2) + 1))).alias("place"))
    # The value at a place is the first whose running count reaches it: places and values in one order again.
    values = ranked.where("NOT is_bound").select(*keys, F.col("above").alias("place"), F.lit(None).cast("double").alias("bound"), "v")
    both = values.unionByName(places.withColumn("v", F.lit(None).cast("double")))
    up = Window.partitionBy(*keys).orderBy(F.desc("place"), F.col("v").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("x", F.last("v", ignorenulls=True).over(up)).where("bound IS NOT NULL")
    return found.groupBy(*keys, "bound").agg(F.avg("x").alias("_m")).select(*keys, "bound", (F.col("_m") - F.col("bound")).alias("tail"))


def _stacked(df: DataFrame, columns: list[str]) -> DataFrame:
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))
    return df.select(F.inline(pairs))


def column_profile(df: DataFrame, columns: list[str], high: int = 50, examples: int = 8, parts: int = 64) -> DataFrame:
    """Each column's rows, missing and different values, whether they are many, and its most frequent ones.

    Values are counted by column; the most frequent ones are picked first in parts of a column's values, by hash, then among the parts' picks.
    """
    counts = _stacked(df, columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")).withColumn("known", F.coalesce(F.col("value"), F.lit("")) != "")
    order = [F.desc("n"), F.col("value")]
    picked = W.recent(counts.where("known").withColumn("_part", F.pmod(F.xxhash64("value"), F.lit(parts))), ["column", "_part"], order, examples, "_r")
    best = W.recent(picked, ["column"], order, examples, "r").groupBy("column").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "value"))), lambda x: x["value"]).alias("examples"))
    sums = counts.groupBy("column").agg(F.sum("n").alias("n_rows"), F.sum(F.when(~F.col("known"), F.col("n")).otherwise(0)).alias("n_missing"), F.count_if("known").alias("n_distinct"))
    out = sums.join(best, "column", "left").withColumn("examples", F.coalesce("examples", F.array().cast("array<string>")))
    return out.withColumn("high_cardinality", F.col("n_distinct") > high)


def value_dictionary(df: DataFrame, columns: list[str], most: int = 50) -> DataFrame:
    """column, value, n of the columns with at most that many different values."""
    counts = _stacked(df, columns).where("value IS NOT NULL").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    few = counts.groupBy("column").agg(F.count(F.lit(1)).alias("_k")).where(F.col("_k") <= most).select("column")
    return counts.join(F.broadcast(few), "column", "left_semi")  # a row a column


def roll_up(counts: DataFrame, rules: list[tuple[Column, str]], default: str, name: str = "status") -> DataFrame:
    """The first rule that holds names a row's status."""
    out = F.lit(default)
    for cond, label in reversed(rules):
        out = F.when(cond, label).otherwise(out)
    return counts.withColumn(name, out)


def review_summary(df: DataFrame, verdict: str) -> DataFrame:
    """Completed, positive and unknown reviews and the positive share of those decided."""
    v = F.coalesce(F.col(verdict), F.lit(""))
    n = [F.count_if(v != "").alias("completed"), F.count_if(v == "yes").alias("positive"), F.count_if(v == "unknown").alias("unknown")]
    return df.agg(*n).withColumn("positive_share", F.col("positive") / F.nullif(F.col("completed") - F.col("unknown"), F.lit(0)))
