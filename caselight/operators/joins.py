"""Joins with checked cardinality, cutoffs and intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def checked(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", matched: str | None = None) -> DataFrame:
    """Many-to-one join: a key that the right side repeats fails the job when it is met; matched names an indicator column."""
    seen = F.count(F.lit(1)).alias("_n")
    values = [c for c in right.columns if c not in keys]
    one = right.groupBy(*keys).agg(seen, *(F.first(c).alias(c) for c in values))
    one = one.withColumn("_ok", F.when(F.col("_n") > 1, F.raise_error(F.lit(f"repeated key {keys}")).cast("boolean")).otherwise(F.lit(True)))
    out = left.join(one.drop("_n"), keys, how)
    if matched:
        out = out.withColumn(matched, F.coalesce("_ok", F.lit(False)))
    return out.where(F.coalesce("_ok", F.lit(True))).drop("_ok")


def last_wins(dimension: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """One value a key: the one of the largest order."""
    return dimension.groupBy(key).agg(F.max_by(value, order).alias(value))


def keep_old(template: DataFrame, old: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The template with the old table's non-empty values."""
    prior = old.select(*keys, *(F.col(c).alias(f"_{c}") for c in columns))
    out = template.join(prior, keys, "left")
    return out.select(*keys, *(F.coalesce(F.nullif(f"_{c}", F.lit("")), c).alias(c) if c in columns else F.col(c) for c in template.columns if c not in keys))


def history(events: DataFrame, targets: DataFrame, patient: str, time: str, cutoff: str, how: str = "inner") -> DataFrame:
    """Events of a target's patient up to its cutoff: an equi-join on the patient with the time as residual."""
    on = (events[patient] == targets[patient]) & (events[time] <= targets[cutoff])
    return targets.join(events, on, how).drop(events[patient])


def visit_only(events: DataFrame, targets: DataFrame, patient: str, visit: str) -> DataFrame:
    """Events of a target's own visit, and those of its patient that belong to no visit."""
    e = events.withColumnRenamed(visit, "_visit")
    own = e.where("_visit <> ''").join(targets, (e[patient] == targets[patient]) & (F.col("_visit") == targets[visit])).drop(e[patient])
    free = e.where("_visit = ''").join(targets, patient)
    return own.drop("_visit").unionByName(free.drop("_visit"))


def interval_link(items: DataFrame, visits: DataFrame, item: str, patient: str, date: str, visit: str, admission: str, discharge: str) -> DataFrame:
    """One row an item: status and the visit whose days hold its date, if there is just one.

    Both ends count, a visit without discharge holds its first day only. Candidates are joined by patient, so a
    patient's visits meet only that patient's items, and are counted before anything leaves the join's partition.
    """
    v = visits.select(F.col(patient).alias("_p"), F.col(visit).alias("_v"), F.to_date(admission).alias("_a"), F.to_date(F.coalesce(F.col(discharge), F.col(admission))).alias("_d"))
    on = (F.col(patient) == F.col("_p")) & F.to_date(date).between(F.col("_a"), F.col("_d"))
    hits = items.join(v, on, "left").groupBy(item).agg(F.countDistinct("_v").alias("n"), F.min("_v").alias("_v"))
    status = F.when(F.col("n") == 1, "matched").when(F.col("n") == 0, "no_visit_on_study_date").otherwise("ambiguous")
    return hits.select(item, status.alias("status"), F.when(F.col("n") == 1, F.col("_v")).alias(visit))


def suffix_link(left: DataFrame, right: DataFrame, left_uid: str, right_uid: str, date: str, size: int = 16) -> DataFrame:
    """The left rows with the date of the right rows that share the last characters of an identifier, if it is one date."""
    dates = right.groupBy(F.right(right_uid, F.lit(size)).alias("_s")).agg(F.countDistinct(date).alias("n_dates"), F.min(date).alias("_d"))
    out = left.withColumn("_s", F.right(left_uid, F.lit(size))).join(dates, "_s", "left").drop("_s")
    return out.withColumn("n_dates", F.coalesce("n_dates", F.lit(0))).withColumn("linked_date", F.when(F.col("n_dates") == 1, F.col("_d"))).drop("_d")


def evidence_link(keys: DataFrame, evidence: DataFrame, cohort: DataFrame, key: str, visit: str) -> DataFrame:
    """One row a key: the visit that all evidence agrees on and that is in the cohort, else the reason and candidates."""
    found = evidence.where(F.col(visit).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set(visit)).alias("candidates"))
    out = keys.select(key).distinct().join(found, key, "left").withColumn("candidates", F.coalesce("candidates", F.array().cast(found.schema["candidates"].dataType)))
    one = F.when(F.size("candidates") == 1, F.get("candidates", F.lit(0)))
    out = out.withColumn("_one", one).join(cohort.select(F.col(visit).alias("_c")).distinct(), F.col("_one") == F.col("_c"), "left")
    reason = F.when(F.size("candidates") == 0, "no_evidence").when(F.size("candidates") > 1, "ambiguous").when(F.col("_c").isNull(), "outside_cohort").otherwise("linked")
    return out.select(key, reason.alias("reason"), F.col("_c").alias(visit), "candidates")


def one_to_one(left: DataFrame, right: DataFrame, left_id: str, right_id: str, identity: DataFrame) -> DataFrame:
    """left_id, right_id of an identity table that must name every left and every right id, each once; anything else fails the job."""
    pairs = identity.select(left_id, right_id)
    faults = []
    for name, df in ((left_id, left), (right_id, right)):
        n = pairs.groupBy(name).agg(F.count(F.lit(1)).alias("_n"))
        known = df.select(name).distinct().withColumn("_k", F.lit(True))
        faults.append(n.join(known, name, "full_outer").where("_n IS NULL OR _k IS NULL OR _n > 1").agg(F.count(F.lit(1)).alias(f"_bad_{name}")))
    out = with_constants(with_constants(pairs, faults[0]), faults[1])
    wrong = F.coalesce(F.col(f"_bad_{left_id}") + F.col(f"_bad_{right_id}"), F.lit(0))
    return out.where(F.when(wrong > 0, F.raise_error(F.lit("identity is not one-to-one")).cast("boolean")).otherwise(F.lit(True))).select(left_id, right_id)


def with_images(visits: DataFrame, images: DataFrame, visit: str, modalities: list[str], path: str = "path", dim: str = "dim", date: str = "study_date", modality: str = "modality") -> DataFrame:
    """Visits that have images, with the number, modalities, paths, sizes and dates of these, and paths and number by modality.

    Lists are in the order of path; the visit table must have a visit once, or the job fails.
    """
    listed = lambda rows, field: F.transform(rows, lambda r: r[field])
    rows = F.array_sort(F.collect_list(F.struct(F.col(path).alias("path"), F.col(dim).cast("int").alias("dim"), F.col(date).alias("date"), F.col(modality).alias("modality"))))
    one = images.groupBy(visit).agg(rows.alias("_r"))
    of = lambda m: lambda r: r["modality"] == m
    out = one.select(
        visit, F.size("_r").cast("long").alias("n_images"), F.array_sort(F.array_distinct(listed(F.col("_r"), "modality"))).alias("modalities"), listed(F.col("_r"), "path").alias("paths"),
        listed(F.col("_r"), "dim").alias("dims"), listed(F.col("_r"), "date").alias("study_dates"),
        *(listed(F.filter("_r", of(m)), "path").alias(f"{m.lower()}_paths") for m in modalities),
    )
    for m in modalities:
        out = out.withColumn(f"{m.lower()}_count", F.size(f"{m.lower()}_paths").cast("long"))
    return checked(out, visits, [visit], "inner")


def pair_by_name(left: DataFrame, right: DataFrame, name: str, value: str) -> DataFrame:
    """name, left_values, right_values: both sides' values under each name, sorted, with empty lists where a side has none."""
    side = lambda df, to: df.groupBy(F.lower(F.trim(name)).alias("name")).agg(F.array_sort(F.collect_list(value)).alias(to))
    out = side(left, "left_values").join(side(right, "right_values"), "name", "full_outer")
    empty = F.array().cast(out.schema["left_values"].dataType)
    return out.select("name", F.coalesce("left_values", empty).alias("left_values"), F.coalesce("right_values", empty).alias("right_values"))


def catalogue(tables: dict[str, DataFrame], key: str, label: str) -> DataFrame:
    """key, label of the first source in name order that has it, and all sources."""
    rows = None
    for source, df in sorted(tables.items()):
        part = df.select(key, label, F.lit(source).alias("source")).distinct()
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy(key).agg(F.min_by(label, F.struct("source", label)).alias(label), F.array_sort(F.collect_set("source")).alias("sources"))


def keep_known(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key the other table holds."""
    return df.join(known.select(key), key, "left_semi")


def in_all(keys: list[DataFrame], key: str) -> DataFrame:
    """Keys that every table holds."""
    out = keys[0].select(key).distinct()
    for other in keys[1:]:
        out = out.join(other.select(key), key, "left_semi")
    return out


def cooccurrence(rows: DataFrame, group: str, item: str, symmetric: bool = False) -> DataFrame:
    """a, b, n: in how many groups two items meet, a < b unless symmetric. Rows are made distinct first; a group is a visit, which bounds its pairs."""
    one = rows.select(group, item).distinct()
    pairs = one.select(group, F.col(item).alias("a")).join(one.select(group, F.col(item).alias("b")), group).where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "n")) if symmetric else pairs


def same_key_edges(left: DataFrame, right: DataFrame, keys: list[str], source: str, target: str) -> DataFrame:
    """source, target of rows that agree on all keys."""
    return left.select(*keys, F.col(source).alias("source")).join(right.select(*keys, F.col(target).alias("target")), keys).select("source", "target").distinct()


def condition(*parts: Column) -> Column:
    """All parts hold; null counts as not."""
    out = F.lit(True)
    for p in parts:
        out = out & F.coalesce(p, F.lit(False))
    return out


def with_constants(df: DataFrame, one: DataFrame) -> DataFrame:
    """The rows with the columns of a table of one row (nulls if it has none), worked out once as a scalar subquery; no join."""
    row = one.limit(1).select(F.struct(*one.columns).alias("_one")).scalar()
    return df.withColumn("_one", row).select(*df.columns, *(F.col("_one")[c].alias(c) for c in one.columns))
