"""Diagnoses of many source fields in one long table (B2): main and secondary codes, texts of the visit, of what was ordered, and of operations."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselight.functions import ids, text


@dataclass(frozen=True)
class Field:
    """A source field: what kind of diagnosis it holds, where it stands, and its columns. A coded field holds codes, several parted by ; , or |."""

    kind: str
    sheet: str
    name: str
    rows: DataFrame
    visit: str
    value: str
    time: str
    coded: bool = False


@dataclass(frozen=True)
class _Placed:
    place: int
    field: Field


def _entries(fields: list[Field]) -> DataFrame:
    """visit_id and the fields' values with their places and times, of fields of one table: a row a row of the table."""
    values = F.array(*(F.struct(F.lit(f.place).alias("place"), F.col(f.field.value).cast("string").alias("v"), F.col(f.field.time).cast("timestamp_ntz").alias("time")) for f in fields))
    one = fields[0].field
    held = one.rows.select(text.clean_key(F.col(one.visit).cast("string")).alias("visit_id"), F.filter(values, lambda e: e["v"].isNotNull()).alias("e"))
    return held.where(F.size("e") > 0)


def build(fields: list[Field], visits: DataFrame, visit: str = "visit_id", patient: str = "patient_id") -> DataFrame:
    """One row a visit, code and text (case and spaces aside): its first spelling, kinds, sheets and fields in order of time, earliest time and number of rows.

    Equal times go by the fields' order. Rows of unknown visits leave. Rows of the tables move once, by visit and with all their fields; a task
    sorts its visits' values and keeps of a group one time a field, so nothing is gathered.
    """
    tables: dict[tuple, list[_Placed]] = {}
    for i, f in enumerate(fields):
        tables.setdefault((id(f.rows), f.visit), []).append(_Placed(i, f))
    moved = reduce(DataFrame.unionByName, map(_entries, tables.values())).repartition("visit_id")
    rows = moved.select("visit_id", F.inline("e"))
    coded = F.array_contains(F.array(*(F.lit(i) for i, f in enumerate(fields) if f.coded)).cast("array<int>"), F.col("place"))
    rows = rows.select("visit_id", "place", "time", coded.alias("coded"), F.explode(F.when(coded, F.split("v", r"[;,|]+")).otherwise(F.array("v"))).alias("v"))
    rows = rows.withColumn("v", text.clean(F.col("v"))).where("v <> ''")
    code, words = (F.when(F.col("coded") == one, F.col("v")).otherwise("") for one in (True, False))
    rows = rows.select("visit_id", "place", "time", code.alias("code"), words.alias("text"), text.casefold(code).alias("code_key"), text.casefold(words).alias("text_key"))
    keys = ["visit_id", "code_key", "text_key"]
    at = F.struct(F.col("time").isNull().alias("none"), F.col("time").alias("time"))
    first = F.min(F.struct(at.alias("at"), "place", "code", "text")).alias("first")
    by_field = (F.min(F.when(F.col("place") == i, at)).alias(f"_{i}") for i in range(len(fields)))
    gathered = rows.groupBy(*keys).agg(first, F.count(F.lit(1)).alias("source_row_count"), *by_field)
    known = visits.select(text.clean_key(F.col(visit).cast("string")).alias("visit_id"), F.col(patient).alias("patient_id")).where("patient_id IS NOT NULL AND visit_id <> ''").dropDuplicates(["visit_id"])
    every = F.array(*(F.when(F.col(f"_{i}").isNotNull(), F.struct(F.col(f"_{i}").alias("at"), F.lit(i).alias("place"), F.lit(f.kind).alias("kind"), F.lit(f.sheet).alias("sheet"), F.lit(f.name).alias("field"))) for i, f in enumerate(fields)))
    out = gathered.join(known, "visit_id").withColumn("all", F.array_sort(F.array_compact(every)))
    listed = lambda c: F.array_join(F.array_distinct(F.transform("all", lambda x: x[c])), "; ")
    made = ids.prefix_id("diag", F.col("patient_id").cast("string"), F.col("visit_id"), F.col("code_key"), F.col("text_key"))
    return out.select(made.alias("diagnosis_id"), "patient_id", "visit_id", F.col("first.code").alias("diagnosis_code"), F.col("first.text").alias("diagnosis_text"), listed("kind").alias("diagnosis_type"), F.col("first.at.time").alias("event_time"), listed("sheet").alias("source_sheet"), listed("field").alias("source_field"), "source_row_count")
