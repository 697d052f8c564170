"""Builders of the clinical tables."""

from __future__ import annotations

import difflib
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caselight.functions import ids, parse, text
from caselight.operators import aggregates as A
from caselight.session import dealt


def build_visits(visits: DataFrame, patients: DataFrame, visit: str, patient: str, admission: str, discharge: str, birth_year: str, gender: str) -> DataFrame:
    """visit_id, patient_id, times, birth year, gender and age; a visit id that occurs twice keeps its first admission."""
    one = patients.groupBy(text.clean_key(F.col(patient)).alias("patient_id")).agg(F.min(F.col(birth_year).try_cast("int")).alias("birth_year"), F.min(text.gender_token(F.col(gender).cast("string"))).alias("gender_code"))
    v = visits.select(text.clean_key(F.col(visit).cast("string")).alias("visit_id"), text.clean_key(F.col(patient).cast("string")).alias("patient_id"), parse.parse_time(F.col(admission).cast("string")).alias("admission_time"), parse.parse_time(F.col(discharge).cast("string")).alias("discharge_time"))
    v = v.where("visit_id <> ''").withColumn("_r", F.row_number().over(Window.partitionBy("visit_id").orderBy("admission_time", "patient_id"))).where("_r = 1").drop("_r")
    return v.join(one, "patient_id", "left").withColumn("age", parse.age_at(F.col("admission_time"), F.col("birth_year"))).select("visit_id", "patient_id", "admission_time", "discharge_time", "birth_year", "gender_code", "age")


def build_diagnoses(sources: list[tuple[str, DataFrame, str | None, str | None]], patient: str = "patient_id", visit: str = "visit_id") -> DataFrame:
    """One row a (patient, visit, code, name), with the fields it came from and how often.

    Each source is (field, table, code column or None, name column or None); a code column may list several. Equal
    rows of a source are counted before their texts are cleaned, so a text is cleaned once a visit. The sources' rows move once, by visit.
    """
    parts, coded = [], [field for field, _, code, _ in sources if code]
    for field, df, code, name in sources:
        parts.append(df.select(patient, visit, F.lit(field).alias("field"), (F.col(code) if code else F.lit(None)).cast("string").alias("_c"), (F.col(name) if name else F.lit(None)).cast("string").alias("_n")))
    moved = dealt(reduce(DataFrame.unionByName, parts), visit)
    one = moved.groupBy(*moved.columns).agg(F.count(F.lit(1)).alias("_m"))
    codes = F.when(F.col("field").isin(coded), text.icd_list(F.col("_c"))).otherwise(F.array(F.lit("")))
    listed = one.select(patient, visit, "field", F.explode(codes).alias("code"), text.clean(F.col("_n")).alias("name"), "_m")
    rows = listed.withColumn("name_key", text.entity_key(F.col("name"))).where((F.col("code") != "") | (F.col("name") != ""))
    out = rows.groupBy(patient, visit, "code", "name_key").agg(F.min("name").alias("name"), F.array_join(F.array_sort(F.collect_set("field")), ";").alias("fields"), F.sum("_m").alias("source_row_count"))
    return out.withColumn("diagnosis_id", ids.prefix_id("dx", F.col(patient), F.col(visit), F.col("code"), F.col("name_key")))


def code_only(diagnoses: DataFrame, visit: str = "visit_id", code: str = "code") -> DataFrame:
    """Diagnoses that may become nodes: those of a visit with a controlled code. A name never stands in for a code."""
    return diagnoses.where((text.clean(F.col(visit).cast("string")) != "") & (text.clean(F.col(code)) != ""))


def build_medicines(rows: DataFrame, visits: DataFrame, columns: list[str], visit: str = "visit_id", return_reason: str | None = None, include_returned: bool = True) -> DataFrame:
    """Medicine rows of known visits, cleaned; equal rows once with their number.

    A row with a return_reason is a returned medicine: it has status 'returned', others 'prescribed'; without include_returned it leaves.
    """
    known = dealt(rows, visit).join(visits.select(visit), visit, "left_semi")
    extra = [F.when(text.clean(F.col(return_reason)) != "", "returned").otherwise("prescribed").alias("status")] if return_reason else []
    cleaned = known.select(visit, *(text.clean(F.col(c).cast("string")).alias(c) for c in columns), *extra)
    if return_reason and not include_returned:
        cleaned = cleaned.where("status = 'prescribed'")
    keys = [*columns, *(["status"] if extra else [])]
    out = A.collapse(cleaned, [visit, *keys])
    return out.withColumn("medicine_id", ids.prefix_id("med", F.col(visit), *(F.col(c) for c in keys)))


def build_procedures(orders: DataFrame, codes: DataFrame, performed: DataFrame, order: str = "order_id", code: str = "service_code") -> DataFrame:
    """Orders with their service codes, each once, and the performed rows; every identity column enters the id."""
    listed = codes.groupBy(order).agg(F.array_join(F.array_sort(F.collect_set(code)), ";").alias("service_codes"))
    out = orders.join(listed, order, "left").join(performed, order, "left").distinct()
    return out.withColumn("procedure_id", ids.prefix_id("proc", *(F.col(c).cast("string") for c in sorted(out.columns))))


def build_notes(rows: DataFrame, visit: str, fields: list[str], placeholder: str = "richeditcontrol1") -> DataFrame:
    """One row a visit, section and text of the note fields; placeholders and empty texts leave."""
    pairs = F.inline(F.array(*(F.struct(F.lit(f).alias("section"), text.clean(F.col(f)).alias("text")) for f in fields)))
    flat = rows.select(visit, pairs).where((F.col("text") != "") & (F.lower("text") != placeholder))
    return A.collapse(flat, [visit, "section", "text"]).withColumn("note_id", ids.prefix_id("note", F.col(visit), F.col("section"), F.col("text")))


def build_all_notes(sources: list[tuple[str, DataFrame, list[str]]], visit: str, placeholder: str = "richeditcontrol1") -> DataFrame:
    """The notes of several tables, such as main fields, order notes and reports: (name, table, fields); source tells which."""
    parts = [build_notes(df, visit, fields, placeholder).withColumn("source", F.lit(name)) for name, df, fields in sources]
    return reduce(DataFrame.unionByName, parts)


def build_observations(labs: DataFrame, vitals: DataFrame | None, visit: str, name: str, result: str, time: str, vital_columns: list[str] | None = None, source_row: str = "source_row", unit: str | None = None) -> DataFrame:
    """Laboratory rows and vital signs as one table with typed results; a row's unit is the unit column's, else the one in its result."""
    own = (text.clean(F.col(unit)) if unit else F.lit("")).alias("unit")
    rows = labs.select(F.col(visit).alias("visit_id"), F.lit("lab").alias("source"), text.clean(F.col(name)).alias("name"), F.col(result).cast("string").alias("value"), own, F.col(time).alias("time"), F.col(source_row).alias("source_row"))
    if vitals is not None and vital_columns:
        pairs = F.inline(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in vital_columns)))
        rows = rows.unionByName(vitals.select(F.col(visit).alias("visit_id"), F.lit("vital").alias("source"), F.lit("").alias("unit"), F.col(time).alias("time"), F.col(source_row).alias("source_row"), pairs).where("value IS NOT NULL"))
    typed = rows.withColumn("r", parse.parse_result(F.col("value"))).select("visit_id", "source", "name", "unit", "time", "source_row", "r.*")
    typed = typed.withColumn("unit", F.coalesce(F.nullif("unit", F.lit("")), "value_unit"))
    return typed.withColumn("entity", text.entity_key(F.col("name"))).withColumn("unit_key", text.entity_key(F.col("unit"))).withColumn("observation_id", ids.prefix_id("obs", F.col("visit_id"), F.col("source"), F.col("name"), F.col("result_raw"), F.col("source_row").cast("string")))


def assign_tail_proxies(observations: DataFrame, keys: tuple[str, ...] = ("entity", "unit_key")) -> DataFrame:
    """Right-censored rows get their bound plus the median tail of the exact values of their test and unit above it; without any, their bound."""
    right = F.col("result_operator").isin(">", ">=") & (F.col("result_type") == "numeric_censored")
    exact = F.when(F.col("result_type").isin("numeric_exact", "numeric_with_unit"), F.col("result_numeric"))
    tails = A.group_tail_median(observations.withColumn("_x", exact).withColumn("_b", F.when(right, F.col("result_lower_bound"))), list(keys), "_x", "_b")
    # Only right-censored rows meet the tails: the others have no bound and would meet in one task as rows of one key.
    censored = F.coalesce(right, F.lit(False))
    out = observations.where(censored).join(tails.withColumnRenamed("bound", "result_lower_bound"), [*keys, "result_lower_bound"], "left")
    found = F.col("tail").isNotNull()
    proxy = F.when(found, F.col("result_lower_bound") + F.col("tail")).otherwise(F.col("result_lower_bound"))
    method = F.when(found, "threshold_plus_group_tail_median").otherwise("lower_bound_fallback")
    out = out.withColumn("value_proxy", proxy).withColumn("proxy_method", method).select(*observations.columns)
    return out.unionByName(observations.where(~censored))


def attach_summary(visits: DataFrame, notes: DataFrame, tables: dict[str, DataFrame], visit: str = "visit_id") -> DataFrame:
    """Visits with one assembled note and the counts of their tables."""
    joined = notes.groupBy(visit).agg(A.note("section", "text", "section", "text").alias("clinical_note"))
    return A.table_counts(visits, tables, visit).join(joined, visit, "left").withColumn("clinical_note", F.coalesce("clinical_note", F.lit("")))


def visit_records(visits: DataFrame, tables: dict[str, tuple[DataFrame, list[str], list[str]]], visit: str = "visit_id") -> DataFrame:
    """One row a visit with a JSON array of records for each table: name -> (table, columns, order)."""
    out = visits
    for name, (df, columns, order) in tables.items():
        out = out.join(df.groupBy(visit).agg(A.json_records(columns, *order).alias(f"{name}_json")), visit, "left").withColumn(f"{name}_json", F.coalesce(f"{name}_json", F.lit("[]")))
    return out


def enrich(df: DataFrame, name: str, vocabulary: dict[str, str]) -> DataFrame:
    """Adds the entity key of a name and its canonical form from a fixed dictionary."""
    key = text.entity_key(F.col(name))
    canon = key
    for k, v in vocabulary.items():
        canon = F.when(key == k, F.lit(v)).otherwise(canon)
    return df.withColumn(f"{name}_key", key).withColumn(f"{name}_canonical", canon)


def header_rows(df: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    """keys, place (from 0), header: text.unique_headers of each group's names in the order of a column, a row a header.

    A repeated name is numbered by its place among its equals, so a header row of any width takes the time of sorting it.
    """
    row = Window.partitionBy(*keys)
    cleaned = df.select(*keys, (F.row_number().over(row.orderBy(order)) - 1).cast("long").alias("place"), text.collapse(F.coalesce(name, F.lit(""))).alias("_t"))
    named = cleaned.withColumn("_t", F.when(F.lower("_t").isin(*text.MISSING_STRICT), F.concat(F.lit("unnamed_column_"), (F.col("place") + 1).cast("string"))).otherwise(F.col("_t")))
    k = F.row_number().over(Window.partitionBy(*keys, "_t").orderBy("place"))
    return named.withColumn("_k", k).select(*keys, "place", F.when(F.col("_k") == 1, F.col("_t")).otherwise(F.concat("_t", F.lit("__"), F.col("_k").cast("string"))).alias("header"))


def without_identifiers(df: DataFrame, names: list[str]) -> DataFrame:
    """The table without direct identifiers."""
    return df.drop(*names)


def close_names(df: DataFrame, column: str, least: float = 0.92, top: int = 500, most: int = 2) -> DataFrame:
    """value, suggested, similarity: the close spellings among the top most frequent values with other keys, for review and never merged.

    Closeness is twice the characters in matching blocks over both lengths. Of the most (2) values closest to a
    value, itself among them and the larger text first among equals, those with another entity key stay; similarity is
    without regard to case. The limits are the feature. Two values can only reach least if the shorter has
    least / (2 - least) of the longer one's length, so a value meets those of such lengths, and only these are compared.
    """

    @F.pandas_udf("double")
    def matching(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype=float)

    values = df.select(text.clean(F.col(column)).alias("v")).where("v <> ''").groupBy("v").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "v").limit(top)
    keyed = values.select("v", text.entity_key(F.col("v")).alias("k"), F.length("v").alias("l"))
    share = least / (2 - least)
    lengths = F.sequence(F.ceil(F.col("l") * share - 1e-9).cast("int"), F.floor(F.col("l") / share + 1e-9).cast("int"))
    x = keyed.select(F.col("v").alias("value"), F.col("k").alias("kx"), F.explode(lengths).alias("l"))
    pairs = x.join(keyed.withColumnRenamed("v", "suggested"), "l")
    scored = pairs.withColumn("s", matching(F.col("suggested"), F.col("value"))).where(F.col("s") >= least)
    w = Window.partitionBy("value").orderBy(F.desc("s"), F.desc("suggested"))
    near = scored.withColumn("r", F.row_number().over(w)).where((F.col("r") <= most) & (F.col("suggested") != F.col("value")) & (F.col("k") != F.col("kx")))
    return near.select("value", "suggested", matching(text.casefold(F.col("value")), text.casefold(F.col("suggested"))).alias("similarity"))


def packets(visits: DataFrame, tables: dict[str, tuple[DataFrame, list[str], list[str]]], order_fields: dict[str, tuple[DataFrame, str]] | None = None, private: tuple[str, ...] = (), patient: str = "patient_id", visit: str = "visit_id") -> DataFrame:
    """One row a (patient, visit): its own fields and those of its tables as arrays of structs, for one document a visit.

    tables: name -> (table with the visit's keys, columns, order). order_fields: name -> (table, key), whose rows go by
    that key into a list beside each row of 'procedures'. Private columns enter no packet.
    """
    out = visits.select(patient, visit, F.struct(*(c for c in visits.columns if c not in (patient, visit, *private))).alias("fields"))
    for name, (df, columns, order) in tables.items():
        kept = [c for c in columns if c not in private]
        if name == "procedures":
            for extra, (rows, key) in (order_fields or {}).items():
                listed = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*sorted(c for c in rows.columns if c not in (key, *private))))).alias(extra))
                df, kept = df.join(listed, key, "left").withColumn(extra, F.coalesce(extra, F.array().cast(listed.schema[extra].dataType))), [*kept, extra]
        rows = F.array_sort(F.collect_list(F.struct(*(F.col(o).alias(f"_o{i}") for i, o in enumerate(order)), F.struct(*kept).alias("_r"))))
        one = df.groupBy(patient, visit).agg(F.transform(rows, lambda r: r["_r"]).alias(name))
        out = out.join(one, [patient, visit], "left").withColumn(name, F.coalesce(name, F.array().cast(one.schema[name].dataType)))
    return out


def read_model(ehr: DataFrame, labels: list[tuple[str, str]], labs: DataFrame, canonical: DataFrame | None = None, patient: str = "patient_id", visit: str = "visit_id") -> DataFrame:
    """One row a (patient, visit) for display: details, (label, text) pairs in order, and labs with their flag.

    Details are the labelled columns that have text, then the other columns by name, then the canonical table's values that
    differ from them, marked as such. labs: name, value, unit, range, time; missing names, values and ranges show a dash.
    """
    shown = [c for c, _ in labels]
    rest = [c for c in ehr.columns if c not in (patient, visit, *shown)]
    pair = lambda label, value: F.when(F.coalesce(value, F.lit("")) != "", F.struct(F.lit(label).alias("label"), value.alias("value")))
    pairs = [pair(label, F.col(c).cast("string")) for c, label in labels] + [pair(c, F.col(c).cast("string")) for c in sorted(rest)]
    out = ehr
    if canonical is not None:
        more = [c for c in canonical.columns if c not in (patient, visit)]
        out = ehr.join(canonical.select(patient, visit, *(F.col(c).alias(f"_canon_{c}") for c in more)), [patient, visit], "left")
        same = lambda c: F.col(f"_canon_{c}").cast("string").eqNullSafe(F.col(c).cast("string")) if c in ehr.columns else F.lit(False)
        pairs += [F.when(~same(c), pair(f"{c} (canonical)", F.col(f"_canon_{c}").cast("string"))) for c in more]
    details = out.select(patient, visit, F.filter(F.array(*pairs), lambda p: p.isNotNull()).alias("details"))
    dash = lambda c: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("—"))
    row = F.struct(F.col("time").alias("time"), dash("name").alias("name"), dash("value").alias("value"), F.coalesce(F.col("unit"), F.lit("")).alias("unit"), dash("range").alias("range"), text.is_flagged(F.col("value").cast("string"), F.col("range")).alias("flagged"))
    listed = labs.groupBy(patient, visit).agg(F.array_sort(F.collect_list(row)).alias("labs"))
    return details.join(listed, [patient, visit], "left").withColumn("labs", F.coalesce("labs", F.array().cast(listed.schema["labs"].dataType)))
