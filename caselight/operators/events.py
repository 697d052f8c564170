"""Event store, targets and timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from caselight.functions import ids, parse
from caselight.operators import aggregates as A
from caselight.operators import joins as J
from caselight.operators import windows as W
from caselight.session import dealt
from caselight.sources.readers import union_projected

#: The order of sources at one time.
PRIORITY = {"demographics": 0, "diagnoses": 20, "medicines": 30, "procedures": 40, "observations": 50}


def project(df: DataFrame, source: str, patient: str, visit: str, time: str, code: Column, value: Column | None = None, text: Column | None = None) -> DataFrame:
    """A source table's rows as events; rows without a code leave."""
    rows = df.select(
        F.lit(source).alias("source_table"), F.col(patient).cast("string").alias("patient_id"), F.coalesce(F.col(visit).cast("string"), F.lit("")).alias("visit_id"), F.col(time).alias("time"),
        code.alias("code"), (value if value is not None else F.lit(None)).cast("double").alias("numeric_value"), (text if text is not None else F.lit(None)).cast("string").alias("text_value"),
    )
    rows = rows.where(~F.col("code").isin("", "name:", "code:"))
    return rows.withColumn("priority", F.lit(PRIORITY.get(source, 99))).withColumn("event_id", ids.event_id(F.col("source_table"), F.col("patient_id"), F.col("visit_id"), F.col("time"), F.col("code"), F.col("numeric_value"), F.col("text_value")))


def demographic_events(visits: DataFrame, patient: str = "patient_id", admission: str = "admission_time", gender: str = "gender_code", birth: str = "birth_year") -> DataFrame:
    """One gender event a patient, at the time of birth, from its first visit."""
    first = visits.groupBy(patient).agg(F.min_by(F.struct(gender, birth), F.struct(admission, "visit_id")).alias("f"))
    born = F.make_date(F.col(f"f.{birth}"), F.lit(1), F.lit(1)).cast("timestamp_ntz")
    return project(first.withColumn("time", born).withColumn("visit_id", F.lit("")), "demographics", patient, "visit_id", "time", F.concat(F.lit("GENDER/"), F.col(f"f.{gender}")))


def build_events(parts: list[DataFrame]) -> DataFrame:
    """All events with their place in the patient's and the visit's order; equal events count once.

    An id says all that an event holds but its priority, which its source sets, so events are made distinct on their
    columns and the ids are worked out afterwards, once an event. Rows move once, by patient.
    """
    columns = ["source_table", "patient_id", "visit_id", "time", "code", "numeric_value", "text_value", "priority"]
    rows = dealt(union_projected(parts).select(columns), "patient_id").distinct()
    rows = rows.withColumn("event_id", ids.event_id(*(F.col(c) for c in columns[:-1])))
    order = [F.asc_nulls_last("time"), "priority", "event_id"]
    return W.ordinal(W.ordinal(rows, ["patient_id"], order, "patient_ordinal"), ["patient_id", "visit_id"], order, "visit_ordinal")


def context_events(events: DataFrame, mapping: DataFrame, visits: DataFrame, visit_code: str = "Visit/IP", birth_code: str = "SNOMED/3950001") -> DataFrame:
    """Mapped events with those of visits and of patients' birth and gender, each patient's in order.

    A visit's event is at its admission; a patient's birth is on the first day of the year, if from 1900 to 2100, and its
    gender at its first admission. In one patient, times come first, unknown ones last, then priority and id.
    """
    columns = ["source_table", "patient_id", "visit_id", "time", "code", "numeric_value", "priority", "event_id"]
    mapped_ = mapped(events, mapping).drop("code").withColumnRenamed("target_code", "code").select(columns)
    first = visits.groupBy("patient_id").agg(F.min_by(F.struct("admission_time", "birth_year", "gender_code"), F.struct("admission_time", "visit_id")).alias("f"))
    when_born = F.make_date(F.col("f.birth_year"), F.lit(1), F.lit(1))

    def person(source: str, rows: DataFrame, visit: Column, time: Column, code: Column, priority: int) -> DataFrame:
        out = rows.select(F.lit(source).alias("source_table"), "patient_id", visit.alias("visit_id"), time.cast("timestamp_ntz").alias("time"), code.alias("code"), F.lit(None).cast("double").alias("numeric_value"), F.lit(priority).alias("priority"))
        return out.withColumn("event_id", ids.event_id(F.col("source_table"), F.col("patient_id"), F.col("visit_id"), F.col("code")))

    parts = [
        mapped_.withColumn("time", F.col("time").cast("timestamp_ntz")), person("visits", visits, F.col("visit_id"), F.col("admission_time"), F.lit(visit_code), 10),
        person("demographics", first.where(F.col("f.birth_year").between(1900, 2100)), F.lit(""), when_born, F.lit(birth_code), 0),
        person("demographics", first.where(F.coalesce(F.col("f.gender_code"), F.lit("")) != ""), F.lit(""), F.col("f.admission_time"), F.concat(F.lit("Gender/"), F.col("f.gender_code")), 1),
    ]
    return W.ordinal(union_projected(parts), ["patient_id"], [F.asc_nulls_last("time"), "priority", "event_id"], "patient_ordinal")


def place(events: DataFrame, visits: DataFrame) -> DataFrame:
    """Events with imputed times and their status against their visit."""
    v = visits.select("visit_id", "admission_time", "discharge_time")
    out = J.checked(events, v, ["visit_id"], "left", "visit_known")
    t = parse.imputed_time(F.col("time"), ("discharge", F.col("discharge_time")), ("admission", F.col("admission_time")))
    out = out.withColumn("_t", t).withColumn("time", F.col("_t.time")).withColumn("time_imputed", F.col("_t.imputed")).withColumn("time_source", F.col("_t.source")).drop("_t")
    return out.withColumn("temporal_status", parse.temporal_status(F.col("time"), F.col("admission_time"), F.col("discharge_time")))


def mapped(events: DataFrame, mapping: DataFrame) -> DataFrame:
    """Events whose concept has an approved target, with converted values. The map is editable and small; its join is left to the planner."""
    m = mapping.where("status = 'approved'").select("source_table", F.col("source_key").alias("code"), "target_code", (F.lower("use_value") == "true").alias("_use"), F.col("multiplier").try_cast("double").alias("_m"), F.col("offset").try_cast("double").alias("_o"))
    out = events.join(m, ["source_table", "code"])
    value = F.when(F.col("_use") & F.col("numeric_value").isNotNull(), F.col("numeric_value") * F.coalesce("_m", F.lit(1.0)) + F.coalesce("_o", F.lit(0.0)))
    return out.withColumn("numeric_value", value).drop("_use", "_m", "_o")


def coverage(events: DataFrame, mapping: DataFrame) -> DataFrame:
    """source_table, n_events, n_mapped, share of events with an approved concept."""
    m = mapping.where("status = 'approved'").select("source_table", F.col("source_key").alias("code")).distinct().withColumn("_ok", F.lit(True))
    rows = events.join(m, ["source_table", "code"], "left")
    return rows.groupBy("source_table").agg(F.count(F.lit(1)).alias("n_events"), F.count_if(F.coalesce("_ok", F.lit(False))).alias("n_mapped")).withColumn("share", F.col("n_mapped") / F.col("n_events"))


def targets(visits: DataFrame, events: DataFrame) -> DataFrame:
    """One row a visit: the cutoff is its discharge, else its last own event, else its admission; and its ordinal."""
    last = events.where("visit_id <> ''").groupBy("visit_id").agg(F.max("time").alias("_last"))
    out = visits.select("visit_id", "patient_id", "admission_time", "discharge_time").join(last, "visit_id", "left")
    out = out.withColumn("cutoff", F.coalesce("discharge_time", "_last", "admission_time")).drop("_last")
    return W.ordinal(out, ["patient_id"], [F.asc_nulls_last("admission_time"), "visit_id"], "visit_number")


def timelines(events: DataFrame, goals: DataFrame, mode: str = "history") -> DataFrame:
    """The events of every target: its patient's up to the cutoff, or its own visit's."""
    e = events.select("event_id", "patient_id", F.col("visit_id").alias("event_visit_id"), "time", "priority", "code", "source_table")
    t = goals.select(F.col("visit_id").alias("target_visit_id"), "patient_id", "cutoff")
    if mode == "visit_only":  # by equality on the visit; only events of no visit meet all of a patient's targets
        own = t.join(e.where("event_visit_id <> ''").withColumnRenamed("patient_id", "_p"), (F.col("target_visit_id") == F.col("event_visit_id")) & (F.col("patient_id") == F.col("_p"))).drop("_p")
        free = t.join(e.where("event_visit_id = ''"), "patient_id")
        rows = own.select(*free.columns).unionByName(free).where("time <= cutoff")
    elif mode == "history":
        rows = t.join(e, "patient_id").where("time <= cutoff")
    else:
        raise ValueError(f"unknown mode {mode}")
    return rows.withColumn("is_current", F.col("event_visit_id") == F.col("target_visit_id"))


def preflight(lines: DataFrame) -> DataFrame:
    """Each target's events, current events, visits, first and last time."""
    visits = F.countDistinct(F.nullif("event_visit_id", F.lit("")))
    return lines.groupBy("target_visit_id").agg(F.count(F.lit(1)).alias("n_events"), F.count_if("is_current").alias("n_current"), visits.alias("n_visits"), F.min("time").alias("first_time"), F.max("time").alias("last_time"))


def history_counts(events: DataFrame, goals: DataFrame) -> DataFrame:
    """The counts that preflight gives of full histories, without listing them.

    A patient's events and cutoffs go in one order in time, and a cutoff's counts are running ones, so a long-lived
    patient costs its rows and not their product with its targets. A visit counts from its first event on.
    """
    e = events.where("time IS NOT NULL").select("patient_id", F.col("visit_id").cast("string").alias("visit_id"), "time")
    goals = goals.withColumn("visit_id", F.col("visit_id").cast("string"))
    rows = e.select("patient_id", "visit_id", "time", F.lit(None).cast("string").alias("target_visit_id"), F.lit(1).alias("n"), F.col("time").alias("at"))
    cut = goals.where("cutoff IS NOT NULL").select("patient_id", "visit_id", F.col("cutoff").alias("time"), F.col("visit_id").alias("target_visit_id"), F.lit(0).alias("n"), F.lit(None).cast(e.schema["time"].dataType).alias("at"))
    upto = lambda *keys: Window.partitionBy(*keys).orderBy("time", "target_visit_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # A visit's running count tells its first event, and at a cutoff the target's own events.
    both = dealt(rows.unionByName(cut), "patient_id").withColumn("own", F.sum("n").over(upto("patient_id", "visit_id")))
    both = both.withColumn("v", ((F.col("n") == 1) & (F.col("own") == 1) & (F.col("visit_id") != "")).cast("int"))
    w = upto("patient_id")
    counted = both.select("target_visit_id", "patient_id", F.sum("n").over(w).alias("n_events"), "own", F.sum("v").over(w).alias("n_visits"), F.min("at").over(w).alias("first_time"), F.max("at").over(w).alias("last_time"))
    current = F.when(F.col("patient_id").isNotNull(), F.col("own")).otherwise(F.lit(0)).alias("n_current")
    return counted.where("target_visit_id IS NOT NULL AND n_events > 0").select("target_visit_id", "n_events", current, "n_visits", "first_time", "last_time")


def serialise(lines: DataFrame, line: Column, limit: int) -> DataFrame:
    """Each target's events as one text in order, its words, SHA-256 and whether it passes the limit of words."""
    rows = F.array_sort(F.collect_list(F.struct("time", "priority", "event_id", line.alias("_l"))))
    text = F.array_join(F.transform(rows, lambda r: r["_l"]), "\n")
    out = lines.groupBy("target_visit_id").agg(text.alias("text"))
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    return out.withColumn("n_words", words).withColumn("sha256", F.sha2(F.col("text").cast("binary"), 256)).withColumn("over_limit", F.col("n_words") > limit)


def tokenise(lines: DataFrame, vocabulary: DataFrame, value_kind: Column) -> DataFrame:
    """Events with the token of their code and kind of value, else of the code alone, else null."""
    v = vocabulary.select("code", "kind", "token")
    exact = v.withColumnRenamed("token", "_exact")
    plain = v.where("kind = ''").select("code", F.col("token").alias("_plain"))
    rows = lines.withColumn("kind", value_kind).join(exact, ["code", "kind"], "left").join(plain, "code", "left")
    return rows.withColumn("token", F.coalesce("_exact", "_plain")).withColumn("fallback", F.col("_exact").isNull() & F.col("_plain").isNotNull()).drop("_exact", "_plain")


def rebuild_window(events: DataFrame, demographic: Column, ordinal: str, first: Column) -> DataFrame:
    """The rows of a selected window from the ordinal it starts at; a window without one holds demographics only."""
    return events.where(demographic | F.coalesce(F.col(ordinal) >= first, F.lit(False)))


def coverage_gate(tokens: DataFrame, least: float = 0.95) -> DataFrame:
    """One row: share of events with a token, targets without any, and whether the gate is passed."""
    per = tokens.groupBy("target_visit_id").agg(F.count_if(F.col("token").isNotNull()).alias("k"), F.count(F.lit(1)).alias("n"))
    out = per.agg((F.sum("k") / F.sum("n")).alias("share"), F.count_if(F.col("k") == 0).alias("n_empty"))
    return out.withColumn("passed", (F.col("share") >= least) & (F.col("n_empty") == 0))


def inventory(events: DataFrame) -> DataFrame:
    """Concepts with their counts and cumulative share of their source."""
    one = A.concept_inventory(events, ["source_table", "code"], "visit_id", "patient_id", "event_id", "event_id")
    return W.cumulative_share(one, ["source_table"], "n_events", "code")


def windowed_tokens(events: DataFrame, n: int) -> DataFrame:
    """target_visit_id with its last n codes in order."""
    return W.last_values(events, ["target_visit_id"], ["time", "priority", "event_id"], "code", n, "codes")


def target_order(goals: DataFrame) -> DataFrame:
    """Targets with their place among all targets: by patient, admission and visit."""
    return W.placed(goals, ["patient_id", F.asc_nulls_last("admission_time"), "visit_id"], "target_index")


def notes_text(notes: DataFrame, visits: DataFrame, visit: str, order: str, section: str, text: str, stored: str | None = None) -> DataFrame:
    """One text a visit from its notes in a given order; with a stored text, whether the two agree."""
    one = notes.groupBy(visit).agg(A.note(section, text, order).alias("note"))
    out = visits.join(one, visit, "left").withColumn("note", F.coalesce("note", F.lit("")))
    return out.withColumn("agrees", F.col("note") == F.coalesce(F.col(stored), F.lit(""))) if stored else out


def audits(sources: list[str], statuses: list[str], concept: Column) -> dict[str, Column]:
    """Named global counts of placed events: by source and temporal status, imputed times, mapped concepts, missing values, first and last time."""
    out = {"n_events": F.count(F.lit(1)), "n_imputed": F.count_if(F.coalesce(F.col("time_imputed"), F.lit(False))), "n_mapped": F.count_if(concept.isNotNull()), "n_values": F.count("numeric_value"), "n_without_time": F.count_if(F.col("time").isNull())}
    out |= {f"source:{s}": F.count_if(F.col("source_table") == s) for s in sources} | {"source:other": F.count_if(~F.col("source_table").isin(sources))}
    out |= {f"status:{s}": F.count_if(F.col("temporal_status") == s) for s in statuses} | {"status:other": F.count_if(~F.coalesce(F.col("temporal_status").isin(statuses), F.lit(False)))}
    return out | {"first_day": F.date_diff(F.min("time"), F.lit("1970-01-01").cast("date")), "last_day": F.date_diff(F.max("time"), F.lit("1970-01-01").cast("date"))}


def write_audited(df: DataFrame, path: str, measures: dict[str, Column]) -> dict[str, int | None]:
    """Writes the rows and returns the measures, taken from the pass that writes them; nothing is scanned for the audit alone."""
    seen = Observation()
    df.observe(seen, *(c.alias(n) for n, c in measures.items())).write.mode("error").parquet(path)
    return dict(seen.get)


def adjacent(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows with the next row's order columns in their group."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.select("*", *(F.lead(o).over(w).alias(f"next_{o}") for o in order))
