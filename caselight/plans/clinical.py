"""Queries on text, parsing, clinical tables, events and evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caselight.functions import ids, parse, text
from caselight.operators import events as E
from caselight.operators import evidence as X
from caselight.operators import quality as Q
from caselight.operators import tables as B
from caselight.plans import query
from caselight.session import table
from caselight.sources import sinks


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result texts of every shape from the events' values."""
    v = F.round("value", 2).cast("string")
    shape = F.pmod("event_id", F.lit(8))
    s = F.when(shape == 0, F.concat(F.lit("< "), v)).when(shape == 1, F.concat(F.lit(">="), v)).when(shape == 2, F.concat(v, F.lit(" - "), F.round(F.col("value") + 1, 2).cast("string")))
    s = s.when(shape == 3, F.concat(F.lit("~"), v, F.lit(" mg"))).when(shape == 4, F.lit("+++")).when(shape == 5, F.lit("Positive")).when(shape == 6, F.lit("see note")).otherwise(F.replace(v, F.lit("."), F.lit(",")))
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts", s.alias("result"))


@query("""
SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'numeric_censored' WHEN 1 THEN 'numeric_censored' WHEN 2 THEN 'numeric_interval' WHEN 3 THEN 'numeric_approx' WHEN 4 THEN 'semi_quantitative' WHEN 5 THEN 'categorical' WHEN 6 THEN 'free_text' ELSE 'numeric_exact' END AS result_type,
  CASE event_id % 8 WHEN 0 THEN '<' WHEN 1 THEN '>=' ELSE '' END AS result_operator, CASE event_id % 8 WHEN 4 THEN 'positive_plusplusplus' WHEN 5 THEN 'positive' ELSE '' END AS result_category,
  CAST(CASE event_id % 8 WHEN 4 THEN 3.0 END AS DOUBLE) AS ordinal_level, CASE event_id % 8 WHEN 3 THEN 'mg' ELSE '' END AS value_unit FROM events
""")
def parse_result_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed results of derived texts."""
    return _results(spark, sf_dir).select("event_id", parse.parse_result(F.col("result")).alias("r")).select("event_id", "r.result_type", "r.result_operator", "r.result_category", "r.ordinal_level", "r.value_unit")


_SHAPES = """
e AS (SELECT event_id, user_id, event_type, ts, round(value, 2) AS v, round(value + 1, 2) AS w, event_id % 8 AS s FROM events),
r AS (SELECT *, CASE s WHEN 0 THEN 'numeric_censored' WHEN 1 THEN 'numeric_censored' WHEN 2 THEN 'numeric_interval' WHEN 3 THEN 'numeric_approx' WHEN 4 THEN 'semi_quantitative' WHEN 5 THEN 'categorical' WHEN 6 THEN 'free_text' ELSE 'numeric_exact' END AS result_type,
  CASE s WHEN 0 THEN '< ' || v WHEN 1 THEN '>=' || v WHEN 2 THEN v || ' - ' || w WHEN 3 THEN '~' || v || ' mg' WHEN 4 THEN '+++' WHEN 5 THEN 'Positive' WHEN 6 THEN 'see note' ELSE replace(v::VARCHAR, '.', ',') END AS result_raw,
  CASE WHEN s IN (3, 7) THEN v END AS result_numeric, CASE s WHEN 0 THEN v / 2 WHEN 1 THEN v WHEN 2 THEN (v + w) / 2 WHEN 3 THEN v WHEN 7 THEN v END AS value_proxy,
  CASE s WHEN 0 THEN 'half_upper_bound_nonnegative' WHEN 1 THEN 'lower_bound' WHEN 2 THEN 'interval_midpoint' WHEN 3 THEN 'approximate_value' WHEN 7 THEN 'exact_value' ELSE '' END AS proxy_method,
  CASE s WHEN 3 THEN 'approximate' ELSE '' END AS numeric_subtype, CASE s WHEN 3 THEN 'mg' ELSE '' END AS value_unit, CASE s WHEN 0 THEN '<' WHEN 1 THEN '>=' ELSE '' END AS result_operator,
  CASE WHEN s IN (1, 2) THEN v END AS result_lower_bound, CASE s WHEN 0 THEN v WHEN 2 THEN w END AS result_upper_bound, CASE s WHEN 4 THEN 'positive_plusplusplus' WHEN 5 THEN 'positive' ELSE '' END AS result_category,
  CASE s WHEN 4 THEN 'semi_quantitative' WHEN 5 THEN 'polarity' ELSE '' END AS result_category_group, CAST(CASE s WHEN 4 THEN 3.0 END AS DOUBLE) AS ordinal_level FROM e)
"""


@query(f"""
WITH {_SHAPES} SELECT event_id, result_raw, result_type, result_numeric, round(value_proxy, 6) AS value_proxy, proxy_method, numeric_subtype, value_unit, result_operator, result_lower_bound, result_upper_bound, result_category, result_category_group, ordinal_level,
  round(value_proxy, 6) AS proxy, CASE s WHEN 7 THEN v END AS numeric_value, CASE WHEN s IN (4, 5) THEN result_category WHEN s <> 7 THEN result_raw END AS text_value FROM r
""")
def parse_result_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fields of the typed results, with proxies and projected values."""
    out = _results(spark, sf_dir).select("event_id", parse.parse_result(F.col("result")).alias("r")).select("event_id", "r.*")
    proxy = parse.observation_proxy(F.col("value_proxy"), F.col("result_numeric"), F.col("result_lower_bound"), F.col("result_upper_bound"))
    value = parse.observation_values(F.col("result_type"), F.col("result_numeric"), F.col("result_category"), F.col("result_raw"))
    out = out.withColumn("proxy", F.round(proxy, 6)).withColumn("v", value).withColumn("value_proxy", F.round("value_proxy", 6))
    return out.select("*", F.col("v.numeric").alias("numeric_value"), F.col("v.text").alias("text_value")).drop("v")


@query("SELECT doc_id, trim(regexp_replace(replace(lower(source || '_ ß-' || lang || ' ' || n_chars), 'ß', 'ss'), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS key FROM documents")
def entity_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised keys."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", text.entity_key(F.concat("source", F.lit("_ ß-"), "lang", F.lit(" "), F.col("n_chars").cast("string"))).alias("key"))


@query("SELECT p_partkey, upper(replace(replace(p_type, '.', ''), ' ', '')) AS code, CASE WHEN p_size % 3 = 0 THEN 'J18.9' ELSE p_type END AS raw, p_size % 3 = 0 AS is_icd, CASE WHEN p_size % 3 = 0 THEN 'ICD10CM/J18.9' ELSE 'LOCAL/' || p_type END AS concept FROM part")
def icd_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical codes and their strategy."""
    raw = F.when(F.col("p_size") % 3 == 0, "J18.9").otherwise(F.col("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", text.canonical_icd(F.col("p_type")).alias("code"), raw.alias("raw"), text.is_icd10(raw).alias("is_icd"), text.diagnosis_concept(raw, F.lit(""))["code"].alias("concept"))


@query("""
WITH t AS (SELECT o_orderkey, o_orderdate AS d, o_orderdate + to_minutes(o_orderkey % 1440) AS t FROM orders)
SELECT o_orderkey, d::DATE AS compact, t AS minute, d AS day, CAST(NULL AS TIMESTAMP) AS bad, d + to_hours(6 * (o_orderkey % 4)) AS serial, t AS iso, CASE WHEN o_orderkey % 6 IN (2, 5) THEN d ELSE t END AS visit FROM t
""")
def parsed_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times in every layout."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").alias("d"), (F.col("o_orderdate") + F.expr("make_dt_interval(0, 0, CAST(o_orderkey % 1440 AS INT))")).alias("t"))
    as_text = lambda c, layout: F.date_format(c, layout)
    serial = F.concat((F.datediff("d", F.lit("1899-12-30"))).cast("string"), F.element_at(F.array(*map(F.lit, ("", ".25", ".5", ".75"))), (F.col("o_orderkey") % 4 + 1).cast("int")))
    visit = F.lit(None).cast("string")
    for i, layout in enumerate(("yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "dd/MM/yyyy HH:mm:ss", "d/M/yyyy HH:mm", "dd/MM/yyyy")):
        visit = F.when(F.col("o_orderkey") % 6 == i, as_text("t", layout)).otherwise(visit)
    return o.select(
        "o_orderkey", parse.study_date(F.concat(as_text("d", "yyyyMMdd"), F.lit("-x"))).alias("compact"), parse.parse_time(as_text("t", "yyyyMMddHHmm")).alias("minute"), parse.parse_time(F.concat(as_text("d", "yyyyMMdd"), F.lit(".0"))).alias("day"),
        parse.parse_time(F.concat(F.lit("no time "), F.col("o_orderkey").cast("string"))).alias("bad"), parse.parse_time(serial).alias("serial"), parse.parse_time(as_text("t", "yyyy-MM-dd HH:mm:ss")).alias("iso"), parse.parse_date(visit).alias("visit"),
    )


@query("SELECT event_id, value < 20.0 OR value > 60.0 AS flagged FROM events")
def flagged_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values outside their reference range."""
    return table(spark, sf_dir, "events").select("event_id", text.is_flagged(F.replace(F.col("value").cast("string"), F.lit("."), F.lit(",")), F.lit("20,0 - 60.0 U")).alias("flagged"))


@query("SELECT event_id, CASE WHEN event_id % 5 > 1 THEN CASE WHEN event_id % 5 = 2 THEN -value ELSE value END END AS x FROM events")
def parsed_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers with a decimal comma or point; other texts and numbers that aren't finite give null."""
    m, v = F.col("event_id") % 5, F.col("value").cast("string")
    comma = F.replace(v, F.lit("."), F.lit(","))
    raw = F.when(m == 0, "1,2,3").when(m == 1, F.when(F.col("event_id") % 2 == 0, "1e999").otherwise("NaN")).when(m == 2, F.concat(F.lit(" -"), comma)).when(m == 3, F.concat(comma, F.lit(" "))).otherwise(v)
    return table(spark, sf_dir, "events").select("event_id", parse.number(raw).alias("x"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'code:' || c_nationkey WHEN c_custkey % 3 = 1 THEN 'name:' || c_name ELSE 'code_name:' || c_nationkey || '|' || c_name END AS k, CASE WHEN c_custkey % 3 = 1 THEN c_name ELSE c_nationkey::VARCHAR END AS first FROM customer")
def source_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source keys and first non-empty values."""
    c = table(spark, sf_dir, "customer")
    m = F.col("c_custkey") % 3
    code, name = F.when(m == 1, "").otherwise(F.col("c_nationkey").cast("string")), F.when(m == 0, "").otherwise(F.col("c_name"))
    return c.select("c_custkey", text.source_key(code, name, both=True).alias("k"), text.first_nonempty(code, name).alias("first"))


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN '''' || c_acctbal::VARCHAR ELSE c_acctbal::VARCHAR END AS cell FROM customer")
def csv_safe_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that spreadsheets don't read as formulas."""
    return table(spark, sf_dir, "customer").select("c_custkey", sinks.csv_number(F.col("c_acctbal")).alias("cell"))


@query("SELECT doc_id, sha256(text) AS sha256, CAST(ceil(length(text) / 1000.0) AS INTEGER) AS n_pieces FROM documents WHERE length(text) > 0")
def text_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests and pieces of texts."""
    d = table(spark, sf_dir, "documents").where(F.length("text") > 0)
    return d.select("doc_id", text.text_sha256(F.col("text")).alias("sha256"), F.size(text.split_text(F.col("text"), 1000)).alias("n_pieces"))


@query("SELECT c_custkey, 'med_' || substr(sha256('[\"' || c_custkey || '\", \"' || c_mktsegment || '\"]'), 1, 24) AS prefix_id, substr(sha256(c_custkey || chr(31) || c_mktsegment), 1, 24) AS event_id, 'MED:' || substr(sha256(c_mktsegment), 1, 20) AS token FROM customer")
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """§1.4: hash contracts of identifiers."""
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", ids.prefix_id("med", F.col("c_custkey"), F.col("c_mktsegment")).alias("prefix_id"), ids.event_id(F.col("c_custkey"), F.col("c_mktsegment")).alias("event_id"), ids.concept_token("MED", F.col("c_mktsegment")).alias("token"))


def _visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    days = F.expr("make_dt_interval(CAST(o_orderkey % 7 AS INT))")
    return o.select(F.col("o_orderkey").cast("string").alias("visit_id"), F.col("o_custkey").cast("string").alias("patient_id"), F.col("o_orderdate").alias("admission_time"), (F.col("o_orderdate") + days).alias("discharge_time"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    line = table(spark, sf_dir, "lineitem").join(o.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    line = line.join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type", "p_brand"), "l_partkey")
    parts = [
        E.project(o, "diagnoses", "o_custkey", "o_orderkey", "o_orderdate", F.concat(F.lit("code:"), "o_orderpriority")),
        E.project(line, "medicines", "o_custkey", "l_orderkey", "l_shipdate", F.concat(F.lit("code:"), "p_brand"), F.col("l_quantity")),
    ]
    return E.build_events(parts)


@query("""
WITH e AS (SELECT 'diagnoses' AS source_table, o_custkey AS p, o_orderkey AS v, o_orderdate AS t, 'code:' || o_orderpriority AS c, CAST(NULL AS DOUBLE) AS q FROM orders
  UNION SELECT 'medicines', o_custkey, l_orderkey, l_shipdate, 'code:' || p_brand, l_quantity FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey)
SELECT source_table, c AS code, count(*) AS n_events, count(DISTINCT v) AS n_visits, count(DISTINCT p) AS n_patients FROM e GROUP BY ALL
""")
def event_store_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of two sources and their concepts."""
    return E.inventory(_events(spark, sf_dir)).select("source_table", "code", "n_events", "n_visits", "n_patients")


_EVENTS = """
e AS (SELECT 'diagnoses' AS source_table, 20 AS priority, o_custkey::VARCHAR AS p, o_orderkey::VARCHAR AS v, o_orderdate AS t, 'code:' || o_orderpriority AS c, CAST(NULL AS DOUBLE) AS q FROM orders
  UNION SELECT 'medicines', 30, o_custkey::VARCHAR, l_orderkey::VARCHAR, l_shipdate, 'code:' || p_brand, l_quantity FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey),
g AS (SELECT o_orderkey::VARCHAR AS target_visit_id, o_custkey::VARCHAR AS p, o_orderdate + to_days(CAST(o_orderkey % 7 AS INTEGER)) AS cutoff FROM orders)
"""


@query(f"WITH {_EVENTS} SELECT target_visit_id, count(*) AS n_events, count(*) FILTER (WHERE v = target_visit_id) AS n_current, count(DISTINCT v) AS n_visits, min(t) AS first_time, max(t) AS last_time FROM g JOIN e USING (p) WHERE t <= cutoff GROUP BY 1")
def target_timelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the histories of targets."""
    ev = _events(spark, sf_dir)
    return E.history_counts(ev, E.targets(_visits(spark, sf_dir), ev))


@query(f"""
WITH {_EVENTS}, x AS (SELECT *, substr(sha256(concat_ws(chr(31), source_table, p, v, t::VARCHAR, c, coalesce(q::VARCHAR, ''), '')), 1, 24) AS event_id FROM e),
l AS (SELECT target_visit_id, string_agg(strftime(t, '%Y-%m-%d') || ' ' || c, chr(10) ORDER BY t, priority, event_id) AS text FROM g JOIN x USING (p) WHERE t <= cutoff AND v = target_visit_id GROUP BY 1)
SELECT target_visit_id, CAST(len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) AS INTEGER) AS n_words, sha256(text) AS sha256, len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) > 10 AS over_limit FROM l
""")
def timeline_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each target's own visit as text, its words and digest."""
    ev = _events(spark, sf_dir)
    lines = E.timelines(ev, E.targets(_visits(spark, sf_dir), ev), "visit_only")
    return E.serialise(lines, F.concat_ws(" ", F.date_format("time", "yyyy-MM-dd"), "code"), 10).drop("text")


@query("""
WITH e AS (SELECT o_orderkey AS visit_id, 'main' AS field, upper(replace(replace(o_orderpriority, '.', ''), ' ', '')) AS code, '' AS name FROM orders
  UNION ALL SELECT l_orderkey, 'secondary', upper(replace(replace(unnest([l_returnflag, l_linestatus]), '.', ''), ' ', '')), '' FROM lineitem
  UNION ALL SELECT l_orderkey, 'note', '', p_name FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_linenumber = 1 UNION ALL SELECT o_orderkey, 'discharge', upper(replace(replace(o_orderpriority, '.', ''), ' ', '')), 'State-' || o_orderstatus FROM orders WHERE o_orderkey % 2 = 0)
SELECT visit_id::VARCHAR AS visit_id, code, replace(lower(name), '-', ' ') AS name_key, min(name) AS name, string_agg(DISTINCT field, ';' ORDER BY field) AS fields, count(*) AS source_row_count FROM e GROUP BY ALL
""")
def build_diagnoses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and names of four source fields in one table: codes alone, a list of codes, names alone, both."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("patient_id"), F.col("o_orderkey").cast("string").alias("visit_id"), "o_orderpriority", F.concat(F.lit(" State-"), "o_orderstatus").alias("state"), "o_orderkey")
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("visit_id"), F.concat_ws(";", "l_returnflag", "l_linestatus").alias("codes"), "l_partkey", "l_linenumber").join(o.select("visit_id", "patient_id"), "visit_id")
    notes = line.where("l_linenumber = 1").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    sources = [("main", o, "o_orderpriority", None), ("secondary", line, "codes", None), ("note", notes, None, "p_name"), ("discharge", o.where("o_orderkey % 2 = 0"), "o_orderpriority", "state")]
    return B.build_diagnoses(sources).select("visit_id", "code", "name_key", "name", "fields", "source_row_count")


@query("SELECT l_orderkey AS visit_id, l_returnflag, l_linestatus, count(*) AS source_row_count FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') GROUP BY ALL")
def build_medicines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medicine rows of known visits, equal ones once."""
    v = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("visit_id"))
    rows = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "visit_id")
    return B.build_medicines(rows, v, ["l_returnflag", "l_linestatus"]).drop("medicine_id")


@query("""
SELECT conv_id, f AS section, t AS text, count(*) AS source_row_count FROM (SELECT conv_id, unnest(['role', 'text']) AS f, trim(regexp_replace(unnest([role, text]), '\\s+', ' ', 'g')) AS t FROM conversations) WHERE t <> '' AND lower(t) NOT IN ('null', 'none', 'nan', 'nat', 'not available') GROUP BY ALL
""")
def build_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Note fields as rows."""
    return B.build_notes(table(spark, sf_dir, "conversations"), "conv_id", ["role", "text"]).drop("note_id")


@query(f"""
WITH {_SHAPES}, t AS (SELECT a.event_id, quantile_cont(x.v - a.v, 0.5) AS tail FROM r a JOIN r x ON x.event_type = a.event_type AND x.s = 7 AND x.v > a.v WHERE a.s = 1 GROUP BY 1)
SELECT user_id AS visit_id, 'lab' AS source, event_type AS name, event_id AS source_row, result_type, value_unit AS unit, round(value_proxy + coalesce(tail, 0), 6) AS value_proxy,
  CASE WHEN s = 1 THEN CASE WHEN tail IS NULL THEN 'lower_bound_fallback' ELSE 'threshold_plus_group_tail_median' END ELSE proxy_method END AS proxy_method FROM r LEFT JOIN t USING (event_id)
UNION ALL SELECT o_custkey, 'vital', 'price', o_orderkey, 'numeric_exact', '', round(o_totalprice, 6), 'exact_value' FROM orders
UNION ALL SELECT o_custkey, 'vital', 'state', o_orderkey, 'free_text', '', NULL, '' FROM orders
""")
def build_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed results of labs and vital signs, with proxies from the tail of their test and unit."""
    rows = _results(spark, sf_dir).withColumn("source_row", F.col("event_id"))
    vitals = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), F.lit(None).cast("timestamp").alias("ts"), F.col("o_orderkey").alias("source_row"), F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("price"), F.concat(F.lit("state "), "o_orderstatus").alias("state"), F.lit(None).cast("string").alias("pulse"))
    out = B.assign_tail_proxies(B.build_observations(rows, vitals, "user_id", "event_type", "result", "ts", ["price", "state", "pulse"]))
    return out.select("visit_id", "source", "name", "source_row", "result_type", "unit", F.round("value_proxy", 6).alias("value_proxy"), "proxy_method")


@query("""
SELECT conv_id, count(*) AS turns_count, true AS has_turns, string_agg('[' || role || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY role, text) AS clinical_note FROM conversations GROUP BY 1
""")
def visit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One note and table counts a visit."""
    c = table(spark, sf_dir, "conversations")
    notes = c.select("conv_id", F.col("role").alias("section"), "text")
    return B.attach_summary(c.select("conv_id").distinct(), notes, {"turns": c.select("conv_id")}, "conv_id")


@query("""
SELECT o_orderkey AS visit_id, coalesce(lines_json, '[]') AS lines_json FROM orders LEFT JOIN (SELECT l_orderkey, '[' || string_agg('{"l_partkey":' || l_partkey || ',"l_quantity":' || l_quantity || '}', ',' ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey) || ']' AS lines_json FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
""")
def visit_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON records of each visit."""
    v = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("visit_id"))
    line = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "visit_id")
    return B.visit_records(v, {"lines": (line, ["l_partkey", "l_quantity"], ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey"])})


@query("""
WITH d AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id, text ORDER BY turn) > 1 AS duplicate FROM conversations),
w AS (SELECT *, CASE WHEN duplicate THEN 0 ELSE least(length(text), 200) END AS want FROM d),
b AS (SELECT *, coalesce(sum(want) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM w)
SELECT conv_id, turn, duplicate, CAST(greatest(0, least(want, 600 - before)) AS INTEGER) AS taken, substr(text, 1, CAST(greatest(0, least(want, 600 - before)) AS BIGINT)) AS kept_text FROM b
""")
def text_budget_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts under a cap a field and a cap a visit."""
    out = X.budget_profile(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], "text", 200, 600)
    return out.select("conv_id", "turn", "duplicate", "taken", "kept_text")


_STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)


@query(f"""
WITH t AS (SELECT conv_id, turn, role, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), lambda x: length(x) >= 2 AND NOT list_contains([{_STOP}], x)) AS w FROM conversations),
g AS (SELECT *, list_concat(CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' '))) ELSE [] END, CASE WHEN len(w) >= 2 THEN list_distinct(list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i+1], ' '))) ELSE [] END) AS g FROM t),
p AS (SELECT a.conv_id, a.turn, list_distinct(list_intersect(a.w, b.w)) AS t, list_intersect(a.g, b.g) AS p FROM g a JOIN g b ON a.conv_id = b.conv_id AND b.turn = a.turn + 2 AND a.role = b.role),
f AS (SELECT *, lambda_sorted(t, 8) AS terms, lambda_sorted(p, 4) AS phrases FROM p WHERE len(p) > 0 OR len(t) >= 2)
SELECT conv_id, turn, CAST(len(t) AS INTEGER) AS n_terms, CAST(len(p) AS INTEGER) AS n_phrases, terms, phrases, CAST(3 + len(t) + 3 * coalesce(list_sum(list_transform(p, lambda x: length(x) - length(replace(x, ' ', '')) + 1)), 0) AS INTEGER) AS score FROM f
""".replace("lambda_sorted(t, 8)", "array_to_string(list_transform(list_sort(list_transform(t, lambda x: {'n': -length(x), 'x': x}))[1:8], lambda s: s.x), '|')").replace("lambda_sorted(p, 4)", "array_to_string(list_transform(list_sort(list_transform(p, lambda x: {'n': -length(x), 'x': x}))[1:4], lambda s: s.x), '|')"))
def shared_terms_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared terms and phrases of a speaker's turns that follow one another."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", X.terms_of(F.col("text")).alias("own"))
    pairs = c.join(c.select("conv_id", (F.col("turn") - 2).alias("turn"), F.col("role").alias("other_role"), F.col("own").alias("other")), ["conv_id", "turn"])
    out = X.shared_terms(pairs, "own", "other", "role", "other_role")
    return out.select("conv_id", "turn", "n_terms", "n_phrases", F.array_join("terms", "|").alias("terms"), F.array_join("phrases", "|").alias("phrases"), "score")


@query("""
WITH r AS (SELECT user_id, lower(trim(event_type)) AS n, value, row_number() OVER (PARTITION BY user_id, lower(trim(event_type)) ORDER BY ts DESC, value) AS r FROM events),
t AS (SELECT user_id, n, string_agg(value::VARCHAR, ';' ORDER BY r) AS x, bool_or(value > 50) AS f FROM r WHERE r <= 3 GROUP BY ALL),
p AS (SELECT user_id AS l, lead(user_id) OVER (ORDER BY user_id) AS r FROM (SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL))
SELECT p.l AS "left", p.r AS "right", a.n AS name, a.x AS left_values, b.x AS right_values, a.f AND b.f AS both_flagged FROM p JOIN t a ON a.user_id = p.l JOIN t b ON b.user_id = p.r AND b.n = a.n
""")
def shared_labs_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last three results of tests that two patients share, for every patient and the one of the next id."""
    e = table(spark, sf_dir, "events").withColumn("flag", F.col("value") > 50)
    # The next id is in the same range of ids, or the least of the next range with any; one row a range meets in one task.
    users = e.where("user_id IS NOT NULL").select("user_id").distinct().withColumn("range", F.floor(F.col("user_id") / 1000))
    first = users.groupBy("range").agg(F.min("user_id").alias("first"))
    first = first.select("range", F.lead("first").over(Window.orderBy("range")).alias("after"))
    near = users.withColumn("near", F.lead("user_id").over(Window.partitionBy("range").orderBy("user_id")))
    pairs = near.join(first, "range").select(F.col("user_id").alias("left"), F.coalesce("near", "after").alias("right")).where("right IS NOT NULL")
    out = X.shared_labs(pairs, e, "user_id", "event_type", "ts", "value", "flag")
    texts = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), ";").alias(c)
    return out.select("left", "right", "name", texts("left_values"), texts("right_values"), "both_flagged")


@query("""
WITH l AS (SELECT p_brand, list({'priority': p_size % 3, 'size': -CAST(p_partkey % 5 + 1 AS INTEGER), 's': p_size, 'e': CAST(p_size + p_partkey % 5 + 1 AS INTEGER)}) AS x FROM part GROUP BY 1),
c AS (SELECT p_brand, list_reduce(list_sort(x), lambda acc, s: CASE WHEN len(list_filter(acc, lambda c: s.s < c.e AND c.s < s.e)) > 0 THEN acc ELSE list_append(acc, {'s': s.s, 'e': s.e, 'p': s.priority}) END, []::STRUCT(s INTEGER, e INTEGER, p INTEGER)[]) AS c FROM l)
SELECT p_brand, array_to_string(list_transform(list_sort(c), lambda x: x.s || '-' || x.e || '-' || x.p), ',') AS spans FROM c
""")
def apart_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans that don't overlap, by priority and length."""
    p = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.collect_list(F.struct((F.col("p_size") % 3).alias("priority"), F.col("p_size").alias("start"), (F.col("p_size") + F.col("p_partkey") % 5 + 1).cast("int").alias("end"))).alias("s"))
    return p.select("p_brand", F.array_join(F.transform(X.apart(F.col("s")), lambda x: F.concat_ws("-", x["start"], x["end"], x["priority"])), ",").alias("spans"))


_CELLS = {n: "concat(" + ", ".join(f"coalesce({c}::VARCHAR, chr(30)), chr(31)" for c in sorted(cols)) + ")" for n, cols in {"customer": ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"), "orders": ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")}.items()}


@query(" UNION ALL ".join(f"""
SELECT '{n}' AS "table", count(*) AS rows, sum(('0x' || substr(h, 1, 15))::BIGINT::HUGEINT)::VARCHAR || ':' || sum(('0x' || substr(h, 16, 15))::BIGINT::HUGEINT)::VARCHAR AS digest, '{{"run":"test"}}' AS config FROM (SELECT sha256({c}) AS h FROM {n})""" for n, c in _CELLS.items()))
def table_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q6, Q7: counts and digests of tables."""
    return Q.manifest({n: table(spark, sf_dir, n) for n in _CELLS}, {"run": "test"})


@query()
def close_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Close spellings among the most frequent part names."""
    return B.close_names(table(spark, sf_dir, "part"), "p_name")
