"""Windows by serialised length, commits of several tables, stages that can be taken up again, and checks of written artifacts, over the driver's tables.

The queries that write do so in a folder of their own, gone when the application ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselight.operators import diagnoses as D
from caselight.operators import events as E
from caselight.operators import lengths as L
from caselight.operators import stages as S
from caselight.operators import verify as V
from caselight.plans import query
from caselight.plans.clinical import _EVENTS, _events, _visits
from caselight.session import table, work_folder
from caselight.sources.commits import Store

#: Different words that a window's text may hold; such a length doesn't add up over events.
WORDS = 12


def different_words(texts: list[str]) -> list[int]:
    return [len(set(t.split())) for t in texts]


_LINES = rf"""
{_EVENTS}, x AS (SELECT *, substr(sha256(concat_ws(chr(31), source_table, p, v, t::VARCHAR, c, coalesce(q::VARCHAR, ''), '')), 1, 24) AS event_id, strftime(t, '%Y-%m-%d') || ' ' || c AS line FROM e),
o AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY t, priority, event_id) AS ord FROM x WHERE t IS NOT NULL),
l AS (SELECT target_visit_id, p, v, t, ord, line, v = target_visit_id AS current FROM g JOIN o USING (p) WHERE t <= cutoff)
"""


@query(rf"""
WITH {_LINES}, a AS (SELECT c_custkey::VARCHAR AS p, 'segment ' || c_mktsegment AS line, ['segment', c_mktsegment] AS words FROM customer),
w AS (SELECT target_visit_id, word, max(ord) AS ord FROM (SELECT target_visit_id, p, ord, unnest(string_split_regex(line, '\s+')) AS word FROM l) JOIN a USING (p) WHERE NOT list_contains(words, word) GROUP BY 1, 2),
k AS (SELECT target_visit_id, ord, count(*) AS k FROM w GROUP BY 1, 2),
s AS (SELECT l.*, 2 + sum(coalesce(k, 0)) OVER (PARTITION BY l.target_visit_id ORDER BY l.ord DESC) AS length FROM l LEFT JOIN k USING (target_visit_id, ord)),
f AS (SELECT target_visit_id, min(ord) AS start FROM s WHERE length <= {WORDS} GROUP BY 1),
r AS (SELECT s.target_visit_id, any_value(p) AS p, count(*) AS n_events, count(*) FILTER (WHERE ord >= start) AS n_selected, count(*) FILTER (WHERE current) AS n_current, count(*) FILTER (WHERE current AND ord >= start) AS n_current_selected,
  any_value(start) AS first_ordinal, min(t) FILTER (WHERE ord >= start) AS first_time, max(length) FILTER (WHERE ord >= start) AS length, string_agg(line, chr(10) ORDER BY ord) FILTER (WHERE ord >= start) AS text FROM s JOIN f USING (target_visit_id) GROUP BY 1)
SELECT g.target_visit_id, coalesce(n_events, 0) AS n_events, coalesce(n_selected, 0) AS n_selected, coalesce(n_current, 0) AS n_current, coalesce(n_current_selected, 0) AS n_current_selected, first_ordinal, first_time, coalesce(length, 2)::BIGINT AS length, true AS fits,
  sha256(concat_ws(chr(10), a.line, text)) AS sha256 FROM g JOIN a USING (p) LEFT JOIN r USING (target_visit_id)
""")
def windows_by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every target the longest run of newest events whose whole text holds few enough different words."""
    ev = _events(spark, sf_dir)
    cols = ["patient_id", "visit_id", "time", "priority", "event_id"]
    line = F.concat_ws(" ", F.date_format("time", "yyyy-MM-dd"), "code")
    always = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("patient_id"), F.lit("").alias("visit_id"), F.lit(None).cast("timestamp_ntz").alias("time"), F.lit(0).alias("priority"), F.lit("").alias("event_id"), F.concat(F.lit("segment "), "c_mktsegment").alias("line"), F.lit(True).alias("always"))
    rows = ev.select(*cols, line.alias("line"), F.lit(False).alias("always")).unionByName(always)
    return L.recent_windows(rows, E.targets(_visits(spark, sf_dir), ev), F.col("line"), F.col("always"), different_words, WORDS)


@query(rf"""
WITH {_LINES}, b AS (SELECT target_visit_id, 'full' AS view, line, ord FROM l UNION ALL SELECT target_visit_id, 'current', line, ord FROM l WHERE current),
n AS (SELECT target_visit_id, view, count(DISTINCT word) AS length FROM (SELECT target_visit_id, view, unnest(string_split_regex(line, '\s+')) AS word FROM b) GROUP BY 1, 2)
SELECT view, count(*) AS n_targets, count(*) FILTER (WHERE length > {WORDS}) AS n_over, quantile_cont(length, 0.0) AS shortest, quantile_cont(length, 0.5) AS median, quantile_cont(length, 0.9) AS p90, quantile_cont(length, 0.99) AS p99, quantile_cont(length, 1.0) AS longest FROM n GROUP BY 1
""")
def length_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of every target's whole text in the full and the current view, with those over the limit and quantiles."""
    ev = _events(spark, sf_dir)
    line = F.concat_ws(" ", F.date_format("time", "yyyy-MM-dd"), "code")
    return L.length_summary(L.audited_lengths(ev, E.targets(_visits(spark, sf_dir), ev), line, different_words, WORDS))


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("key"), F.col("o_orderdate").alias("day"), F.col("o_orderkey").alias("order"), F.col("o_orderstatus").alias("status"))


@query("""
WITH h AS (SELECT o_custkey AS key, o_orderdate AS day, o_orderkey AS "order", o_orderstatus AS status FROM orders WHERE o_orderkey % 3 <> 2),
l AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY day DESC, "order" DESC) AS r FROM h)
SELECT l.key, l.day, l."order", l.status, n.n AS n_history, 2::BIGINT AS version, 0::BIGINT AS n_leftovers FROM l JOIN (SELECT key, count(*) AS n FROM h GROUP BY 1) n ON n.key = l.key WHERE r = 1
""")
def committed_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest rows and history after two commits and one that failed midway; each changes both tables or neither."""
    store = Store(spark, work_folder(spark))
    rows = _states(spark, sf_dir)
    store.upsert(rows.where("order % 3 = 0"), "key", "day")

    def fails(_) -> None:
        raise RuntimeError("a check that fails after both tables are written")

    try:
        store.commit({"latest": rows}, {"history": rows.where("order % 3 = 2")}, checks=fails)
    except RuntimeError:
        pass
    version = store.upsert(rows.where("order % 3 = 1"), "key", "day")
    n = store.read("history").groupBy("key").agg(F.count(F.lit(1)).alias("n_history"))
    return store.read("latest").join(n, "key").withColumn("version", F.lit(version).cast("long")).withColumn("n_leftovers", F.lit(len(store.leftovers())).cast("long"))


def paid(lines: DataFrame, least: float) -> DataFrame:
    """The stage's lines of at least a quantity."""
    return lines.where(F.col("l_quantity") >= least).select("l_orderkey", "l_quantity", "l_linestatus")


def by_status(lines: DataFrame) -> DataFrame:
    """Lines and quantity by status."""
    return lines.groupBy("l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").cast("double").alias("quantity"))


@query("""
WITH r AS (SELECT unnest([1, 2, 3, 4]) AS run, unnest([10, 10, 10, 20]) AS least, unnest(['ran', 'skipped', 'stopped', 'ran']) AS lines, unnest(['ran', 'skipped', 'stopped', 'ran']) AS totals),
s AS (SELECT run, least, 'lines' AS stage, lines AS outcome FROM r UNION ALL SELECT run, least, 'totals', totals FROM r)
SELECT run::BIGINT AS run, stage, outcome, CASE stage WHEN 'lines' THEN (SELECT count(*) FROM lineitem WHERE l_quantity >= least) ELSE (SELECT count(DISTINCT l_linestatus) FROM lineitem WHERE l_quantity >= least) END AS rows,
  (SELECT sum(l_quantity)::DOUBLE FROM lineitem WHERE l_quantity >= least) AS quantity FROM s
""")
def resumed_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q6, Q7: two stages run, met again unchanged, stopped by other settings, and run again with them; what the store holds after each."""
    runner = S.Runner(spark, work_folder(spark), {"lineitem": f"{sf_dir}/lineitem.parquet"})
    plan = lambda least: [S.Stage("lines", paid, ("lineitem",), {"least": least}), S.Stage("totals", by_status, ("lines",))]
    out = []
    for run, (least, answer) in enumerate([(10, "rerun"), (10, "rerun"), (20, "stop"), (20, "rerun")], 1):
        try:
            found = runner.run(plan(least), answer)
        except S.ChangedError:
            found = dict.fromkeys(("lines", "totals"), "stopped")
        total = runner.store.read("totals").agg(F.sum("quantity").alias("quantity"))
        for stage, outcome in found.items():
            rows = runner.manifest(stage)["rows"]
            out.append(total.select(F.lit(run).cast("long").alias("run"), F.lit(stage).alias("stage"), F.lit(outcome).alias("outcome"), F.lit(rows).cast("long").alias("rows"), "quantity"))
    first, *rest = out
    for r in rest:
        first = first.unionByName(r)
    return first


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 97 = 0 THEN 'missing' WHEN o_orderkey % 89 = 0 THEN 'count' WHEN o_orderkey % 83 = 0 AND o_orderkey % 79 = 0 THEN 'changed' WHEN o_orderkey % 83 = 0 THEN 'changed' WHEN o_orderkey % 79 = 0 THEN 'changed' END AS reason,
  CASE WHEN o_orderkey % 97 = 0 OR o_orderkey % 89 = 0 THEN '' WHEN o_orderkey % 83 = 0 AND o_orderkey % 79 = 0 THEN 'o_orderstatus,o_totalprice' WHEN o_orderkey % 83 = 0 THEN 'o_orderstatus' ELSE 'o_totalprice' END AS columns
FROM orders WHERE o_orderkey % 97 = 0 OR o_orderkey % 89 = 0 OR o_orderkey % 83 = 0 OR o_orderkey % 79 = 0
UNION ALL SELECT -o_orderkey, 'extra', '' FROM orders WHERE o_orderkey % 101 = 0 AND o_orderkey > 0
""")
def verified_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q5: two written artifacts compared by digests of key ranges; planted faults are found in the differing ranges and named by key and column."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_totalprice").cast("double").alias("o_totalprice"))
    bad = o.where("o_orderkey % 97 <> 0")
    bad = bad.unionByName(bad.where("o_orderkey % 89 = 0")).unionByName(o.where("o_orderkey % 101 = 0 AND o_orderkey > 0").withColumn("o_orderkey", -F.col("o_orderkey")))
    clean = F.expr("o_orderkey < 0 OR o_orderkey % 89 = 0")
    bad = bad.withColumn("o_orderstatus", F.when(~clean & (F.col("o_orderkey") % 83 == 0), F.lit(None)).otherwise(F.col("o_orderstatus")))
    bad = bad.withColumn("o_totalprice", F.when(~clean & (F.col("o_orderkey") % 79 == 0), F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    root = work_folder(spark)
    V.write_artifact(o, f"{root}/a", ["o_orderkey"])
    V.write_artifact(bad, f"{root}/b", ["o_orderkey"])
    return V.differences(spark, f"{root}/a", f"{root}/b", ["o_orderkey"])


@query("""
WITH m AS (SELECT DISTINCT l_partkey AS node, l_orderkey AS edge FROM lineitem)
SELECT node, edge, CASE WHEN (node + edge) % 50 = 0 THEN 'no cell' ELSE 'repeated' END AS reason FROM m WHERE (node + edge) % 50 IN (0, 7)
UNION ALL SELECT node, edge, 'no membership' FROM (SELECT DISTINCT a.node, b.edge FROM (SELECT node, min(edge) AS e FROM m GROUP BY 1) a JOIN (SELECT edge, edge + 1 AS x FROM m GROUP BY 1) b ON b.x = a.e WHERE a.node % 10 = 0) n ANTI JOIN m USING (node, edge)
""")
def incidence_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q5: an incidence matrix with planted faults against the memberships that it is to hold, named by node and edge."""
    m = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("node"), F.col("l_orderkey").alias("edge")).distinct()
    nodes, edges = (m.select(c).distinct().withColumn("index", F.col(c) + shift) for c, shift in (("node", 1000), ("edge", 5)))
    first = m.groupBy("node").agg(F.min("edge").alias("e")).where("node % 10 = 0")
    strange = first.join(edges.select("edge", (F.col("edge") + 1).alias("e")), "e").select("node", "edge").join(m, ["node", "edge"], "left_anti")
    part = F.pmod(F.col("node") + F.col("edge"), F.lit(50))
    cells = m.where(part != 0).unionByName(m.where(part == 7)).unionByName(strange)
    incidence = cells.select((F.col("node") + 1000).alias("row"), (F.col("edge") + 5).alias("col"))
    return V.incidence_differences(incidence, m, nodes, edges)


_DIAGNOSES = """
v AS (SELECT o_orderkey::VARCHAR AS visit_id, o_custkey AS patient_id, o_orderkey AS k, o_orderstatus AS s, o_orderpriority AS p, o_orderdate AS a, o_orderdate + INTERVAL 3 DAY AS d, CASE WHEN o_orderkey % 9 > 0 THEN o_orderdate END AS m FROM orders),
l AS (SELECT l_orderkey::VARCHAR AS visit_id, l_linenumber AS n, l_returnflag AS r, l_shipdate AS t, p_name, p_type, p_brand FROM lineitem JOIN part ON p_partkey = l_partkey),
f AS (SELECT visit_id, 'A' || (k % 7) AS code, '' AS text, m AS t, 0 AS place, 'primary_icd' AS kind, 'visits' AS sheet, 'main_code' AS field FROM v
  UNION ALL SELECT visit_id, unnest(['a' || (k % 7), 'B1', 'C' || (k % 3)]), '', a, 1, 'secondary_icd', 'visits', 'other_codes' FROM v
  UNION ALL SELECT visit_id, '', 'State ' || s, d, 2, 'discharge', 'visits', 'at_discharge' FROM v
  UNION ALL SELECT visit_id, '', lower(p), a, 3, 'preoperative', 'visits', 'before_operation' FROM v WHERE k % 4 = 0
  UNION ALL SELECT visit_id, '', upper(p), a, 4, 'postoperative', 'visits', 'after_operation' FROM v WHERE k % 4 = 0
  UNION ALL SELECT visit_id, '', 'State ' || lower(s), a, 5, 'primary_exam', 'visits', 'main_finding' FROM v
  UNION ALL SELECT visit_id, '', 'Chronic ' || p, a, 6, 'comorbidity', 'visits', 'other_findings' FROM v WHERE k % 5 > 0
  UNION ALL SELECT visit_id, '', 'Rule out ' || p, a, 7, 'differential', 'visits', 'to_rule_out' FROM v WHERE k % 3 = 0
  UNION ALL SELECT visit_id, '', p_name, t, 8, 'order_context', 'orders', 'ordered_for' FROM l
  UNION ALL SELECT visit_id, '', p_type, t, 9, 'medicine_context', 'medicines', 'given_for' FROM l
  UNION ALL SELECT visit_id, '', p_brand, t, 10, 'result_context', 'labs', 'tested_for' FROM l
  UNION ALL SELECT visit_id, '', upper(p_name), t, 11, 'preoperative', 'procedures', 'planned_for' FROM l WHERE n = 2
  UNION ALL SELECT visit_id, '', 'STATE F', t, 12, 'postoperative', 'procedures', 'found_at' FROM l WHERE n = 2 AND r = 'R'),
g AS (SELECT visit_id, lower(code) AS ck, lower(text) AS tk, * EXCLUDE (visit_id) FROM f),
o AS (SELECT visit_id, ck, tk, arg_min(code, (t IS NULL, coalesce(t, TIMESTAMP '1970-01-01'), place, code, text)) AS diagnosis_code, arg_min(text, (t IS NULL, coalesce(t, TIMESTAMP '1970-01-01'), place, code, text)) AS diagnosis_text, min(t) AS event_time, count(*) AS source_row_count FROM g GROUP BY ALL),
w AS (SELECT visit_id, ck, tk, place, kind, sheet, field, min((t IS NULL, coalesce(t, TIMESTAMP '1970-01-01'), place)) AS o FROM g GROUP BY ALL)
"""


@query(f"""
WITH {_DIAGNOSES}, {', '.join(f"{c}_ AS (SELECT visit_id, ck, tk, string_agg({c}, '; ' ORDER BY o) AS {c}s FROM (SELECT visit_id, ck, tk, {c}, min(o) AS o FROM w GROUP BY ALL) GROUP BY ALL)" for c in ('kind', 'sheet', 'field'))}
SELECT v.patient_id, visit_id, diagnosis_code, diagnosis_text, kinds AS diagnosis_type, event_time, sheets AS source_sheet, fields AS source_field, source_row_count FROM o JOIN v USING (visit_id) JOIN kind_ USING (visit_id, ck, tk) JOIN sheet_ USING (visit_id, ck, tk) JOIN field_ USING (visit_id, ck, tk)
""")
def diagnosis_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B2: thirteen source fields, two of codes, six of the visit's texts, three of what was ordered, given and tested, and two of operations."""
    k = F.col("k")
    v = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderkey").alias("visit_id"), F.col("o_custkey").alias("patient_id"), F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p"), F.col("o_orderdate").alias("a"))
    v = v.select("*", (F.col("a") + F.expr("INTERVAL 3 DAYS")).alias("d"), F.when(k % 9 > 0, F.col("a")).alias("m"), F.concat(F.lit(" A"), k % 7).alias("main_code"), F.concat(F.lit("a"), k % 7, F.lit("; B1|C"), k % 3, F.lit(",")).alias("other_codes"), F.concat(F.lit("State "), "s").alias("at_discharge"))
    v = v.select("*", F.when(k % 4 == 0, F.lower("p")).alias("before_operation"), F.when(k % 4 == 0, F.concat(F.lit("  "), F.upper("p"), F.lit(" "))).alias("after_operation"), F.concat(F.lit("State   "), F.lower("s")).alias("main_finding"))
    v = v.select("*", F.when(k % 5 == 0, "None").otherwise(F.concat(F.lit("Chronic "), "p")).alias("other_findings"), F.when(k % 3 == 0, F.concat(F.lit("Rule out "), "p")).alias("to_rule_out"))
    line = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_type", "p_brand"), "l_partkey").withColumnRenamed("l_orderkey", "visit_id")
    done = line.where("l_linenumber = 2").select("visit_id", "l_shipdate", F.upper("p_name").alias("planned_for"), F.when(F.col("l_returnflag") == "R", "STATE F").alias("found_at"))
    texts = [("discharge", "at_discharge", "d"), ("preoperative", "before_operation", "a"), ("postoperative", "after_operation", "a"), ("primary_exam", "main_finding", "a"), ("comorbidity", "other_findings", "a"), ("differential", "to_rule_out", "a")]
    fields = [D.Field("primary_icd", "visits", "main_code", v, "visit_id", "main_code", "m", True), D.Field("secondary_icd", "visits", "other_codes", v, "visit_id", "other_codes", "a", True), *(D.Field(kind, "visits", c, v, "visit_id", c, t) for kind, c, t in texts)]
    fields += [D.Field(kind, sheet, name, line, "visit_id", c, "l_shipdate") for kind, sheet, name, c in (("order_context", "orders", "ordered_for", "p_name"), ("medicine_context", "medicines", "given_for", "p_type"), ("result_context", "labs", "tested_for", "p_brand"))]
    fields += [D.Field("preoperative", "procedures", "planned_for", done, "visit_id", "planned_for", "l_shipdate"), D.Field("postoperative", "procedures", "found_at", done, "visit_id", "found_at", "l_shipdate")]
    return D.build(fields, v).drop("diagnosis_id")
