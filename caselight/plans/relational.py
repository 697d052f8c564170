"""Queries on joins, aggregations, windows, splits and sets over the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselight.functions import ids, parse
from caselight.operators import aggregates as A
from caselight.operators import events as E
from caselight.operators import graph as G
from caselight.operators import joins as J
from caselight.operators import quality as Q
from caselight.operators import windows as W
from caselight.plans import query
from caselight.session import dealt, table

_LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]


def _visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as visits: a stay of 0 to 6 days."""
    o = table(spark, sf_dir, "orders")
    days = F.expr("make_dt_interval(CAST(o_orderkey % 7 AS INT))")
    return o.select(F.col("o_orderkey").alias("visit_id"), F.col("o_custkey").alias("patient_id"), F.col("o_orderdate").alias("admission_time"), (F.col("o_orderdate") + days).alias("discharge_time"))


_VISITS = "v AS (SELECT o_orderkey AS visit_id, o_custkey AS patient_id, o_orderdate AS admission_time, o_orderdate + to_days(CAST(o_orderkey % 7 AS INTEGER)) AS discharge_time FROM orders)"


@query("""
SELECT o_orderkey, CASE WHEN s < 0.7 THEN 'train' WHEN s < 0.85 THEN 'validation' ELSE 'test' END AS split, round(s, 9) AS score
FROM (SELECT o_orderkey, ('0x' || substr(sha256('42:' || o_orderkey), 1, 12))::BIGINT / pow(16, 12) AS s FROM orders)
""")
def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """70/15/15 by a hash of the id."""
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", ids.hash_split(42, F.col("o_orderkey")).alias("split"), F.round(ids.split_score(42, F.col("o_orderkey")), 9).alias("score"))


@query("""
WITH k AS (SELECT DISTINCT o_custkey FROM orders), r AS (SELECT o_custkey, row_number() OVER (ORDER BY sha256('7:' || o_custkey), o_custkey) - 1 AS r, count(*) OVER () AS n FROM k)
SELECT o_custkey, CASE WHEN r < floor(n * 2 / 3) THEN 'train' WHEN r < floor(n * 2 / 3) + floor(n / 6) THEN 'test' ELSE 'validation' END AS split FROM r
""")
def patient_disjoint_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customers split by the order of a hash."""
    return W.disjoint_split(table(spark, sf_dir, "orders"), "o_custkey", 7)


@query("SELECT c_custkey FROM customer ORDER BY sha256('3:' || c_custkey), c_custkey LIMIT 50")
def hash_sample_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4: 50 ids in hash order."""
    return W.sample_by_hash(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", 3, 50)


@query("""
SELECT o.o_orderkey AS visit_id, count(*) AS n_events, count(*) FILTER (WHERE l_orderkey = o.o_orderkey) AS n_current, count(DISTINCT l_orderkey) AS n_visits, min(l_shipdate) AS first_time, max(l_shipdate) AS last_time
FROM orders o JOIN orders p ON p.o_custkey = o.o_custkey JOIN lineitem l ON l.l_orderkey = p.o_orderkey
WHERE l_shipdate <= o.o_orderdate + to_days(30) GROUP BY 1
""")
def cutoff_history_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each visit's history of events up to its cutoff."""
    events, goals = _line_history(spark, sf_dir)
    out = E.history_counts(events, goals)
    return out.select(F.col("target_visit_id").cast("long").alias("visit_id"), "n_events", "n_current", "n_visits", "first_time", "last_time")


def _line_history(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Lines as events, and orders as targets whose cutoff is 30 days after the order."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("patient_id"), (F.col("o_orderdate") + F.expr("make_dt_interval(30)")).alias("cutoff"))
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate", "l_returnflag", "l_quantity")
    e = line.join(o.select(F.col("o_orderkey").alias("l_orderkey"), "patient_id"), "l_orderkey")
    return e.select("patient_id", F.col("l_orderkey").alias("visit_id"), F.col("l_shipdate").alias("time"), "l_returnflag", "l_quantity"), o.select(F.col("o_orderkey").alias("visit_id"), "patient_id", "cutoff")


@query("""
SELECT o.o_orderkey AS visit_id, l_returnflag AS flag, count(*) AS n, sum(l_quantity) AS quantity
FROM orders o JOIN orders p ON p.o_custkey = o.o_custkey JOIN lineitem l ON l.l_orderkey = p.o_orderkey WHERE l_shipdate <= o.o_orderdate + to_days(30) GROUP BY ALL
""")
def cutoff_history_by_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of each target's patient up to its cutoff, joined by patient and time, summed by kind."""
    events, goals = _line_history(spark, sf_dir)
    rows = J.history(events.withColumnRenamed("visit_id", "event_visit_id"), goals, "patient_id", "time", "cutoff")
    return rows.groupBy("visit_id", F.col("l_returnflag").alias("flag")).agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


@query(f"""
WITH {_VISITS}, i AS (SELECT e.event_id, e.user_id % 1500 AS patient_id, e.ts FROM events e),
h AS (SELECT i.event_id, count(DISTINCT v.visit_id) AS n, min(v.visit_id) AS visit_id FROM i LEFT JOIN v ON v.patient_id = i.patient_id
      AND CAST(i.ts AS DATE) BETWEEN CAST(admission_time AS DATE) AND CAST(discharge_time AS DATE) GROUP BY 1)
SELECT event_id, CASE WHEN n = 1 THEN 'matched' WHEN n = 0 THEN 'no_visit_on_study_date' ELSE 'ambiguous' END AS status, CASE WHEN n = 1 THEN visit_id END AS visit_id FROM h
""")
def interval_link_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in exactly one visit's days."""
    e = table(spark, sf_dir, "events").select("event_id", F.pmod("user_id", F.lit(1500)).alias("patient_id"), "ts")
    return J.interval_link(e, _visits(spark, sf_dir), "event_id", "patient_id", "ts", "visit_id", "admission_time", "discharge_time")


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate,
  CASE WHEN l_shipdate < o_orderdate THEN 'before_admission' WHEN l_shipdate > o_orderdate + to_days(60) THEN 'after_discharge' ELSE 'within_visit' END AS status
FROM lineitem JOIN orders ON o_orderkey = l_orderkey
""")
def temporal_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H2, H3: lines before, within and after their visit."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    rows = table(spark, sf_dir, "lineitem").select(*_LINE).join(o, "l_orderkey")
    end = F.col("o_orderdate") + F.expr("make_dt_interval(60)")
    return rows.select(*_LINE, parse.temporal_status(F.col("l_shipdate"), F.col("o_orderdate"), end).alias("status"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey) - 1 AS INTEGER) AS ordinal FROM lineitem
""")
def event_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of each line within its order."""
    return W.ordinal(table(spark, sf_dir, "lineitem").select(*_LINE), ["l_orderkey"], ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey"])


@query("""
WITH n AS (SELECT event_id AS source, lead(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS target FROM events)
SELECT source, target, 'next' AS relation FROM n WHERE target IS NOT NULL UNION ALL SELECT target, source, 'prev' FROM n WHERE target IS NOT NULL
""")
def next_same_concept_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between consecutive events of one user and type."""
    return W.chain(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"], "event_id")


@query("""
SELECT o_custkey, o_orderkey, CAST(recency AS INTEGER) AS recency FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS recency FROM orders) WHERE recency <= 3
""")
def recent_three_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three newest orders of each customer."""
    return W.recent(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 3).select("o_custkey", "o_orderkey", "recency")


@query("""
WITH e AS (SELECT *, event_type = 'signup' AS keep, length(props) AS cost FROM events),
s AS (SELECT event_id, user_id, keep, sum(cost) OVER (PARTITION BY user_id, keep ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS used,
      coalesce(sum(cost) FILTER (WHERE keep) OVER (PARTITION BY user_id), 0) AS fixed FROM e)
SELECT event_id, user_id FROM s WHERE keep OR used <= 120 - fixed
""")
def suffix_within_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept events and the newest others that fit a budget."""
    e = table(spark, sf_dir, "events").withColumn("cost", F.length("props"))
    return W.suffix_within_budget(e, ["user_id"], ["ts", "event_id"], "cost", 120, F.col("event_type") == "signup").select("event_id", "user_id")


@query("""
WITH c AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL)
SELECT p_brand, p_type, n, round(sum(n) OVER (PARTITION BY p_brand ORDER BY n DESC, p_type ROWS UNBOUNDED PRECEDING) / sum(n) OVER (PARTITION BY p_brand), 9) AS share FROM c
""")
def cumulative_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running share of a brand's types."""
    c = table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"))
    return W.cumulative_share(c, ["p_brand"], "n", "p_type", "share").withColumn("share", F.round("share", 9))


@query("""
SELECT p_type, count(*) AS n_events, count(DISTINCT o_orderkey) AS n_visits, count(DISTINCT o_custkey) AS n_patients, min(p_name) AS example
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1
""")
def concept_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events, visits and patients of each concept."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    rows = rows.join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type", "p_name"), "l_partkey")
    rows = dealt(rows, "l_orderkey").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    return A.concept_inventory(rows, ["p_type"], "l_orderkey", "o_custkey", "p_name", "p_name")


@query("""
SELECT conv_id, string_agg(role, '; ' ORDER BY first_turn) AS roles FROM (SELECT conv_id, role, min(turn) AS first_turn FROM conversations WHERE role <> '' GROUP BY ALL) GROUP BY 1
""")
def ordered_distinct_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The roles of a conversation in order, each once."""
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(A.ordered_concat("role", "turn").alias("roles"))


@query("SELECT conv_id, string_agg('[' || role || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS note FROM conversations GROUP BY 1")
def note_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One note a conversation from its sections."""
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(A.note("role", "text", "turn").alias("note"))


@query("SELECT o_custkey, o_orderstatus, o_orderpriority, count(*) AS source_row_count FROM orders GROUP BY ALL")
def duplicate_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: equal rows once, with their number."""
    return A.collapse(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderstatus", "o_orderpriority"])


@query("""
SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS n_click, count(*) FILTER (WHERE event_type = 'view') AS n_view, count(*) FILTER (WHERE event_type = 'purchase') AS n_purchase FROM events GROUP BY 1
""")
def pivot_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of event types side by side."""
    return A.pivot_counts(table(spark, sf_dir, "events"), "user_id", "event_type", ["click", "view", "purchase"])


@query("""
WITH t AS (SELECT l_orderkey, p_brand, l_quantity FROM lineitem JOIN part ON p_partkey = l_partkey WHERE ('0x' || substr(sha256('42:' || l_orderkey), 1, 12))::BIGINT / pow(16, 12) < 0.7),
n AS (SELECT count(DISTINCT l_orderkey) AS n FROM t),
q AS (SELECT p_brand, count(DISTINCT l_orderkey) AS df, quantile_cont(l_quantity, 0.5) AS median, quantile_cont(l_quantity, 0.75) - quantile_cont(l_quantity, 0.25) AS iqr FROM t GROUP BY 1)
SELECT p_brand, df, round(ln((n + 1) / (df + 1)) + 1, 9) AS idf, median, CASE WHEN iqr <= 1e-8 THEN 1.0 ELSE iqr END AS iqr FROM q, n
""")
def robust_stats_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document frequency, IDF, median and spread on the training split."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity").where(ids.split_score(42, F.col("l_orderkey")) < 0.7)
    rows = rows.join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    return A.idf(rows, "l_orderkey", "p_brand").join(A.robust_stats(rows, "p_brand", "l_quantity"), "p_brand").select("p_brand", "df", F.round("idf", 9).alias("idf"), "median", "iqr")


@query("""
WITH b AS (SELECT DISTINCT event_type, floor(value / 10) * 10 AS bound FROM events WHERE event_id % 10 = 0), x AS (SELECT event_type, value FROM events WHERE event_id % 10 <> 0)
SELECT event_type, bound, round(quantile_cont(value - bound, 0.5), 6) AS tail FROM b JOIN x USING (event_type) WHERE value > bound GROUP BY ALL
""")
def group_tail_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The median excess over each censoring bound."""
    e = table(spark, sf_dir, "events").select("event_type", F.when(F.pmod("event_id", F.lit(10)) != 0, F.col("value")).alias("x"), F.when(F.pmod("event_id", F.lit(10)) == 0, (F.floor(F.col("value") / 10) * 10).cast("double")).alias("b"))
    return A.group_tail_median(e, ["event_type"], "x", "b").withColumn("tail", F.round("tail", 6))


@query("SELECT p_type, CAST(row_number() OVER (ORDER BY p_type) + 2 AS INTEGER) AS index FROM (SELECT DISTINCT p_type FROM part)")
def vocab_dense_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted tokens numbered after three reserved ids."""
    return A.vocabulary(table(spark, sf_dir, "part"), "p_type")


@query("""
SELECT p_brand, frequency, CAST(index AS INTEGER) AS index FROM (SELECT p_brand, frequency, row_number() OVER (ORDER BY frequency DESC, p_brand) - 1 AS index
  FROM (SELECT p_brand, count(DISTINCT l_orderkey) AS frequency FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1)) WHERE index < 10
""")
def top_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten brands in most orders."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    return A.ranked_vocabulary(rows, "l_orderkey", "p_brand", 10)


_COHORT = """
WITH b AS (SELECT p_brand FROM (SELECT p_brand, count(DISTINCT l_orderkey) AS f FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1) ORDER BY f DESC, p_brand LIMIT 8),
e AS (SELECT l_orderkey FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_brand IN (FROM b) INTERSECT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P'),
k AS (SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE o_orderkey IN (FROM e)),
c AS (SELECT * FROM k WHERE o_custkey IN (SELECT o_custkey FROM k GROUP BY 1 HAVING count(DISTINCT o_orderkey) >= 2))
"""


def _cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_returnflag")
    brands = line.join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("token")), "l_partkey").select("o_orderkey", "token")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
    domains = {"brand": brands, "flag": line.where("l_returnflag = 'R'").select("o_orderkey", F.col("l_returnflag").alias("token")), "status": orders.where("o_orderstatus <> 'P'").select("o_orderkey", F.col("o_orderstatus").alias("token"))}
    return G.select_cohort(domains, orders.drop("o_orderstatus"), "o_orderkey", "o_custkey", "token", {"brand": 8}, 2)


@query(_COHORT + "SELECT * FROM c")
def cohort_all_domains_min_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits with all domains of patients with at least two."""
    return _cohort(spark, sf_dir)


@query(_COHORT + """
SELECT o_orderkey, o_custkey, o_orderdate, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS INTEGER) AS visit_index,
  CAST(dense_rank() OVER (ORDER BY sha256('7:' || o_custkey), o_custkey) - 1 AS INTEGER) AS patient_index FROM c
""")
def cohort_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of visits and patients."""
    return G.with_indices(_cohort(spark, sf_dir), "o_custkey", "o_orderkey", "o_orderdate", 7)


@query("""
WITH x AS (SELECT DISTINCT l_orderkey, p_brand FROM lineitem JOIN part ON p_partkey = l_partkey),
p AS (SELECT a.p_brand AS a, b.p_brand AS b, count(*) AS n FROM x a JOIN x b USING (l_orderkey) WHERE a.p_brand < b.p_brand GROUP BY ALL)
SELECT a, b, n FROM p UNION ALL SELECT b, a, n FROM p
""")
def cooccurrence_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands that meet in an order, in both directions."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    return J.cooccurrence(rows, "l_orderkey", "p_brand", symmetric=True)


def _star(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("visit_id"))
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("visit_id"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"))
    return G.star_graph(v, {"part": line.select("visit_id", F.col("part").alias("node_id")), "supplier": line.select("visit_id", F.col("supp").alias("node_id"))})


_STAR = """
WITH n AS (SELECT o_orderkey AS graph_id, 'visit:' || o_orderkey AS node_id, 'visit' AS node_type FROM orders
  UNION ALL SELECT DISTINCT l_orderkey, 'part:' || l_partkey, 'part' FROM lineitem UNION ALL SELECT DISTINCT l_orderkey, 'supplier:' || l_suppkey, 'supplier' FROM lineitem)
"""


@query(_STAR + "SELECT * FROM n")
def star_graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1: a root a visit and its children."""
    return _star(spark, sf_dir)[0]


@query(_STAR + """
SELECT graph_id, 'visit:' || graph_id AS source, node_id AS target, 'has_' || node_type AS relation FROM n WHERE node_type <> 'visit'
UNION ALL SELECT graph_id, node_id, 'visit:' || graph_id, 'rev_has_' || node_type FROM n WHERE node_type <> 'visit'
""")
def star_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1: edges between roots and children, both ways."""
    return _star(spark, sf_dir)[1]


@query("""
SELECT DISTINCT a.l_partkey AS source, b.ps AS target, 'result_of' AS relation FROM lineitem a JOIN (SELECT l_orderkey, l_linenumber, l_suppkey AS ps FROM lineitem WHERE l_returnflag = 'R') b USING (l_orderkey, l_linenumber)
UNION ALL SELECT DISTINCT b.ps, a.l_partkey, 'rev_result_of' FROM lineitem a JOIN (SELECT l_orderkey, l_linenumber, l_suppkey AS ps FROM lineitem WHERE l_returnflag = 'R') b USING (l_orderkey, l_linenumber)
""")
def same_order_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between rows of one order and line."""
    line = table(spark, sf_dir, "lineitem")
    return G.link_edges(line, line.where("l_returnflag = 'R'"), ["l_orderkey", "l_linenumber"], "l_partkey", "l_suppkey", "result_of")


@query("""
WITH d AS (SELECT l_orderkey AS visit_id, l_returnflag AS token, date_diff('second', o_orderdate, l_shipdate) / 3600.0 AS hours, l_quantity, l_discount FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT visit_id, token, CAST(floor(hours / 24) AS INTEGER) AS bucket, count(*) AS n, round(quantile_cont(hours, 0.5), 6) AS hours, sum(l_quantity) AS quantity, round(quantile_cont(l_quantity, 0.5), 6) AS value, min(l_discount) AS lower, max(l_discount) AS upper FROM d GROUP BY 1, 2, 3
""")
def node_events_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a visit, token and day as one node."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    rows = table(spark, sf_dir, "lineitem").join(o, "l_orderkey").withColumn("hours", parse.hours_between(F.col("l_shipdate"), F.col("o_orderdate"))).withColumnRenamed("l_orderkey", "visit_id").withColumn("lo", F.col("l_discount"))
    out = G.node_events(rows, "visit_id", F.col("l_returnflag"), "hours", "l_quantity", "l_quantity", 24, "lo", "l_discount")
    return out.withColumn("hours", F.round("hours", 6)).withColumn("value", F.round("value", 6))


@query("""
WITH s AS (SELECT unnest([{'c': 'c_nationkey', 'v': c_nationkey::VARCHAR}, {'c': 'c_mktsegment', 'v': c_mktsegment}, {'c': 'c_custkey', 'v': c_custkey::VARCHAR}]) AS x FROM customer),
n AS (SELECT x.c AS c, x.v AS v, count(*) AS n FROM s GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY n DESC, v) AS r FROM n)
SELECT c AS "column", CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(n) FILTER (WHERE v IS NULL OR v = '') AS BIGINT) IS NOT NULL AS has_missing, count(*) AS n_distinct, string_agg(v, '|' ORDER BY r) FILTER (WHERE r <= 8) AS examples, count(*) > 50 AS high_cardinality FROM r GROUP BY 1
""")
def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile of three columns."""
    out = A.column_profile(table(spark, sf_dir, "customer"), ["c_nationkey", "c_mktsegment", "c_custkey"])
    return out.select("column", "n_rows", (F.col("n_missing") > 0).alias("has_missing"), "n_distinct", F.array_join("examples", "|").alias("examples"), "high_cardinality")


@query("""
SELECT 'c_nationkey' AS "column", c_nationkey::VARCHAR AS value, count(*) AS n FROM customer GROUP BY 2 UNION ALL SELECT 'c_mktsegment', c_mktsegment, count(*) FROM customer GROUP BY 2
""")
def value_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of columns with few of them."""
    return A.value_dictionary(table(spark, sf_dir, "customer"), ["c_nationkey", "c_mktsegment", "c_custkey"])


@query("SELECT o_orderpriority, quantile_cont(o_totalprice, 0.5) AS q50, quantile_cont(o_totalprice, 0.95) AS q95, quantile_disc(o_totalprice, 0.5) AS p50, quantile_disc(o_totalprice, 0.95) AS p95 FROM orders GROUP BY 1")
def quantile_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interpolated and nearest-rank percentiles."""
    return A.exact_quantiles(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice", {"q50": 0.5, "q95": 0.95}, {"p50": 0.5, "p95": 0.95})


@query("""
WITH n AS (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderstatus) AS r FROM n)
SELECT o_custkey, o_orderstatus AS status FROM r WHERE r = 1
""")
def mode_with_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's most frequent status, the smallest of equals."""
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(A.mode("o_orderstatus").alias("status"))


@query("SELECT o_custkey, arg_min(o_orderpriority, (o_orderdate, o_orderkey)) FILTER (WHERE o_orderpriority <> '1-URGENT') AS priority FROM orders GROUP BY 1")
def first_nonempty_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2, A3: the first known value in time order."""
    o = table(spark, sf_dir, "orders").withColumn("p", F.when(F.col("o_orderpriority") == "1-URGENT", "").otherwise(F.col("o_orderpriority")))
    return o.groupBy("o_custkey").agg(A.first_nonempty("p", "o_orderdate", "o_orderkey").alias("priority"))


@query("""
SELECT c_custkey, count(o_orderkey) AS orders_count, coalesce((SELECT 1 WHERE count(o_orderkey) > 0), 0) = 1 AS has_orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1
""")
def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of other tables counted for each key, 0 where there are none."""
    c = table(spark, sf_dir, "customer").select("c_custkey")
    return A.table_counts(c, {"orders": table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))}, "c_custkey")


@query("SELECT c_custkey, c_name, n_name, n_nationkey IS NOT NULL AS matched FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey")
def checked_many_to_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join whose right key must be unique, with an indicator."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return J.checked(table(spark, sf_dir, "customer"), n, ["c_nationkey"], "left", "matched").select("c_custkey", "c_name", "n_name", "matched")


@query("""
WITH e AS (SELECT l_partkey AS k, l_suppkey AS v FROM lineitem WHERE l_returnflag = 'R'), g AS (SELECT p_partkey AS k, list_sort(list_distinct(list(e.v) FILTER (WHERE e.v IS NOT NULL))) AS c FROM part LEFT JOIN e ON e.k = p_partkey GROUP BY 1)
SELECT k, CASE WHEN coalesce(len(c), 0) = 0 THEN 'no_evidence' WHEN len(c) > 1 THEN 'ambiguous' WHEN c[1] % 2 = 0 THEN 'linked' ELSE 'outside_cohort' END AS reason,
  CASE WHEN len(c) = 1 AND c[1] % 2 = 0 THEN c[1] END AS v, array_to_string(coalesce(c, []), ',') AS candidates FROM g
""")
def unique_evidence_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key linked only where all its evidence agrees and is in the cohort."""
    line = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("k"), F.col("l_suppkey").alias("v"))
    cohort = table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("v"))
    out = J.evidence_link(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")), line, cohort, "k", "v")
    return out.withColumn("candidates", F.array_join("candidates", ","))


@query("""
WITH a AS (SELECT lower(n_name) AS name, list_sort(list(n_nationkey)) AS v FROM nation WHERE n_regionkey < 3 GROUP BY 1), b AS (SELECT lower(n_name) AS name, list_sort(list(n_nationkey)) AS v FROM nation WHERE n_regionkey > 1 GROUP BY 1)
SELECT coalesce(a.name, b.name) AS name, coalesce(len(a.v), 0) AS n_left, coalesce(len(b.v), 0) AS n_right FROM a FULL JOIN b ON a.name = b.name
""")
def paired_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides' records under each name."""
    n = table(spark, sf_dir, "nation")
    out = J.pair_by_name(n.where("n_regionkey < 3"), n.where("n_regionkey > 1"), "n_name", "n_nationkey")
    return out.select("name", F.size("left_values").cast("long").alias("n_left"), F.size("right_values").cast("long").alias("n_right"))


@query("""
SELECT k, arg_min(n, (s, n)) AS label, string_agg(DISTINCT s, ',' ORDER BY s) AS sources FROM (SELECT c_nationkey AS k, c_mktsegment AS n, 'a' AS s FROM customer UNION SELECT s_nationkey, s_name, 'b' FROM supplier) GROUP BY 1
""")
def source_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys over two sources with the first label."""
    a = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_mktsegment").alias("label"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_name").alias("label"))
    return J.catalogue({"a": a, "b": b}, "k", "label").withColumn("sources", F.array_join("sources", ","))


@query("SELECT lpad(c_custkey::VARCHAR, 16, '0') AS uid, count(DISTINCT o_orderdate::DATE) AS n_dates, CASE WHEN count(DISTINCT o_orderdate::DATE) = 1 THEN min(o_orderdate::DATE) END AS linked_date FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def suffix_key_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers joined by their last characters, a date only where it is one."""
    uid = lambda c, p: F.concat(F.lit(p), F.lpad(F.col(c).cast("string"), 16, "0"))
    left = table(spark, sf_dir, "customer").select(F.lpad(F.col("c_custkey").cast("string"), 16, "0").alias("uid"))
    right = table(spark, sf_dir, "orders").select(uid("o_custkey", "1.2.").alias("ruid"), F.to_date("o_orderdate").alias("d"))
    return J.suffix_link(left, right, "uid", "ruid", "d").select("uid", "n_dates", "linked_date")


@query("""
SELECT 'dangling_orders' AS "check", count(*) AS n FROM (SELECT DISTINCT o_custkey FROM orders ANTI JOIN customer ON c_custkey = o_custkey)
UNION ALL SELECT 'repeated_lines', count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'repeated_orders', count(*) FROM (SELECT o_orderkey FROM orders GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'negative_price', count(*) FROM orders WHERE NOT o_totalprice >= 0
UNION ALL SELECT 'unknown_status', count(*) FROM orders WHERE o_orderstatus NOT IN ('P', 'O')
""")
def quality_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of keys, references and row rules."""
    o, line = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    tables = Q.constraint_report({"repeated_orders": Q.repeated_keys(o, ["o_orderkey"]), "repeated_lines": Q.repeated_keys(line, ["l_orderkey", "l_linenumber"]), "dangling_orders": Q.orphans(o, table(spark, sf_dir, "customer"), "o_custkey", "c_custkey")})
    return tables.unionByName(Q.violations(o, {"negative_price": F.col("o_totalprice") >= 0, "unknown_status": F.col("o_orderstatus").isin("P", "O")}))


@query("""
WITH a AS (SELECT o_orderstatus, o_orderpriority, o_custkey % 5 AS m FROM orders WHERE o_orderkey % 100 <> 1 UNION ALL SELECT 'X', 'twice', 1 UNION ALL SELECT 'X', 'twice', 1),
b AS (SELECT o_orderstatus, o_orderpriority, o_custkey % 5 AS m FROM orders WHERE o_orderkey % 100 <> 0 UNION ALL SELECT 'X', 'twice', 1)
SELECT 'left' AS side, * FROM (FROM a EXCEPT ALL FROM b) UNION ALL SELECT 'right', * FROM (FROM b EXCEPT ALL FROM a)
""")
def multiset_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that one of two tables has more often, of several columns and with both sides short of some."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", (F.col("o_custkey") % 5).alias("m"))
    more = lambda n: spark.range(n).select(F.lit("X").alias("o_orderstatus"), F.lit("twice").alias("o_orderpriority"), F.lit(1).cast("long").alias("m"))
    a, b = o.where("o_orderkey % 100 <> 1").drop("o_orderkey").unionByName(more(2)), o.where("o_orderkey % 100 <> 0").drop("o_orderkey").unionByName(more(1))
    return Q.same_rows(a, b)


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(ts) AS ts FROM events GROUP BY 1")
def latest_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest document of each key of a log."""
    e = table(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id").alias("at"), "event_type")
    return Q.latest(e, "user_id", "at").select("user_id", "event_type", F.col("at.ts").alias("ts"))


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 25 OFFSET 50")
def page_of_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page."""
    return W.page(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), ["c_custkey"], 50, 25)


@query("""
SELECT c_nationkey, c_custkey FROM (SELECT c_nationkey, c_custkey, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey))
WHERE i = 0 OR floor(i * 5 / n) <> floor((i - 1) * 5 / n)
""")
def evenly_spaced_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five customers of each nation at equal distances."""
    return W.evenly_spaced(table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey"), ["c_nationkey"], ["c_custkey"], 5)


@query("""
WITH d AS (SELECT doc_id, length(text) AS n FROM documents), m AS (SELECT quantile_cont(n, 0.5) AS m FROM d)
SELECT arg_min(doc_id, (n, doc_id)) AS shortest, arg_min(doc_id, (abs(n - m), doc_id)) AS middle, arg_min(doc_id, (-n, doc_id)) AS longest FROM d, m
""")
def shortest_middle_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three documents by length."""
    return W.shortest_middle_longest(table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n")), "n", "doc_id")


@query("SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def first_visit_per_patient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a patient, the first in order."""
    return W.first_of_group(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("SELECT o_custkey, string_agg(o_orderkey::VARCHAR, '>' ORDER BY o_orderdate, o_orderkey) AS visits FROM orders GROUP BY 1")
def nested_visit_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each patient's visits in order."""
    out = W.nested(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], F.col("o_orderkey").cast("string"))
    return out.select("o_custkey", F.array_join("nested", ">").alias("visits"))


@query("SELECT user_id, string_agg(event_type, ',' ORDER BY ts, event_id) AS tokens FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 5 GROUP BY 1")
def last_five_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last five tokens of each timeline."""
    out = W.last_values(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type", 5, "tokens")
    return out.select("user_id", F.array_join("tokens", ",").alias("tokens"))


@query("SELECT o_orderkey::VARCHAR AS visit_id, row_number() OVER (ORDER BY o_custkey, o_orderdate, o_orderkey) - 1 AS target_index FROM orders")
def target_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each target among all, by patient and admission."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("patient_id"), F.col("o_orderdate").alias("admission_time"), F.col("o_orderkey").alias("visit_id"))
    return E.target_order(o).select(F.col("visit_id").cast("string").alias("visit_id"), "target_index")


@query("SELECT l_orderkey AS row, l_suppkey AS col, 1 AS value FROM lineitem GROUP BY ALL")
def sparse_incidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A binary matrix in coordinates."""
    from caselight.sources.sinks import sparse

    return sparse(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey")
