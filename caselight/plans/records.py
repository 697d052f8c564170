"""Queries on table builders, graphs, checks, sources and sinks that read and write files of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselight.functions import ids, parse
from caselight.operators import evidence as X
from caselight.operators import events as E
from caselight.operators import graph as G
from caselight.operators import joins as J
from caselight.operators import quality as Q
from caselight.operators import tables as B
from caselight.operators import vectors
from caselight.plans import query
from caselight.session import dealt, table, work_folder
from caselight.sources import readers, sinks


@query("""
WITH v AS (SELECT o_orderkey, o_custkey, o_orderdate AS t, CASE WHEN o_orderkey % 4 > 0 THEN o_orderdate + to_days(2) END AS d FROM orders),
c AS (SELECT c_custkey, 1900 + c_custkey % 150 AS y, CASE c_custkey % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'F' ELSE 'unknown' END AS g FROM customer)
SELECT o_orderkey::VARCHAR AS visit_id, o_custkey::VARCHAR AS patient_id, t AS admission_time, d AS discharge_time, CAST(y AS INTEGER) AS birth_year, g AS gender_code, CAST(CASE WHEN year(t) - y BETWEEN 0 AND 120 THEN year(t) - y END AS INTEGER) AS age FROM v LEFT JOIN c ON c_custkey = o_custkey
""")
def build_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits with demographics and age; of a visit id that comes twice the first admission counts."""
    o = table(spark, sf_dir, "orders")
    stamp = lambda c: F.date_format(c, "yyyyMMddHHmm")
    left = F.when(F.col("o_orderkey") % 4 > 0, stamp(F.col("o_orderdate") + F.expr("make_dt_interval(2)"))).otherwise("null")
    rows = o.select(F.concat(F.col("o_orderkey").cast("string"), F.lit(".0")).alias("visit"), F.col("o_custkey").cast("string").alias("patient"), stamp("o_orderdate").alias("a"), left.alias("d"))
    again = rows.where(F.substring("visit", 1, 1) == "7").withColumn("a", F.lit("209901010000")).withColumn("d", F.lit(None).cast("string"))
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit(" "), F.col("c_custkey").cast("string")).alias("patient"), (F.col("c_custkey") % 150 + 1900).cast("string").alias("born"), F.element_at(F.array(F.lit("Nam"), F.lit(" NỮ"), F.lit("?")), (F.col("c_custkey") % 3 + 1).cast("int")).alias("sex"))
    return B.build_visits(rows.unionByName(again).unionByName(rows.limit(1).withColumn("visit", F.lit("none"))), c, "visit", "patient", "a", "d", "born", "sex")


@query("""
WITH c AS (SELECT l_orderkey, string_agg(DISTINCT l_returnflag, ';' ORDER BY l_returnflag) AS codes FROM lineitem GROUP BY 1), p AS (SELECT DISTINCT l_orderkey, l_linestatus FROM lineitem WHERE l_linenumber <= 2),
r AS (SELECT o_orderkey::VARCHAR AS order_id, o_orderstatus AS state, codes AS service_codes, l_linestatus AS performed FROM orders LEFT JOIN c ON c.l_orderkey = o_orderkey LEFT JOIN p ON p.l_orderkey = o_orderkey)
SELECT *, 'proc_' || substr(sha256('["' || order_id || '", "' || coalesce(performed, '') || '", "' || coalesce(service_codes, '') || '", "' || state || '"]'), 1, 24) AS procedure_id FROM r
""")
def build_procedures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their service codes and performed rows, by two left joins."""
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("order_id"), F.col("l_returnflag").alias("service_code"), F.col("l_linestatus").alias("performed"), "l_linenumber")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("order_id"), F.col("o_orderstatus").alias("state"))
    return B.build_procedures(o, line.select("order_id", "service_code"), line.where("l_linenumber <= 2").select("order_id", "performed"))


@query("SELECT p_partkey, lower(p_name) AS p_name_key, CASE lower(p_name) WHEN 'red widget' THEN 'widget' WHEN 'small ring' THEN 'ring' ELSE lower(p_name) END AS p_name_canonical FROM part")
def enriched_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with their keys and canonical forms."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit(" "), F.upper("p_name")).alias("p_name"))
    return B.enrich(p, "p_name", {"red widget": "widget", "small ring": "ring"}).drop("p_name")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as events of the orders' patients."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").cast("string").alias("patient_id"))
    line = table(spark, sf_dir, "lineitem").join(o, "l_orderkey").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    return line.select(F.lit("medicines").alias("source_table"), "patient_id", F.col("l_orderkey").cast("string").alias("visit_id"), F.col("l_shipdate").alias("time"), F.concat(F.lit("code:"), "p_brand").alias("code"), F.col("l_quantity").alias("numeric_value"), "l_linenumber", "l_partkey", "l_suppkey")


def _concept_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map of brands: of every three one approved with values, one approved without, one pending; written as CSV and read."""
    n = F.regexp_extract("p_brand", "[0-9]+", 0).cast("int")
    rows = table(spark, sf_dir, "part").select("p_brand").distinct().select(
        F.lit("medicines").alias("source_table"), F.concat(F.lit("code:"), "p_brand").alias("source_key"), F.concat(F.lit("T/"), n.cast("string")).alias("target_code"),
        F.when(n % 3 == 2, "Pending ").otherwise(" APPROVED").alias("status"), F.when(n % 3 == 0, "True").otherwise("no").alias("use_value"), F.when(n % 2 == 0, "0.5").alias("multiplier"), F.lit("1").alias("offset"),
    )
    path = f"{work_folder(spark)}/map"
    rows.write.option("header", True).csv(path)
    return readers.read_mapping(spark, path)


@query("""
WITH b AS (SELECT l.*, CAST(regexp_extract(p_brand, '[0-9]+') AS INTEGER) AS n FROM lineitem l JOIN part ON p_partkey = l_partkey)
SELECT l_orderkey::VARCHAR AS visit_id, 'T/' || n AS target_code, count(*) AS n, sum(CASE WHEN n % 3 = 0 THEN l_quantity * CASE WHEN n % 2 = 0 THEN 0.5 ELSE 1.0 END + 1 END) AS total FROM b WHERE n % 3 <> 2 GROUP BY ALL
""")
def mapped_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose concept has an approved target, with converted values."""
    out = E.mapped(_lines(spark, sf_dir), _concept_map(spark, sf_dir))
    return out.groupBy("visit_id", "target_code").agg(F.count(F.lit(1)).alias("n"), F.sum("numeric_value").alias("total"))


@query("""
WITH b AS (SELECT CAST(regexp_extract(p_brand, '[0-9]+') AS INTEGER) % 3 <> 2 AS ok FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT 'medicines' AS source_table, count(*) AS n_events, count(*) FILTER (WHERE ok) AS n_mapped, round(count(*) FILTER (WHERE ok) / count(*), 9) AS share FROM b
""")
def mapping_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many events the approved map covers."""
    return E.coverage(_lines(spark, sf_dir), _concept_map(spark, sf_dir)).withColumn("share", F.round("share", 9))


@query("""
WITH v AS (SELECT o_orderkey, o_orderdate AS a, CASE WHEN o_orderkey % 5 > 0 THEN o_orderdate + to_days(90) END AS d FROM orders),
e AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber % 3 > 0 THEN l_shipdate END AS t FROM lineitem)
SELECT l_orderkey::VARCHAR AS visit_id, l_linenumber, l_partkey, l_suppkey, coalesce(t, d, a) AS time, t IS NULL AS time_imputed, CASE WHEN t IS NOT NULL THEN 'event' WHEN d IS NOT NULL THEN 'discharge' ELSE 'admission' END AS time_source,
  CASE WHEN coalesce(t, d, a) < a THEN 'before_admission' WHEN coalesce(t, d, a) > d THEN 'after_discharge' ELSE 'within_visit' END AS temporal_status FROM e JOIN v ON o_orderkey = l_orderkey
""")
def placed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with imputed times and their place against their visit."""
    o = table(spark, sf_dir, "orders")
    v = o.select(F.col("o_orderkey").cast("string").alias("visit_id"), F.col("o_orderdate").alias("admission_time"), F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderdate") + F.expr("make_dt_interval(90)")).alias("discharge_time"))
    e = _lines(spark, sf_dir).withColumn("time", F.when(F.col("l_linenumber") % 3 > 0, F.col("time")))
    return E.place(e, v).select("visit_id", "l_linenumber", "l_partkey", "l_suppkey", "time", "time_imputed", "time_source", "temporal_status")


_TOKENS = """
WITH e AS (SELECT l_orderkey::VARCHAR AS target_visit_id, CAST(regexp_extract(p_brand, '[0-9]+') AS INTEGER) AS n, l_quantity >= 25 AS high FROM lineitem JOIN part ON p_partkey = l_partkey),
t AS (SELECT *, CASE WHEN n % 4 = 0 AND high THEN 'H' || n WHEN n % 4 <= 2 THEN 'C' || n END AS token, n % 4 IN (1, 2) OR (n % 4 = 0 AND NOT high) AS fallback FROM e)
"""


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.regexp_extract("code", "[0-9]+$", 0).cast("int")
    codes = _lines(spark, sf_dir).select("code").distinct().withColumn("n", n)
    exact = codes.where("n % 4 = 0").select("code", F.lit("high").alias("kind"), F.concat(F.lit("H"), "n").alias("token"))
    plain = codes.where("n % 4 <= 2").select("code", F.lit("").alias("kind"), F.concat(F.lit("C"), "n").alias("token"))
    lines = _lines(spark, sf_dir).withColumnRenamed("visit_id", "target_visit_id")
    return E.tokenise(lines, exact.unionByName(plain), F.when(F.col("numeric_value") >= 25, "high").otherwise("low"))


@query(_TOKENS + "SELECT coalesce(token, '-') AS token, fallback, count(*) AS n FROM t GROUP BY ALL")
def event_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H5: the token of an event's code and kind of value, else of the code, else none."""
    return _tokens(spark, sf_dir).groupBy(F.coalesce("token", F.lit("-")).alias("token"), "fallback").agg(F.count(F.lit(1)).alias("n"))


@query(_TOKENS + ", p AS (SELECT count(token) AS k, count(*) AS n FROM t GROUP BY target_visit_id) SELECT round(sum(k) / sum(n), 9) AS share, count(*) FILTER (WHERE k = 0) AS n_empty, sum(k) / sum(n) >= 0.7 AND count(*) FILTER (WHERE k = 0) = 0 AS passed FROM p")
def token_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether tokens cover enough events and every target."""
    return E.coverage_gate(_tokens(spark, sf_dir), 0.7).withColumn("share", F.round("share", 9))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_linenumber = 1 OR (l_orderkey % 3 > 0 AND l_linenumber >= l_orderkey % 5 + 1)")
def rebuilt_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H6: the rows of selected windows from the ordinal that each starts at; some have none and hold the first line only."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    first = F.when(F.col("l_orderkey") % 3 > 0, F.col("l_orderkey") % 5 + 1)
    return E.rebuild_window(line, F.col("l_linenumber") == 1, "l_linenumber", first)


def _graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("graph"), F.col("l_returnflag").alias("token"), "l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return G.indexed(line, "graph", ["token", "l_shipdate", "l_linenumber", "l_partkey", "l_suppkey"])


_NODES = "n AS (SELECT l_orderkey AS graph, l_returnflag AS token, l_quantity, l_partkey, l_linenumber, l_suppkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag, l_shipdate, l_linenumber, l_partkey, l_suppkey) AS INTEGER) AS i FROM lineitem)"


@query(f"WITH {_NODES}, c AS (SELECT graph, i AS source, lead(i) OVER (PARTITION BY graph, token ORDER BY i) AS target FROM n) SELECT graph, source, target, 'next' AS relation FROM c WHERE target IS NOT NULL UNION ALL SELECT graph, target, source, 'prev' FROM c WHERE target IS NOT NULL")
def graph_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes numbered in a graph, and edges between nodes of one token that follow one another."""
    return G.temporal_chains(_graph_nodes(spark, sf_dir), "graph", "token", ["index"])


@query(f"""
WITH {_NODES}, k AS (SELECT *, row_number() OVER (PARTITION BY graph ORDER BY i) AS j FROM n WHERE l_partkey % 4 > 0), c AS (SELECT graph, i AS a, lead(i) OVER (PARTITION BY graph, token ORDER BY i) AS b FROM n),
e AS (SELECT c.graph, x.j AS s, y.j AS t FROM c JOIN k x ON x.graph = c.graph AND x.i = a JOIN k y ON y.graph = c.graph AND y.i = b), g AS (SELECT graph, string_agg(p, ',' ORDER BY s, t) AS edges FROM (SELECT graph, s, t, s || '>' || t AS p FROM e UNION ALL SELECT graph, t, s, t || '>' || s FROM e) GROUP BY 1)
SELECT graph, n_nodes, features, coalesce(edges, '') AS edges FROM (SELECT graph, CAST(count(*) AS INTEGER) AS n_nodes, string_agg(l_quantity || '/' || (i::DOUBLE), ',' ORDER BY j) AS features FROM k GROUP BY 1) LEFT JOIN g USING (graph)
""")
def graph_tensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features and edges of each graph after nodes were removed and the rest numbered again."""
    nodes = _graph_nodes(spark, sf_dir).withColumn("place", F.col("index").cast("double"))
    edges = G.temporal_chains(nodes, "graph", "token", ["index"])
    out = G.tensors(nodes, edges, "graph", ["l_quantity", "place"], F.col("l_partkey") % 4 == 0)
    rows = F.array_join(F.transform("x", lambda r: F.array_join(F.transform(r, lambda v: v.cast("string")), "/")), ",")
    pairs = F.coalesce(F.array_join(F.transform("edges", lambda e: F.concat_ws(">", e["source"], e["target"])), ","), F.lit(""))
    return out.select("graph", F.size("x").alias("n_nodes"), rows.alias("features"), pairs.alias("edges"))


@query("""
WITH d AS (SELECT DISTINCT l_orderkey AS graph, l_returnflag AS kind, l_partkey AS node FROM lineitem),
r AS (SELECT *, count(*) OVER (PARTITION BY graph, kind) AS n, row_number() OVER (PARTITION BY graph, kind ORDER BY sha256('11:' || graph || ':' || node), node) AS r FROM d)
SELECT graph, kind, node FROM r WHERE n > 1 AND r <= greatest(1, least(n - 1, round_even(n * 0.4, 0)))
""")
def sampled_graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded share of each graph's nodes of a kind."""
    d = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("graph"), F.col("l_returnflag").alias("kind"), F.col("l_partkey").alias("node"))
    d = dealt(d, "graph").distinct()
    return G.sampled_nodes(d, "graph", "kind", "node", 0.4, 11).select("graph", "kind", "node")


@query("""
WITH t AS (SELECT c_custkey, c_nationkey::VARCHAR AS a, c_mktsegment AS b FROM customer), o AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'edited' WHEN 1 THEN '' END AS a, 'old' AS b FROM customer WHERE c_custkey % 5 > 0)
SELECT t.c_custkey, coalesce(nullif(o.a, ''), t.a) AS a, t.b FROM t LEFT JOIN o USING (c_custkey)
""")
def kept_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new template with the old table's edited values."""
    c = table(spark, sf_dir, "customer")
    new = c.select("c_custkey", F.col("c_nationkey").cast("string").alias("a"), F.col("c_mktsegment").alias("b"))
    old = c.where("c_custkey % 5 > 0").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, "edited").when(F.col("c_custkey") % 3 == 1, "").alias("a"), F.lit("old").alias("b"))
    return J.keep_old(new, old, ["c_custkey"], ["a"])


@query("""
WITH x AS (SELECT event_id, CASE WHEN event_id % 3 > 0 THEN value END AS v, CASE WHEN event_id % 4 > 0 THEN event_id % 50 * 10.0 - 100 END AS h, event_id % 6 AS k, CASE WHEN event_id % 5 = 0 THEN value - 10 END AS lo, CASE WHEN event_id % 7 = 0 THEN value + 10 END AS hi, event_id % 11 = 0 AS masked FROM events),
f AS (SELECT event_id, unnest([CASE WHEN masked OR v IS NULL THEN 0 ELSE greatest(-5, least(5, (v - 40) / 4.0)) END, ln(1 + event_id % 7), CASE WHEN h IS NULL THEN 0 ELSE greatest(-4, least(4, h / 168)) END, (v IS NOT NULL)::INT, (h IS NOT NULL)::INT, (v IS NULL)::INT, masked::INT,
  (k = 0)::INT, (k = 1)::INT, (k IN (2, 3))::INT, CASE WHEN lo IS NULL THEN 0 ELSE greatest(-5, least(5, (lo - 40) / 4.0)) END, CASE WHEN hi IS NULL THEN 0 ELSE greatest(-5, least(5, (hi - 40) / 4.0)) END, (lo IS NOT NULL)::INT, (hi IS NOT NULL)::INT, CASE k WHEN 2 THEN 0.75 WHEN 3 THEN 1 ELSE 0 END, (k IN (2, 3))::INT]::DOUBLE[]) AS x, unnest(range(16)) AS i FROM x)
SELECT event_id, i, round(x, 9) AS x FROM f
""")
def node_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 16 scaled features of nodes."""
    e = table(spark, sf_dir, "events")
    k, v, null = F.col("event_id"), F.col("value"), F.lit(None).cast("double")
    kinds = F.element_at(F.array(*map(F.lit, ("numeric_censored", "numeric_interval", "semi_quantitative", "unknown", "numeric_exact", "free_text"))), (k % 6 + 1).cast("int"))
    level = F.when(k % 6 == 2, 3.0).when(k % 6 == 3, 9.0)
    x = parse.node_features(F.when(k % 3 > 0, v), F.lit(40.0), F.lit(4.0), k % 7, F.when(k % 4 > 0, k % 50 * 10.0 - 100), kinds, F.when(k % 5 == 0, v - 10).otherwise(null), F.when(k % 7 == 0, v + 10), level, k % 11 == 0)
    return e.select("event_id", F.posexplode(x).alias("i", "x")).select("event_id", F.col("i").cast("long").alias("i"), F.round("x", 9).alias("x"))


@query("""
WITH h AS (SELECT c_nationkey, CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN ' N/A ' WHEN 2 THEN NULL ELSE '  ' || replace(lower(c_mktsegment), 'e', ' e ') END AS name, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS i FROM customer),
c AS (SELECT c_nationkey, i, trim(regexp_replace(coalesce(name, ''), '\\s+', ' ', 'g')) AS t FROM h), n AS (SELECT c_nationkey, i, CASE WHEN lower(t) IN ('', 'n/a') THEN 'unnamed_column_' || i ELSE t END AS t FROM c),
k AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey, t ORDER BY i) AS k FROM n)
SELECT c_nationkey, i - 1 AS place, CASE WHEN k = 1 THEN t ELSE t || '__' || k END AS header FROM k
""")
def repeated_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A header row a nation, numbered where empty or repeated."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey") % 5
    name = F.when(k == 0, "").when(k == 1, " N/A ").when(k == 2, F.lit(None)).otherwise(F.concat(F.lit("  "), F.replace(F.lower("c_mktsegment"), F.lit("e"), F.lit(" e "))))
    return B.header_rows(c.withColumn("name", name), ["c_nationkey"], "c_custkey", "name")


@query("""
WITH s AS (SELECT o_custkey, CASE WHEN o_orderkey % 97 = 0 THEN 'test' ELSE 'train' END AS split FROM orders), l AS (SELECT count(*) FILTER (WHERE l_shipdate > o_orderdate + to_days(60)) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT 'split_keys' AS "check", count(*) AS n FROM (SELECT o_custkey FROM s GROUP BY 1 HAVING count(DISTINCT split) > 1) UNION ALL SELECT 'late_events', n FROM l UNION ALL SELECT 'columns', 1
""")
def leakage_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q4: keys in several splits, events after their target's cutoff, forbidden columns."""
    o = table(spark, sf_dir, "orders")
    splits = o.select("o_custkey", F.when(F.col("o_orderkey") % 97 == 0, "test").otherwise("train").alias("split"))
    lines = table(spark, sf_dir, "lineitem").join(o.select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderdate") + F.expr("make_dt_interval(60)")).alias("cutoff")), "l_orderkey")
    columns = spark.createDataFrame([(c,) for c in Q.forbidden_columns(o, ["O_TOTALPRICE", "name"])], "c string")
    return Q.constraint_report({"split_keys": Q.leaking_keys(splits, "o_custkey", "split"), "late_events": Q.late_events(lines, "cutoff", "l_shipdate"), "columns": columns})


@query("""
WITH x AS (SELECT l_orderkey AS g, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 + CASE WHEN l_orderkey % 100 = 0 THEN 1 ELSE 0 END AS i FROM lineitem),
e AS (SELECT DISTINCT c_nationkey AS a, CAST(c_custkey % 25 AS INTEGER) AS b FROM customer)
SELECT 'contiguous' AS "check", count(*) AS n FROM (SELECT g FROM x GROUP BY 1 HAVING min(i) <> 0 OR max(i) <> count(DISTINCT i) - 1) UNION ALL SELECT 'symmetric', count(*) FROM e WHERE NOT EXISTS (SELECT 1 FROM e f WHERE f.a = e.b AND f.b = e.a)
""")
def artifact_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q5: groups whose index has gaps, edges without their reverse."""
    from pyspark.sql import Window

    line = dealt(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), "l_orderkey")
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")) - 1 + F.when(F.col("l_orderkey") % 100 == 0, 1).otherwise(0)
    edges = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("a"), (F.col("c_custkey") % 25).cast("int").alias("b"))
    return Q.constraint_report({"contiguous": Q.contiguous(line.select("l_orderkey", place.alias("i")), ["l_orderkey"], "i"), "symmetric": Q.asymmetric(edges, "a", "b")})


def _reviews(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("review_id"))
    every = o.withColumn("candidate_id", F.explode(F.sequence(F.lit(1), F.when(F.col("review_id") % 10 == 1, 19).otherwise(20))))
    picked = every.where((F.col("candidate_id") <= F.col("review_id") % 4) & (F.col("candidate_id") <= 20))
    strange = o.where("review_id % 10 = 2").withColumn("candidate_id", F.lit(99))
    return o.withColumn("none_similar", F.col("review_id") % 8 == 0), picked.unionByName(strange), every


@query("""
WITH r AS (SELECT o_orderkey AS k, o_orderkey % 8 = 0 AS none, CASE WHEN o_orderkey % 10 = 1 THEN 19 ELSE 20 END AS c, o_orderkey % 4 + CASE WHEN o_orderkey % 10 = 2 THEN 1 ELSE 0 END AS s FROM orders)
SELECT k AS review_id, 'candidates' AS reason FROM r WHERE c <> 20 UNION ALL SELECT k, 'selections' FROM r WHERE NOT none AND s = 0 UNION ALL SELECT k, 'not_a_candidate' FROM r WHERE k % 10 = 2 UNION ALL SELECT k, 'none_with_selections' FROM r WHERE none AND s > 0
""")
def review_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q9: reviews that break the rules on candidates and selections."""
    return Q.review_violations(*_reviews(spark, sf_dir))


@query("""
WITH l AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1)
SELECT c_custkey AS user_id, c_name, event_type, value FROM customer LEFT JOIN l ON user_id = c_custkey
""")
def exported_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ranking with the newest review of each row."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_name")
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "value", F.struct("ts", "event_id").alias("at"))
    return Q.export_join(c, e, ["user_id"], "at").drop("at")


@query()
def estimated_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q11: rows and estimated bytes of an export, from a seeded sample."""
    return Q.estimated_bytes(table(spark, sf_dir, "orders"), 0.2)


@query("""
SELECT 'customers' AS sheet, row_number() OVER (ORDER BY c_custkey) + 1 AS source_row, c_name AS name, c_acctbal::VARCHAR AS balance FROM customer
""")
def sheets_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet written as CSV and read again, with its rows' numbers; empty rows and columns leave."""
    c = table(spark, sf_dir, "customer").orderBy("c_custkey").select(F.col("c_name").alias("name"), F.abs("c_acctbal").alias("_b"), F.col("c_acctbal").cast("string").alias("balance"), F.lit(None).cast("string").alias("nothing")).drop("_b")
    folder = work_folder(spark)
    c.coalesce(1).write.option("header", True).csv(f"{folder}/customers.csv")
    sheet = readers.read_sheets(spark, folder, ["customers"])["customers"]
    out = readers.drop_empty_columns(readers.non_empty_rows(sheet))
    return out.select(F.lit("customers").alias("sheet"), "source_row", "name", "balance")


@query("SELECT o_orderkey, o_totalprice, CAST(NULL AS VARCHAR) AS absent FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'O'")
def filtered_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written once, read by a declared schema, filtered by equalities that reach the scan."""
    path = f"{work_folder(spark)}/orders"
    sinks.write_table(table(spark, sf_dir, "orders"), path)
    df = readers.read_table(spark, path, "o_orderkey bigint, o_totalprice double, o_orderpriority string, o_orderstatus string, absent string", ("o_orderkey",))
    return readers.lookup(df, {"o_orderpriority": "1-URGENT", "o_orderstatus": "O"}, ["o_orderkey", "o_totalprice", "absent"], 1 << 30)


@query("SELECT conv_id, turn, role, text FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations WHERE role = 'system')")
def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as JSON lines, read with a schema, and those whose key is in a set."""
    c = table(spark, sf_dir, "conversations")
    path = f"{work_folder(spark)}/turns"
    sinks.write_jsonl(c, path)
    return readers.selective(readers.read_jsonl(spark, path, c.schema), "conv_id", c.where("role = 'system'"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding[1:3], lambda x: x::DOUBLE)), 5) AS s, layout FROM embeddings, (SELECT unnest(['json', 'list', 'wide']) AS layout)")
def embedding_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors from arrays, JSON texts and columns."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", 1, 3).alias("embedding"))
    layouts = {"list": e, "json": e.withColumn("embedding", F.to_json("embedding")), "wide": e.select("vec_id", *(F.col("embedding")[i].alias(f"embedding_{i:04d}") for i in range(3)))}
    parts = [readers.embeddings(df, "vec_id").withColumn("layout", F.lit(n)) for n, df in layouts.items()]
    return readers.union_projected(parts).select("vec_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x), 5).alias("s"), "layout")


@query("SELECT c_custkey::VARCHAR AS query_id, CAST(r AS INTEGER) AS rank, 'n \"' || c_name || '\", ' || r AS candidate_id, r / 8.0 AS score FROM customer, (SELECT unnest([1, 2, 3]) AS r)")
def ranked_list_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked lists from CSV with quoted cells."""
    c = table(spark, sf_dir, "customer").withColumn("r", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    rows = c.select(F.col("c_custkey").cast("string").alias("query_patient_id"), F.col("r").alias("rank"), F.concat(F.lit('n "'), "c_name", F.lit('", '), F.col("r").cast("string")).alias("related_patient_id"), (F.col("r") / 8).alias("cosine_similarity"))
    path = f"{work_folder(spark)}/topk"
    rows.write.option("header", True).option("escape", '"').csv(path)
    return readers.read_topk(spark, path)


@query("SELECT 'c' || c_nationkey AS patient, c_mktsegment AS visit, c_custkey AS id, c_acctbal AS balance FROM customer")
def folder_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON documents in nested folders named after patient and visit."""
    c = table(spark, sf_dir, "customer")
    rows = c.select(F.concat(F.lit("c"), F.col("c_nationkey").cast("string")).alias("patient"), F.col("c_mktsegment").alias("visit"), F.struct(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance")).alias("d"))
    listed = rows.groupBy("patient", "visit").agg(F.to_json(F.collect_list("d")).alias("value")).collect()  # a row a folder
    root = work_folder(spark)
    for r in listed:
        sinks.write_text(spark, f"{root}/{r.patient}/{r.visit}/doc.json", r.value)
    return readers.read_tree(spark, root, "id bigint, balance double", ("patient", "visit")).select("patient", "visit", "id", "balance")


@query("""
SELECT c_nationkey, strlen(t)::BIGINT AS bytes, sha256(t) AS sha256, c_nationkey % 2 = 0 AS listed FROM (SELECT c_nationkey, string_agg(c_name || chr(10), '' ORDER BY c_name) AS t FROM customer GROUP BY 1)
""")
def file_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and digests of a file a nation, and which of them have a wanted suffix."""
    root = work_folder(spark)
    c = table(spark, sf_dir, "customer").select("c_name", "c_nationkey", (F.col("c_nationkey") % 2 == 0).alias("even"))
    for even, suffix in ((True, "json"), (False, "txt")):  # a file a nation: one task sorts its customers
        part = c.where(F.col("even") == even).drop("even").repartition("c_nationkey").sortWithinPartitions("c_nationkey", "c_name")
        part.write.partitionBy("c_nationkey").mode("append").option("header", False).text(f"{root}/{suffix}")
    nation = F.regexp_extract("path", "c_nationkey=([0-9]+)", 1).cast("int").alias("c_nationkey")
    found = readers.discover(spark, f"{root}/json", (".txt",)).select(nation, F.lit(True).alias("listed"))
    rows = Q.file_inventory(spark, root).where("path NOT LIKE '%_SUCCESS'").select(nation, "bytes", "sha256")
    return rows.join(found, "c_nationkey", "left").select("c_nationkey", "bytes", "sha256", F.coalesce("listed", F.lit(False)).alias("listed"))


@query("SELECT c_custkey, c_custkey % 2 = 0 AS first FROM customer")
def resumed_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written in two runs, of which the second only adds what the first lacks."""
    c = table(spark, sf_dir, "customer").select("c_custkey")
    path = f"{work_folder(spark)}/shards"
    sinks.write_missing(c.where("c_custkey % 2 = 0").withColumn("first", F.lit(True)), path, "c_custkey", spark)
    sinks.write_missing(c.withColumn("first", F.lit(False)), path, "c_custkey", spark)
    return spark.read.parquet(path)


@query("""SELECT 'nations' AS sheet, CAST(n_nationkey + 2 AS BIGINT) AS source_row, '["{\\"type\\":\\"bigint\\",\\"value\\":\\"' || n_nationkey || '\\"}","{\\"type\\":\\"string\\",\\"value\\":\\"' || n_name || '\\"}"]' AS cells FROM nation""".replace('\\"', '#').replace('#', '\\"').replace('["{', '[{').replace('}","{', '},{').replace('}"]', '}]').replace('\\"', '"'))
def cell_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cell of a sheet with its type."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("n_nationkey"), "n_name", (F.col("n_nationkey") + 2).cast("bigint").alias("source_row"))
    out = sinks.snapshot({"nations": n}, spark)
    return out.select("sheet", "source_row", F.concat(F.lit("["), F.array_join("payload", ","), F.lit("]")).alias("cells"))


@query("""
SELECT l_orderkey AS visit_id, p_brand AS name, CASE WHEN l_returnflag = 'R' THEN 'returned' ELSE 'prescribed' END AS status, count(*) AS source_row_count FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_linestatus = 'O' OR l_returnflag <> 'R' GROUP BY ALL
""")
def returned_medicines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medicines with a return reason are marked, and where asked for left out."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("name"))
    rows = table(spark, sf_dir, "lineitem").join(p, "l_partkey").select(F.col("l_orderkey").alias("visit_id"), "name", F.when(F.col("l_returnflag") == "R", "reaction").otherwise(" ").alias("why"), "l_linestatus")
    v = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("visit_id"))
    build = lambda state, kept: B.build_medicines(rows.where(F.col("l_linestatus") == state), v, ["name"], return_reason="why", include_returned=kept)
    both = build("O", True).unionByName(build("F", False)).drop("medicine_id")
    return both.groupBy("visit_id", "name", "status").agg(F.sum("source_row_count").alias("source_row_count"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 1 THEN o_orderpriority ELSE ' x' END AS code FROM orders WHERE o_orderkey % 3 > 0 AND o_orderkey % 7 > 0")
def code_only_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diagnoses without a controlled code never become nodes."""
    o = table(spark, sf_dir, "orders")
    code = F.when(F.col("o_orderkey") % 3 == 0, "null").when(F.col("o_orderkey") % 3 == 1, F.col("o_orderpriority")).otherwise(" x")
    rows = o.select("o_orderkey", F.when(F.col("o_orderkey") % 7 > 0, F.col("o_orderkey").cast("string")).otherwise(" ").alias("visit_id"), code.alias("code"), F.lit("a name").alias("name"))
    return B.code_only(rows).select("o_orderkey", "code")


_IMAGES = "i AS (SELECT vec_id, vec_id % 120 AS visit_id, CASE vec_id % 3 WHEN 0 THEN 'CT' WHEN 1 THEN 'MRI' ELSE 'XQ' END AS m, 'p' || lpad(vec_id::VARCHAR, 6, '0') AS path, '2024010' || (vec_id % 9) AS d FROM embeddings)"


@query(f"""
WITH {_IMAGES} SELECT o_orderkey AS visit_id, o_orderstatus, count(*) AS n_images, string_agg(DISTINCT m, ',' ORDER BY m) AS modalities, string_agg(path, ',' ORDER BY path) AS paths, string_agg('64', ',') AS dims, string_agg(d, ',' ORDER BY path) AS study_dates,
  coalesce(string_agg(path, ',' ORDER BY path) FILTER (WHERE m = 'CT'), '') AS ct_paths, count(*) FILTER (WHERE m = 'MRI') AS mri_count FROM orders JOIN i ON visit_id = o_orderkey GROUP BY ALL
""")
def visits_with_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits joined to their image aggregates, with lists by modality."""
    k = F.col("vec_id")
    e = table(spark, sf_dir, "embeddings").select((k % 120).alias("visit_id"), F.element_at(F.array(F.lit("CT"), F.lit("MRI"), F.lit("XQ")), (k % 3 + 1).cast("int")).alias("modality"), F.concat(F.lit("p"), F.lpad(k.cast("string"), 6, "0")).alias("path"), F.size("embedding").alias("dim"), F.concat(F.lit("2024010"), (k % 9).cast("string")).alias("study_date"))
    out = J.with_images(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("visit_id"), "o_orderstatus"), e, "visit_id", ["CT", "MRI", "XQ"])
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return out.select("visit_id", "o_orderstatus", "n_images", joined("modalities"), joined("paths"), joined("dims"), joined("study_dates"), joined("ct_paths"), "mri_count")


@query("SELECT c_custkey AS profile_id, 'raw-' || c_custkey AS raw_id FROM customer")
def one_to_one_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An identity table that must name every profile and every raw id once."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("profile_id"), F.concat(F.lit("raw-"), F.col("c_custkey").cast("string")).alias("raw_id"))
    return J.one_to_one(c, c.select("raw_id"), "profile_id", "raw_id", c.repartition(3))


@query("""
SELECT o_custkey::VARCHAR AS patient_id, o_orderkey::VARCHAR AS visit_id, '{"state":"' || o_orderstatus || '"}' AS fields, coalesce(m, '[]') AS medicines, coalesce(p, '[]') AS procedures FROM orders
LEFT JOIN (SELECT l_orderkey, '[' || string_agg('{"l_partkey":' || l_partkey || '}', ',' ORDER BY l_linenumber, l_partkey, l_suppkey) || ']' AS m FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
LEFT JOIN (SELECT l_orderkey AS k, '[' || string_agg('{"l_linenumber":' || l_linenumber || ',"stock":[{"s_nationkey":' || s_nationkey || '}]}', ',' ORDER BY l_linenumber, l_partkey, l_suppkey) || ']' AS p FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_linenumber <= 2 GROUP BY 1) ON k = o_orderkey
""")
def visit_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of each visit with lists beside them, without private columns."""
    key = lambda c: F.col(c).cast("string")
    v = table(spark, sf_dir, "orders").select(key("o_custkey").alias("patient_id"), key("o_orderkey").alias("visit_id"), F.col("o_orderstatus").alias("state"), F.lit("secret").alias("address"))
    line = table(spark, sf_dir, "lineitem").withColumn("visit_id", key("l_orderkey")).join(v.select("visit_id", "patient_id"), "visit_id").withColumn("address", F.lit("secret"))
    stock = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey", F.lit("secret").alias("address"))
    order = ["l_linenumber", "l_partkey", "l_suppkey"]
    out = B.packets(v, {"medicines": (line, ["l_partkey", "address"], order), "procedures": (line.where("l_linenumber <= 2"), ["l_linenumber"], order)}, {"stock": (stock, "l_suppkey")}, ("address",))
    return out.select("patient_id", "visit_id", *(F.to_json(c).alias(c) for c in ("fields", "medicines", "procedures")))


@query("""
WITH l AS (SELECT user_id % 40 AS c, string_agg(event_type || '=' || value || CASE WHEN value < 20 OR value > 60 THEN '!' ELSE '' END, ';' ORDER BY ts, event_type, value) AS labs FROM events GROUP BY 1)
SELECT c_custkey AS visit_id, 'Segment=' || c_mktsegment || ';c_acctbal=' || c_acctbal || CASE WHEN c_custkey % 2 = 0 THEN ';c_mktsegment (canonical)=other' ELSE '' END AS details, coalesce(labs, '') AS labs FROM customer LEFT JOIN l ON c = c_custkey
""")
def display_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Details and labs of each record for display."""
    c = table(spark, sf_dir, "customer").select(F.lit("p").alias("patient_id"), F.col("c_custkey").alias("visit_id"), "c_mktsegment", "c_acctbal", F.lit("").alias("empty"))
    canon = c.select("patient_id", "visit_id", F.when(F.col("visit_id") % 2 == 0, "other").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"))
    labs = table(spark, sf_dir, "events").select(F.lit("p").alias("patient_id"), (F.col("user_id") % 40).alias("visit_id"), F.col("event_type").alias("name"), "value", F.lit("").alias("unit"), F.lit("20 - 60").alias("range"), F.col("ts").alias("time"))
    out = B.read_model(c, [("c_mktsegment", "Segment"), ("empty", "Nothing")], labs, canon)
    details = F.array_join(F.transform("details", lambda d: F.concat_ws("=", d["label"], d["value"])), ";")
    listed = F.array_join(F.transform("labs", lambda r: F.concat(r["name"], F.lit("="), r["value"], F.when(r["flagged"], "!").otherwise(""))), ";")
    return out.select("visit_id", details.alias("details"), listed.alias("labs"))


@query()
def marked_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases that a speaker's turns share, chosen apart, and the turn as marked text."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    c = c.select("*", X.icd_spans(F.col("text")).alias("icd"), X.phrase_spans(F.col("text"), chars=8, negators=X.NEGATORS).alias("phrases"))
    o = c.select("conv_id", (F.col("turn") - 2).alias("turn"), "role", F.col("icd").alias("icd2"), F.col("phrases").alias("phrases2"))
    spans = X.apart(F.concat(X.shared_spans(F.col("icd"), F.col("icd2"), 0), X.shared_spans(F.col("phrases"), F.col("phrases2"), 1)))
    return c.join(o, ["conv_id", "turn", "role"]).withColumn("spans", spans).where(F.size("spans") > 0).select("conv_id", "turn", F.size("spans").alias("n"), X.marked(F.col("text"), F.col("spans")).alias("html"))


@query("""
WITH f AS (SELECT o_custkey, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey::VARCHAR) AS r FROM orders)
SELECT 'demographics' AS source_table, o_custkey::VARCHAR AS patient_id, '' AS visit_id, make_date(CAST(1900 + o_orderkey % 99 AS INTEGER), 1, 1)::TIMESTAMP AS time, 'GENDER/' || CASE WHEN o_orderkey % 2 = 0 THEN 'F' ELSE 'M' END AS code, 0 AS priority FROM f WHERE r = 1
""")
def demographic_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One gender event a patient, at birth, from its first visit."""
    o = table(spark, sf_dir, "orders")
    v = o.select(F.col("o_custkey").alias("patient_id"), F.col("o_orderkey").cast("string").alias("visit_id"), F.col("o_orderdate").alias("admission_time"), F.when(F.col("o_orderkey") % 2 == 0, "F").otherwise("M").alias("gender_code"), (F.col("o_orderkey") % 99 + 1900).cast("int").alias("birth_year"))
    return E.demographic_events(v).select("source_table", "patient_id", "visit_id", "time", "code", "priority")


@query("""
WITH n AS (SELECT 'main' AS source, l_orderkey AS visit, 'flag' AS section, l_returnflag AS text FROM lineitem UNION ALL SELECT 'main', l_orderkey, 'status', l_linestatus FROM lineitem
  UNION ALL SELECT 'orders', o_orderkey, 'priority', o_orderpriority FROM orders UNION ALL SELECT 'reports', o_orderkey, 'report', 'state ' || o_orderstatus FROM orders WHERE o_orderkey % 3 > 0)
SELECT source, visit, section, text, count(*) AS source_row_count FROM n GROUP BY ALL
""")
def build_all_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Note fields of several tables; placeholders and empty texts leave."""
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("visit"), F.col("l_returnflag").alias("flag"), F.concat(F.lit("  "), "l_linestatus").alias("status"), F.lit("RichEditControl1").alias("empty"))
    o = table(spark, sf_dir, "orders")
    reports = o.select(F.col("o_orderkey").alias("visit"), F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.lit("state \n "), "o_orderstatus")).otherwise("null").alias("report"))
    sources = [("main", line, ["flag", "status", "empty"]), ("orders", o.select(F.col("o_orderkey").alias("visit"), F.col("o_orderpriority").alias("priority")), ["priority"]), ("reports", reports, ["report"])]
    return B.build_all_notes(sources, "visit").drop("note_id")


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = table(spark, sf_dir, "events").where("user_id IS NOT NULL").select("user_id").distinct()
    return u.select(F.col("user_id").alias("left"), (F.col("user_id") + 1).alias("right")).join(u.select(F.col("user_id").alias("right")), "right", "left_semi")


@query("""
WITH u AS (SELECT user_id, list_sort(list_distinct(list(event_type))) AS m FROM events WHERE value > 60 GROUP BY 1)
SELECT a.user_id AS "left", b.user_id AS "right", array_to_string(list_sort(list_intersect(a.m, b.m)), ',') AS modalities FROM u a JOIN u b ON b.user_id = a.user_id + 1 WHERE len(list_intersect(a.m, b.m)) > 0
""")
def shared_modalities_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kinds of study that two patients have in common."""
    out = X.shared_modalities(_neighbours(spark, sf_dir), table(spark, sf_dir, "events").where("value > 60"), "user_id", "event_type")
    return out.select("left", "right", F.array_join("modalities", ",").alias("modalities"))


@query("""
WITH u AS (SELECT user_id, list_distinct(list(event_type)) AS m FROM events WHERE value > 60 GROUP BY 1), p AS (SELECT a.user_id AS l, b.user_id AS r, len(list_intersect(a.m, b.m)) AS s, len(a.m) AS x, len(b.m) AS y FROM u a JOIN u b ON b.user_id = a.user_id + 1)
SELECT l AS "left", r AS "right", CAST(s AS INTEGER) AS shared, round(s / least(x, y), 9) AS coverage, round(s / (x + y - s), 9) AS jaccard FROM p WHERE s >= 2 AND s / least(x, y) >= 0.6
""")
def gated_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs whose tests overlap enough to be compared."""
    out = vectors.gated_neighbours(_neighbours(spark, sf_dir), table(spark, sf_dir, "events").where("value > 60"), "user_id", "event_type", 2, 0.6)
    return out.select("left", "right", "shared", F.round("coverage", 9).alias("coverage"), F.round("jaccard", 9).alias("jaccard"))


@query("SELECT label, CAST(len(embedding[1:CASE WHEN vec_id % 3 = 0 THEN 8 ELSE 64 END]) AS INTEGER) AS length, count(*) AS n FROM embeddings GROUP BY ALL")
def shape_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many vectors there are of each length, by label."""
    e = table(spark, sf_dir, "embeddings")
    return vectors.shape_counts(e.withColumn("embedding", F.when(F.col("vec_id") % 3 == 0, F.slice("embedding", 1, 8)).otherwise(F.col("embedding"))), "embedding", "label")


@query("""
WITH e AS (SELECT l_orderkey AS g, l_returnflag AS t, floor((l_linenumber * 10) / 24.0) AS b, l_quantity AS v FROM lineitem), n AS (SELECT g, t, b, quantile_cont(v, 0.5) AS v FROM e GROUP BY ALL), s AS (SELECT * FROM n WHERE g % 10 < 7)
SELECT 'nodes' AS part, count(*) AS n, round(sum(v), 6) AS total FROM n UNION ALL SELECT 'chains', 2 * (SELECT count(*) - count(DISTINCT (g, t)) FROM n), NULL UNION ALL SELECT 'vocabulary', count(DISTINCT t), NULL FROM s
UNION ALL SELECT 'idf', count(*), round(sum(ln((k + 1) / (d + 1)) + 1), 6) FROM (SELECT t, count(DISTINCT g) AS d FROM s GROUP BY 1), (SELECT count(DISTINCT g) AS k FROM s)
UNION ALL SELECT 'statistics', count(*), round(sum(m), 6) FROM (SELECT quantile_cont(v, 0.5) AS m FROM s GROUP BY t) UNION ALL SELECT 'splits', count(DISTINCT g), NULL FROM e
""")
def structured_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts of a structured dataset; their sizes and sums."""
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("graph"), F.col("l_returnflag").alias("kind"), (F.col("l_linenumber") * 10.0).alias("at"), "l_quantity")
    parts = G.structured_dataset(line, "graph", "kind", "at", "l_quantity", F.when(F.col("graph") % 10 < 7, "train").otherwise("test"))
    sums = {"nodes": "value", "idf": "idf", "statistics": "median"}
    rows = [df.agg(F.count(F.lit(1)).alias("n"), (F.round(F.sum(sums[name]), 6) if name in sums else F.lit(None).cast("double")).alias("total")).select(F.lit(name).alias("part"), "n", "total") for name, df in parts.items()]
    return readers.union_projected(rows)


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'second' ELSE 'first' END AS state, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS balance FROM customer")
def appended_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents appended to a log in two turns, and the newest of each key."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit("first").alias("state"), F.col("c_acctbal").alias("balance"))
    path = f"{work_folder(spark)}/log"
    sinks.append_log(c, path)
    sinks.append_log(c.where("id % 3 = 0").withColumn("state", F.lit("second")).withColumn("balance", F.col("balance") + 1), path)
    return Q.latest(spark.read.parquet(path), "id", "at").drop("at")


@query("SELECT c_custkey, c_name, 'x' AS again FROM customer")
def sized_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table in shards of a given size; a damaged and a missing shard are written anew, whole ones stay."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.lit("x").alias("again"))
    path = f"{work_folder(spark)}/shards"
    wrote = sinks.write_shards(c, path, "c_custkey", 40)
    part = spark.read.parquet(path).where(F.col("shard") == wrote[0]).limit(1).drop("shard").withColumn("shard", F.lit(wrote[0]))
    part.withColumn("again", F.lit("damaged")).write.partitionBy("shard").mode("append").parquet(path)
    if sinks.write_shards(c, path, "c_custkey", 40) != wrote[:1] or sinks.write_shards(c, path, "c_custkey", 40):
        raise ValueError("a whole shard was written again, or a damaged one was not")
    return spark.read.parquet(path).drop("shard")


@query("""
WITH c AS (SELECT c_custkey AS key, 'c_name' AS header, c_name AS v FROM customer UNION ALL SELECT c_custkey, 'c_custkey', c_custkey::VARCHAR FROM customer UNION ALL SELECT c_custkey, 'note', '=' || repeat('ab', 20) FROM customer),
s AS (SELECT key, header, CASE WHEN v LIKE '=%' THEN chr(39) || v ELSE v END AS v FROM c), p AS (SELECT *, unnest(range(0, CAST(ceil(length(v) / 15.0) AS BIGINT))) AS i FROM s)
SELECT 'customers' AS sheet, key, header, CAST(i + 1 AS INTEGER) AS part, substr(v, i * 15 + 1, 15) AS value FROM p
""")
def workbook_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of a workbook, long ones in parts, formulas as text."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.concat(F.lit("="), F.repeat(F.lit("ab"), 20)).alias("note"), F.lit(None).cast("string").alias("nothing"))
    return sinks.workbook_cells(c, "customers", "c_custkey", 15)


@query("""
WITH c AS (SELECT DISTINCT c FROM (SELECT lower(p_type) AS c FROM part UNION ALL SELECT p_name || ' é' FROM part UNION ALL SELECT unnest(['negative', 'positive', 'indeterminate', 'normal', 'abnormal', 'x', ''])))
SELECT c, CASE c WHEN 'negative' THEN 0 WHEN 'positive' THEN 1 WHEN 'indeterminate' THEN -1 WHEN 'normal' THEN 10 WHEN 'abnormal' THEN 11
  ELSE CAST(100 + list_reduce(list_prepend(0::BIGINT, list_reverse(list_transform(range(1, octet_length(encode(c)) + 1), lambda i: ('0x' || substr(hex(encode(c)), 2 * i - 1, 2))::BIGINT))), lambda a, b: (a * 256 + b) % 900000) AS INTEGER) END AS id FROM c
""")
def category_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stable numbers of categories."""
    p = table(spark, sf_dir, "part")
    words = spark.createDataFrame([(w,) for w in ("negative", "positive", "indeterminate", "normal", "abnormal", "x", "")], "c string")
    c = p.select(F.lower("p_type").alias("c")).union(p.select(F.concat("p_name", F.lit(" é")).alias("c"))).union(words).distinct()
    return c.select("c", ids.category_id(F.col("c")).alias("id"))


@query("""
WITH b AS (SELECT l.*, o_custkey, CAST(regexp_extract(p_brand, '[0-9]+') AS INTEGER) AS n FROM lineitem l JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey),
f AS (SELECT o_custkey, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey::VARCHAR) AS r FROM orders),
e AS (SELECT 'medicines' AS source_table, o_custkey AS p, l_shipdate AS t, 'T/' || n AS code FROM b WHERE n % 3 <> 2 UNION ALL SELECT 'visits', o_custkey, o_orderdate, 'Visit/IP' FROM orders
  UNION ALL SELECT 'demographics', o_custkey, make_date(CAST(1880 + o_orderkey % 99 AS INTEGER), 1, 1)::TIMESTAMP, 'SNOMED/3950001' FROM f WHERE r = 1 AND 1880 + o_orderkey % 99 >= 1900
  UNION ALL SELECT 'demographics', o_custkey, o_orderdate, 'Gender/F' FROM f WHERE r = 1 AND o_orderkey % 2 = 0)
SELECT p::VARCHAR AS patient_id, source_table, code, count(*) AS n, min(t) AS first_time, max(t) AS last_time, (SELECT count(*) FROM e x WHERE x.p = e.p) AS n_patient FROM e GROUP BY ALL
""")
def context_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mapped events with those of visits and patients, in each patient's order."""
    o = table(spark, sf_dir, "orders")
    v = o.select(F.col("o_custkey").cast("string").alias("patient_id"), F.col("o_orderkey").cast("string").alias("visit_id"), F.col("o_orderdate").alias("admission_time"), F.when(F.col("o_orderkey") % 2 == 0, "F").otherwise("").alias("gender_code"), (F.col("o_orderkey") % 99 + 1880).cast("int").alias("birth_year"))
    lines = _lines(spark, sf_dir).withColumn("priority", F.lit(30)).withColumn("event_id", F.concat_ws("-", "visit_id", "l_linenumber", "l_partkey", "l_suppkey"))
    out = E.context_events(lines, _concept_map(spark, sf_dir), v)
    whole = out.groupBy("patient_id").agg((F.max("patient_ordinal") + 1).cast("long").alias("n_patient"))
    return out.groupBy("patient_id", "source_table", "code").agg(F.count(F.lit(1)).alias("n"), F.min("time").alias("first_time"), F.max("time").alias("last_time")).join(whole, "patient_id")
