"""Gates on measured figures, draws, audits, parts under a budget, proposed pairs and nested model output, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caselight.functions import text
from caselight.operators import aggregates as A
from caselight.operators import events as E
from caselight.operators import evidence as X
from caselight.operators import vectors
from caselight.operators import graph as G
from caselight.operators import joins as J
from caselight.operators import quality as Q
from caselight.operators import tables as B
from caselight.plans import query
from caselight.plans.clinical import _EVENTS, _STOP, _events, _visits
from caselight.plans.retrieval import _unit
from caselight.session import table, work_folder

_VIEWS = f"""
u AS (SELECT vec_id, {_unit('embedding')} AS v, {_unit('embedding[1:32]')} AS a, list_slice({_unit('embedding')}, 1, 32) AS b FROM embeddings WHERE vec_id % 2 = 0),
h AS (SELECT vec_id, coalesce(lead(vec_id) OVER w, first_value(vec_id) OVER w) AS other FROM u WINDOW w AS (ORDER BY sha256('5:' || vec_id), vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
s AS (SELECT q.vec_id AS q, c.vec_id AS c, round(list_inner_product(q.a, c.b), 9) AS s FROM u q, u c),
r AS (SELECT s.q, 1 + count(*) FILTER (WHERE s.s > o.s) AS own, 1 + count(*) FILTER (WHERE s.s > n.s) AS shuffled FROM s JOIN h ON h.vec_id = s.q JOIN s o ON o.q = s.q AND o.c = s.q JOIN s n ON n.q = s.q AND n.c = h.other GROUP BY s.q),
d AS (SELECT avg((own <= 1)::INTEGER) AS own, avg((shuffled <= 1)::INTEGER) AS shuffled FROM r)
"""


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second embedding, normalised, and two views of it."""
    e = table(spark, sf_dir, "embeddings").where("vec_id % 2 = 0")
    v = vectors.normalize(F.col("embedding"))
    return e.select("vec_id", v.alias("embedding"), vectors.normalize(F.slice("embedding", 1, 32)).alias("a"), F.slice(v, 1, 32).alias("b"), (F.col("vec_id") % 9).alias("size"))


def _recalls(e: DataFrame) -> DataFrame:
    """recall_at_1 of the same row in the other view, and of a row that isn't the same."""
    at_1 = lambda ranks, name: ranks.agg(F.avg((F.col("rank") <= 1).cast("double")).alias(name))
    own = at_1(vectors.ranks_of_own(e, e, "vec_id", "a", "b"), "own")
    null = at_1(vectors.ranks_of_own(e, e, "vec_id", "a", "b", partners=vectors.mismatched(e, "vec_id", 5)), "shuffled")
    return J.with_constants(own, null)


@query(f"WITH {_VIEWS} SELECT own, shuffled, own - shuffled AS delta FROM d")
def shuffled_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of the same row in another view beside that of a seeded mismatch without a fixed point."""
    return _recalls(_split(spark, sf_dir)).withColumn("delta", F.col("own") - F.col("shuffled"))


@query(f"""
WITH {_VIEWS}, i AS (SELECT unnest(range(1, 65)) AS i), x AS (SELECT vec_id, i, v[i] AS x FROM u, i), mu AS (SELECT i, avg(x) AS m FROM x GROUP BY 1), z AS (SELECT vec_id, x.i, x - m AS x FROM x JOIN mu ON mu.i = x.i),
g AS (SELECT a.i, b.i AS j, sum(a.x * b.x) AS g FROM z a JOIN z b USING (vec_id) GROUP BY 1, 2), p AS (SELECT pow(sum(g) FILTER (WHERE i = j), 2) / sum(g * g) AS least_rank FROM g),
n AS (SELECT vec_id, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM u),
c AS (SELECT a.vec_id AS q, b.vec_id AS c, list_inner_product(a.v, b.v) AS s FROM u a JOIN u b ON a.vec_id <> b.vec_id),
t AS (SELECT c, count(*) AS n FROM (SELECT q, c, row_number() OVER (PARTITION BY q ORDER BY s DESC, c) AS r FROM c) WHERE r = 1 GROUP BY 1),
k AS (SELECT corr(m, ln(1 + q % 9)) AS corr FROM (SELECT q, avg(s) AS m FROM c GROUP BY 1)),
f AS (SELECT (SELECT count(*) FROM u WHERE v IS NULL) = 0 AS finite, (SELECT min(n) >= 1 - 1e-4 AND max(n) <= 1 + 1e-4 FROM n) AS l2_norm, (SELECT least_rank >= 16 FROM p) AS effective_rank, (SELECT max(n) / sum(n) <= 0.05 FROM t) AS top1_hub,
  (SELECT abs(corr) < 0.2 FROM k) AS graph_size_correlation, (SELECT own - shuffled > 0.05 FROM d) AS cross_view_beats_shuffled_null)
SELECT unnest(['finite', 'l2_norm', 'effective_rank', 'top1_hub', 'graph_size_correlation', 'cross_view_beats_shuffled_null', 'all']) AS gate,
  unnest([finite, l2_norm, effective_rank, top1_hub, graph_size_correlation, cross_view_beats_shuffled_null, finite AND l2_norm AND effective_rank AND top1_hub AND graph_size_correlation AND cross_view_beats_shuffled_null]) AS passed FROM f
""")
def embedding_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates on diagnostics of one split, all of them measured. The SQL bounds the effective rank from below, which is enough where it passes."""
    e = _split(spark, sf_dir)
    n = e.agg(F.count_if(~vectors.is_valid(F.col("embedding"))).alias("n_not_finite"), F.min(vectors.norm(F.col("embedding"))).alias("norm_min"), F.max(vectors.norm(F.col("embedding"))).alias("norm_max"))
    stats = vectors.matrix_statistics(e, "embedding", "size").select("effective_rank", "effective_rank_target", "size_correlation")
    hub = vectors.hub_share(vectors.topk_cosine(e, e, "vec_id", "embedding", 1)).select(F.col("hub_share").alias("top1_hub"))
    delta = _recalls(e).select((F.col("own") - F.col("shuffled")).alias("recall_delta"))
    return Q.embedding_gates(J.with_constants(J.with_constants(J.with_constants(n, stats), hub), delta))


_NODES = "SELECT DISTINCT l_orderkey AS graph, l_returnflag AS kind, l_partkey AS node, 1 + l_partkey % 5 AS weight FROM lineitem"


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    return line.select(F.col("l_orderkey").alias("graph"), F.col("l_returnflag").alias("kind"), F.col("l_partkey").alias("node"), (F.col("l_partkey") % 5 + 1).alias("weight")).distinct()


@query(f"""
WITH d AS ({_NODES}), k AS (SELECT *, -ln(('0x' || substr(sha256('21:' || graph || ':' || node), 1, 12))::BIGINT / pow(16, 12) + 1e-12) / weight AS k FROM d),
r AS (SELECT *, count(*) OVER (PARTITION BY graph, kind) AS n, row_number() OVER (PARTITION BY graph, kind ORDER BY k, node) AS r FROM k)
SELECT graph, kind, node FROM r WHERE r <= least(CASE WHEN kind IN ('A', 'R') THEN n - 1 ELSE n END, greatest(1, round_even(n * 0.4, 0)))
""")
def weighted_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes drawn by weight without replacement; of a core kind one stays."""
    return G.weighted_removal(_nodes(spark, sf_dir), "graph", "kind", "node", "weight", 0.4, 21, ["A", "R"]).select("graph", "kind", "node")


@query(f"""
WITH d AS (SELECT *, node % 3 AS bucket FROM ({_NODES}))
SELECT graph, kind, bucket, node, coalesce(lead(node) OVER w, first_value(node) OVER w) AS node_permuted FROM d
WINDOW w AS (PARTITION BY kind, bucket, graph ORDER BY sha256('3:' || node), node ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
""")
def permuted_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each node's partner of its graph, type and bucket, by a seeded permutation."""
    nodes = _nodes(spark, sf_dir).withColumn("bucket", F.col("node") % 3)
    return G.permuted(nodes, ["kind", "bucket", "graph"], "node", "node", 3).select("graph", "kind", "bucket", "node", "node_permuted")


@query(f"""
WITH {_EVENTS}, v AS (SELECT o_orderkey::VARCHAR AS v, o_orderdate AS a, o_orderdate + to_days(CAST(o_orderkey % 7 AS INTEGER)) AS d FROM orders),
x AS (SELECT e.source_table, e.q, e.c, t, CASE WHEN t IS NULL THEN NULL WHEN t < a THEN 'before_admission' WHEN t > d THEN 'after_discharge' ELSE 'within_visit' END AS status FROM e JOIN v USING (v)),
m AS (SELECT count(*) AS n_events, 0 AS n_imputed, count(*) FILTER (WHERE c LIKE 'code:Brand#1%') AS n_mapped, count(q) AS n_values, 0 AS n_without_time, count(*) FILTER (WHERE source_table = 'diagnoses') AS "source:diagnoses", count(*) FILTER (WHERE source_table = 'medicines') AS "source:medicines", 0 AS "source:other",
  count(*) FILTER (WHERE status = 'before_admission') AS "status:before_admission", count(*) FILTER (WHERE status = 'within_visit') AS "status:within_visit", count(*) FILTER (WHERE status = 'after_discharge') AS "status:after_discharge", 0 AS "status:other", date_diff('day', DATE '1970-01-01', min(t)::DATE) AS first_day, date_diff('day', DATE '1970-01-01', max(t)::DATE) AS last_day FROM x)
SELECT name AS measure, value::BIGINT AS value FROM (UNPIVOT m ON COLUMNS(*))
""")
def audited_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by source, status, imputation and mapping from the pass that writes the placed events."""
    placed = E.place(_events(spark, sf_dir), _visits(spark, sf_dir))
    concept = F.when(F.startswith("code", F.lit("code:Brand#1")), F.col("code"))
    found = E.write_audited(placed, f"{work_folder(spark)}/events", E.audits(["diagnoses", "medicines"], ["before_admission", "within_visit", "after_discharge"], concept))
    return spark.createDataFrame(sorted(found.items()), "measure string, value long")


_BUDGET = 4000


@query(f"""
WITH x AS (SELECT conv_id, sum(strlen('{{"conv_id":' || conv_id || ',"turn":' || turn || ',"text":' || to_json(text) || '}}') + 1)::BIGINT AS bytes FROM (SELECT conv_id, turn, regexp_replace(text, '[^a-z ]', '', 'g') AS text FROM conversations) GROUP BY conv_id),
h AS (SELECT *, sha256(conv_id::VARCHAR) AS h, bytes * 2 > {_BUDGET} AS large FROM x),
p AS (SELECT *, sum(bytes) OVER w - bytes AS start, count(*) OVER w AS nth FROM h WINDOW w AS (PARTITION BY large ORDER BY substr(h, 1, 3), h, conv_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
q AS (SELECT conv_id, bytes, bytes > {_BUDGET} AS over, CASE WHEN large THEN 'large-' || nth ELSE 'small-' || CAST(start * 2 // {_BUDGET} + 1 AS BIGINT) END AS part FROM p)
SELECT conv_id, bytes, part, over, sum(bytes) OVER (PARTITION BY part)::BIGINT AS part_bytes FROM q
""")
def packed_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q11: whole conversations packed into parts of a byte budget by exact sizes."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.regexp_replace("text", "[^a-z ]", "").alias("text"))
    out = Q.packed_parts(c, "conv_id", _BUDGET)
    return out.withColumn("part_bytes", F.sum("bytes").over(Window.partitionBy("part")))


@query(f"""
WITH t AS (SELECT conv_id, turn, role, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), lambda x: length(x) >= 2 AND NOT list_contains([{_STOP}], x)) AS w FROM conversations),
g AS (SELECT *, list_concat(CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' '))) ELSE [] END, CASE WHEN len(w) >= 2 THEN list_distinct(list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i+1], ' '))) ELSE [] END) AS g FROM t),
o AS (SELECT a.conv_id AS q, b.conv_id AS c FROM (SELECT DISTINCT conv_id FROM conversations) a JOIN (SELECT DISTINCT conv_id FROM conversations) b ON b.conv_id = a.conv_id + 1),
p AS (SELECT o.q AS "left", o.c AS "right", a.turn AS left_field, b.turn AS right_field, a.role AS title, list_distinct(list_intersect(a.w, b.w)) AS t, list_intersect(a.g, b.g) AS p FROM o JOIN g a ON a.conv_id = q JOIN g b ON b.conv_id = c AND a.role = b.role),
f AS (SELECT *, CAST(3 + len(t) + 3 * coalesce(list_sum(list_transform(p, lambda x: length(x) - length(replace(x, ' ', '')) + 1)), 0) AS INTEGER) AS score FROM p WHERE len(p) > 0 OR len(t) >= 2),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "left", "right", title ORDER BY score DESC, left_field, right_field) AS r FROM f) WHERE r = 1)
SELECT "left", "right", left_field, right_field, title, CAST(len(t) AS INTEGER) AS n_terms, CAST(len(p) AS INTEGER) AS n_phrases, score, CAST(row_number() OVER (PARTITION BY "left", "right" ORDER BY score DESC, title) AS INTEGER) AS place FROM b
""")
def field_pairs_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field pairs of each conversation and the next, proposed by an inverted index of terms; the best one of a title, the first twelve."""
    fields = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", X.terms_of(F.col("text")).alias("own"))
    known = fields.select("conv_id").distinct()
    pairs = known.select(F.col("conv_id").alias("left"), (F.col("conv_id") + 1).alias("right")).join(known.withColumnRenamed("conv_id", "right"), "right")
    found = X.proposed_pairs(pairs, "left", "right", fields, "conv_id", "turn", "role", "own")
    side = lambda c, f, title, own: fields.select(F.col("conv_id").alias(c), F.col("turn").alias(f), F.col("role").alias(title), F.col("own").alias(own)).hint("merge")  # noqa: E731  terms are many times their text
    rows = found.join(side("left", "left_field", "title", "a"), ["left", "left_field"]).join(side("right", "right_field", "other", "b"), ["right", "right_field"])
    best = X.best_pairs(X.shared_terms(rows, "a", "b", "title", "other"), ["left", "right"], "title", "other", ties=["left_field", "right_field"])
    return best.select("left", "right", "left_field", "right_field", "title", "n_terms", "n_phrases", "score", "place")


@query("""
WITH c AS (SELECT conv_id, turn, conv_id * 100 + turn AS k FROM conversations)
SELECT conv_id, turn, CASE k % 7 WHEN 1 THEN 'payload' WHEN 2 THEN 'no text' WHEN 3 THEN 'not json' WHEN 4 THEN 'missing ranking' END AS error,
  CASE WHEN k % 7 IN (0, 5, 6) THEN 'A' || (k % 10) END AS code, CASE WHEN k % 7 IN (0, 5, 6) THEN i END::INTEGER AS place, CASE WHEN k % 7 IN (0, 5, 6) THEN (k + i) / 4.0 END::DOUBLE AS score
FROM c, (VALUES (0), (1)) p(i) WHERE k % 7 IN (0, 5, 6) OR i = 0
""")
def model_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored model calls around every turn: fenced answers, answers encoded once more, an answer after a part without one, and four kinds of faults."""
    c = table(spark, sf_dir, "conversations").withColumn("k", F.col("conv_id") * 100 + F.col("turn"))
    ranking = F.array(*(F.struct((F.col("k") + i).cast("string").alias("id"), ((F.col("k") + i) / 4).alias("score")) for i in (0, 1)))
    full = F.to_json(F.struct(F.struct(F.concat(F.lit("A"), (F.col("k") % 10).cast("string")).alias("code"), F.col("text").alias("why")).alias("query_icd_assessment"), ranking.alias("ranking")))
    half = F.to_json(F.struct(F.struct(F.lit("x").alias("code")).alias("query_icd_assessment"), F.col("text").alias("note")))
    fenced = lambda t: F.concat(F.lit("```json\n"), t, F.lit("\n```"))
    # A JSON string of the text: the object of one field without the field's name and braces.
    again = lambda t: F.regexp_extract(F.to_json(F.struct(t.alias("t"))), r'(?s)^\{"t":(.*)\}$', 1)
    kind = F.col("k") % 7
    parts = (
        F.when(kind == 0, F.array(fenced(full))).when(kind == 5, F.array(again(fenced(full)))).when(kind == 6, F.array(F.lit(""), F.lit("no object here"), F.concat(F.lit("Here it is: "), full, F.lit(" - done"))))
        .when(kind == 2, F.array(F.lit(""))).when(kind == 3, F.array(F.concat(F.lit("```json\n{"), F.lit('"ranking": ['), F.lit("\n```")))).otherwise(F.array(fenced(half)))
    )
    call = F.to_json(F.struct(F.struct(F.array(F.struct(F.struct(F.transform(parts, lambda t: F.struct(t.alias("text"))).alias("parts")).alias("content"))).alias("candidates")).alias("response")))
    payload = F.when(kind == 1, F.substring(call, 1, 20)).otherwise(call)
    found = c.withColumn("o", text.model_output(payload, ["query_icd_assessment", "ranking"])).select("conv_id", "turn", "o.error", "o.output")
    items = found.select("conv_id", "turn", "error", F.try_variant_get("output", "$.query_icd_assessment.code", "string").alias("code"), F.try_variant_get("output", "$.ranking", "variant").alias("ranking"))
    every = items.lateralJoin(spark.tvf.variant_explode_outer(F.col("ranking").outer()))
    return every.select("conv_id", "turn", "error", "code", F.col("pos").cast("int").alias("place"), F.try_variant_get("value", "$.score", "double").alias("score"))


_WORDS_MISSING = "('', 'null', 'none', 'nan', 'nat', 'not available', 'n/a', 'na')"


@query(f"""
WITH v AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN '  ' || event_type || '   x ' WHEN 1 THEN ' N/A' WHEN 2 THEN 'None' WHEN 3 THEN NULL WHEN 4 THEN '' ELSE event_type END AS v FROM events), c AS (SELECT event_id, trim(regexp_replace(coalesce(v, ''), '\\s+', ' ', 'g')) AS t FROM v)
SELECT event_id, CASE WHEN lower(t) NOT IN {_WORDS_MISSING} THEN t END AS value FROM c
""")
def cleaned_or_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned cells, missing words as nulls."""
    k = F.col("event_id") % 6
    v = F.when(k == 0, F.concat(F.lit("  "), "event_type", F.lit("   x "))).when(k == 1, " N/A").when(k == 2, "None").when(k == 3, F.lit(None)).when(k == 4, "").otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", text.clean_or_null(v).alias("value"))


@query("SELECT c_nationkey, c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY ALL")
def without_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without what names them, in counts by what is left."""
    left = B.without_identifiers(table(spark, sf_dir, "customer"), ["c_custkey", "c_name", "c_phone"])
    return left.groupBy(*(c for c in left.columns if c != "c_acctbal")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("""
SELECT c_custkey, 'Instruct: find alike customers' || chr(10) || 'Query: ' || concat_ws(chr(10), 'segment: ' || c_mktsegment, CASE WHEN c_custkey % 3 > 0 THEN 'nation: ' || n_name END, CASE WHEN c_custkey % 4 > 0 THEN 'name: ' || c_name END) AS text
FROM customer JOIN nation ON n_nationkey = c_nationkey
""")
def instructed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled sections of every customer behind an instruction; sections without text are left out."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey")
    sections = text.labelled_sections(("segment", F.col("c_mktsegment")), ("nation", F.when(k % 3 > 0, F.col("n_name"))), ("name", F.when(k % 4 > 0, F.col("c_name")).otherwise("")))
    return c.select("c_custkey", text.instruct("find alike customers", sections).alias("text"))


@query("""
WITH s AS (SELECT p_partkey, p_name, CASE p_partkey % 4 WHEN 0 THEN upper(string_split(p_name, ' ')[-1]) || '  ' || string_split(p_name, ' ')[1] WHEN 1 THEN substr(p_name, 2, 3) WHEN 2 THEN 'no such ' || p_name ELSE '' END AS s FROM part)
SELECT p_partkey FROM s WHERE len(list_filter(string_split_regex(lower(s), '\\s+'), lambda w: w <> '' AND NOT contains(lower(p_name), w))) = 0
""")
def searched_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose name holds every word of a search, whatever their order and case."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey") % 4
    words = F.split("p_name", " ")
    search = F.when(k == 0, F.concat(F.upper(F.element_at(words, -1)), F.lit("  "), F.element_at(words, 1))).when(k == 1, F.substring("p_name", 2, 3)).when(k == 2, F.concat(F.lit("no such "), "p_name")).otherwise("")
    return p.where(text.matches_all(F.col("p_name"), search)).select("p_partkey")


@query("""
WITH n AS (SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, count(*) FILTER (WHERE o_orderstatus = 'P') AS partly FROM orders GROUP BY 1)
SELECT o_custkey, n, done, partly, CASE WHEN done = n THEN 'complete' WHEN partly > 0 THEN 'partial' WHEN done = 0 THEN 'open' ELSE 'started' END AS status FROM n
""")
def case_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's status by the first rule on counts that holds."""
    state = F.col("o_orderstatus")
    counts = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(state == "F").alias("done"), F.count_if(state == "P").alias("partly"))
    return A.roll_up(counts, [(F.col("done") == F.col("n"), "complete"), (F.col("partly") > 0, "partial"), (F.col("done") == 0, "open")], "started")


@query("""
WITH v AS (SELECT CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_type = 'purchase' THEN 'yes' WHEN event_type = 'error' THEN 'unknown' ELSE 'no' END AS v FROM events), n AS (SELECT count(v) AS completed, count(*) FILTER (WHERE v = 'yes') AS positive, count(*) FILTER (WHERE v = 'unknown') AS unknown FROM v)
SELECT *, positive / nullif(completed - unknown, 0) AS positive_share FROM n
""")
def review_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completed, positive and unknown verdicts and the positive share of those decided."""
    kind = F.col("event_type")
    verdict = F.when(F.col("event_id") % 5 == 0, F.lit(None)).when(kind == "purchase", "yes").when(kind == "error", "unknown").otherwise("no")
    return A.review_summary(table(spark, sf_dir, "events").withColumn("verdict", verdict), "verdict")
