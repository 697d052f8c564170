"""Visit graphs, hypergraphs and cohorts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselight.functions import ids
from caselight.operators import aggregates as A
from caselight.operators import joins as J
from caselight.operators import windows as W


def star_graph(visits: DataFrame, children: dict[str, DataFrame], visit: str = "visit_id", node: str = "node_id") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): a root a visit, its children, and edges in both directions."""
    root = F.concat(F.lit("visit:"), F.col(visit).cast("string"))
    parts = [visits.select(F.col(visit).alias("graph_id"), root.alias("node_id"), F.lit("visit").alias("node_type"))]
    for kind, df in sorted(children.items()):
        parts.append(df.select(F.col(visit).alias("graph_id"), F.concat(F.lit(f"{kind}:"), F.col(node).cast("string")).alias("node_id"), F.lit(kind).alias("node_type")).distinct())
    nodes = reduce(DataFrame.unionByName, parts)
    leaf = nodes.where("node_type <> 'visit'").select("graph_id", F.concat(F.lit("visit:"), F.col("graph_id").cast("string")).alias("source"), F.col("node_id").alias("target"), F.concat(F.lit("has_"), F.col("node_type")).alias("relation"))
    back = leaf.select("graph_id", F.col("target").alias("source"), F.col("source").alias("target"), F.concat(F.lit("rev_"), F.col("relation")).alias("relation"))
    return nodes, leaf.unionByName(back)


def link_edges(left: DataFrame, right: DataFrame, keys: list[str], source: str, target: str, relation: str) -> DataFrame:
    """Edges in both directions between rows that agree on the keys, such as an order and its results."""
    one = J.same_key_edges(left, right, keys, source, target).withColumn("relation", F.lit(relation))
    return one.unionByName(one.select(F.col("target").alias("source"), F.col("source").alias("target"), F.lit(f"rev_{relation}").alias("relation")))


def node_events(df: DataFrame, visit: str, token: Column, hours: str, value: str | None = None, quantity: str | None = None, bucket_hours: int | None = None, lower: str | None = None, upper: str | None = None, by: list[str] | None = None) -> DataFrame:
    """Rows of one visit and token (and day, or other columns) as one node: count, sum, medians, bounds, relative hours."""
    rows = df.withColumn("token", token)
    keys = [visit, "token", *(by or [])]
    if bucket_hours:
        rows = rows.withColumn("bucket", F.coalesce(F.floor(F.col(hours) / bucket_hours).cast("int"), F.lit(-2147483648)))
        keys.append("bucket")
    aggs = [F.count(F.lit(1)).alias("n"), F.percentile(hours, 0.5).alias("hours")]
    if quantity:
        aggs.append(F.sum(quantity).alias("quantity"))
    if value:
        aggs.append(F.percentile(value, 0.5).alias("value"))
    if lower:
        aggs.append(F.min(lower).alias("lower"))
    if upper:
        aggs.append(F.max(upper).alias("upper"))
    return rows.where(F.col("token").isNotNull() & (F.col("token") != "")).groupBy(*keys).agg(*aggs)


def indexed(nodes: DataFrame, graph: str, order: list[Column | str]) -> DataFrame:
    """Nodes with an index from 1 within their graph (0 is the root)."""
    return nodes.withColumn("index", F.row_number().over(Window.partitionBy(graph).orderBy(*order)))


def temporal_chains(nodes: DataFrame, graph: str, token: str, order: list[str], index: str = "index") -> DataFrame:
    """graph, source, target, relation between nodes of one token that follow one another."""
    nxt = F.lead(index).over(Window.partitionBy(graph, token).orderBy(*order))
    one = nodes.select(graph, F.col(index).alias("source"), nxt.alias("target")).where("target IS NOT NULL").withColumn("relation", F.lit("next"))
    return one.unionByName(one.select(graph, F.col("target").alias("source"), F.col("source").alias("target"), F.lit("prev").alias("relation")))


def tensors(nodes: DataFrame, edges: DataFrame, graph: str, features: list[str], removed: Column | None = None) -> DataFrame:
    """One row a graph: ordered features and edges; removed nodes leave and the rest are numbered again."""
    kept = nodes.where(~F.coalesce(removed, F.lit(False))) if removed is not None else nodes
    new = kept.withColumn("_i", F.row_number().over(Window.partitionBy(graph).orderBy("index")))
    rows = F.array_sort(F.collect_list(F.struct("_i", F.array(*(F.col(f).cast("double") for f in features)).alias("_x"))))
    x = new.groupBy(graph).agg(F.transform(rows, lambda r: r["_x"]).alias("x"))
    m = new.select(graph, F.col("index").alias("_old"), "_i")
    e = edges.join(m.withColumnRenamed("_old", "source").withColumnRenamed("_i", "_s"), [graph, "source"]).join(m.withColumnRenamed("_old", "target").withColumnRenamed("_i", "_t"), [graph, "target"])
    listed = e.groupBy(graph).agg(F.array_sort(F.collect_list(F.struct(F.col("_s").alias("source"), F.col("_t").alias("target"), "relation"))).alias("edges"))
    return x.join(listed, graph, "left")


def training_statistics(nodes: DataFrame, split: Column, graph: str, token: str, value: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(vocabulary, idf, robust statistics) from the training part alone."""
    train = nodes.where(split == "train")
    return A.vocabulary(train, token), A.idf(train, graph, token), A.robust_stats(train.where(F.col(value).isNotNull()), token, value)


def structured_dataset(events: DataFrame, visit: str, token: str, hours: str, value: str, split: Column, bucket_hours: int = 24) -> dict[str, DataFrame]:
    """nodes (numbered, by visit, token and day), chains, vocabulary, idf, statistics and splits of a structured dataset; the last three of the training part alone."""
    nodes = node_events(events, visit, F.col(token), hours, value, None, bucket_hours)
    placed = indexed(nodes, visit, ["token", "bucket"])
    words, weights, stats = training_statistics(placed, split, visit, "token", "value")
    return {"nodes": placed, "chains": temporal_chains(placed, visit, "token", ["bucket"]), "vocabulary": words, "idf": weights, "statistics": stats, "splits": events.select(visit).distinct().withColumn("split", split)}


def select_cohort(domains: dict[str, DataFrame], visits: DataFrame, visit: str, patient: str, token: str, top: dict[str, int], min_visits: int) -> DataFrame:
    """visit, patient, visit_index, edge_index, patient_index: visits with every domain after its vocabulary cut, of patients with enough of them."""
    eligible = []
    for name, df in sorted(domains.items()):
        if top.get(name):
            df = df.join(A.ranked_vocabulary(df, visit, token, top[name]).select(token), token, "left_semi")
        eligible.append(df.select(visit).distinct())
    kept = visits.join(J.in_all(eligible, visit), visit, "left_semi")
    many = kept.groupBy(patient).agg(F.countDistinct(visit).alias("n")).where(F.col("n") >= min_visits)
    return kept.join(many.select(patient), patient, "left_semi")


def with_indices(cohort: DataFrame, patient: str, visit: str, time: str, seed: int) -> DataFrame:
    """The cohort's visits with their place within the patient and the patient's place in hash order; the cohort is already a cut."""
    df = cohort.withColumn("_h", ids.hash_order(seed, F.col(patient))).withColumn("visit_index", F.row_number().over(Window.partitionBy(patient).orderBy(time, visit)) - 1)
    order = W.placed(df.select(patient, "_h").distinct(), ["_h", patient], "patient_index").withColumn("patient_index", F.col("patient_index").cast("int"))
    return df.join(order.drop("_h"), patient).drop("_h")


def memberships(events: DataFrame, cohort: DataFrame, vocabulary: DataFrame, visit: str, token: str, edge_index: str) -> DataFrame:
    """edge, node: a binary incidence in long form."""
    rows = events.select(visit, token).distinct().join(cohort.select(visit, F.col(edge_index).alias("edge")), visit)
    return rows.join(vocabulary.select(token, F.col("index").alias("node")), token).select("edge", "node")


def sampled_nodes(nodes: DataFrame, graph: str, kind: str, node: str, share: float, seed: int) -> DataFrame:
    """Of each graph's nodes of a kind the rounded share, one at least, in the order of a seeded hash; a lone node stays out."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(graph).cast("string"), F.lit(":"), F.col(node).cast("string")).cast("binary"), 256)
    w = Window.partitionBy(graph, kind)
    rows = nodes.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_r", F.row_number().over(w.orderBy(h, node)))
    want = F.greatest(F.lit(1), F.least(F.col("_n") - 1, F.bround(F.col("_n") * share).cast("int")))
    return rows.where((F.col("_n") > 1) & (F.col("_r") <= want)).drop("_n", "_r")


def weighted_pick(nodes: DataFrame, graph: str, node: str, weight: str, seed: int) -> DataFrame:
    """One node a graph, drawn with a chance in proportion to its weight."""
    u = (ids.split_score(seed, F.concat_ws(":", F.col(graph), F.col(node))) + 1e-12)
    return nodes.where(F.col(weight) > 0).groupBy(graph).agg(F.min_by(node, -F.log(u) / F.col(weight)).alias(node))


def weighted_removal(nodes: DataFrame, graph: str, kind: str, node: str, weight: str, share: float, seed: int, core: list[str]) -> DataFrame:
    """The nodes to remove: of each graph's nodes of a kind the rounded share, one at least, drawn without replacement with chances in proportion to their weights.

    Each node has an exponential key, -ln(u) / weight with u from a hash, and the least ones go, so the draw is one ranking and always the
    same. Of a core kind one node stays; a lone node of another kind may go. Nodes without a positive weight are drawn last.
    """
    u = ids.split_score(seed, F.concat_ws(":", F.col(graph), F.col(node))) + 1e-12
    key = F.when(F.col(weight) > 0, -F.log(u) / F.col(weight)).otherwise(F.lit(float("inf")))
    w = Window.partitionBy(graph, kind)
    rows = nodes.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_r", F.row_number().over(w.orderBy(key, node)))
    most = F.when(F.col(kind).isin(core), F.col("_n") - 1).otherwise(F.col("_n"))
    want = F.least(most, F.greatest(F.lit(1), F.bround(F.col("_n") * share).cast("int")))
    return rows.where(F.col("_r") <= want).drop("_n", "_r") if share > 0 else nodes.limit(0)


def permuted(nodes: DataFrame, keys: list[str], value: str, node: str, seed: int) -> DataFrame:
    """The value of the next node, in hash order, of the same keys (such as a type and a bucket); the last takes the first one's."""
    w = Window.partitionBy(*keys).orderBy(ids.hash_order(seed, F.col(node)), node)
    first = F.first(value).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    next_ = F.when(F.lead(F.lit(1)).over(w).isNotNull(), F.lead(value).over(w)).otherwise(first)
    return nodes.withColumn(f"{value}_permuted", next_)
