"""Graph projections of facts (triple_id, subject, object, relation_id, relation_label, confidence, source, evidence).

Defined results: edges with a null end are left out of paths; a centre that no node has means all nodes for the focused view and share 0; empty tables give empty results and shares 0."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import checkpointed
from ..functions.sizes import small_or_shuffled


def edges(facts: DataFrame, digits: int = 4) -> DataFrame:
    """(from, to, label, relation_id, value, avg_confidence, source, evidence): one row for each (subject, object, relation); the first three evidences by triple_id."""
    key = ["subject", "object", "relation_id"]
    g = facts.where("subject IS NOT NULL AND object IS NOT NULL AND relation_id IS NOT NULL").groupBy(*key).agg(F.min_by("relation_label", "triple_id").alias("label"), F.count("*").alias("value"), F.round(F.avg("confidence"), digits).alias("avg_confidence"), F.array_join(F.array_sort(F.collect_set("source")), "+").alias("source"))
    first = facts.select(*key, "triple_id", "evidence", F.row_number().over(Window.partitionBy(*key).orderBy("triple_id")).alias("rn")).where("rn <= 3")
    texts = first.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", F.coalesce("evidence", F.lit("")).alias("e")))), lambda x: x["e"]), "\n").alias("evidence"))
    return g.join(texts, key).select(F.col("subject").alias("from"), F.col("object").alias("to"), "label", "relation_id", "value", "avg_confidence", "source", "evidence")


def mention_counts(mentions: DataFrame) -> DataFrame:
    """(id, mentions) of linked entities."""
    return mentions.where("linked_entity_id IS NOT NULL").groupBy(F.col("linked_entity_id").alias("id")).agg(F.count("*").alias("mentions"))


def degrees(facts: DataFrame) -> DataFrame:
    """(id, degree): a fact counts at both ends, so twice for a loop."""
    return facts.select(F.explode(F.array("subject", "object")).alias("id")).where("id IS NOT NULL").groupBy("id").agg(F.count("*").alias("degree"))


def reached(pairs: DataFrame, center: str) -> DataFrame:
    """(id) of everything connected with ``center`` over undirected pairs (a, b): a frontier of new nodes is joined with the edges until none is new."""
    both = checkpointed(pairs.select("a", "b").union(pairs.select("b", "a")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct())
    seen = pairs.sparkSession.createDataFrame([(center,)], "id string")
    frontier = seen
    while True:
        new = both.join(small_or_shuffled(frontier.select(F.col("id").alias("a"))), "a").select(F.col("b").alias("id")).distinct().join(seen, "id", "left_anti")
        frontier = checkpointed(new)
        if frontier.isEmpty():
            return seen
        seen = checkpointed(seen.union(frontier))


def component(nodes: DataFrame, facts: DataFrame, center: str) -> DataFrame:
    """(id) of ``nodes`` in the component of ``center``; all nodes if the centre isn't one."""
    if nodes.where(F.col("id") == center).isEmpty():
        return nodes.select("id")
    inside = facts.select(F.col("subject").alias("a"), F.col("object").alias("b"))
    ids = nodes.select("id")
    inside = inside.join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi")
    return ids.join(reached(inside, center), "id", "left_semi")


def component_ratio(nodes: DataFrame, facts: DataFrame, center: str) -> DataFrame:
    """One row: nodes, reached, ratio (0 without nodes or centre)."""
    inside = component(nodes, facts, center).select("id", F.lit(1).alias("_in"))
    known = F.max((F.col("id") == center).cast("int")) == 1
    a = nodes.select("id").join(inside, "id", "left").agg(F.count("*").alias("nodes"), F.coalesce(F.when(known, F.count("_in")), F.lit(0)).alias("reached"))
    return a.select("nodes", "reached", F.coalesce(F.round(F.col("reached") / F.nullif(F.col("nodes"), F.lit(0)), 4), F.lit(0.0)).alias("ratio"))


def node_ids(mentions: DataFrame, facts: DataFrame) -> DataFrame:
    return mention_counts(mentions).select("id").union(degrees(facts).select("id")).distinct()


def nodes(ids: DataFrame, entities: DataFrame, mentions: DataFrame, facts: DataFrame) -> DataFrame:
    """(id, label, group, value, in_triples) of known entities; value is the number of mentions, at least 1."""
    e = entities.select("id", F.col("name").alias("label"), F.col("entity_type").alias("group"))
    j = e.join(ids, "id", "left_semi").join(mention_counts(mentions), "id", "left").join(degrees(facts), "id", "left")
    return j.select("id", "label", "group", F.greatest(F.coalesce("mentions", F.lit(0)), F.lit(1)).cast("bigint").alias("value"), F.col("degree").isNotNull().alias("in_triples"))


def focused_ids(facts: DataFrame, center: str) -> DataFrame:
    """Nodes of the facts in the component of ``center``."""
    return component(degrees(facts).select("id"), facts, center)


def projection_stats(entities: DataFrame, mentions: DataFrame, facts: DataFrame, center: str) -> DataFrame:
    """(metric, value): nodes and edges of the full and the focused view, linked nodes without facts."""
    full = node_ids(mentions, facts)
    focus = checkpointed(focused_ids(facts, center))
    e = edges(facts)
    inner = e.join(small_or_shuffled(focus.withColumnRenamed("id", "from")), "from", "left_semi").join(small_or_shuffled(focus.withColumnRenamed("id", "to")), "to", "left_semi")
    alone = mention_counts(mentions).join(degrees(facts), "id", "left_anti")
    one = lambda df, name: df.agg(F.lit(name).alias("metric"), F.count("*").alias("value"))
    return one(full, "full_nodes").union(one(e, "full_edges")).union(one(focus, "focused_nodes")).union(one(inner, "focused_edges")).union(one(alone, "isolated_nodes"))


def neighborhood(facts: DataFrame, center: str) -> DataFrame:
    """Facts with the centre at either end."""
    return facts.where((F.col("subject") == center) | (F.col("object") == center))


def found_nodes(nodes: DataFrame, query: str) -> DataFrame:
    """Nodes whose label or id contains ``query``, ignoring case."""
    q = query.lower()
    return nodes.where(F.contains(F.lower("label"), F.lit(q)) | F.contains(F.lower("id"), F.lit(q)))


def highlighted(nodes: DataFrame, facts: DataFrame, query: str) -> DataFrame:
    """(id, label, role): the nodes found by ``query`` (``found``) and those a fact links them with (``neighbour``)."""
    found = found_nodes(nodes, query).select("id")
    ends = facts.where("subject IS NOT NULL AND object IS NOT NULL").select(F.col("subject").alias("a"), F.col("object").alias("b"))
    near = ends.union(ends.select("b", "a")).join(found.withColumnRenamed("id", "a"), "a", "left_semi").select(F.col("b").alias("id")).distinct()
    j = nodes.select("id", "label").join(found.withColumn("_f", F.lit(1)), "id", "left").join(near.withColumn("_n", F.lit(1)), "id", "left").where("_f = 1 OR _n = 1")
    return j.select("id", "label", F.when(F.col("_f") == 1, "found").otherwise("neighbour").alias("role"))


def view(name: str, entities: DataFrame, mentions: DataFrame, facts: DataFrame, center: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the view ``full`` or ``focused``; any other name is refused."""
    if name not in ("full", "focused"):
        raise ValueError(f"no view {name}")
    ids = checkpointed(node_ids(mentions, facts) if name == "full" else focused_ids(facts, center))
    ends = small_or_shuffled(ids)
    inside = edges(facts).join(ends.withColumnRenamed("id", "from"), "from", "left_semi").join(ends.withColumnRenamed("id", "to"), "to", "left_semi")
    return nodes(ids, entities, mentions, facts), inside


def connected_nodes(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """(id, label) of the ends of ``edges`` (from, to); an id without an entity is its own label."""
    ids = edges.select(F.explode(F.array("from", "to")).alias("id")).distinct()
    return ids.join(small_or_shuffled(entities.select("id", F.col("name").alias("label"))), "id", "left").select("id", F.coalesce("label", "id").alias("label"))


def budgeted(pairs: DataFrame, seeds: list[str], most: int = 50) -> DataFrame:
    """(from, to, value) of weighted edges (from, to) by falling weight, up to the first that would bring a new node over the budget of ``most`` nodes, seeds included. Ties by ids."""
    w = pairs.where("`from` IS NOT NULL AND `to` IS NOT NULL").where(~F.col("to").isin(seeds)).groupBy("from", "to").agg(F.count("*").alias("value"))
    order = [F.desc("value"), "from", "to"]
    first = w.withColumn("rn", F.row_number().over(Window.partitionBy("to").orderBy(*order))).where("rn = 1").orderBy(*order).limit(most + 1)
    # the cut lies at the first appearance of the node one over the budget; at most budget + 1 rows are looked at
    room = max(0, most - len(set(seeds)))
    rank = first.withColumn("k", F.row_number().over(Window.orderBy(*order)))
    cut = rank.where(F.col("k") == room + 1).first()
    if cut is not None:
        v, f, to = F.col("value"), F.col("from"), F.col("to")
        w = w.where((v > cut["value"]) | ((v == cut["value"]) & ((f < cut["from"]) | ((f == cut["from"]) & (to < cut["to"])))))
    return w.select("from", "to", "value")


def confidence_histogram(facts: DataFrame) -> DataFrame:
    """(bucket, facts) for the fixed edges 0, .5, .6, .7, .8, .9; empty buckets too, nulls in none."""
    names = ["0.0-0.5", "0.5-0.6", "0.6-0.7", "0.7-0.8", "0.8-0.9", "0.9+"]
    c = F.col("confidence")
    b = F.when(c < 0.5, names[0]).when(c < 0.6, names[1]).when(c < 0.7, names[2]).when(c < 0.8, names[3]).when(c < 0.9, names[4]).when(c >= 0.9, names[5])
    got = facts.select(b.alias("bucket")).where("bucket IS NOT NULL").groupBy("bucket").agg(F.count("*").alias("facts"))
    every = facts.sparkSession.createDataFrame([(n,) for n in names], "bucket string")
    return every.join(got, "bucket", "left").select("bucket", F.coalesce("facts", F.lit(0)).cast("bigint").alias("facts"))
