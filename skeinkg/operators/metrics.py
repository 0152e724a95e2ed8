"""Metrics of a whole run as rows (metric, value)."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import checkpointed
from ..functions.sizes import small_or_shuffled
from .graph import component_ratio, degrees, edges, focused_ids, mention_counts, projection_stats
from .spans import boundary_metrics


def pipeline_metrics(sentences: DataFrame, mentions: DataFrame, facts: DataFrame) -> DataFrame:
    """Counts, NIL rate, mean link score, orphans, conflicting ordered pairs. Ratios of nothing are 0."""
    r = lambda x: F.coalesce(F.round(F.round(x, 9), 4), F.lit(0.0))
    nil = F.coalesce("is_nil", F.lit(False))
    m = mentions.agg(F.count("*").cast("double").alias("mentions"), r(F.avg(nil.cast("double"))).alias("nil_rate"), r(F.avg(F.when(~nil, F.col("link_score")))).alias("average_link_score"), F.count_distinct("linked_entity_id").cast("double").alias("linked_entities"))
    s = sentences.agg(F.count("*").cast("double").alias("sentences"), F.coalesce(F.sum(F.greatest(F.coalesce(F.size("tokens"), F.lit(0)), F.lit(0))), F.lit(0)).cast("double").alias("tokens"))
    t = facts.agg(F.count("*").cast("double").alias("triples"), *[F.count_if(F.col("source") == k).cast("double").alias(f"triples_{k}") for k in ("extracted", "cooccurrence", "inferred")])
    linked = mention_counts(mentions).select("id").join(small_or_shuffled(degrees(facts).select("id", F.lit(1).alias("_t"))), "id", "left")
    o = linked.agg(r(F.avg(F.col("_t").isNull().cast("double"))).alias("orphan_ratio"))
    pairs = facts.groupBy("subject", "object").agg((F.min("relation_id") != F.max("relation_id")).alias("conflict"))
    c = pairs.agg(r(F.avg(F.coalesce("conflict", F.lit(False)).cast("double"))).alias("conflict_pair_ratio"))
    d = degrees(facts).agg(F.count("*").cast("double").alias("triple_nodes"))
    out = None
    for one in (m, s, t, o, c, d):
        rows = one.select(F.explode(F.array(*[F.struct(F.lit(x).alias("metric"), F.col(x).alias("value")) for x in one.columns])).alias("x")).select("x.metric", "x.value")
        out = rows if out is None else out.unionByName(rows)
    return out


def _rows(one: DataFrame, names: dict[str, str]) -> DataFrame:
    """The columns of a single row as rows (metric, value)."""
    return one.select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(c).cast("double").alias("value")) for c, m in names.items()])))


def quality_metrics(sentences: DataFrame, mentions: DataFrame, facts: DataFrame, entities: DataFrame, center: str) -> DataFrame:
    """(metric, value): how well the graph holds together (share of linked and of shown nodes in the centre's component, support of shown edges), how tokens fit mentions, and the sizes of both views. Ratios and means of nothing are 0."""
    r = lambda x: F.coalesce(F.round(F.round(x, 9), 4), F.lit(0.0))
    focus = checkpointed(focused_ids(facts, center))
    ends = small_or_shuffled(focus)
    inside = facts.join(ends.withColumnRenamed("id", "subject"), "subject", "left_semi").join(ends.withColumnRenamed("id", "object"), "object", "left_semi")
    shown = edges(inside).agg(r(F.avg((F.col("value") == 1).cast("double"))).alias("single"), r(F.avg("value")).alias("support"))
    out = _rows(component_ratio(mention_counts(mentions).select("id"), facts, center), {"ratio": "raw_center_component_ratio"})
    out = out.unionByName(_rows(component_ratio(focus, inside, center), {"ratio": "projected_center_component_ratio"}))
    loose = focus.join(degrees(inside), "id", "left").agg(r(F.avg(F.col("degree").isNull().cast("double"))).alias("loose"))
    out = out.unionByName(_rows(loose, {"loose": "projected_orphan_node_ratio"})).unionByName(_rows(shown, {"single": "single_support_edge_ratio", "support": "average_edge_support"}))
    nil = F.coalesce("is_nil", F.lit(False))
    for name, some in (("linked", mentions.where(~nil)), ("gazetteer", mentions.where("source = 'gazetteer'"))):
        out = out.unionByName(_rows(boundary_metrics(sentences, some), {"mentions": f"{name}_token_mentions", "aligned_rate": f"{name}_boundary_alignment_rate", "mean_tokens": f"{name}_fragmentation_mean", "single_rate": f"{name}_single_token_rate"}))
    tokens = sentences.agg(r(F.avg(F.greatest(F.coalesce(F.size("tokens"), F.lit(0)), F.lit(0)))).alias("tokens"))
    out = out.unionByName(_rows(tokens, {"tokens": "average_sentence_tokens"}))
    return out.unionByName(projection_stats(entities, mentions, facts, center).select(F.concat(F.lit("projection_"), "metric").alias("metric"), F.col("value").cast("double").alias("value")))


def conflicting_pairs(facts: DataFrame) -> DataFrame:
    """(pair, relations): ordered pairs with more than one relation, those joined with ``|``."""
    g = facts.where("subject IS NOT NULL AND object IS NOT NULL AND relation_id IS NOT NULL").groupBy("subject", "object").agg(F.array_sort(F.collect_set("relation_id")).alias("r"))
    return g.where("size(r) > 1").select(F.concat("subject", F.lit("->"), "object").alias("pair"), F.array_join("r", "|").alias("relations"))


def run_summary(documents: DataFrame, sentences: DataFrame, mentions: DataFrame, facts: DataFrame) -> DataFrame:
    """(metric, value): how much each stage of a run gave."""
    count = lambda df, names: df.agg(*[F.coalesce(F.count_if(F.expr(c)), F.lit(0)).alias(m) for m, c in names.items()])
    out = None
    for df, names in (
        (documents, {"document_count": "true"}), (sentences, {"sentence_count": "true"}),
        (mentions, {"entity_mention_count": "source IN ('gazetteer', 'crf')", "linked_mention_count": "NOT coalesce(is_nil, false)"}),
        (facts, {"triple_count": "true", "asserted_triple_count": "source = 'extracted'", "inferred_triple_count": "source = 'inferred'"}),
    ):
        rows = _rows(count(df, names), {m: m for m in names})
        out = rows if out is None else out.unionByName(rows)
    return out
