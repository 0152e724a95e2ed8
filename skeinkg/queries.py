"""Registered queries of the core operators over the domain tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as tx
from .functions.lineage import checkpointed, scratch
from .operators import crf, discovery, graph, hmm, linking, maxent, metrics, nested, reasoning, relations, spans, store, tfidf
from .operators.reasoning import Rule
from .sources import domain, records
from .sources.tables import table

CENTER = "person_irene_serrvitz"
#: Example rules of each kind: one body, two bodies, two bodies over one relation, transitive.
RULES = {
    "rule_single": [Rule("visited", (("attended", "p", "e"),), ("took_part_in", "p", "e"), 0.8)],
    "rule_join": [Rule("works_in", (("employed_at", "p", "o"), ("seated_in", "o", "c")), ("works_in", "p", "c"), 0.7)],
    "rule_self_join": [Rule("colleagues", (("employed_at", "p", "o"), ("employed_at", "q", "o")), ("colleague_of", "p", "q"), 0.6)],
    "rule_transitive": [Rule("reaches", (("corresponded_with", "a", "b"), ("corresponded_with", "b", "c")), ("linked_with", "a", "c"), 0.5)],
}
# Short English words that are no names.
NOISE = [
    "the", "see", "for", "and", "was", "his", "had", "not", "but", "are", "has", "can", "its", "new", "one", "two",
    "of", "in", "to", "it", "is", "on", "at", "by", "or", "be", "as", "we", "an", "if", "my", "so", "up", "no",
]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    """Registers a query; integers come out as bigint, so they compare with any SQL."""

    @wraps(f)
    def run(spark: SparkSession, d: str) -> DataFrame:
        df = f(spark, d)
        return df.select(*[F.col(f"`{c}`").cast("bigint").alias(c) if t in ("int", "smallint", "tinyint") else F.col(f"`{c}`") for c, t in df.dtypes])

    QUERIES[f.__name__] = run
    return run


def facts(spark: SparkSession, d: str) -> DataFrame:
    return domain.triples(spark, d).withColumnsRenamed({"subject_entity_id": "subject", "object_entity_id": "object", "evidence_sentence": "evidence"})


def linked(spark: SparkSession, d: str) -> DataFrame:
    return domain.mentions(spark, d)


def sentence_words(spark: SparkSession, d: str) -> DataFrame:
    s = domain.sentences(spark, d)
    return s.select(F.col("sentence_id").alias("doc_id"), F.posexplode("tokens").alias("pos", "t")).select("doc_id", "pos", F.col("t.text").alias("word")).where("word IS NOT NULL")


def stop_words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "common_words").select("word").where("word IS NOT NULL").distinct()


def known_names(spark: SparkSession, d: str) -> DataFrame:
    return spans.alias_index(domain.entities(spark, d)).select(F.lower("alias").alias("name")).distinct()


# ---------------------------------------------------------------- text
@query
def normalize_documents(spark, d):
    return domain.documents(spark, d).select("doc_id", tx.normalized(F.col("text")).alias("text"))


@query
def split_sentences(spark, d):
    return tx.sentence_table(domain.documents(spark, d))


@query
def slug_titles(spark, d):
    return domain.documents(spark, d).select("doc_id", tx.slug(F.col("title")).alias("slug"), tx.zh_or_en(F.coalesce("title", F.lit(""))).alias("zh_or_en"))


@query
def tokenize_offsets(spark, d):
    return tx.token_table(domain.sentences(spark, d).where("text IS NOT NULL"), "sentence_id")


@query
def token_features(spark, d):
    return tx.token_features(domain.sentences(spark, d), "sentence_id").where("token IS NOT NULL")


@query
def feature_buckets(spark, d):
    words = sentence_words(spark, d)
    return words.select(tx.feature_bucket(F.col("word")).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("tokens"))


@query
def mention_contexts(spark, d):
    m = domain.mentions(spark, d).select("mention_id", "sentence_id", "start", "end").join(domain.sentences(spark, d).select("sentence_id", F.col("text").alias("t")), "sentence_id")
    return m.where("t IS NOT NULL AND start IS NOT NULL AND `end` IS NOT NULL").select("mention_id", tx.context(F.col("t"), F.col("start"), F.col("end"), 30).alias("context"))


@query
def text_chunks(spark, d):
    c = domain.documents(spark, d).select("doc_id", F.posexplode(tx.chunks(F.col("text"), 5000)).alias("chunk_no", "chunk"))
    return c.select("doc_id", "chunk_no", F.length("chunk").alias("chars"), F.md5("chunk").alias("digest"))


# ---------------------------------------------------------------- spans
@query
def alias_index(spark, d):
    return spans.alias_index(domain.entities(spark, d))


@query
def gazetteer_candidates(spark, d):
    f = spans.occurrences(domain.sentences(spark, d), spans.alias_index(domain.entities(spark, d)))
    return f.select("sentence_id", "start", "end", "text", "entity_id", "entity_type")


@query
def gazetteer_mentions(spark, d):
    return spans.gazetteer(domain.sentences(spark, d), domain.entities(spark, d)).drop("source")


@query
def merge_mentions(spark, d):
    return spans.merged_methods(domain.mentions(spark, d))


@query
def bio_labels(spark, d):
    return spans.bio_labels(domain.sentences(spark, d), domain.mentions(spark, d)).where("token IS NOT NULL")


@query
def bio_decode(spark, d):
    return spans.bio_spans(spans.bio_labels(domain.sentences(spark, d), domain.mentions(spark, d)))


@query
def ner_method_stats(spark, d):
    return spans.method_counts(domain.mentions(spark, d))


@query
def ner_overlap_matrix(spark, d):
    return spans.method_overlap(domain.mentions(spark, d))


@query
def boundary_metrics(spark, d):
    return spans.boundary_metrics(domain.sentences(spark, d), domain.mentions(spark, d).where("linked_entity_id IS NOT NULL"))


# ---------------------------------------------------------------- TF-IDF and linking
def _document_terms(spark, d):
    s = domain.sentences(spark, d).select(F.col("document_id").alias("id"), F.explode("tokens").alias("t"))
    return s.select("id", F.lower("t.text").alias("term")).where("term IS NOT NULL")


@query
def tfidf_terms(spark, d):
    w, _ = tfidf.fitted(_document_terms(spark, d))
    return w.select("id", "term", F.round("weight", 6).alias("weight"))


@query
def tfidf_top_terms(spark, d):
    words = sentence_words(spark, d).where(F.length("word") >= 2).join(stop_words(spark, d), "word", "left_anti")
    return discovery.paragraph_tfidf(words.select(F.col("doc_id").alias("id"), F.col("word").alias("term"))).select("word", F.round("score", 6).alias("score"))


def _keys(spark, d):
    return domain.mentions(spark, d).select(F.lower(tx.stripped(F.col("text"))).alias("key")).where("key <> ''").distinct()


@query
def alias_cosine_top15(spark, d):
    s = linking.similar_aliases(_keys(spark, d), checkpointed(spans.alias_index(domain.entities(spark, d))))
    return s.select("key", "alias_rank", "entity_id", F.round("cosine", 6).alias("cosine"))


def _words(c):
    return F.filter(F.regexp_extract_all(c, F.lit(f"({tx.WORD})"), F.lit(1)), lambda w: ~w.rlike(r"^\s"))


@query
def link_mentions(spark, d):
    m = domain.mentions(spark, d)
    return linking.linked(m, checkpointed(linking.scored_candidates(m, domain.sentences(spark, d), domain.entities(spark, d), _words)))


@query
def self_link_removal(spark, d):
    return linking.self_linked(domain.mentions(spark, d), domain.entities(spark, d))


# ---------------------------------------------------------------- relations
@query
def trigger_matches(spark, d):
    return relations.trigger_matches(domain.sentences(spark, d), domain.relations(spark, d))


@query
def pattern_triples(spark, d):
    return relations.pattern_triples(linked(spark, d), domain.sentences(spark, d), domain.relations(spark, d), domain.entities(spark, d), digits=6)


@query
def cooccurrence_pairs(spark, d):
    return relations.cooccurring_pairs(linked(spark, d), 2)


@query
def cooccurrence_triples(spark, d):
    return relations.cooccurrence_triples(linked(spark, d), domain.sentences(spark, d), domain.relations(spark, d), domain.entities(spark, d), 2)


SHORT = ("triple_id", "subject", "relation_id", "object", "confidence", "source")


@query
def triple_argmax(spark, d):
    return relations.best_per_fact(facts(spark, d).select(*SHORT))


@query
def relation_conflicts(spark, d):
    return relations.settled_ordered(facts(spark, d).select(*SHORT))


@query
def pair_conflicts(spark, d):
    return relations.settled_unordered(facts(spark, d).select(*SHORT))


@query
def fragment_filter(spark, d):
    return relations.fragment_ends(facts(spark, d).select("triple_id", "subject", "object"), domain.entities(spark, d), "concept_", 3)


# ---------------------------------------------------------------- reasoning
def _rule(name):
    def run(spark, d):
        asserted = facts(spark, d).where("source <> 'inferred'")
        return reasoning.inferred(asserted, RULES[name]).select("relation_id", "subject", "object", "confidence", F.array_join("support_ids", "|").alias("support_ids"), "supports")

    run.__name__ = name
    return query(run)


for _name in RULES:
    if _name != "rule_self_join":
        _rule(_name)


@query
def rule_self_join(spark, d):
    """All pairs of a class would square a hot one, so the classes come out."""
    return reasoning.inferred_classes(facts(spark, d).where("source <> 'inferred'"), RULES["rule_self_join"][0])


# ---------------------------------------------------------------- graph
@query
def edge_aggregate(spark, d):
    return graph.edges(facts(spark, d), digits=6)


@query
def center_component(spark, d):
    f = facts(spark, d)
    return graph.component(graph.degrees(f).select("id"), f, CENTER)


@query
def component_ratio(spark, d):
    f = facts(spark, d)
    return graph.component_ratio(graph.node_ids(linked(spark, d), f), f, CENTER)


@query
def graph_nodes_full(spark, d):
    f, m = facts(spark, d), linked(spark, d)
    return graph.nodes(graph.node_ids(m, f), domain.entities(spark, d), m, f)


@query
def graph_nodes_focused(spark, d):
    f = facts(spark, d)
    return graph.nodes(graph.focused_ids(f, CENTER), domain.entities(spark, d), linked(spark, d), f)


@query
def projection_stats(spark, d):
    return graph.projection_stats(domain.entities(spark, d), linked(spark, d), facts(spark, d), CENTER)


@query
def node_search(spark, d):
    f, m = facts(spark, d), linked(spark, d)
    return graph.found_nodes(graph.nodes(graph.node_ids(m, f), domain.entities(spark, d), m, f), "irene")


@query
def budgeted_graph(spark, d):
    pairs = facts(spark, d).select(F.col("subject").alias("from"), F.col("object").alias("to"))
    return graph.budgeted(pairs, [CENTER], 50)


@query
def confidence_histogram(spark, d):
    return graph.confidence_histogram(facts(spark, d))


# ---------------------------------------------------------------- store and metrics
@query
def entity_rows(spark, d):
    return store.entity_rows(domain.entities(spark, d), linked(spark, d), facts(spark, d))


@query
def relation_rows(spark, d):
    return store.relation_rows(domain.relations(spark, d), facts(spark, d))


@query
def fact_rows(spark, d):
    return store.fact_rows(facts(spark, d))


@query
def rdf_lines(spark, d):
    return store.rdf_lines(facts(spark, d))


@query
def center_neighborhood(spark, d):
    return store.center_neighborhood(facts(spark, d), CENTER)


@query
def relation_distribution(spark, d):
    return store.relation_distribution(facts(spark, d))


@query
def inferred_facts(spark, d):
    return store.inferred_facts(facts(spark, d))


@query
def evidence_samples(spark, d):
    return store.evidence_samples(facts(spark, d))


@query
def pipeline_metrics(spark, d):
    return metrics.pipeline_metrics(domain.sentences(spark, d), linked(spark, d), facts(spark, d))


@query
def quality_metrics(spark, d):
    return metrics.quality_metrics(domain.sentences(spark, d), linked(spark, d), facts(spark, d), domain.entities(spark, d), CENTER)


@query
def conflicting_pairs(spark, d):
    return metrics.conflicting_pairs(facts(spark, d))


@query
def run_summary(spark, d):
    return metrics.run_summary(domain.documents(spark, d), domain.sentences(spark, d), linked(spark, d), facts(spark, d))


@query
def graph_tables(spark, d):
    """Nodes and edges of the budgeted graph as one table of labelled rows."""
    e = checkpointed(graph.budgeted(facts(spark, d).select(F.col("subject").alias("from"), F.col("object").alias("to")), [CENTER], 50))
    n = graph.connected_nodes(e, domain.entities(spark, d))
    return n.select(F.lit("node").alias("kind"), "id", "label", F.lit(None).cast("string").alias("to"), F.lit(None).cast("bigint").alias("value")).unionByName(e.select(F.lit("edge").alias("kind"), F.col("from").alias("id"), F.lit(None).cast("string").alias("label"), "to", "value"))


@query
def node_neighborhood(spark, d):
    f, m = facts(spark, d), linked(spark, d)
    n = graph.nodes(graph.node_ids(m, f), domain.entities(spark, d), m, f)
    return graph.highlighted(n, f, "irene")


# ---------------------------------------------------------------- discovery
@query
def word_freq(spark, d):
    return discovery.word_frequency(sentence_words(spark, d), stop_words(spark, d), known_names(spark, d))


@query
def neighbour_boost(spark, d):
    return discovery.neighbour_boost(sentence_words(spark, d), stop_words(spark, d), known_names(spark, d))


@query
def context_windows(spark, d):
    return discovery.context_windows(sentence_words(spark, d))


def _candidates(spark, d):
    w, s, k = sentence_words(spark, d), stop_words(spark, d), known_names(spark, d)
    terms = w.where(F.length("word") >= 2).join(s, "word", "left_anti").select(F.col("doc_id").alias("id"), F.col("word").alias("term"))
    return discovery.candidates(discovery.word_frequency(w, s, k), discovery.paragraph_tfidf(terms), discovery.neighbour_boost(w, s, k))


@query
def discover_candidates(spark, d):
    return _candidates(spark, d)


@query
def validate_candidates(spark, d):
    names = checkpointed(discovery.discovered(_candidates(spark, d), least=0.2).select("name"))
    return discovery.validated(domain.documents(spark, d), names, known_names(spark, d), NOISE)


@query
def fragment_clusters(spark, d):
    return discovery.fragment_clusters(linked(spark, d), domain.sentences(spark, d), domain.entities(spark, d), 0.05, "place_", 40, 6).select("fragment", "canonical", F.round("similarity", 6).alias("similarity"))


# ---------------------------------------------------------------- files, written and read again
@query
def jsonl_sentences(spark, d):
    path = scratch(spark, "sentences")
    store.write_jsonl(domain.sentences(spark, d).drop("loaded_at"), path)
    s = records.load(spark, path, "sentence", strict=False)
    return s.select("sentence_id", "document_id", "paragraph_index", "sentence_index", "text", F.size("tokens").alias("tokens"))


@query
def exported_facts(spark, d):
    path = scratch(spark, "export")
    store.export(path, domain.entities(spark, d), domain.relations(spark, d), linked(spark, d), facts(spark, d), CENTER)
    t = spark.read.option("sep", "\t").option("header", True).option("multiLine", True).csv(f"{path}/facts.tsv")
    return t.select("triple_id", "subject_id", "relation_id", "object_id", F.col("confidence").cast("double").alias("confidence"), "source")


@query
def exported_lines(spark, d):
    path = scratch(spark, "export")
    f = facts(spark, d)
    store.rdf_lines(f).write.text(path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query
def document_texts(spark, d):
    path = scratch(spark, "texts")
    store.write_texts(domain.documents(spark, d).withColumn("doc_id", F.col("doc_id").cast("string")), path, "doc_id")
    return store.read_texts(spark, path).select(F.col("key").cast("bigint").alias("doc_id"), F.length("text").alias("chars"), F.md5("text").alias("digest"))


# ---------------------------------------------------------------- sequence model
def _labels(spark, d):
    return spans.bio_labels(domain.sentences(spark, d), domain.mentions(spark, d)).where("token IS NOT NULL")


@query
def hmm_init(spark, d):
    return hmm.start_counts(_labels(spark, d))


@query
def hmm_transition(spark, d):
    return hmm.transition_counts(_labels(spark, d))


@query
def hmm_emission(spark, d):
    return hmm.emission_counts(_labels(spark, d))


@query
def hmm_viterbi(spark, d):
    tagged = hmm.decoded(domain.sentences(spark, d), hmm.fitted(checkpointed(_labels(spark, d))))
    return spans.bio_spans(tagged)


@query
def hmm_buckets(spark, d):
    s, labels = domain.sentences(spark, d), checkpointed(_labels(spark, d))
    model, _ = hmm.reestimated(hmm.counted(labels), s, rounds=2)
    return spans.bio_spans(hmm.decoded_buckets(s, model))


@query
def crf_report(spark, d):
    """Precision and recall by label over the fifth of the sentences that the model was not trained on."""
    s, labels = domain.sentences(spark, d), checkpointed(_labels(spark, d))
    model = crf.fitted(labels)
    held = labels.where(F.pmod(F.xxhash64("sentence_id"), F.lit(5)) == 0)
    if model is None:
        return maxent.report(labels.limit(0).select("label", F.col("label").alias("predicted")))
    tagged = crf.decoded(s.where(F.pmod(F.xxhash64("sentence_id"), F.lit(5)) == 0), model)
    return maxent.report(held.join(tagged.select("sentence_id", "token_index", F.col("label").alias("predicted")), ["sentence_id", "token_index"]).select("label", "predicted"))


@query
def maxent_report(spark, d):
    s, labels = domain.sentences(spark, d), checkpointed(_labels(spark, d))
    fit = maxent.fitted(s, labels)
    if fit is None:
        return maxent.report(labels.limit(0).select("label", F.col("label").alias("predicted")))
    held = labels.where(F.pmod(F.xxhash64("sentence_id"), F.lit(5)) == 0)
    return maxent.report(held.join(maxent.tagged(s, *fit), ["sentence_id", "token_index"]).select("label", "predicted"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.p2_found(spark, d)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p2_found": p2_found} | QUERIES
