"""The whole run from documents to facts and graph, as lazily planned stages.

With ``discover`` names that the ontology lacks are found in the documents, join it as concepts for the run, and are cleaned up after linking: short names are
merged into longer ones with like contexts, and those that only ever name themselves go. Each stage takes and returns DataFrames; sentences, linked mentions and asserted facts are read more than once and are checkpointed. Any
stage can also start from saved tables (``sources.records.load``)."""

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.lineage import checkpointed
from ..functions.sizes import small_or_shuffled
from ..operators import crf, discovery, graph, hmm, linking, metrics, reasoning, relations, spans, store


@dataclass
class Run:
    entities: DataFrame
    relations: DataFrame
    center: str
    rules: list[reasoning.Rule] = field(default_factory=list)
    parents: dict[str, list[str]] = field(default_factory=dict)
    ends: str = tx.ENDS
    least: int = 6
    cooccurrences: int = 2
    tokenizer: Callable[[Column], Column] = tx.tokens
    methods: tuple[str, ...] = ("gazetteer",)
    discover: bool = False
    stop: DataFrame | None = None
    noise: tuple[str, ...] = ()
    least_confidence: float = 0.45

    def __post_init__(self):
        unknown = set(self.methods) - {"gazetteer", "crf", "hmm", "hmm_buckets"}
        if unknown:
            raise ValueError(f"no method {', '.join(sorted(unknown))}")

    def sentences(self, documents: DataFrame) -> DataFrame:
        """SentenceRecords with tokens; ids ``{document_id}-s00001``."""
        s = tx.sentence_table(documents, "document_id", "text", self.least, self.ends)
        s = s.join(documents.select("document_id", F.col("title").alias("document_title")), "document_id")
        return s.select(F.format_string("%s-s%05d", "document_id", "sentence_index").alias("sentence_id"), "document_id", "document_title", "paragraph_index", "sentence_index", "text", self.tokenizer(F.col("text")).alias("tokens"))

    def mentions(self, sentences: DataFrame, entities: DataFrame | None = None) -> DataFrame:
        """Dictionary mentions, merged with those of the taggers in ``methods`` (``crf``, ``hmm``, ``hmm_buckets``), which are trained on them."""
        g = spans.gazetteer(sentences, self.entities if entities is None else entities).drop("entity_id")
        found = g
        others = [m for m in self.methods if m != "gazetteer"]
        if others:
            g = checkpointed(g)
            found, labels = g, checkpointed(spans.bio_labels(sentences, g))
        for method in others:
            if method == "crf":
                model = crf.fitted(labels)
                tags = crf.decoded(sentences, model) if model else None
            else:
                tags = hmm.decoded(sentences, hmm.fitted(labels)) if method == "hmm" else hmm.decoded_buckets(sentences, hmm.reestimated(hmm.counted(labels), sentences)[0])
            if tags is not None:
                t = spans.bio_spans(tags).join(sentences.select("sentence_id", F.col("text").alias("_t")), "sentence_id")
                found = found.unionByName(t.select(F.format_string(f"%s-{method[0]}{method[-1]}%03d", "sentence_id", "span_no").alias("mention_id"), "sentence_id", "start", "end", F.expr("substring(_t, start + 1, `end` - start)").alias("text"), "entity_type", F.lit(method).alias("source")))
        kept = spans.merged_methods(found).select("mention_id", "merged_no")
        m = found.join(kept, "mention_id").join(sentences.select("sentence_id", "document_id"), "sentence_id")
        return m.select(F.format_string("%s-m%03d", "sentence_id", "merged_no").alias("mention_id"), "sentence_id", "document_id", "text", "start", "end", "entity_type", "source")

    def discovered(self, documents: DataFrame) -> DataFrame:
        """(id, name, entity_type, ...): names that the ontology lacks, in columns of the entity table; others than those that stand often enough outside citations are left out."""
        docs = documents.select(F.col("document_id").alias("doc_id"), tx.normalized(F.col("text")).alias("text")).where("text <> ''")
        words = checkpointed(docs.select("doc_id", F.posexplode(self.tokenizer(F.col("text"))).alias("pos", "t")).select("doc_id", "pos", F.col("t.text").alias("word")))
        stop = self.stop if self.stop is not None else words.select("word").limit(0)
        known = checkpointed(spans.alias_index(self.entities).select(F.lower("alias").alias("name")).distinct())
        parts = discovery.paragraph_table(docs).select(F.concat_ws("#", "doc_id", F.col("paragraph").cast("string")).alias("id"), F.explode(self.tokenizer(F.col("text"))).alias("t")).select("id", F.col("t.text").alias("term"))
        terms = parts.where(F.length("term") >= 2).join(small_or_shuffled(stop.select(F.col("word").alias("term"))), "term", "left_anti")
        scored = discovery.candidates(discovery.word_frequency(words, stop, known), discovery.paragraph_tfidf(terms), discovery.neighbour_boost(words, stop, known))
        new = checkpointed(discovery.discovered(scored, least=self.least_confidence))
        good = discovery.validated(docs, new.select("name"), known, list(self.noise)).where("valid").select("name")
        return new.join(F.broadcast(good), "name", "left_semi")

    def disambiguated(self, linked: DataFrame, sentences: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Linked mentions and entities after discovered fragments were merged and those that only name themselves removed."""
        merges = checkpointed(discovery.fragment_clusters(linked, sentences, entities))
        linked = checkpointed(linking.redirected(linked, merges, entities))
        entities = entities.join(small_or_shuffled(merges.select(F.col("fragment").alias("id"))), "id", "left_anti")
        alone = checkpointed(linking.self_linked(linked, entities.where(F.col("id").startswith("discovered_"))).select("id"))
        return linking.without_removed(linked, alone), entities.join(small_or_shuffled(alone), "id", "left_anti")

    def linked(self, mentions: DataFrame, sentences: DataFrame, entities: DataFrame | None = None) -> DataFrame:
        entities = self.entities if entities is None else entities
        words = lambda c: F.transform(self.tokenizer(c), lambda t: t["text"])
        c = checkpointed(linking.scored_candidates(mentions, sentences, entities, words, self.parents))
        best = c.where("rank <= 5").groupBy("mention_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "entity_id", "alias_score", "context_score", "type_score", "final_score"))), lambda x: F.struct(x["entity_id"].alias("entity_id"), x["alias_score"].alias("alias_score"), x["context_score"].alias("context_score"), x["type_score"].alias("type_score"), F.lit(0.0).alias("pop_score"), x["final_score"].alias("final_score"))).alias("candidates"))
        names = small_or_shuffled(entities.select(F.col("id").alias("linked_entity_id"), F.col("name").alias("linked_entity_name")))
        return mentions.join(linking.linked(mentions, c), "mention_id").join(best, "mention_id", "left").join(names, "linked_entity_id", "left")

    def asserted(self, linked: DataFrame, sentences: DataFrame, entities: DataFrame | None = None) -> DataFrame:
        """Facts by patterns (settled by ordered pair) and by co-occurrence, one row a fact, fragments left out. A type in a relation stands for its children too."""
        entities, typed = self.entities if entities is None else entities, relations.with_child_types(self.relations, self.parents)
        p = relations.pattern_triples(linked, sentences, typed, entities)
        p = p.join(sentences.select("sentence_id", "document_id", F.col("text").alias("evidence")), "sentence_id")
        p = p.select(F.concat_ws(":", "sentence_id", "relation_id", "subject", "object").alias("triple_id"), "sentence_id", "document_id", "relation_id", "subject", "object", "pattern", "confidence", F.lit("extracted").alias("source"), "evidence")
        c = relations.cooccurrence_triples(linked, sentences, typed, entities, self.cooccurrences)
        c = c.select("triple_id", "sentence_id", F.lit("cooccurrence").alias("document_id"), "relation_id", "subject", "object", F.concat(F.lit("cooccur+trigger("), "pattern", F.lit(","), F.col("matched").cast("string"), F.lit(")")).alias("pattern"), "confidence", F.lit("cooccurrence").alias("source"), "evidence")
        best = relations.best_per_fact(relations.settled_ordered(p).unionByName(c))
        clean = relations.fragment_ends(best, entities).where("NOT is_fragment").drop("is_fragment")
        return self._named(clean.withColumn("support_triple_ids", F.array().cast("array<string>")), entities)

    def _named(self, f: DataFrame, entities: DataFrame) -> DataFrame:
        n = small_or_shuffled(entities.select("id", "name"))
        labels = small_or_shuffled(self.relations.select(F.col("id").alias("relation_id"), F.col("label").alias("relation_label")))
        f = f.join(n.withColumnsRenamed({"id": "subject", "name": "subject_name"}), "subject", "left").join(n.withColumnsRenamed({"id": "object", "name": "object_name"}), "object", "left").join(labels, "relation_id", "left")
        return f.withColumn("relation_label", F.coalesce("relation_label", "relation_id"))

    def facts(self, asserted: DataFrame, entities: DataFrame | None = None) -> DataFrame:
        """Asserted facts, settled by unordered pair, with those the rules derive."""
        entities = self.entities if entities is None else entities
        kept = relations.settled_unordered(asserted)
        if not self.rules:
            return kept
        i = reasoning.inferred(kept, self.rules, entities)
        note = F.concat(F.array_join(F.slice("support_ids", 1, 4), "; "), F.when(F.col("supports") > 4, F.concat(F.lit("; "), F.col("supports").cast("string"), F.lit(" in all"))).otherwise(""))
        i = i.select("triple_id", F.lit(None).cast("string").alias("sentence_id"), F.lit("reasoning").alias("document_id"), "relation_id", "subject", "object", F.lit("rule").alias("pattern"), "confidence", F.lit("inferred").alias("source"), note.alias("evidence"), F.col("support_ids").alias("support_triple_ids"))
        return kept.unionByName(self._named(i, entities))

    def __call__(self, documents: DataFrame) -> dict[str, DataFrame]:
        """All tables of a run."""
        s, entities = checkpointed(self.sentences(documents)), self.entities
        if self.discover:
            entities = checkpointed(discovery.extended(entities, self.discovered(documents)))
        m = checkpointed(self.linked(checkpointed(self.mentions(s, entities)), s, entities))
        if self.discover:
            m, entities = self.disambiguated(m, s, entities)
            m, entities = checkpointed(m), checkpointed(entities)
        f = checkpointed(self.facts(checkpointed(self.asserted(m, s, entities)), entities))
        ids = checkpointed(graph.focused_ids(f, self.center))
        return {
            "entities": entities, "sentences": s, "mentions": m, "facts": f, "edges": graph.edges(f), "nodes": graph.nodes(graph.node_ids(m, f), entities, m, f), "focused_nodes": graph.nodes(ids, entities, m, f),
            "entity_rows": store.entity_rows(entities, m, f), "relation_rows": store.relation_rows(self.relations, f), "metrics": metrics.pipeline_metrics(s, m, f), "quality": metrics.quality_metrics(s, m, f, entities, self.center),
            "summary": metrics.run_summary(documents, s, m, f),
        }
