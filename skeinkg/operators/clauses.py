"""Relations from subject-verb-object clauses of any parser: the parser is a plug-in, the mapping to relations is a join."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sizes import small_or_shuffled


def clause_triples(clauses: DataFrame, verbs: DataFrame, mentions: DataFrame, entities: DataFrame, relations: DataFrame, confidence: float = 0.85) -> DataFrame:
    """(triple_id, sentence_id, relation_id, subject, object, confidence, source) from clauses (sentence_id, s_start, s_end, verb, o_start, o_end) and verbs (verb, relation_id).

    The ends of a clause are the linked mentions their spans overlap; both must have types that the relation takes. First clause by position for each fact of a sentence. Null verbs or spans match nothing."""
    m = mentions.where("linked_entity_id IS NOT NULL AND NOT coalesce(is_nil, false)").select("sentence_id", "start", "end", F.col("linked_entity_id").alias("e"))
    kinds = small_or_shuffled(entities.select(F.col("id").alias("e"), "entity_type"))
    m = m.join(kinds, "e")
    c = clauses.join(small_or_shuffled(verbs.select("verb", "relation_id")), "verb")

    def end(p: str) -> DataFrame:
        x = m.select("sentence_id", F.col("start").alias(f"{p}_from"), F.col("end").alias(f"{p}_to"), F.col("e").alias(f"{p}_id"), F.col("entity_type").alias(f"{p}_type"))
        return x

    j = c.join(end("s"), "sentence_id").where("s_from < s_end AND s_to > s_start").join(end("o"), "sentence_id").where("o_from < o_end AND o_to > o_start AND s_id <> o_id")
    r = small_or_shuffled(relations.select(F.col("id").alias("relation_id"), "subject_types", "object_types"))
    j = j.join(r, "relation_id").where(F.array_contains("subject_types", F.col("s_type")) & F.array_contains("object_types", F.col("o_type")))
    g = j.groupBy("sentence_id", "relation_id", F.col("s_id").alias("subject"), F.col("o_id").alias("object")).agg(F.min("s_start").alias("at"))
    return g.select(F.concat_ws(":", F.lit("svo"), "sentence_id", "relation_id", "subject", "object").alias("triple_id"), "sentence_id", "relation_id", "subject", "object", F.lit(confidence).alias("confidence"), F.lit("dependency_path").alias("source"))
