"""Fixed schemas of the pipeline's tables."""

from pyspark.sql.types import StructType

TOKEN = "struct<text: string, start: int, end: int>"
CANDIDATE = "struct<entity_id: string, entity_name: string, entity_type: string, alias_score: double, context_score: double, type_score: double, pop_score: double, final_score: double>"
DDL = {
    "document": "document_id string, title string, source_path string, format string, text string",
    "sentence": f"sentence_id string, document_id string, document_title string, paragraph_index int, sentence_index int, text string, tokens array<{TOKEN}>",
    "mention": f"mention_id string, sentence_id string, document_id string, text string, start int, end int, entity_type string, source string, candidates array<{CANDIDATE}>, linked_entity_id string, linked_entity_name string, link_score double, is_nil boolean",
    "triple": "triple_id string, sentence_id string, document_id string, relation_id string, relation_label string, subject_entity_id string, subject_name string, object_entity_id string, object_name string, evidence_sentence string, rule_pattern string, confidence double, source string, support_triple_ids array<string>",
    "entity": "id string, name string, aliases array<string>, entity_type string, description string, tags array<string>, attributes map<string, string>",
    "relation": "id string, label string, subject_types array<string>, object_types array<string>, patterns array<string>, subject_direction string, object_direction string, subject_tags array<string>, object_tags array<string>, negative_patterns array<string>, max_distance int, symmetric boolean",
}
#: Columns that a record must have; the others get defaults.
REQUIRED = {
    "document": ("document_id", "title", "source_path", "format", "text"),
    "sentence": ("sentence_id", "document_id", "text"),
    "mention": ("mention_id", "sentence_id", "document_id", "text", "start", "end", "entity_type", "source"),
    "triple": ("triple_id", "relation_id", "subject_entity_id", "object_entity_id", "confidence"),
    "entity": ("id", "name", "entity_type"),
    "relation": ("id", "label"),
}
DEFAULTS = {
    "mention": {"link_score": "0.0D", "is_nil": "false", "candidates": f"cast(array() AS array<{CANDIDATE}>)"},
    "sentence": {"tokens": f"cast(array() AS array<{TOKEN}>)"},
    "triple": {"source": "'extracted'", "support_triple_ids": "cast(array() AS array<string>)"},
    "entity": {"aliases": "cast(array() AS array<string>)", "tags": "cast(array() AS array<string>)", "attributes": "cast(map() AS map<string, string>)"},
    "relation": {c: "cast(array() AS array<string>)" for c in ("subject_types", "object_types", "patterns", "subject_tags", "object_tags", "negative_patterns")}
    | {"subject_direction": "'before'", "object_direction": "'after'", "max_distance": "80", "symmetric": "false"},
}


def schema(kind: str) -> StructType:
    return StructType.fromDDL(DDL[kind])
