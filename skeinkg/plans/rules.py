"""Rules as data. A schema brings its own; these are the published example set, whose templates name no weights but the first."""

from ..operators.reasoning import Rule

# Relations and entity of the example rules.
EXAMPLES = [
    Rule("codebreaking", (("decrypted", "p", "x"),), ("codebreaking_contribution", "p", "event_world_war_ii"), 0.8),
    Rule("place_of_study", (("studied_at", "p", "o"), ("located_in", "o", "c")), ("associated_with_place", "p", "c"), 0.7),
    Rule("place_of_work", (("worked_at", "p", "o"), ("located_in", "o", "c")), ("associated_with_place", "p", "c"), 0.7),
    Rule("influence_by_teaching", (("supervised", "a", "b"), ("developed", "b", "c")), ("indirect_influence", "a", "c"), 0.7),
    Rule("influence_by_work", (("developed", "p", "c"),), ("indirect_influence", "p", "c"), 0.7),
    Rule("influence_of_influence", (("influenced", "a", "b"), ("influenced", "b", "c")), ("indirect_influence", "a", "c"), 0.7),
]
#: Rules whose facts are all pairs of a class, for ``reasoning.inferred_classes``.
CLASSES = [
    Rule("common_maker", (("developed", "p", "a"), ("developed", "p", "b")), ("shared_affiliation", "a", "b"), 0.6),
    Rule("colleagues_at_work", (("worked_at", "a", "o"), ("worked_at", "b", "o")), ("likely_colleague", "a", "b"), 0.6),
    Rule("colleagues_at_school", (("studied_at", "a", "o"), ("studied_at", "b", "o")), ("likely_colleague", "a", "b"), 0.6),
]
