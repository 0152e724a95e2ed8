"""Relations from trigger words and from co-occurrence, and the rules that settle conflicts.

Defined results: relations without patterns or types match nothing, empty tag lists let everything pass, mentions without a link take no part, ties are broken by scores and positions, then by ids."""

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sizes import small_or_shuffled
from .spans import positions


#: Patterns that a schema may have; more are refused.
PATTERNS = 10_000


def _plain(pattern: str) -> bool:
    """A pattern without special characters, no end of which is its start again, so that its matches can't overlap."""
    return not re.search(r"[\\.\[\](){}*+?^$|]", pattern) and not any(pattern.startswith(pattern[k:]) for k in range(1, len(pattern)))


def trigger_matches(sentences: DataFrame, relations: DataFrame) -> DataFrame:
    """(sentence_id, relation_id, pattern, t_start, t_end) of every match of every pattern, a case-sensitive regular expression; matches of one pattern don't overlap, empty ones don't count.

    Plain words are found by a join of positions and first characters; what is left, by the lengths of the matches and of what lies between them."""
    flat = relations.select(F.col("id").alias("relation_id"), F.explode("patterns").alias("pattern")).where(F.length("pattern") > 0).distinct()
    rows = flat.limit(PATTERNS + 1).collect()
    if len(rows) > PATTERNS:
        raise ValueError(f"more than {PATTERNS} patterns")
    plain = sorted({(r["relation_id"], r["pattern"]) for r in rows if _plain(r["pattern"])}, key=str)
    texts = sentences.where(F.length("text") > 0)
    p = sentences.sparkSession.createDataFrame([(r, x, len(x), x[0]) for r, x in plain], "relation_id string, pattern string, _n int, _lead string")
    longest = max((len(x) for _, x in plain), default=1)
    at = positions(texts, "sentence_id", "text", longest).withColumn("_lead", F.expr("substring(_s, _p, 1)"))
    found = at.join(F.broadcast(p), "_lead").where("substring(_s, _p, _n) = pattern")
    out = found.select("sentence_id", "relation_id", "pattern", F.col("_at").alias("t_start"), (F.col("_at") + F.col("_n")).alias("t_end"))
    by: dict[str, list[str]] = {}
    for r in rows:
        if not _plain(r["pattern"]):
            by.setdefault(r["pattern"], []).append(r["relation_id"])
    if by:
        each = [F.when(F.col("text").rlike(x), _named(_places(F.col("text"), x), x)) for x in sorted(by)]
        hits = texts.select("sentence_id", F.explode(F.flatten(F.filter(F.array(*each), lambda x: x.isNotNull()))).alias("m")).where("m.a < m.b")
        names = sentences.sparkSession.createDataFrame([(x, r) for x, rs in by.items() for r in rs], "pattern string, relation_id string")
        out = out.unionByName(hits.select("sentence_id", "m.pattern", F.col("m.a").alias("t_start"), F.col("m.b").alias("t_end")).join(F.broadcast(names), "pattern"))
    return out


def _named(places: Column, pattern: str) -> Column:
    return F.transform(places, lambda m: F.struct(F.lit(pattern).alias("pattern"), m["a"].alias("a"), m["b"].alias("b")))


def _places(text: Column, pattern: str) -> Column:
    """array<struct<a, b>>: where the matches of a pattern start and end."""
    between, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<a:int,b:int>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        a = s["at"] + F.length(x["between"])
        b = a + F.length(x["matches"])
        return F.struct(b.alias("at"), F.concat(s["out"], F.array(F.struct(a.alias("a"), b.alias("b")))).alias("out"))

    return F.aggregate(F.arrays_zip(F.slice(between, 1, F.size(matches)).alias("between"), matches.alias("matches")), state, step, lambda s: s["out"])


def with_child_types(relations: DataFrame, parents: dict[str, list[str]]) -> DataFrame:
    """``relations`` whose subject and object types also name the children of each type, ``parents`` being {type: children}."""
    for c in ("subject_types", "object_types"):
        wide = F.col(c)
        for parent, children in parents.items():
            wide = F.when(F.array_contains(c, parent), F.array_union(wide, F.array(*map(F.lit, children)))).otherwise(wide) if children else wide
        relations = relations.withColumn(c, wide)
    return relations


def gap(direction: Column, start: Column, end: Column, t_start: Column, t_end: Column) -> Column:
    """Characters between a mention and a trigger on the side that ``direction`` names; null on the wrong side, 0 for overlap with either side."""
    before, after = F.when(end <= t_start, t_start - end), F.when(start >= t_end, start - t_end)
    return F.when(direction == "before", before).when(direction == "after", after).otherwise(F.coalesce(before, after, F.lit(0)))


def _roles(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    tags = small_or_shuffled(entities.select(F.col("id").alias("entity_id"), F.col("name").alias("entity_name"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags")))
    m = mentions.where("NOT coalesce(is_nil, false) AND linked_entity_id IS NOT NULL").select("sentence_id", "mention_id", "start", "end", "entity_type", F.coalesce("link_score", F.lit(0.0)).alias("link_score"), F.col("linked_entity_id").alias("entity_id"))
    return m.join(tags, "entity_id")


def _passes(required: str) -> Column:
    return F.coalesce((F.size(required) <= 0) | F.arrays_overlap("tags", required), F.lit(True))


def pattern_triples(mentions: DataFrame, sentences: DataFrame, relations: DataFrame, entities: DataFrame, digits: int = 4) -> DataFrame:
    """(sentence_id, relation_id, subject, object, pattern, confidence): for each trigger the first pair of a subject and an object that fit; first of equal ones in a sentence."""
    r = small_or_shuffled(relations.select(F.col("id").alias("relation_id"), "subject_types", "object_types", "subject_direction", "object_direction", "subject_tags", "object_tags", "negative_patterns", "max_distance", F.coalesce("symmetric", F.lit(False)).alias("symmetric")))
    t = trigger_matches(sentences, relations).join(r, "relation_id")
    m = _roles(mentions, entities)
    key = ["sentence_id", "relation_id", "pattern", "t_start", "t_end"]

    def candidates(role: str) -> DataFrame:
        j = t.join(m, "sentence_id").where(F.array_contains(f"{role}_types", F.col("entity_type")) & _passes(f"{role}_tags"))
        j = j.withColumn("gap", gap(F.col(f"{role}_direction"), F.col("start"), F.col("end"), F.col("t_start"), F.col("t_end"))).where("gap IS NOT NULL AND gap <= max_distance")
        by = Window.partitionBy(*key).orderBy("gap", F.desc("link_score"), "start", "mention_id")
        p = role[0]
        return j.select(*key, "symmetric", "negative_patterns", F.row_number().over(by).alias(f"{p}_rank"), F.col("entity_id").alias(f"{p}_id"), F.col("link_score").alias(f"{p}_score"), F.col("start").alias(f"{p}_start"), F.col("end").alias(f"{p}_end"))

    s, o = candidates("subject"), candidates("object")
    directed = s.where("NOT symmetric").join(o.drop("symmetric", "negative_patterns"), key).where("s_id <> o_id")
    text = sentences.select("sentence_id", "text")
    a, b = F.least("t_start", "o_start"), F.greatest("t_end", "o_end")
    directed = directed.join(text, "sentence_id").withColumn("between", F.substring("text", a + 1, b - a))
    directed = directed.where(~F.coalesce(F.exists("negative_patterns", lambda p: F.regexp_like("between", p)), F.lit(False)))
    right = s.where("symmetric").select(*key, F.col("s_rank").alias("o_rank"), F.col("s_id").alias("o_id"), F.col("s_score").alias("o_score"))
    both = s.where("symmetric").join(right, key).where("s_rank < o_rank AND s_id <> o_id")
    cols = [*key, "s_rank", "o_rank", "s_id", "o_id", "s_score", "o_score"]
    pairs = directed.select(*cols, F.lit(False).alias("symmetric")).unionByName(both.select(*cols, F.lit(True).alias("symmetric")))
    first = pairs.withColumn("rn", F.row_number().over(Window.partitionBy(*key).orderBy("s_rank", "o_rank"))).where("rn = 1")
    swap = F.col("symmetric") & (F.col("s_id") > F.col("o_id"))
    made = first.select(*key, F.when(swap, F.col("o_id")).otherwise(F.col("s_id")).alias("subject"), F.when(swap, F.col("s_id")).otherwise(F.col("o_id")).alias("object"), F.round((F.col("s_score") + F.col("o_score")) / 2, digits).alias("confidence"))
    once = Window.partitionBy("sentence_id", "relation_id", "subject", "object").orderBy("t_start", "t_end", "pattern")
    return made.withColumn("rn", F.row_number().over(once)).where("rn = 1").select("sentence_id", "relation_id", "subject", "object", "pattern", "confidence")


def settled_ordered(triples: DataFrame) -> DataFrame:
    """Where one ordered pair has several relations, only the best row stays (confidence, then relation); pairs with one relation keep all rows. Columns subject, object, relation_id, confidence, triple_id."""
    pair = Window.partitionBy("subject", "object")
    d = triples.withColumn("_many", F.min("relation_id").over(pair) != F.max("relation_id").over(pair)).withColumn("_rn", F.row_number().over(pair.orderBy(F.desc("confidence"), "relation_id", "triple_id")))
    return d.where("NOT _many OR _rn = 1").drop("_many", "_rn")


def best_per_fact(triples: DataFrame) -> DataFrame:
    """One row for each (subject, relation, object): greatest confidence, then least triple_id."""
    by = Window.partitionBy("subject", "relation_id", "object").orderBy(F.desc("confidence"), "triple_id")
    return triples.withColumn("_rn", F.row_number().over(by)).where("_rn = 1").drop("_rn")


def source_rank(source: Column) -> Column:
    return F.when(source == "extracted", 3).when(source == "dependency_path", 2).when(source == "cooccurrence", 1).otherwise(0)


def settled_unordered(triples: DataFrame) -> DataFrame:
    """Where an unordered pair has several relations, only the best row stays (source rank, confidence, then triple_id)."""
    pair = Window.partitionBy(F.least("subject", "object"), F.greatest("subject", "object"))
    d = triples.withColumn("_many", F.min("relation_id").over(pair) != F.max("relation_id").over(pair)).withColumn("_rn", F.row_number().over(pair.orderBy(source_rank(F.col("source")).desc(), F.desc("confidence"), "triple_id")))
    return d.where("NOT _many OR _rn = 1").drop("_many", "_rn")


def cooccurring_pairs(mentions: DataFrame, least: int = 3) -> DataFrame:
    """(a, b, sentences): entity pairs a < b named in at least ``least`` common sentences. Pairs are made inside each sentence's own list, so nothing is joined."""
    per = mentions.where("NOT coalesce(is_nil, false) AND linked_entity_id IS NOT NULL AND sentence_id IS NOT NULL").groupBy("sentence_id").agg(F.array_sort(F.collect_set("linked_entity_id")).alias("e"))
    pairs = per.where("size(e) > 1").select("sentence_id", "e", F.posexplode("e").alias("i", "a")).select("sentence_id", "a", F.explode(F.slice("e", F.col("i") + 2, F.size("e"))).alias("b"))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("sentences")).where(F.col("sentences") >= least)


def cooccurrence_triples(mentions: DataFrame, sentences: DataFrame, relations: DataFrame, entities: DataFrame, least: int = 3) -> DataFrame:
    """(triple_id, sentence_id, relation_id, subject, object, pattern, matched, confidence, evidence): pairs often named together, with a trigger word between them in at least one sentence (from the last mention of each)."""
    m = mentions.where("NOT coalesce(is_nil, false) AND linked_entity_id IS NOT NULL AND sentence_id IS NOT NULL")
    last = m.groupBy("sentence_id", F.col("linked_entity_id").alias("e")).agg(F.max(F.struct("mention_id", "start", "end")).alias("p"))
    lists = last.groupBy("sentence_id").agg(F.array_sort(F.collect_list(F.struct("e", F.col("p.start").alias("s"), F.col("p.end").alias("t")))).alias("l")).where("size(l) > 1")
    pairs = lists.select("sentence_id", "l", F.posexplode("l").alias("i", "x")).select("sentence_id", "x", F.explode(F.slice("l", F.col("i") + 2, F.size("l"))).alias("y"))
    pairs = pairs.select("sentence_id", F.col("x.e").alias("a"), F.col("y.e").alias("b"), F.least("x.s", "y.s").alias("lo"), F.greatest("x.t", "y.t").alias("hi"))
    often = pairs.groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    kinds = small_or_shuffled(entities.select("id", F.col("entity_type").alias("kind")))
    often = often.join(kinds.withColumnsRenamed({"id": "a", "kind": "ka"}), "a").join(kinds.withColumnsRenamed({"id": "b", "kind": "kb"}), "b")
    r = relations.select(F.col("id").alias("relation_id"), "subject_types", "object_types", "patterns")
    forward = F.array_contains("subject_types", F.col("ka")) & F.array_contains("object_types", F.col("kb"))
    backward = F.array_contains("subject_types", F.col("kb")) & F.array_contains("object_types", F.col("ka"))
    allowed = r.select("relation_id", F.explode("subject_types").alias("x"), "object_types").select("relation_id", "x", F.explode("object_types").alias("y")).distinct()
    types = allowed.select("relation_id", F.col("x").alias("ka"), F.col("y").alias("kb")).union(allowed.select("relation_id", F.col("y").alias("ka"), F.col("x").alias("kb"))).distinct()
    c = often.join(small_or_shuffled(types), ["ka", "kb"]).join(small_or_shuffled(r), "relation_id").where(forward | backward)
    c = c.withColumn("subject", F.when(forward, F.col("a")).otherwise(F.col("b"))).withColumn("object", F.when(forward, F.col("b")).otherwise(F.col("a")))
    j = c.select("a", "b", "relation_id", "subject", "object", "patterns").join(pairs, ["a", "b"]).join(sentences.select("sentence_id", "text"), "sentence_id")
    j = j.withColumn("between", F.substring("text", F.col("lo") + 1, F.col("hi") - F.col("lo"))).withColumn("pattern", F.try_element_at(F.filter("patterns", lambda p: F.contains("between", p)), F.lit(1))).where("pattern IS NOT NULL")
    g = j.groupBy("relation_id", "subject", "object").agg(F.count("*").alias("matched"), F.min(F.struct("sentence_id", "pattern", F.left("text", F.lit(150)).alias("evidence"))).alias("f"))
    return g.select(F.concat(F.lit("cooccur:"), "subject", F.lit(":"), "relation_id", F.lit(":"), "object").alias("triple_id"), "f.sentence_id", "relation_id", "subject", "object", "f.pattern", "matched", F.least(F.round(0.5 + 0.05 * F.col("matched"), 4), F.lit(0.9)).alias("confidence"), "f.evidence")


def fragment_ends(triples: DataFrame, entities: DataFrame, prefix: str = "discovered_", most: int = 2) -> DataFrame:
    """Triples with ``is_fragment``: an end is a discovered entity whose short name is part of another entity's name."""
    short = entities.where(F.col("id").startswith(prefix) & (F.length("name") <= most) & (F.length("name") > 0)).select("id", "name")
    grams = lambda n: entities.where(F.length("name") > n).select(F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("name") - n + 1), lambda i: F.substring("name", i, F.lit(n))))).alias("name"))
    parts = grams(1)
    for n in range(2, most + 1):
        parts = parts.union(grams(n))
    bad = short.join(parts.distinct(), "name", "left_semi").select("id").distinct()
    bad = small_or_shuffled(bad)
    s = triples.join(bad.select(F.col("id").alias("subject"), F.lit(True).alias("_s")), "subject", "left")
    return s.join(bad.select(F.col("id").alias("object"), F.lit(True).alias("_o")), "object", "left").withColumn("is_fragment", F.coalesce("_s", "_o", F.lit(False))).drop("_s", "_o")
