"""Linking mentions to entities: exact and similar aliases, context, type, NIL threshold.

Defined results: a mention without any candidate is NIL with no candidates; null texts have none; ties of the final score go to exact matches, then to the lesser alias rank, then to the entity id."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import checkpointed
from ..functions.sizes import small_or_shuffled
from ..functions.text import stripped
from . import tfidf
from .spans import alias_index


def similar_aliases(texts: DataFrame, aliases: DataFrame, most: int = 15, least: float = 0.1) -> DataFrame:
    """(key, alias_rank, entity_id, cosine): the ``most`` alias rows nearest to each distinct text by character grams of 2 to 4, above ``least``; ties by alias rank."""
    gram = lambda df, i, t: df.select(F.col(i).alias("id"), F.explode(tfidf.char_grams(F.col(t), 2, 4)).alias("term"))
    fit, vocabulary = tfidf.fitted(gram(aliases, "alias_rank", "alias"))
    query = tfidf.weights(tfidf.counts(gram(texts, "key", "key")), vocabulary)
    scored = tfidf.cosines(query, fit).select(F.col("id").alias("key"), F.col("other").alias("alias_rank"), F.round("cosine", 9).alias("cosine"))
    by = Window.partitionBy("key").orderBy(F.desc("cosine"), "alias_rank")
    top = scored.withColumn("rn", F.row_number().over(by)).where((F.col("rn") <= most) & (F.col("cosine") > least))
    return top.join(small_or_shuffled(aliases.select("alias_rank", "entity_id")), "alias_rank").select("key", "alias_rank", "entity_id", "cosine")


def alias_candidates(texts: DataFrame, aliases: DataFrame) -> DataFrame:
    """(key, entity_id, alias_score, place): exact aliases score 1 and come first, then the best similarity of each entity."""
    exact = texts.join(small_or_shuffled(aliases.select(F.lower("alias").alias("key"), "entity_id", "alias_rank")), "key").select("key", "entity_id", F.lit(1.0).alias("alias_score"), F.lit(0).alias("place"))
    near = similar_aliases(texts, aliases).select("key", "entity_id", F.col("cosine").alias("alias_score"), F.col("alias_rank").alias("place"))
    return exact.unionByName(near).groupBy("key", "entity_id").agg(F.max("alias_score").alias("alias_score"), F.min("place").alias("place"))


def context_scores(pairs: DataFrame, sentences: DataFrame, entities: DataFrame, profile_tokens) -> DataFrame:
    """(sentence_id, entity_id, context_score) of the given pairs: cosine of a sentence's tokens and the entity's profile (names and description), on the profiles' vocabulary. ``profile_tokens`` turns text into an array of tokens."""
    text = F.array_join(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")), F.array(F.coalesce("description", F.lit("")))), " ")
    profiles = entities.select(F.col("id"), F.explode(profile_tokens(text)).alias("term"))
    fit, vocabulary = tfidf.fitted(profiles.select("id", F.lower("term").alias("term")))
    words = sentences.select(F.col("sentence_id").alias("id"), F.explode("tokens").alias("t")).select("id", F.lower("t.text").alias("term"))
    w = tfidf.weights(tfidf.counts(words), vocabulary).select(F.col("id").alias("sentence_id"), "term", "weight")
    profile = small_or_shuffled(fit.select(F.col("id").alias("entity_id"), "term", F.col("weight").alias("_w")))
    both = pairs.select("sentence_id", "entity_id").distinct().join(w, "sentence_id").join(profile, ["entity_id", "term"])
    return both.groupBy("sentence_id", "entity_id").agg(F.sum(F.col("weight") * F.col("_w")).alias("context_score"))


def type_score(mention_type, entity_type, parents: dict[str, list[str]] | None = None):
    """0.3 for equal types, 0.2 where the entity's is a child of the mention's, 0.15 where it is the parent, else 0."""
    score = F.when(mention_type == entity_type, 0.3)
    for parent, children in (parents or {}).items():
        score = score.when((mention_type == parent) & entity_type.isin(children), 0.2).when((entity_type == parent) & mention_type.isin(children), 0.15)
    return score.otherwise(0.0)


def scored_candidates(mentions: DataFrame, sentences: DataFrame, entities: DataFrame, profile_tokens, parents: dict[str, list[str]] | None = None) -> DataFrame:
    """(mention_id, entity_id, alias_score, context_score, type_score, final_score, rank) of all candidates. Aliases are compared once for each distinct text."""
    keyed = mentions.select("mention_id", "sentence_id", "entity_type", F.lower(stripped(F.col("text"))).alias("key")).where("key <> ''")
    candidates = checkpointed(alias_candidates(keyed.select("key").distinct(), checkpointed(alias_index(entities))))
    types = small_or_shuffled(entities.select(F.col("id").alias("entity_id"), F.col("entity_type").alias("kind")))
    c = keyed.join(small_or_shuffled(candidates), "key").join(types, "entity_id")
    c = c.join(context_scores(c, sentences, entities, profile_tokens), ["sentence_id", "entity_id"], "left")
    ctx = F.least(F.coalesce("context_score", F.lit(0.0)), F.lit(1.0))
    kind = type_score(F.col("entity_type"), F.col("kind"), parents)
    c = c.select("mention_id", "entity_id", "alias_score", ctx.alias("context_score"), kind.alias("type_score"), "place")
    c = c.withColumn("final_score", F.round(F.round(0.4 * F.col("alias_score") + 0.2 * F.col("context_score") + F.col("type_score"), 9), 4))
    by = Window.partitionBy("mention_id").orderBy(F.desc("final_score"), "place", "entity_id")
    return c.withColumn("rank", F.row_number().over(by)).drop("place")


def linked(mentions: DataFrame, candidates: DataFrame) -> DataFrame:
    """(mention_id, linked_entity_id, link_score, is_nil): the first candidate if it reaches the threshold, 0.4 for a lone one, else the greater of 0.3 and 0.55 times the mean of the first three."""
    g = candidates.groupBy("mention_id").agg(F.count("*").alias("n"), F.max(F.when(F.col("rank") == 1, F.col("final_score"))).alias("top"), F.max(F.when(F.col("rank") == 1, F.col("entity_id"))).alias("best"), F.avg(F.when(F.col("rank") <= 3, F.col("final_score"))).alias("mean3"))
    limit = F.when(F.col("n") >= 2, F.greatest(F.lit(0.3), F.round(0.55 * F.col("mean3"), 9))).otherwise(0.4)
    j = mentions.select("mention_id").join(g, "mention_id", "left")
    ok = F.coalesce(F.col("top") >= limit, F.lit(False))
    return j.select("mention_id", F.when(ok, F.col("best")).alias("linked_entity_id"), F.when(ok, F.col("top")).otherwise(0.0).alias("link_score"), (~ok).alias("is_nil"))


def redirected(mentions: DataFrame, merges: DataFrame, entities: DataFrame) -> DataFrame:
    """Linked ids rewritten by ``merges`` (fragment, canonical), names refreshed. Null ids stay null."""
    m = mentions.join(small_or_shuffled(merges.select(F.col("fragment").alias("linked_entity_id"), "canonical")), "linked_entity_id", "left")
    m = m.withColumn("linked_entity_id", F.coalesce("canonical", "linked_entity_id")).drop("canonical", "linked_entity_name")
    return m.join(small_or_shuffled(entities.select(F.col("id").alias("linked_entity_id"), F.col("name").alias("linked_entity_name"))), "linked_entity_id", "left")


def without_removed(mentions: DataFrame, removed: DataFrame) -> DataFrame:
    """Mentions linked to none of ``removed`` (id); unlinked ones stay."""
    return mentions.join(small_or_shuffled(removed.select(F.col("id").alias("linked_entity_id"))), "linked_entity_id", "left_anti")


def self_linked(mentions: DataFrame, entities: DataFrame, least: int = 5, share: float = 0.95) -> DataFrame:
    """(id, mentions, same): entities with at least ``least`` mentions of which more than ``share`` read exactly as their name."""
    j = mentions.where("linked_entity_id IS NOT NULL").join(small_or_shuffled(entities.select(F.col("id").alias("linked_entity_id"), "name")), "linked_entity_id")
    g = j.groupBy("linked_entity_id").agg(F.count("*").alias("mentions"), F.count_if(F.trim("text") == F.col("name")).alias("same"))
    return g.where((F.col("mentions") >= least) & (F.col("same") > share * F.col("mentions"))).select(F.col("linked_entity_id").alias("id"), "mentions", "same")
