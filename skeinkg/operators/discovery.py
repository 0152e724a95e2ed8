"""Finding new entities in documents without a dictionary: frequency, TF-IDF over paragraphs, nearness to known names.

Tokens are rows (doc_id, pos, word), so any tokenizer can feed the operators. Defined results: words of one character, stop words and known names are no candidates; fewer than three paragraphs give no TF-IDF scores; ties are broken by word."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sizes import small_or_shuffled
from ..functions.text import stripped
from . import tfidf
from .spans import positions


def word_frequency(words: DataFrame, stop: DataFrame, known: DataFrame) -> DataFrame:
    """(word, freq) of words with two characters at least, no stop words (word), no known names (name, lower case)."""
    w = words.where(F.length("word") >= 2).groupBy("word").agg(F.count("*").alias("freq"))
    w = w.join(small_or_shuffled(stop.select("word").distinct()), "word", "left_anti")
    return w.join(small_or_shuffled(known.select(F.col("name").alias("_n")).distinct()), F.lower("word") == F.col("_n"), "left_anti")


def neighbour_boost(words: DataFrame, stop: DataFrame, known: DataFrame, window: int = 8) -> DataFrame:
    """(word, boost): each occurrence at distance d of a known name adds window - d + 1. Known positions spread their scores to the positions around, which are added up and joined back, so pairs are bounded by the window."""
    k = small_or_shuffled(known.select(F.col("name").alias("_n")).distinct())
    hits = words.join(k, F.lower("word") == F.col("_n"), "left_semi").select("doc_id", "pos")
    around = hits.select("doc_id", F.explode(F.array(*[F.struct((F.col("pos") + d).alias("pos"), F.lit(window - abs(d) + 1).alias("s")) for d in range(-window, window + 1) if d])).alias("x")).groupBy("doc_id", F.col("x.pos").alias("pos")).agg(F.sum("x.s").alias("s"))
    w = words.where(F.length("word") >= 2).join(around, ["doc_id", "pos"])
    w = w.join(small_or_shuffled(stop.select("word").distinct()), "word", "left_anti").join(k, F.lower("word") == F.col("_n"), "left_anti")
    return w.groupBy("word").agg(F.sum("s").alias("boost"))


def context_windows(words: DataFrame, around: int = 3, most: int = 3) -> DataFrame:
    """(word, rank, context): the first ``most`` different contexts of each word, by document and position; contexts stay inside a document."""
    by = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(-around, around)
    c = words.withColumn("context", F.array_join(F.collect_list("word").over(by), "")).where(F.length("word") >= 2)
    first = c.groupBy("word", "context").agg(F.min(F.struct("doc_id", "pos")).alias("at"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("word").orderBy("at"))).where(F.col("rank") <= most).select("word", "rank", "context")


def paragraph_table(docs: DataFrame, least: int = 40) -> DataFrame:
    """(doc_id, paragraph, text) of paragraphs between blank lines, with ``least`` characters at least."""
    p = docs.select("doc_id", F.posexplode(F.split("text", r"\n\s*\n")).alias("paragraph", "_t")).select("doc_id", "paragraph", stripped(F.col("_t")).alias("text"))
    return p.where(F.length("text") >= least)


def paragraph_tfidf(terms: DataFrame, top: int = 300, features: int = 600) -> DataFrame:
    """(word, score): mean TF-IDF over paragraphs (id, term) of the ``top`` words; document frequency from 2 to 60 %."""
    tf = tfidf.counts(terms)
    n = tf.select("id").distinct().count()
    if n < 3:
        return tf.select(F.col("term").alias("word"), F.lit(0.0).alias("score")).limit(0)
    w = tfidf.weights(tf, tfidf.vocabulary(tf, n, 0.6, 2, features))
    return w.groupBy(F.col("term").alias("word")).agg(F.round(F.sum("weight") / n, 9).alias("score")).orderBy(F.desc("score"), "word").limit(top)


def candidates(freq: DataFrame, tfidf_scores: DataFrame, boost: DataFrame, named: DataFrame | None = None, least: int = 5) -> DataFrame:
    """(word, freq, tfidf, boost, confidence): words that any method proposes, with enough occurrences; ``named`` (word) are proposals of a recogniser, if there is one."""
    f = freq.where(F.col("freq") >= least)
    j = f.join(small_or_shuffled(tfidf_scores.select("word", "score")), "word", "left").join(boost, "word", "left")
    flag = F.lit(0)
    if named is not None:
        j = j.join(small_or_shuffled(named.select("word", F.lit(1).alias("_named")).distinct()), "word", "left")
        flag = F.coalesce("_named", F.lit(0))
    j = j.withColumn("flag", flag).where(F.col("score").isNotNull() | F.col("boost").isNotNull() | (F.col("flag") == 1))
    t, b = F.coalesce("score", F.lit(0.0)), F.coalesce("boost", F.lit(0))
    conf = 0.4 * F.col("flag") + 0.3 * F.least(t * 8, F.lit(1.0)) + 0.2 * F.least(b / 100, F.lit(1.0)) + 0.1 * F.least(F.col("freq") / 300, F.lit(1.0))
    return j.select("word", "freq", F.round(t, 6).alias("tfidf"), b.cast("bigint").alias("boost"), F.round(F.round(conf, 9), 4).alias("confidence"))


def discovered(candidates_: DataFrame, entity_type: str = "Concept", least: float = 0.45, most: int = 80) -> DataFrame:
    """(id, name, entity_type): the best candidates, numbered by type."""
    top = candidates_.where(F.col("confidence") >= least).orderBy(F.desc("confidence"), F.desc("freq"), "word").limit(most)
    by = Window.orderBy(F.desc("confidence"), F.desc("freq"), "word")
    return top.withColumn("_n", F.row_number().over(by)).select(F.format_string(f"discovered_{entity_type.lower()}_%03d", "_n").alias("id"), F.col("word").alias("name"), F.lit(entity_type).alias("entity_type"))


def validated(docs: DataFrame, names: DataFrame, known: DataFrame, noise: list[str], least: int = 3) -> DataFrame:
    """(name, occurrences, citations, valid): a name is valid with ``least`` occurrences (greedy, not overlapping), unless it has five and more than 70 % stand behind a citation mark or comma."""
    n = names.select("name").distinct().where((F.length("name") >= 2) & ~F.col("name").rlike(r"^\p{Nd}+$") & ~(F.col("name").rlike(r"^[\x00-\x7F]{1,3}$") & F.lower("name").isin(noise)))
    n = n.join(small_or_shuffled(known.select(F.col("name").alias("_n")).distinct()), F.lower("name") == F.col("_n"), "left_anti")
    lead = small_or_shuffled(n.select("name", F.length("name").alias("_n"), F.substring("name", 1, 2).alias("_two")))
    longest = lead.agg(F.coalesce(F.max("_n"), F.lit(2))).first()[0]
    # a position carries a window with the 20 characters before it and as many behind as the longest name has
    rows = positions(docs, "doc_id", "text", longest, 20).withColumnRenamed("_at", "at")
    hit = rows.withColumn("_two", F.expr("substring(_s, _p, 2)")).join(lead, "_two").where("substring(_s, _p, _n) = name")
    # greedy from the left: inside a run of overlapping starts only those a whole name apart count
    spots = hit.select("doc_id", "name", "at", F.expr("substring(_s, _p - _b, _b)").alias("before"))
    per = spots.groupBy("doc_id", "name").agg(F.array_sort(F.collect_list(F.struct("at", "before"))).alias("s"))
    kept = F.reduce("s", F.slice("s", 1, 0), lambda acc, x: F.when((F.size(acc) > 0) & (x["at"] < F.element_at(acc, -1)["at"] + F.length("name")), acc).otherwise(F.concat(acc, F.array(x))))
    one = per.select("name", F.explode(kept).alias("x")).select("name", (F.col("x.before").rlike(r"[①-⑩0-9]+[．.]") | F.contains(F.right("x.before", F.lit(5)), F.lit("，"))).alias("cited"))
    g = one.groupBy("name").agg(F.count("*").alias("occurrences"), F.count_if("cited").alias("citations"))
    bad = (F.col("occurrences") >= 5) & (F.col("citations") > 0.7 * F.col("occurrences"))
    return g.select("name", "occurrences", "citations", (~bad & (F.col("occurrences") >= least)).alias("valid"))


def extended(entities: DataFrame, new: DataFrame) -> DataFrame:
    """Entities with those of ``new`` whose id isn't there yet."""
    return entities.unionByName(new.join(entities.select("id"), "id", "left_anti"), allowMissingColumns=True)


def fragment_clusters(mentions: DataFrame, sentences: DataFrame, entities: DataFrame, threshold: float = 0.75, prefix: str = "discovered_", width: int = 40, longest: int = 2) -> DataFrame:
    """(fragment, canonical, similarity): a discovered entity with a name of at most ``longest`` characters is merged into the entity whose longer name holds it and whose contexts are most alike: the product of the mean unit TF-IDF vectors (grams of 2 and 3 characters), which equals the mean pairwise cosine. Both need two contexts."""
    known = entities.select(F.col("id").alias("linked_entity_id"), "name")
    m = mentions.where("linked_entity_id IS NOT NULL").select("mention_id", "sentence_id", "start", "end", "linked_entity_id").join(small_or_shuffled(known), "linked_entity_id").join(sentences.select("sentence_id", F.col("text").alias("_t")), "sentence_id")
    a = F.greatest(F.col("start") - width, F.lit(0))
    ctx = m.select(F.col("linked_entity_id").alias("e"), "mention_id", F.substring("_t", a + 1, F.col("end") + width - a).alias("c"))
    short = entities.where(F.col("id").startswith(prefix) & (F.length("name") <= longest) & (F.length("name") > 0)).select(F.col("id").alias("fragment"), F.col("name").alias("part"))
    grams = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.length("name") - k + 1, F.lit(1))), lambda i: F.substring("name", i, k)))))
    long = entities.where(F.length("name") > longest).select(F.col("id").alias("canonical"), F.explode(grams).alias("part"))
    pairs = short.join(long, "part").where("fragment <> canonical").select("fragment", "canonical").distinct()
    n = ctx.groupBy("e").agg(F.count("*").alias("n")).where("n >= 2").select("e")
    pairs = pairs.join(n.withColumnRenamed("e", "fragment"), "fragment", "left_semi").join(n.withColumnRenamed("e", "canonical"), "canonical", "left_semi")
    used = pairs.select(F.explode(F.array("fragment", "canonical")).alias("e")).distinct()
    w, _ = tfidf.fitted(ctx.join(small_or_shuffled(used), "e", "left_semi").select(F.col("mention_id").alias("id"), F.explode(tfidf.char_grams(F.col("c"), 2, 3)).alias("term")))
    size = ctx.groupBy("e").agg(F.count("*").alias("n"))
    mean = w.join(ctx.select(F.col("mention_id").alias("id"), "e"), "id").groupBy("e", "term").agg(F.sum("weight").alias("s")).join(size, "e").select("e", "term", (F.col("s") / F.col("n")).alias("v"))
    left = pairs.join(mean.withColumnsRenamed({"e": "fragment", "v": "x"}), "fragment").join(mean.withColumnsRenamed({"e": "canonical", "v": "y"}), ["canonical", "term"])
    s = left.groupBy("fragment", "canonical").agg(F.round(F.sum(F.col("x") * F.col("y")), 9).alias("similarity")).where(F.col("similarity") >= threshold)
    by = Window.partitionBy("fragment").orderBy(F.desc("similarity"), "canonical")
    return s.withColumn("rn", F.row_number().over(by)).where("rn = 1").drop("rn")

