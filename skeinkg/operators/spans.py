"""Spans: alias index, dictionary matches, overlap resolution, BIO labels.

Defined results: null or empty texts and token lists match nothing; equal spans go to the lesser rank; empty tables give empty results.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sizes import small_or_shuffled


def alias_index(entities: DataFrame) -> DataFrame:
    """(alias_rank, alias, entity_id, entity_type): distinct names of each entity, longest first, then by text and entity id."""
    names = F.array_distinct(F.filter(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))), lambda x: x.isNotNull() & (x != "")))
    flat = entities.select(F.explode(names).alias("alias"), F.col("id").alias("entity_id"), "entity_type").distinct().withColumn("_n", F.length("alias"))
    # ranks count on from the longer aliases' number; only one row a length meets in a window without key
    longer = flat.groupBy("_n").agg(F.count("*").alias("_k"))
    base = longer.select("_n", F.coalesce(F.sum("_k").over(Window.orderBy(F.desc("_n")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    order = Window.partitionBy("_n").orderBy("alias", "entity_id")
    ranked = flat.withColumn("_rn", F.row_number().over(order)).join(F.broadcast(base), "_n")
    return ranked.select((F.col("_base") + F.col("_rn")).cast("int").alias("alias_rank"), "alias", "entity_id", "entity_type")


def occurrences(sentences: DataFrame, aliases: DataFrame, key: str = "sentence_id", text: str = "text") -> DataFrame:
    """(key, start, end, text, alias_rank, entity_id, entity_type) of every occurrence, overlapping ones too; ASCII aliases ignore case.

    Every position's first two characters are joined to the aliases' (an equi-join), then the whole alias is compared with what stands there; a position carries a window little longer than the longest alias, never its text."""
    lead = lambda c: F.lower(F.substring(c, 1, 2))
    index = small_or_shuffled(aliases.where(F.length("alias") > 0).select("*", F.length("alias").alias("_n"), lead(F.col("alias")).alias("_lead")))
    longest, single = index.agg(F.coalesce(F.max("_n"), F.lit(1)), F.coalesce(F.min("_n"), F.lit(2)) == 1).first()
    two = F.lower(F.substring("_s", F.col("_p"), F.lit(2)))
    leads = F.explode(F.array_distinct(F.array(two, F.substring(two, 1, 1)))) if single else two
    rows = positions(sentences, key, text, longest).select(key, "_at", "_s", "_p", leads.alias("_lead"))
    found = rows.join(index, "_lead").withColumn("_slice", F.substring("_s", F.col("_p"), F.col("_n")))
    same = F.when(F.col("alias").rlike(r"^[\x00-\x7F]+$"), F.lower("_slice") == F.lower("alias")).otherwise(F.col("_slice") == F.col("alias"))
    return found.where(same).select(key, F.col("_at").alias("start"), (F.col("_at") + F.col("_n")).alias("end"), F.col("_slice").alias("text"), "alias_rank", "entity_id", "entity_type")


#: Positions of a text that share one window.
WINDOW = 64


def positions(rows: DataFrame, key: str, text: str, size: int, before: int = 0) -> DataFrame:
    """(key, _at, _s, _p, _b): each position of a text, from 0, and a window of it in which ``size`` characters stand from place ``_p`` (from 1) on, behind the ``_b`` (at most ``before``) characters in front. Texts are cut into short overlapping windows first, so that neither a row nor the search for a place in it grows with the text."""
    n = F.length(text)
    cut = lambda w: F.struct(w.alias("w"), F.substring(text, F.greatest(w - before, F.lit(0)) + 1, F.least(w, F.lit(before)) + WINDOW + size).alias("s"), F.least(n - w, F.lit(WINDOW)).alias("n"))
    windows = rows.where(n > 0).select(key, F.explode(F.transform(F.sequence(F.lit(0), n - 1, F.lit(WINDOW)), cut)).alias("_w")).select(key, "_w.w", "_w.s", "_w.n")
    at = windows.select(key, "w", "s", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    here = F.col("w") + F.col("i")
    return at.select(key, here.alias("_at"), F.col("s").alias("_s"), (F.col("i") + F.least("w", F.lit(before)) + 1).alias("_p"), F.least(here, F.lit(before)).alias("_b"))


def _kept(spans: Column, overlap) -> Column:
    """Folds sorted spans, keeping those that overlap none kept before."""
    return F.reduce(spans, F.slice(spans, 1, 0), lambda acc, x: F.when(overlap(acc, x), acc).otherwise(F.concat(acc, F.array(x))))


def leftmost_longest(found: DataFrame, key: str = "sentence_id") -> DataFrame:
    """(key, mention_no from 1, start, end, text, entity_id, entity_type): leftmost first, then longest, then least rank; no overlaps."""
    spans = F.array_sort(F.collect_list(F.struct("start", (-F.col("end")).alias("neg"), "alias_rank", "text", "entity_id", "entity_type")))
    kept = _kept(F.col("_s"), lambda acc, x: (F.size(acc) > 0) & (x["start"] < -F.element_at(acc, -1)["neg"]))
    rows = found.groupBy(key).agg(spans.alias("_s")).select(key, F.posexplode(kept).alias("_k", "x"))
    return rows.select(key, (F.col("_k") + 1).alias("mention_no"), F.col("x.start").alias("start"), (-F.col("x.neg")).alias("end"), F.col("x.text").alias("text"), F.col("x.entity_id").alias("entity_id"), F.col("x.entity_type").alias("entity_type"))


def gazetteer(sentences: DataFrame, entities: DataFrame) -> DataFrame:
    """Dictionary mentions with ids ``{sentence_id}-g001``..."""
    m = leftmost_longest(occurrences(sentences, alias_index(entities)))
    return m.select(F.format_string("%s-g%03d", "sentence_id", "mention_no").alias("mention_id"), "sentence_id", "start", "end", "text", "entity_id", "entity_type", F.lit("gazetteer").alias("source"))


def merged_methods(mentions: DataFrame, order: tuple[str, ...] = ("gazetteer", "crf", "hmm", "hmm_buckets")) -> DataFrame:
    """(sentence_id, merged_no, mention_id, start, end, source): the first of ``order`` before all, then the longest, then leftmost; ties by the order of methods, then id; no overlaps."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, order)), F.col("source")), F.lit(0))
    rank = F.when(rank == 0, len(order) + 1).otherwise(rank)
    x = F.struct((F.col("source") != order[0]).alias("late"), (F.col("start") - F.col("end")).alias("neg"), F.col("start").alias("start"), rank.alias("rank"), "mention_id", F.col("end").alias("end"), "source")
    valid = mentions.where("sentence_id IS NOT NULL AND start IS NOT NULL AND `end` IS NOT NULL AND source IS NOT NULL")
    kept = _kept(F.col("_s"), lambda acc, x: F.exists(acc, lambda y: (x["start"] < y["end"]) & (x["end"] > y["start"])))
    rows = valid.groupBy("sentence_id").agg(F.array_sort(F.collect_list(x)).alias("_s")).select("sentence_id", F.explode(kept).alias("x"))
    by = Window.partitionBy("sentence_id").orderBy("x.start", "x.end")
    return rows.select("sentence_id", F.row_number().over(by).alias("merged_no"), "x.mention_id", "x.start", "x.end", "x.source")


def covered_tokens(sentences: DataFrame, mentions: DataFrame) -> DataFrame:
    """(mention_id, sentence_id, start, end, entity_type, covered): the tokens each mention overlaps, by sentence."""
    toks = F.filter(F.transform("tokens", lambda t, i: F.struct(i.alias("i"), t["start"].alias("s"), t["end"].alias("e"))), lambda t: (t["s"] < F.col("m_end")) & (t["e"] > F.col("m_start")))
    m = mentions.where("sentence_id IS NOT NULL").select("mention_id", "sentence_id", F.col("start").alias("m_start"), F.col("end").alias("m_end"), "entity_type")
    j = m.join(sentences.select("sentence_id", "tokens"), "sentence_id")
    return j.select("mention_id", "sentence_id", F.col("m_start").alias("start"), F.col("m_end").alias("end"), "entity_type", F.coalesce(toks, F.array().cast("array<struct<i:int,s:int,e:int>>")).alias("covered"))


def bio_labels(sentences: DataFrame, mentions: DataFrame) -> DataFrame:
    """(sentence_id, token_index, token, start, end, label): B- on the first token a mention covers, I- on the rest; the later mention by (start, end, id) overwrites."""
    c = covered_tokens(sentences, mentions).where("size(covered) > 0")
    hits = c.select("sentence_id", "start", "end", "mention_id", "entity_type", F.posexplode("covered").alias("_k", "t"))
    last = hits.groupBy("sentence_id", F.col("t.i").alias("token_index")).agg(F.max_by(F.concat(F.when(F.col("_k") == 0, "B-").otherwise("I-"), F.col("entity_type")), F.struct("start", "end", "mention_id")).alias("label"))
    toks = sentences.select("sentence_id", F.posexplode("tokens").alias("token_index", "t"))
    joined = toks.join(last, ["sentence_id", "token_index"], "left")
    return joined.select("sentence_id", "token_index", F.col("t.text").alias("token"), F.col("t.start").alias("start"), F.col("t.end").alias("end"), F.coalesce("label", F.lit("O")).alias("label"))


def bio_spans(labels: DataFrame) -> DataFrame:
    """(sentence_id, span_no, entity_type, start, end) from (sentence_id, token_index, start, end, label): islands of equal type that start at B- or a change of type."""
    by = Window.partitionBy("sentence_id").orderBy("token_index")
    kind = F.when(F.col("label") != "O", F.substring("label", 3, 1_000))
    d = labels.withColumn("kind", kind).withColumn("before", F.lag("kind").over(by))
    opens = F.col("kind").isNotNull() & (F.col("label").startswith("B-") | ~F.col("kind").eqNullSafe(F.col("before")))
    d = d.withColumn("island", F.sum(opens.cast("int")).over(by)).where("kind IS NOT NULL")
    spans = d.groupBy("sentence_id", "island").agg(F.first("kind").alias("entity_type"), F.min("start").alias("start"), F.max("end").alias("end"))
    return spans.select("sentence_id", F.row_number().over(Window.partitionBy("sentence_id").orderBy("island")).alias("span_no"), "entity_type", "start", "end")


def method_counts(mentions: DataFrame) -> DataFrame:
    """(source, entity_type or null for all, mentions, texts)."""
    g = mentions.groupingSets([["source"], ["source", "entity_type"]], "source", "entity_type").agg(F.grouping("entity_type").alias("every"), F.count("*").alias("mentions"), F.count_distinct("text").alias("texts"))
    return g.select("source", F.when(F.col("every") == 1, F.lit("*")).otherwise(F.coalesce("entity_type", F.lit("?"))).alias("entity_type"), "mentions", "texts")


def method_overlap(mentions: DataFrame) -> DataFrame:
    """(a, b, spans): equal (sentence, start, end) of every two methods; with itself, the distinct spans. One row a span carries its set of methods, so nothing is joined."""
    spans = mentions.where("sentence_id IS NOT NULL").groupBy("sentence_id", "start", "end").agg(F.collect_set("source").alias("m"))
    return spans.select(F.explode("m").alias("a"), "m").select("a", F.explode("m").alias("b")).groupBy("a", "b").agg(F.count("*").alias("spans"))


def boundary_metrics(sentences: DataFrame, mentions: DataFrame) -> DataFrame:
    """One row: mentions of known sentences that overlap tokens, the share whose ends are token ends, mean tokens a mention, share with one token."""
    c = covered_tokens(sentences, mentions).where("size(covered) > 0")
    aligned = (F.col("covered")[0]["s"] == F.col("start")) & (F.element_at("covered", -1)["e"] == F.col("end"))
    r = lambda x: F.coalesce(F.round(x, 4), F.lit(0.0))
    return c.agg(F.count("*").alias("mentions"), r(F.avg(aligned.cast("double"))).alias("aligned_rate"), r(F.avg(F.size("covered"))).alias("mean_tokens"), r(F.avg((F.size("covered") == 1).cast("double"))).alias("single_rate"))
