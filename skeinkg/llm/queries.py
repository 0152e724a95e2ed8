"""Registered queries of the text operators."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import table
from ..functions.lineage import checkpointed
from . import markup, mixing, packing, quality, sentences, terms, textform, tokens, variants

#: Packs that are filled at once; more are refused.
MOST_PACKS = 100


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "sentences").select(F.lit("sentence").alias("record_kind"), F.col("sentence_id").alias("record_id"), "text").unionByName(table(spark, d, "mentions").select(F.lit("mention").alias("record_kind"), F.col("mention_id").alias("record_id"), "text"))
    rows = rows.where(textform.calls_for_work(F.col("text")))
    forms = textform.consistent_texts(rows).where("form <> text")
    return rows.join(forms, "text", "left_semi").select("record_kind", "record_id").distinct()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    found = markup.marked_elements(markup.document_blocks(table(spark, d, "documents")))
    return found.where("element = 'document' OR element_text <> ''").select(F.col("id").cast("bigint").alias("doc_id"), "element", "element_text").distinct()


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    scored = terms.term_divergence(terms.sentence_terms(table(spark, d, "sentences")), "document_id")
    return scored.where((F.col("tf") >= 3) & (F.col("df") <= 3) & terms.is_word(F.col("term")) & F.col("score").isNotNull()).select("document_id", "term")


def p4_scores(spark: SparkSession, d: str) -> DataFrame:
    """Every term of every document with its score and rank, the greatest score first; terms of one document alone are cut off."""
    scored = terms.term_divergence(terms.sentence_terms(table(spark, d, "sentences")), "document_id", min_df=2)
    return scored.where(terms.is_word(F.col("term"))).withColumn("rank", F.row_number().over(Window.partitionBy("document_id").orderBy(F.desc("score"), "term")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    fields = {"token": terms.sentence_terms(table(spark, d, "sentences")), "mention": terms.mention_terms(table(spark, d, "mentions"))}
    return terms.marked_terms(fields).where("mark IS NOT NULL").select("field", "term", "mark")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "sentences")
    model = sentences.fitted(records)
    documents = table(spark, d, "documents").where("stage = 'cleaned'").select(F.lit("document").alias("record_kind"), F.col("doc_id").cast("string").alias("record_id"), "text")
    rows = records.where("sentence_id IS NOT NULL").select(F.lit("sentence").alias("record_kind"), F.col("sentence_id").alias("record_id"), "text")
    return sentences.segmented(documents, model).unionByName(sentences.segmented(rows, model, least=2).distinct())


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return variants.variant_links(table(spark, d, "mentions"), table(spark, d, "entities"), table(spark, d, "nicknames"))


def p7_clusters(spark: SparkSession, d: str) -> DataFrame:
    return variants.variant_clusters(table(spark, d, "mentions"), table(spark, d, "entities"), table(spark, d, "nicknames"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    sizes = table(spark, d, "pack_sizes").select("pack_name", "capacity").limit(MOST_PACKS + 1).collect()
    if len(sizes) > MOST_PACKS:
        raise ValueError(f"more than {MOST_PACKS} packs")
    return packing.packed(table(spark, d, "documents"), [(r["pack_name"], r["capacity"]) for r in sizes])


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_rates(p8_containers(spark, d))


def _mixture(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sizes = checkpointed(tokens.with_sizes(table(spark, d, "documents"), ["doc_id", "source"]))
    return mixing.mixture(sizes, table(spark, d, "mix_targets"))


def p9_curriculum(spark: SparkSession, d: str) -> DataFrame:
    return mixing.in_training_order(_mixture(spark, d)[1])


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.actual_shares(*_mixture(spark, d))


def p10_statistics(spark: SparkSession, d: str) -> DataFrame:
    features = checkpointed(quality.document_features(table(spark, d, "documents"), table(spark, d, "common_words")))
    rules = quality.induced_rules(quality.labelled_features(features, table(spark, d, "doc_labels")))
    return quality.document_kinds(features, rules).withColumn("doc_id", F.col("id").cast("bigint")).drop("id")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_statistics(spark, d).where("kind <> 'prose'").select("doc_id", "kind")


def queries() -> dict:
    return {"p1_found": p1_found, "p3_found": p3_found, "p4_found": p4_found, "p4_scores": p4_scores, "p5_found": p5_found, "p6_found": p6_found, "p7_found": p7_found, "p7_clusters": p7_clusters, "p8_containers": p8_containers, "p8_fill": p8_fill, "p9_curriculum": p9_curriculum, "p9_shares": p9_shares, "p10_found": p10_found, "p10_statistics": p10_statistics}


def oracle_sql() -> dict[str, str]:
    return {}
