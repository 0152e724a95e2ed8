"""Export rows of the graph store and its queries, and the files it writes."""

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.files import write_text
from ..functions.lineage import checkpointed
from ..functions.sizes import small_or_shuffled
from .graph import degrees, mention_counts, neighborhood


def _bar(c: str):
    return F.coalesce(F.array_join(c, "|"), F.lit(""))


def entity_rows(entities: DataFrame, mentions: DataFrame, facts: DataFrame) -> DataFrame:
    e = entities.select(F.col("id").alias("entity_id"), "name", F.col("entity_type").alias("type"), _bar("aliases").alias("aliases"), "description")
    m, d = small_or_shuffled(mention_counts(mentions)), small_or_shuffled(degrees(facts))
    j = e.join(m.withColumnRenamed("id", "entity_id"), "entity_id", "left").join(d.withColumnRenamed("id", "entity_id"), "entity_id", "left")
    return j.select("entity_id", "name", "type", "aliases", "description", F.coalesce("mentions", F.lit(0)).alias("mention_count"), F.coalesce("degree", F.lit(0)).alias("degree"))


def relation_rows(relations: DataFrame, facts: DataFrame) -> DataFrame:
    """All relations of the schema, and those that only facts have (source ``reasoning``), with their fact counts."""
    n = facts.where("relation_id IS NOT NULL").groupBy("relation_id").agg(F.count("*").alias("triple_count"), F.min("relation_label").alias("fact_label"))
    r = relations.select(F.col("id").alias("relation_id"), "label", _bar("subject_types").alias("subject_types"), _bar("object_types").alias("object_types"), F.lit("schema").alias("source"))
    j = r.join(n, "relation_id", "full")
    return j.select("relation_id", F.coalesce("label", "fact_label").alias("label"), F.coalesce("subject_types", F.lit("")).alias("subject_types"), F.coalesce("object_types", F.lit("")).alias("object_types"), F.coalesce("source", F.lit("reasoning")).alias("source"), F.coalesce("triple_count", F.lit(0)).alias("triple_count"))


def fact_rows(facts: DataFrame) -> DataFrame:
    """The 13 export columns; lists are joined with ``|``."""
    return facts.select("triple_id", F.col("subject").alias("subject_id"), "subject_name", "relation_id", "relation_label", F.col("object").alias("object_id"), "object_name", "confidence", "source", "document_id", "sentence_id", F.col("evidence"), _bar("support_triple_ids").alias("support_triple_ids"))


def rdf_lines(facts: DataFrame, base: str = "urn:kg:") -> DataFrame:
    """(line): distinct N-Triples lines."""
    iri = lambda kind, c: F.concat(F.lit(f"<{base}{kind}/"), F.regexp_replace(c, r'[\s<>"{}|\\^`]', "_"), F.lit(">"))
    return facts.where("subject IS NOT NULL AND object IS NOT NULL AND relation_id IS NOT NULL").select(F.concat_ws(" ", iri("entity", F.col("subject")), iri("relation", F.col("relation_id")), iri("entity", F.col("object")), F.lit(".")).alias("line")).distinct()


def center_neighborhood(facts: DataFrame, center: str, most: int = 20) -> DataFrame:
    """The first ``most`` facts around the centre by triple_id, each with the full number."""
    n = neighborhood(facts, center)
    rn = F.row_number().over(Window.orderBy("triple_id"))
    top = n.select("triple_id", "subject", "relation_id", "object", "source", "confidence").orderBy("triple_id").limit(most)
    total = n.agg(F.count("*").alias("total")).first()["total"]
    return top.withColumn("rank", rn).withColumn("total", F.lit(total))


def relation_distribution(facts: DataFrame) -> DataFrame:
    return facts.groupBy("relation_id").agg(F.count("*").alias("facts"))


def inferred_facts(facts: DataFrame, most: int = 20) -> DataFrame:
    """The first ``most`` inferred facts by triple_id, with the number of supports and the first five of them."""
    i = facts.where("source = 'inferred'").orderBy("triple_id").limit(most)
    s = F.coalesce("support_triple_ids", F.array().cast("array<string>"))
    return i.select("triple_id", "subject", "relation_id", "object", "confidence", F.size(s).alias("support_count"), F.array_join(F.slice(s, 1, 5), "|").alias("first_supports"))


def evidence_samples(facts: DataFrame, most: int = 3) -> DataFrame:
    """The first ``most`` facts of each relation by triple_id."""
    by = Window.partitionBy("relation_id").orderBy("triple_id")
    return facts.where("relation_id IS NOT NULL").select("relation_id", "triple_id", "evidence", F.row_number().over(by).alias("rank")).where(F.col("rank") <= most)


def export(out: str, entities: DataFrame, relations: DataFrame, mentions: DataFrame, facts: DataFrame, center: str) -> dict:
    """Writes facts, entities and relations (TSV with header), facts as N-Triples and JSON lines, the four queries as JSON lines; a summary of counts comes back and is written as JSON."""
    tsv = lambda df, name: df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns]).write.mode("overwrite").option("sep", "\t").option("header", True).csv(f"{out}/{name}")
    # each table is computed once, whatever it is written as
    facts, mentions = checkpointed(facts), checkpointed(mentions)
    fr = fact_rows(facts)
    tsv(entity_rows(entities, mentions, facts), "entities.tsv")
    tsv(relation_rows(relations, facts), "relations.tsv")
    tsv(fr, "facts.tsv")
    rdf_lines(facts).orderBy("line").write.mode("overwrite").text(f"{out}/facts.nt")
    write_jsonl(fr, f"{out}/facts.jsonl")
    for name, df in (("center_neighborhood", center_neighborhood(facts, center)), ("relation_distribution", relation_distribution(facts)), ("inferred_facts", inferred_facts(facts)), ("evidence_samples", evidence_samples(facts))):
        write_jsonl(df, f"{out}/{name}.jsonl")
    summary = {"facts": facts.count(), "entities": entities.count(), "relations": relations.count(), "center": center}
    write_json(entities.sparkSession, summary, f"{out}/summary.json")
    return summary


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines, nulls kept."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_json(spark: SparkSession, payload, path: str) -> None:
    """A small report as one JSON document, two blanks of indent, non-ASCII kept."""
    write_text(spark, json.dumps(payload, ensure_ascii=False, indent=2), path)


def write_texts(docs: DataFrame, path: str, key: str = "document_id", text: str = "text", buckets: int = 64) -> None:
    """Texts as JSON lines (key, text) in one folder for each of ``buckets`` hashes of the key, so that neither files nor folders grow with the number of documents, and one document is found in one folder."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    rows.write.mode("overwrite").partitionBy("bucket").option("ignoreNullFields", "false").json(path)


def read_texts(spark: SparkSession, path: str, keys: list[str] | None = None, buckets: int = 64) -> DataFrame:
    """(key, text) written by ``write_texts``; with ``keys``, only their folders are read."""
    rows = spark.read.schema("key string, text string, bucket bigint").json(path)
    if keys is not None:
        wanted = spark.createDataFrame([(k,) for k in keys], "key string")
        places = [r[0] for r in wanted.select(F.pmod(F.xxhash64("key"), F.lit(buckets))).distinct().collect()]
        rows = rows.where(F.col("bucket").isin(places) & F.col("key").isin(keys))
    return rows.select("key", "text")
