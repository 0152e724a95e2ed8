"""Reading JSON and JSON-lines tables with fixed schemas, ontologies, stop words, snapshots and query bindings."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import DDL, DEFAULTS, REQUIRED, schema


def with_defaults(df: DataFrame, kind: str) -> DataFrame:
    """Optional columns' nulls replaced by their defaults."""
    d = DEFAULTS.get(kind, {})
    return df.select(*[F.coalesce(F.col(c), F.expr(d[c])).alias(c) if c in d else F.col(c) for c in df.columns])


def load(spark: SparkSession, path: str, kind: str, strict: bool = True) -> DataFrame:
    """A JSON-lines table. Unknown keys are ignored, blank lines skipped; malformed lines fail, and so does, if ``strict``, a missing required value when its row is read."""
    df = with_defaults(spark.read.schema(schema(kind)).option("mode", "FAILFAST").json(path), kind)
    if not strict:
        return df
    need = REQUIRED[kind]
    return df.select(*[F.when(F.col(c).isNull(), F.raise_error(F.lit(f"{kind}: {c} is missing"))).otherwise(F.col(c)).alias(c) if c in need else F.col(c) for c in df.columns])


def load_json(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """A JSON document that spans lines."""
    return spark.read.schema(ddl).option("multiLine", True).json(path)


def load_ontology(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """entities, relations and hierarchy (parent, child) of an ontology in one JSON document."""
    raw = load_json(spark, path, f"entities array<struct<{_fields('entity')}>>, relations array<struct<{_fields('relation')}>>, entity_hierarchy map<string, map<string, array<string>>>, central_entity_id string")
    flat = lambda c: raw.select(F.explode(c).alias("x")).select("x.*")
    h = raw.select(F.explode("entity_hierarchy").alias("parent", "groups")).select("parent", F.explode("groups").alias("group", "children")).select("parent", F.explode("children").alias("child"))
    return {"entities": with_defaults(flat("entities"), "entity"), "relations": with_defaults(flat("relations"), "relation"), "hierarchy": h.distinct(), "center": raw.select("central_entity_id")}


def _fields(kind: str) -> str:
    return ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in schema(kind))


def allowed_types(relations: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """(relation_id, role, entity_type): the types each role takes, parents standing for their children too."""
    roles = [relations.select(F.col("id").alias("relation_id"), F.lit(r).alias("role"), F.explode(f"{r}_types").alias("entity_type")) for r in ("subject", "object")]
    own = roles[0].unionByName(roles[1])
    below = own.join(F.broadcast(hierarchy), F.col("entity_type") == F.col("parent")).select("relation_id", "role", F.col("child").alias("entity_type"))
    return own.unionByName(below).distinct()


def load_stop_words(spark: SparkSession, paths: list[str], extra: list[str] = ()) -> DataFrame:
    """(word): lines of the files without blanks around, empty lines and lines that start with ``#`` left out, with ``extra``."""
    words = spark.read.text(paths).select(F.trim("value").alias("word")).where("word <> '' AND NOT startswith(word, '#')")
    if extra:
        words = words.union(spark.createDataFrame([(w,) for w in extra], "word string"))
    return words.distinct()


def load_snapshots(spark: SparkSession, glob: str) -> DataFrame:
    """(folder, content): each snapshot's JSON as VARIANT, by folder."""
    texts = spark.read.option("wholetext", True).text(glob).select(F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1).alias("folder"), F.col("value"))
    return texts.select("folder", F.expr("try_parse_json(value)").alias("content")).orderBy("folder")


def load_bindings(spark: SparkSession, path: str) -> DataFrame:
    """(from, to, label, type) of a SPARQL result in JSON, ids without their prefix; labels that are empty, numbers, or in other scripts than Han and ASCII are left out."""
    from ..functions.text import zh_or_en

    raw = load_json(spark, path, "results struct<bindings: array<map<string, struct<value: string>>>>").select(F.explode("results.bindings").alias("b"))
    value = lambda k: F.coalesce(F.try_element_at("b", F.lit(k))["value"], F.lit(""))
    last = lambda c: F.element_at(F.split(c, "/"), -1)
    rows = raw.select(last(value("s")).alias("from"), last(value("o")).alias("to"), value("oLabel").alias("label"), last(value("oType")).alias("type"))
    return rows.where(zh_or_en(F.col("label")) & ~F.col("label").rlike(r"^\p{Nd}+$"))


KINDS = tuple(DDL)
