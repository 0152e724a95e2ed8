"""The tables of the domain, each record once: the version that was loaded first."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import table


def first_versions(df: DataFrame, key: str, version: str = "loaded_at") -> DataFrame:
    """The first row of each ``key`` by ``version`` (nulls first); rows with a null key are left out."""
    by = Window.partitionBy(key).orderBy(F.col(version).asc_nulls_first())
    return df.where(F.col(key).isNotNull()).withColumn("_no", F.row_number().over(by)).where("_no = 1").drop("_no")


def sentences(spark: SparkSession, d: str) -> DataFrame:
    return first_versions(table(spark, d, "sentences"), "sentence_id")


def mentions(spark: SparkSession, d: str) -> DataFrame:
    return first_versions(table(spark, d, "mentions"), "mention_id")


def triples(spark: SparkSession, d: str) -> DataFrame:
    return first_versions(table(spark, d, "triples"), "triple_id")


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("doc_id IS NOT NULL")


def entities(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "entities").where("id IS NOT NULL")


def relations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "relations").where("id IS NOT NULL")
