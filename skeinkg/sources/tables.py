"""Reading the parquet tables of a directory."""

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The parquet table ``name`` under ``directory``; columns are pruned by whoever selects from it."""
    return spark.read.parquet(f"{directory}/{name}.parquet")
