from pyspark.sql import functions as F

from skeinkg.functions.sample import least_hashed


def test_least_hashed(spark):
    df = spark.range(20_000).withColumn("k", F.concat(F.lit("d"), F.col("id").cast("string")))
    got = least_hashed(df, "k", 500)
    first = [r["k"] for r in df.orderBy(F.xxhash64("k")).limit(500).collect()]
    assert 500 <= got.count() < 3_000 and set(first) <= {r["k"] for r in got.collect()}
    assert least_hashed(df.limit(0), "k", 5).count() == 0 and least_hashed(df.limit(3), "k", 5).count() == 3
