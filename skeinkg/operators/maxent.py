"""A multinomial logistic tagger on hashed token features, trained on weak labels: a stand-in where no CRF library is at hand.

Fitting looks at no more than ``EXAMPLES`` sentences: those with a label other than O first, then others, by id. Sentences are split for
evaluation by the hash of their id. Fewer than ``LEAST`` examples give no model."""

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import FeatureHasher, IndexToString, StringIndexer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import token_features

EXAMPLES, LEAST, BITS = 1_500, 20, 1 << 14
INPUT = ("lower", "first1", "first2", "last1", "last2", "prev_token", "next_token", "is_digit", "is_ascii", "has_han", "bos", "eos")


def examples(labels: DataFrame, most: int = EXAMPLES, negatives: int = 200) -> DataFrame:
    """(sentence_id) to train on: sentences with labels first, then at most max(their number, ``negatives``) without."""
    s = labels.groupBy("sentence_id").agg(F.max((F.col("label") != "O").cast("int")).alias("pos"))
    top = s.withColumn("rn", F.row_number().over(Window.partitionBy("pos").orderBy("sentence_id"))).where(F.col("rn") <= most)
    have = top.where("pos = 1").count()
    return top.where(f"pos = 1 OR rn <= {max(have, negatives)}").orderBy(F.desc("pos"), "sentence_id").limit(most).select("sentence_id")


def _vectors(sentences: DataFrame) -> DataFrame:
    f = token_features(sentences, "sentence_id").where("token IS NOT NULL")
    f = f.select("sentence_id", "token_index", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in INPUT])
    return FeatureHasher(inputCols=list(INPUT), outputCol="features", numFeatures=BITS).transform(f).select("sentence_id", "token_index", "features")


def fitted(sentences: DataFrame, labels: DataFrame, held_out: int = 5) -> tuple[LogisticRegressionModel, list[str]] | None:
    """(model, label names), trained on four fifths of the examples; None for too few."""
    ids = examples(labels)
    if ids.count() < LEAST:
        return None
    ids = ids.where(F.pmod(F.xxhash64("sentence_id"), F.lit(held_out)) != 0)
    rows = _vectors(sentences.join(F.broadcast(ids), "sentence_id")).join(labels.select("sentence_id", "token_index", "label"), ["sentence_id", "token_index"])
    index = StringIndexer(inputCol="label", outputCol="y", stringOrderType="alphabetAsc").fit(rows)
    model = LogisticRegression(featuresCol="features", labelCol="y", maxIter=75, regParam=1e-4).fit(index.transform(rows).select("features", "y"))
    return model, index.labels


def tagged(sentences: DataFrame, model: LogisticRegressionModel, names: list[str]) -> DataFrame:
    """(sentence_id, token_index, predicted)."""
    p = model.transform(_vectors(sentences))
    return IndexToString(inputCol="prediction", outputCol="predicted", labels=names).transform(p).select("sentence_id", "token_index", "predicted")


def report(pairs: DataFrame) -> DataFrame:
    """(label, precision, recall, f1, support) from (label, predicted), with rows ``macro`` and ``weighted`` over the labels that occur."""
    r = lambda x: F.coalesce(x, F.lit(0.0))
    each = pairs.select(F.explode(F.array(F.struct(F.col("label").alias("l"), F.lit(1).alias("t"), F.lit(0).alias("p"), F.lit(0).alias("b")), F.struct(F.col("predicted").alias("l"), F.lit(0).alias("t"), F.lit(1).alias("p"), (F.col("label") == F.col("predicted")).cast("int").alias("b")))).alias("x")).select("x.*")
    g = each.groupBy(F.col("l").alias("label")).agg(F.sum("t").alias("support"), F.sum("p").alias("n"), F.sum("b").alias("hit"))
    nz = lambda c: F.nullif(F.col(c), F.lit(0))
    m = g.select("label", r(F.col("hit") / nz("n")).alias("precision"), r(F.col("hit") / nz("support")).alias("recall"), "support")
    m = m.withColumn("f1", r(2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)))).select("label", "precision", "recall", "f1", "support")
    s = F.nullif(F.sum("support"), F.lit(0))
    macro = m.agg(F.lit("macro").alias("label"), *[F.avg(c).alias(c) for c in ("precision", "recall", "f1")], F.coalesce(F.sum("support"), F.lit(0)).alias("support"))
    weighted = m.agg(F.lit("weighted").alias("label"), *[(F.sum(F.col(c) * F.col("support")) / s).alias(c) for c in ("precision", "recall", "f1")], F.coalesce(F.sum("support"), F.lit(0)).alias("support"))
    return m.union(macro).union(weighted)
