"""TF-IDF as long tables (id, term, weight): raw counts, idf = ln((1 + n) / (1 + df)) + 1, unit length.

Document frequencies are joined to the postings by broadcast if the vocabulary is small, else by shuffle. Ids without terms have no rows; n counts the ids that are given."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sizes import small_or_shuffled


def char_grams(text: Column, least: int, most: int) -> Column:
    """Grams of ``least`` to ``most`` characters inside blank-padded words, as array with repeats; a padded word not longer than n gives itself once and no longer grams."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")

    def of(w: Column) -> Column:
        p = F.concat(F.lit(" "), w, F.lit(" "))
        size = F.length(p)
        grams = lambda n: F.when(size > n, F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.substring(p, i, F.lit(n))))
        whole = lambda n: F.when((size <= n) & ((size > n - 1) if n > least else F.lit(True)), F.array(p))
        none = F.array().cast("array<string>")
        return F.flatten(F.array(*[F.coalesce(grams(n), whole(n), none) for n in range(least, most + 1)]))

    return F.flatten(F.transform(words, of))


def counts(terms: DataFrame) -> DataFrame:
    """(id, term, tf) from (id, term)."""
    return terms.where("id IS NOT NULL AND term IS NOT NULL").groupBy("id", "term").agg(F.count("*").alias("tf"))


def vocabulary(tf: DataFrame, n: int, max_df: float = 1.0, min_df: int = 1, max_features: int | None = None) -> DataFrame:
    """(term, idf) of terms in at least ``min_df`` ids and at most the share ``max_df``; the ``max_features`` most frequent, ties by term."""
    v = tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).where((F.col("df") >= min_df) & (F.col("df") <= max_df * n))
    if max_features is not None:
        v = v.orderBy(F.desc("cf"), "term").limit(max_features)
    return v.select("term", (F.log((1.0 + n) / (1.0 + F.col("df"))) + 1).alias("idf"))


def weights(tf: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(id, term, weight) on a fitted vocabulary: unknown terms count neither in products nor in lengths."""
    w = tf.join(small_or_shuffled(vocabulary), "term").select("id", "term", (F.col("tf") * F.col("idf")).alias("w"))
    return w.select("id", "term", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))).alias("weight"))


def fitted(terms: DataFrame, **limits) -> tuple[DataFrame, DataFrame]:
    """(weights, vocabulary) over (id, term)."""
    tf = counts(terms)
    n = tf.select("id").distinct().count()
    v = vocabulary(tf, n, **limits)
    return weights(tf, v), v


def cosines(left: DataFrame, right: DataFrame) -> DataFrame:
    """(id, other, cosine) of all pairs that share a term; ``right`` is broadcast only if small."""
    r = small_or_shuffled(right.select(F.col("id").alias("other"), "term", F.col("weight").alias("_w")))
    return left.join(r, "term").groupBy("id", "other").agg(F.sum(F.col("weight") * F.col("_w")).alias("cosine"))
