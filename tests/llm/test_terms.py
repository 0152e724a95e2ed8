import math
import random
from collections import Counter

from pyspark.sql import functions as F

from skeinkg.llm import terms

TOK = "array<struct<text: string, start: int, end: int>>"


def test_counts_equal_brute_force(spark):
    rng = random.Random(1)
    data = [(f"r{i}", [rng.choice("abcdefgh") * 2 if rng.random() < 0.6 else "hot" for _ in range(rng.randrange(0, 30))]) for i in range(300)]
    df = spark.createDataFrame(data, "id string, terms array<string>").repartition(5)
    old, terms.FLUSH = terms.FLUSH, 3
    try:
        got = {r["term"]: (r["occurrences"], r["records"]) for r in terms.term_counts(df).collect()}
    finally:
        terms.FLUSH = old
    occ, rec = Counter(t for _, ts in data for t in ts), Counter(t for _, ts in data for t in set(ts))
    assert got.pop("") == (300, 300) and got == {t: (occ[t], rec[t]) for t in occ}


def test_marks(spark):
    df = spark.createDataFrame([("common",)] * 60 + [("once",), ("",), (None,)], "t string").select(F.array("t").alias("terms"))
    got = {r["term"]: r["mark"] for r in terms.marked_terms({"f": df}).collect()}
    assert got == {"common": "common", "once": "rare"}
    assert terms.marked_terms({"f": df.limit(0)}).count() == 0


def test_sentence_terms(spark):
    rows = [("s1", "d", [("The", 0, 3), ("ｔａｐｅ", 4, 8), (".", 8, 9)]), ("s1", "d", [("The", 0, 3), ("ｔａｐｅ", 4, 8), (".", 8, 9)]), ("s2", "d", []), ("s3", "d", None), (None, "d", [("x", 0, 1)])]
    got = terms.sentence_terms(spark.createDataFrame(rows, f"sentence_id string, document_id string, tokens {TOK}")).collect()
    assert [(r["sentence_id"], r["terms"]) for r in got] == [("s1", ["the", "tape", ""])]


def test_divergence(spark):
    docs = {"a": ["x", "x", "y"], "b": ["y", "z"], "c": []}
    df = spark.createDataFrame([(k, v) for k, v in docs.items()] + [(None, ["q"])], "doc string, terms array<string>")
    got = {(r["doc"], r["term"]): r["score"] for r in terms.term_divergence(df, "doc", mu=10).collect()}
    cf, size = Counter(t for v in docs.values() for t in v), 5
    for d, v in docs.items():
        for t, k in Counter(v).items():
            p = cf[t] / size
            q = (k + 10 * p) / (len(v) + 10)
            assert abs(got[d, t] - q * math.log(q / p)) < 1e-9
    assert len(got) == 4 and terms.term_divergence(df.limit(0), "doc").count() == 0


def test_scores_with_a_minimum_of_documents(spark, tmp_path):
    from skeinkg.llm import queries

    rows = [("s1", "a", ["xx", "xx", "yy", "1"]), ("s2", "b", ["yy", "zz"]), ("s3", "c", ["yy", "xx"])]
    spark.createDataFrame([(s, d, [(t, 0, 1) for t in ts]) for s, d, ts in rows], f"sentence_id string, document_id string, tokens {TOK}").write.parquet(f"{tmp_path}/sentences.parquet")
    got = [(r["document_id"], r["term"], r["df"], r["rank"]) for r in queries.p4_scores(spark, str(tmp_path)).orderBy("document_id", "rank").collect()]
    assert got == [("a", "xx", 2, 1), ("a", "yy", 3, 2), ("b", "yy", 3, 1), ("c", "xx", 2, 1), ("c", "yy", 3, 2)]
    assert not any(g[1] in ("zz", "1") for g in got)
