"""Small cases worked out by hand, and properties."""

import pytest
from pyspark.sql import functions as F

from skeinkg.functions import text as tx
from skeinkg.operators import discovery, graph, hmm, linking, reasoning, relations, spans, tfidf
from skeinkg.operators.reasoning import Rule

ENT = "id string, name string, aliases array<string>, entity_type string, description string, tags array<string>"
REL = "id string, label string, subject_types array<string>, object_types array<string>, patterns array<string>, subject_direction string, object_direction string, subject_tags array<string>, object_tags array<string>, negative_patterns array<string>, max_distance int, symmetric boolean"
MEN = "mention_id string, sentence_id string, text string, start int, end int, entity_type string, source string, linked_entity_id string, link_score double, is_nil boolean"
FACT = "triple_id string, subject string, relation_id string, object string, confidence double, source string, relation_label string, evidence string"


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_split_and_least_length(spark):
    df = spark.createDataFrame([("你好。。真的吗？是！a",)], "t string")
    assert df.select(tx.split_at_ends(F.col("t"))).first()[0] == ["你好。", "真的吗？", "是！", "a"]
    docs = spark.createDataFrame([(1, "你好。。真的吗？是！a"), (2, None), (3, ""), (4, "一二三四五六。\n\n七八九十一二三！")], "doc_id bigint, text string")
    assert rows(tx.sentence_table(docs), "doc_id", "paragraph_index", "sentence_index") == [(4, 0, 1), (4, 1, 2)]


def test_normalized(spark):
    df = spark.createDataFrame([("﻿甲　 乙\r\n丙\n\n\n\n丁  。\n 戊",), (None,)], "t string")
    got = [r[0] for r in df.select(tx.normalized(F.col("t"))).collect()]
    assert got[1] is None and "\n\n\n" not in got[0] and "\r" not in got[0] and got[0].startswith("甲 乙丙")


def test_tokens_cover_text(spark):
    text = "The 林达机 was built in 1936, né? 😀ok"
    df = spark.createDataFrame([("s", text), ("e", ""), ("n", None)], "k string, text string")
    got = [r for r in tx.token_table(df.where("text IS NOT NULL"), "k").collect()]
    assert all(text[r["start"] : r["end"]] == r["token"] for r in got)
    arr = df.where("k = 's'").select(tx.tokens(F.col("text")).alias("t")).first()["t"]
    assert [(t["text"], t["start"], t["end"]) for t in arr] == [(r["token"], r["start"], r["end"]) for r in sorted(got, key=lambda r: r["token_index"])]


def test_chunks_and_slug(spark):
    df = spark.createDataFrame([("",), ("abcdefg",), ("  ?? ",)], "t string")
    assert [r[0] for r in df.select(tx.chunks(F.col("t"), 3)).collect()] == [[], ["abc", "def", "g"], ["  ?", "? "]]
    assert [r[0] for r in df.select(tx.slug(F.col("t"))).collect()] == ["document", "abcdefg", "document"]


def test_gazetteer_leftmost_longest(spark):
    e = spark.createDataFrame([("c", "林达机", [], "Concept", None, []), ("p", "艾伦·林达", ["林达", "艾伦", "艾伦"], "Person", None, [])], ENT)
    s = spark.createDataFrame([("s1", "林达机和艾伦·林达"), ("s2", None), ("s3", "")], "sentence_id string, text string")
    got = rows(spans.gazetteer(s, e), "mention_id", "start", "end", "text", "entity_type")
    assert got == [("s1-g001", 0, 3, "林达机", "Concept"), ("s1-g002", 4, 9, "艾伦·林达", "Person")]
    assert spans.gazetteer(s.limit(0), e).count() == 0


def test_ascii_aliases_ignore_case_and_overlap(spark):
    e = spark.createDataFrame([("a", "aa", ["Ab"], "X", None, [])], ENT)
    s = spark.createDataFrame([("s", "aaa aB")], "sentence_id string, text string")
    got = rows(spans.occurrences(s, spans.alias_index(e)), "start", "end", "text")
    assert got == [(0, 2, "aa"), (1, 3, "aa"), (4, 6, "aB")]


def _m(spark, *ms):
    return spark.createDataFrame([(f"m{i}", "s", "t", a, b, kind, src, None, 0.0, False) for i, (a, b, kind, src) in enumerate(ms)], MEN)


def test_merge_prefers_gazetteer_then_length_then_order(spark):
    assert rows(spans.merged_methods(_m(spark, (0, 2, "P", "gazetteer"), (0, 5, "P", "crf"))), "start", "end", "source") == [(0, 2, "gazetteer")]
    assert rows(spans.merged_methods(_m(spark, (0, 5, "P", "hmm"), (0, 5, "P", "crf"))), "source") == [("crf",)]
    once = spans.merged_methods(_m(spark, (0, 3, "P", "crf"), (2, 9, "P", "hmm"), (9, 10, "P", "crf")))
    assert rows(once, "start", "end") == [(2, 9), (9, 10)]


def test_bio_round(spark):
    s = spark.createDataFrame([("s", [("ab", 0, 2), ("cd", 2, 4)])], "sentence_id string, tokens array<struct<text:string,start:int,end:int>>")
    got = rows(spans.bio_labels(s, _m(spark, (1, 3, "Person", "crf"))), "token_index", "label")
    assert got == [(0, "B-Person"), (1, "I-Person")]
    tags = spark.createDataFrame([("s", i, i, i + 1, t) for i, t in enumerate(["B-Person", "I-Place", "O", "I-Place"])], "sentence_id string, token_index int, start int, end int, label string")
    assert rows(spans.bio_spans(tags), "span_no", "entity_type", "start") == [(1, "Person", 0), (2, "Place", 1), (3, "Place", 3)]


@pytest.mark.parametrize(("scores", "nil", "score"), [([0.39], True, 0.0), ([0.40], False, 0.40), ([0.9, 0.8, 0.7], False, 0.9), ([0.5, 0.2], False, 0.5)])
def test_nil_threshold(spark, scores, nil, score):
    c = spark.createDataFrame([("m", f"e{i}", x, i + 1) for i, x in enumerate(scores)], "mention_id string, entity_id string, final_score double, rank int")
    r = linking.linked(spark.createDataFrame([("m",), ("none",)], "mention_id string"), c)
    assert rows(r, "mention_id", "is_nil", "link_score") == [("m", nil, score), ("none", True, 0.0)]


def test_type_score(spark):
    df = spark.createDataFrame([("P", "P"), ("Top", "P"), ("P", "Top"), ("P", "Q")], "m string, e string")
    got = [r[0] for r in df.select(linking.type_score(F.col("m"), F.col("e"), {"Top": ["P"]})).collect()]
    assert got == [0.3, 0.2, 0.15, 0.0]


def test_char_grams(spark):
    df = spark.createDataFrame([("ab c",)], "t string")
    assert df.select(tfidf.char_grams(F.col("t"), 2, 4)).first()[0] == [" a", "ab", "b ", " ab", "ab ", " ab ", " c", "c ", " c "]


def _relation(spark, **kw):
    base = {"id": "born_in", "label": "b", "subject_types": ["Person"], "object_types": ["Place"], "patterns": ["出生", "出生于", "生于"], "subject_direction": "before", "object_direction": "after", "subject_tags": [], "object_tags": [], "negative_patterns": [], "max_distance": 40, "symmetric": False} | kw
    return spark.createDataFrame([tuple(base.values())], REL)


def test_pattern_relation(spark):
    e = spark.createDataFrame([("p", "林达", [], "Person", None, []), ("l", "伦敦", [], "Place", None, []), ("k", "剑桥", [], "Place", None, [])], ENT)
    s = spark.createDataFrame([("s", "林达出生于伦敦"), ("t", "林达出生对抗伦敦后剑桥")], "sentence_id string, text string")
    m = spark.createDataFrame([("1", "s", "林达", 0, 2, "Person", "g", "p", 0.8, False), ("2", "s", "伦敦", 5, 7, "Place", "g", "l", 0.6, False)], MEN)
    assert rows(relations.pattern_triples(m, s, _relation(spark), e), "subject", "object", "pattern", "confidence") == [("p", "l", "出生", 0.7)]
    m2 = spark.createDataFrame([("1", "t", "林达", 0, 2, "Person", "g", "p", 0.8, False), ("2", "t", "伦敦", 6, 8, "Place", "g", "l", 0.6, False), ("3", "t", "剑桥", 9, 11, "Place", "g", "k", 0.6, False)], MEN)
    assert rows(relations.pattern_triples(m2, s, _relation(spark, negative_patterns=["对抗"]), e), "object") == []
    assert relations.pattern_triples(m.limit(0), s, _relation(spark), e).count() == 0


def test_gap(spark):
    df = spark.createDataFrame([("before", 0, 2), ("after", 0, 2), ("either", 0, 2), ("either", 4, 6)], "d string, s int, e int")
    got = [r[0] for r in df.select(relations.gap(F.col("d"), F.col("s"), F.col("e"), F.lit(5), F.lit(7))).collect()]
    assert got == [3, None, 3, 0]


def test_conflicts(spark):
    f = spark.createDataFrame([("1", "a", "r1", "b", 0.6, "extracted", "", ""), ("2", "b", "r2", "a", 0.9, "cooccurrence", "", "")], FACT)
    assert rows(relations.settled_unordered(f), "triple_id") == [("1",)]
    assert len(rows(relations.settled_ordered(f), "triple_id")) == 2
    same = spark.createDataFrame([("1", "a", "r1", "b", 0.5, "extracted", "", ""), ("2", "a", "r1", "b", 0.7, "extracted", "", "")], FACT)
    assert len(rows(relations.settled_ordered(same), "triple_id")) == 2
    assert rows(relations.best_per_fact(same), "triple_id") == [("2",)]


@pytest.mark.parametrize(("n", "confidence"), [(1, 0.55), (8, 0.9), (10, 0.9)])
def test_cooccurrence_confidence(spark, n, confidence):
    e = spark.createDataFrame([("a", "A", [], "Person", None, []), ("b", "B", [], "Place", None, [])], ENT)
    s = spark.createDataFrame([(f"s{i}", "A 出生 B") for i in range(n)], "sentence_id string, text string")
    m = spark.createDataFrame([x for i in range(n) for x in ((f"{i}x", f"s{i}", "A", 0, 1, "Person", "g", "a", 0.5, False), (f"{i}y", f"s{i}", "B", 5, 6, "Place", "g", "b", 0.5, False))], MEN)
    assert rows(relations.cooccurrence_triples(m, s, _relation(spark), e, 1), "subject", "object", "matched", "confidence") == [("a", "b", n, confidence)]


def test_rules(spark):
    f = spark.createDataFrame([("1", "p", "decrypted", "enigma", 0.75, "extracted", "", ""), ("2", "p", "decrypted", "tunny", 0.5, "extracted", "", "")], FACT)
    rule = [Rule("r", (("decrypted", "p", "x"),), ("contributed", "p", "war"), 0.8)]
    ents = spark.createDataFrame([("p",), ("war",)], "id string")
    assert rows(reasoning.inferred(f, rule, ents), "subject", "object", "confidence", "supports") == [("p", "war", 0.6, 2)]
    assert reasoning.inferred(f, rule, ents.where("id = 'p'")).count() == 0
    chain = spark.createDataFrame([(str(i), f"n{i}", "r", f"n{i + 1}", 1.0, "extracted", "", "") for i in range(3)], FACT)
    trans = [Rule("t", (("r", "a", "b"), ("r", "b", "c")), ("r", "a", "c"), 0.5)]
    assert rows(reasoning.inferred(chain, trans), "subject", "object") == [("n0", "n2"), ("n1", "n3")]
    assert ("n0", "n3") in rows(reasoning.inferred(chain, trans, rounds=2), "subject", "object")


def test_rules_on_repeated_facts(spark, monkeypatch):
    n = 6_000  # 36 million ways from p by hub to q, if each fact is joined with each
    f = spark.range(2 * n).selectExpr("cast(id AS string) AS triple_id", "'r' AS relation_id", f"if(id < {n}, 'p', 'hub') AS subject", f"if(id < {n}, 'hub', 'q') AS object", f"CASE id WHEN 7 THEN 0.75 WHEN {n} THEN 0.5 WHEN 8 THEN null ELSE 0.25 END AS confidence")
    trans = [Rule("t", (("r", "a", "b"), ("r", "b", "c")), ("s", "a", "c"), 0.5)]
    assert rows(reasoning.inferred(f, trans).selectExpr("*", "support_ids[0] AS first", "size(array_distinct(support_ids)) AS ids"), "subject", "object", "confidence", "supports", "first", "ids") == [("p", "q", 0.25, 2 * n, "0", 2 * n)]
    # an own loop, a way by two middles, a fact that is known, and ids that aren't broadcast
    few = [("1", "a", "a", 0.4), ("2", "a", "b", 0.6), ("3", "a", "b", 0.8), ("4", "b", "d", 0.9), ("5", "a", "c", 0.5), ("6", "c", "d", 0.7), ("7", "d", "e", None), ("8", "b", None, 1.0)]
    g = spark.createDataFrame([(i, "r", s, o, c) for i, s, o, c in few] + [("9", "s", "b", "e", 0.1)], "triple_id string, relation_id string, subject string, object string, confidence double")
    expected = [("a", "b", 0.2, ["1", "2", "3"]), ("a", "c", 0.2, ["1", "5"]), ("a", "d", 0.4, ["2", "3", "4", "5", "6"]), ("c", "e", 0.0, ["6", "7"])]
    assert rows(reasoning.inferred(g, trans), "subject", "object", "confidence", "support_ids") == expected
    monkeypatch.setattr(reasoning, "small_or_shuffled", lambda df: df)
    assert rows(reasoning.inferred(g, trans), "subject", "object", "confidence", "support_ids") == expected


def test_rule_confidences_round_as_in_sql(spark):
    import duckdb

    values = [round(k / 10_000, 4) for k in range(10_001)]
    f = spark.createDataFrame([(f"{k}", "r", f"a{k}", "b", c) for k, c in enumerate(values)], "triple_id string, relation_id string, subject string, object string, confidence double")
    for weight in (0.5, 0.7, 0.8):
        found = dict(rows(reasoning.inferred(f, [Rule("t", (("r", "a", "b"),), ("s", "a", "b"), weight)]), "subject", "confidence"))
        assert found == dict(duckdb.sql(f"SELECT 'a' || k, round(round(k / 10000.0 * {weight}, 9), 4) FROM range(10001) t(k)").fetchall())


def test_component(spark):
    f = spark.createDataFrame([("1", "a", "r", "b", 1.0, "x", "", ""), ("2", "b", "r", "a", 1.0, "x", "", ""), ("3", "c", "r", "d", 1.0, "x", "", "")], FACT)
    n = spark.createDataFrame([(x,) for x in "abcd"], "id string")
    assert rows(graph.component(n, f, "a"), "id") == [("a",), ("b",)]
    assert len(rows(graph.component(n, f, "x"), "id")) == 4
    assert rows(graph.component_ratio(n, f, "a"), "ratio") == [(0.5,)]
    assert rows(graph.component_ratio(n, f, "x"), "ratio") == [(0.0,)]
    assert rows(graph.component_ratio(n.limit(0), f.limit(0), "a"), "ratio") == [(0.0,)]
    loop = spark.createDataFrame([("1", "a", "r", "a", 1.0, "x", "", "")], FACT)
    assert rows(graph.degrees(loop), "id", "degree") == [("a", 2)]


def test_budget(spark):
    p = spark.createDataFrame([("s", "a"), ("s", "a"), ("s", "b"), ("a", "c"), ("s", "s")], "from string, to string")
    assert rows(graph.budgeted(p, ["s"], 2), "from", "to") == [("s", "a")]
    assert len(rows(graph.budgeted(p, ["s"], 9), "from")) == 3


@pytest.mark.parametrize(("n", "same", "removed"), [(5, 5, True), (4, 4, False), (20, 19, False)])
def test_self_links(spark, n, same, removed):
    e = spark.createDataFrame([("d", "X", [], "C", None, [])], ENT)
    m = spark.createDataFrame([(str(i), "s", "X" if i < same else "y", 0, 1, "C", "g", "d", 0.0, False) for i in range(n)], MEN)
    assert (linking.self_linked(m, e).count() == 1) == removed


def test_null_links_survive_removal(spark):
    m = spark.createDataFrame([("1", "s", "t", 0, 1, "C", "g", None, 0.0, True), ("2", "s", "t", 0, 1, "C", "g", "d", 0.0, False)], MEN)
    assert rows(linking.without_removed(m, spark.createDataFrame([("d",)], "id string")), "mention_id") == [("1",)]


def test_neighbour_boost(spark):
    w = spark.createDataFrame([("d", i, x) for i, x in enumerate(["Known", "near", *["x"] * 6, "away"])], "doc_id string, pos int, word string")
    one = lambda *xs: spark.createDataFrame([(x,) for x in xs], "word string")
    got = rows(discovery.neighbour_boost(w, one("stop"), one("known").withColumnRenamed("word", "name")), "word", "boost")
    assert got == [("away", 1), ("near", 8)]


def test_validation_brute(spark):
    texts = ["[①．]abab abab", "abab，abab", "zz abababab"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    names = spark.createDataFrame([("abab",), ("q",), ("the",)], "name string")
    got = rows(discovery.validated(docs, names, spark.createDataFrame([], "name string"), ["the"]), "name", "occurrences")
    assert got == [("abab", sum(t.count("abab") for t in texts))]


def test_fragment_clusters_equal_brute_force(spark):
    e = spark.createDataFrame([("discovered_1", "ab", [], "C", None, []), ("c", "abcd", [], "C", None, [])], ENT)
    texts = ["xx ab yy", "xx ab zz", "xx abcd yy", "xx abcd zz"]
    s = spark.createDataFrame([(f"s{i}", t) for i, t in enumerate(texts)], "sentence_id string, text string")
    m = spark.createDataFrame([(f"m{i}", f"s{i}", "", 3, 5 if i < 2 else 7, "C", "g", "discovered_1" if i < 2 else "c", 0.0, False) for i in range(4)], MEN)
    got = discovery.fragment_clusters(m, s, e, 0.0).first()
    w, _ = tfidf.fitted(s.select(F.col("sentence_id").alias("id"), F.explode(tfidf.char_grams(F.col("text"), 2, 3)).alias("term")))
    v = {}
    for r in w.collect():
        v.setdefault(r["id"], {})[r["term"]] = r["weight"]
    brute = sum(sum(x * v[b].get(k, 0) for k, x in v[a].items()) for a in ("s0", "s1") for b in ("s2", "s3")) / 4
    assert got["canonical"] == "c" and abs(got["similarity"] - brute) < 1e-6


def test_hmm_hand_worked():
    t = hmm.Tagger({"O": 1}, {("O", "B-P"): 1}, {("O", "x"): 1, ("B-P", "y"): 1}, 0.01, ["O", "B-P", "I-P"])
    import numpy as np

    assert np.allclose(np.exp(t.pi)[0], 1.01 / 1.03) and np.allclose(np.exp(t.a)[0, 1], 1.01 / 1.03) and np.allclose(np.exp(t.a)[1], 1 / 3) and np.allclose(np.exp(t.unseen)[2], 1.0)
    assert t.tags(["x", "y"]) == ["O", "B-P"] and t.tags([]) == []


def test_shuffle_partitions_do_not_matter(spark):
    f = spark.createDataFrame([(str(i), f"n{i % 7}", "r", f"n{i % 5}", i / 50, "x", "l", None) for i in range(50)], FACT)
    got = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append(rows(graph.edges(f), "from", "to", "value", "avg_confidence", "evidence"))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got[0] == got[1]
