import json

from skeinkg.operators.nested import KINDS, all_links, nested_links


def _links(spark, payloads):
    df = spark.createDataFrame([(i, p, "x") for i, p in enumerate(payloads, 1)], "raw_id bigint, payload string, child_id string")
    return sorted(tuple(r) for r in all_links(df).collect())


def test_shapes(spark):
    doc = {
        "document_id": "d",
        "sentences": {"sentence_id": "s", "tokens": json.dumps([{"text": "a"}, None, {"text": "b"}]), "mentions": {"mention_id": "m", "candidates": {"total": 2, "items": [None, {"entity_id": "e"}]}}},
        "mentions": [{"mention_id": "n", "sentence_id": "s", "candidates": []}],
        "triples": [{"triple_id": "t", "support_triple_ids": "u|v"}, {"triple_id": "w", "support_triple_ids": [{"triple_id": "x"}, None, "y"]}, {"triple_id": "z", "support_triple_ids": ""}],
    }
    expected = [
        (1, "candidate", "m", 2, "e"), (1, "mention", "s", 1, "m"), (1, "mention", "s", 1, "n"), (1, "sentence", "d", 1, "s"), (1, "support", "t", 1, "u"), (1, "support", "t", 2, "v"),
        (1, "support", "w", 1, "x"), (1, "support", "w", 3, "y"), (1, "token", "s", 1, "a"), (1, "token", "s", 3, "b"), (1, "triple", "d", 1, "t"), (1, "triple", "d", 2, "w"), (1, "triple", "d", 3, "z"),
    ]
    for payload in (doc, {"document": doc}, {"batch": {"documents": [doc]}}):
        assert _links(spark, [json.dumps(payload)]) == sorted(expected)


def test_invalid_payloads_give_nothing(spark):
    good = '{"document_id": "d", "sentences": [{"sentence_id": "s", "tokens": [["a", 0, 1]]}]}'
    bad = [None, "", "{", good[:-1], good + " x", "[" + good, '"text"', "null", "3"]
    assert _links(spark, bad) == []
    assert len(_links(spark, [good, good])) == 4


def test_empty_table(spark):
    empty = spark.createDataFrame([], "raw_id bigint, payload string")
    assert all_links(empty).count() == 0
    assert set(nested_links(empty)) == set(KINDS)


def test_candidates_as_a_map_in_written_order(spark):
    doc = {"document_id": "d", "sentences": [{"sentence_id": "s", "mentions": [{"mention_id": "m1", "candidates": {"z": {"x": 1}, "a": {"x": 2}, "n": None, "k": {}}}, {"mention_id": "m2", "candidates": {"a": {}, "z": {}}}]}]}
    df = spark.createDataFrame([(1, json.dumps(doc))], "raw_id bigint, payload string")
    got = sorted((r["parent_id"], r["child_no"], r["child_id"]) for r in nested_links(df)["candidate"].collect())
    assert got == [("m1", 1, "z"), ("m1", 2, "a"), ("m1", 4, "k"), ("m2", 1, "a"), ("m2", 2, "z")]
