"""Every query of the text operators on empty tables and on tables with nulls in each column, repeated rows and extra columns with clashing names."""

import pytest
from pyspark.sql import functions as F

from skeinkg.llm import queries

TOK = "array<struct<text: string, start: int, end: int>>"
TABLES = {
    "sentences": f"sentence_id string, document_id string, sentence_index int, text string, tokens {TOK}, loaded_at timestamp",
    "mentions": "mention_id string, sentence_id string, text string, entity_type string, linked_entity_id string, loaded_at timestamp",
    "entities": "id string, name string, aliases array<string>, entity_type string",
    "documents": "doc_id bigint, document_id string, format string, text string, source string, stage string",
    "doc_labels": "doc_id bigint, label string",
    "nicknames": "given_name string, short_name string",
    "common_words": "lang string, word string",
    "mix_targets": "mix_name string, source string, target_share double, max_repeats int",
    "pack_sizes": "pack_name string, capacity int",
}
VALUES = {"text": "Adа Lin, ｔａｐｅ. Dr. Lin said so.", "entity_type": "Person", "aliases": ["Ada Lin"], "name": "艾达·林", "tokens": [("tape", 0, 4)] * 3, "stage": "cleaned", "label": "prose", "target_share": 1.0, "capacity": 16, "max_repeats": 2, "linked_entity_id": None}
CLASH = ("k", "term", "form", "key", "_t", "kind", "size", "position", "pos", "rank", "n", "line", "words", "id_", "look", "bucket", "copy", "visible")


def _row(fields, without=None):
    kinds = {"string": "v", "int": 1, "bigint": 1, "double": 0.5}
    return tuple(None if f.name == without else VALUES.get(f.name, kinds.get(f.dataType.simpleString())) for f in fields)


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("edge")
    for name, ddl in TABLES.items():
        empty = spark.createDataFrame([], ddl)
        empty.write.parquet(f"{base}/empty/{name}.parquet")
        f = empty.schema.fields
        rows = [_row(f), _row(f), tuple(None for _ in f), *(_row(f, c.name) for c in f)]
        df = spark.createDataFrame(rows, ddl)
        df.select("*", *[F.lit("clash").alias(c) for c in CLASH if c not in df.columns]).coalesce(1).write.parquet(f"{base}/nulls/{name}.parquet")
    return base


@pytest.mark.parametrize("name", list(queries.queries()))
def test_edges(spark, folders, name):
    run = queries.queries()[name]
    assert run(spark, f"{folders}/nulls").count() >= 0
    got = run(spark, f"{folders}/empty").collect()
    assert got == [] or name == "p9_shares"


def test_very_long_text(spark):
    from skeinkg.llm import quality, sentences

    long = "word, " * 60_000 + "end."
    docs = spark.createDataFrame([(1, "s", None, long), (2, "s", "html", "<p>" + long)], "doc_id bigint, source string, format string, text string")
    assert quality.document_features(docs).where("word_count > 59000").count() == 2
    assert len(sentences.units(sentences.Model(), long)) >= 1
