"""Every core query on empty tables, and on tables with nulls in each column, repeated rows, and extra columns with clashing names."""

import pytest
from pyspark.sql import functions as F

from skeinkg import oracle, queries
from skeinkg.schemas import DDL

TABLES = {f"{k}s" if k != "entity" else "entities": v for k, v in DDL.items() if k != "document"}
TABLES = {k: v + (", loaded_at timestamp" if k in ("sentences", "mentions", "triples") else "") for k, v in TABLES.items()} | {
    "documents": "doc_id bigint, document_id string, title string, source_path string, format string, text string, lang string, source string, n_chars bigint, stage string, work_id string, created_at timestamp, loaded_at timestamp",
    "raw_records": "raw_id bigint, received_at timestamp, origin string, payload string",
    "common_words": "lang string, word string",
}
VALUES = {"text": "Ada 出生于 Rome. x", "name": "Ada", "aliases": ["Ada", "A"], "patterns": ["出生于"], "subject_types": ["T"], "object_types": ["T"], "entity_type": "T", "tokens": [("Ada", 0, 3)], "start": 0, "end": 3, "payload": '{"document_id": "d"}', "word": "the", "max_distance": 40, "source": "crf", "confidence": 0.5}
CLASH = ("k", "term", "form", "key", "_t", "kind", "size", "position", "pos", "rank", "n", "alias")


def _row(fields, without=None):
    kinds = {"string": "v", "int": 1, "bigint": 1, "double": 0.5, "boolean": False}
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


#: Queries that give rows (of zeros or bounds) for empty tables.
ALWAYS = ("component_ratio", "projection_stats", "pipeline_metrics", "quality_metrics", "run_summary", "boundary_metrics", "confidence_histogram", "center_component", "maxent_report", "crf_report")
#: Rows of the table of nulls: one for each id that isn't null, of tables with versions one for each id.
DEFINED = {"normalize_documents": 14, "slug_titles": 14, "document_texts": 14, "entity_rows": 8, "fact_rows": 1, "exported_facts": 1, "relation_distribution": 1, "jsonl_sentences": 1, "run_summary": 7, "alias_index": 4, "conflicting_pairs": 0, "p2_found": 0}


@pytest.mark.parametrize("name", list(queries.queries()))
def test_edges(spark, folders, name):
    run = queries.queries()[name]
    odd, empty = run(spark, f"{folders}/nulls"), run(spark, f"{folders}/empty")
    rows, none = odd.collect(), empty.collect()
    assert odd.columns == empty.columns and [t for _, t in odd.dtypes] == [t for _, t in empty.dtypes]
    assert len(rows) == DEFINED.get(name, len(rows))
    assert none == [] or name in ALWAYS


def test_every_sql_has_its_query():
    assert set(oracle.oracle_sql()) <= set(queries.queries())
