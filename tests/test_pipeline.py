"""Sources, the whole run on a small corpus, streaming."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from skeinkg.operators import store
from skeinkg.operators.reasoning import Rule
from skeinkg.plans.pipeline import Run
from skeinkg.plans.report import write_report
from skeinkg.schemas import schema
from skeinkg.sources import books, records
from skeinkg.streaming import mentions as stream

ENTITIES = [
    {"id": "linda", "name": "林达", "aliases": ["艾伦·林达"], "entity_type": "Person", "tags": ["m"]},
    {"id": "london", "name": "伦敦", "aliases": [], "entity_type": "Place"},
    {"id": "enigma", "name": "密码机", "entity_type": "Artifact"},
    {"id": "war", "name": "二战", "entity_type": "Event"},
]
RELATIONS = [{"id": "born_in", "label": "出生于", "subject_types": ["Person"], "object_types": ["Place"], "patterns": ["出生于", "出生"]}, {"id": "decrypted", "label": "破译", "subject_types": ["Person"], "object_types": ["Artifact"], "patterns": ["破译"]}]


@pytest.fixture(scope="module")
def run(spark):
    e = records.with_defaults(spark.createDataFrame(ENTITIES, schema("entity")), "entity")
    r = records.with_defaults(spark.createDataFrame(RELATIONS, schema("relation")), "relation")
    return Run(e, r, "linda", [Rule("r", (("decrypted", "p", "x"),), ("contributed", "p", "war"), 0.8)], methods=("gazetteer", "hmm"))


def test_run(spark, run, tmp_path):
    docs = spark.createDataFrame([("d1", "甲", "p", "txt", "艾伦·林达出生于伦敦的医院。\n\n后来林达破译了密码机密码！没有别的。"), ("d2", "乙", "p", "txt", None), ("d3", "丙", "p", "txt", "")], schema("document"))
    got = run(docs)
    facts = {(r["subject"], r["relation_id"], r["object"], r["source"]) for r in got["facts"].collect()}
    assert facts == {("linda", "born_in", "london", "extracted"), ("linda", "decrypted", "enigma", "extracted"), ("linda", "contributed", "war", "inferred")}
    s = {r["sentence_id"]: r["text"] for r in got["sentences"].collect()}
    for m in got["mentions"].collect():
        assert s[m["sentence_id"]][m["start"] : m["end"]] == m["text"]
    assert {r["id"] for r in got["focused_nodes"].collect()} == {"linda", "london", "enigma", "war"}
    out = store.export(str(tmp_path / "out"), run.entities, run.relations, got["mentions"], got["facts"], "linda")
    assert out["facts"] == 3 and json.loads((tmp_path / "out/summary.json").read_text())["facts"] == 3
    assert spark.read.text(str(tmp_path / "out/facts.nt")).count() == 3
    write_report(str(tmp_path / "r.html"), "图", got["nodes"], got["edges"], got["metrics"])
    assert "破译" in (tmp_path / "r.html").read_text()
    triples = tmp_path / "t.jsonl"
    triples.write_text('{"triple_id": "1", "relation_id": "r", "subject_entity_id": "a", "object_entity_id": "b", "confidence": 0.5, "extra": 1}\n\n')
    assert records.load(spark, str(triples), "triple").first()["source"] == "extracted"


def test_run_on_nothing(spark, run):
    got = run(spark.createDataFrame([], schema("document")))
    assert got["facts"].count() == 0 and got["nodes"].count() == 0 and got["metrics"].where("value <> 0").count() == 0


def test_run_with_all_methods_and_discovery(spark, run):
    # "drumset" is in no ontology, but stands beside a known name; the subject's type is a child of the relation's
    text = "。".join(["艾伦·林达出生于伦敦的医院", "Linda drumset 和林达破译了密码机密码", "drumset Linda 买的很重要", "林达先生的 drumset Linda 说"]) + "。"
    docs = spark.createDataFrame([(f"d{i}", "甲", "p", "txt", (text + "\n\n") * 3) for i in range(4)], schema("document"))
    agents = run.relations.withColumn("subject_types", F.array(F.lit("Agent")))
    known = run.entities.withColumn("aliases", F.when(F.col("id") == "linda", F.array(F.lit("艾伦·林达"), F.lit("Linda"))).otherwise(F.col("aliases")))
    whole = Run(known, agents, "linda", run.rules, {"Agent": ["Person"]}, methods=("gazetteer", "crf", "hmm", "hmm_buckets"), discover=True, least_confidence=0.1)
    got = whole(docs)
    assert ("linda", "born_in", "london") in {(r["subject"], r["relation_id"], r["object"]) for r in got["facts"].collect()}
    new = {r["name"] for r in whole.discovered(docs).collect()}
    assert "drumset" in new
    # it only ever names itself, so it is gone after linking
    assert not {r["id"] for r in got["entities"].collect() if r["id"].startswith("discovered_") and r["name"] == "drumset"}
    assert {r["metric"]: r["value"] for r in got["summary"].collect()}["document_count"] == 4
    with pytest.raises(ValueError):
        Run(run.entities, run.relations, "linda", methods=("spell",))


def test_missing_required_value_fails(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"triple_id": "1"}\n')
    with pytest.raises(Exception, match="is missing"):
        records.load(spark, str(tmp_path / "m.jsonl"), "triple").collect()


def test_ontology_and_types(spark, tmp_path):
    p = tmp_path / "o.json"
    p.write_text(json.dumps({"entities": ENTITIES, "relations": [RELATIONS[0] | {"subject_types": ["Agent"]}], "entity_hierarchy": {"Agent": {"g": ["Person"]}}, "central_entity_id": "linda"}, indent=1))
    o = records.load_ontology(spark, str(p))
    assert o["entities"].count() == 4 and o["relations"].first()["max_distance"] == 80 and o["center"].first()[0] == "linda"
    got = {tuple(r) for r in records.allowed_types(o["relations"], o["hierarchy"]).collect()}
    assert got == {("born_in", "subject", "Agent"), ("born_in", "subject", "Person"), ("born_in", "object", "Place")}


def test_small_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# note\nthe\n\n the \nof\n")
    assert {r[0] for r in records.load_stop_words(spark, [str(tmp_path / "a.txt")], ["is"]).collect()} == {"the", "of", "is"}
    (tmp_path / "s1").mkdir()
    (tmp_path / "s1/snapshot.json").write_text('{"a": 1}')
    assert records.load_snapshots(spark, str(tmp_path / "*/snapshot.json")).select("folder", F.expr("variant_get(content, '$.a', 'int')")).first()[:] == ("s1", 1)
    v = lambda x: {"value": x}
    (tmp_path / "b.json").write_text(json.dumps({"results": {"bindings": [{"s": v("x/Q1"), "o": v("x/Q2"), "oLabel": v("名")}, {"s": v("x/Q1"), "o": v("x/Q3"), "oLabel": v("12")}, {"s": v("x/Q1"), "o": v("x/Q4"), "oLabel": v("имя")}]}}))
    assert [r["to"] for r in records.load_bindings(spark, str(tmp_path / "b.json")).collect()] == ["Q2"]


def test_books(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "One.EPUB", "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="c"><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></container>')
        z.writestr("o/p.opf", '<package xmlns="p"><manifest><item id="b" href="b.xhtml" media-type="application/xhtml+xml"/><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/><item id="c" href="no.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="b"/><itemref idref="c"/><itemref idref="a"/></spine></package>')
        z.writestr("o/a.xhtml", "<p>second</p><script>x</script>")
        z.writestr("o/b.xhtml", "<h1>First &amp; best</h1><style>y</style>")
    (tmp_path / "two.pdf").write_bytes(b"%PDF")
    (tmp_path / "three.txt").write_text("no")
    got = {r["format"]: r for r in books.book_documents(books.book_files(spark, str(tmp_path)), lambda c: [" page ", "", "end"]).collect()}
    assert got["epub"]["text"].startswith("First & best") and got["epub"]["text"].endswith("second") and got["epub"]["title"] == "First & best"
    assert got["pdf"]["text"] == "page\n\nend" and got["pdf"]["document_id"].startswith("doc_0")
    bad = books.book_documents(books.book_files(spark, str(tmp_path)).where("path LIKE '%pdf'")).first()
    assert bad["text"] is None and "PDF" in bad["error"] and bad["title"] == "two"


def test_stream(spark, run, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text(json.dumps({"document_id": "d", "text": "艾伦·林达出生于伦敦的医院。"}, ensure_ascii=False))
    q = stream.start_mentions(stream.document_stream(spark, str(tmp_path / "in")), run.entities, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert sorted(r["text"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["伦敦", "艾伦·林达"]
