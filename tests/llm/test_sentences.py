import random

from skeinkg.llm import queries
from skeinkg.llm import sentences as Z

PARTS = {
    "en": ["Dr. Ada Lin drew the plan.", "The parts came from Torfield, Norwold, etc.", "It ran for 3.5 hours... and then it stopped.", '"We are done. Go home," Mr. Bell said.', "Ada asked: \"Who ordered it?\"", "They met at 9 a.m. on 3 May and voted.", "The rule held until 10 p.m.", "J. R. Bell paid for it!"],
    "zh": ["机器运行了2.5小时……然后停了。", "艾达问道：“是谁订的？”", "“真的吗？我不信。”贝尔说道。", "他们又订购了一个磁鼓。", "谁也说不清！"],
}


def corpus(rng, n=400):
    return [[rng.choice(PARTS[lang]) for _ in range(6)] for lang in rng.choices(list(PARTS), k=n)]


def test_learns_boundaries():
    rng = random.Random(3)
    docs = corpus(rng)
    train = [[*d[:3], d[3] + (" " if d[3][0] < "z" else "") + d[4], d[5]] if rng.random() < 0.1 else d for d in docs]
    model = Z.trained_model(train)
    right = total = 0
    for d in corpus(rng, 60):
        text = ("" if d[0][0] > "z" or d[0][0] == "“" else " ").join(d)
        got = [text[a:b] for a, b in Z.units(model, text)]
        right += len(set(got) & set(d))
        total += len(set(d) | set(got))
    assert right / total > 0.97


def test_blank_lines_offsets_and_edges():
    model = Z.trained_model(corpus(random.Random(4), 50))
    text = "  Title without end\n\nOne line\nbroken here. \u200bDr. Ada Lin drew the plan.  "
    got = [text[a:b] for a, b in Z.units(model, text)]
    assert got[0] == "Title without end" and all(x == x.strip() for x in got) and got[-1].endswith("plan.")
    for empty in (None, "", " \n\n "):
        assert Z.units(model, empty) == []
    long = "word " * 6000
    assert Z.units(model, long)[0][0] == 0 and Z.units(Z.Model(), "A b. C d.")


def test_posteriors_equal_enumeration():
    model = Z.trained_model(corpus(random.Random(5), 80))
    words = [model.name(w) for w in ("asked", ".", "J", ".", "R", ".", "Bell", "paid")]
    gaps = (1, 3, 5)
    h = model.order - 1
    mass, by = 0.0, [0.0] * 3
    for mask in range(8):
        state, p = tuple(words[: gaps[0] + 1])[-h:], 1.0
        for j in range(gaps[0], len(words) - 1):
            if j in gaps and mask >> gaps.index(j) & 1:
                p *= Z.BIAS * model.p(state, Z.EDGE)
                state = (*state, Z.EDGE)[-h:]
            p *= model.p(state, words[j + 1])
            state = (*state, words[j + 1])[-h:]
        mass += p
        for k in range(3):
            by[k] += p * (mask >> k & 1)
    assert all(abs(a - b / mass) < 1e-9 for a, b in zip(model._chain(tuple(words), gaps), by))


def test_in_spark(spark):
    model = Z.trained_model(corpus(random.Random(6), 50))
    rows = spark.createDataFrame([("document", "1", "他们又订购了一个磁鼓。谁也说不清！"), ("document", "2", None), ("document", "3", "谁也说不清！")], "record_kind string, record_id string, text string")
    assert [tuple(r) for r in Z.segmented(rows, model, 2).orderBy("sent_no").collect()] == [("document", "1", 1, 0, 11), ("document", "1", 2, 11, 17)]
    assert Z.segmented(rows.limit(0), model).count() == 0


def test_unpunctuated_text_is_cut_and_short_units_are_not():
    rng = random.Random(9)
    names, acts, things = ["Ada Lin", "Mr Bell", "The old clerk", "A young nurse"], ["drew", "sold", "found", "lost"], ["the plan", "a drum", "two tapes", "her key"]
    zh = [[a + b + c for a in ("艾达", "贝尔先生", "老店员") for b in ("画了", "卖掉", "找到") for c in ("图纸", "磁鼓", "钥匙")]]
    make = lambda: f"{rng.choice(names)} {rng.choice(acts)} {rng.choice(things)}"
    docs = [[make() + "." for _ in range(6)] for _ in range(200)] + [[rng.choice(zh[0]) + "。" for _ in range(6)] for _ in range(200)]
    model = Z.trained_model(docs)
    for units, gap in (([make() for _ in range(12)], " "), ([rng.choice(zh[0]) for _ in range(12)], "")):
        text = gap.join(units)
        got = [text[a:b] for a, b in Z.units(model, text)]
        assert len(set(got) & set(units)) / len(set(units) | set(got)) > 0.9
        # one mark at the end, or an abbreviation's, doesn't switch it off
        marked = text + ("。" if gap == "" else ".")
        got = [marked[a:b].rstrip(".。") for a, b in Z.units(model, marked)]
        assert len(set(got) & set(units)) / len(set(units) | set(got)) > 0.9
    for one in ("Ada Lin drew the plan", "艾达画了图纸", "Title", "Ada Lin sold the plan."):
        assert Z.units(model, one) == [(0, len(one))]


def same(got, expected):
    assert got.order == expected.order and got.vocabulary == expected.vocabulary and got.long == expected.long
    for a, b in ((got.counts, expected.counts), (got.totals, expected.totals)):
        assert len(a) == len(b) and all(a.get(g) == n for g, n in b.items()) and a.get(("no", "such", "gram"), 7) == 7
    assert (got.bare is None) == (expected.bare is None)
    if got.bare:
        same(got.bare, expected.bare)


def test_all_records_train_the_model(spark, tmp_path, monkeypatch):
    # more records than a sample of 20,000 would hold; rare words, repeated and empty rows, records that are cut or torn
    rng = random.Random(12)
    docs = [[*d[:2], d[2] + (" " if d[2][0] < "z" else "") + d[3] if rng.random() < 0.2 else d[3], f"Word{i % 900} {rng.choice(['ran', 'sat'])} here", "Dr.", "Ada Lin drew the plan."] for i, d in enumerate(corpus(rng, 3500))]
    rows = [(f"d{i}", k, f"s{i}-{k}", t) for i, d in enumerate(docs) for k, t in enumerate(d)]
    rng.shuffle(rows)
    odd = [*rows[:50], ("d1", 9, "x", None), (None, 0, "y", "No document here."), ("d2", 9, "z", " ")]
    spark.createDataFrame(rows + odd, "document_id string, sentence_index int, sentence_id string, text string").write.parquet(f"{tmp_path}/sentences.parquet")
    spark.createDataFrame([(1, "cleaned", "Ada Lin drew the plan. It sat here.")], "doc_id bigint, stage string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    models, segmented = [], Z.segmented
    monkeypatch.setattr(Z, "segmented", lambda rows, model, least=1: models.append(model) or segmented(rows, model, least))
    assert queries.p6_found(spark, str(tmp_path)).where("record_kind = 'document'").count() == 2
    same(models[0], Z.trained_model(docs))


def test_no_records_train_an_empty_model(spark):
    none = spark.createDataFrame([], "document_id string, sentence_index int, sentence_id string, text string")
    same(Z.fitted(none), Z.trained_model([]))
