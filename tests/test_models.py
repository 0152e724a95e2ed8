from skeinkg.operators import clauses, maxent


def test_report(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("O", "O")], "label string, predicted string")
    got = {r["label"]: r for r in maxent.report(df).collect()}
    assert got["a"]["precision"] == 1 and got["a"]["recall"] == 0.5 and got["b"]["precision"] == 0.5 and got["b"]["support"] == 1
    assert abs(got["macro"]["recall"] - (0.5 + 1 + 1) / 3) < 1e-9 and abs(got["weighted"]["recall"] - 0.75) < 1e-9


def test_tagger_learns(spark):
    s = [(f"s{i}", [("the", 0, 3), ("Ada" if i % 2 else "cat", 4, 7), ("ran", 8, 11)]) for i in range(60)]
    df = spark.createDataFrame(s, "sentence_id string, tokens array<struct<text: string, start: int, end: int>>")
    labels = spark.createDataFrame([(i, k, "B-P" if t[0] == "Ada" else "O") for i, ts in s for k, t in enumerate(ts)], "sentence_id string, token_index int, label string")
    model, names = maxent.fitted(df, labels)
    assert {(r["token_index"], r["predicted"]) for r in maxent.tagged(df, model, names).collect() if int(r["sentence_id"][1:]) % 2} == {(0, "O"), (1, "B-P"), (2, "O")}
    assert maxent.fitted(df, labels.limit(3)) is None


def test_clauses(spark):
    m = spark.createDataFrame([("s", 0, 3, "a", False), ("s", 10, 14, "b", False), ("s", 10, 14, None, True)], "sentence_id string, start int, end int, linked_entity_id string, is_nil boolean")
    e = spark.createDataFrame([("a", "Person"), ("b", "Place")], "id string, entity_type string")
    r = spark.createDataFrame([("left", ["Person"], ["Place"])], "id string, subject_types array<string>, object_types array<string>")
    c = spark.createDataFrame([("s", 0, 3, "leave", 10, 14), ("s", 10, 14, "leave", 0, 3), ("s", 0, 3, None, 10, 14), ("s", 0, 3, "eat", 10, 14)], "sentence_id string, s_start int, s_end int, verb string, o_start int, o_end int")
    v = spark.createDataFrame([("leave", "left")], "verb string, relation_id string")
    assert [(x["subject"], x["object"]) for x in clauses.clause_triples(c, v, m, e, r).collect()] == [("a", "b")]


def test_reestimation_raises_likelihood_and_equals_enumeration(spark):
    import itertools

    import numpy as np

    from skeinkg.operators import hmm

    rng = np.random.default_rng(1)
    m = hmm.BucketModel(["O", "B-P"], rng.dirichlet([1, 1]), rng.dirichlet([1, 1], 2), rng.dirichlet(np.ones(48), 2))
    obs = [3, 5, 3, 7]
    mass, start, moves = 0.0, np.zeros(2), np.zeros((2, 2))
    for path in itertools.product(range(2), repeat=4):
        p = m.pi[path[0]] * np.prod([m.b[s, o] for s, o in zip(path, obs)]) * np.prod([m.a[x, y] for x, y in zip(path, path[1:])])
        mass += p
        start[path[0]] += p
        for x, y in zip(path, path[1:]):
            moves[x, y] += p
    got = m.expected(obs)
    assert np.isclose(got[0], np.log(mass)) and np.allclose(got[1], start / mass) and np.allclose(got[2], moves / mass) and np.isclose(got[3].sum(), 4)
    words = ["Ada", "ran", "1936", "林达"]
    df = spark.createDataFrame([(f"s{i}", [(str(w), 0, 1) for w in rng.choice(words, 5)]) for i in range(40)] + [("e", [])], "sentence_id string, tokens array<struct<text: string, start: int, end: int>>")
    _, seen = hmm.reestimated(m, df, 4, 1e-6)
    assert all(b >= a - 1e-6 for a, b in zip(seen, seen[1:]))
    assert hmm.decoded_buckets(df, m).count() == 200


def test_chain_field_equals_enumeration():
    import itertools
    import random

    import numpy as np

    from skeinkg.operators import crf

    rng, model = np.random.default_rng(1), crf.Chain(["O", "A", "B"])
    model.a, model.s = rng.normal(size=(3, 3)), rng.normal(size=3)
    e = rng.normal(size=(4, 3))
    z, p, moves = model.expected(e)
    score = lambda y: model.s[y[0]] + sum(e[t, k] for t, k in enumerate(y)) + sum(model.a[a, b] for a, b in zip(y, y[1:]))
    every = {y: np.exp(score(y)) for y in itertools.product(range(3), repeat=4)}
    total = sum(every.values())
    assert abs(z - np.log(total)) < 1e-9
    assert all(abs(p[t, k] - sum(v for y, v in every.items() if y[t] == k) / total) < 1e-9 for t in range(4) for k in range(3))
    assert all(abs(moves[a, b] - sum(v * sum((x, w) == (a, b) for x, w in zip(y, y[1:])) for y, v in every.items()) / total) < 1e-9 for a in range(3) for b in range(3))
    # a label that only the one before tells: the second of two unknown words behind "von"
    random_ = random.Random(2)
    words = lambda: random_.choice("abcdefgh") + random_.choice("klmnop")
    data = []
    for _ in range(300):
        x, y = words(), words()
        data.append((["von", x, y, "sagt"], ["O", "B-P", "I-P", "O"]) if random_.random() < 0.5 else (["das", x, y, "sagt"], ["O", "O", "O", "O"]))
    model = crf.Chain(["O", "B-P", "I-P"]).fit(data[:200], 6)
    assert sum(model.tags(t) == y for t, y in data[200:]) >= 95 and model.tags([]) == []
