import random

import pytest
from pyspark.sql import functions as F

from skeinkg.llm import variants as V

ENT = "id string, name string, aliases array<string>, entity_type string"
E = [
    ("p1", "伊蕾娜·塞尔维茨", ["Irène Serrvitz", "Serrvitz", "塞尔维茨"], "Person"), ("p2", "罗伯特·佐尔森", ["Robert Zorsen"], "Person"), ("p3", "玛格丽特·佐尔森", ["Margaret Zorsen"], "Person"), ("p4", "理查德·马恩代尔", ["Richard Marndale"], "Person"),
    ("o1", "诺尔黑文密码局", ["Norhaven Cipher Bureau"], "Organization"), ("o2", "诺尔黑文工程学院", ["Norhaven College of Engineering"], "Organization"), ("l1", "诺尔黑文", ["Norhaven"], "Place"),
]


@pytest.mark.parametrize(
    ("text", "kind", "expected"),
    [
        ("Serrvitz, Irène", "Person", "p1"), ("SERRVITZ, I.", "Person", "p1"), ("Irene Serrvitz", "Person", "p1"), ("Irène Servritz", "Person", "p1"), ("Irène R. Serrvitz", "Person", "p1"), ("I. 塞尔维茨", "Person", "p1"), ("塞尔维茨，伊蕾娜", "Person", "p1"), ("伊蕾娜·Serrvitz", "Person", "p1"),
        ("Bob Zorsen", "Person", "p2"), ("R. Zorsen", "Person", "p2"), ("Zorsen", "Person", None), ("Irène Zorsen", "Person", None), ("Robert Marndale", "Person", None), ("Marndale", "Person", "p4"),
        ("Cipher Bureau of Norhaven", "Organization", "o1"), ("CB Norhaven", "Organization", "o1"), ("诺尔黑文市密码局", "Organization", "o1"), ("密码局（诺尔黑文）", "Organization", "o1"), ("诺尔黑文密局", "Organization", "o1"), ("Coll. of Engg., Norhaven", "Organization", "o2"), ("CoE Norhaven", "Organization", "o2"), ("Norhaven工程学院", "Organization", "o2"),
        ("Irène Serrvitz", "Person", None), ("irène serrvitz", "Person", None), ("Irènе Serrvіtz", "Person", None), ("", "Person", None), (None, "Person", None), ("Irene Serrvitz", "Place", None),
    ],
)
def test_links(links, text, kind, expected):
    assert links.get((text, kind)) == expected


@pytest.fixture(scope="module")
def links(spark):
    cases = [(a, b) for a, b, _ in test_links.pytestmark[0].args[1]]
    ms = spark.createDataFrame([(f"{t}|{k}", t, k, None) for t, k in cases * 2] + [("x", "Irene Serrvitz", "Person", "p1")], "mention_id string, text string, entity_type string, linked_entity_id string")
    nick = spark.createDataFrame([("Robert", "Bob"), (None, "x")], "given_name string, short_name string")
    got = V.variant_links(ms, spark.createDataFrame(E, ENT), nick).collect()
    assert "x" not in {r["mention_id"] for r in got}
    return {tuple(r["mention_id"].split("|")): r["entity_id"] for r in got}


def test_collision_curve():
    bands, rows = V.bands_for(0.5, 0.95)
    assert 1 - (1 - 0.5**rows) ** bands >= 0.95
    rng = random.Random(2)
    hit = n = 0
    for _ in range(300):
        a = {rng.randrange(1 << 32) for _ in range(20)}
        b = set(list(a)[:14]) | {rng.randrange(1 << 32) for _ in range(6)}
        t = len(a & b) / len(a | b)
        bands, rows = V.bands_for()
        x, y = V.signature(list(a))[: bands * rows].reshape(bands, rows), V.signature(list(b))[: bands * rows].reshape(bands, rows)
        hit += bool((x == y).all(1).any())
        n += 1 - (1 - t**rows) ** bands
    assert abs(hit - n) < 12


def test_empty(spark):
    ms = spark.createDataFrame([], "mention_id string, text string, entity_type string, linked_entity_id string")
    assert V.variant_links(ms, spark.createDataFrame(E, ENT)).count() == 0
    assert V.variant_links(ms, spark.createDataFrame([], ENT)).count() == 0


def test_no_learned_pair_is_cut(spark, monkeypatch):
    # 10,500 Han segments of two families each, and a pet name of three families, one of which explains it otherwise
    han = spark.range(10_500).selectExpr("'han' AS kind", "concat('x', id) AS name", "concat('y', id) AS written", "explode(array('F1', 'F2')) AS family")
    nick = [("nick", "Helene", "Lenny", f) for f in "ABC"] + [("nick", "Leonard", "Lenny", f) for f in "CD"] + [("nick", "Robert", "Bobbin", f) for f in "AB"]
    seen = han.unionByName(spark.createDataFrame(nick, "kind string, name string, written string, family string"))
    monkeypatch.setattr(V, "_teacher", lambda names: lambda batches: batches)
    forms = seen.select(F.struct("*").alias("form"))
    monkeypatch.setattr(type(forms), "mapInArrow", lambda self, f, schema: self.select("form.*"))
    names = V.Names([], [])
    V._learn(names, forms)
    assert len([n for n in names.alike if n.startswith("x")]) == 10_500
    assert names.short["Bobbin"] == {"Robert"} and not names.short.get("Lenny")
    monkeypatch.setattr(V, "MOST_LEARNED", 10_000, raising=False)
    with pytest.raises(ValueError):
        V._learn(names, forms)


def test_stars_equal_brute_force(spark):
    rng = random.Random(3)
    nodes = [f"n{i}" for i in range(40)]
    links = {tuple(sorted(rng.sample(nodes[:34], 2))): round(rng.random(), 3) for _ in range(60)}
    got = V.star_clusters(spark.createDataFrame([(n,) for n in nodes], "id string"), spark.createDataFrame([(*k, s) for k, s in links.items()], "a string, b string, similarity double")).collect()
    h = {r["id"]: r["h"] for r in spark.createDataFrame([(n,) for n in nodes], "id string").select("id", F.xxhash64("id").alias("h")).collect()}
    near = {n: {b if a == n else a: s for (a, b), s in links.items() if n in (a, b)} for n in nodes}
    undecided, centers = set(nodes), set()
    while undecided:  # the greedy order
        c = max(undecided, key=lambda n: (len(near[n]), h[n]))
        centers.add(c)
        undecided -= {c, *near[c]}
    assert {r["id"] for r in got if r["id"] == r["center"]} == centers and len(got) == 40
    for r in got:
        if r["id"] not in centers:
            assert r["center"] in centers and r["similarity"] == max(s for n, s in near[r["id"]].items() if n in centers)


def test_variants_without_an_entity_are_clustered(spark):
    texts = ["Gustav Ollenberg"] * 3 + ["Ollenberg, Gustav", "G. Ollenberg", "Gustav Olenberg", "Clara Nimsky", "Nimsky, Clara", "Serrvitz, Irène"]
    ms = spark.createDataFrame([(f"m{i}", t, "Person", None) for i, t in enumerate(texts)], "mention_id string, text string, entity_type string, linked_entity_id string")
    got = {r["text"]: r for r in V.variant_clusters(ms, spark.createDataFrame(E, ENT)).collect()}
    assert {got[t]["center"] for t in texts[2:6]} == {"Gustav Ollenberg"} and got["Gustav Ollenberg"]["mentions"] == 3
    assert len({got["Clara Nimsky"]["center"], got["Nimsky, Clara"]["center"]}) == 1
    assert got["Serrvitz, Irène"]["center"] == got["Serrvitz, Irène"]["entity_id"] == "p1"


def written(rng):
    """Random spellings of a few names and institutions, frequent ones and typing errors among them."""
    typo = lambda w: w if len(w) < 3 or rng.random() < 0.5 else w[: (k := rng.randrange(len(w)))] + rng.choice(["", w[k] * 2, rng.choice("aeostr"), w[k + 1 : k + 2] + w[k]]) + w[k + 1 :]
    out = set()
    for _ in range(220):
        given, family = rng.choice(["Gustav", "Gustave", "Clara", "Oskar", "Al"]), rng.choice(["Ollenberg", "Olmberg", "Nimsky", "Wu", "Pravquisten"])
        given = typo(rng.choice([given, given, given[0] + ".", given[:3] + "."]))
        out.add((rng.choice(["{0} {1}", "{1}, {0}", "{1}", "{0} R. {1}"]).format(given, typo(typo(family))), "Person"))
        han = lambda w: "".join(rng.choice([c, c, c, {"塞": "瑟", "拉": "罗", "德": "", "茨": "兹"}.get(c, c)]) for c in w)
        out.add((han(rng.choice(["古斯塔夫", "克拉拉", "拉德"])) + "·" + han(rng.choice(["塞尔维茨", "塞拉德", "奥伦德", "塞茨"])), "Person"))
        place, house = rng.choice(["Torfield", "Norwold"]), rng.choice([["Paper", "Mill"], ["Engineering", "College"], ["Institute"]])
        out.add((" ".join(rng.sample([typo(place), *(rng.choice([w, w[:3] + w[-1] + ".", typo(w)]) for w in house)], 1 + len(house))), "Organization"))
        out.add((rng.choice(["托菲市", "托菲"]) + "，" + rng.choice(["的", "", ""]) + rng.choice(["造纸工厂", "造厂", "工程学院", "工院"]), "Organization"))
    return sorted((t, k) for t, k in out if V.parts_of(t))


def test_no_link_between_texts_is_left_out(spark, monkeypatch):
    texts = written(random.Random(7))
    names = V.Names([], [("Oskar", "Ossi")])
    names.alike = {"塞": {"瑟"}, "拉": {"罗"}, "茨": {"兹"}, "奥伦": {"欧"}}
    parts = [tuple(V.parts_of(t)) for t, _ in texts]
    brute = {(a[0], b[0]) for i, a in enumerate(texts) for j, b in enumerate(texts) if a[0] < b[0] and a[1] == b[1] and names.likeness(parts[i], parts[j], a[1])}
    seen = {}
    monkeypatch.setattr(V, "star_clusters", lambda nodes, edges: seen.update(edges=edges.collect()) or nodes.select("id", F.col("id").alias("center"), F.lit(1.0).alias("similarity")))
    V.text_stars(spark.createDataFrame([(t, t, k, 1 + i % 9) for i, (t, k) in enumerate(texts)], "text string, form string, entity_type string, n bigint"), names)
    found = {tuple(sorted(x.split("\x01", 1)[1] for x in r[:2])) for r in seen["edges"]}
    assert len(brute) > 500 and found == brute
