"""Deriving facts by declarative rules: each rule is data, each round a few joins.

A rule has one or two body atoms (relation, first variable, second variable), a head atom, and a weight; a head argument
that is no variable is an entity id that must exist. A derived fact has the least confidence of its support times the weight;
equal facts are merged (greatest confidence, union of supports); facts already asserted are dropped. One round, as stated; ``rounds`` repeats it.

Defined results: facts with null ends or relation take no part; a null confidence counts as 0."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import checkpointed
from ..functions.sizes import small_or_shuffled


@dataclass(frozen=True)
class Rule:
    name: str
    body: tuple[tuple[str, str, str], ...]
    head: tuple[str, str, str]
    weight: float = 0.8


def _pairs(known: DataFrame, names: set[str]) -> DataFrame:
    """(pair, relation_id, subject, object, least, most, ids) of the facts of some relations: equal facts once, with their confidences and their ids."""
    c = F.coalesce("confidence", F.lit(0.0))
    ids = F.array_distinct(F.flatten(F.collect_list(F.array("triple_id"))))
    g = known.where(F.col("relation_id").isin(sorted(names))).groupBy("relation_id", "subject", "object").agg(F.min(c).alias("least"), F.max(c).alias("most"), ids.alias("ids"))
    return checkpointed(g.withColumn("pair", F.monotonically_increasing_id()))


def _rounded(x: Column, digits: int) -> Column:
    """``x`` rounded as SQL engines round doubles, by the product with a power of ten: 0.7787 / 2 becomes 0.3893, since its product with 10,000 lies below 3893.5; ``F.round`` goes by the shortest decimal, 0.38935."""
    return F.round(x * 10.0**digits) / 10.0**digits


def _derived(pairs: DataFrame, rule: Rule) -> DataFrame:
    """(relation_id, subject, object, confidence, support) of a rule, once for each way through ``pairs``; support holds the pairs. Rounding and the lesser of two keep order, so the greatest confidence of each pair stands for all its facts."""

    def atom(k: int) -> DataFrame:
        relation, x, y = rule.body[k]
        a = pairs.where(F.col("relation_id") == relation)
        a = a if x != y else a.where("subject = object")
        ends = [F.col("subject").alias(f"v_{x}")] + [F.col("object").alias(f"v_{y}")] * (x != y)
        return a.select(*ends, F.col("most" if rule.weight >= 0 else "least").alias(f"c{k}"), F.col("pair").alias(f"t{k}"))

    d = atom(0)
    for k in range(1, len(rule.body)):
        right = atom(k)
        shared = [c for c in right.columns if c in d.columns]
        if not shared:
            raise ValueError(f"rule {rule.name}: an atom shares no variable with those before it")
        d = d.join(right, shared)
    n = len(rule.body)
    relation, x, y = rule.head
    end = lambda v: F.col(f"v_{v}") if f"v_{v}" in d.columns else F.lit(v)
    least = F.least(*[F.col(f"c{k}") for k in range(n)]) if n > 1 else F.col("c0")
    made = d.select(F.lit(relation).alias("relation_id"), end(x).alias("subject"), end(y).alias("object"), _rounded(_rounded(least * rule.weight, 9), 4).alias("confidence"), F.array(*[F.col(f"t{k}") for k in range(n)]).alias("support"))
    return made.where("subject IS NOT NULL AND object IS NOT NULL AND subject <> object")


def inferred(facts: DataFrame, rules: list[Rule], entities: DataFrame | None = None, rounds: int = 1) -> DataFrame:
    """(triple_id, relation_id, subject, object, confidence, support_ids, supports) derived from (triple_id, relation_id, subject, object, confidence).

    Facts that repeat a pair would multiply in a join, so pairs are joined once each; the ids of their facts come last, once for each derived fact and pair."""
    known, made = facts.select("triple_id", "relation_id", "subject", "object", "confidence"), None
    names = {r for rule in rules for r, _, _ in (*rule.body, rule.head)}
    fact = ["relation_id", "subject", "object"]
    for _ in range(rounds):
        pairs, new = _pairs(known, names), None
        for rule in rules:
            one = _derived(pairs, rule)
            new = one if new is None else new.unionByName(one)
        if entities is not None:
            ids = small_or_shuffled(entities.select("id"))
            new = new.join(ids.select(F.col("id").alias("subject")), "subject", "left_semi").join(ids.select(F.col("id").alias("object")), "object", "left_semi")
        new = new.join(pairs.select(fact), fact, "left_anti")
        # rows of a fact are put together while they are numbers; where the ids are broadcast they aren't moved again
        new = new.select(*fact, "confidence", F.explode("support").alias("pair")).repartition("subject", "object")
        new = new.groupBy(*fact, "pair").agg(F.max("confidence").alias("confidence")).join(small_or_shuffled(pairs).select("pair", "ids"), "pair")
        g = new.groupBy(*fact).agg(F.max("confidence").alias("confidence"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("support_ids"))
        g = g.withColumn("triple_id", F.concat_ws(":", F.lit("inferred"), "relation_id", "subject", "object"))
        made = g if made is None else made.unionByName(g)
        known = known.unionByName(g.select(known.columns))
    return made.select("triple_id", "relation_id", "subject", "object", "confidence", "support_ids", F.size("support_ids").alias("supports"))


def inferred_classes(facts: DataFrame, rule: Rule) -> DataFrame:
    """(relation_id, class_id, representative, member, confidence, support) of a rule that relates all subjects of one relation with a common object (colleagues), or all objects with a common subject.

    Such a rule means all pairs of a class, which a hot class would square; a class is given by its members instead, each with the class's least member as representative. Two different members of a class are related with the lesser of their confidences."""
    (r1, x, z), (r2, y, w) = rule.body
    common, member = ("object", "subject") if z == w else ("subject", "object")
    if r1 != r2 or (z == w) == (x == y) or {rule.head[1], rule.head[2]} != ({x, y} if z == w else {z, w}):
        raise ValueError(f"rule {rule.name} doesn't relate the ends of one relation by a common end")
    a = facts.where((F.col("relation_id") == r1) & F.col("subject").isNotNull() & F.col("object").isNotNull())
    best = F.max_by("triple_id", F.struct(F.coalesce("confidence", F.lit(0.0)), F.col("triple_id")))
    m = a.groupBy(F.col(common).alias("class_id"), F.col(member).alias("member")).agg(F.max(F.coalesce("confidence", F.lit(0.0))).alias("c"), best.alias("support"))
    first = m.groupBy("class_id").agg(F.min("member").alias("representative"), F.count("*").alias("n")).where("n > 1")
    return m.join(first, "class_id").select(F.lit(rule.head[0]).alias("relation_id"), "class_id", "representative", "member", F.round(F.round(F.col("c") * rule.weight, 9), 4).alias("confidence"), "support")
