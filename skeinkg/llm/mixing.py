"""Mixing sources to target weights over the course of training.

Each source has a weight schedule over training time t in [0, 1]: a table of knots (mix_name, source, t, weight),
linear in between and constant before the first and behind the last. Its shape says when a source comes, its
target share how much of it: the schedule is scaled so that its integral is the share. Integrated, it gives the
source's cumulative token demand, a parabola in each piece; a document copy that starts at token c of its source is
due at the t where the demand reaches c, which the piece's quadratic gives in closed form. Copies are then range-sorted
by t, so around t the sources stand in the proportion of their scaled weights there.

The mix is as large as the shares allow without repeating any source more than ``max_repeats`` times, so
actual shares differ from the targets by less than one document each; they are reported.

Running token counts inside a source are prefix sums over hash buckets: sums per bucket first, then a
window over the few buckets, then a window inside each bucket, so no task ever holds a source.

Defined results: documents without source, id or tokens are left out; sources without documents get nothing and are
reported with share 0, the other shares being scaled to one; null or negative shares count as 0; null or non-positive repeats as 1; repeated rows are documents of their own.
Knots that are null or outside [0, 1] are left out, negative weights count as 0; sources without knots, or whose weights are all 0, come evenly.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import checkpointed
from ..functions.sizes import small_or_shuffled

#: Documents in a hash bucket, about.
BUCKET = 20_000
#: Greatest slope of the schedules that are made where none are given.
SLOPE = 0.5


def planned(totals: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_name, source, target_share, max_repeats, available, share, repeats, demand): one row for each target; ``totals`` is (source, available). ``demand`` is never more than ``available`` times ``repeats``."""
    by = Window.partitionBy("mix_name")
    t = targets.groupBy("mix_name", "source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    t = t.join(totals, "source", "left").withColumn("available", F.coalesce("available", F.lit(0)))
    t = t.withColumn("wanted", F.when((F.col("available") > 0) & (F.col("target_share") > 0), F.col("target_share")).otherwise(0.0))
    t = t.withColumn("share", F.coalesce(F.col("wanted") / F.nullif(F.sum("wanted").over(by), F.lit(0.0)), F.lit(0.0)))
    t = t.withColumn("repeats", F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(1)))
    most = F.col("available") * F.col("repeats")
    budget = F.min(F.when(F.col("share") > 0, most / F.col("share"))).over(by)
    demand = F.least(F.coalesce(budget * F.col("share"), F.lit(0.0)), most.cast("double"))
    return t.select("mix_name", "source", "target_share", "max_repeats", "available", "share", "repeats", demand.alias("demand"))


def linear_schedules(plan: DataFrame) -> DataFrame:
    """(mix_name, source, t, weight): for each source a straight line that rises for small shares and falls for large ones, all lines of a mix adding up to one at every t."""
    by = Window.partitionBy("mix_name")
    p = plan.withColumn("lean", F.percent_rank().over(by.orderBy(F.desc("share"), "source")) - 0.5)
    slope = SLOPE * (F.col("lean") - F.sum(F.col("share") * F.col("lean")).over(by))
    ends = F.array(F.struct(F.lit(0.0).alias("t"), (F.col("share") * (1 - F.col("slope"))).alias("weight")), F.struct(F.lit(1.0).alias("t"), (F.col("share") * (1 + F.col("slope"))).alias("weight")))
    return p.withColumn("slope", slope).select("mix_name", "source", F.inline(ends))


def with_pieces(plan: DataFrame, schedules: DataFrame) -> DataFrame:
    """``plan`` with ``pieces``: array<struct<c, t, d, w, v>>, the linear pieces of each schedule with integral one: demand before, start, length, weights at both ends."""
    weight = F.greatest(F.col("weight").cast("double"), F.lit(0.0))
    k = schedules.where("t >= 0 AND t <= 1 AND weight IS NOT NULL").groupBy("mix_name", "source").agg(F.array_sort(F.collect_list(F.struct(F.col("t").cast("double").alias("t"), weight.alias("w")))).alias("k"))
    p = plan.join(small_or_shuffled(k), ["mix_name", "source"], "left")
    knot = lambda t, at: F.array(F.struct(F.lit(t).alias("t"), F.coalesce(F.try_element_at("k", F.lit(at))["w"], F.lit(1.0)).alias("w")))
    none = F.array().cast("array<struct<t:double,w:double>>")
    p = p.withColumn("k", F.concat(knot(0.0, 1), F.coalesce("k", none), knot(1.0, -1)))

    def piece(a: Column, i: Column) -> Column:
        x, y = F.get("k", i), F.get("k", i + 1)
        d = y["t"] - x["t"]
        one = F.array(F.struct(a["c"].alias("c"), x["t"].alias("t"), d.alias("d"), x["w"].alias("w"), y["w"].alias("v")))
        return F.struct((a["c"] + d * (x["w"] + y["w"]) / 2).alias("c"), F.when(d > 0, F.concat(a["out"], one)).otherwise(a["out"]).alias("out"))

    empty = F.array().cast("array<struct<c:double,t:double,d:double,w:double,v:double>>")
    made = F.aggregate(F.sequence(F.lit(0), F.size("k") - 2), F.struct(F.lit(0.0).alias("c"), empty.alias("out")), piece)
    even = F.array(F.struct(F.lit(0.0).alias("c"), F.lit(0.0).alias("t"), F.lit(1.0).alias("d"), F.lit(1.0).alias("w"), F.lit(1.0).alias("v")))
    scaled = F.transform(F.col("made.out"), lambda x: F.struct((x["c"] / F.col("made.c")).alias("c"), x["t"].alias("t"), x["d"].alias("d"), (x["w"] / F.col("made.c")).alias("w"), (x["v"] / F.col("made.c")).alias("v")))
    return p.withColumn("made", made).withColumn("pieces", F.when(F.col("made.c") > 0, scaled).otherwise(even)).drop("k", "made")


def due(pieces: Column, c: Column) -> Column:
    """The t at which a schedule's integral reaches ``c`` in [0, 1)."""
    # pieces without weight give nothing, so the last piece that starts at or before c is the one that reaches it
    return F.transform(F.array(F.element_at(F.filter(pieces, lambda x: (x["c"] <= c) & ((x["w"] > 0) | (x["v"] > 0))), -1)), lambda x: _solved(x, c))[0]


def _solved(x: Column, c: Column) -> Column:
    rest, bend = F.greatest(c - x["c"], F.lit(0.0)), (x["v"] - x["w"]) / x["d"]
    # w s + bend s s / 2 = rest, in the form that doesn't cancel
    return F.least(x["t"] + F.when(rest == 0, 0.0).otherwise(2 * rest / (x["w"] + F.sqrt(F.greatest(x["w"] * x["w"] + 2 * bend * rest, F.lit(0.0))))), F.lit(1.0))


def mixture(sizes: DataFrame, targets: DataFrame, schedules: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The plan, and (mix_name, source, doc_id, copy, size, position) of all copies of documents (doc_id, source, size) that are used."""
    usable = sizes.where("doc_id IS NOT NULL AND source IS NOT NULL AND size > 0").select("doc_id", "source", "size")
    totals = checkpointed(usable.groupBy("source").agg(F.sum("size").alias("available"), F.count("*").alias("n")))
    plan = planned(totals.select("source", "available"), targets)
    plan = checkpointed(with_pieces(plan, linear_schedules(plan) if schedules is None else schedules))
    rows = totals.agg(F.max("n")).first()[0] or 0
    buckets = max(1, rows // BUCKET)
    last = F.least(F.ceil(F.col("demand") / F.col("available")), F.col("repeats")).cast("int") - 1
    small = small_or_shuffled(plan.where("demand > 0").select("mix_name", "source", "pieces", "demand", F.explode(F.sequence(F.lit(0), last)).alias("copy")))
    order = F.xxhash64("doc_id", "copy", "mix_name")
    copies = usable.join(small.drop("pieces"), "source").withColumn("order", order).withColumn("bucket", F.pmod(F.shiftright("order", 20), F.lit(buckets)))
    sums = copies.groupBy("mix_name", "source", "copy", "bucket").agg(F.sum("size").alias("s"))
    before = Window.partitionBy("mix_name", "source").orderBy("copy", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("mix_name", "source", "copy", "bucket", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("mix_name", "source", "copy", "bucket").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    at = copies.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(starts, ["mix_name", "source", "copy", "bucket"])
    used = at.where(F.col("base") + F.col("within") < F.col("demand")).join(small_or_shuffled(plan.select("mix_name", "source", "pieces")), ["mix_name", "source"])
    return plan.drop("pieces", "repeats"), used.select("mix_name", "source", "doc_id", "copy", "size", due(F.col("pieces"), (F.col("base") + F.col("within")) / F.col("demand")).alias("position"))


def in_training_order(copies: DataFrame) -> DataFrame:
    """Range-sorted by mix and position; ties by source, document and copy."""
    return copies.orderBy("mix_name", "position", "source", "doc_id", "copy")


def actual_shares(plan: DataFrame, copies: DataFrame) -> DataFrame:
    """(mix_name, source, target_share, max_repeats, available, used, repeats, actual_share) for each target."""
    by = copies.groupBy("mix_name", "source").agg(F.sum("size").alias("used"), F.max("copy").alias("last"))
    joined = plan.join(by, ["mix_name", "source"], "left").withColumn("used", F.coalesce("used", F.lit(0)))
    total = F.nullif(F.sum("used").over(Window.partitionBy("mix_name")), F.lit(0))
    return joined.select("mix_name", "source", "target_share", "max_repeats", "available", "used", F.coalesce(F.col("last") + 1, F.lit(0)).cast("int").alias("repeats"), F.coalesce(F.col("used") / total, F.lit(0.0)).alias("actual_share"))
