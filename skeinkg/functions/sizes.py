"""Joins that broadcast a side only after its size was checked."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import checkpointed

#: Rows and characters that are broadcast at most.
BROADCAST_ROWS, BROADCAST_CHARS = 500_000, 64 << 20
#: Bytes of the optimizer's estimate, taken from the sizes of files, up to which a side is small beyond doubt.
SURE = 2 << 20


def small_or_shuffled(df: DataFrame, rows: int = BROADCAST_ROWS, chars: int = BROADCAST_CHARS) -> DataFrame:
    """``df`` with a broadcast hint if it is small; otherwise as it is, for a shuffled join that AQE splits where it is skewed.

    Where the optimizer's estimate leaves a doubt, ``df`` is checkpointed, so that it is computed once, and its rows and the characters of all its columns are counted there."""
    plan = df._jdf.queryExecution().optimizedPlan()
    try:
        sure = int(str(plan.stats().sizeInBytes())) <= SURE
    except ValueError:  # products of joins may have more digits than Python converts
        sure = False
    if sure:
        return F.broadcast(df)
    kept = df if plan.nodeName().startswith("LogicalRDD") else checkpointed(df)
    # a hint would keep the optimizer from counting, so the rows are cut first
    n, size = kept.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(F.length(F.struct(*[F.col(f"`{c}`") for c in kept.columns]).cast("string"))), F.lit(0))).first()
    return F.broadcast(kept) if n <= rows and size <= chars else kept
