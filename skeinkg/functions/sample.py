"""Bounded samples that don't send every task's candidates to the driver."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def least_hashed(df: DataFrame, key: str, n: int) -> DataFrame:
    """Rows of the keys with the least hashes, at least ``n`` rows if there are so many, and about that many: a threshold on the hash, doubled until enough rows lie below it."""
    total = df.count()
    share = 2.0 * n / max(1, total)
    while share < 1.0:
        part = df.where(F.xxhash64(key) < int(-(2**63) + share * 2**64))
        if part.count() >= n:
            return part
        share *= 2
    return df
