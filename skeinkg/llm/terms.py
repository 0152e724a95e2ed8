"""Term counts over a whole collection, and how distinctive a term is for a record.

*Counts* use last-seen counters. Records are hash-partitioned by id (which also drops repeated rows) and
come one after the other, so a partition keeps for each term only its occurrences, its records and the
last record it was seen in, never a set of records; the partial counters are then added by term. A hot
term therefore sends one row per partition and flush, however often it occurs.

*Distinctiveness* is the term's contribution to the relative entropy between the record's
Dirichlet-smoothed distribution and the collection's: p(t|d) ln(p(t|d) / p(t)), with
p(t|d) = (tf + mu p(t)) / (|d| + mu).

Defined results: null ids give no rows, null or empty token lists and empty forms count nothing, repeated
ids count once (with the greatest of differing contents), empty tables give empty results.
"""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import checkpointed
from . import textform

#: Counters kept in a worker before they are handed on.
FLUSH = 200_000
#: Name of the counter of records itself; real terms aren't empty.
RECORDS = ""


def sentence_terms(sentences: DataFrame) -> DataFrame:
    """(sentence_id, document_id, terms): the forms of each sentence's tokens, in order, each sentence_id once.

    A token's look-alike letters are resolved in the context of its sentence."""
    texts = F.transform("tokens", lambda t: F.regexp_replace(F.coalesce(t["text"], F.lit("")), "\n", " "))
    once = sentences.where(F.col("sentence_id").isNotNull() & (F.size("tokens") > 0)).select("sentence_id", "document_id", F.array_join(texts, "\n").alias("line"))
    once = once.groupBy("sentence_id").agg(F.max("document_id").alias("document_id"), F.max("line").alias("line"))
    formed = textform.with_consistent_form(once, "line", "form")
    return formed.select("sentence_id", "document_id", F.split(textform.plain_form_of_lines(F.col("form")), "\n").alias("terms"))


def mention_terms(mentions: DataFrame) -> DataFrame:
    """(mention_id, terms): the form of each mention's text as the only element, each mention_id once."""
    once = mentions.where("mention_id IS NOT NULL").groupBy("mention_id").agg(F.max("text").alias("text"))
    return textform.with_consistent_form(once, "text", "form").select("mention_id", F.array(F.coalesce(textform.plain_form(F.col("form")), F.lit(""))).alias("terms"))


def _counters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept: dict[str, list[int]] = {}
    record = total = 0

    def handed_on() -> pa.RecordBatch:
        terms, rows = list(kept), list(kept.values())
        return pa.RecordBatch.from_pydict({"term": [*terms, RECORDS], "occurrences": pa.array([*(x[0] for x in rows), total], pa.int64()), "records": pa.array([*(x[1] for x in rows), total], pa.int64())})

    for batch in batches:
        for terms in batch.column(0).to_pylist():
            record += 1
            total += 1
            for t in terms or ():
                if t:
                    x = kept.get(t)
                    if x is None:
                        kept[t] = [1, 1, record]
                    else:
                        x[0] += 1
                        if x[2] != record:
                            x[1] += 1
                            x[2] = record
            if len(kept) > FLUSH:
                yield handed_on()
                kept, total = {}, 0
    yield handed_on()


def term_counts(records: DataFrame, terms: str = "terms") -> DataFrame:
    """(term, occurrences, records) over rows that each are one whole record; the row of the empty term counts the records."""
    partial = records.select(terms).mapInArrow(_counters, "term string, occurrences bigint, records bigint")
    return partial.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def marked_terms(fields: dict[str, DataFrame], rare: int = 1, common: float = 0.02) -> DataFrame:
    """(field, term, occurrences, records, mark): mark is ``rare`` in at most ``rare`` records, ``common`` in more than the share ``common`` of the field's records, else null."""
    counts = None
    for field, records in fields.items():
        one = term_counts(records).select(F.lit(field).alias("field"), "*")
        counts = one if counts is None else counts.unionByName(one)
    counts = checkpointed(counts)
    totals = counts.where(F.col("term") == RECORDS).select("field", F.col("records").alias("total"))
    mark = F.when(F.col("records") <= rare, "rare").when(F.col("records") > common * F.col("total"), "common")
    return counts.where(F.col("term") != RECORDS).join(F.broadcast(totals), "field").select("field", "term", "occurrences", "records", mark.alias("mark"))


def term_divergence(records: DataFrame, record: str, terms: str = "terms", mu: float = 2000.0, min_df: int = 1) -> DataFrame:
    """(record, term, tf, df, score) for the terms of each record that are in ``min_df`` records at least. Rows of one record may be spread.

    Terms in more than 1 % of the records are joined by broadcast (at most 100 times the mean number of
    different terms of a record, so bounded), the others by shuffle: no key holds more than 1 % of the rows."""
    pairs = records.where(F.col(record).isNotNull()).select(F.col(record).alias("_r"), F.explode(terms).alias("term")).where("term <> ''")
    tf = checkpointed(pairs.groupBy("_r", "term").agg(F.count("*").alias("tf")))
    lengths = tf.groupBy("_r").agg(F.sum("tf").alias("length"))
    stats = checkpointed(tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")))
    size, number = lengths.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count("*")).first()
    common = F.col("df") > max(1, number) / 100
    wide = stats.where(common)
    many = tf.join(F.broadcast(wide), "term")
    few = tf.join(F.broadcast(wide.select("term")), "term", "left_anti").join(stats.where(~common), "term")
    p = F.col("cf") / F.lit(float(max(1, size)))
    q = (F.col("tf") + mu * p) / (F.col("length") + mu)
    joined = many.unionByName(few).where(F.col("df") >= min_df).join(lengths, "_r")
    return joined.select(F.col("_r").alias(record), "term", "tf", "df", (q * F.log(q / p)).alias("score"))


def is_word(term: Column) -> Column:
    return (F.length(term) >= 2) & term.rlike(r"\p{L}")
