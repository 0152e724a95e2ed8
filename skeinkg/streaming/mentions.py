"""Documents as a file stream: normalising, splitting and dictionary matching are row-local joins with static tables, so the stream keeps no state; counts by type do, under a watermark."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators.spans import alias_index, leftmost_longest, occurrences
from ..schemas import schema


def document_stream(spark: SparkSession, folder: str, files: int = 100) -> DataFrame:
    """JSON-lines documents as they arrive."""
    return spark.readStream.schema(schema("document")).option("maxFilesPerTrigger", files).json(folder)


def sentence_stream(documents: DataFrame, ends: str = tx.ENDS, least: int = 6) -> DataFrame:
    """(document_id, paragraph_index, sentence_no, text); the number counts all sentences of a paragraph, since a stream has no windows over rows."""
    p = documents.select("document_id", F.posexplode(tx.paragraphs(tx.normalized(F.col("text")))).alias("paragraph_index", "_p"))
    return p.select("document_id", "paragraph_index", F.posexplode(tx.split_at_ends(F.col("_p"), ends)).alias("sentence_no", "text")).where(F.length("text") >= least)


def start_mentions(documents: DataFrame, entities: DataFrame, out: str, checkpoint: str, **trigger):
    """Writes dictionary mentions of each micro-batch as parquet under ``out``; a batch that is run again overwrites its own folder only."""
    aliases = alias_index(entities)

    def write(batch: DataFrame, number: int) -> None:
        s = sentence_stream(batch).withColumn("sentence_id", F.concat_ws("-", "document_id", F.col("paragraph_index").cast("string"), F.col("sentence_no").cast("string")))
        leftmost_longest(occurrences(s, aliases)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def event_counts(events: DataFrame, ts: str = "ts", kind: str = "event_type", late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """(start, end, kind, n) in tumbling windows; rows later than ``late`` are dropped by the watermark."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), F.col(kind).alias("kind")).agg(F.count("*").alias("n")).select("w.start", "w.end", "kind", "n")
