"""Cutting lineage where a result is read more than once."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _folder(context) -> str:
    """The checkpoint folder of the session, set from ``spark.checkpoint.dir`` if it isn't yet. Where none is named, a local master gets a folder of its own; a cluster is refused, since its executors couldn't read one."""
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="skeinkg"))
    return context._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder."""
    _folder(df.sparkSession.sparkContext)
    return df.checkpoint()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder, for files that are written and read again."""
    return f"{_folder(spark.sparkContext)}/{name}-{uuid.uuid4().hex}"
