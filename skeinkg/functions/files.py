"""Small files, written by the file system that their path names."""

from pyspark.sql import SparkSession


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """``text`` as UTF-8; an existing file is replaced, missing folders are made."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
