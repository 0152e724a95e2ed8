"""Sizes of texts in tokens of a public tokenizer. The vocabulary file is a parameter and is read where the tasks run."""

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


@lru_cache(4)
def encoding(path: str = TOKENIZER):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_sizes(docs: DataFrame, keep: list[str], text: str = "text", path: str = TOKENIZER) -> DataFrame:
    """Columns ``keep`` and ``size``, the number of tokens of ``text`` (0 for null). The text itself goes no further."""
    schema = docs.select(*keep, F.lit(0).cast("bigint").alias("size")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoding(path)
        for b in batches:
            sizes = [len(e.encode_ordinary(t)) if t else 0 for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(sizes, pa.int64())], [*keep, "size"])

    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, schema)
