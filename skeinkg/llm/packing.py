"""Filling containers of a fixed capacity with whole texts, by lexical retrieval.

A task reads its part of the documents in shards of at most ``SHARD`` tokens. A shard has its own index with
BM25 weights over token ids, all terms of a text included. The longest unused text seeds a container; the index
returns its unused neighbours, best first, and those that fit go in, as long as one fits; what room is left then is
filled with the longest unused texts that fit. A text longer than the capacity is cut into full containers and one
rest, which is packed like any text. Nothing is shuffled, and a task holds one shard at a time.

Postings stand by text and texts by size, so a seed is scored against the texts that fit its room and no others,
and a term that all texts have costs no more than any other.

The last containers of a shard are filled as far as its texts go, so the unused room grows with the number of
shards, not with the number of texts: at most about one container a shard and capacity.

Defined results: null, empty and blank texts and null ids are left out; ties go to the lesser row; repeated rows are texts of their own.
"""

from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import TOKENIZER, encoding

SHARD = 2_000_000
#: Neighbours that are ranked at a time; further ones are asked for while room is left.
NEIGHBOURS = 256
K1, B = 1.2, 0.75
#: Terms in up to this share of a shard's texts are asked for: all.
COMMON = 1.0
#: Postings are written anew once less than this share of their texts is unused.
KEPT = 0.85
OUT = "pack_name string, container string, slot int, doc_id bigint, start_token bigint, end_token bigint, capacity int"


class Index:
    """BM25 weights of a shard, by text."""

    def __init__(self, tokens: list[np.ndarray]):
        n = len(tokens)
        found = [np.unique(t, return_counts=True) for t in tokens]
        lengths = np.array([max(1, len(t)) for t in tokens], dtype=np.float64)
        sizes = np.array([len(u) for u, _ in found], dtype=np.int64)
        terms = np.concatenate([u for u, _ in found]) if n else np.array([], dtype=np.int64)
        t = np.concatenate([c for _, c in found]).astype(np.float64) if n else np.array([])
        vocabulary, at, df = np.unique(terms, return_inverse=True, return_counts=True)
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * lengths / lengths.mean()) if n else lengths
        self.n, self.starts, self.terms = n, np.concatenate(([0], np.cumsum(sizes))), at.astype(np.intp)
        self.weights = idf[at] * t * (K1 + 1) / (t + np.repeat(norm, sizes))
        self.asked = np.zeros(len(vocabulary))

    def neighbours(self, i: int, unused: np.ndarray) -> np.ndarray:
        """Unused rows by falling score for the terms of row ``i``."""
        rows = np.flatnonzero(unused & (np.diff(self.starts) > 0))
        scores = Postings(self, rows).scores(i, len(rows))
        order = np.lexsort((rows, -scores))
        return rows[order[scores[order] > 0]]


class Postings:
    """The postings of some rows with terms, in the order given."""

    def __init__(self, index: Index, rows: np.ndarray):
        lengths = index.starts[rows + 1] - index.starts[rows]
        self.index, self.rows, self.starts = index, rows, np.concatenate(([0], np.cumsum(lengths)))
        at = np.arange(self.starts[-1]) + np.repeat(index.starts[rows] - self.starts[:-1], lengths)
        self.terms, self.weights = index.terms[at], index.weights[at]
        #: Written again by each seed, as new memory for every seed costs more than the sums.
        self.found = np.empty(len(at))

    def scores(self, i: int, k: int) -> np.ndarray:
        """Scores of the first ``k`` rows for the terms of row ``i``."""
        if not k:
            return np.array([])
        own, end = self.index.terms[self.index.starts[i] : self.index.starts[i + 1]], self.starts[k]
        self.index.asked[own] = 1
        found = np.take(self.index.asked, self.terms[:end], out=self.found[:end], mode="clip")
        scores = np.add.reduceat(np.multiply(found, self.weights[:end], out=found), self.starts[:k])
        self.index.asked[own] = 0
        return scores


def packed_shard(tokens: list[np.ndarray], capacity: int, index: Index | None = None) -> list[list[tuple[int, int, int]]]:
    """Containers of (row, start, end)."""
    index = index or Index(tokens)
    out: list[list[tuple[int, int, int]]] = []
    first = [0] * len(tokens)
    size = np.zeros(len(tokens), dtype=np.int64)
    for i, t in enumerate(tokens):
        full = len(t) // capacity if len(t) > capacity else 0
        out += [[(i, j * capacity, (j + 1) * capacity)] for j in range(full)]
        first[i] = full * capacity
        size[i] = len(t) - first[i]
    unused = size > 0
    by_size: list[tuple[int, int]] = sorted((int(size[i]), -i) for i in np.flatnonzero(unused))
    postings = Postings(index, np.array([-i for _, i in by_size], dtype=np.int64))

    def take(i: int) -> tuple[int, int, int]:
        unused[i] = False
        del by_size[bisect_right(by_size, (int(size[i]), -i)) - 1]
        return i, first[i], first[i] + int(size[i])

    while by_size:
        seed = -by_size[-1][1]
        box, left = [take(seed)], capacity - int(size[seed])
        if left and by_size and by_size[0][0] <= left:
            if KEPT * len(postings.rows) > len(by_size):
                postings = Postings(index, postings.rows[unused[postings.rows]])
            rows = postings.rows[: np.searchsorted(size[postings.rows], left, "right")]
            scores = postings.scores(seed, len(rows))
            while True:
                fits = np.flatnonzero(unused[rows] & (size[rows] <= left) & (scores > 0))
                if not len(fits):
                    break
                if len(fits) > NEIGHBOURS:
                    # all of the least score, so that ties go to the lesser row
                    fits = fits[scores[fits] >= np.partition(scores[fits], -NEIGHBOURS)[-NEIGHBOURS]]
                for i in rows[fits[np.lexsort((rows[fits], -scores[fits]))]]:
                    if size[i] <= left:
                        box.append(take(int(i)))
                        left -= int(size[i])
                        if not by_size or by_size[0][0] > left:
                            break
            while left and by_size and by_size[0][0] <= left:
                i = -by_size[bisect_right(by_size, (left, 1)) - 1][1]
                box.append(take(i))
                left -= int(size[i])
        out.append(box)
    return out


def packed(docs: DataFrame, packs: list[tuple[str, int]], key: str = "doc_id", text: str = "text", path: str = TOKENIZER, shard: int = SHARD) -> DataFrame:
    """(pack_name, container, slot, doc_id, start_token, end_token, capacity): where each text, or part of a text longer than the capacity, goes."""
    packs = [(n, c) for n, c in packs if n is not None and c and c > 0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, no, e = TaskContext.get().partitionId(), 0, encoding(path)
        ids: list[int] = []
        tokens: list[np.ndarray] = []
        held = 0

        def flushed() -> Iterator[pa.RecordBatch]:
            index = Index(tokens)
            for name, capacity in packs:
                rows = [(name, f"{name}-{part}-{no}-{k}", s, ids[i], a, b, capacity) for k, box in enumerate(packed_shard(tokens, capacity, index)) for s, (i, a, b) in enumerate(box)]
                kinds = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
                cols = zip(*rows) if rows else [()] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["pack_name", "container", "slot", "doc_id", "start_token", "end_token", "capacity"])

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = np.asarray(e.encode_ordinary(t), dtype=np.int32)
                if len(x):
                    ids.append(i)
                    tokens.append(x)
                    held += len(x)
                if held >= shard:
                    yield from flushed()
                    ids, tokens, held, no = [], [], 0, no + 1
        if ids:
            yield from flushed()

    rows = docs.where(F.col(key).isNotNull() & F.col(text).rlike(r"\S")).select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, OUT)


def fill_rates(containers: DataFrame) -> DataFrame:
    """(pack_name, capacity, containers, tokens, fill): how much of the room of each pack is used."""
    used = containers.groupBy("pack_name", "capacity", "container").agg(F.sum(F.col("end_token") - F.col("start_token")).alias("used"))
    return used.groupBy("pack_name", "capacity").agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), (F.sum("used") / (F.count("*") * F.first("capacity"))).alias("fill"))
