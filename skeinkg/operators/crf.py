"""A linear-chain conditional random field over token features, trained on weak labels.

Labels of neighbouring tokens are scored together (transitions), so the model learns which label may follow which. It is fitted on the driver by
AdaGrad over the sentence log-likelihood with an L2 penalty, on no more than ``maxent.EXAMPLES`` sentences (those with a label other than O first); tagging covers
all sentences in Arrow batches. Features are hashed to ``BITS`` rows, so the model has a fixed size. Rows without tokens get no tags; fewer than ``maxent.LEAST`` examples give no model."""

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .maxent import LEAST, examples

BITS, ROUNDS, RATE, PENALTY = 1 << 15, 12, 0.2, 1e-4


@lru_cache(200_000)
def _row(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) & (BITS - 1)


def feature_rows(tokens: list[str]) -> list[list[int]]:
    """The hashed features of each token: itself, its ends and kind, its neighbours, and the sentence's ends."""
    out = []
    for i, w in enumerate(tokens):
        names = ["bias", f"w={w.lower()}", f"a={w[:1]}", f"aa={w[:2]}", f"z={w[-1:]}", f"zz={w[-2:]}", f"digit={w.isdigit()}", f"ascii={w.isascii()}", f"han={any('一' <= c <= '鿿' for c in w)}"]
        names += [f"p={tokens[i - 1]}", f"pd={tokens[i - 1].isdigit()}"] if i else ["bos"]
        names += [f"n={tokens[i + 1]}", f"nd={tokens[i + 1].isdigit()}"] if i + 1 < len(tokens) else ["eos"]
        out.append([_row(n) for n in names])
    return out


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


class Chain:
    def __init__(self, labels: list[str]):
        n = len(labels)
        self.labels, self.w, self.a, self.s = labels, np.zeros((BITS, n)), np.zeros((n, n)), np.zeros(n)

    def emissions(self, rows: list[list[int]]) -> np.ndarray:
        return np.array([self.w[r].sum(axis=0) for r in rows])

    def expected(self, e: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Log of the partition sum, the probability of each label at each token, and the expected number of each transition."""
        n, k = e.shape
        alpha, beta = np.zeros((n, k)), np.zeros((n, k))
        alpha[0] = self.s + e[0]
        for t in range(1, n):
            alpha[t] = e[t] + _lse(alpha[t - 1][:, None] + self.a, 0)
        for t in range(n - 2, -1, -1):
            beta[t] = _lse(self.a + (e[t + 1] + beta[t + 1])[None, :], 1)
        z = float(_lse(alpha[-1], 0))
        moves = np.exp(alpha[:-1, :, None] + self.a[None] + (e[1:] + beta[1:])[:, None, :] - z).sum(axis=0) if n > 1 else np.zeros_like(self.a)
        return z, np.exp(alpha + beta - z), moves

    def fit(self, sequences: list[tuple[list[str], list[str]]], rounds: int = ROUNDS) -> "Chain":
        at = {x: i for i, x in enumerate(self.labels)}
        data = [(feature_rows(t), np.array([at[x] for x in y])) for t, y in sequences if t]
        gw, ga, gs = np.full(self.w.shape, 1e-8), np.full(self.a.shape, 1e-8), np.full(self.s.shape, 1e-8)
        order = np.random.default_rng(7)
        for _ in range(rounds):
            for i in order.permutation(len(data)):
                rows, y = data[i]
                _, p, moves = self.expected(self.emissions(rows))
                p[np.arange(len(y)), y] -= 1
                np.add.at(moves, (y[:-1], y[1:]), -1)
                flat = np.concatenate(rows)
                g = np.repeat(p, [len(r) for r in rows], axis=0)
                used, back = np.unique(flat, return_inverse=True)
                sums = np.zeros((len(used), len(self.labels)))
                np.add.at(sums, back, g)
                sums += PENALTY * self.w[used]
                gw[used] += sums**2
                self.w[used] -= RATE * sums / np.sqrt(gw[used])
                moves += PENALTY * self.a
                ga += moves**2
                self.a -= RATE * moves / np.sqrt(ga)
                gs += p[0] ** 2
                self.s -= RATE * p[0] / np.sqrt(gs)
        return self

    def tags(self, tokens: list[str]) -> list[str]:
        """The best labelling; the first of equal labels."""
        if not tokens:
            return []
        e = self.emissions(feature_rows(tokens))
        score, back = self.s + e[0], []
        for t in range(1, len(e)):
            step = score[:, None] + self.a
            best = step.argmax(0)
            back.append(best)
            score = step[best, np.arange(len(score))] + e[t]
        path = [int(score.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return [self.labels[k] for k in reversed(path)]


def fitted(labels: DataFrame, held_out: int = 5) -> Chain | None:
    """A model of four fifths of the examples of (sentence_id, token_index, token, label), chosen by the hash of the id; None for too few."""
    ids = examples(labels)
    if ids.count() < LEAST:
        return None
    ids = ids.where(F.pmod(F.xxhash64("sentence_id"), F.lit(held_out)) != 0)
    rows = labels.join(F.broadcast(ids), "sentence_id").groupBy("sentence_id").agg(F.array_sort(F.collect_list(F.struct("token_index", F.coalesce("token", F.lit("")).alias("token"), "label"))).alias("x")).orderBy("sentence_id").collect()
    data = [([t["token"] for t in r["x"]], [t["label"] for t in r["x"]]) for r in rows]
    return Chain(["O", *sorted({y for _, ys in data for y in ys} - {"O"})]).fit(data) if data else None


def decoded(sentences: DataFrame, model: Chain) -> DataFrame:
    """(sentence_id, token_index, token, start, end, label) of tagged tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tags = [model.tags(t or []) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(tags, pa.list_(pa.string()))], ["sentence_id", "tokens", "labels"])

    texts = F.transform("tokens", lambda t: F.coalesce(t["text"], F.lit("")))
    rows = sentences.where(F.size("tokens") > 0).select("sentence_id", texts.alias("t"), "tokens")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    tagged = rows.mapInArrow(run, f"sentence_id {kinds['sentence_id']}, tokens {kinds['tokens']}, labels array<string>")
    return tagged.select("sentence_id", F.posexplode(F.arrays_zip("tokens", "labels")).alias("token_index", "x")).select("sentence_id", "token_index", F.col("x.tokens.text").alias("token"), F.col("x.tokens.start").alias("start"), F.col("x.tokens.end").alias("end"), F.col("x.labels").alias("label"))
