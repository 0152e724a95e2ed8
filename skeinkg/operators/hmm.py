"""A hidden Markov tagger: counted in Spark, decoded in Arrow batches.

Probabilities: start (n + alpha) / (N + alpha S), transition the same by row, emission (n + alpha) / (N + alpha) with
alpha / (N + alpha) for unseen words. Decoding takes the first best state on ties. Rows without tokens get no tags.
The model's size is bounded by the vocabulary, so it is sent to the tasks only up to ``MOST`` emission rows."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import feature_bucket

MOST = 2_000_000


def start_counts(labels: DataFrame) -> DataFrame:
    """(label, n) of first tokens; ``labels`` is (sentence_id, token_index, token, label)."""
    return labels.where("token_index = 0").groupBy("label").agg(F.count("*").alias("n"))


def transition_counts(labels: DataFrame) -> DataFrame:
    """(label, next, n)."""
    by = Window.partitionBy("sentence_id").orderBy("token_index")
    return labels.select("label", F.lead("label").over(by).alias("next")).where("next IS NOT NULL").groupBy("label", "next").agg(F.count("*").alias("n"))


def emission_counts(labels: DataFrame) -> DataFrame:
    """(label, token, n)."""
    return labels.where("token IS NOT NULL").groupBy("label", "token").agg(F.count("*").alias("n"))


class Tagger:
    def __init__(self, starts: dict[str, int], moves: dict[tuple[str, str], int], words: dict[tuple[str, str], int], alpha: float = 0.01, states: list[str] | None = None):
        self.states = states or ["O", *sorted({s for s in [*starts, *(a for a, _ in words)] if s != "O"})]
        n, at = len(self.states), {s: i for i, s in enumerate(self.states)}
        pi = np.array([starts.get(s, 0) for s in self.states], dtype=float)
        a = np.zeros((n, n))
        for (x, y), c in moves.items():
            a[at[x], at[y]] = c
        total = np.zeros(n)
        for (s, _), c in words.items():
            total[at[s]] += c
        with np.errstate(divide="ignore"):
            self.pi = np.log((pi + alpha) / (pi.sum() + alpha * n) + 1e-12)
            self.a = np.log((a + alpha) / (a.sum(1, keepdims=True) + alpha * n) + 1e-12)
            self.unseen = np.log(alpha / (total + alpha) + 1e-12)
        self.emit: dict[str, np.ndarray] = {}
        for (s, w), c in words.items():
            row = self.emit.get(w)
            if row is None:
                row = self.emit[w] = self.unseen.copy()
            row[at[s]] = np.log((c + alpha) / (total[at[s]] + alpha) + 1e-12)

    def tags(self, tokens: list[str]) -> list[str]:
        if not tokens:
            return []
        score = self.pi + self.emit.get(tokens[0], self.unseen)
        back = []
        for w in tokens[1:]:
            step = score[:, None] + self.a
            best = step.argmax(0)
            back.append(best)
            score = step[best, np.arange(len(score))] + self.emit.get(w, self.unseen)
        k = int(score.argmax())
        path = [k]
        for b in reversed(back):
            path.append(k := int(b[k]))
        return [self.states[i] for i in reversed(path)]


def fitted(labels: DataFrame, alpha: float = 0.01) -> Tagger:
    words = emission_counts(labels)
    rows = words.limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"more than {MOST} (label, token) pairs; use feature buckets as tokens")
    return Tagger({r["label"]: r["n"] for r in start_counts(labels).collect()}, {(r["label"], r["next"]): r["n"] for r in transition_counts(labels).collect()}, {(r["label"], r["token"]): r["n"] for r in rows}, alpha)


def decoded(sentences: DataFrame, tagger: Tagger) -> DataFrame:
    """(sentence_id, token_index, token, start, end, label) of tagged tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tags = [tagger.tags(t or []) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(tags, pa.list_(pa.string()))], ["sentence_id", "tokens", "labels"])

    texts = F.transform("tokens", lambda t: F.coalesce(t["text"], F.lit("")))
    rows = sentences.where(F.size("tokens") > 0).select("sentence_id", texts.alias("t"), "tokens")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    # the tokens go through the batch untouched, so that labels needn't be joined back
    tagged = rows.mapInArrow(run, f"sentence_id {kinds['sentence_id']}, tokens {kinds['tokens']}, labels array<string>")
    return tagged.select("sentence_id", F.posexplode(F.arrays_zip("tokens", "labels")).alias("token_index", "x")).select("sentence_id", "token_index", F.col("x.tokens.text").alias("token"), F.col("x.tokens.start").alias("start"), F.col("x.tokens.end").alias("end"), F.col("x.labels").alias("label"))


# ---------------------------------------------------------------- feature buckets and re-estimation
class BucketModel:
    """Start, transition and emission probabilities over a few dozen feature buckets."""

    def __init__(self, states: list[str], pi: np.ndarray, a: np.ndarray, b: np.ndarray):
        self.states, self.pi, self.a, self.b = states, pi, a, b

    @classmethod
    def counted(cls, starts: dict[str, int], moves: dict[tuple[str, str], int], words: dict[tuple[str, str], int], smooth: float = 0.01, size: int = 48) -> "BucketModel":
        states = ["O", *sorted({s for s in [*starts, *(s for s, _ in words)] if s != "O"})]
        at, n = {s: i for i, s in enumerate(states)}, len(states)
        pi, a, b = np.full(n, smooth), np.full((n, n), smooth), np.full((n, size), smooth)
        for s, c in starts.items():
            pi[at[s]] += c
        for (x, y), c in moves.items():
            a[at[x], at[y]] += c
        for (s, w), c in words.items():
            b[at[s], int(w)] += c
        return cls(states, pi / pi.sum(), a / a.sum(1, keepdims=True), b / b.sum(1, keepdims=True))

    def expected(self, obs: list[int]) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        """Log likelihood and expected counts of starts, moves and emissions of one sequence (scaled forward-backward)."""
        e = self.b[:, obs]
        n, t = e.shape
        alpha, scale = np.zeros((t, n)), np.zeros(t)
        for k in range(t):
            x = (self.pi if k == 0 else alpha[k - 1] @ self.a) * e[:, k]
            scale[k] = x.sum()
            alpha[k] = x / scale[k]
        beta = np.ones((t, n))
        moves = np.zeros((n, n))
        for k in range(t - 2, -1, -1):
            right = e[:, k + 1] * beta[k + 1] / scale[k + 1]
            moves += alpha[k][:, None] * self.a * right
            beta[k] = self.a @ right
        gamma = alpha * beta
        emitted = np.zeros_like(self.b)
        np.add.at(emitted.T, obs, gamma)
        return float(np.log(scale).sum()), gamma[0], moves, emitted

    def tagger(self) -> Tagger:
        t = Tagger({"O": 0}, {}, {}, states=self.states)
        t.pi, t.a, t.unseen = np.log(self.pi + 1e-12), np.log(self.a + 1e-12), np.log(np.full(len(self.states), 1e-12))
        t.emit = {str(k): np.log(self.b[:, k] + 1e-12) for k in range(self.b.shape[1])}
        return t


def bucketed(labels: DataFrame) -> DataFrame:
    """Labels with each token replaced by its feature bucket."""
    return labels.withColumn("token", feature_bucket(F.coalesce("token", F.lit(""))).cast("string"))


def counted(labels: DataFrame) -> BucketModel:
    b = bucketed(labels)
    return BucketModel.counted({r["label"]: r["n"] for r in start_counts(b).collect()}, {(r["label"], r["next"]): r["n"] for r in transition_counts(b).collect()}, {(r["label"], r["token"]): r["n"] for r in emission_counts(b).collect()})


def reestimated(model: BucketModel, sentences: DataFrame, rounds: int = 5, smooth: float = 0.01) -> tuple[BucketModel, list[float]]:
    """Baum-Welch over all sentences: expected counts are summed in the tasks and then by Spark, so only states x (states + buckets) rows reach the driver. Also the log likelihood before each round."""
    obs = sentences.where("size(tokens) > 0").select(F.transform("tokens", lambda t: feature_bucket(F.coalesce(t["text"], F.lit("")))).alias("o"))
    likelihoods = []
    for _ in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], m: BucketModel = model) -> Iterator[pa.RecordBatch]:
            total, s, a, b = 0.0, np.zeros_like(m.pi), np.zeros_like(m.a), np.zeros_like(m.b)
            for batch in batches:
                for o in batch.column(0).to_pylist():
                    x = m.expected(o)
                    total, s, a, b = total + x[0], s + x[1], a + x[2], b + x[3]
            rows = [("l", 0, 0, total), *(("s", i, 0, v) for i, v in enumerate(s)), *(("a", i, j, a[i, j]) for i, j in np.ndindex(*a.shape)), *(("b", i, j, b[i, j]) for i, j in np.ndindex(*b.shape))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.int32(), pa.int32(), pa.float64()))], ["kind", "i", "j", "v"])

        s, a, b = np.full_like(model.pi, smooth), np.full_like(model.a, smooth), np.full_like(model.b, smooth)
        for r in obs.mapInArrow(run, "kind string, i int, j int, v double").groupBy("kind", "i", "j").agg(F.sum("v").alias("v")).collect():
            if r["kind"] == "l":
                likelihoods.append(r["v"])
            elif r["kind"] == "s":
                s[r["i"]] += r["v"]
            else:
                (a if r["kind"] == "a" else b)[r["i"], r["j"]] += r["v"]
        model = BucketModel(model.states, s / s.sum(), a / a.sum(1, keepdims=True), b / b.sum(1, keepdims=True))
    return model, likelihoods


def decoded_buckets(sentences: DataFrame, model: BucketModel) -> DataFrame:
    """As ``decoded``, over feature buckets; the tokens keep their text."""
    tagger = model.tagger()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tags = [tagger.tags(list(map(str, t or []))) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(tags, pa.list_(pa.string()))], ["sentence_id", "tokens", "labels"])

    buckets = F.transform("tokens", lambda t: feature_bucket(F.coalesce(t["text"], F.lit(""))))
    rows = sentences.where(F.size("tokens") > 0).select("sentence_id", buckets.alias("t"), "tokens")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    tagged = rows.mapInArrow(run, f"sentence_id {kinds['sentence_id']}, tokens {kinds['tokens']}, labels array<string>")
    return tagged.select("sentence_id", F.posexplode(F.arrays_zip("tokens", "labels")).alias("token_index", "x")).select("sentence_id", "token_index", F.col("x.tokens.text").alias("token"), F.col("x.tokens.start").alias("start"), F.col("x.tokens.end").alias("end"), F.col("x.labels").alias("label"))
