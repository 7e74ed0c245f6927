"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors of its words, of the words'
character 3- and 4-grams and of its word pairs, all hashed into ``BUCKETS``
rows; a softmax layer turns the average into a probability. Vectors and layer
are trained together by stochastic gradient descent in numpy, one document at
a time, on a bounded sample of labelled rows. For scoring, the layer is folded
into the vectors: a document's logit is the average of one number per feature,
so the model that is sent to the executors has BUCKETS numbers at any scale.

Nulls and empty texts score the bias alone. A pair of equal adjacent words
shares one row whatever the word is, so that repetition is learned as such.
Rows are scored one by one: repeated rows, nulls in other columns and extra
columns change nothing. A table without labels of both classes gives the share
of label 1, moved by a thousandth towards 0.5 (0.5 without labels), as every
score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqmotif.llm.common import CACHE_WORDS, fresh, held_out, labelled_texts, portions, texts, with_score
from seqmotif.session import ship

#: Hashed rows; the last one stands for a repeated word.
BUCKETS = 1 << 18
REPEAT = BUCKETS - 1
PAIR, GRAM = np.uint32(2654435761), np.uint32(2246822519)


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(owner, row) of every feature of the words: each word itself and its character 3- and 4-grams with marked ends."""
    points = np.frombuffer(("<" + "><".join(words) + ">").encode("utf-32-le", "surrogatepass"), np.uint32)
    of = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)) + 2)
    owners, rows = [np.arange(len(words))], [np.fromiter(map(xxhash.xxh32_intdigest, words), np.uint32, len(words))]
    for n in (3, 4):
        inside = np.flatnonzero(of[: len(of) - n + 1] == of[n - 1 :])
        code = np.full(len(inside), n, np.uint32)
        for k in range(n):
            code = (code ^ points[inside + k]) * GRAM
            code ^= code >> np.uint32(15)
        owners.append(of[inside])
        rows.append(code)
    return np.concatenate(owners), (np.concatenate(rows) % np.uint32(REPEAT)).astype(np.int64)


class Words:
    """Numbers words and keeps arrays of what is known of each; ``weights`` are the folded vectors."""

    def __init__(self, weights: np.ndarray | None):
        self.weights, self.ids = weights, {}
        self.hashes, self.sums, self.counts, self.features = [np.zeros(1 << 12, t) for t in (np.uint32, np.float64, np.int64)] + [[]]

    def index(self, words: list[str]) -> np.ndarray:
        """The words' numbers, after learning what is new among them."""
        ids = self.ids
        if len(ids) > CACHE_WORDS:
            self.__init__(self.weights)
            ids = self.ids
        new = list(set(words).difference(ids))
        if new:
            first, end = len(ids), len(ids) + len(new)
            while end > len(self.hashes):
                self.hashes, self.sums, self.counts = (np.concatenate([x, np.zeros_like(x)]) for x in (self.hashes, self.sums, self.counts))
            ids.update(zip(new, range(first, end)))
            owner, rows = word_features(new)
            self.hashes[first:end] = np.fromiter((xxhash.xxh32_intdigest(w, 1) for w in new), np.uint32, len(new))
            self.counts[first:end] = np.bincount(owner, minlength=len(new))
            if self.weights is None:
                order = np.argsort(owner, kind="stable")
                self.features += np.split(rows[order].astype(np.int32), np.cumsum(self.counts[first : end - 1]))
            else:
                self.sums[first:end] = np.bincount(owner, self.weights[rows], len(new))
        return np.fromiter(map(ids.__getitem__, words), np.int64, len(words))

    def pairs(self, ids: np.ndarray) -> np.ndarray:
        h = self.hashes[ids]
        rows = ((h[:-1] * PAIR) ^ h[1:]) % np.uint32(REPEAT)
        return np.where(ids[:-1] == ids[1:], REPEAT, rows).astype(np.int64)

    def probabilities(self, texts: list[str], bias: float) -> np.ndarray:
        """The softmax output for label 1, of the average over all features of each text."""
        split = [t.split() for t in texts]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        of = np.repeat(np.arange(len(split)), sizes)
        ids = self.index([w for words in split for w in words])
        total, n = np.bincount(of, self.sums[ids], len(split)), np.bincount(of, self.counts[ids], len(split))
        inside = of[:-1] == of[1:]
        total += np.bincount(of[1:][inside], self.weights[self.pairs(ids)[inside]], len(split))
        n += np.maximum(sizes - 1, 0)
        return 1 / (1 + np.exp(-np.clip(total / np.maximum(n, 1) + bias, -500, 500)))


def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(y, ids, shares): a labelled text's rows and each row's share of all its features."""
    known = Words(None)
    for batch in batches:
        out: dict[str, list] = {"y": [], "ids": [], "shares": []}
        for y, text in zip(batch.column("y").to_pylist(), texts(batch)):
            words = text.split()
            ids = known.index(words)
            seen, times = np.unique(ids, return_counts=True)
            rows = [known.features[k] for k in seen.tolist()]
            each = np.repeat(times, [len(r) for r in rows]) if rows else np.zeros(0, np.int64)
            flat = np.concatenate([*rows, known.pairs(ids).astype(np.int32)]) if rows else np.zeros(0, np.int32)
            each = np.concatenate([each, np.ones(len(flat) - len(each), np.int64)])
            rows, place = np.unique(flat, return_inverse=True)
            total = np.bincount(place, each, len(rows))
            out["y"].append(y)
            out["ids"].append(rows.astype(np.int32).tobytes())
            out["shares"].append((total / max(1, total.sum())).astype(np.float32).tobytes())
        yield pa.RecordBatch.from_pydict(out, pa.schema([("y", pa.int32()), ("ids", pa.binary()), ("shares", pa.binary())]))


def train(sample: list[tuple[int, np.ndarray, np.ndarray]], dim: int = 8, epochs: int = 6, rate: float = 0.6, seed: int = 7) -> tuple[np.ndarray, float]:
    """(folded weights, bias) learned by stochastic gradient descent over (label, rows, shares)."""
    n, positive = len(sample), sum(y for y, _, _ in sample)
    if not 0 < positive < n:
        share = positive / n if n else 0.5
        return np.zeros(BUCKETS, np.float32), float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim)).astype(np.float32)
    layer, bias = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    balance = np.array([n / (2 * (n - positive)), n / (2 * positive)], np.float32)
    steps = done = n * epochs
    for _ in range(epochs):
        for k in rng.permutation(n):
            y, rows, shares = sample[k]
            done -= 1
            step = rate * (done + 1) / steps * balance[y]
            hidden = shares @ vectors[rows]
            logits = hidden @ layer + bias
            p = np.exp(logits - logits.max())
            off = p / p.sum()
            off[y] -= 1
            back = layer @ off
            layer -= step * np.outer(hidden, off)
            bias -= 0.1 * step * off
            if len(rows):
                vectors[rows] -= (step / (shares @ shares)) * shares[:, None] * back
    return (vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def fit(documents: DataFrame, labels: DataFrame, max_train_rows: int = 2000) -> tuple[np.ndarray, float]:
    """Learn from at most ``max_train_rows`` labelled rows, none of them held out."""
    ship(documents.sparkSession)
    rows = labelled_texts(documents, labels, "quality", max_train_rows).select("y", "text")
    got = rows.mapInArrow(bags, "y int, ids binary, shares binary").toArrow().to_pydict()
    sample = [(y, np.frombuffer(i, np.int32), np.frombuffer(s, np.float32)) for y, i, s in sorted(zip(got["y"], got["ids"], got["shares"]))]
    return train(sample)


def score(documents: DataFrame, model: tuple[np.ndarray, float], column: str = "score") -> DataFrame:
    """All rows and columns of ``documents`` with ``column`` (added or replaced), the probability of label 1 for the whole text."""
    spark = documents.sparkSession
    ship(spark)
    shared, base = spark.sparkContext.broadcast(model), documents.drop(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        known = Words(weights)
        for batch in batches:
            scores = np.concatenate([np.zeros(0), *(known.probabilities(run, bias) for run in portions(texts(batch)))])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, column])

    return base.mapInArrow(run, with_score(base.schema, column))


def classify(documents: DataFrame, labels: DataFrame, max_train_rows: int = 2000, threshold: float = 0.3) -> DataFrame:
    """``documents`` with held_out, score and predicted (score >= threshold)."""
    scored = score(documents, fit(documents, labels, max_train_rows))
    return scored.withColumns({"held_out": held_out(), "predicted": (F.col("score") >= threshold).cast("int")})


def keep(documents: DataFrame, labels: DataFrame, max_train_rows: int = 2000, threshold: float = 0.3) -> DataFrame:
    """The rows of ``documents`` that score ``threshold`` or more, with all their own columns whatever the names."""
    column = fresh(documents.columns, "score")
    return score(documents, fit(documents, labels, max_train_rows), column).where(F.col(column) >= threshold).drop(column)


def query(spark: SparkSession, documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    return classify(documents.select("doc_id", "text"), labels).select("doc_id", "held_out", "score", "predicted")
