"""Toxicity: noisy-channel deobfuscation, then a score of the restored text.

1. A character language model: trigram counts over the whole corpus, counted
   per task in numpy and summed by Spark. There are ALPHABET ** 3 trigrams at
   most, whatever the size of the corpus.
2. A noisy channel: each observed token is a lattice of what its characters
   may stand for: a letter for itself, letters for a look-alike digit or sign,
   nothing for a separator or a repeated letter. Single characters that are
   spaced out (``i d i o t``) form one lattice, whose spaces may be dropped or
   kept. Viterbi decoding finds the reading with the least channel cost and
   language-model cost; all states are kept, so it is exact. A token of plain
   letters without a repeated letter has a lattice with one path and reads as
   itself; so does a number (digits with what stands in dates, times, amounts
   and shares). Any other token is decoded, with letters or without.
3. A logistic model with an L1 penalty over the restored words and their
   first 4 and 5 letters (hashed), learned on a bounded sample of labelled rows.

A document's logit is the bias plus the sum over its distinct tokens, so any
length of text is scored whole. Nulls and empty texts score the bias alone;
repeated rows and other columns change nothing. Without labels of both
classes every score is the share of label 1, moved by a thousandth towards 0.5
(0.5 without labels). An empty corpus gives the uniform language model.
"""

from __future__ import annotations

import math
import re
import sys
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqmotif.llm.common import Memo, fresh, held_out, labelled_texts, portions, texts, with_score
from seqmotif.session import ship

BUCKETS = 1 << 18
#: Symbols of the language model, one a character: 0 for whatever bounds a word, 1-26 the letters, 27 any other letter.
ALPHABET = 28
OTHER = 27
#: What a digit or sign may stand for.
LOOKALIKES = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e"}
#: Channel costs in nats: a look-alike read as a letter or as nothing, a dropped separator, a dropped repeat (second, later ones), a dropped space, a kept space.
LOOK, UNREAD, DROP, AGAIN, MORE, JOIN, KEEP = 0.7, 3.0, 0.5, 4.5, 0.2, 0.1, 1.5
#: What may stand around a token and reads as nothing; exclamation marks only behind it.
EDGES = ".,;:?\"'()[]{}<>*#%&-_~=/\\^`"
ENDS = EDGES + "!"
#: A number reads as itself.
NUMBER = re.compile(r"[$€£+-]?\d[\d.,:/%°x+-]*[€£]?")
SPACED, SINGLES = re.compile(r"(?<!\S)(?:\S\s){2,}\S(?!\S)"), re.compile(r"\s\S\s\S\s")
TWICE, THRICE = re.compile(r"(.)\1"), re.compile(r"(.)\1\1")


def symbol(char: str) -> int:
    """The language model's symbol of a character in lower case, 0 if it is no letter."""
    return ord(char) - 96 if "a" <= char <= "z" else OTHER if char.isalpha() else 0


@cache
def symbols() -> np.ndarray:
    """The symbol of every code point, upper case read as lower."""
    table = np.fromiter((OTHER if chr(k).isalpha() else 0 for k in range(sys.maxunicode + 1)), np.int64, sys.maxunicode + 1)
    for k in range(26):
        table[97 + k] = table[65 + k] = k + 1
    return table


def count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, n) of all texts of a task, each text bounded by two blanks."""
    table, counts = symbols(), np.zeros(ALPHABET**3, np.int64)
    for batch in batches:
        for run in portions(texts(batch)):
            codes = table[np.frombuffer(("  " + "  ".join(run) + "  ").encode("utf-32-le", "surrogatepass"), np.uint32)]
            counts += np.bincount((codes[:-2] * ALPHABET + codes[1:-1]) * ALPHABET + codes[2:], minlength=ALPHABET**3)
    seen = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(counts[seen], pa.int64())], ["gram", "n"])


def language_model(documents: DataFrame) -> np.ndarray:
    """Costs in nats of a symbol after two others, from all rows; smoothed with the bigram and the symbol shares."""
    ship(documents.sparkSession)
    rows = documents.select("text").mapInArrow(count_trigrams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(ALPHABET**3)
    counts[rows.column("gram").to_numpy()] = rows.column("n").to_numpy()
    tri = counts.reshape(ALPHABET, ALPHABET, ALPHABET)
    bi, uni = tri.sum(0), tri.sum((0, 1))
    p1 = (uni + 1) / (uni.sum() + ALPHABET)
    p2 = (bi + 20 * p1) / (bi.sum(1, keepdims=True) + 20)
    return -np.log((tri + 20 * p2[None]) / (tri.sum(2, keepdims=True) + 20))


class Decoder:
    """Viterbi decoding of noisy tokens under the language model."""

    def __init__(self, costs: np.ndarray):
        self.costs = costs.tolist()
        again = costs[:, np.arange(ALPHABET), np.arange(ALPHABET)][:, :, None] + costs[np.arange(ALPHABET), np.arange(ALPHABET)][None]
        self.drops = (AGAIN + costs < again).tolist()

    def lattice(self, token: str) -> list[list[tuple[str, float]]]:
        """For each character the readings it has: a letter, a blank, or nothing; with channel costs."""
        steps, run, shouts = [], 0, len(token.rstrip("!"))
        for k, c in enumerate(token):
            run = run + 1 if k and token[k - 1] == c else 0
            if c.isalpha():
                steps.append([(c, 0.0)] + ([("", AGAIN if run == 1 else MORE)] if run else []))
            elif c.isspace():
                steps.append([("", JOIN), (" ", KEEP)])
            else:
                looks = [(x, LOOK + 0.3 * n) for n, x in enumerate(LOOKALIKES.get(c, ""))]
                steps.append([*looks, ("", DROP if k >= shouts or not looks else UNREAD)])
        return steps

    def decode(self, token: str) -> str:
        """The likeliest reading; states are the last two symbols emitted."""
        best: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
        for step in self.lattice(token):
            fresh: dict[tuple[int, int], tuple[float, str]] = {}
            for (a, b), (cost, read) in best.items():
                for c, channel in step:
                    if c:
                        s = symbol(c)
                        state, total = (b, s), cost + channel + self.costs[a][b][s]
                    else:
                        state, total = (a, b), cost + channel
                    if state not in fresh or total < fresh[state][0]:
                        fresh[state] = (total, read + c)
            best = fresh
        return min((cost + self.costs[a][b][0], read) for (a, b), (cost, read) in best.items())[1]

    def twice(self, token: str) -> str:
        """The decoding of plain letters without a letter thrice in a row.

        Whether to drop the second of two equal letters changes the costs of
        their own trigrams only, so every pair is decided by itself.
        """
        marked = f" {token} "

        def read(m: re.Match) -> str:
            a, s, b = (symbol(marked[k]) for k in (m.start(), m.start() + 1, m.end() + 1))
            return m[1] if self.drops[a][s][b] else m[0]

        return TWICE.sub(read, token)

    def restore(self, token: str) -> str:
        """The reading of one observed token, or of one spaced-out run."""
        core = token.lower().strip(EDGES).rstrip(ENDS)
        if core.isalpha():
            return core if not TWICE.search(core) else self.twice(core) if not THRICE.search(core) else self.decode(core)
        return core if not core or NUMBER.fullmatch(core) else self.decode(core)


def tokens(text: str) -> list[str]:
    """A text's distinct observed tokens, and its runs of spaced-out characters as one token each."""
    found = set(text.split())
    if SINGLES.search(f" {text} "):
        found.update(SPACED.findall(text))
    return list(found)


def row(feature: str) -> int:
    """A feature's hashed row."""
    return xxhash.xxh32_intdigest(feature) % BUCKETS


def features(word: str) -> list[int]:
    """Hashed rows of a restored reading: each word of it with its first 4 and 5 letters."""
    return [row(x) for w in word.split() for x in (w, "^" + w[:4], "^" + w[:5])]


class Scorer(Memo):
    """What each observed token adds to a text's logit."""

    def __init__(self, costs: np.ndarray, weights: np.ndarray):
        super().__init__(self.added)
        self.decoder, self.weights = Decoder(costs), weights.tolist()
        self.starts = Memo(lambda start: self.weights[row("^" + start)])

    def added(self, token: str) -> float:
        return sum(self.weights[row(w)] + self.starts[w[:4]] + self.starts[w[:5]] for w in self.decoder.restore(token).split())

    def logit(self, text: str, bias: float) -> float:
        return sum(map(self.__getitem__, tokens(text)), bias)


def learn(sample: list[tuple[int, np.ndarray]], penalty: float = 8e-4) -> tuple[np.ndarray, float]:
    """(weights, bias) of logistic regression by accelerated proximal gradient steps.

    Weights are not negative and carry an L1 penalty: a toxic passage counts the
    same in a short text and in a very long one. A first pass with a tenfold
    penalty finds the features that count; the second fits those alone.
    """
    n, positive = len(sample), sum(y for y, _ in sample)
    weights = np.zeros(BUCKETS)
    if not 0 < positive < n:
        share = positive / n if n else 0.5
        return weights.astype(np.float32), float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    y = np.array([y for y, _ in sample], float)
    of = np.repeat(np.arange(n), [len(r) for _, r in sample])
    flat = np.concatenate([r for _, r in sample])
    used, col, times = np.unique(flat, return_inverse=True, return_counts=True)
    often = times >= 5
    of, col, used = of[often[col]], (np.cumsum(often) - 1)[col[often[col]]], used[often]
    cost = np.where(y == 1, n / (2 * positive), n / (2 * (n - positive))) / n
    cell, times = np.unique(of * max(1, len(used)) + col, return_counts=True)
    of, col = cell // max(1, len(used)), cell % max(1, len(used))
    scale = np.sqrt(np.bincount(col, cost[of] * times**2, len(used)))
    val = times / scale[col]
    w, b = np.zeros(len(used)), 0.0
    for rounds, shrink in ((60, 10 * penalty), (1500, penalty)):
        top, curve = np.ones(len(used)), 1.0
        for _ in range(20):  # the largest curvature, by power iteration
            top = np.bincount(col, val * (cost * np.bincount(of, val * top[col], n))[of], len(used))
            curve = max(float(np.linalg.norm(top)), 1e-9)
            top /= curve
        step = 1 / (0.25 * 1.1 * curve + 0.25)
        z, zb, t = w, b, 1.0
        for _ in range(rounds):
            logit = np.clip(np.bincount(of, val * z[col], n) + zb, -30, 30)
            off = (1 / (1 + np.exp(-logit)) - y) * cost
            fresh = np.maximum(z - step * (np.bincount(col, val * off[of], len(used)) + shrink), 0)
            fb = zb - step * off.sum()
            u = (1 + math.sqrt(1 + 4 * t * t)) / 2
            z, zb = fresh + (t - 1) / u * (fresh - w), fb + (t - 1) / u * (fb - b)
            w, b, t = fresh, fb, u
        keep = w > 0
        mine = keep[col]
        of, col, val, used, w, scale = of[mine], (np.cumsum(keep) - 1)[col[mine]], val[mine], used[keep], w[keep], scale[keep]
    # The cut with the best balanced accuracy, in the middle of its gap, becomes logit 0.
    logit = np.bincount(of, val * w[col], n) + b
    order = np.argsort(logit, kind="stable")
    at, gain = logit[order], np.cumsum(np.where(y[order] == 1, -1 / positive, 1 / (n - positive)))
    gap = np.append(at[1:], at[-1]) > at
    cut = np.flatnonzero(gap & (gain >= gain[gap].max() - 1e-12)) if gap.any() else []
    if len(cut):
        k = max(cut, key=lambda k: at[k + 1] - at[k])
        b -= (at[k] + at[k + 1]) / 2
    w = w / scale
    weights[used] = w
    return weights.astype(np.float32), float(b)


def fit(documents: DataFrame, labels: DataFrame, costs: np.ndarray, max_train_rows: int = 3000) -> tuple[np.ndarray, float]:
    """Learn from at most ``max_train_rows`` labelled rows, none of them held out."""
    spark = documents.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(costs)

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        known = Memo(lambda t: features(decoder.restore(t)))
        for batch in batches:
            rows = [np.array([f for t in tokens(text) for f in known[t]], np.int32).tobytes() for text in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(rows, pa.binary())], ["y", "rows"])

    got = labelled_texts(documents, labels, "toxic", max_train_rows).select("y", "text").mapInArrow(bags, "y int, rows binary").toArrow().to_pydict()
    return learn([(y, np.sort(np.frombuffer(r, np.int32))) for y, r in sorted(zip(got["y"], got["rows"]))])


def score(documents: DataFrame, costs: np.ndarray, model: tuple[np.ndarray, float], column: str = "score") -> DataFrame:
    """All rows and columns of ``documents`` with ``column`` (added or replaced), the probability of label 1 for the whole restored text."""
    spark = documents.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast((costs, model))
    base = documents.drop(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        costs, (weights, bias) = shared.value
        known = Scorer(costs, weights)
        for batch in batches:
            logits = np.array([known.logit(t, bias) for t in texts(batch)])
            scores = 1 / (1 + np.exp(-np.clip(logits, -500, 500)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, column])

    return base.mapInArrow(run, with_score(base.schema, column))


def classify(documents: DataFrame, labels: DataFrame, max_train_rows: int = 3000, threshold: float = 0.5) -> DataFrame:
    """``documents`` with held_out, score and predicted (score >= threshold)."""
    costs = language_model(documents)
    scored = score(documents, costs, fit(documents, labels, costs, max_train_rows))
    return scored.withColumns({"held_out": held_out(), "predicted": (F.col("score") >= threshold).cast("int")})


def keep(documents: DataFrame, labels: DataFrame, max_train_rows: int = 3000, threshold: float = 0.5) -> DataFrame:
    """The rows of ``documents`` that score less than ``threshold``, with all their own columns whatever the names."""
    costs, column = language_model(documents), fresh(documents.columns, "score")
    scored = score(documents, costs, fit(documents, labels, costs, max_train_rows), column)
    return scored.where(F.col(column) < threshold).drop(column)


def query(spark: SparkSession, documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    return classify(documents.select("doc_id", "text"), labels).select("doc_id", "held_out", "score", "predicted")
