"""Position frequency matrices: reading, integer weights, exact score distribution and cutoff."""

from __future__ import annotations

import math
import re
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def parse_matrices(text: str) -> list[tuple[str, str, list[list[float]]]]:
    """(id, name, columns of A, C, G, T counts) of every matrix in JASPAR text."""
    out, rows, head = [], {}, None

    def finish() -> None:
        if head is None:
            return
        if set(rows) != set("ACGT") or len({len(r) for r in rows.values()}) != 1 or not rows["A"]:
            raise ValueError(f"matrix {head[0]}: needs rows A, C, G and T of one length")
        out.append((*head, [list(c) for c in zip(*(rows[b] for b in "ACGT"))]))

    for line in filter(None, map(str.strip, text.splitlines())):
        if line.startswith(">"):
            finish()
            words = line[1:].split(None, 1)
            if not words:
                raise ValueError("a matrix has no id")
            head, rows = (words[0], words[1] if len(words) > 1 else ""), {}
        elif head and (m := re.fullmatch(r"([ACGTacgt])\s*\[([^\]]*)\]", line)):
            if m[1].upper() in rows:
                raise ValueError(f"matrix {head[0]}: row {m[1]} twice")
            rows[m[1].upper()] = [float(x) for x in m[2].split()]
        else:
            raise ValueError(f"can't read `{line}`")
    finish()
    if not out:
        raise ValueError("no matrix found")
    return out


def reverse_columns(columns: list[list[float]]) -> list[list[float]]:
    """The matrix of the reverse complement."""
    return [list(reversed(c)) for c in reversed(columns)]


def integer_weights(columns: list[list[float]], background: tuple[float, ...] = (0.25,) * 4, scale: float = 100, pseudocount: float = 1) -> list[list[int]]:
    """Rounded log-odds of each letter against the background."""
    out = []
    for column in columns:
        total = sum(column) + pseudocount
        shares = [(n + pseudocount * b) / total for n, b in zip(column, background)]
        if min(shares) <= 0:
            raise ValueError("zero frequency: use a pseudocount above 0")
        out.append([math.floor(scale * math.log2(f / b) + 0.5) for f, b in zip(shares, background)])
    return out


def score_distribution(weights: list[list[int]], background: tuple[float, ...] = (0.25,) * 4) -> dict[int, float]:
    """The probability of every score over random words."""
    known = {0: 1.0}
    for column in weights:
        ahead: dict[int, float] = defaultdict(float)
        for score, p in known.items():
            for w, b in zip(column, background):
                ahead[score + w] += p * b
        known = dict(ahead)
    return known


def cutoff(distribution: dict[int, float], p_value: float) -> int:
    """The smallest T with P(score > T) <= p_value."""
    above, best = 0.0, max(distribution)
    for score in sorted(distribution, reverse=True):
        if above > p_value * (1 + 1e-12):
            break
        best = score
        above += distribution[score]
    return best


def weight_unit(columns: list[list[float]], p_value: float = 1e-4, reverse: bool = False, **options: object) -> str:
    """The pattern unit of a matrix with its exact cutoff."""
    weights = integer_weights(reverse_columns(columns) if reverse else columns, **options)  # type: ignore[arg-type]
    background = options.get("background", (0.25,) * 4)
    body = ",".join(f"({','.join(map(str, c))})" for c in weights)
    return f"{{{body}}} > {cutoff(score_distribution(weights, background), p_value)}"  # type: ignore[arg-type]


def distribution_frame(spark: SparkSession, weights: list[list[int]]) -> DataFrame:
    """(score, words, above): how many words have each score and how many a higher one, as group-bys column by column."""
    known = spark.createDataFrame([(0, 1)], "score long, words long")
    for column in weights:
        step = F.explode(F.array(*map(F.lit, column)))
        known = known.select("words", "score", step.alias("w")).groupBy((F.col("score") + F.col("w")).alias("score")).agg(F.sum("words").alias("words"))
    above = F.sum("words").over(Window.orderBy(F.desc("score"))) - F.col("words")
    return known.select("score", "words", above.alias("above"))
