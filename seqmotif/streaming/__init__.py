"""Scanning file streams, and the SQL table function."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

from seqmotif.operators.scan import scan
from seqmotif.session import ship


def stream_scan(seqs: DataFrame, patterns: object, **options: object) -> DataFrame:
    """Hits of a streaming DataFrame (seq_ord, seq_id, seq): stateless, a record at a time, in append mode.

    Limits and names count over the whole run and need ``foreachBatch`` with a
    counter of one's own; they are refused here.
    """
    if {"max_hits", "max_misses"} & set(options):
        raise ValueError("limits need an order over the whole run, which a stream has not")
    return scan(seqs, patterns, **options)  # type: ignore[arg-type]


@udtf(returnType="start: long, end: long, text: string")
class MotifScan:
    """``SELECT ... FROM t, LATERAL motif_scan(seq, pattern)``: chained forward hits of one sequence."""

    def __init__(self) -> None:
        self.matchers: dict[str, object] = {}

    def eval(self, seq: str, pattern: str) -> Iterator[tuple[int, int, str]]:
        from seqmotif.operators.kernel import Matcher
        from seqmotif.pattern.parser import parse

        if seq is None or pattern is None:
            return
        matcher = self.matchers.get(pattern) or self.matchers.setdefault(pattern, Matcher(parse(pattern)))
        for start, end, _ in matcher.hits(seq):  # type: ignore[attr-defined]
            yield start + 1, end, seq[start:end]


def register(spark: SparkSession) -> None:
    """Make ``motif_scan`` callable from SQL."""
    ship(spark)
    spark.udtf.register("motif_scan", MotifScan)
