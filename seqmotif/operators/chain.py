"""The left-to-right chain of hits over the pieces of long records."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def chain(candidates: DataFrame) -> DataFrame:
    """Of hits in forward places those that a left-to-right pass over each record, pattern and strand keeps, with hit_ord from 0.

    Rows are sorted within partitions and streamed: a task holds the end of the last kept hit, however many a record has.
    """
    names = candidates.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, past, number = None, 0, 0
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("seq_ord", "seq_id", "pat_ord", "strand"))))
            rows, order = [], []
            for k, (key, start, end) in enumerate(zip(keys, batch.column("_from").to_pylist(), batch.column("_to").to_pylist())):
                if key != current:
                    current, past, number = key, 0, 0
                if start > past:
                    rows.append(k)
                    order.append(number)
                    past, number = end, number + 1
            kept = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(order, pa.int64()) if c == "hit_ord" else kept.column(c) for c in names], names)

    plus = "strand = '+'"
    placed = candidates.selectExpr("*", f"IF({plus}, start, seq_len - end + 1) AS _from", f"IF({plus}, end, seq_len - start + 1) AS _to")
    dealt = placed.repartition("seq_ord", "pat_ord", "strand").sortWithinPartitions("seq_ord", "seq_id", "pat_ord", "strand", "_from")
    return dealt.mapInArrow(run, candidates.schema)
