"""Running numbers over a total order, without gathering rows in one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqmotif.session import stored


def ranked(rows: DataFrame, order: Sequence, counters: dict[str, Sequence[str]]) -> DataFrame:
    """``rows`` with running numbers from 1 in the order given: for each of ``counters`` a column that counts rows with equal values of some others.

    Rows are sorted by ranges and stored; numbers within a range come from a window over it, and
    the counts of the ranges before it are added. These are one row for each range and group of a counter.
    """
    spark = rows.sparkSession
    kept = stored(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), spark).withColumn("_range", F.shiftright("_at", 33))
    out = kept
    for name, by in counters.items():
        before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        counts = kept.groupBy("_range", *by).agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        right = counts.select(F.col("_range").alias("_r"), "_before", *[F.col(c).alias(f"_by{k}") for k, c in enumerate(by)])
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_by{k}")) for k, c in enumerate(by)], F.col("_range") == F.col("_r"))
        within = F.row_number().over(Window.partitionBy("_range", *by).orderBy("_at"))
        out = out.withColumn("_row", within).join(right, same, "left").withColumn(name, F.col("_before") + F.col("_row"))
        out = out.drop("_r", "_before", "_row", *[f"_by{k}" for k in range(len(by))])
    return out.drop("_at", "_range")
