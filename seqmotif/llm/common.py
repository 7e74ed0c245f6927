"""What several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: Words a worker remembers before it starts afresh; bounds its memory.
CACHE_WORDS = 250_000


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the fifth of the rows whose labels are never learned from; null ids are not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


class Memo(dict):
    """A dict that computes what it lacks and empties itself once it is full."""

    def __init__(self, compute, limit: int = CACHE_WORDS):
        super().__init__()
        self.compute, self.limit = compute, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.compute(key)
        return value


def label_sample(labels: DataFrame, column: str, bound: int) -> DataFrame:
    """At most ``bound`` labelled ids for learning, half of each class, chosen by a hash of the id.

    Rows with a null id or label are left out; an id labelled twice keeps its smaller label.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.min(column).cast("int").alias("y"))
    parts = [rows.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound // 2) for y in (0, 1)]
    return parts[0].unionByName(parts[1])


def labelled_texts(documents: DataFrame, labels: DataFrame, column: str, bound: int) -> DataFrame:
    """(doc_id, y, text) of the bounded label sample, whose size is ``bound`` at most and so may be broadcast."""
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return docs.join(F.broadcast(label_sample(labels, column, bound)), "doc_id").select("doc_id", "y", "text")


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """A batch's strings, null read as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def portions(rows: list, letters: int = 1_000_000, size: Callable = len) -> Iterator[list]:
    """Runs of whole texts (or rows of some size) of about so many letters each; a longer one is a run by itself."""
    run, total = [], 0
    for row in rows:
        run.append(row)
        total += size(row)
        if total >= letters:
            yield run
            run, total = [], 0
    if run:
        yield run


def fresh(columns: list[str], stem: str) -> str:
    """A column name that none of ``columns`` has, in any case of letters."""
    taken = {c.lower() for c in columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def with_score(schema: StructType, column: str = "score") -> StructType:
    """The schema with a last column for scores."""
    return StructType([*schema.fields, StructField(column, DoubleType())])


def components(edges: DataFrame, spark: SparkSession, store) -> DataFrame:
    """(id, component): each endpoint's smallest reachable id, for undirected edges (a, b) of longs.

    In each round every vertex moves to its neighbour of the least hash (or
    stays, if its own is less), and the edges between vertices that have met
    vanish; hashes keep chains of moves short whatever the ids are. Each round
    is a stored table, so a lost executor costs no more than the round it was in.
    """
    edges = store(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), spark)
    at = None
    while edges.limit(1).count():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b").alias("h"), "b")).alias("n"))
        own = F.struct(F.xxhash64("a").alias("h"), F.col("a").alias("b"))
        moves = store(near.select("a", F.least(own, "n")["b"].alias("to")), spark)
        left = edges.join(moves, "a").select(F.col("to").alias("x"), "b")
        both_moved = left.join(moves.withColumnRenamed("a", "b"), "b").select("x", F.col("to").alias("y")).where("x != y")
        edges = store(both_moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), spark)
        if at is None:
            at = moves.select(F.col("a").alias("id"), F.col("to").alias("at"))
        else:
            at = store(at.join(moves.select(F.col("a").alias("at"), "to"), "at", "left").select("id", F.coalesce("to", "at").alias("at")), spark)
    if at is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    least = store(at.groupBy("at").agg(F.min("id").alias("component")), spark)
    return store(at.join(least, "at").select("id", "component"), spark)


def block_pairs(members: DataFrame, group: str, member: str, block: int) -> DataFrame:
    """Deal each group's members to pairs of blocks, so that any two members meet exactly once in a bounded task group.

    Adds ``left`` (the number of the row's block), ``ba`` <= ``bb`` (the pair of
    blocks it is sent to) for groups of any size; a group of n members has
    about n / block blocks, and each row is sent to as many pairs.
    """
    sizes = members.groupBy(group).agg(F.count("*").alias("_n")).select(group, F.greatest(F.lit(1), F.ceil(F.col("_n") / block)).cast("long").alias("_blocks"))
    out = members.join(sizes, group)
    out = out.withColumn("left", F.pmod(F.xxhash64(member), F.col("_blocks")))
    out = out.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    return out.select(*members.columns, "left", F.least("left", "_other").alias("ba"), F.greatest("left", "_other").alias("bb"))


def forest(links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of a symmetric matrix of links: at most n - 1 pairs (a, b) with the same components."""
    unseen = np.ones(len(links), bool)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for first in np.flatnonzero(links.sum(1) > links.diagonal()).tolist():
        stack = [first] if unseen[first] else []
        unseen[first] = False
        while stack:
            a = stack.pop()
            near = np.flatnonzero(links[a] & unseen)
            if len(near):
                unseen[near] = False
                stack += near.tolist()
                pairs.append((np.full(len(near), a), near))
    if not pairs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([a for a, _ in pairs]), np.concatenate([b for _, b in pairs])


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Runs of sorted rows that hold whole groups of equal ``keys`` (longs), with the groups' first rows and the end."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = [batch.column(k).to_numpy() for k in keys]
        change = np.any([v[1:] != v[:-1] for v in values], axis=0)
        starts = np.flatnonzero(change) + 1
        head = tuple(v[0] for v in values)
        if last is not None and head != last:
            yield _grouped(held, keys)
            held = []
        if len(starts):
            yield _grouped([*held, batch.slice(0, starts[-1])], keys)
            held = [batch.slice(starts[-1])]
        else:
            held.append(batch)
        last = tuple(v[-1] for v in values)
    if held:
        yield _grouped(held, keys)


def _grouped(parts: list[pa.RecordBatch], keys: list[str]) -> tuple[pa.Table, np.ndarray]:
    table = pa.Table.from_batches(parts).combine_chunks()
    values = [table.column(k).to_numpy() for k in keys]
    change = np.any([v[1:] != v[:-1] for v in values], axis=0) if table.num_rows > 1 else np.zeros(0, bool)
    return table, np.concatenate([[0], np.flatnonzero(change) + 1, [table.num_rows]])
