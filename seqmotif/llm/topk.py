"""Exact top-k search by multi-resolution segment statistics.

Vectors become whole numbers, floor(256 x). Each is described at several
resolutions by the mean and the deviation (root of the summed squares around
the mean) of its segments; as sum(L m m' + D D') over segments is at least the
inner product, |q|^2 + |c|^2 minus twice that sum bounds the squared distance
from below. For blocks of queries against blocks of candidates the bound is
taken from coarse to fine; pairs that can't reach a query's k-th best score so
far are dropped, survivors get their exact integer inner product. A bound that
equals the k-th best score is no reason to drop, so ties are exact. Where more
than an eighth of a block's pairs survive, one matrix product tells which of them
reach that score; it is exact, as sums are below 2^24 in single or 2^53 in double
precision. A bound that leaves seven eighths isn't refined first.

Candidate blocks are a stored table and never shuffled. Query blocks are read by
the driver a group at a time, ``GROUP`` bytes at most whatever the size of the
table, and sent to all tasks; each group is one pass over the candidates. Before
it, ``FIRST`` candidate blocks give every query of the group a k-th best score from
below, so that a task emits nothing that can't be among the best of these.

Vectors that are null or hold null or non-finite components take no part, nor
do rows with a null vec_id. Rows with the query's vec_id are its own; a vec_id
that is repeated is one query, with the smallest of its vectors, while each of its rows
is a candidate of other queries. Vectors of different lengths aren't compared.
Components beyond 2^62 and scores beyond the range of a long are clipped to
it. Repeated rows are candidates each. No queries: an empty result.
"""

from __future__ import annotations

import math
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqmotif.session import scratch, ship, stored

SCALE = 256
#: Vectors in a block of queries and of candidates; segments at each resolution.
QUERY_BLOCK, CANDIDATE_BLOCK, SEGMENTS = 128, 512, (4, 8, 16)
LONG = (1 << 63) - 1
#: Bytes of query blocks that are sent to all tasks at once, and candidate blocks that the first thresholds come from.
GROUP, FIRST = 32 << 20, 4
FOUND = "query_id long, rank int, vec_id long, score long"


def usable(column: str = "embedding") -> Column:
    """True for vectors without null or non-finite components."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(column).isNotNull() & F.coalesce(finite, F.lit(False))


def blocks(vectors: DataFrame, size: int) -> DataFrame:
    """(dim, n, ids, whole): vectors packed into blocks of ``size`` rows of one dimension, as 64-bit whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, np.ndarray]]] = {}

        def flush(dim: int) -> pa.RecordBatch:
            rows = held.pop(dim)
            ids, whole = np.array([i for i, _ in rows], np.int64), np.array([w for _, w in rows], np.int64).reshape(len(rows), dim)
            return pa.RecordBatch.from_pydict({"dim": [dim], "ids": [ids.tobytes()], "whole": [whole.tobytes()]}, pa.schema([("dim", pa.int32()), ("ids", pa.binary()), ("whole", pa.binary())]))

        for batch in batches:
            for vec_id, vector in zip(batch.column("vec_id").to_pylist(), batch.column("embedding")):
                x = np.asarray(vector.values.to_numpy(zero_copy_only=False), np.float64)
                held.setdefault(len(x), []).append((vec_id, np.clip(np.floor(SCALE * x), -(2.0**62), 2.0**62).astype(np.int64)))
                if len(held[len(x)]) == size:
                    yield flush(len(x))
        for dim in list(held):
            yield flush(dim)

    return vectors.mapInArrow(run, "dim int, ids binary, whole binary")


def statistics(whole: np.ndarray, segments: int) -> np.ndarray:
    """Per vector the scaled means and the deviations of its segments: their dot product bounds the inner product from above."""
    parts = np.array_split(np.arange(whole.shape[1]), min(segments, max(1, whole.shape[1])))
    columns = []
    for p in parts:
        x = whole[:, p]
        mean = x.mean(1) if len(p) else np.zeros(len(x))
        columns += [mean * math.sqrt(len(p)), np.sqrt(((x - mean[:, None]) ** 2).sum(1))]
    return np.stack(columns, 1)


class Block:
    """A block of candidates with what bounds need of it."""

    def __init__(self, ids: np.ndarray, whole: np.ndarray):
        self.ids, self.whole = ids, whole
        self.float = whole.astype(np.float64)
        self.levels = [statistics(self.float, s) for s in SEGMENTS]
        self.single = self.float.astype(np.float32)
        self.norm, self.most = float(np.linalg.norm(self.levels[0], axis=1).max(initial=0)), float(np.abs(self.float).max(initial=0))


class Search(Block):
    """The best k of one block of queries over the candidate blocks it is shown."""

    def __init__(self, ids: np.ndarray, whole: np.ndarray, k: int, least: np.ndarray | None = None):
        super().__init__(ids, whole)
        self.k = k
        self.best: list[list[tuple[int, int]]] = [[] for _ in ids]  # (-score, vec_id), sorted
        self.least = np.full(len(ids), -np.inf) if least is None else least.copy()

    def offer(self, q: np.ndarray, c: np.ndarray, block: Block) -> None:
        """Integer inner products of pairs, with Python's integers where a long might overflow; those that reach a query's k-th best so far."""
        if self.most * block.most * max(1, self.whole.shape[1]) < 2.0**62:
            exact = np.einsum("ij,ij->i", self.whole[q], block.whole[c])
            keep = exact >= self.least[q]
            q, c, scores = q[keep], c[keep], exact[keep].tolist()
        else:
            scores = [max(-LONG - 1, min(LONG, sum(a * b for a, b in zip(self.whole[i].tolist(), block.whole[j].tolist())))) for i, j in zip(q.tolist(), c.tolist())]
        for i, score, vec_id in zip(q.tolist(), scores, block.ids[c].tolist()):
            best = self.best[i]
            if len(best) < self.k or (-score, vec_id) < best[-1]:
                insort(best, (-score, vec_id))
                del best[self.k :]
                if len(best) == self.k:
                    self.least[i] = max(self.least[i], -best[-1][0])

    def show(self, block: Block) -> None:
        """Bound, prune and score a block of candidates."""
        slack = 1e-9 * self.norm * block.norm + 1e-6
        bound = self.levels[0] @ block.levels[0].T
        if np.isin(block.ids, self.ids).any():
            bound[self.ids[:, None] == block.ids[None]] = -np.inf
        first = min(self.k, len(block.ids))
        open_ = np.flatnonzero(np.isneginf(self.least))
        if len(open_):  # a first threshold from the candidates with the best bounds
            top = np.argpartition(-bound[open_], first - 1, axis=1)[:, :first]
            q, c = np.repeat(open_, first), top.ravel()
            real = ~np.isneginf(bound[q, c])
            self.offer(q[real], c[real], block)
            bound[q, c] = -np.inf
        floor = (self.least - slack)[:, None]
        near = bound >= floor
        if len(open_):
            near &= bound > -np.inf
        for mine, theirs in zip(self.levels[1:], block.levels[1:]):
            left = np.count_nonzero(near) * 8
            if left > 7 * near.size:  # bounds tell too little here: finer ones cost as much as the product
                break
            if left > near.size:  # many pairs are left: bound all
                near &= mine @ theirs.T >= floor
            else:
                q, c = np.nonzero(near)
                near[q, c] = np.einsum("ij,ij->i", mine[q], theirs[c]) + slack >= self.least[q]
        reach = self.norm * block.norm  # no partial sum of an inner product is larger
        if reach < 2.0**53 and np.count_nonzero(near) * 8 > near.size:
            mine, theirs = (self.single, block.single) if reach < 2.0**24 else (self.float, block.float)
            near &= mine @ theirs.T >= self.least[:, None].astype(mine.dtype)
        q, c = np.nonzero(near)
        for part in range(0, len(q), 65536):
            self.offer(q[part : part + 65536], c[part : part + 65536], block)

    def rows(self) -> list[tuple[int, int, int]]:
        return [(int(i), vec_id, -negative) for i, best in zip(self.ids, self.best) for negative, vec_id in best]


def unpack(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """(ids, vectors) of a block."""
    ids = np.frombuffer(row["ids"], np.int64)
    return ids, np.frombuffer(row["whole"], np.int64).reshape(len(ids), row["dim"])


def thresholds(queries: DataFrame, first: list[dict], k: int) -> DataFrame:
    """``queries`` with ``least``, the k-th best score of each query over the ``first`` candidate blocks, or minus infinity."""
    shared = queries.sparkSession.sparkContext.broadcast(first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [(c["dim"], Block(*unpack(c))) for c in shared.value]
        for batch in batches:
            least = []
            for q in batch.to_pylist():
                search = Search(*unpack(q), k)
                for dim, block in blocks:
                    if dim == q["dim"]:
                        search.show(block)
                least.append(search.least.tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least, pa.binary())], [*batch.schema.names, "least"])

    return queries.mapInArrow(run, "dim int, ids binary, whole binary, least binary")


def search(candidates: DataFrame, queries: list[dict], k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of each query in the blocks of ``queries``, which hold GROUP bytes at most."""
    shared = candidates.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine: dict[int, list[Search]] = {}
        for q in shared.value:
            mine.setdefault(q["dim"], []).append(Search(*unpack(q), k, np.frombuffer(q["least"])))
        for batch in batches:
            for c in batch.to_pylist():
                block = Block(*unpack(c))
                for s in mine[c["dim"]]:
                    s.show(block)
        for some in mine.values():
            for s in some:
                columns = list(zip(*s.rows())) or [[]] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

    found = candidates.where(F.col("dim").isin(sorted({q["dim"] for q in queries}))).mapInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def grouped(queries: DataFrame) -> Iterator[list[dict]]:
    """Blocks of queries in groups of GROUP bytes at most (or one block), read one after the other."""
    group, size = [], 0
    for r in queries.toLocalIterator():
        if group and size + len(r["whole"]) > GROUP:
            yield group
            group, size = [], 0
        group.append(r.asDict())
        size += len(r["whole"])
    if group:
        yield group


def top(embeddings: DataFrame, every: int, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): for rows whose vec_id is divisible by ``every`` the k best of all other rows."""
    spark = embeddings.sparkSession
    ship(spark)
    vectors = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & usable())
    candidates = stored(blocks(vectors, CANDIDATE_BLOCK), spark)
    asked = vectors.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    first = [r.asDict() for r in candidates.limit(FIRST).collect()]
    queries = stored(thresholds(blocks(asked, QUERY_BLOCK), first, k), spark)
    path, written = scratch(spark), False
    for group in grouped(queries):
        search(candidates, group, k).write.mode("append").parquet(path)
        written = True
    return spark.read.schema(FOUND).parquet(path) if written else spark.createDataFrame([], FOUND)


def query(spark: SparkSession, embeddings: DataFrame) -> DataFrame:
    """The 5 best of every row whose vec_id is divisible by 50."""
    return top(embeddings, 50, 5)


ORACLE = """
WITH v AS (SELECT vec_id, embedding AS e, row_number() OVER () AS row, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT vec_id, arg_min(w, e) AS w FROM v WHERE vec_id % 50 = 0 GROUP BY vec_id),
e AS (SELECT vec_id, row, len(w) AS d, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM v),
u AS (SELECT vec_id, len(w) AS d, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM q),
s AS (SELECT u.vec_id AS query_id, e.vec_id AS vec_id, e.row, CAST(sum(u.x * e.x) AS BIGINT) AS score FROM u JOIN e ON u.i = e.i AND u.d = e.d AND u.vec_id <> e.vec_id GROUP BY ALL)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
