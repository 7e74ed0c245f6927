"""Embedding near-duplicates by spherical-cap filters.

Filters are the words of a random product code: a vector is rotated and cut
into ``PARTS`` parts, each part has its own small set of random unit
directions, and a filter is one direction of each part. Each vector is
list-decoded: all filters whose inner product is within a margin of the
vector's best one, found part by part with the bound that the best directions
of the remaining parts give. A vector at cosine 0.98 of another differs from it
by 0.2 in an independent direction, of which a filter sees about 0.2 / sqrt(d);
the margin is several times that. A bucket holds hundreds of vectors rather than
a few, as fewer and larger filters mean fewer copies of a vector.

What is copied to the buckets is a vector's code, a byte a component with the
norm of what it leaves out, which bounds the cosine from above. Large buckets are
dealt to pairs of blocks, so a task group holds a bounded number of vectors; a
bucket yields a spanning forest of the pairs whose bound reaches the threshold.
Components of those are then compared all against all in double precision, again
in pairs of blocks, which gives the links, a forest of them and each vector's number.

Vectors that are null, zero or hold null or non-finite components, and rows
with a null label or vec_id, link with nothing; each is its own component.
Vectors of different lengths don't link. Rows that repeat a vec_id count as one
vector, the first in the order of label and stored bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from seqmotif.llm.common import block_pairs, components, forest, whole_groups
from seqmotif.llm.topk import usable
from seqmotif.session import ship, stored

#: The margin is MARGIN / sqrt(dimension); a filter is meant for so many of all vectors.
PARTS, MARGIN, BLOCK, SHARE = 4, 0.36, 1000, 1024


class Code:
    """The random product code for vectors of one dimension."""

    def __init__(self, dim: int, size: int):
        rng = np.random.default_rng(dim * 1009 + size)
        self.rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        self.cuts = np.array_split(np.arange(dim), min(PARTS, dim))
        self.words = []
        for cut in self.cuts:
            words = rng.standard_normal((size, len(cut)))
            self.words.append(words / np.linalg.norm(words, axis=1, keepdims=True) / np.sqrt(len(self.cuts)))
        self.size, self.margin = size, MARGIN / np.sqrt(dim)

    def decode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of all filters within the margin of each row's best."""
        rotated = vectors @ self.rotation
        scores = [rotated[:, cut] @ words.T for cut, words in zip(self.cuts, self.words)]
        lost = [s.max(1, keepdims=True) - s for s in scores]
        row, code, gap = np.arange(len(vectors)), np.zeros(len(vectors), np.int64), np.zeros(len(vectors))
        for part in lost:
            total = gap[:, None] + part[row]
            at, word = np.nonzero(total <= self.margin)
            row, code, gap = row[at], code[at] * self.size + word, total[at, word]
        return row, code


def unit(rows: list[bytes], kind: type) -> np.ndarray:
    """Unit vectors in double precision of stored vectors of one dimension, whose components are of type ``kind``."""
    x = np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def encode(x: np.ndarray) -> list[bytes]:
    """Per unit vector a byte a component behind two floats, the step and the norm of the error (rounded up)."""
    step = (np.abs(x).max(1, keepdims=True) / 127).astype(np.float32)
    whole = np.rint(x / step).astype(np.int8)
    error = np.linalg.norm(x - whole * step.astype(np.float64), axis=1, keepdims=True) * (1 + 1e-6) + 1e-6
    both = np.concatenate([step, error.astype(np.float32)], axis=1).view(np.uint8)
    return [row.tobytes() for row in np.concatenate([both, whole.view(np.uint8)], axis=1)]


def kind_of(embeddings: DataFrame) -> type:
    """The type that holds components without loss: single precision if the column has it, double otherwise."""
    return np.float32 if embeddings.schema["embedding"].dataType.elementType == FloatType() else np.float64


def prepare(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, dim, vector): usable vectors of labelled rows, components as they are given."""
    kind = kind_of(embeddings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for vec_id, label, vector in zip(batch.column("vec_id").to_pylist(), batch.column("label").to_pylist(), batch.column("embedding")):
                x = np.asarray(vector.values.to_numpy(zero_copy_only=False), np.float64)
                if np.abs(x).max(initial=0) > 0:
                    out.append((vec_id, label, len(x), x.astype(kind).tobytes()))
            columns = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int32(), pa.binary()))], ["vec_id", "label", "dim", "vector"])

    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding")
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable())
    found = rows.mapInArrow(run, "vec_id long, label string, dim int, vector binary")
    return found.groupBy("vec_id").agg(F.min(F.struct("label", "dim", "vector")).alias("v")).select("vec_id", "v.*")


def filtered(vectors: DataFrame, size: int, kind: type, coded: bool) -> DataFrame:
    """(bucket, vec_id, code): each vector under every filter it exceeds; label and dimension are part of the bucket's key. Codes on request."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[int, Code] = {}
        for batch in batches:
            dims, labels, ids = batch.column("dim").to_numpy(), batch.column("label").to_pylist(), batch.column("vec_id").to_numpy()
            for dim in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == dim)
                code = codes.setdefault(dim, Code(dim, size))
                for part in range(0, len(rows), 1000):
                    mine = rows[part : part + 1000]
                    x = unit(batch.column("vector").take(pa.array(mine)).to_pylist(), kind)
                    row, word = code.decode(x)
                    salt = np.array([xxhash.xxh3_64_intdigest(f"{dim} {labels[k]}") for k in mine.tolist()], np.uint64)
                    key = (word.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ salt[row]
                    columns = [pa.array(key.view(np.int64)), pa.array(ids[mine[row]])]
                    if coded:
                        columns.append(pa.array(encode(x), pa.binary()).take(pa.array(row)))
                    yield pa.RecordBatch.from_arrays(columns, ["bucket", "vec_id", "code"][: len(columns)])

    return vectors.mapInArrow(run, "bucket long, vec_id long" + ", code binary" * coded)


def close(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """(a, b): a spanning forest of the pairs of each group (bucket, ba, bb) whose codes allow a link."""
    for table, starts in whole_groups(batches, ["bucket", "ba", "bb"]):
        ids, sizes = table.column("vec_id").to_numpy(), np.diff(starts)
        codes = table.column("code").to_pylist()
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for start, n in zip(starts[:-1].tolist(), sizes.tolist()):
            if n < 2:
                continue
            of: dict[int, list[int]] = {}
            for k in range(start, start + n):
                of.setdefault(len(codes[k]), []).append(k)
            for rows in map(np.array, of.values()):
                raw = np.frombuffer(b"".join(codes[k] for k in rows.tolist()), np.uint8).reshape(len(rows), -1)
                step, error = np.ascontiguousarray(raw[:, :8]).view(np.float32).T
                x = raw[:, 8:].view(np.int8).astype(np.float32) * step[:, None]
                # x.y = x'.y' + (x - x').y' + x.(y - y'), and y' is at most 1 + its error long
                product = x @ x.T
                product += (error * (1 + error.max()))[:, None]
                product += error
                near = product >= np.float32(threshold - 1e-4)  # single precision
                a, b = forest(near | near.T)
                found.append((ids[rows[a]], ids[rows[b]]))
        if found:
            a, b = (np.concatenate(x) for x in zip(*found))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def count_links(batches: Iterator[pa.RecordBatch], threshold: float, kind: type) -> Iterator[pa.RecordBatch]:
    """(a, b, n): exact links in a component's block or between two: a forest of them (a, b, -1), and (a, a, number of links)."""
    for table, starts in whole_groups(batches, ["component", "ba", "bb"]):
        ids, left, ba, bb = (table.column(c).to_numpy() for c in ("vec_id", "left", "ba", "bb"))
        labels = np.unique(table.column("label").to_numpy(zero_copy_only=False).astype(str), return_inverse=True)[1]
        vectors = table.column("vector").to_pylist()
        n = np.zeros(len(ids), np.int64)
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for start, end in zip(starts[:-1].tolist(), starts[1:].tolist()):
            of: dict[int, list[int]] = {}
            for k in range(start, end):
                of.setdefault(len(vectors[k]), []).append(k)
            for rows in map(np.array, of.values()):
                x = unit([vectors[k] for k in rows.tolist()], kind)
                links = (x @ x.T >= threshold) & (labels[rows][:, None] == labels[rows])
                links[np.arange(len(rows)), np.arange(len(rows))] = False
                if ba[start] != bb[start]:  # pairs within a block are counted where the block meets itself
                    links &= left[rows][:, None] != left[rows]
                links |= links.T
                n[rows] = links.sum(1)
                a, b = forest(links)
                out.append((ids[rows[a]], ids[rows[b]]))
        a, b = (np.concatenate(x) for x in zip(*out))
        columns = [np.concatenate([a, ids]), np.concatenate([b, ids]), np.concatenate([np.full(len(a), -1), n])]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "b", "n"])


def link(embeddings: DataFrame, threshold: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    spark = embeddings.sparkSession
    ship(spark)
    vectors = stored(prepare(embeddings), spark)
    kind = kind_of(embeddings)
    size = int(min(96, max(2, np.ceil((vectors.count() / SHARE) ** (1 / PARTS)))))
    counts = filtered(vectors, size, kind, False).groupBy("bucket").agg(F.count("*").alias("n"))
    large = stored(counts.where(F.col("n") > BLOCK).select("bucket", F.ceil(F.col("n") / BLOCK).cast("long").alias("blocks")), spark)
    dealt = filtered(vectors, size, kind, True).join(F.broadcast(large), "bucket", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
    dealt = dealt.withColumn("left", F.pmod(F.xxhash64("vec_id"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("bucket", F.least("left", "other").alias("ba"), F.greatest("left", "other").alias("bb"), "vec_id", "code")
    edges = dealt.repartition("bucket", "ba", "bb").sortWithinPartitions("bucket", "ba", "bb", "vec_id").mapInArrow(lambda b: close(b, threshold), "a long, b long")
    near = components(stored(edges.distinct(), spark), spark, stored)
    members = vectors.join(near, vectors["vec_id"] == near["id"]).select("component", "vec_id", "label", "vector")
    pairs = block_pairs(members, "component", "vec_id", BLOCK)
    checked = pairs.repartition("component", "ba", "bb").sortWithinPartitions("component", "ba", "bb").mapInArrow(lambda b: count_links(b, threshold, kind), "a long, b long, n long")
    checked = stored(checked, spark)
    groups = components(checked.where("n < 0").select("a", "b"), spark, stored)
    links = checked.where("n >= 0").groupBy(F.col("a").alias("vec_id")).agg(F.sum("n").alias("n_links")).withColumnRenamed("vec_id", "id").join(groups, "id")
    out = embeddings.select(F.col("vec_id").cast("long").alias("vec_id")).join(links, F.col("vec_id") == F.col("id"), "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def query(spark: SparkSession, embeddings: DataFrame) -> DataFrame:
    """One row per vector."""
    return link(embeddings)


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT vec_id, label, list_transform(e, lambda x: CAST(x AS DOUBLE)) AS e FROM v),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM p a JOIN p b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""
