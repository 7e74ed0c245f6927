"""N-gram Jaccard join by chosen paths.

A document is the set of its runs of five words (a shorter text is one run of
all its words). Equal sets are joined at once, by a 128-bit fingerprint; the
rest of the work is on distinct sets.

Chosen paths: in each of several independent runs a set chooses each of its
tokens with probability 1 / (similarity x size) by a hash that all sets share,
and goes into the bucket of every token it chose. Buckets of at most ``LIMIT``
sets are compared by brute force; larger ones are split again by tokens chosen
with a hash of the path so far, down to ``DEPTH`` tokens, so sets that only share a
common passage drift apart while similar sets stay together. A pair at the
threshold survives a level with the probability of a branching process;
``repeats`` gives the number of runs that reaches the target recall at full
depth, and pairs that meet in small buckets earlier are found more surely.

Within a bucket, sets are compared by 64 min-hashes; the margin is more than five
standard deviations. A bucket gives a spanning forest of its candidate links.
Each component of candidates is then compared all against all by exact
intersections. Buckets and components are dealt to pairs of blocks, so a task
group holds a bounded number of sets whatever the size of a group of copies.

Result: per document the class (the smallest doc_id reachable over links) and
the number of other documents linked to it. Null and empty texts have no words
and link with nothing. Repeated rows are documents each, linked to each other.
A null doc_id is larger than any other. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqmotif.llm.common import Memo, block_pairs, components, forest, fresh, texts, whole_groups
from seqmotif.session import ship, stored

WORDS, LIMIT, DEPTH, SKETCH, BUCKET_BLOCK, SET_BLOCK = 5, 64, 3, 64, 500, 200
SIGNED = "uid long, doc_id long, text_key long, f1 long, f2 long, n int, p1 array<long>, p2 array<struct<parent:long,child:long>>, p3 array<struct<parent:long,child:long>>, sketch binary"


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def survival(depth: int) -> float:
    """The chance that a pair at the threshold shares a path of ``depth`` tokens: one shared choice a level on average."""
    p = 1.0
    for _ in range(depth):
        p = 1 - math.exp(-p)
    return p


def repeats(recall: float, depth: int = DEPTH) -> int:
    """Runs that reach the recall for pairs at the threshold and full depth."""
    return math.ceil(math.log(1 - recall) / math.log(1 - survival(depth)))


class Shingler:
    """Sorted distinct 64-bit hashes of a text's word runs."""

    def __init__(self, words: int = WORDS):
        self.words = words
        self.known = Memo(xxhash.xxh3_64_intdigest)

    def tokens(self, text: str) -> np.ndarray:
        split = text.split()
        if not split:
            return np.zeros(0, np.uint64)
        h = np.fromiter(map(self.known.__getitem__, split), np.uint64, len(split))
        k = min(self.words, len(h))
        run = np.full(len(h) - k + 1, k, np.uint64)
        for i in range(k):
            run = mix(run * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
        return np.unique(run)


def choose(tokens: np.ndarray, paths: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(index of the path, longer path) of every token chosen by each path."""
    limit = min(1.0, 1 / (similarity * len(tokens)))
    bound = np.uint64(min(2**64 - 1, int(limit * 2**64)))
    at, child = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for first in range(0, len(paths), max(1, 2_000_000 // len(tokens))):
        some = paths[first : first + max(1, 2_000_000 // len(tokens))]
        row, col = np.nonzero(mix(tokens[None] ^ some[:, None]) <= bound)
        at.append(row + first)
        child.append(mix(some[row] * np.uint64(0x9E3779B97F4A7C15) ^ mix(tokens[col])))
    return np.concatenate(at), np.concatenate(child)


def sketch(tokens: np.ndarray) -> bytes:
    """64 min-hashes of 16 bits."""
    seeds = mix(np.arange(1, SKETCH + 1, dtype=np.uint64) << np.uint64(20))
    least = np.full(SKETCH, np.uint64(2**64 - 1))
    for first in range(0, len(tokens), 32768):
        least = np.minimum(least, mix(tokens[None, first : first + 32768] ^ seeds[:, None]).min(1))
    return (least & np.uint64(0xFFFF)).astype(np.uint16).tobytes()


def sign(documents: DataFrame, similarity: float, runs: int, words: int) -> DataFrame:
    """The stored table of SIGNED: fingerprint, size, chosen paths of all levels and sketch of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seeds = Shingler(words), mix(np.arange(1, runs + 1, dtype=np.uint64) << np.uint64(40))
        pairs = pa.list_(pa.struct([("parent", pa.int64()), ("child", pa.int64())]))
        schema = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("n", pa.int32()), ("p1", pa.list_(pa.int64())), ("p2", pairs), ("p3", pairs), ("sketch", pa.binary())])

        def structs(levels: list[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
            ends = np.concatenate([[0], np.cumsum([len(c) for _, c in levels])]).astype(np.int32)
            flat = [np.concatenate([np.zeros(0, np.uint64), *x]).view(np.int64) for x in ([p for p, _ in levels], [c for _, c in levels])]
            return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(x) for x in flat], ["parent", "child"]))

        for whole in batches:
            for part in range(0, whole.num_rows, 2000):
                batch = whole.slice(part, 2000)
                f1, f2, n, p1, p2, p3, sketches = [], [], [], [], [], [], []
                for text in texts(batch):
                    tokens = shingler.tokens(text)
                    print_ = xxhash.xxh3_128_intdigest(tokens.tobytes())
                    f1.append((print_ >> 64) - (1 << 63))
                    f2.append((print_ & (2**64 - 1)) - (1 << 63))
                    n.append(len(tokens))
                    paths = [(seeds, seeds)]
                    for _ in range(DEPTH):
                        before = paths[-1][1]
                        at, child = choose(tokens, before, similarity) if len(tokens) and len(before) else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
                        paths.append((before[at], child))
                    p1.append(paths[1][1].view(np.int64))
                    p2.append(paths[2])
                    p3.append(paths[3])
                    sketches.append(sketch(tokens) if len(tokens) else b"")
                columns = [batch.column(c) for c in ("uid", "doc_id", "text_key")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(n, pa.int32()), pa.array(p1, pa.list_(pa.int64())), structs(p2), structs(p3), pa.array(sketches, pa.binary())], schema=schema)

    rows = documents.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    return stored(rows.mapInArrow(run, SIGNED), documents.sparkSession)


def candidates(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """(a, b): a spanning forest of the pairs of each bucket whose min-hashes agree in ``least`` places at least."""
    for table, starts in whole_groups(batches, ["path", "ba", "bb"]):
        ids = table.column("set_id").to_numpy()
        marks = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint16).reshape(len(ids), SKETCH)
        sizes = np.diff(starts)
        found = []
        for n in np.unique(sizes[sizes > 1]).tolist():
            heads = starts[:-1][sizes == n]
            if n <= 8:  # all buckets of this size at once
                for i in range(n):
                    for j in range(i + 1, n):
                        hit = heads[(marks[heads + i] == marks[heads + j]).sum(1) >= least]
                        found.append((ids[hit + i], ids[hit + j]))
                continue
            for head in heads.tolist():
                m = marks[head : head + n]
                agree = np.zeros((n, n), np.uint8)
                for k in range(SKETCH):
                    agree += m[:, k, None] == m[None, :, k]
                a, b = forest(agree >= least)
                found.append((ids[head + a], ids[head + b]))
        if found:
            a, b = (np.concatenate(x) for x in zip(*found))
            keep = a != b
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[keep]), pa.array(np.maximum(a, b)[keep])], ["a", "b"])


def least_agreement(similarity: float, deviations: float = 5.3) -> int:
    """Min-hashes that a pair at the threshold agrees in but for that many standard deviations: 34 of 64 at 0.8."""
    return max(0, math.floor(SKETCH * similarity - deviations * math.sqrt(SKETCH * similarity * (1 - similarity))))


def candidate_edges(sets: DataFrame, spark: SparkSession, least: int) -> DataFrame:
    """Candidate links among distinct sets that agree in ``least`` min-hashes, over all levels of the recursion."""
    edges = None
    rows = sets.select(F.explode("p1").alias("path"), "set_id")
    for level in range(1, DEPTH + 1):
        rows = stored(rows.distinct(), spark)
        sizes = stored(rows.groupBy("path").agg(F.count("*").alias("size")).where("size > 1"), spark)
        met = stored(rows.join(sizes, "path"), spark)
        ready = met if level == DEPTH else met.where(F.col("size") <= LIMIT)
        ready = ready.select("path", "set_id").join(sets.select("set_id", "sketch"), "set_id")
        if level == DEPTH:
            dealt = block_pairs(ready, "path", "set_id", BUCKET_BLOCK)
        else:
            dealt = ready.withColumns({"ba": F.lit(0).cast("long"), "bb": F.lit(0).cast("long")})
        dealt = dealt.select("path", "ba", "bb", "set_id", "sketch")
        found = dealt.repartition("path", "ba", "bb").sortWithinPartitions("path", "ba", "bb", "set_id").mapInArrow(lambda b: candidates(b, least), "a long, b long").distinct()
        edges = found if edges is None else edges.unionByName(found)
        if level < DEPTH:
            large = met.where(F.col("size") > LIMIT).select("path", "set_id")
            deeper = large.join(sets.select("set_id", f"p{level + 1}"), "set_id")
            rows = deeper.select("set_id", F.explode(F.filter(f"p{level + 1}", lambda x: x["parent"] == F.col("path"))).alias("x")).select(F.col("x.child").alias("path"), "set_id")
    return stored(edges.distinct(), spark)


def exact(batches: Iterator[pa.RecordBatch], similarity: tuple[int, int], words: int) -> Iterator[pa.RecordBatch]:
    """(a, b, n): exact links of each group's sets: a forest of them (a, b), and (a, null, documents linked to a)."""
    up, down = similarity
    shingler = Shingler(words)
    for table, starts in whole_groups(batches, ["component", "ba", "bb"]):
        ids, weight, left, ba, bb = (table.column(c).to_numpy() for c in ("set_id", "weight", "left", "ba", "bb"))
        column = table.column("text")
        out_a, out_b, out_n = [], [], []
        for start, end in zip(starts[:-1].tolist(), starts[1:].tolist()):
            sets = [shingler.tokens(t or "") for t in column.slice(start, end - start).to_pylist()]
            count = np.array([len(s) for s in sets])
            flat, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), count)
            _, token, times = np.unique(flat, return_inverse=True, return_counts=True)
            common = times > 1
            token, of = (np.cumsum(common) - 1)[token[common[token]]], of[common[token]]
            inter = np.zeros((len(sets), len(sets)), np.int64)
            order = np.argsort(token, kind="stable")
            token, of = token[order], of[order]
            for first in range(0, int(common.sum()), 4096):
                lo, hi = np.searchsorted(token, [first, first + 4096])
                x = np.zeros((len(sets), 4096), np.float32)
                x[of[lo:hi], token[lo:hi] - first] = 1
                inter += np.rint(x @ x.T).astype(np.int64)
            links = down * inter >= up * (count[:, None] + count[None] - inter)
            links[np.arange(len(sets)), np.arange(len(sets))] = False
            if ba[start] != bb[start]:  # pairs within a block are counted where the block meets itself
                mine = left[start:end]
                links &= mine[:, None] != mine[None]
            a, b = forest(links)
            out_a += [ids[start + a], ids[start:end]]
            out_b += [ids[start + b], np.full(end - start, -1)]
            out_n += [np.zeros(len(a), np.int64), links @ weight[start:end]]
        a, b, n = map(np.concatenate, (out_a, out_b, out_n))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n)], ["a", "b", "n"])


def join(documents: DataFrame, similarity: tuple[int, int] = (4, 5), recall: float = 0.999, words: int = WORDS) -> DataFrame:
    """(doc_id, text_key, class_id, n_links, first) per document; ``first`` marks the one document of each class.

    ``text_key`` is xxhash64 of the text. Of rows that repeat the first
    document, doc_id and text, each is marked.
    """
    spark = documents.sparkSession
    ship(spark)
    signed = sign(documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), similarity[0] / similarity[1], repeats(recall), words)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key", "uid")
    groups = signed.where("n > 0").groupBy("f1", "f2").agg(F.min("uid").alias("set_id"), F.count("*").alias("weight"), F.min(order).alias("least"))
    groups = stored(groups, spark)
    sets = stored(signed.join(groups.select("set_id"), signed["uid"] == F.col("set_id")).select("set_id", "doc_id", "text_key", "p1", "p2", "p3", "sketch"), spark)
    near = components(candidate_edges(sets, spark, least_agreement(similarity[0] / similarity[1])), spark, stored)
    members = sets.select("set_id", "doc_id", "text_key").join(near.withColumnRenamed("id", "set_id"), "set_id").join(groups.select("set_id", "weight"), "set_id")
    read = documents.select(F.col("doc_id").cast("long").alias("_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("_key", F.xxhash64("text"))
    whole = read.join(members, (F.col("_key") == F.col("text_key")) & F.col("_id").eqNullSafe(F.col("doc_id"))).select("component", "set_id", "weight", "text").dropDuplicates(["set_id"])
    pairs = block_pairs(stored(whole, spark), "component", "set_id", SET_BLOCK)
    checked = pairs.repartition("component", "ba", "bb").sortWithinPartitions("component", "ba", "bb", "set_id").mapInArrow(lambda b: exact(b, similarity, words), "a long, b long, n long")
    checked = stored(checked, spark)
    classes = components(checked.where("b >= 0").select("a", "b"), spark, stored)
    linked = checked.where("b < 0").groupBy("a").agg(F.sum("n").alias("others"))
    known = groups.join(linked, groups["set_id"] == linked["a"], "left").join(classes, groups["set_id"] == classes["id"], "left")
    known = known.select("f1", "f2", "least", F.coalesce("component", "set_id").alias("component"), (F.col("weight") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    known = stored(known, spark)
    firsts = known.groupBy("component").agg(F.min("least").alias("first"))
    known = stored(known.drop("least").join(firsts, "component").select("f1", "f2", "n_links", "first"), spark)
    out = signed.select("doc_id", "text_key", "f1", "f2", "n").join(known, ["f1", "f2"], "left")
    mine = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))
    return out.select("doc_id", "text_key", F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("first").isNull(), True).otherwise(mine).alias("first"))


def deduplicate(documents: DataFrame, similarity: tuple[int, int] = (4, 5), recall: float = 0.999) -> DataFrame:
    """``documents`` with one document of each class, all columns whatever their names; rows that repeat both doc_id and text count as one."""
    own, key, kept_id, kept_key = (fresh([*documents.columns], stem) for stem in ("own_id", "own_key", "kept_id", "kept_key"))
    kept = join(documents, similarity, recall).where("first").select(F.col("doc_id").alias(kept_id), F.col("text_key").alias(kept_key)).distinct()
    keyed = documents.withColumns({own: F.col("doc_id").cast("long"), key: F.xxhash64(F.coalesce("text", F.lit("")))})
    same = F.col(own).eqNullSafe(F.col(kept_id)) & (F.col(key) == F.col(kept_key))
    return keyed.join(kept, same, "left_semi").dropDuplicates([own, key]).drop(own, key)


def query(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, class_id, n_links."""
    return join(documents).select("doc_id", "class_id", "n_links")


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '') AS w FROM documents),
t AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i+4], ' '))) AS t FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM t a JOIN t b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 5 * i >= 4 * (x.n + y.n - i)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS class_id FROM r GROUP BY a),
k AS (SELECT a AS doc_id, count(*) AS n_links FROM l GROUP BY a)
SELECT doc_id, class_id, coalesce(n_links, 0) AS n_links FROM c LEFT JOIN k USING (doc_id)
"""
