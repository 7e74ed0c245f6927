"""Best-fit packing by a configuration linear program over the length histogram.

1. Every document is tokenised whole (null text: empty) and ends with id 0;
   documents longer than a sequence are cut into pieces. Only (doc_id, piece,
   start, length, checksum) is kept, as a stored table.
2. The driver sees the histogram of lengths alone: ``capacity`` numbers at most.
   A row of the program is a length, or, where there are more than ``ROWS``, a
   run of neighbouring lengths of about equal volume that counts as its longest.
   Minimise the number of sequences over all configurations (multisets of rows
   that fit), such that every row is covered. Multiplicative weights: a row's
   price falls exponentially with its coverage so far; each round adds the
   configuration of the highest price, by as much as covers one row
   once more, so that no step is wider than one. The knapsack dynamic program
   prices all configurations; between two of its runs those already found are
   priced, as long as one of them is nearly as good. The average, scaled
   so that every row is covered, is feasible; the prices, scaled by the
   program's best price over true lengths, are a feasible dual solution, whose value
   bounds every packing from below.
3. The solution is rounded by running sums, each configuration to a whole number of
   sequences; a row's slots take its longest pieces first. What slots leave free and what
   remains of the histogram is packed best-fit decreasing.
   Work and plan depend on ``capacity`` and ``rounds``, not on the number of documents.
4. Pieces get their rank among those of equal length from sharded windows
   (a shard holds about ``SHARD`` rows, however common a length is), and the
   plan, sent to all tasks, turns (length, rank) into a sequence and an offset.

Repeated rows are packed once each. A null doc_id is kept. Extra columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqmotif.llm.common import portions, texts
from seqmotif.session import ship, stored

CAPACITY = 2048
SHARD = 50_000
#: Shares of the solution that are tried.
SHARES = (1.0, 0.99, 0.98, 0.95, 0.9, 0.8, 0.65, 0.5, 0.35, 0.2, 0.1)
#: Rows of the linear program, how steeply prices fall, and steps with known configurations between two runs of the dynamic program.
ROWS, STEEP, INNER = 96, 0.15, 400
#: Words a worker remembers, some 200 bytes each, or fewer where other operators need the memory too, and texts whose pieces it does.
WORDS, FEWER, TEXTS = 1_400_000, 700_000, 50_000
#: Signs that end a word of letters; an apostrophe may belong to it.
SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: A space before white space.
BEFORE = re.compile(r" \s")


class Tokens:
    """Little-endian 32-bit ids of texts, as `tokenizers` gives them; ids of words with the space before them are remembered.

    The tokenizer splits text before every space that is not between white
    space, so that a space and what follows it are encoded alike wherever they stand. A text that holds
    one of the tokenizer's added tokens is encoded in one go, unless ``plainly``,
    which reads these as any other text.
    """

    def __init__(self, path: str, plainly: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plainly
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.sizes[list(vocabulary.values())] = list(map(len, vocabulary))  # a letter of a byte-level vocabulary is a byte
        self.whole = ["\x00"] + ([] if plainly else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()])
        self.room = WORDS
        self.known: dict[str, bytes] = {}
        self.signs: dict[str, bytes] = {}

    def unsafe(self, text: str) -> bool:
        """Must the text be encoded in one go? For cutting before a space changes how text is split only between white space."""
        return text.endswith(" ") or BEFORE.search(text) is not None or any(x in text for x in self.whole)

    def raw(self, some: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]

    def learn(self, new: set[str]) -> None:
        """Remember the ids of new words with a space before them.

        Words are encoded in one go and told apart by their bytes. Signs behind a word of letters are split from it by the
        tokenizer too, so both are encoded by themselves.
        """
        known, signs = self.known, self.signs
        parted = [(w, head, w[len(head) :]) for w in new if (head := w.rstrip(SIGNS)) != w and head.isalpha()]
        if fresh := [*{end for _, _, end in parted}.difference(signs)]:
            signs.update(zip(fresh, self.raw(fresh)))
        wanted = new.difference([w for w, _, _ in parted])
        wanted.update(head for _, head, _ in parted if head not in known)
        joint = [w for w in wanted if w and not w[0].isspace()]
        alone = wanted.difference(joint)
        if joint:
            text = " " + " ".join(joint)
            whole = self.raw([text])[0]
            at = np.cumsum(self.sizes[np.frombuffer(whole, "<u4")])
            ends = np.cumsum(np.fromiter(map(len, joint if text.isascii() else map(str.encode, joint)), np.int64, len(joint)) + 1)
            last = np.minimum(np.searchsorted(at, ends), len(at) - 1)
            if (at[last] == ends).all():
                stops = (4 * (last + 1)).tolist()
                known.update(zip(joint, map(whole.__getitem__, map(slice, [0, *stops], stops))))
            else:
                alone.update(joint)
        some = list(alone)
        known.update(zip(some, self.raw([" " + w for w in some])))
        known.update([(w, known[head] + signs[end]) for w, head, end in parted])

    def encode(self, some: list[str]) -> list[bytes]:
        cut = [None if self.unsafe(t) else t.split(" ") for t in some]
        if len(self.known) > self.room:
            self.known.clear()
        self.signs = {} if len(self.signs) > self.room else self.signs
        firsts = dict(zip(alone := [*{words[0] for words in cut if words}], self.raw(alone)))
        rest = [words[1:] if words else [] for words in cut]
        self.learn(set().union(*rest).difference(self.known))
        get = self.known.__getitem__
        return [self.raw([t])[0] if words is None else firsts[words[0]] + b"".join(map(get, more)) for t, words, more in zip(some, cut, rest)]


_TOKENS: dict[tuple[str, bool], Tokens] = {}


def tokens(path: str, plainly: bool = False) -> Tokens:
    """This worker's tokenizer."""
    if (path, plainly) not in _TOKENS:
        _TOKENS[path, plainly] = Tokens(path, plainly)
    return _TOKENS[path, plainly]


def tokenizer_path() -> str:
    """Where the public tokenizer of this operator lies on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all full but the first."""
    first = n if n <= capacity else n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(documents: DataFrame, capacity: int = CAPACITY, path: str | None = None, words: int = WORDS) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece of every document; a worker remembers so many ``words``."""
    ship(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens(path or tokenizer_path())
        encoder.room = words
        known: dict[int, list[tuple]] = {}

        def parts(ids: bytes) -> list[tuple]:
            ids += b"\0\0\0\0"
            return [(p, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])) for p, (start, length) in enumerate(cut(len(ids) // 4, capacity))]

        for batch in batches:
            out: list[tuple] = []
            all_texts = texts(batch)
            keys = list(map(xxhash.xxh3_128_intdigest, all_texts))  # copies are encoded once
            if len(known) > TEXTS:
                known.clear()
            new = {key: t for key, t in zip(keys, all_texts) if key not in known}
            for run in portions(list(new.items()), size=lambda x: len(x[1])):
                known.update(zip((key for key, _ in run), map(parts, encoder.encode([t for _, t in run]))))
            for doc_id, key in zip(batch.column("doc_id").to_pylist(), keys):
                out += [(doc_id, *part) for part in known[key]]
            columns = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


Config = list[tuple[int, int]]  # (length, how many), longest first


def best_configuration(prices: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """(how many of each row, total price) of the multiset with the highest price that fits: unbounded knapsack, ``sizes`` ascending."""
    value, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fit = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for c in range(int(sizes[0]), capacity + 1):
        total = value[c - sizes[: fit[c]]] + prices[: fit[c]]
        k = int(total.argmax())
        if total[k] > value[c - 1]:
            value[c], last[c] = total[k], k
        else:
            value[c] = value[c - 1]
    counts, c = np.zeros(len(sizes), np.int64), capacity
    while c > 0:
        if last[c] >= 0:
            counts[last[c]] += 1
            c -= int(sizes[last[c]])
        else:
            c -= 1
    return counts, float(value[capacity])


def grouped(histogram: dict[int, int]) -> list[list[int]]:
    """The program's rows: every length, or runs of neighbouring lengths of about equal volume."""
    lengths = sorted(histogram)
    if len(lengths) <= ROWS:
        return [[x] for x in lengths]
    before = np.cumsum([x * histogram[x] for x in lengths])
    row = ((before - 1) * ROWS) // before[-1]
    return [[lengths[i] for i in np.flatnonzero(row == k)] for k in np.unique(row)]


def fractional(histogram: dict[int, int], capacity: int, rounds: int) -> tuple[list[list[int]], list[tuple[np.ndarray, float]], float]:
    """(rows, [(how many of each row, times)], lower bound): a feasible solution of the covering program, and a dual bound on any packing.

    Stops when the solution is within 0.3 per cent of the dual bound over rows, or after ``rounds`` runs of the dynamic program.
    """
    rows = grouped(histogram)
    sizes, least = (np.array([pick(r) for r in rows]) for pick in (max, min))
    demand = np.array([sum(histogram[x] for x in r) for r in rows], float)
    cover, found, times = np.zeros(len(rows)), np.zeros((0, len(rows))), np.zeros(0)
    dual, best = 0.0, np.ones(len(rows)) / len(rows)
    answer = (times, np.inf)
    for _ in range(rounds):
        prices = np.exp(-STEEP * (cover - cover.min())) / demand
        config, top = best_configuration(prices, sizes, capacity)
        config = np.minimum(config, demand)
        if (bound := float(demand @ prices) / top) > dual:
            dual, best = bound, prices
        same = np.flatnonzero((found == config).all(1))
        if not len(same):
            found, times = np.vstack([found, config]), np.append(times, 0.0)
        k = int(same[0]) if len(same) else len(found) - 1
        share = found / demand
        for _ in range(INNER):  # this configuration, then any known one that is good enough for the bound
            step = 1 / share[k].max()
            times[k] += step
            cover += step * share[k]
            prices = np.exp(-STEEP * (cover - cover.min())) / demand
            value = found @ prices
            k = int(value.argmax())
            if 1.002 * dual * value[k] < demand @ prices:
                break
        if cover.min() > 0:
            total = times.sum() / cover.min()
            if total < answer[1]:
                answer = (times / cover.min(), total)
            if total <= 1.003 * dual:
                break
    lower = float(demand @ best) / best_configuration(best[np.argsort(least)], np.sort(least), capacity)[1]
    solved = answer[0] if len(answer[0]) else times
    return rows, [(c.astype(np.int64), float(x)) for c, x in zip(found, solved) if x > 0], lower


def rounded(histogram: dict[int, int], rows: list[list[int]], found: list[tuple[np.ndarray, float]], share: float, capacity: int, longest: bool = True) -> tuple[list[tuple[int, Config]], int]:
    """(groups of equal sequences, pieces in slots of the program): ``share`` of each configuration, rounded by running sums; the rest best-fit decreasing."""
    left = {length: n for length, n in histogram.items() if n}
    room: dict[int, list[tuple[int, Config]]] = {}
    spaces: list[int] = []

    def put(space: int, times: int, config: Config) -> None:
        if times:
            if space not in room:
                room[space] = []
                insort(spaces, space)
            room[space].append((times, config))

    def fill(counts: np.ndarray) -> Config:
        """The longest pieces left for the slots of one sequence; with ``longest`` the last slot takes the longest of all that fits."""
        taken: dict[int, int] = {}
        used = 0
        last = int(np.flatnonzero(counts)[0])
        for k in np.flatnonzero(counts)[::-1].tolist():
            need = int(counts[k]) - (longest and k == last)
            for x in reversed(rows[k]):
                n = min(need, left.get(x, 0))
                if n:
                    taken[x] = n
                    used += n * x
                    need -= n
        k = bisect_right(alive, capacity - used) - 1 if longest else -1
        while k >= 0:
            x = alive[k]
            if left[x] > taken.get(x, 0):
                taken[x] = taken.get(x, 0) + 1
                break
            if not left[x]:
                del alive[k]
            k -= 1
        return sorted(taken.items(), reverse=True)

    alive = sorted(left)
    total = before = slotted = 0
    for counts, times in sorted(found, key=lambda x: -x[1]):
        total += times * share
        whole, before = round(total) - before, round(total)
        while whole > 0 and (config := fill(counts)):
            each = min(whole, *(left[x] // n for x, n in config))
            for x, n in config:
                left[x] -= each * n
                slotted += each * n
            put(capacity - sum(x * n for x, n in config), each, config)
            whole -= each
    for length in sorted(left, reverse=True):
        n = left[length]
        while n:
            k = bisect_left(spaces, length)
            if k == len(spaces):
                each = min(n, capacity // length)
                put(capacity - each * length, n // each, [(length, each)])
                n %= each
                continue
            space = spaces[k]
            times, config = room[space].pop()
            if not room[space]:
                del room[space], spaces[k]
            each = min(n, space // length)
            whole = min(times, n // each)
            put(space - each * length, whole, [*config, (length, each)])
            put(space, times - whole, config)
            n -= whole * each
    return [g for gs in room.values() for g in gs], slotted


@dataclass
class Plan:
    """(number of sequences, configuration) of all groups of equal sequences; the lower bound; how many pieces stand in slots of the program."""

    groups: list[tuple[int, Config]]
    bound: float
    slotted: int

    @property
    def sequences(self) -> int:
        return sum(n for n, _ in self.groups)


def plan(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = 250) -> Plan:
    """The plan for the whole histogram.

    The program is solved once and rounded with several shares of its
    solution; the rounding with the fewest sequences is the plan, the largest share first.
    """
    rest = {length: n for length, n in histogram.items() if n and length < capacity}
    full = histogram.get(capacity, 0)
    groups = [(full, [(capacity, 1)])] if full else []
    if not rest:
        return Plan(groups, full, full)
    rows, found, bound = fractional(rest, capacity, rounds)
    tried = [rounded(rest, rows, found, share, capacity, longest) for share in SHARES for longest in (False, True)]
    packed, slotted = min(tried, key=lambda x: sum(n for n, _ in x[0]))
    volume = sum(length * n for length, n in rest.items()) / capacity
    return Plan(groups + packed, full + max(bound, volume), full + slotted)


def layout(groups: list[tuple[int, Config]]) -> dict[int, np.ndarray]:
    """By length the rows (first rank, each, first sequence, offset), by rank."""
    rows: dict[int, list] = {}
    ranks: dict[int, int] = {}
    first = 0
    for times, config in groups:
        offset = 0
        for length, each in config:
            rank = ranks.get(length, 0)
            rows.setdefault(length, []).append((rank, each, first, offset))
            ranks[length] = rank + times * each
            offset += length * each
        first += times
    return {length: np.array(r, np.int64) for length, r in rows.items()}


def pack(parts: DataFrame, capacity: int = CAPACITY, rounds: int = 250) -> DataFrame:
    """A stored table of pieces with ``sequence_id`` and ``offset`` added."""
    spark = parts.sparkSession
    ship(spark)
    sizes = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    shared = spark.sparkContext.broadcast(layout(plan(sizes, capacity, rounds).groups))
    shards = F.greatest(F.lit(1), F.ceil(F.count("*") / SHARD)).cast("long")
    names = parts.columns
    known = parts.groupBy("length").agg(shards.alias("_shards"))
    dealt = parts.join(F.broadcast(known), "length").withColumn("_shard", F.pmod(F.xxhash64("doc_id", "piece"), F.col("_shards")))
    before = dealt.groupBy("length", "_shard").agg(F.count("*").alias("_n"))
    before = before.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_shard")) - F.col("_n")).drop("_n")
    ranked = dealt.withColumn("_row", F.row_number().over(Window.partitionBy("length", "_shard").orderBy("doc_id", "piece", "ids_crc32")))
    ranked = ranked.join(before, ["length", "_shard"]).withColumn("_rank", F.col("_row") - 1 + F.col("_before"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = shared.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for one in np.unique(length).tolist():
                mine = np.flatnonzero(length == one)
                r = rows[one]
                at = r[np.searchsorted(r[:, 0], rank[mine], side="right") - 1]
                k = rank[mine] - at[:, 0]
                sequence[mine], offset[mine] = at[:, 2] + k // at[:, 1], at[:, 3] + k % at[:, 1] * one
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts.schema.fields)
    return ranked.select(*parts.columns, "_rank").mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def query(spark: SparkSession, documents: DataFrame, words: int = WORDS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(stored(pieces(documents, words=words), spark)).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
