"""Scanning sequences for patterns."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqmotif.functions import revcomp
from seqmotif.operators.chain import chain
from seqmotif.operators.kernel import Matcher
from seqmotif.operators.order import ranked
from seqmotif.pattern.parser import Pattern, lengths, parse
from seqmotif.plans import vector
from seqmotif.plans.regex import NotRegular, hits, to_regex
from seqmotif.session import ship

#: A hit: 1-based closed place on the forward strand, its order within (record, pattern, strand), and the pieces of its units.
UNITS = "array<struct<unit:int,line:int,start:long,end:long,text:string>>"
HITS = f"seq_ord long, seq_id string, seq_len long, pat_ord int, strand string, hit_ord long, start long, end long, units {UNITS}"
_STRUCT = pa.struct([("unit", pa.int32()), ("line", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string())])


class MissLimit(RuntimeError):
    """More records without a hit than allowed."""


def as_patterns(patterns: str | Pattern | Sequence[str | Pattern], alphabet: str) -> list[Pattern]:
    some = [patterns] if isinstance(patterns, (str, Pattern)) else list(patterns)
    return [p if isinstance(p, Pattern) else parse(p, alphabet) for p in some]


def splittable(pattern: Pattern) -> bool:
    """May a record be cut by start positions? Not with anchors, empty hits, or a first unit that is an alternative."""
    return pattern.units[0].slides and lengths(pattern.units)[0] > 0 and not any(u.kind in ("start", "end") for u in pattern.flat)


def strategy(pattern: Pattern, plain: bool = False, strict_n: bool = False, align: bool = False, overlaps: bool = False) -> str:
    """How a pattern is run: vector (arrays, all records of a batch at once), regex (in the JVM) or kernel (start by start).

    Measured on records of some hundred letters, arrays take about half the time of an
    expression for words and gaps, and less for repeats.
    """
    if overlaps:
        return "vector" if vector.supported(pattern, align) and not any(map(vector.wide, pattern.flat)) else "kernel"
    if vector.supported(pattern, align):
        return "vector"
    if align and any(u.kind == "complement" for u in pattern.flat):
        return "kernel"
    try:
        to_regex(pattern, plain, strict_n)
        return "kernel" if pattern.units[0].kind == "either" else "regex"
    except NotRegular:
        return "kernel"


def stranded(seqs: DataFrame, both: bool) -> DataFrame:
    """One row per record and strand; ``strand_ord`` 0 is forward."""
    rows = seqs.withColumn("seq", F.substring_index("seq", "\0", 1))
    forward = rows.select("seq_ord", "seq_id", F.length("seq").cast("long").alias("seq_len"), F.lit("+").alias("strand"), "seq")
    if not both:
        return forward
    strands = F.array(F.struct(F.lit("+").alias("strand"), F.col("seq")), F.struct(F.lit("-").alias("strand"), revcomp("seq").alias("seq")))
    return rows.select("seq_ord", "seq_id", F.length("seq").cast("long").alias("seq_len"), F.explode(strands).alias("_x")).select("seq_ord", "seq_id", "seq_len", "_x.strand", "_x.seq")


def _native(rows: DataFrame, pattern: Pattern, order: int, found: F.Column, units: bool) -> DataFrame:
    """HITS rows from an array of structs (start, end, sizes of the units' pieces)."""
    out = rows.select("*", F.posexplode(found).alias("hit_ord", "_h"))
    sizes = F.col("_h.sizes")
    plus = F.col("strand") == "+"
    first, last = F.col("_h.start").cast("long"), F.col("_h.end").cast("long")
    index = F.array(*[F.struct(F.lit(u.index).alias("unit"), F.lit(u.line).alias("line")) for u in pattern.flat])

    def piece(x: F.Column, i: F.Column) -> F.Column:
        at = F.col("_h.start") + F.aggregate(F.slice(sizes, F.lit(1), i), F.lit(0), lambda a, b: a + b)
        size = sizes[i]
        a, b = at.cast("long"), (at + size - 1).cast("long")
        return F.struct(x["unit"].alias("unit"), x["line"].alias("line"), F.when(plus, a).otherwise(F.col("seq_len") - b + 1).alias("start"), F.when(plus, b).otherwise(F.col("seq_len") - a + 1).alias("end"), F.substr("seq", at.cast("int"), size).alias("text"))

    pieces = F.transform(index, piece) if units else F.lit(None)
    start, end = F.when(plus, first).otherwise(F.col("seq_len") - last + 1), F.when(plus, last).otherwise(F.col("seq_len") - first + 1)
    return out.select("seq_ord", "seq_id", "seq_len", F.lit(order).alias("pat_ord"), "strand", F.col("hit_ord").cast("long").alias("hit_ord"), start.alias("start"), end.alias("end"), pieces.cast(UNITS).alias("units"))


#: Letters that are searched in one go.
PORTION = 100_000
NAMES = [f.split()[0] for f in HITS.replace(UNITS, "units").split(", ")]
KINDS = (pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(_STRUCT))
#: What the matchers read: whole records, or pieces of long ones. ``first`` letters of the strand stand before a piece and its hits begin within ``limit`` letters.
ROWS = ("seq_ord", "seq_id", "seq_len", "strand", "first", "limit", "seq")


def _letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The letters of strings in a row, one byte each (other letters than ASCII are unknown ones), and the bounds between strings."""
    column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset)
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    if len(raw) and raw.max() > 127:
        texts = [t.encode("latin-1", "replace") for t in column.to_pylist()]
        return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    return raw, (offsets - offsets[0]).astype(np.int64)


def _portions(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows of some PORTION letters each."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("seq")), 0).to_numpy(zero_copy_only=False))
    first = 0
    while first < batch.num_rows:
        past = sizes[first - 1] if first else 0
        end = max(first + 1, int(np.searchsorted(sizes, past + PORTION, side="right")))
        yield batch.slice(first, end - first)
        first = end


class _Writer:
    """Hits of one pattern as record batches of HITS."""

    def __init__(self, pattern: Pattern, order: int, units: bool):
        self.pattern, self.order, self.units = pattern, order, units
        self.lines = np.array([u.line for u in pattern.flat], np.int32)

    def batches(self, batch: pa.RecordBatch, data: vector.Letters, hits: vector.Hits, number: np.ndarray, strand: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
        """``batch`` holds the records of ``data`` in its order; ``number`` is each hit's place within its record."""
        weight = np.cumsum((hits.end - hits.start) * self.units + 8)
        first = 0
        while first < len(weight):
            past = weight[first - 1] if first else 0
            end = max(first + 1, int(np.searchsorted(weight, past + most, side="right")))
            rows = np.arange(first, end)
            yield self.batch(batch, data, hits.take(rows), number[rows], strand)
            first = end

    def batch(self, batch: pa.RecordBatch, data: vector.Letters, hits: vector.Hits, number: np.ndarray, strand: str) -> pa.RecordBatch:
        record = np.searchsorted(data.bounds, hits.start, side="right") - 1
        ids, size = (batch.column(c).take(pa.array(record)) for c in ("seq_id", "seq_len"))
        sizes = size.to_numpy()
        shift = batch.column("first").to_numpy()[record] - data.bounds[:-1][record]

        def forward(a: np.ndarray, b: np.ndarray, shift: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Closed places on the forward strand of half-open ones in the row of records."""
            return (a + shift + 1, b + shift) if strand == "+" else (sizes - b - shift + 1, sizes - a - shift)

        start, end = forward(hits.start, hits.end, shift, sizes)
        units = pa.nulls(len(record), KINDS[-1])
        if self.units:
            count = np.array([len(r) for r in hits.routes], np.int64)[hits.route]
            bounds = np.concatenate([[0], np.cumsum(count)])
            unit, at, n = (np.zeros(int(bounds[-1]), np.int64) for _ in range(3))
            for k in np.unique(hits.route).tolist():
                mine = np.flatnonzero(hits.route == k)
                route = hits.routes[k]
                lengths_ = np.array([m or 0 for _, m in route], np.int64) + np.outer(hits.gap[mine], [m is None for _, m in route])
                cells = bounds[mine][:, None] + np.arange(len(route))
                unit[cells] = [u for u, _ in route]
                n[cells] = lengths_
                at[cells] = hits.start[mine][:, None] + np.cumsum(lengths_, 1) - lengths_
            owner = np.repeat(np.arange(len(record)), count)
            a, b = forward(at, at + n, shift[owner], sizes[owner])
            ends = np.concatenate([[0], np.cumsum(n)])
            text = data.raw[np.arange(int(ends[-1])) + np.repeat(at - ends[:-1], n)]
            texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(text)])
            texts = texts.cast(pa.binary()).cast(pa.string()) if not len(text) or text.max() < 128 else pa.array([t.decode("latin-1") for t in texts.to_pylist()])
            cells = pa.StructArray.from_arrays([pa.array(unit, pa.int32()), pa.array(self.lines[unit]), pa.array(a), pa.array(b), texts], fields=list(_STRUCT))
            units = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), cells)
        columns = [batch.column("seq_ord").take(pa.array(record)), ids, size, pa.array(np.full(len(record), self.order, np.int32)), pa.array([strand] * len(record), pa.string()), pa.array(number, pa.int64()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), units]
        return pa.RecordBatch.from_arrays(columns, NAMES)


def _by_matcher(matcher: Matcher, pattern: Pattern, data: vector.Letters, overlaps: bool, cut: bool, limits: np.ndarray) -> tuple[vector.Hits, np.ndarray]:
    """Hits of each record by the general matcher, and their places in their records; of a piece (``cut``) the first hit of each start."""
    known: dict[tuple, int] = {}
    rows, numbers = [], []
    for k, (a, b) in enumerate(zip(data.bounds[:-1].tolist(), data.bounds[1:].tolist())):
        seen = -1
        for number, (start, end, entries) in enumerate(matcher.hits(data.raw[a:b].tobytes().decode("latin-1"), overlaps or cut, last=int(limits[k]) - 1 if cut else None)):
            if cut and start == seen:
                continue
            seen = start
            rows.append((a + start, a + end, known.setdefault(tuple((u, y - x) for u, x, y in entries), len(known)), 0))
            numbers.append(number)
    columns = [np.array(c, np.int64) for c in zip(*rows)] or [np.zeros(0, np.int64)] * 4
    return vector.Hits(*columns, [list(r) for r in known]), np.array(numbers, np.int64)


def _matched(rows: DataFrame, patterns: list[tuple[int, Pattern, str]], strict_n: bool, align: bool, overlaps: bool, units: bool, cut: bool) -> DataFrame:
    """HITS of rows of ROWS, strand ``*`` for both, by arrays or by the general matcher; of pieces (``cut``) all hits that a chain over the record can hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = [(p, way, Matcher(p, strict_n, align), _Writer(p, k, units)) for k, p, way in patterns]
        pad = max(lengths(p.units)[1] + sum(sum(u.err) + len(u.letters) for u in p.flat) for p, *_ in made) + 1
        for whole in batches:
            for batch in _portions(whole):
                for strand in "+-":
                    side = batch.filter(pc.is_in(batch.column("strand"), pa.array([strand, "*"])))
                    if not side.num_rows:
                        continue
                    data = vector.Letters(*_letters(side.column("seq")), made[0][0].dna, pad)
                    if strand == "-":
                        data, side = data.reversed(pad), side.take(pa.array(np.arange(side.num_rows)[::-1]))
                    limits = side.column("limit").to_numpy()
                    for pattern, way, matcher, writer in made:
                        every = overlaps and strand == "+"
                        if way == "kernel":
                            hits, number = _by_matcher(matcher, pattern, data, every, cut, limits)
                        else:
                            hits = vector.Search(pattern, data, strict_n, every, align).hits()
                            number = np.zeros(len(hits.start), np.int64)
                        record = np.searchsorted(data.bounds, hits.start, side="right") - 1
                        if cut:
                            inside = np.flatnonzero(hits.start - data.bounds[record] < limits[record])
                            hits = hits.take(inside)
                            kept = _reachable(hits, data, record[inside], side, lengths(pattern.units)[1])
                            hits, number = hits.take(kept), np.zeros(len(kept), np.int64)
                        elif way != "kernel":
                            if not every:
                                hits = hits.take(vector.chain(hits))
                                record = np.searchsorted(data.bounds, hits.start, side="right") - 1
                            heads = np.searchsorted(record, record)
                            number = np.arange(len(record)) - heads
                        yield from writer.batches(side, data, hits, number, strand)

    return rows.select(*ROWS).mapInArrow(run, HITS)


def _reachable(hits: vector.Hits, data: vector.Letters, record: np.ndarray, side: pa.RecordBatch, longest: int) -> np.ndarray:
    """Rows of the hits that a chain over the records which the pieces were cut from can hold."""
    firsts, out = side.column("first").to_numpy(), [np.zeros(0, np.int64)]
    for k in np.unique(record).tolist():
        mine = np.flatnonzero(record == k)
        some = hits.take(mine)
        out.append(mine[vector.chain(some) if firsts[k] == 0 else vector.possible(some, data.bounds[k] + longest)])
    return np.concatenate(out)


def _pieces(rows: DataFrame, patterns: list[Pattern], both: bool, piece: int) -> DataFrame:
    """ROWS of long records: both strands cut by start position, each piece with as many letters behind it as a hit may need."""
    halo = max(lengths(p.units)[1] for p in patterns)
    size = F.length("seq").cast("long")
    cuts = F.sequence(F.lit(0).cast("long"), F.floor((size - 1) / piece).cast("long"))
    out = rows.select("seq_ord", "seq_id", size.alias("seq_len"), "seq", F.explode(F.array(*map(F.lit, "+-" if both else "+"))).alias("strand"), cuts.alias("_cuts"))
    out = out.select("seq_ord", "seq_id", "seq_len", "strand", "seq", F.explode(F.transform("_cuts", lambda k: k * piece)).alias("first"))
    n = F.least(F.lit(piece + halo).cast("long"), F.col("seq_len") - F.col("first"))
    at = F.when(F.col("strand") == "+", F.col("first")).otherwise(F.col("seq_len") - F.col("first") - n)
    out = out.select("seq_ord", "seq_id", "seq_len", "strand", "first", F.lit(piece).cast("long").alias("limit"), F.substr("seq", (at + 1).cast("int"), n.cast("int")).alias("seq"))
    return out.repartition("seq_ord", "strand", "first")


def scan(
    seqs: DataFrame,
    patterns: str | Pattern | Sequence[str | Pattern],
    alphabet: str = "dna",
    both_strands: bool = False,
    overlaps: bool = False,
    strict_n: bool = False,
    align: bool = False,
    ignore_ids: DataFrame | Sequence[str] | None = None,
    max_hits: int | None = None,
    max_misses: int | None = None,
    plain: bool = False,
    engine: str = "auto",
    units: bool = True,
    piece: int | None = None,
) -> DataFrame:
    """Hits of one or several patterns in ``seqs`` (seq_ord long, seq_id string, seq string).

    Without ``overlaps`` a strand's hits are a left-to-right chain, each behind
    the end of the last; with it all hits of the forward strand in order of
    choice. ``plain`` promises that sequences hold plain bases only. ``engine``
    is auto, regex, vector or kernel. Without ``units`` that column is null, which
    spares the texts. With ``piece``, records of more letters are searched in pieces
    of so many, dealt to all tasks; the hits are the same whatever its size.
    Null sequences are empty. The result has the columns of HITS.
    """
    ship(seqs.sparkSession)
    if alphabet == "protein" and both_strands:
        raise ValueError("proteins have one strand")
    parsed = as_patterns(patterns, alphabet)
    if not parsed:
        raise ValueError("no pattern")
    rows = seqs.select("seq_ord", "seq_id", F.coalesce("seq", F.lit("")).alias("seq"))
    if ignore_ids is not None:
        ids = ignore_ids if isinstance(ignore_ids, DataFrame) else seqs.sparkSession.createDataFrame([(i,) for i in ignore_ids], "seq_id string")
        rows = rows.join(ids.select("seq_id"), "seq_id", "left_anti").select("seq_ord", "seq_id", "seq")
    ways = [strategy(p, plain, strict_n, align, overlaps) if engine == "auto" else engine for p in parsed]
    parts = []
    cut = rows.withColumn("seq", F.substring_index("seq", "\0", 1))
    short, some = cut, [splittable(p) and piece is not None and not overlaps for p in parsed]
    if any(some):
        # A pattern that has no regular form for pieces gets the first hit of each start by arrays.
        pieced = [(k, p, "vector" if way == "regex" and vector.supported(p, align) else "kernel" if way == "regex" else way) for k, (p, way) in enumerate(zip(parsed, ways)) if some[k]]
        long = _pieces(cut.where(F.length("seq") > piece), [p for _, p, _ in pieced], both_strands, piece)
        parts.append(chain(_matched(long, pieced, strict_n, align, False, units, True)))
        short = cut.where(F.length("seq") <= piece)
    for these, wanted in ((short, True), (cut, False)):
        chosen = [(k, p, way) for k, (p, way) in enumerate(zip(parsed, ways)) if some[k] == wanted]
        for k, p, way in chosen:
            if way == "regex":
                parts.append(_native(stranded(these, both_strands), p, k, hits(p, F.col("seq"), plain, strict_n), units))
        slow = [x for x in chosen if x[2] != "regex"]
        if slow:
            whole = these.select("seq_ord", "seq_id", F.length("seq").cast("long").alias("seq_len"), F.lit("*" if both_strands else "+").alias("strand"), F.lit(0).cast("long").alias("first"), F.length("seq").cast("long").alias("limit"), "seq")
            parts.append(_matched(whole, slow, strict_n, align, overlaps, units, False))
    found = reduce(DataFrame.unionByName, parts)
    if max_misses is not None:
        found = limit_misses(rows, found, max_misses)
    if max_hits is not None:
        found = limit_hits(found, max_hits)
    return found


def hit_order() -> list:
    """The order of all hits of a run: record, pattern, strand, order of choice."""
    return ["seq_ord", "pat_ord", F.when(F.col("strand") == "-", 1).otherwise(0), "hit_ord"]


def limit_hits(found: DataFrame, n: int) -> DataFrame:
    """The first n hits of the run."""
    return found.orderBy(*hit_order()).limit(n)


def missed(seqs: DataFrame, found: DataFrame) -> DataFrame:
    """seq_ord of the records without any hit."""
    return seqs.select("seq_ord").join(found.select("seq_ord").distinct(), "seq_ord", "left_anti")


def limit_misses(seqs: DataFrame, found: DataFrame, n: int) -> DataFrame:
    """Hits before the n-th record without a hit, where the run would stop."""
    last = missed(seqs, found).orderBy("seq_ord").limit(n).agg(F.max("seq_ord").alias("_last"), F.count("*").alias("_n"))
    stop = last.select(F.when(F.col("_n") >= n, F.col("_last")).alias("_stop"))
    return found.join(F.broadcast(stop), F.col("_stop").isNull() | (F.col("seq_ord") < F.col("_stop"))).drop("_stop")


def check_misses(seqs: DataFrame, found: DataFrame, n: int) -> None:
    """Raise MissLimit if n records or more have no hit."""
    if missed(seqs, found).limit(n).count() >= n:
        raise MissLimit("exceeded limit of lines failing to match")


def running_hits(found: DataFrame) -> DataFrame:
    """Hits with ``nth``, the number of hits up to each in the order of the run."""
    return ranked(found, hit_order(), {"nth": []})
