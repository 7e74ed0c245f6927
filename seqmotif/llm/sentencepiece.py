"""SentencePiece encoding and decoding by suffix-array matching.

Texts are cut into units (a run of spaces and what follows it): no piece has a
space behind another character, so units are encoded independently, and each
worker remembers the ids of units it has met. New units of a batch are
concatenated and indexed by a suffix array (prefix doubling up to the longest
piece); every piece of the vocabulary is found by two binary searches, which
give the range of its occurrences; each occurrence is an edge (position,
length, piece). The edges, in a table by position and length, are relaxed: starting from
single characters, the best-scored edge that joins two neighbouring symbols is
applied in every unit at once, the leftmost of equals, until none is left.
That order of relaxation is what the vocabulary's merge scores mean; a
shortest-path relaxation would give other ids than the library does. Units of
more than ``LONG`` characters keep their candidate edges in a heap instead.

Characters without a piece become byte pieces. Decoding joins the pieces' bytes
and drops the space that encoding puts in front. Nulls and empty texts have no
ids and decode to the empty text. The space symbol itself, when it occurs in a
text, is an ordinary character that encodes as a space: it decodes to a space.
Repeated rows, extra columns and empty tables need no special care.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqmotif.llm.common import CACHE_WORDS, texts
from seqmotif.session import ship

SPACE = "▁"
UNIT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: A unit of more characters is merged with a heap; new units are indexed in runs of so many characters.
LONG, RUN = 48, 400_000


def model_path() -> str:
    """Where the public model of this operator lies on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """Pieces, their ids and merge order, as read from a model file by the library."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
        ids = [i for i in range(model.get_piece_size()) if not special(i)]
        self.texts = {i: model.id_to_piece(i) for i in ids}
        self.bytes = {int(model.id_to_piece(i)[3:5], 16): i for i in range(model.get_piece_size()) if model.is_byte(i)}
        order = sorted(ids, key=lambda i: (-model.get_score(i), i))
        self.order = np.zeros(model.get_piece_size(), np.int64)
        self.order[order] = np.arange(len(order))
        self.longest = max(map(len, self.texts.values()))
        self.ids = np.array(ids)
        self.lengths = np.array([len(self.texts[i]) for i in ids])
        self.points = np.zeros((len(ids), self.longest), np.int64)
        for k, i in enumerate(ids):
            self.points[k, : self.lengths[k]] = [ord(c) for c in self.texts[i]]
        self.singles = {t: i for i, t in self.texts.items() if len(t) == 1}
        self.spelled: list[bytes] = [b""] * model.get_piece_size()
        for i, t in self.texts.items():
            self.spelled[i] = t.replace(SPACE, " ").encode()
        for byte, i in self.bytes.items():
            self.spelled[i] = bytes([byte])


def suffix_array(points: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by the next ``depth`` code points or more, by prefix doubling from as many as fit into one number."""
    letters, rank = np.unique(points, return_inverse=True)
    rank, base, done = rank.astype(np.int64) + 1, len(letters) + 1, 1

    def doubled(base: int) -> np.ndarray:
        key = rank * base
        key[:-done] += rank[done:]
        return key

    while done < depth and base * base < 1 << 62:
        rank, base, done = doubled(base), base * base, done * 2
    while True:
        order = np.argsort(rank)
        if done >= depth:
            return order
        ordered = rank[order]
        fresh = np.ones(len(rank), np.int64)
        fresh[1:] += np.cumsum(ordered[1:] != ordered[:-1])
        rank[order] = fresh
        rank, done = doubled(len(points) + 2), done * 2


def edges(text: str, words: Vocabulary) -> np.ndarray:
    """For each position and length (0 to the longest) the id of the piece that occurs there, or -1."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    n, depth = len(points), words.longest
    padded = np.concatenate([points, np.full(depth, -1)])
    order = suffix_array(points, depth) if n > 1 else np.zeros(n, np.int64)

    def side(pieces: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Does what stands at each place come before its piece (below 0), begin with it (0) or come after it?"""
        sign, rows = np.zeros(len(pieces), np.int64), np.arange(len(pieces))
        for k in range(depth):
            rows = rows[(sign[rows] == 0) & (k < words.lengths[pieces[rows]])]
            if not len(rows):
                break
            sign[rows] = np.sign(padded[at[rows] + k] - words.points[pieces[rows], k])
        return sign

    def bound(low: np.ndarray, high: np.ndarray, after: bool) -> np.ndarray:
        while (open_ := np.flatnonzero(low < high)).size:
            middle = (low[open_] + high[open_]) // 2
            up = side(open_, order[middle]) < after
            low[open_[up]] = middle[up] + 1
            high[open_[~up]] = middle[~up]
        return low

    first = bound(np.zeros(len(words.ids), np.int64), np.full(len(words.ids), n, np.int64), False)
    there = np.flatnonzero(first < n)
    there = there[side(there, order[first[there]]) == 0]
    last = first.copy()
    last[there] = n  # only pieces that occur have an end to look for
    last = bound(first.copy(), last, True)
    found = last - first
    piece = np.repeat(np.arange(len(found)), found)
    at = order[np.repeat(first, found) + np.arange(found.sum()) - np.repeat(np.cumsum(found) - found, found)]
    out = np.full((n, depth + 1), -1, np.int32)
    out[at, words.lengths[piece]] = words.ids[piece]
    return out


def relax(found: np.ndarray, starts: np.ndarray, sizes: np.ndarray, words: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit, start, length) of the symbols left after all merges; units are given by start and size."""
    depth = words.longest
    unit = np.repeat(np.arange(len(starts)), sizes)
    start = np.repeat(starts, sizes) + np.arange(len(unit)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    length = np.ones(len(start), np.int64)
    settled: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    none = np.int64(1) << 60
    while len(unit):
        joined = length[:-1] + length[1:]
        ids = np.where((unit[:-1] == unit[1:]) & (joined <= depth), found[start[:-1], np.minimum(joined, depth)], -1)
        key = np.append(np.where(ids >= 0, words.order[np.maximum(ids, 0)] * len(found) + start[:-1], none), none)
        heads = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
        best = np.minimum.reduceat(key, heads)
        group = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(unit))))
        live = best[group] < none
        settled.append((unit[~live], start[~live], length[~live]))
        merge = live & (key == best[group])
        length = length + np.where(merge, np.append(length[1:], 0), 0)
        keep = live & ~np.append(False, merge[:-1])
        unit, start, length = unit[keep], start[keep], length[keep]
    out = [np.concatenate(x) for x in zip(*settled)] if settled else [unit, start, length]
    by = np.lexsort((out[1], out[0]))
    return out[0][by], out[1][by], out[2][by]


def relax_long(found: np.ndarray, start: int, size: int, words: Vocabulary) -> list[tuple[int, int]]:
    """(start, length) of one long unit's symbols after all merges, with a heap of candidate edges."""
    length = dict.fromkeys(range(start, start + size), 1)
    before = {k: k - 1 for k in length}
    heap: list[tuple[int, int, int]] = []

    def offer(a: int) -> None:
        b = a + length[a]
        if b in length and (total := length[a] + length[b]) <= words.longest and (i := found[a, total]) >= 0:
            heapq.heappush(heap, (int(words.order[i]), a, total))

    for k in range(start, start + size - 1):
        offer(k)
    while heap:
        _, a, total = heapq.heappop(heap)
        b = a + length.get(a, 0)
        if a not in length or b not in length or length[a] + length[b] != total:
            continue
        length[a] = total
        del length[b]
        if a + total in length:
            before[a + total] = a
        offer(a)
        if a > start:
            offer(before[a])
    return sorted(length.items())


class Encoder:
    """Encodes texts, remembering the ids of units as little-endian 32-bit bytes."""

    def __init__(self, path: str):
        self.words = Vocabulary(path)
        self.known: dict[str, bytes] = {}

    def learn(self, new: list[str]) -> None:
        run: list[str] = []
        size = 0
        for u in new:
            run.append(u)
            size += len(u) + 1
            if size >= RUN:
                self.index(run)
                run, size = [], 0
        if run:
            self.index(run)

    def index(self, new: list[str]) -> None:
        """Match all pieces in the concatenated units and relax the edges."""
        words, text = self.words, "\x00".join(new)
        found = edges(text, words)
        sizes = np.fromiter(map(len, new), np.int64, len(new))
        starts = np.cumsum(sizes + 1) - sizes - 1
        short = np.flatnonzero(sizes <= LONG)
        _, start, length = relax(found, starts[short], sizes[short], words)
        long = [(s, n) for u in np.flatnonzero(sizes > LONG).tolist() for s, n in relax_long(found, int(starts[u]), int(sizes[u]), words)]
        if long:
            start, length = (np.concatenate([x, y]) for x, y in zip((start, length), np.array(long, np.int64).T))
            by = np.argsort(start)
            start, length = start[by], length[by]
        ids = found[start, length]
        of = np.searchsorted(starts, start, side="right") - 1
        if len(bare := np.flatnonzero(ids < 0)):  # characters without a piece, by their bytes
            spelled = [[words.bytes[b] for b in text[s].encode("utf-8", "surrogatepass")] for s in start[bare].tolist()]
            times = np.ones(len(ids), np.int64)
            times[bare] = list(map(len, spelled))
            rows = np.repeat(np.arange(len(ids)), times)
            out = ids[rows]
            out[ids[rows] < 0] = np.concatenate(spelled)
            ids, of = out, of[rows]
        flat = ids.astype("<u4").tobytes()
        stops = (4 * np.cumsum(np.bincount(of, minlength=len(new)))).tolist()
        self.known.update(zip(new, map(flat.__getitem__, map(slice, [0, *stops], stops))))

    def encode(self, some: list[str]) -> list[bytes]:
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        cut = []
        for t in some:
            if not t:
                cut.append([])
            elif "  " in t or t[0] == " " or t[-1] == " " or SPACE in t:
                cut.append(UNIT.findall(SPACE + t.replace(" ", SPACE)))
            else:
                cut.append((SPACE + t.replace(" ", f"\x00{SPACE}")).split("\x00") if "\x00" not in t else UNIT.findall(SPACE + t.replace(" ", SPACE)))
        self.learn([*set().union(*cut).difference(self.known)])
        get = self.known.__getitem__
        return [b"".join(map(get, units)) for units in cut]

    def decode(self, ids: bytes) -> str:
        """The text of little-endian 32-bit ids."""
        spelled = b"".join(map(self.words.spelled.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return spelled[1 if spelled[:1] == b" " else 0 :].decode("utf-8", "replace")


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    """This worker's encoder."""
    path = path or model_path()
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode(documents: DataFrame, path: str | None = None, with_ids: bool = True) -> DataFrame:
    """(doc_id, ids, n_ids, ids_crc32, decoded_crc32, round_trip) per row.

    ``ids`` is left out on request; ``decoded_crc32`` is the checksum of the
    decoded text's UTF-8 bytes, and ``round_trip`` tells whether it is the
    text that was encoded.
    """
    ship(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            doc_ids, all_texts, k = batch.column("doc_id").to_pylist(), texts(batch), 0
            while k < len(all_texts):
                size, end = 0, k
                while end < len(all_texts) and (size < 4_000_000 or end == k):
                    size, end = size + len(all_texts[end]), end + 1
                coded = coder.encode(all_texts[k:end])
                decoded = [coder.decode(c) for c in coded]
                columns = {
                    "doc_id": pa.array(doc_ids[k:end], pa.int64()),
                    **({"ids": pa.array([np.frombuffer(c, "<i4") for c in coded], pa.list_(pa.int32()))} if with_ids else {}),
                    "n_ids": pa.array([len(c) // 4 for c in coded], pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(c) for c in coded], pa.int64()),
                    "decoded_crc32": pa.array([zlib.crc32(d.encode()) for d in decoded], pa.int64()),
                    "round_trip": pa.array([a == b for a, b in zip(decoded, all_texts[k:end])], pa.bool_()),
                }
                yield pa.RecordBatch.from_pydict(columns)
                k = end

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, f"doc_id long, {'ids array<int>, ' * with_ids}n_ids long, ids_crc32 long, decoded_crc32 long, round_trip boolean")


def query(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_ids, ids_crc32, decoded_crc32, round_trip."""
    return encode(documents, with_ids=False)
