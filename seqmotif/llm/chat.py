"""Chat formatting with a prefix tree.

Conversations that share initial turns share tree nodes: a node is the hash of
all turns up to it, so nodes of all trees come from one aggregation, however
many conversations start alike. Nodes are sorted by their path of hashes, which
is depth-first order, and their tokens are emitted once each, as a stream of
rows. A node has its place in the stream, the position id of its first token
(tokens before it on its path), the stream intervals of its ancestors, which
are what its tokens may attend to besides itself, and the interval under the
loss mask. Places come from sums per partition and one sum over partitions;
intervals of ancestors in an earlier partition come from that partition's last
path. The driver sees one path and one sum per partition.

Template: ``<s>`` opens a conversation; ``[INST] text [/INST]`` is a user turn,
`` text </s>`` an assistant turn, ``<<SYS>>text<</SYS>>`` a system turn and
``<<ROLE>>role<<NAME>>text<</ROLE>>`` any other. Inside texts a backslash is
doubled and a control string gets a backslash behind its first character, so
that none occurs in a formatted text; both are undone when reading.

Null texts and roles are empty. Turns are ordered by turn (nulls first), ties
by role and text; repeated rows are turns each. Rows with a null conv_id are
one conversation. A conversation is streamed, never held, apart from its
current path. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqmotif.llm.packing import tokenizer_path, tokens
from seqmotif.session import ship, stored

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<ROLE>>", "<<NAME>>", "<</ROLE>>")
CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": (" ", " </s>"), "system": ("<<SYS>>", "<</SYS>>")}
KEY = 16


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def format_turn(role: str, text: str, first: bool) -> tuple[str, str, str]:
    """A turn's marks before and after its escaped text, and that text between them."""
    before, after = MARKS.get(role) or (f"<<ROLE>>{escape(role)}<<NAME>>", "<</ROLE>>")
    return "<s>" * first + before, escape(text), after


def parse_turn(formatted: str) -> tuple[str, str]:
    """(role, text) of a formatted turn."""
    body = formatted.removeprefix("<s>")
    for role, (before, after) in MARKS.items():
        if body.startswith(before) and body.endswith(after):
            return role, unescape(body[len(before) : -len(after)])
    role, _, text = body.removeprefix("<<ROLE>>").partition("<<NAME>>")
    return unescape(role), unescape(text.removesuffix("<</ROLE>>"))


def paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, path, role, text): each turn with the path of hashes that leads to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: object = ()
        depth, key, path = 0, b"", b""
        for whole in batches:
            for part in range(0, whole.num_rows, 1000):
                batch = whole.slice(part, 1000)
                out = []
                for conv_id, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                    if conv_id != current:
                        current, depth, key, path = conv_id, 0, b"", b""
                    key = hashlib.blake2b(key + len(role.encode()).to_bytes(8, "big") + role.encode() + text.encode(), digest_size=KEY).digest()
                    path += key
                    out.append((conv_id, depth, path, role, text))
                    depth += 1
                columns = list(zip(*out)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.binary(), pa.string(), pa.string()))], ["conv_id", "depth", "path", "role", "text"])

    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return rows.mapInArrow(run, "conv_id long, depth int, path binary, role string, text string")


def emit(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Tokens and places within the partition of nodes sorted by path.

    ``missing`` is the number of ancestors that lie in earlier partitions,
    ``near`` the places and lengths of the others; ``position`` counts the
    tokens of the near ones.
    """
    coder, part = tokens(path, plainly=True), TaskContext.get().partitionId()
    place = number = 0
    stack: list[tuple[bytes, int, int]] = []
    for whole in batches:
        for first in range(0, whole.num_rows, 500):
            batch = whole.slice(first, 500)
            turns = [format_turn(r, t, len(p) == KEY) for p, r, t in zip(*(batch.column(c).to_pylist() for c in ("path", "role", "text")))]
            coded = coder.encode([x for turn in turns for x in turn])
            out = []
            for k, (node, role, uses) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("path", "role", "uses")))):
                while stack and not (len(stack[-1][0]) < len(node) and node.startswith(stack[-1][0])):
                    stack.pop()
                ids = coded[3 * k : 3 * k + 3]
                n, before = sum(map(len, ids)) // 4, len(ids[0]) // 4
                loss = (before, len(ids[1]) // 4) if role == "assistant" else (before, 0)
                out.append((node, part, number, place, n, len(node) // KEY - 1 - len(stack), [s for _, s, _ in stack], [m for _, _, m in stack], b"".join(ids), *loss, uses))
                stack.append((node, place, n))
                place, number = place + n, number + 1
            columns = list(zip(*out)) or [[]] * 12
            kinds = (pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["path", "part", "number", "place", "n", "missing", "near", "lengths", "ids", "loss_at", "loss_n", "uses"])


EMITTED = "path binary, part int, number long, place long, n long, missing int, near array<long>, lengths array<long>, ids binary, loss_at long, loss_n long, uses long"
STREAM = "path binary, start long, length long, position long, ancestors array<struct<start:long,length:long>>, ids binary, loss_start long, loss_length long, uses long"


def stream(turns: DataFrame, path: str | None = None) -> DataFrame:
    """STREAM: every tree node once, with its tokens (little-endian 32-bit) and where they stand, as a stored table."""
    spark = turns.sparkSession
    ship(spark)
    nodes = turns.groupBy("path").agg(F.first("role").alias("role"), F.first("text").alias("text"), F.count("*").alias("uses"))
    emitted = nodes.repartitionByRange("path").sortWithinPartitions("path").mapInArrow(lambda b: emit(b, path or tokenizer_path()), EMITTED)
    emitted = stored(emitted, spark)
    ends = emitted.groupBy("part").agg(F.max_by(F.struct("place", "n", "missing", "near", "lengths"), "number").alias("last")).orderBy("part").collect()
    bases, before, base, path_now = {}, {}, 0, []
    for r in ends:
        bases[r["part"]], before[r["part"]] = base, path_now
        last = r["last"]
        path_now = path_now[: last["missing"]] + [(base + s, m) for s, m in zip(last["near"], last["lengths"])] + [(base + last["place"], last["n"])]
        base += last["place"] + last["n"]
    shared = spark.sparkContext.broadcast((bases, before))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bases, before = shared.value
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
        for batch in batches:
            starts, positions, ancestors, losses = [], [], [], []
            for part, at, missing, near, lengths, loss in zip(*(batch.column(c).to_pylist() for c in ("part", "place", "missing", "near", "lengths", "loss_at"))):
                above = before[part][:missing] + [(bases[part] + s, m) for s, m in zip(near, lengths)]
                starts.append(bases[part] + at)
                positions.append(sum(m for _, m in above))
                ancestors.append([{"start": s, "length": m} for s, m in above])
                losses.append(bases[part] + at + loss)
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(starts, pa.int64()), batch.column("n"), pa.array(positions, pa.int64()), pa.array(ancestors, kind), batch.column("ids"), pa.array(losses, pa.int64()), batch.column("loss_n"), batch.column("uses")], ["path", "start", "length", "position", "ancestors", "ids", "loss_start", "loss_length", "uses"])

    return stored(emitted.mapInArrow(place, STREAM), spark)


def read_back(turns: DataFrame, nodes: DataFrame, path: str | None = None) -> DataFrame:
    """Per conversation what its path through the stream says: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    spark = turns.sparkSession
    ship(spark)
    kinds = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = tokens(path or tokenizer_path(), plainly=True).tokenizer
        names = [f.split()[0] for f in kinds.split(", ")]
        types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())

        def done() -> tuple:
            return current[0], n, said.hexdigest(), loss_chars, loss.hexdigest(), chars

        current: tuple = ()
        n = chars = loss_chars = place = 0
        said, loss = hashlib.sha256(), hashlib.sha256()
        for whole in batches:
            for first in range(0, whole.num_rows, 500):
                batch = whole.slice(first, 500)
                rows, out = batch.to_pylist(), []
                ids = [np.frombuffer(r["ids"], "<u4").tolist() for r in rows]
                formatted = decoder.decode_batch(ids, skip_special_tokens=False)
                masked = decoder.decode_batch([i[r["loss_start"] - r["start"] :][: r["loss_length"]] for i, r in zip(ids, rows)], skip_special_tokens=False)
                for r, text, under in zip(rows, formatted, masked):
                    if (r["conv_id"],) != current:
                        if current:
                            out.append(done())
                        current, n, chars, loss_chars, place, said, loss = (r["conv_id"],), 0, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                    if r["position"] != place:
                        raise ValueError(f"positions of conversation {r['conv_id']} have a gap")
                    role, content = parse_turn(text)
                    said.update(f"{role}\n{content}\n".encode())
                    learned = unescape(under)
                    loss.update(learned.encode())
                    n, chars, loss_chars, place = n + 1, chars + len(text), loss_chars + len(learned), place + r["length"]
                columns = list(zip(*out)) or [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)
        if current:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(done(), types)], names)

    rows = turns.select("conv_id", "depth", "path").join(nodes.drop("ancestors", "uses"), "path").select("conv_id", "depth", "start", "length", "position", "ids", "loss_start", "loss_length")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "depth").mapInArrow(run, kinds)


def query(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """All conversations and the one numbered -1 that speaks in control strings."""
    ship(spark)
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(extra)
    turns = stored(paths(rows), spark)
    return read_back(turns, stream(turns.select("path", "role", "text")))


ORACLE = r"""
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(regexp_replace(replace(t, '\', '\\'), '<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|<<ROLE>>|<<NAME>>|<</ROLE>>', '\0\\', 'g'))
  + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 6 WHEN 'system' THEN 15 END AS k FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(t)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(k) + 3 AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
