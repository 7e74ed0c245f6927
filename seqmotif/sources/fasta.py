"""FASTA and GFF3 files, pattern files and ordered text output."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqmotif.pattern.parser import Pattern, parse
from seqmotif.session import ship


def parse_fasta(data: bytes) -> Iterator[tuple[str, str]]:
    """(id, sequence) of each record.

    Text before the first line that starts with ``>`` is skipped; the id is the
    first word behind the sign, the rest of that line is dropped; a ``>``
    anywhere in a body ends it; blanks and line ends are removed.
    """
    at = 0 if data.startswith(b">") else data.find(b"\n>") + 1
    if not data.startswith(b">") and at == 0:
        return
    while at < len(data):
        first = at + 1
        while first < len(data) and data[first : first + 1].isspace():
            first += 1
        stop = first
        while stop < len(data) and not data[stop : stop + 1].isspace():
            stop += 1
        line = data.find(b"\n", stop)
        body = len(data) if line < 0 else line + 1
        end = data.find(b">", body)
        end = len(data) if end < 0 else end
        seq = data[body:end].translate(None, b" \r\n")
        if stop > first:
            yield data[first:stop].decode("latin-1"), seq.decode("latin-1")
        at = end


def inflate(data: bytes) -> bytes:
    """Decompress data that begins like gzip, any number of members; other data as it is."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        try:
            out.append(member.decompress(data))
        except zlib.error as e:
            raise ValueError(f"gzip input: {e}") from e
        if not member.eof:
            raise ValueError("gzip input: unexpected end of file")
        data = member.unused_data
    return b"".join(out)


def bgzf_blocks(data: bytes) -> list[tuple[int, int]]:
    """(offset, size) of the blocks of a blocked gzip file, from their size fields; empty if it isn't one."""
    at, out = 0, []
    while at + 18 <= len(data):
        if data[at : at + 4] != b"\x1f\x8b\x08\x04":
            return []
        extra, size, k = int.from_bytes(data[at + 10 : at + 12], "little"), 0, at + 12
        while k < at + 12 + extra:
            n = int.from_bytes(data[k + 2 : k + 4], "little")
            if data[k : k + 2] == b"BC" and n == 2:
                size = int.from_bytes(data[k + 4 : k + 6], "little") + 1
            k += 4 + n
        if not size:
            return []
        out.append((at, size))
        at += size
    return out if at == len(data) else []


def ordered(rows: DataFrame) -> DataFrame:
    """Records numbered in the order of files and of places in them; only ids and places are sorted."""
    rows = rows.withColumn("_uid", F.xxhash64("_file", "_place"))
    number = F.row_number().over(Window.orderBy("_file", "_place")) - 1
    order = rows.select("_file", "_place", number.cast("long").alias("seq_ord"))
    return rows.join(order, ["_file", "_place"]).select("seq_ord", "seq_id", "seq")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(seq_ord, seq_id, seq) of FASTA files below ``path``, plain, gzip or blocked gzip (told by content, not by name).

    A file is read whole by one task; use ``read_fasta_split`` for large plain files.
    """
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                rows, size = [], 0
                for place, (seq_id, seq) in enumerate(parse_fasta(inflate(content))):
                    rows.append((name, place, seq_id, seq))
                    size += len(seq)
                    if size > 8_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["_file", "_place", "seq_id", "seq"])
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["_file", "_place", "seq_id", "seq"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return ordered(files.mapInArrow(run, "_file string, _place long, seq_id string, seq string"))


def read_fasta_split(spark: SparkSession, path: str) -> DataFrame:
    """(file, place, seq_id, seq) of plain FASTA files whose headers hold no ``>`` behind the first, read in splits.

    Records are separated by ``>`` natively, so a file of any size is read by many tasks.
    """
    text = spark.read.option("lineSep", ">").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), "value")
    head = F.regexp_extract("value", r"^\s*(\S+)[^\n]*", 1)
    body = F.regexp_replace(F.regexp_replace("value", r"^\s*\S+[^\n]*\n?", ""), "[ \r\n]", "")
    return text.where(head != "").select("file", "place", head.alias("seq_id"), body.alias("seq"))


def read_pattern(spark: SparkSession, path: str, alphabet: str = "dna") -> Pattern:
    """A pattern file: ``%`` starts a comment, lines are joined."""
    rows = spark.read.text(path, wholetext=True).limit(2).collect()
    if len(rows) != 1:
        raise FileNotFoundError(f"{path} is not one pattern file")
    return parse(rows[0]["value"], alphabet)


def write_text(lines: DataFrame, path: str, order: list | None = None) -> None:
    """Write the column ``text`` in order, as one file of lines per sorted range."""
    rows = lines.orderBy(*order) if order else lines
    rows.select("text").write.mode("overwrite").text(path)


def read_gff3(spark: SparkSession, path: str, file_ord: int = 0) -> DataFrame:
    """(file_ord, line_ord, seqid, type, start, end, strand, attributes, line) of feature lines up to ``##FASTA``.

    Malformed lines raise when they are read.
    """
    rows = spark.read.text(path).withColumn("line_ord", F.monotonically_increasing_id())
    stop = rows.where(F.col("value").startswith("##FASTA") | F.col("value").startswith(">")).agg(F.min("line_ord").alias("_stop"))
    rows = rows.join(F.broadcast(stop), F.col("_stop").isNull() | (F.col("line_ord") < F.col("_stop")))
    rows = rows.where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    cells = F.split("value", "\t")
    start, end = cells[3].try_cast("long"), cells[4].try_cast("long")
    bad = (F.size(cells) != 9) | start.isNull() | end.isNull() | (start < 1) | (start > end)
    line = F.when(F.coalesce(bad, F.lit(True)), F.raise_error(F.concat(F.lit("malformed feature line: "), "value"))).otherwise(F.col("value"))
    return rows.select(F.lit(file_ord).alias("file_ord"), "line_ord", cells[0].alias("seqid"), cells[2].alias("type"), start.alias("start"), end.alias("end"), cells[6].alias("strand"), cells[8].alias("attributes"), line.alias("line"))
