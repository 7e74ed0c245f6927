"""Merging annotation files: grouping, duplicates, order, names and provenance."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqmotif.functions import natural_key
from seqmotif.operators.order import ranked
from seqmotif.session import ship, stored


def attribute(attributes: Column | str, key: str) -> Column:
    """The raw value of one key of a GFF3 attribute column, or null."""
    found = F.regexp_extract(attributes, rf"(?:^|;)\s*{key}=([^;]*)", 1)
    return F.when(found != "", found)


class MergeError(ValueError):
    """Annotation lines that don't form elements."""


def roots(features: DataFrame) -> DataFrame:
    """``features`` with ``top``, the line_ord of the feature at the top of its parents.

    Parents are followed by joins that double the distance each time. Raises MergeError if features are their own
    ancestors, and when it is read if a parent is missing, parents belong to several elements, or
    features of one ID have several parents.
    """
    spark = features.sparkSession
    rows = features.withColumns({"id": attribute("attributes", "ID"), "parents": F.split(attribute("attributes", "Parent"), ",")})
    same = rows.where("id IS NOT NULL").groupBy("file_ord", "id").agg(F.min("line_ord").alias("up"), F.count_distinct(F.coalesce(F.array_join("parents", ","), F.lit(""))).alias("_ways"))
    clash = F.raise_error(F.concat(F.lit("one ID under several parents: "), "id"))
    ids = same.select("file_ord", F.col("id").alias("parent"), F.when(F.col("_ways") > 1, clash).otherwise(F.col("up")).alias("up"))
    links = rows.select("file_ord", "line_ord", F.posexplode_outer("parents").alias("nth", "parent")).join(ids, ["file_ord", "parent"], "left")
    missing = F.col("parent").isNotNull() & F.col("up").isNull()
    links = links.withColumn("up", F.when(missing, F.raise_error(F.concat(F.lit("parent not found: "), "parent"))).otherwise(F.coalesce("up", "line_ord")))
    links = stored(links.select("file_ord", "line_ord", F.coalesce("nth", F.lit(0)).alias("nth"), F.col("parent").isNotNull().alias("below"), "up"), spark)
    below = links.where("nth = 0").select("file_ord", F.col("line_ord").alias("top"), F.col("below").alias("_below"))
    tops = stored(links.where("nth = 0").select("file_ord", "line_ord", F.col("up").alias("top")), spark)
    for _ in range(tops.count().bit_length() + 1):
        under = tops.join(below, ["file_ord", "top"]).where("_below")
        if not under.limit(1).count():
            break
        far = tops.select("file_ord", F.col("line_ord").alias("top"), F.col("top").alias("_far"))
        tops = stored(tops.join(far, ["file_ord", "top"]).select("file_ord", "line_ord", F.col("_far").alias("top")), spark)
    else:
        raise MergeError("a Parent loop")
    each = links.join(tops.select("file_ord", F.col("line_ord").alias("up"), "top"), ["file_ord", "up"])
    several = F.raise_error(F.concat(F.lit("parents in several elements: line "), F.col("line_ord").cast("string")))
    found = each.groupBy("file_ord", "line_ord").agg(F.min("top").alias("top"), F.max("top").alias("_most"))
    found = found.select("file_ord", "line_ord", F.when(F.col("top") != F.col("_most"), several).otherwise(F.col("top")).alias("top"))
    return features.join(found, ["file_ord", "line_ord"])


def elements(features: DataFrame) -> DataFrame:
    """(file_ord, elem_ord, seqid, start, end, name, lines): each top feature with its descendants' lines in order."""
    rows = roots(features)
    lines = rows.groupBy("file_ord", F.col("top").alias("elem_ord")).agg(F.sort_array(F.collect_list(F.struct("line_ord", "line"))).alias("lines"))
    tops = rows.where("top = line_ord").select("file_ord", F.col("line_ord").alias("elem_ord"), "seqid", "start", "end", F.coalesce(attribute("attributes", "Name"), attribute("attributes", "ID"), F.lit("")).alias("name"))
    return tops.join(lines, ["file_ord", "elem_ord"])


def keep_first_span(rows: DataFrame) -> DataFrame:
    """``rows`` with ``keeper_file``, ``keeper_elem``: of elements with one span (strand aside) the first in (file, line) order."""
    window = Window.partitionBy("seqid", "start", "end").orderBy("file_ord", "elem_ord")
    return rows.withColumns({"keeper_file": F.first("file_ord").over(window), "keeper_elem": F.first("elem_ord").over(window)})


def overlapping(a: tuple[int, int], b: tuple[int, int], share: float) -> bool:
    """Do two spans overlap by ``share`` of the longer one, or coincide?"""
    common = min(a[1], b[1]) - max(a[0], b[0]) + 1
    return a == b or common > 0 and common >= share * max(a[1] - a[0] + 1, b[1] - b[0] + 1) - 1e-9


def keep_overlap(rows: DataFrame, share: float) -> DataFrame:
    """Keepers under reciprocal overlap: an element goes if it overlaps one already kept; of several the earliest is its keeper.

    Only elements that overlap by chains of spans decide over each other. Such
    clusters are found by windows and each is decided in priority order.
    """
    ship(rows.sparkSession)
    window = Window.partitionBy("seqid").orderBy("start", "end", "file_ord", "elem_ord")
    before = F.max("end").over(window.rowsBetween(Window.unboundedPreceding, -1))
    cluster = F.sum(F.when(before.isNull() | (F.col("start") > before), 1).otherwise(0)).over(window)
    spans = rows.select("file_ord", "elem_ord", "seqid", "start", "end").withColumn("cluster", cluster)

    def decide(group: pa.Table) -> pa.Table:
        starts: list[int] = []  # of the kept spans, in order, with what is known of them
        kept: list[tuple[int, int, int, int, int]] = []
        out = []
        for number, r in enumerate(sorted(group.to_pylist(), key=lambda r: (r["file_ord"], r["elem_ord"]))):
            a, b = r["start"], r["end"]
            reach = (b - a + 1) * (1 / share - 1) + 1 if share > 0 else float("inf")  # spans that overlap so far begin this near
            some = kept[bisect_left(starts, a - reach) : bisect_right(starts, a + reach)]
            near = min((k[2:] for k in some if overlapping(k[:2], (a, b), share)), default=None)
            if near is None:
                k = bisect_right(starts, a)
                starts.insert(k, a)
                kept.insert(k, (a, b, number, r["file_ord"], r["elem_ord"]))
            out.append((r["file_ord"], r["elem_ord"], *(near[1:] if near else (r["file_ord"], r["elem_ord"]))))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.int32(), pa.int64()))], ["file_ord", "elem_ord", "keeper_file", "keeper_elem"])

    kept = spans.groupBy("seqid", "cluster").applyInArrow(decide, "file_ord int, elem_ord long, keeper_file int, keeper_elem long")
    return rows.join(kept, ["file_ord", "elem_ord"])


def merge(rows: DataFrame, share: float | None = None, prefix: str | None = None, first: int = 1, default: str = "hit", files: list[str] | None = None) -> DataFrame:
    """Kept elements in output order with new names.

    ``rows``: file_ord, elem_ord, seqid, start, end, name. Returns out_ord,
    seqid, start, end, old_name, new_name, merged (``file:name`` of what each
    stands for, in priority order) and n_merged.
    """
    named = files or []
    kept = keep_first_span(rows) if share is None else keep_overlap(rows, share)
    own = (F.col("file_ord") == F.col("keeper_file")) & (F.col("elem_ord") == F.col("keeper_elem"))
    label = F.concat(F.element_at(F.array(*map(F.lit, named)), F.col("file_ord") + 1) if named else F.col("file_ord").cast("string"), F.lit(":"), "name")
    gone = kept.where(~own).groupBy("keeper_file", "keeper_elem").agg(F.sort_array(F.collect_list(F.struct("file_ord", "elem_ord", label.alias("label")))).alias("_m"))
    gone = gone.select(F.col("keeper_file").alias("file_ord"), F.col("keeper_elem").alias("elem_ord"), F.array_join(F.transform("_m", lambda m: m["label"]), ",").alias("merged"), F.size("_m").alias("n_merged"))
    out = kept.where(own).select(*rows.columns).join(gone, ["file_ord", "elem_ord"], "left")
    stem = F.lit(prefix) if prefix else F.regexp_replace("name", r"\d+$", "")
    out = out.withColumns({"_stem": F.when(stem == "", F.lit(default)).otherwise(stem), "_key": natural_key(F.col("seqid"))})
    order = ["_key", "start", F.desc("end"), "file_ord", "elem_ord"]
    out = ranked(out, order, {"out_ord": [], "_number": ["_stem"]})
    out = out.withColumns({"new_name": F.concat("_stem", (F.col("_number") + (first - 1)).cast("string")), "out_ord": F.col("out_ord").cast("long")})
    return out.select("out_ord", "seqid", "start", "end", F.col("name").alias("old_name"), "new_name", F.coalesce("merged", F.lit("")).alias("merged"), F.coalesce("n_merged", F.lit(0)).alias("n_merged"), *[c for c in ("lines",) if c in rows.columns])


def renamed_line(line: str, top: bool, old: str, new: str, merged: str) -> str:
    """A feature line with its ID, Parent and Name under the element's new name."""
    cells = line.split("\t")
    pairs = [p.split("=", 1) if "=" in p else [p, None] for p in cells[8].split(";") if p]

    def under(value: str) -> str:
        return new if value == old else new + value[len(old) :] if old and value.startswith(old + ".") else f"{new}.{value}"

    names = [k for k, _ in pairs]
    out = []
    if top and "Name" not in names and "ID" not in names:
        out.append(f"Name={new}")
    for key, value in pairs:
        if key == "Name":
            out.append(f"Name={new}")
        elif key == "ID":
            out.append(f"ID={under(value or '')}")
            if top and "Name" not in names:
                out.append(f"Name={new}")
        elif key == "Parent":
            out.append("Parent=" + ",".join(map(under, (value or "").split(","))))
        elif key == "Merged" and top and merged:
            out.append(f"Merged={value},{merged}")
        else:
            out.append(key if value is None else f"{key}={value}")
    if top and merged and "Merged" not in names:
        out.append(f"Merged={merged}")
    return "\t".join([*cells[:8], ";".join(out)])


def merged_lines(merged: DataFrame) -> DataFrame:
    """(out_ord, text): the rewritten lines of merged elements that carry ``lines``."""
    ship(merged.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for r in batch.to_pylist():
                lines = [x["line"] for x in r["lines"]]
                old = next((p[3:] for p in lines[0].split("\t")[8].split(";") if p.startswith("ID=")), "")
                texts.append("\n".join([*(renamed_line(x, k == 0, old, r["new_name"], r["merged"]) for k, x in enumerate(lines)), "###"]))
            yield pa.RecordBatch.from_arrays([batch.column("out_ord"), pa.array(texts, pa.string())], ["out_ord", "text"])

    return merged.select("out_ord", "new_name", "merged", "lines").mapInArrow(run, "out_ord long, text string")


def merge_files(spark: SparkSession, paths: list[str], share: float | None = None, prefix: str | None = None, first: int = 1) -> DataFrame:
    """(out_ord, text): GFF3 files merged into one, earlier files first in priority."""
    from functools import reduce

    from seqmotif.sources.fasta import read_gff3

    rows = reduce(DataFrame.unionByName, [elements(read_gff3(spark, p, k)) for k, p in enumerate(paths)])
    return merged_lines(merge(rows, share, prefix, first, files=[p.rsplit("/", 1)[-1] for p in paths]))


def summary(rows: DataFrame, merged: DataFrame) -> str:
    """How many elements were read, removed and written."""
    read, written = rows.count(), merged.count()
    return f"merge: {read} elements read, {read - written} duplicates removed, {written} written"
