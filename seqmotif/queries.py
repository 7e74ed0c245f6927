"""Queries of the engine's operators over the driver's tables, and SQL with the same results.

Sequences come from document texts: their letters that are plain bases
(``dna``), nucleotide codes (``iupac``) or any ASCII letters (``protein``).
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqmotif import functions, streaming
from seqmotif.operators import features, merge, scan
from seqmotif.pattern import lint, parse
from seqmotif.session import scratch, table
from seqmotif.sources import catalog, fasta, matrix

Query = Callable[[SparkSession, str], DataFrame]
KEEP = {"dna": "[^ACGT]", "iupac": "[^ACGTURYSWKMBDHVN]", "protein": "[^A-Z]"}
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def sequences(spark: SparkSession, sf_dir: str, kind: str = "dna") -> DataFrame:
    """(seq_ord, seq_id, seq) of all documents."""
    letters = KEEP[kind][2:-1]
    others = "[^A-Za-z]+" if kind == "protein" else f"[^{letters}{letters.lower()}]+"
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq_ord"), F.col("doc_id").cast("string").alias("seq_id"), F.upper(F.regexp_replace(F.coalesce("text", F.lit("")), others, "")).alias("seq"))


def base_sql(kind: str = "dna") -> str:
    """CTEs s (seq_ord, s) and p (seq_ord, s, i): sequences and their positions."""
    letters = "upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g'))"
    kept = f"regexp_replace({letters}, '{KEEP[kind]}', '', 'g')"
    kept = f"replace({kept}, 'U', 'T')" if kind == "iupac" else kept
    return f"s AS (SELECT doc_id AS seq_ord, {kept} AS s FROM documents), p AS (SELECT seq_ord, s, unnest(range(1, length(s) + 1)) AS i FROM s)"


def chain_sql(candidates: str, kind: str = "dna", columns: str = 'seq_ord, CAST(h.start AS BIGINT) AS start, CAST(h."end" AS BIGINT) AS "end"') -> str:
    """The left-to-right chain over the first hits of all starts, folded over each sequence's list of them; ``h`` is a kept hit."""
    return f"""WITH {base_sql(kind)}, c AS ({candidates}),
r AS (SELECT seq_ord, unnest(list_reduce(list([{{'start': start, 'end': "end"}}] ORDER BY start), lambda a, b: CASE WHEN b[1].start > a[-1]."end" THEN list_concat(a, b) ELSE a END)) AS h FROM c GROUP BY seq_ord)
SELECT {columns} FROM r"""


def add(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def wrap(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return wrap


def places(found: DataFrame) -> DataFrame:
    return found.select("seq_ord", "start", "end")


def scanned(name: str, pattern: str, candidates: str | None, kind: str = "dna", **options: object) -> None:
    """Register a chained forward scan whose first hits per start are ``candidates``: SELECT seq_ord, start, end."""
    alphabet = "protein" if kind == "protein" else "dna"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return places(scan.scan(sequences(spark, sf_dir, kind), pattern, alphabet, plain=kind == "dna", units=False, **options))  # type: ignore[arg-type]

    add(name, candidates and chain_sql(candidates, kind))(run)


def revcomp_sql(text: str) -> str:
    return f"reverse(translate({text}, 'ACGT', 'TGCA'))"


def first_sql(lengths: str, condition: str, size: str, order: str) -> str:
    """First hits when a start has several choices: rows of ``lengths`` (a FROM item) that meet the condition, least by ``order``."""
    return f"""SELECT seq_ord, i AS start, i + {size} - 1 AS "end" FROM (SELECT *, row_number() OVER (PARTITION BY seq_ord, i ORDER BY {order}) AS k FROM p, {lengths} WHERE i + {size} - 1 <= length(s) AND {condition}) WHERE k = 1"""


def at(n: int | str, offset: str = "0") -> str:
    return f"substr(s, CAST(i + {offset} AS BIGINT), CAST({n} AS BIGINT))"


def fixed_sql(condition: str, n: int) -> str:
    return f'SELECT seq_ord, i AS start, i + {n - 1} AS "end" FROM p WHERE i + {n - 1} <= length(s) AND {condition}'


GAP = "(SELECT unnest(range({}, {})) AS g) g"
off_by = lambda a, b, n: " + ".join(f"CAST(substr({a}, {k}, 1) <> substr({b}, {k}, 1) AS INTEGER)" for k in range(1, n + 1))
off_word = lambda text, word: " + ".join(f"CAST(substr({text}, {k}, 1) NOT IN ({c}) AS INTEGER)" for k, c in enumerate(("'" + "', '".join(functions.IUPAC[x]) + "'" for x in word), 1))

scanned("word_exact", "TATAA", fixed_sql(f"{at(5)} = 'TATAA'", 5))
scanned("word_iupac", "RYRRYN", fixed_sql(f"regexp_full_match({at(6)}, '[AG][CT][AG][AG][CT][ACGT]')", 6))
scanned("word_protein_x", "ESXXN", fixed_sql(f"regexp_full_match({at(5)}, 'ES..N')", 5), "protein")
scanned("word_mismatch", "TATACA[1,0,0]", fixed_sql(f"{off_word(at(6), 'TATACA')} <= 1", 6))
scanned("word_indel", "TATACCA[1,1,1]", None)
scanned("gap", "TATA 3...12 GCA", first_sql(GAP.format(3, 13), f"{at(4)} = 'TATA' AND {at(3, '4 + g')} = 'GCA'", "7 + g", "g"))
scanned("range_first", "4...8", "SELECT seq_ord, i AS start, i + 3 AS \"end\" FROM p WHERE i + 3 <= length(s)")
scanned("direct_repeat", "p1=6...6 0...20 p1", first_sql(GAP.format(0, 21), f"{at(6)} = {at(6, '6 + g')}", "12 + g", "g"))
scanned("named_repeat", "p1=4...6 2...8 p1", first_sql("(SELECT unnest(range(4, 7)) AS n) n, " + GAP.format(2, 9), f"{at('n')} = {at('n', 'n + g')}", "2 * n + g", "n, g"))
scanned("tandem_repeat", "p1=3...3 p1 p1", fixed_sql(f"{at(3)} = {at(3, '3')} AND {at(3)} = {at(3, '6')}", 9))
scanned("repeat_mismatch", "p1=6...6 3...3 p1[1,0,0]", fixed_sql(f"{off_by(at(6), at(6, '9'), 6)} <= 1", 15))
scanned("hairpin", "p1=5...5 3...8 ~p1", first_sql(GAP.format(3, 9), f"{at(5, '5 + g')} = {revcomp_sql(at(5))}", "10 + g", "g"))
scanned("hairpin_mismatch", "p1=6...6 3...5 ~p1[1,0,0]", first_sql(GAP.format(3, 6), f"{off_by(at(6, '6 + g'), revcomp_sql(at(6)), 6)} <= 1", "12 + g", "g"))
scanned("hairpin_indel", "p1=6...6 3...5 ~p1[1,1,1]", None)
scanned("hairpin_aligned", "p1=6...6 3...5 ~p1[0,1,1] A", None, align=True)
scanned("gu_pairs", "r1={at,ta,gc,cg,gt,tg} p1=5...5 3...6 r1~p1", first_sql(GAP.format(3, 7), " AND ".join(f"substr(s, CAST(i + {4 - k} AS BIGINT), 1) || substr(s, CAST(i + 5 + g + {k} AS BIGINT), 1) IN ('AT','TA','GC','CG','GT','TG')" for k in range(5)), "10 + g", "g"))
scanned("palindrome_reverse", "p1=5...5 <p1", fixed_sql(f"{at(5, '5')} = reverse({at(5)})", 10))
COLUMNS = [[50, 0, 50, 0], [0, 0, 0, 75], [50, 50, 0, 0], [10, -20, 30, 5]]
score_sql = " + ".join("CASE " + " ".join(f"WHEN {at(1, str(k))} = '{b}' THEN {w}" for b, w in zip("ACGT", c)) + " END" for k, c in enumerate(COLUMNS))
weight_text = "{" + ",".join("(" + ",".join(map(str, c)) + ")" for c in COLUMNS) + "}"
scanned("weight_matrix", f"{weight_text} > 120", fixed_sql(f"({score_sql}) > 120", 4))
scanned("weight_upper_bound", f"190 > {weight_text} > 120", fixed_sql(f"({score_sql}) > 120 AND ({score_sql}) < 190", 4))
PROTEIN = [[(7 * k + 3 * j) % 11 - 4 for k in range(20)] for j in range(4)]
protein_sql = " + ".join(f"coalesce({c}[strpos('ACDEFGHIKLMNPQRSTVWY', {at(1, str(k))})], 0)" for k, c in enumerate(PROTEIN))
scanned("weight_protein", "{" + ",".join("(" + ",".join(map(str, c)) + ")" for c in PROTEIN) + "} > 20", fixed_sql(f"({protein_sql}) > 20", 4), "protein")
scanned("length_limit", "p1=3...5 CAT p2=2...5 length(p1+p2) < 8 A", first_sql("(SELECT unnest(range(3, 6)) AS n) n, (SELECT unnest(range(2, 6)) AS g) g", f"{at(3, 'n')} = 'CAT' AND n + g < 8 AND {at(1, 'n + 3 + g')} = 'A'", "n + 4 + g", "n, g"))
scanned("alternative", "TA ( ACA | GG ) T", first_sql("(SELECT unnest(['ACA', 'GG']) AS a, unnest([1, 2]) AS b) b", f"{at('3 + length(a)')} = 'TA' || a || 'T'", "3 + length(a)", "b"))
scanned("alternative_first", "( TATA | GCG )", None)
FOLD = """list_reduce(list([{{'start': i, 'end': i + {n} - 1}}] ORDER BY i), lambda a, b: CASE WHEN b[1].start > a[-1]."end" THEN list_concat(a, b) ELSE a END)"""
SQL["alternative_first"] = f"""WITH {base_sql()}, a AS (SELECT seq_ord, {FOLD.format(n=4)} AS h FROM p WHERE substr(s, i, 4) = 'TATA' GROUP BY seq_ord),
b AS (SELECT p.seq_ord, {FOLD.format(n=3)} AS h FROM p LEFT JOIN a ON a.seq_ord = p.seq_ord WHERE substr(s, i, 3) = 'GCG' AND i > coalesce(a.h[-1]."end", 0) GROUP BY p.seq_ord)
SELECT seq_ord, CAST(h.start AS BIGINT) AS start, CAST(h."end" AS BIGINT) AS "end" FROM (SELECT seq_ord, unnest(h) AS h FROM a UNION ALL SELECT seq_ord, unnest(h) FROM b)"""
scanned("anchor_start", "^ 2...9 TA", f'SELECT seq_ord, 1 AS start, 2 + min(g) AS "end" FROM s, {GAP.format(2, 10)} WHERE substr(s, CAST(1 + g AS BIGINT), 2) = \'TA\' GROUP BY seq_ord')
scanned("anchor_end", "AC $", fixed_sql(f"{at(2)} = 'AC' AND i + 1 = length(s)", 2))
scanned("any_set", "any(HQD) E any(ST)", fixed_sql(f"regexp_full_match({at(3)}, '[HQD]E[ST]')", 3), "protein")
scanned("notany_set", "T notany(AEIOU) notany(H)", fixed_sql(f"regexp_full_match({at(3)}, 'T[^AEIOU][^H]')", 3), "protein")
scanned("non_overlapping_chain", "p1=3...3 p1", fixed_sql(f"{at(3)} = {at(3, '3')}", 6))
scanned("tir_elements", "TA p2=6...6 20...400 ~p2 TA", first_sql(GAP.format(20, 401), f"{at(2)} = 'TA' AND {at(6, '8 + g')} = {revcomp_sql(at(6, '2'))} AND {at(2, '14 + g')} = 'TA'", "16 + g", "g"))
scanned("tir_mm", "TA p2=6...6 20...24 ~p2[1,0,0] TA", first_sql(GAP.format(20, 25), f"{at(2)} = 'TA' AND {off_by(at(6, '8 + g'), revcomp_sql(at(6, '2')), 6)} <= 1 AND {at(2, '14 + g')} = 'TA'", "16 + g", "g"))
CODES = "MAP {" + ", ".join(f"'{c}': '{b}'" for c, b in functions.IUPAC.items()) + "}"
same = lambda k: f"contains('ACGT', {at(1, str(4 + k))}) AND contains({CODES}[{at(1, str(k))}], {at(1, str(4 + k))})"
scanned("lax_n", "p1=4...4 p1", fixed_sql(" AND ".join(map(same, range(4))), 8), "iupac")
scanned("strict_n", "p1=4...4 p1", fixed_sql(f"{at(4)} = {at(4, '4')} AND regexp_full_match({at(4)}, '[ACGT]*')", 8), "iupac", strict_n=True)


@add("overlapping_hits", f"""WITH {base_sql()} SELECT seq_ord, CAST(i AS BIGINT) AS start, CAST(i + 7 + g AS BIGINT) AS "end", CAST(row_number() OVER (PARTITION BY seq_ord ORDER BY i, g) - 1 AS BIGINT) AS hit_ord
FROM p, {GAP.format(1, 5)} WHERE i + 7 + g <= length(s) AND {at(4)} = {at(4, '4 + g')}""")
def overlapping_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.scan(sequences(spark, sf_dir), "p1=4...4 1...4 p1", overlaps=True, units=False).select("seq_ord", "start", "end", "hit_ord")


@add("both_strands", f"""WITH {base_sql()} SELECT seq_ord, strand, CAST(i AS BIGINT) AS start, CAST(i + 3 AS BIGINT) AS "end" FROM p, (VALUES ('+', 'TGGA'), ('-', 'TCCA')) v(strand, w) WHERE substr(s, i, 4) = w""")
def both_strands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.scan(sequences(spark, sf_dir), "TGGA", both_strands=True, plain=True, units=False).select("seq_ord", "strand", "start", "end")


@add("dedup_strands", f"""WITH {base_sql()} SELECT seq_ord, CAST(i AS BIGINT) AS start, CAST(i + 3 AS BIGINT) AS "end", '.' AS strand FROM p WHERE substr(s, i, 4) = 'AATT'""")
def dedup_strands(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan.scan(sequences(spark, sf_dir), "AATT", both_strands=True, plain=True, units=False)
    return features.dedup_strands(found).select("seq_ord", "start", "end", F.col("shown").alias("strand"))


@add("hit_limit", f"""WITH {base_sql()} SELECT seq_ord, CAST(i AS BIGINT) AS start, CAST(i + 4 AS BIGINT) AS "end" FROM p WHERE substr(s, i, 5) = 'TATAA' ORDER BY seq_ord, i LIMIT 100""")
def hit_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places(scan.scan(sequences(spark, sf_dir), "TATAA", plain=True, units=False, max_hits=100))


@add("miss_limit", f"""WITH {base_sql()}, h AS (SELECT seq_ord, i FROM p WHERE substr(s, i, 5) = 'TATAA'),
m AS (SELECT seq_ord, row_number() OVER (ORDER BY seq_ord) AS k FROM s WHERE seq_ord NOT IN (SELECT seq_ord FROM h))
SELECT seq_ord, CAST(i AS BIGINT) AS start, CAST(i + 4 AS BIGINT) AS "end" FROM h WHERE seq_ord < coalesce((SELECT seq_ord FROM m WHERE k = 20), 9223372036854775807)""")
def miss_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places(scan.scan(sequences(spark, sf_dir), "TATAA", plain=True, units=False, max_misses=20))


@add("ignore_ids", f"""WITH {base_sql()} SELECT seq_ord, CAST(i AS BIGINT) AS start, CAST(i + 4 AS BIGINT) AS "end" FROM p WHERE substr(s, i, 5) = 'TATAA' AND seq_ord NOT IN (SELECT doc_id FROM labels)""")
def ignore_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("seq_id"))
    return places(scan.scan(sequences(spark, sf_dir), "TATAA", plain=True, units=False, ignore_ids=ids))


WORDS = ["TATAA", "GCAGC", "ACGGTA"]


@add("multi_pattern", f"""WITH {base_sql()}, c AS (SELECT seq_ord, k AS pat_ord, i, length(w) AS n FROM p, (VALUES (0, 'TATAA'), (1, 'GCAGC'), (2, 'ACGGTA')) v(k, w) WHERE substr(s, i, length(w)) = w)
SELECT seq_ord, pat_ord, CAST(i AS BIGINT) AS start, CAST(i + n - 1 AS BIGINT) AS "end" FROM c""")
def multi_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.scan(sequences(spark, sf_dir), WORDS, overlaps=True, plain=True, units=False).select("seq_ord", "pat_ord", "start", "end")


CHAINED = 'seq_ord, {} AS pat_ord, CAST(h.start AS BIGINT) AS start, CAST(h."end" AS BIGINT) AS "end"'


@add("multi_pattern_chain", " UNION ALL ".join(f"SELECT * FROM ({chain_sql(fixed_sql(f"{at(len(w))} = '{w}'", len(w)), columns=CHAINED.format(k))})" for k, w in enumerate(WORDS)))
def multi_pattern_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.scan(sequences(spark, sf_dir), WORDS, plain=True, units=False).select("seq_ord", "pat_ord", "start", "end")


HITS_SQL = f"""{base_sql()}, h AS (SELECT seq_ord, i, CAST(row_number() OVER (ORDER BY seq_ord, i) AS BIGINT) AS n FROM p WHERE substr(s, i, 5) = 'TATAA')"""


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.scan(sequences(spark, sf_dir), "TATAA", plain=True)


@add("native_text", f"""WITH {HITS_SQL} SELECT '>' || seq_ord || ':[' || i || ',' || (i + 4) || ']' || chr(10) || 'TATAA ' AS text FROM h""")
def native_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.native_text(planted(spark, sf_dir)).select("text")


@add("named_hits", f"""WITH {HITS_SQL} SELECT seq_ord, CAST(i AS BIGINT) AS start, 'M' || (n + 6) AS name FROM h""")
def named_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.named(planted(spark, sf_dir), ["M"], first=7).select("seq_ord", "start", "name")


@add("bed6", f"""WITH {HITS_SQL} SELECT seq_ord || chr(9) || (i - 1) || chr(9) || (i + 4) || chr(9) || 'M' || n || chr(9) || '0' || chr(9) || '+' AS text FROM h""")
def bed6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.bed6(features.named(planted(spark, sf_dir), ["M"])).select("text")


@add("jsonl_units", f"""WITH {HITS_SQL} SELECT '{{"seq":"' || seq_ord || '","strand":"+","start":' || i || ',"end":' || (i + 4) || ',"name":"M' || n || '","type":"sequence_motif","units":[{{"line":1,"start":' || i || ',"end":' || (i + 4) || ',"text":"TATAA"}}]}}' AS text FROM h""")
def jsonl_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = features.named(planted(spark, sf_dir), ["M"], keep_empty=True)
    return features.rendered(found, [parse("TATAA")], "jsonl").select("text")


LABELLED = """%@element CACTA_TIR_transposon Name=DTC Classification=TIR/DTC
p1=2...2          %@ target_site_duplication
CA p2=3...3       %@ five_prime_terminal_inverted_repeat
10...60
~p2 TG            %@ three_prime_terminal_inverted_repeat
p1                %@ target_site_duplication
"""
ELEMENT_SQL = chain_sql(first_sql(GAP.format(10, 61), f"{at(2, '2')} = 'CA' AND {at(3, '7 + g')} = {revcomp_sql(at(3, '4'))} AND {at(2, '10 + g')} = 'TG' AND {at(2, '12 + g')} = {at(2)}", "14 + g", "g"), columns="r.seq_ord, s.s, h.start AS a, h.\"end\" AS b")
ELEMENT_SQL = f"""SELECT *, CAST(row_number() OVER (ORDER BY seq_ord, a) AS BIGINT) AS n FROM ({ELEMENT_SQL} JOIN s ON s.seq_ord = r.seq_ord)"""


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.named(scan.scan(sequences(spark, sf_dir), parse(LABELLED), plain=True), ["DTC"])


@add("bed12", f"""SELECT seq_ord || chr(9) || (a - 1) || chr(9) || b || chr(9) || 'DTC' || n || chr(9) || '0' || chr(9) || '+' || chr(9) || (a + 1) || chr(9) || (b - 2) || chr(9) || '0' || chr(9) || '4' || chr(9) || '2,5,5,2,' || chr(9) || '0,2,' || (b - a - 6) || ',' || (b - a - 1) || ',' AS text FROM ({ELEMENT_SQL})""")
def bed12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.rendered(elements(spark, sf_dir), [parse(LABELLED)], "bed12").select("text")


def _feature_sql(kind: str, a: str, b: str, suffix: str, parent: str | None, term: str, more: str = "''") -> str:
    up = f"';Parent=DTC' || n || '{parent}' || " if parent is not None else ""
    return f"seq_ord || chr(9) || 'seqmotif' || chr(9) || '{kind}' || chr(9) || ({a}) || chr(9) || ({b}) || chr(9) || '.' || chr(9) || '+' || chr(9) || '.' || chr(9) || 'ID=DTC' || n || '{suffix}' || {up}';Name=DTC' || n || ';Classification=TIR/DTC;Method=structural;Sequence_ontology={term}' || {more} || chr(10)"


_TSD = "';TSD=' || substr(s, a, 2) || '_' || substr(s, a, 2) || ';TIR=' || substr(s, a + 2, 5) || '_' || substr(s, b - 6, 5)"


@add("gff3_features", "SELECT " + " || ".join([
    _feature_sql("repeat_region", "a", "b", "", None, "SO:0000657"),
    _feature_sql("target_site_duplication", "a", "a + 1", ".lTSD", "", "SO:0000434"),
    _feature_sql("CACTA_TIR_transposon", "a + 2", "b - 2", ".te", "", "SO:0002285", _TSD),
    _feature_sql("five_prime_terminal_inverted_repeat", "a + 2", "a + 6", ".lTIR", ".te", "SO:0000420"),
    _feature_sql("three_prime_terminal_inverted_repeat", "b - 6", "b - 2", ".rTIR", ".te", "SO:0000421"),
    _feature_sql("target_site_duplication", "b - 1", "b", ".rTSD", "", "SO:0000434"),
]) + f" || '###' AS text FROM ({ELEMENT_SQL})")
def gff3_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.rendered(elements(spark, sf_dir), [parse(LABELLED)], "gff3").select("text")


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and orders read as two annotation files on sequences named by source."""
    docs = table(spark, sf_dir, "documents")
    start = (F.col("doc_id") % 977 + 1).alias("start")
    a = docs.select(F.lit(0).alias("file_ord"), F.col("doc_id").alias("elem_ord"), F.col("source").alias("seqid"), start, (start + F.col("n_chars") % 40).alias("end"), F.concat(F.lit("A"), "doc_id").alias("name"))
    b = docs.select(F.lit(1).alias("file_ord"), F.col("doc_id").alias("elem_ord"), F.col("source").alias("seqid"), start, (start + F.col("n_chars") % 20).alias("end"), F.concat(F.lit("B"), "doc_id").alias("name"))
    return a.unionByName(b)


SPANS_SQL = """e AS (SELECT 0 AS f, doc_id AS d, source AS seqid, doc_id % 977 + 1 AS a, doc_id % 977 + 1 + n_chars % 40 AS b, 'A' || doc_id AS name FROM documents
UNION ALL SELECT 1, doc_id, source, doc_id % 977 + 1, doc_id % 977 + 1 + n_chars % 20, 'B' || doc_id FROM documents)"""


@add("merge_exact", f"""WITH {SPANS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY seqid, a, b ORDER BY f, d) AS k, first_value(f) OVER (PARTITION BY seqid, a, b ORDER BY f, d) AS kf, first_value(d) OVER (PARTITION BY seqid, a, b ORDER BY f, d) AS kd FROM e),
g AS (SELECT kf, kd, string_agg(f || ':' || name, ',' ORDER BY f, d) AS merged, count(*) AS n FROM r WHERE k > 1 GROUP BY kf, kd),
o AS (SELECT r.*, coalesce(g.merged, '') AS merged, coalesce(g.n, 0) AS n, row_number() OVER (ORDER BY CAST(substr(seqid, 4) AS INTEGER), a, b DESC, f, d) AS out_ord, regexp_replace(name, '[0-9]+$', '') AS stem FROM r LEFT JOIN g ON r.f = g.kf AND r.d = g.kd WHERE k = 1)
SELECT out_ord, seqid, a AS start, b AS "end", name AS old_name, stem || row_number() OVER (PARTITION BY stem ORDER BY out_ord) AS new_name, merged, CAST(n AS INTEGER) AS n_merged FROM o""")
def merge_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.merge(spans(spark, sf_dir))


@add("merge_overlap")
def merge_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.merge(spans(spark, sf_dir), share=0.8, prefix="E")


@add("natural_order", """SELECT source, CAST(row_number() OVER (ORDER BY CAST(substr(source, 4) AS INTEGER)) AS BIGINT) AS place FROM (SELECT DISTINCT source FROM documents)""")
def natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    sources = table(spark, sf_dir, "documents").select("source").distinct()
    return sources.select("source", F.row_number().over(Window.orderBy(functions.natural_key(F.col("source")))).cast("long").alias("place"))


@add("kmer_index", f"""WITH {base_sql()} SELECT substr(s, i, 5) AS kmer, count(*) AS n, count(DISTINCT seq_ord) AS n_seqs FROM p WHERE i + 4 <= length(s) GROUP BY ALL""")
def kmer_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_record = sequences(spark, sf_dir).select("seq_ord", F.explode(functions.kmers("seq", 5)).alias("kmer")).groupBy("seq_ord", "kmer").agg(F.count("*").alias("m"))
    return per_record.groupBy("kmer").agg(F.sum("m").cast("long").alias("n"), F.count("*").alias("n_seqs"))


@add("revcomp_scalar", f"""WITH {base_sql()} SELECT seq_ord, {revcomp_sql('s')} AS rc, length(s) AS n FROM s""")
def revcomp_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences(spark, sf_dir).select("seq_ord", functions.revcomp("seq").alias("rc"), F.length("seq").cast("long").alias("n"))


@add("pwm_score_distribution", "WITH d AS (SELECT " + " + ".join(f"w{k}" for k in range(4)) + " AS score FROM " + ", ".join(f"(SELECT unnest({c}) AS w{k}) c{k}" for k, c in enumerate(COLUMNS)) + """), g AS (SELECT score, count(*) AS words FROM d GROUP BY score)
SELECT CAST(score AS BIGINT) AS score, CAST(words AS BIGINT) AS words, CAST(sum(words) OVER (ORDER BY score DESC) - words AS BIGINT) AS above FROM g""")  # fmt: skip
def pwm_score_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.distribution_frame(spark, COLUMNS)


@add("fasta_roundtrip", f"""WITH {base_sql()} SELECT CAST(seq_ord AS VARCHAR) AS seq_id, s AS seq FROM s""")
def fasta_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    lines = sequences(spark, sf_dir).select(F.concat(F.lit(">"), "seq_id", F.lit(" from documents\n"), F.regexp_replace("seq", "(.{60})", "$1\n")).alias("text"))
    lines.write.option("compression", "gzip").text(path)
    return fasta.read_fasta(spark, path).select("seq_id", "seq")


@add("fasta_split", f"""WITH {base_sql()} SELECT CAST(seq_ord AS VARCHAR) AS seq_id, s AS seq FROM s""")
def fasta_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    sequences(spark, sf_dir).select(F.concat(F.lit(">"), "seq_id", F.lit(" x\n"), F.regexp_replace("seq", "(.{60})", "$1\n")).alias("text")).write.text(path)
    return fasta.read_fasta_split(spark, path).select("seq_id", "seq")


@add("stream_scan", SQL["word_exact"])
def stream_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, out = scratch(spark), scratch(spark)
    seqs = sequences(spark, sf_dir)
    seqs.write.parquet(source)
    stream = streaming.stream_scan(spark.readStream.schema(seqs.schema).parquet(source), "TATAA", plain=True)
    stream.select("seq_ord", "start", "end").writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch(spark)).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("seq_ord long, start long, end long").parquet(out)


@add("scan_pieces", SQL["hairpin"])
def scan_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places(scan.scan(sequences(spark, sf_dir), "p1=5...5 3...8 ~p1", piece=500, units=False))


@add("sql_table_function", SQL["word_exact"])
def sql_table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    streaming.register(spark)
    sequences(spark, sf_dir).createOrReplaceTempView("motif_sequences")
    return spark.sql("SELECT seq_ord, m.start, m.end FROM motif_sequences, LATERAL motif_scan(seq, 'TATAA') m")


@add("sql_functions", f"""WITH {base_sql()} SELECT seq_ord, {revcomp_sql('substr(s, 1, 20)')} AS rc, regexp_full_match(substr(s, 1, 3), '[AG][CT][ACGT]') AS fits FROM s""")
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    functions.register(spark)
    sequences(spark, sf_dir).createOrReplaceTempView("motif_sequences")
    return spark.sql("SELECT seq_ord, revcomp(substr(seq, 1, 20)) AS rc, iupac_match(substr(seq, 1, 3), 'RYN') AS fits FROM motif_sequences")


@add("sql_functions_whole", f"""WITH {base_sql()} SELECT seq_ord, CAST(i AS BIGINT) AS start, CASE WHEN i = 1 THEN {revcomp_sql('s')} END AS rc, regexp_full_match(substr(s, i, 3), '[AG][CT][ACGT]') AS fits FROM (SELECT seq_ord, s, unnest(range(1, greatest(length(s) - 2, 1) + 1)) AS i FROM s)""")
def sql_functions_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    functions.register(spark)
    sequences(spark, sf_dir).createOrReplaceTempView("motif_sequences")
    return spark.sql("SELECT seq_ord, CAST(coalesce(at, 0) + 1 AS BIGINT) AS start, CASE WHEN coalesce(at, 0) = 0 THEN revcomp(seq) END AS rc, coalesce(iupac_match(w, 'RYN'), false) AS fits FROM motif_sequences LATERAL VIEW OUTER posexplode(regexp_extract_all(seq, '(?s)(?=(.{3}))', 1)) x AS at, w")


@add("lint_report")
def lint_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lint.lint_frame(spark, [(r[0], r[2]) for r in catalog.ELEMENTS] + [("labelled", LABELLED)], both_strands=True)


@add("explain_units")
def explain_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lint.explain_frame(spark, LABELLED)


@add("pattern_catalog")
def pattern_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.catalog(spark)


@add("catalog_scan")
def catalog_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan.scan(sequences(spark, sf_dir), [r[2] for r in catalog.ELEMENTS], both_strands=True, units=False)
    return found.groupBy("pat_ord", "strand").agg(F.count("*").alias("n"), F.min("start").alias("least"), F.max("end").alias("most"))
