"""Scalar expressions on sequences, all evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seqmotif.pattern.units import AMINO, COMPLEMENT, IUPAC

_FROM = "".join(COMPLEMENT) + "".join(COMPLEMENT).lower()
_TO = "".join(COMPLEMENT.values()) + "".join(COMPLEMENT.values()).lower()


def revcomp(seq: Column | str) -> Column:
    """Reverse complement with ambiguity codes; case and unknown letters are kept."""
    return F.reverse(F.translate(F.col(seq) if isinstance(seq, str) else seq, _FROM, _TO))


def normal(seq: Column | str) -> Column:
    """Upper case with U read as T: what exact units compare."""
    return F.translate(F.upper(seq), "U", "T")


def is_plain(seq: Column | str) -> Column:
    """True if the sequence has plain bases only."""
    return normal(seq).rlike("^[ACGT]*$")


def iupac_match(seq: Column | str, word: str) -> Column:
    """Does the sequence match the nucleotide word letter by letter, by plain bases only?"""
    return normal(seq).rlike("^" + "".join(letter_class(c) for c in word.upper()) + "$")


def letter_class(letter: str) -> str:
    """A regular expression for the plain bases of a nucleotide code."""
    bases = IUPAC[letter]
    return bases if len(bases) == 1 else f"[{bases}]"


def mismatches(seq: Column | str, word: str) -> Column:
    """Number of letters of equally long ``seq`` outside the word's codes (unknown letters count)."""
    text = normal(seq)
    return sum((F.when(F.substring(text, k + 1, 1).rlike(letter_class(c)), 0).otherwise(1) for k, c in enumerate(word.upper())), F.lit(0))


def kmers(seq: Column | str, k: int) -> Column:
    """Array of all substrings of length k, in order; empty for shorter sequences."""
    return F.regexp_extract_all(seq, F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1))


def weight_score(seq: Column | str, columns: list[list[int]], dna: bool = True, ready: bool = False) -> Column:
    """Score of equally long ``seq`` under a weight matrix, plain letters (others score 0, or the 21st weight).

    ``ready``: the sequence is in normal form already.
    """
    text = seq if ready else normal(seq) if dna else F.upper(seq)
    total = F.lit(0)
    for k, column in enumerate(columns):
        letter, score = F.substring(text, k + 1, 1), F.lit(column[20] if len(column) > 20 else 0)
        for name, weight in zip("ACGT" if dna else AMINO, column):
            score = F.when(letter == name, weight).otherwise(score)
        total = total + score
    return total


def natural_key(text: Column | str) -> Column:
    """A key that sorts digit runs as numbers: each run without leading zeros behind its length, then the text itself."""
    padded = F.regexp_replace(text, r"0*(\d+)", "\u0001$1\u0002")
    parts = F.split(padded, "\u0001")
    keyed = F.transform(parts, lambda p: F.when(p.contains("\u0002"), F.concat(F.lpad(F.length(F.substring_index(p, "\u0002", 1)).cast("string"), 10, "0"), p)).otherwise(p))
    return F.struct(F.array_join(keyed, "0").alias("k"), F.col(text).alias("t") if isinstance(text, str) else text.alias("t"))


def register(spark) -> None:  # noqa: ANN001
    """Make ``revcomp(seq)`` and ``iupac_match(seq, word)`` callable from SQL as temporary functions."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION revcomp(seq STRING) RETURNS STRING RETURN reverse(translate(seq, '{_FROM}', '{_TO}'))")
    classes = "upper(word)"
    for code, bases in IUPAC.items():
        if len(bases) > 1 or code == "U":
            classes = f"replace({classes}, '{code}', '{'[' + bases.lower() + ']' if len(bases) > 1 else 't'}')"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION iupac_match(seq STRING, word STRING) RETURNS BOOLEAN RETURN translate(upper(seq), 'U', 'T') RLIKE concat('^', upper({classes}), '$')")
