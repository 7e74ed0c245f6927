"""Units of a pattern, letters and their base sets."""

from __future__ import annotations

from dataclasses import dataclass, field

#: The nucleotide ambiguity codes (IUPAC-IUB) as sets of bases.
IUPAC = {
    "A": "A", "C": "C", "G": "G", "T": "T", "U": "T",
    "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC",
    "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT",
}
#: Complements of those codes.
COMPLEMENT = {"A": "T", "C": "G", "G": "C", "T": "A", "U": "A", "R": "Y", "Y": "R", "S": "S", "W": "W", "K": "M", "M": "K", "B": "V", "V": "B", "D": "H", "H": "D", "N": "N"}
#: The order of weights in a protein column; a 21st weight is for any other letter.
AMINO = "ACDEFGHIKLMNPQRSTVWY"
BIT = {"A": 1, "C": 2, "G": 4, "T": 8}
#: Default upper bound of a weight unit.
WEIGHT_TOP = 1_000_000


def base_mask(letter: str) -> int:
    """The set of bases of a letter as bits; 0 if it is no nucleotide code."""
    return sum(BIT[b] for b in IUPAC.get(letter.upper(), ""))


def reverse_complement(seq: str) -> str:
    """Reverse complement with ambiguity codes; case and unknown letters are kept."""
    table = {ord(a): b for a, b in COMPLEMENT.items()} | {ord(a.lower()): b.lower() for a, b in COMPLEMENT.items()}
    return seq.translate(table)[::-1]


@dataclass
class Unit:
    """One unit.

    kind: word, range, repeat, complement, reverse, weight, set, limit, start,
    end or either. ``err`` is (mismatches, deletions, insertions).
    """

    kind: str
    index: int = 0
    line: int = 1
    offset: int = 0
    name: int | None = None
    letters: str = ""
    err: tuple[int, int, int] = (0, 0, 0)
    low: int = 0
    high: int = 0
    ref: int | None = None
    rule: int | None = None
    columns: list[list[int]] = field(default_factory=list)
    refs: list[int] = field(default_factory=list)
    negated: bool = False
    branches: tuple[list[Unit], list[Unit]] | None = None
    text: str = ""

    @property
    def exact(self) -> bool:
        return self.err == (0, 0, 0)

    @property
    def slides(self) -> bool:
        """Is this unit tried at every position when it comes first?"""
        return self.kind in ("word", "range", "weight", "set")
