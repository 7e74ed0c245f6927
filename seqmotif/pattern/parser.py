"""Parser and validation of the motif language."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from seqmotif.pattern.units import IUPAC, WEIGHT_TOP, Unit

NAMES = 51
NUMBER = re.compile(r"-?\d+")
ERR = re.compile(r"\[(-?\d+),(-?\d+),(-?\d+)\]")


class PatternError(ValueError):
    """A pattern that can't be used, with the line where that shows."""

    def __init__(self, message: str, line: int = 1):
        super().__init__(f"failed to parse pattern: line {line}: {message}")
        self.message, self.line = message, line


@dataclass
class Pattern:
    """A parsed pattern: units in order, rule sets, comments by line."""

    units: list[Unit]
    rules: dict[int, frozenset[str]]
    alphabet: str
    text: str
    comments: list[tuple[int, str]] = field(default_factory=list)
    flat: list[Unit] = field(default_factory=list)

    @property
    def dna(self) -> bool:
        return self.alphabet == "dna"


class _Parser:
    def __init__(self, text: str, alphabet: str):
        self.dna = alphabet == "dna"
        self.comments: list[tuple[int, str]] = []
        self.lines: list[int] = []
        out: list[str] = []
        for number, line in enumerate(text.replace("\r", "").split("\n"), 1):
            code, mark, comment = line.partition("%")
            if mark:
                self.comments.append((number, comment))
            out.append(code + " ")
            self.lines += [number] * (len(code) + 1)
        self.s, self.at = "".join(out).replace("\t", " "), 0
        self.rules: dict[int, frozenset[str]] = {}
        self.names: dict[int, Unit] = {}
        self.flat: list[Unit] = []

    def line(self) -> int:
        return self.lines[min(self.at, len(self.lines) - 1)] if self.lines else 1

    def fail(self, message: str) -> PatternError:
        return PatternError(message, self.line())

    def blank(self) -> bool:
        start = self.at
        while self.at < len(self.s) and self.s[self.at] == " ":
            self.at += 1
        return self.at > start

    def done(self) -> bool:
        return self.at >= len(self.s)

    def take(self, pattern: str | re.Pattern) -> re.Match | None:
        m = re.compile(pattern).match(self.s, self.at) if isinstance(pattern, str) else pattern.match(self.s, self.at)
        if m:
            self.at = m.end()
        return m

    def rule_sets(self) -> None:
        """Rule sets in front of a unit."""
        while self.dna and (m := re.compile(r"r(\d+) *= *\{").match(self.s, self.at)):
            if int(m[1]) >= NAMES:
                raise self.fail(f"rule set r{m[1]} is out of range")
            body = re.compile(r"([acgtuACGTU]{2}(?:,[acgtuACGTU]{2})*)\}").match(self.s, m.end())
            if not body:
                raise self.fail("a rule set is a list of letter pairs without blanks")
            self.at = body.end()
            self.rules[int(m[1])] = frozenset(p.upper().replace("U", "T") for p in body[1].split(","))
            self.blank()

    def pattern(self) -> list[Unit]:
        units: list[Unit] = []
        self.blank()
        while not self.done():
            units += self.element()
            if not self.blank() and not self.done():
                raise self.fail(f"unexpected text `{self.s[self.at : self.at + 20].strip()}`")
        return units

    def element(self) -> list[Unit]:
        self.rule_sets()
        if self.s.startswith("(", self.at):
            return [self.either()]
        return [self.unit()]

    def either(self) -> Unit:
        unit = Unit("either", line=self.line(), offset=self.at)
        start = self.at
        self.at += 1
        first = self.branch("|")
        second = self.branch(")")
        unit.branches, unit.text = (first, second), self.s[start : self.at]
        return unit

    def branch(self, end: str) -> list[Unit]:
        units: list[Unit] = []
        self.blank()
        while not self.s.startswith(end, self.at):
            if self.done() or self.s[self.at] in "|)":
                raise self.fail("an alternative is `( units | units )`")
            units += self.element()
            if not self.blank() and not self.s.startswith(end, self.at):
                raise self.fail(f"unexpected text `{self.s[self.at : self.at + 20].strip()}`")
        self.at += 1
        if not units:
            raise self.fail("a branch of an alternative is empty")
        return units

    def unit(self) -> Unit:
        self.rule_sets()
        start, line, name = self.at, self.line(), None
        if m := self.take(r"p(\d+) *= *"):
            name = int(m[1])
            if name >= NAMES:
                raise self.fail(f"name p{name} is out of range")
            if name in self.names:
                raise self.fail(f"name p{name} is defined twice")
            self.rule_sets()
            if self.s.startswith("(", self.at):
                raise self.fail("an alternative can't be named")
        unit = self.body(name)
        unit.line, unit.offset, unit.name, unit.text = line, start, name, self.s[start : self.at]
        unit.index = len(self.flat)
        self.flat.append(unit)
        if name is not None:
            self.names[name] = unit
        return unit

    def error(self) -> tuple[int, int, int]:
        if m := self.take(ERR):
            err = tuple(int(x) for x in m.groups())
            if min(err) < 0:
                raise self.fail("counts of mismatches, deletions and insertions can't be negative")
            return err  # type: ignore[return-value]
        return 0, 0, 0

    def known(self, ref: int, own: int | None) -> int:
        if ref == own:
            raise self.fail(f"name p{ref} refers to itself")
        if ref not in self.names:
            raise self.fail(f"name p{ref} is not defined before it is used")
        return ref

    def body(self, own: int | None) -> Unit:
        if self.take(r"\^"):
            return Unit("start")
        if self.take(r"\$"):
            return Unit("end")
        if m := self.take(r"(-?\d+) *\.\.\. *(-?\d+)"):
            low, high = int(m[1]), int(m[2])
            if low < 0 or high < 0:
                raise self.fail("a range can't be negative")
            return Unit("range", low=low, high=high)
        if not self.dna and (m := self.take(r"(not)?any\(([A-Za-z]+)\)")):
            return Unit("set", letters=m[2].upper(), negated=bool(m[1]))
        if m := self.take(r"length\((p\d+(?: *\+ *p\d+)*) *\) *< *(-?\d+)"):
            refs = [self.known(int(x), own) for x in re.findall(r"\d+", m[1])]
            return Unit("limit", refs=refs, high=int(m[2]))
        if m := self.take(r"<p(\d+)"):
            return Unit("reverse", ref=self.known(int(m[1]), own), err=self.error() if self.dna else (0, 0, 0))
        if m := self.take(r"p(\d+)"):
            return Unit("repeat", ref=self.known(int(m[1]), own), err=self.error())
        if self.dna and (m := self.take(r"(?:r(\d+))?~p(\d+)")):
            rule = int(m[1]) if m[1] else None
            if rule is not None and rule not in self.rules:
                raise self.fail(f"rule set r{rule} is not defined before it is used")
            unit = Unit("complement", ref=self.known(int(m[2]), own), rule=rule, err=self.error())
            if rule is not None:
                unit.letters = ",".join(sorted(self.rules[rule]))
            return unit
        if m := self.take(r"(?:(-?\d+) *> *)?\{ *"):
            return self.weights(m[1])
        if m := self.take(r"[^ \[)|]+" if self.dna else r"[A-Za-z]+"):
            letters = m[0].upper()
            if self.dna and (bad := set(letters) - set(IUPAC)):
                raise self.fail(f"`{m[0]}` is no unit: {sorted(bad)[0]!r} is no nucleotide code")
            return Unit("word", letters=letters.replace("U", "T") if self.dna else letters, err=self.error())
        raise self.fail(f"no unit begins with `{self.s[self.at : self.at + 12].strip()}`")

    def weights(self, top: str | None) -> Unit:
        columns: list[list[int]] = []
        while True:
            m = self.take(r" *\( *(-?\d+(?: *, *-?\d+)*) *\) *")
            if not m:
                raise self.fail("a weight column is `(number,...)`")
            columns.append([int(x) for x in m[1].split(",")])
            if self.take(r", *"):
                continue
            if not self.take(r"\} *> *"):
                raise self.fail("a weight unit ends with `} > number`")
            break
        low = self.take(NUMBER)
        if not low:
            raise self.fail("a weight unit ends with `} > number`")
        sizes = {len(c) for c in columns}
        if len(sizes) > 1 or not sizes <= ({4} if self.dna else {20, 21}):
            raise self.fail("weight columns have 4 numbers (nucleotides), or 20 or 21 (protein)")
        return Unit("weight", columns=columns, low=int(low[0]), high=WEIGHT_TOP if top is None else int(top))


def lengths(units: list[Unit], named: dict[int, tuple[int, int]] | None = None) -> tuple[int, int]:
    """(shortest, longest) match of units in a row."""
    named = {} if named is None else named
    low = high = 0
    for u in units:
        if u.kind == "word":
            a, b = max(0, len(u.letters) - u.err[1]), len(u.letters) + u.err[2]
        elif u.kind == "range":
            a, b = u.low, max(u.low, u.high)
        elif u.kind in ("repeat", "complement", "reverse"):
            a, b = named.get(u.ref, (0, 0))
            a, b = max(0, a - u.err[1]), b + u.err[2]
        elif u.kind == "weight":
            a = b = len(u.columns)
        elif u.kind == "set":
            a = b = 1
        elif u.kind == "either":
            pair = [lengths(x, named) for x in u.branches]
            a, b = min(p[0] for p in pair), max(p[1] for p in pair)
        else:
            a = b = 0
        if u.name is not None:
            named[u.name] = (a, b)
        low, high = low + a, high + b
    return low, high


def uncertain(units: list[Unit], sure: set[int] | None = None) -> list[Unit]:
    """Units that read a name which an earlier unit need not have set, as only one branch of an alternative does."""
    sure = set() if sure is None else sure
    found = []
    for u in units:
        if any(r not in sure for r in ([u.ref] if u.ref is not None else []) + u.refs):
            found.append(u)
        if u.kind == "either":
            sides = [set(sure), set(sure)]
            for branch, side in zip(u.branches, sides):
                found += uncertain(branch, side)
            sure |= sides[0] & sides[1]
        if u.name is not None:
            sure.add(u.name)
    return found


def parse(text: str, alphabet: str = "dna", check: bool = True) -> Pattern:
    """Parse a pattern; ``alphabet`` is dna (RNA too) or protein.

    Raises PatternError for what can't be read, for names or rule sets that are
    undefined, defined twice or read where they may not be set, and for
    patterns whose longest match is empty.
    """
    if alphabet not in ("dna", "protein"):
        raise ValueError("alphabet is dna or protein")
    p = _Parser(text, alphabet)
    units = p.pattern()
    if not units:
        raise PatternError("the pattern is empty")
    if lengths(units)[1] == 0:
        raise PatternError("the longest possible match has 0 letters")
    if check and (early := uncertain(units)):
        raise PatternError(f"`{early[0].text}` reads a name that may not be set", early[0].line)
    return Pattern(units, p.rules, alphabet, text, p.comments, p.flat)
