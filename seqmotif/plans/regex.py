"""Patterns as one ordered-backtracking regular expression, run natively.

Java's engine makes the same choices in the same order as the pattern language
for words, gaps (lazy), captures, exact repeats, sets, inner alternatives and
anchors, and its find() goes on behind the last match, as the chain of hits does.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seqmotif.functions import letter_class, normal
from seqmotif.pattern.parser import Pattern, lengths
from seqmotif.pattern.units import Unit

ANY = r"[\s\S]"


class NotRegular(ValueError):
    """The pattern has a unit that a regular expression can't state exactly."""


def to_regex(pattern: Pattern, plain: bool = False, strict_n: bool = False, shift: int = 0) -> str:
    """The pattern as a regular expression with one group per unit, or NotRegular.

    Repeats are exact by back reference only where captured letters are plain
    bases: on data known to be ``plain``, or with ``strict_n``, where other
    captured letters never match again. ``shift`` is the number of groups in front.
    """
    first = pattern.units[0]
    if not first.slides and first.kind != "start":
        raise NotRegular("the first unit does not slide")
    if lengths(pattern.units)[0] == 0:
        raise NotRegular("hits may be empty")
    group = {u.name: u.index + 1 for u in pattern.flat if u.name is not None}
    again = {u.ref for u in pattern.flat if u.kind == "repeat"}

    def one(u: Unit) -> str:
        if u.kind == "either":
            return "(?:" + "|".join("".join(map(one, b)) for b in u.branches) + ")"
        if u.kind == "word" and u.exact:
            body = "".join(letter_class(c) for c in u.letters) if pattern.dna else u.letters.replace("X", ANY)
        elif u.kind == "range":
            letter = "[ACGT]" if u.name in again and pattern.dna else ANY
            body = f"{letter}{{{u.low},{max(u.low, u.high)}}}?"
        elif u.kind == "repeat" and u.exact and pattern.dna and (plain or strict_n):
            body = f"(?:\\{group[u.ref] + shift})"
        elif u.kind == "set":
            body = f"[A-Z&&[^{u.letters}]]" if u.negated else f"[{u.letters}]"
        elif u.kind == "start":
            body = "\\A"
        elif u.kind == "end":
            body = "\\z"
        else:
            raise NotRegular(f"`{u.text}` has no regular expression")
        return f"({body})"

    if strict_n and not plain and any(u.kind not in ("range", "word") for u in pattern.flat if u.name in again):
        raise NotRegular("a captured unit may hold letters that are not plain")
    return "".join(map(one, pattern.units))


#: Signs that mark what was found: the end of skipped text, of a unit, of a hit. In sequences they are unknown letters.
SKIP, UNIT, HIT = "\x01", "\x02", "\x03"


def hits(pattern: Pattern, seq: Column, plain: bool = False, strict_n: bool = False) -> Column:
    """array<struct<start,end,sizes>> of the chained hits in ``seq``, 1-based and closed; sizes are the lengths of the units' pieces.

    One pass marks all hits and their units in the text; what stands between the marks gives lengths and places.
    """
    data = F.translate(normal(seq) if pattern.dna else F.upper(seq), SKIP + UNIT + HIT, "???")
    whole = F.lit(f"(?s)\\G(.*?){to_regex(pattern, plain, strict_n, 1)}")
    groups = "".join(f"${u.index + 2}{UNIT}" for u in pattern.flat)
    marked = F.split(F.regexp_replace(data, whole, F.lit(f"$1{SKIP}{groups}{HIT}")), HIT)
    found = F.slice(marked, 1, F.size(marked) - 1)
    if pattern.units[0].kind == "start":
        found = F.slice(found, 1, 1)

    def measured(x: Column) -> Column:
        parts = F.split(x, SKIP)
        sizes = F.slice(F.transform(F.split(parts[1], UNIT), F.length), 1, len(pattern.flat))
        return F.struct(F.length(parts[0]).alias("skip"), sizes.alias("sizes"), (F.length(parts[1]) - len(pattern.flat)).alias("size"))

    kind = "struct<past:int,out:array<struct<start:int,end:int,sizes:array<int>>>>"
    start = F.struct(F.lit(0).alias("past"), F.array().alias("out")).cast(kind)

    def step(acc: Column, x: Column) -> Column:
        first = acc["past"] + x["skip"]
        end = first + x["size"]
        return F.struct(end.alias("past"), F.concat(acc["out"], F.array(F.struct((first + 1).alias("start"), end.alias("end"), x["sizes"].alias("sizes")))).alias("out")).cast(kind)

    return F.aggregate(F.transform(found, measured), start, step, lambda acc: acc["out"])
