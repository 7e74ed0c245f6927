"""Patterns over many records at once, unit by unit on arrays of start positions.

The records of a batch are one array of letter codes. The search is depth first
like the pattern language's own order of choice, but each step is taken for all starts
that are still open: a unit keeps those where it matches, a choice (a length of a
range, a branch) is tried for those that no earlier choice has settled. Work is
proportional to the letters and to how many starts survive, in compiled loops.

A wide range isn't tried length by length. What stands behind it is looked up: the
letters that repeats share across the gap are a key, the places behind the gap are
sorted by (key, place), and the first place in reach with the start's key is
found by binary search; what the key can't tell (mismatches, pairing rules) is checked
candidate by candidate. Of a repeat with m mismatches one of m + 1 blocks is exact,
so each block is a key in turn.

Units with deletions or insertions run the alignment's state machine for all starts
in step.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import prod

import numpy as np

from seqmotif.operators.kernel import FLIP, MASKS
from seqmotif.pattern.parser import Pattern, lengths
from seqmotif.pattern.units import AMINO, BIT, COMPLEMENT, Unit, base_mask

#: A range with more lengths is looked up; more combinations of the other choices than ROUTES are too many.
WIDE, ROUTES = 48, 5000
#: Letters of a key: two bits each in a 64-bit number.
KEY = 31
#: Alignments that are searched in one go.
ROWS = 1 << 15
#: Slots of the table that tells which keys occur on the other side.
SLOTS = 1 << 20
#: A repeat across a wide gap of so many letters needs a partner in its record for as many of its letters as the second number.
SHORT = (5, 8)
#: Odd numbers that spread keys and records over the slots.
SPREAD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)

_COMPLEMENT = np.arange(256, dtype=np.uint8)
for _a, _b in COMPLEMENT.items():
    _COMPLEMENT[ord(_a)], _COMPLEMENT[ord(_a.lower())] = ord(_b), ord(_b.lower())
_UPPER = np.array([ord(chr(c).upper()) if c < 128 else c for c in range(256)], np.uint8)
_PLAIN = np.array([c if c in (1, 2, 4, 8) else 0 for c in range(256)], np.uint8)
_TWO = np.array([{2: 1, 4: 2, 8: 3}.get(c, 0) for c in range(256)], np.uint8)
_FLIP = np.array([FLIP.get(c, 0) for c in range(256)], np.uint8)

Step = tuple[Unit, int, int]  # unit, offset, length


def wide(u: Unit) -> bool:
    return u.kind == "range" and u.high - u.low >= WIDE


def choices(units: list[Unit]) -> int:
    """How many combinations of narrow choices the units have."""
    return prod(sum(choices(b) for b in u.branches) if u.kind == "either" else max(1, u.high - u.low + 1) if u.kind == "range" and not wide(u) else 1 for u in units)


def supported(pattern: Pattern, align: bool = False) -> bool:
    """Can the pattern be searched this way? Not with a first alternative, empty hits, two wide gaps, or a unit behind a wide gap that has deletions or insertions.

    With ``align``, complements may have two insertions at most.
    """
    first = pattern.units[0]
    gaps = [u for u in pattern.flat if wide(u)]
    if not (first.slides or first.kind == "start") or lengths(pattern.units)[0] == 0 or len(gaps) > 1 or choices(pattern.units) > ROUTES:
        return False
    if align and any(u.kind == "complement" and (u.err[2] > 2 or u.err[0] > 100) for u in pattern.flat):
        return False
    if gaps:
        if gaps[0] not in pattern.units or gaps[0].name is not None and any(gaps[0].name in (u.ref, *u.refs) for u in pattern.flat):
            return False
        behind = pattern.flat[pattern.flat.index(gaps[0]) + 1 :]
        if any(u.err[1] or u.err[2] or u.kind == "start" for u in behind):
            return False
        before = {u.name for u in pattern.flat[: pattern.flat.index(gaps[0])] if u.name is not None}
        return pattern.dna or not any(u.ref in before for u in behind)
    return True


class Letters:
    """Records in a row: raw letters, codes, and where each record begins and ends."""

    def __init__(self, raw: np.ndarray, bounds: np.ndarray, dna: bool, pad: int):
        self.raw, self.bounds, self.dna, self.n = raw, bounds, dna, len(raw)
        codes = (MASKS if dna else _UPPER)[raw]
        self.codes = np.concatenate([codes, np.zeros(pad + 1, np.uint8)])
        self.plain = _PLAIN[self.codes] if dna else self.codes
        sizes = np.diff(bounds)
        self.room = np.repeat(bounds[1:], sizes).astype(np.int32) - np.arange(self.n, dtype=np.int32)
        self._odd: np.ndarray | None = None
        self._salt: np.ndarray | None = None
        self._partners: dict[tuple[int, bool], np.ndarray] = {}
        self._runs: dict[tuple[int, bool], np.ndarray] = {}

    def reversed(self, pad: int) -> Letters:
        """The reverse strands, records in reverse order."""
        return Letters(_COMPLEMENT[self.raw[::-1]], self.n - self.bounds[::-1], self.dna, pad)

    @property
    def odd(self) -> np.ndarray:
        """How many letters that are not plain stand before each place."""
        if self._odd is None:
            self._odd = np.concatenate([[0], np.cumsum(self.plain == 0, dtype=np.int32)])
        return self._odd

    @property
    def fine(self) -> bool:
        """Are all letters plain?"""
        return self.odd[self.n] == 0

    @property
    def salt(self) -> np.ndarray:
        """At each place and the one behind the last a number of its record."""
        if self._salt is None:
            numbers = np.arange(len(self.bounds), dtype=np.uint64) * SPREAD[1]
            self._salt = np.append(np.repeat(numbers[:-1], np.diff(self.bounds)), numbers[-1:])
        return self._salt

    def slots(self, keys: np.ndarray, salt: np.ndarray) -> np.ndarray:
        """Numbers below SLOTS of keys in their records."""
        return ((keys.view(np.uint64) + salt) * SPREAD[0] >> np.uint64(65 - SLOTS.bit_length())).view(np.int64)

    def partners(self, n: int, flip: bool) -> np.ndarray:
        """Places whose next n letters, if plain, occur elsewhere in the record (reversed and complemented with ``flip``), and a few others."""
        if (n, flip) not in self._partners:
            own, other = np.zeros(self.n, np.int64), np.zeros(self.n, np.int64)
            for at, size_ in parts(n):
                own = (own << (2 * size_)) + self.runs(size_, False)[at : at + self.n]
                if flip:
                    other = (other << (2 * size_)) + self.runs(size_, True)[n - at - size_ : n - at - size_ + self.n]
            own, often = self.slots(own, self.salt[:-1]), np.zeros(SLOTS, bool)
            if flip:
                often[self.slots(other, self.salt[:-1])] = True
            else:
                last, places = np.zeros(SLOTS, np.int32), np.arange(self.n, dtype=np.int32)
                last[own] = places
                often[own[last[own] != places]] = True
            self._partners[n, flip] = often[own]
        return self._partners[n, flip]

    def runs(self, n: int, flip: bool) -> np.ndarray:
        """At each place the next n letters as a number, two bits each; reversed and complemented with ``flip``. n is a power of two, 16 at most."""
        if (n, flip) not in self._runs:
            if n == 1:
                two = _TWO[self.plain].astype(np.uint32)
                self._runs[n, flip] = 3 - two if flip else two
            else:
                half = self.runs(n // 2, flip)
                ahead = np.concatenate([half[n // 2 :], np.zeros(n // 2, np.uint32)])
                self._runs[n, flip] = (ahead << np.uint32(n)) + half if flip else (half << np.uint32(n)) + ahead
        return self._runs[n, flip]

    def at(self, array: np.ndarray, places: np.ndarray, offset: int) -> np.ndarray:
        """array[places + offset]; a slice if the places are all of them."""
        return array[offset : offset + self.n] if len(places) == self.n else array[places + offset]

    def accept(self, wanted: np.ndarray | int, found: np.ndarray) -> np.ndarray:
        """Does a wanted letter (a set of bases) take a found one?"""
        return (wanted & found) != 0 if self.dna else (wanted == found) | (np.asarray(wanted) == 88)


@dataclass
class Hits:
    """First hits of starts (or all hits), by start and order of choice: places in the row of records, and how the units were met."""

    start: np.ndarray
    end: np.ndarray
    route: np.ndarray
    gap: np.ndarray
    routes: list[list[tuple[int, int | None]]]

    def take(self, rows: np.ndarray) -> Hits:
        return Hits(self.start[rows], self.end[rows], self.route[rows], self.gap[rows], self.routes)


class Search:
    """One pattern over one row of records."""

    def __init__(self, pattern: Pattern, data: Letters, strict_n: bool = False, overlaps: bool = False, align: bool = False):
        self.pattern, self.data, self.strict, self.overlaps, self.align = pattern, data, strict_n and pattern.dna, overlaps, align
        self.done = np.zeros(data.n, bool)
        self.found: list[tuple[np.ndarray, np.ndarray, int, np.ndarray]] = []
        self.routes: list[list[tuple[int, int | None]]] = []

    def hits(self) -> Hits:
        data = self.data
        if self.pattern.units[0].kind == "start":
            places = np.unique(data.bounds[:-1][np.diff(data.bounds) > 0]).astype(np.int32)
        else:
            places = np.arange(data.n, dtype=np.int32)
        self.follow(self.pattern.units, places, 0, [], {})
        if not self.found:
            empty = np.zeros(0, np.int64)
            return Hits(empty, empty, empty, empty, self.routes)
        start, end, gap = (np.concatenate([f[k] for f in self.found]).astype(np.int64) for k in (0, 1, 3))
        route = np.repeat([f[2] for f in self.found], [len(f[0]) for f in self.found])
        order = np.lexsort((gap, route, start)) if self.overlaps else np.argsort(start, kind="stable")
        return Hits(start, end, route, gap, self.routes).take(order)

    def keep(self, places: np.ndarray, ends: np.ndarray, route: list[tuple[int, int | None]], gap: np.ndarray) -> None:
        if len(places):
            self.found.append((places, ends, len(self.routes), gap))
            self.routes.append(route)
            self.done[places] = True

    def open(self, places: np.ndarray) -> np.ndarray:
        return places if self.overlaps or not self.found else places[~self.done[places]]

    def follow(self, units: list[Unit], places: np.ndarray, offset: int, route: list[tuple[int, int | None]], names: dict[int, tuple[int, int]]) -> None:
        """All ways to match the units behind ``offset`` letters, for the starts ``places``."""
        if not len(places):
            return
        if not units:
            self.keep(places, places + offset, route, np.zeros(len(places), np.int64))
            return
        u, rest = units[0], units[1:]
        if u.kind == "either":
            for branch in u.branches:  # type: ignore[union-attr]
                self.follow([*branch, *rest], self.open(places), offset, route, names)
        elif wide(u):
            self.across(u, rest, places, offset, route, names)
        else:
            for length, here in self.met(u, places, offset, names):
                now = names if u.name is None else {**names, u.name: (offset, length)}
                self.follow(rest, here, offset + length, [*route, (u.index, length)], now)

    def met(self, u: Unit, places: np.ndarray, offset: int, names: dict[int, tuple[int, int]]) -> Iterator[tuple[int, np.ndarray]]:
        """(length, starts) of the unit's matches, in the order of choice."""
        if u.kind == "range":
            for length in range(u.low, max(u.low, u.high) + 1):
                places = self.open(places)
                places = places[self.data.at(self.data.room, places, 0) >= offset + length]
                if not len(places):
                    return
                yield length, places
        elif u.err[1] or u.err[2]:
            yield from self.aligned(u, places, offset, names)
        else:
            length = size(u, names)
            places = places[self.data.at(self.data.room, places, 0) >= offset + length]
            yield length, self.fixed(u, places, offset, length, names)

    def fixed(self, u: Unit, places: np.ndarray, offset: int, length: int, names: dict[int, tuple[int, int]]) -> np.ndarray:
        """Starts where a unit of known length matches."""
        data = self.data
        if u.kind == "word":
            return self.compared(places, offset, [data_letter(c, data.dna) for c in u.letters], u.err[0])
        if u.kind in ("repeat", "reverse", "complement"):
            if not length:
                return places
            first, _ = names[u.ref]  # type: ignore[index]
            return self.paired(u, places, offset, length, first)
        if u.kind == "weight":
            total = sum((weights(column, data.dna)[data.at(data.codes, places, offset + k)] for k, column in enumerate(u.columns)), np.zeros(len(places), np.int64))
            return places[(total > u.low) & (total < u.high)]
        if u.kind == "set":
            table = np.zeros(256, bool)
            table[65:91] = [(chr(c) in u.letters) != u.negated for c in range(65, 91)]
            return places[table[data.at(data.codes, places, offset)]]
        if u.kind == "limit":
            return places if sum(names[r][1] for r in u.refs) < u.high else places[:0]
        if u.kind == "end":
            return places[data.room[places] == offset]
        return places if offset == 0 else places[:0]

    def compared(self, places: np.ndarray, offset: int, letters: list[int], budget: int) -> np.ndarray:
        """Starts where the letters stand at the offset but for ``budget`` of them; other letters must be plain too."""
        data = self.data
        if not budget:
            for k, letter in enumerate(letters):
                places = places[data.accept(letter, data.at(data.plain, places, offset + k))]
            return places
        missed = np.zeros(len(places), np.uint8)
        for k, letter in enumerate(letters):
            found = data.at(data.plain, places, offset + k)
            missed = missed + ~data.accept(letter, found)
            if data.dna:
                missed[found == 0] = 255 - len(letters)
            near = missed <= budget
            if 2 * np.count_nonzero(near) < len(places):
                places, missed = places[near], missed[near]
        return places[missed <= budget]

    def wanted(self, u: Unit, letters: np.ndarray) -> np.ndarray:
        """What each captured letter accepts where the unit repeats it; 0 for nothing."""
        if u.kind != "complement":
            return _PLAIN[letters] if self.strict else letters
        if u.rule is None:
            return _FLIP[letters]
        table = np.zeros(256, np.uint8)
        for pair in u.letters.split(","):
            table[BIT[pair[0]]] |= BIT[pair[1]]
        return table[letters]

    def paired(self, u: Unit, places: np.ndarray, offset: int, length: int, first: int) -> np.ndarray:
        """Starts where the capture at ``first`` is repeated at ``offset``."""
        data, (budget, *_) = self.data, u.err
        if u.kind == "complement":
            places = places[data.odd[places + (first + length)] == data.odd[places + first]]
        if budget and data.dna:
            places = places[data.odd[places + (offset + length)] == data.odd[places + offset]]
        missed = np.zeros(len(places), np.uint8)
        for k in range(length):
            own = first + (k if u.kind == "repeat" else length - 1 - k)
            same = data.accept(self.wanted(u, data.at(data.codes, places, own)), data.at(data.plain, places, offset + k))
            if not budget:
                places = places[same]
                continue
            missed = missed + ~same
            near = missed <= budget
            if 2 * np.count_nonzero(near) < len(places):
                places, missed = places[near], missed[near]
        return places[missed <= budget] if budget else places

    def aligned(self, u: Unit, places: np.ndarray, offset: int, names: dict[int, tuple[int, int]]) -> Iterator[tuple[int, np.ndarray]]:
        """(length, starts) of units with deletions or insertions: every start has the length of its first alignment, or none.

        With ``align`` a complement has all other lengths behind the first, shorter ones before longer.
        """
        data, length = self.data, size(u, names)
        every = self.align and u.kind == "complement"
        first = 0
        if u.kind == "word":
            room = data.room[places]
            places = places[(room >= offset) & (room >= offset + length - u.err[1])]
        else:
            if not length and u.kind != "complement":
                yield 0, places
                return
            first, _ = names[u.ref]  # type: ignore[index]
            if u.kind == "complement":
                places = places[data.odd[places + (first + length)] == data.odd[places + first]]
        for part in range(0, len(places), ROWS):
            some = places[part : part + ROWS]
            if u.kind == "word":
                columns = [np.full(len(some), data_letter(c, data.dna), np.uint8) for c in u.letters]
            else:
                columns = [self.wanted(u, data.codes[some + (first + (k if u.kind == "repeat" else length - 1 - k))]) for k in range(length)]
            ends = data.room[some] - offset  # letters from the unit on
            lanes = Lanes(data, columns, some + offset, ends, u.err)
            used = lanes.first()
            for consumed in np.unique(used[used >= 0]).tolist():
                yield consumed, some[used == consumed]
            for consumed, fits in lanes.lengths() if every else ():
                yield consumed, self.open(some[fits & (used != consumed)])

    def across(self, u: Unit, rest: list[Unit], places: np.ndarray, offset: int, route: list[tuple[int, int | None]], names: dict[int, tuple[int, int]]) -> None:
        """The units behind a wide gap, at the first place in reach where they match."""
        places = self.open(places)
        best = np.full(len(places), np.iinfo(np.int64).max)
        way = np.zeros(len(places), np.int64)
        ways = list(routes(rest, 0, [], {n: k for n, (_, k) in names.items()}))
        for number, steps in enumerate(ways):
            nearest = self.nearest(places, offset, u, steps, names)
            closer = nearest < best
            if self.overlaps:
                raise ValueError("overlapping hits of a wide gap aren't looked up")
            best[closer], way[closer] = nearest[closer], number
        for number, steps in enumerate(ways):
            mine = (way == number) & (best < np.iinfo(np.int64).max)
            total = sum(n for _, _, n in steps)
            gap = best[mine] - places[mine] - offset
            self.keep(places[mine], best[mine] + total, [*route, (u.index, None), *((s.index, n) for s, _, n in steps)], gap)

    def nearest(self, places: np.ndarray, offset: int, u: Unit, steps: list[Step], names: dict[int, tuple[int, int]]) -> np.ndarray:
        """For each start the first place behind the gap where the steps match, or the greatest number."""
        data, total, far = self.data, sum(n for _, _, n in steps), np.iinfo(np.int64).max
        own = {s.name for s, _, _ in steps if s.name is not None}
        links = [(s, at, n, names[s.ref][0]) for s, at, n in steps if n and s.ref is not None and s.ref in names and s.ref not in own]  # unit, offset behind the gap, length, offset of the capture
        out = np.full(len(places), far)
        open_ = np.ones(len(places), bool)
        firm = [x for x in links if x[0].exact and x[0].rule is None and x[0].kind in ("repeat", "complement") and x[2] >= SHORT[0]] if data.dna else []
        for s, _, n, first in firm:
            open_ &= data.partners(min(n, SHORT[1]), s.kind == "complement")[places + first]
        open_ &= data.room[places] >= offset + u.low + total
        if not data.fine:
            for s, _, n, first in links:
                if s.kind != "complement":
                    open_ |= data.odd[places + (first + n)] != data.odd[places + first]
        chosen = np.flatnonzero(open_)
        out[chosen] = self.nearest_of(places[chosen], offset, u, steps, names, links, firm)
        return out

    def behind(self, steps: list[Step], names: dict[int, tuple[int, int]], links: list[tuple[Unit, int, int, int]], firm: list[tuple[Unit, int, int, int]]) -> np.ndarray:
        """Places behind the gap where all steps but the ``links`` match; ``firm`` links have a partner there."""
        data, total = self.data, sum(n for _, _, n in steps)
        behind = np.arange(data.n, dtype=np.int32) if total else np.arange(data.n + 1, dtype=np.int32)
        if total:
            behind = np.flatnonzero(data.room >= total).astype(np.int32)
        for s, at, n, _ in firm:
            short = min(n, SHORT[1])
            behind = behind[data.partners(short, s.kind == "complement")[behind + (at + n - short if s.kind == "complement" else at)]]
        linked = {id(s) for s, *_ in links}
        own: dict[int, tuple[int, int]] = {}
        for s, at, n in steps:
            if s.kind == "limit":
                if sum((own.get(r) or names[r])[1] for r in s.refs) >= s.high:
                    behind = behind[:0]
            elif s.kind == "end":
                ends = np.zeros(data.n + 1, bool)
                ends[data.bounds[1:]] = True
                behind = behind[ends[behind + at]]
            elif s.kind != "range" and id(s) not in linked and not (s.ref is not None and s.ref in names and s.ref not in own):
                behind = self.fixed(s, behind, at, n, own)
            if s.name is not None:
                own[s.name] = (at, n)
        return behind

    def nearest_of(self, places: np.ndarray, offset: int, u: Unit, steps: list[Step], names: dict[int, tuple[int, int]], links: list[tuple[Unit, int, int, int]], firm: list[tuple[Unit, int, int, int]]) -> np.ndarray:
        """The same of starts with partners for the ``firm`` links, or with letters that stand for several."""
        data, total, far = self.data, sum(n for _, _, n in steps), np.iinfo(np.int64).max
        behind = self.behind(steps, names, links, firm) if len(places) else places
        if not len(places) or data.fine and not len(behind):
            return np.full(len(places), far)
        low = places.astype(np.int64) + (offset + u.low)
        high = np.minimum(places.astype(np.int64) + (offset + u.high), places.astype(np.int64) + data.room[places] - total)
        for s, _, n, first in links:
            if s.kind == "complement":
                high[data.odd[places + (first + n)] != data.odd[places + first]] = -1
        exact = [pair for s, at, n, first in links if s.exact and s.rule is None for pair in pairs(s, at, n, first)]
        loose = [x for x in links if not (x[0].exact and x[0].rule is None)]
        vague = np.zeros(len(places), bool)  # captures that hold letters which stand for several
        for s, _, n, first in links:
            if s.kind != "complement":
                vague |= data.odd[places + (first + n)] != data.odd[places + first]
        if self.strict and any(x[0].exact for x in links):
            for s, _, n, first in links:
                if s.exact and s.kind != "complement":
                    high[data.odd[places + (first + n)] != data.odd[places + first]] = -1
            vague[high < low] = False
        seeds = [exact]
        near = [x for x in loose if x[0].rule is None and x[2] > x[0].err[0]]
        if near and len(exact) < KEY:
            s, at, n, first = max(near, key=lambda x: x[2] / (x[0].err[0] + 1))
            cuts = np.linspace(0, n, s.err[0] + 2).astype(int)
            every = pairs(s, at, n, first)
            seeds = [[*exact, *every[a:b]] for a, b in zip(cuts[:-1], cuts[1:])]
        out = np.full(len(places), far)
        asked = np.flatnonzero((high >= low) & ~vague)
        for seed in seeds if len(behind) else []:
            residual = len(seed) > KEY or bool(loose)
            reach = np.minimum(high[asked], out[asked] - 1)
            found = self.lookup(places[asked], low[asked], reach, behind, seed[:KEY], links if residual else [])
            out[asked] = np.minimum(out[asked], found)
        unsure = np.flatnonzero(vague & (high >= low)).tolist()
        behind = self.behind(steps, names, links, []) if unsure and firm else behind
        for k in unsure:
            some = behind[np.searchsorted(behind, low[k]) : np.searchsorted(behind, high[k], side="right")]
            ok = self.linked(np.full(len(some), places[k]), some, links)
            if ok.any():
                out[k] = some[int(ok.argmax())]
        return out

    def key(self, places: np.ndarray, letters: list[tuple[int, bool]]) -> np.ndarray:
        """The letters at some offsets (complemented or not) as one number, and -1 where one of them isn't plain."""
        data = self.data
        number, fine = np.zeros(len(places), np.int64), np.ones(len(places), bool)
        k = 0
        while k < len(letters):
            offset, flip = letters[k]
            n = 1
            while k + n < len(letters) and letters[k + n] == (offset + (-n if flip else n), flip):
                n += 1
            first = offset - n + 1 if flip else offset
            if not data.fine:
                fine &= data.at(data.odd, places, first + n) == data.at(data.odd, places, first)
            for at, size_ in parts(n):
                at = n - at - size_ if flip else at
                number = (number << (2 * size_)) + data.at(data.runs(size_, flip), places, first + at)
            k += n
        if not data.fine:
            number[~fine] = -1
        return number

    def lookup(self, places: np.ndarray, low: np.ndarray, high: np.ndarray, behind: np.ndarray, seed: list[tuple[int, int, bool]], links: list[tuple[Unit, int, int, int]]) -> np.ndarray:
        """For each start the first of ``behind`` within [low, high] that shares the seed and passes the links."""
        out = np.full(len(places), np.iinfo(np.int64).max)
        row = np.arange(len(places))
        if seed:
            mine, theirs = self.key(places, [(a, False) for a, _, _ in seed]), self.key(behind, [(b, flip) for _, b, flip in seed])
            row, mine, behind, theirs = self.met_keys(places, mine, behind, theirs)
            keys, rank = np.unique(theirs, return_inverse=True)
            if not len(keys):
                return out
            at = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
            same = keys[at] == mine
            row, at = row[same], at[same]
            span = self.data.n + 2
            sorted_ = np.sort(rank * span + behind)
            base = at * span
        else:
            span, sorted_, base = self.data.n + 2, behind.astype(np.int64), np.zeros(len(row), np.int64)
        first = np.searchsorted(sorted_, base + low[row])
        last = np.searchsorted(sorted_, base + np.maximum(high[row], low[row] - 1), side="right")
        row, first, last = (x[first < last] for x in (row, first, last))
        while len(row):
            place = sorted_[first] % span
            if not links:
                out[row] = place
                return out
            ok = self.linked(places[row], place, links)
            out[row[ok]] = place[ok]
            first = first + 1
            going = ~ok & (first < last)
            row, first, last = row[going], first[going], last[going]
        return out

    def met_keys(self, places: np.ndarray, mine: np.ndarray, behind: np.ndarray, theirs: np.ndarray) -> tuple[np.ndarray, ...]:
        """Rows of the starts and their keys, places behind the gap and their keys: those whose key is likely to be on the other side in the same record too."""
        slots = [self.data.slots(keys, self.data.salt[at]) for keys, at in ((mine, places), (theirs, behind))]
        chosen = [np.arange(len(keys)) if self.data.fine else np.flatnonzero(keys >= 0) for keys in (mine, theirs)]
        slots = [s[c] for s, c in zip(slots, chosen)]
        for side in (0, 1, 0, 1):
            table = np.zeros(SLOTS, bool)
            table[slots[1 - side]] = True
            keep = np.flatnonzero(table[slots[side]])
            slots[side], chosen[side] = slots[side][keep], chosen[side][keep]
        return chosen[0], mine[chosen[0]], behind[chosen[1]], theirs[chosen[1]]

    def linked(self, places: np.ndarray, behind: np.ndarray, links: list[tuple[Unit, int, int, int]]) -> np.ndarray:
        """Which pairs of a start and a place behind the gap agree in all repeats."""
        data, ok = self.data, np.ones(len(places), bool)
        for s, at, n, first in links:
            missed = np.zeros(len(places), np.int32)
            for k in range(n):
                own = first + (k if s.kind == "repeat" else n - 1 - k)
                found = data.plain[behind + (at + k)]
                missed += ~data.accept(self.wanted(s, data.codes[places + own]), found)
                if not s.exact:
                    ok &= found != 0
            ok &= missed <= s.err[0]
        return ok


def parts(n: int) -> Iterator[tuple[int, int]]:
    """(offset, length) of a run of n letters cut into powers of two."""
    at = 0
    for size_ in (16, 8, 4, 2, 1):
        while n - at >= size_:
            yield at, size_
            at += size_


def pairs(s: Unit, at: int, n: int, first: int) -> list[tuple[int, int, bool]]:
    """(offset of a captured letter, offset behind the gap of its repeat, complemented?) of all letters of a repeat."""
    return [(first + k, at + (k if s.kind == "repeat" else n - 1 - k), s.kind == "complement") for k in range(n)]


def size(u: Unit, names: dict[int, tuple[int, int]]) -> int:
    """How many letters a unit without choice has, alignments aside."""
    return len(u.letters) if u.kind == "word" else names[u.ref][1] if u.ref is not None else len(u.columns) if u.kind == "weight" else int(u.kind == "set")


def routes(units: list[Unit], offset: int, steps: list[Step], sizes: dict[int, int]) -> Iterator[list[Step]]:
    """All combinations of the units' choices, in order, as (unit, offset, length)."""
    if not units:
        yield steps
        return
    u, rest = units[0], units[1:]
    if u.kind == "either":
        for branch in u.branches:  # type: ignore[union-attr]
            yield from routes([*branch, *rest], offset, steps, sizes)
        return
    for n in range(u.low, max(u.low, u.high) + 1) if u.kind == "range" else [size(u, {k: (0, x) for k, x in sizes.items()})]:
        yield from routes(rest, offset + n, [*steps, (u, offset, n)], sizes if u.name is None else {**sizes, u.name: n})


def data_letter(letter: str, dna: bool) -> int:
    return base_mask(letter) if dna else ord(letter)


def weights(column: list[int], dna: bool) -> np.ndarray:
    """The weight of every letter code: an ambiguous one gets halves and quarters by shifts, thirds truncated."""
    table = np.zeros(256, np.int64)
    if dna:
        for code in range(1, 16):
            own = [w for w, bit in zip(column, (1, 2, 4, 8)) if code & bit]
            table[code] = sum(abs(w) // 3 * (1 if w >= 0 else -1) for w in own) if len(own) == 3 else sum(w >> (len(own) // 2) for w in own)
    else:
        table[:] = column[20] if len(column) > 20 else 0
        for letter, w in zip(AMINO, column):
            table[ord(letter)] = w
    return table


def mask(flags: np.ndarray) -> np.ndarray:
    """255 where true, 0 elsewhere."""
    return np.negative(flags.view(np.uint8))


class Lanes:
    """Alignments of rows of wanted letters (a column each) with the letters from ``at`` on, of which ``room`` belong to the record.

    All rows take each step of the matcher's search together, a byte per row. What it
    finds from a state (wanted letter, budgets left, whether other moves are kept
    for later) depends on the letters ahead alone, so each state is solved once for all rows.
    """

    def __init__(self, data: Letters, columns: list[np.ndarray], at: np.ndarray, room: np.ndarray, budget: tuple[int, int, int]):
        self.data, self.columns, self.at, self.room, self.budget, self.n = data, columns, at, room, budget, len(columns)
        #: May a row come to the end of its record?
        self.tight = int(room.min(initial=0)) <= self.n + budget[2]
        self._there: dict[int, np.ndarray] = {}
        self._letters: dict[int, np.ndarray] = {}
        self._fits: dict[tuple[int, int], np.ndarray] = {}
        self._solved: dict[tuple[int, int, int, int, bool], np.ndarray] = {}

    def there(self, q: int) -> np.ndarray:
        """255 where the record has a letter q."""
        if q not in self._there:
            self._there[q] = mask(self.room > q)
        return self._there[q]

    def fits(self, p: int, q: int) -> np.ndarray:
        """255 where letter q is there and wanted letter p takes it."""
        if (p, q) not in self._fits:
            if q not in self._letters:
                self._letters[q] = self.data.plain[np.minimum(self.at + q, len(self.data.plain) - 1) if self.tight else self.at + q]
            fits = mask(self.data.accept(self.columns[p], self._letters[q]))
            self._fits[p, q] = fits & self.there(q) if self.tight else fits
        return self._fits[p, q]

    def first(self) -> np.ndarray:
        """Letters consumed by each row's first alignment, or -1."""
        m, d, i = self.budget
        if not self.n or self.n + i > 250 or self.n * (m + 1) * (d + 1) * (i + 1) > 1000:
            wanted = np.stack(self.columns, 1) if self.n else np.zeros((len(self.at), 0), np.uint8)
            at = self.at.astype(np.int64)
            return first_alignments(self.data, wanted, at, at + self.room, self.budget)
        return self.solved(0, m, d, i, self.tight).astype(np.int64) - 1

    def solved(self, p: int, m: int, d: int, i: int, alone: bool) -> np.ndarray:
        """One more than the letters consumed by the first alignment from a state, 0 for none; ``alone`` if no other move is kept."""
        state = (p, m, d, i, alone)
        if state not in self._solved:
            q = p - (self.budget[1] - d) + self.budget[2] - i
            if p == self.n:
                self._solved[state] = np.full(len(self.at), q + 1, np.uint8)
                return self._solved[state]
            steps = [self.solved(p + 1, m - 1, d, i, alone and not d and not i)] if m else []
            if self.tight and m:
                steps[0] = steps[0] & self.there(q)
            if d:
                step = self.solved(p + 1, m, d - 1, i, alone and not i)
                steps.append(step & self.there(q) if alone else step)
            if i:
                step = self.solved(p, m, d, i - 1, alone)
                steps.append(step & self.there(q) if self.tight else step)
            fits = self.fits(p, q)
            out = self.solved(p + 1, m, d, i, alone) & fits
            if steps:
                other = steps[0]
                for step in steps[1:]:
                    other = other | (step & mask(other == 0))
                out |= other & ~fits
            self._solved[state] = out
        return self._solved[state]

    def lengths(self) -> Iterator[tuple[int, np.ndarray]]:
        """Every length that some alignment consumes, ascending, and the rows where one does."""
        m, d, i = self.budget
        costs = {(0, 0): np.zeros(len(self.at), np.uint8)}  # (left out, skipped) -> fewest mismatches, m + 1 for too many
        for k in range(self.n + 1):
            for a in range(min(k, d) + 1):
                for b in range(i):
                    if (a, b) in costs:
                        step = np.minimum(costs[a, b] | ~self.there(k - a + b), m + 1)
                        costs[a, b + 1] = np.minimum(step, costs.get((a, b + 1), step))
            if k == self.n:
                break
            after: dict[tuple[int, int], np.ndarray] = {}
            for (a, b), cost in costs.items():
                q = k - a + b
                step = np.minimum(cost + (~self.fits(k, q) & 1), m + 1)
                step = np.minimum(step | ~self.there(q), m + 1)
                for to, value in ((a, b), step), ((a + 1, b), cost):
                    if to[0] <= d:
                        after[to] = np.minimum(value, after.get(to, value))
            costs = after
        for length in sorted({self.n - a + b for a, b in costs}):
            yield length, np.any([cost <= m for (a, b), cost in costs.items() if self.n - a + b == length], axis=0)


def first_alignments(data: Letters, wanted: np.ndarray, at: np.ndarray, end: np.ndarray, budget: tuple[int, int, int]) -> np.ndarray:
    """Letters consumed by the first alignment of each row of wanted letters, or -1: the matcher's state machine for all rows in step, for great budgets."""
    rows, n = wanted.shape
    used = np.full(rows, -1, np.int64)
    live = np.arange(rows)
    state = np.zeros((rows, 5), np.int64)  # pattern letters, data letters, mismatches, deletions, insertions left
    state[:, 2:] = budget
    saved, depth = np.zeros((rows, 2 * sum(budget) + 4, 5), np.int64), np.zeros(rows, np.int64)
    end = np.asarray(end, np.int64) - at
    while len(live):
        p, q, m, d, i = state[live].T
        there = q < end[live]
        on = there | (depth[live] > 0)
        live, p, q, m, d, i, there = (x[on] for x in (live, p, q, m, d, i, there))
        if not len(live):
            break
        inside = p < n
        fits = np.zeros(len(live), bool)
        both = there & inside
        fits[both] = data.accept(wanted[live[both], p[both]], data.plain[at[live[both]] + q[both]])
        state[live[fits], 0] += 1
        state[live[fits], 1] += 1
        for allowed, step in ((~fits & (i > 0) & there, (0, 1, 0, 0, -1)), (~fits & (d > 0) & inside, (1, 0, 0, -1, 0)), (~fits & (m > 0) & both, (1, 1, -1, 0, 0))):
            some = live[allowed]
            saved[some, depth[some]] = state[some] + np.array(step)
            depth[some] += 1
        stuck = live[~fits]
        out = stuck[depth[stuck] == 0]
        back = stuck[depth[stuck] > 0]
        depth[back] -= 1
        state[back] = saved[back, depth[back]]
        lost = np.zeros(rows, bool)
        lost[out] = True
        full = state[live, 0] == n
        finished = full & ~lost[live]
        used[live[finished]] = state[live[finished], 1]
        live = live[~finished & ~lost[live]]
    return used


def chain(hits: Hits) -> np.ndarray:
    """Rows of a left-to-right chain over first hits of starts: each begins at or behind the end of the last."""
    starts = hits.start
    after = np.searchsorted(starts, hits.end).tolist()
    rows, k = [], 0
    while k < len(starts):
        rows.append(k)
        k = after[k]
    return np.array(rows, np.int64)


def possible(hits: Hits, entry: int) -> np.ndarray:
    """Rows that some chain over a longer record can hold, if an earlier hit may end anywhere up to ``entry``."""
    starts = hits.start
    after = np.searchsorted(starts, hits.end)
    reached = np.zeros(len(starts) + 1, bool)
    reached[: int(np.searchsorted(starts, entry, side="right")) + 1] = True
    for k, to in enumerate(after.tolist()):
        if reached[k]:
            reached[to] = True
    return np.flatnonzero(reached[:-1])
