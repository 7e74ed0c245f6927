"""HTML extraction: main text by text-to-tag ratios over parser events.

The standard library's streaming parser yields events; they make lines (the
text between two block-level boundaries), each with its letters, its tags, the
block it stands in and, if any, the article or main element around it (of
nested ones the outermost). What is never shown or no text (head, scripts,
styles, form controls, hidden parts) yields no lines.

A line's text-to-tag ratio is its letters outside of links over its tags. What
elements, roles, classes and ids say only weighs on it: text in menus,
headers, footers, sidebars, notices, adverts, forms and reader comments weighs
nothing. A class or id of which only a part says so leaves that open: such an
element weighs nothing unless it holds most of the page's text over the
threshold, and the header of an article is part of the article. Ratios are smoothed with a
Gaussian kernel. Lines over the threshold (a share of the spread, so that it
scales with the page), smoothed and by themselves, are dense; runs of smoothed lines
over it, cut back to dense ones, are clusters.

The content regions are what clusters stand in: an article or main element with
a dense line gives all its lines that weigh something, short ones too. If such elements
hold less than half of the dense text, so do other blocks with dense lines, and what
lies between two clusters unless it has lists of links or weighs nothing. Regions are
returned in page order. A page without a dense line has no text.

Null html counts as empty. Text is "" if there is none. White space within a
line becomes one space; a line break element is white space. Repeated rows and
extra columns change nothing; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqmotif.llm.common import texts
from seqmotif.session import ship

BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that show no text, and those whose text weighs nothing.
UNSEEN = frozenset("head script style noscript template iframe object svg math canvas button select textarea title audio video".split())
LIGHT = frozenset("nav header footer aside form dialog menu search".split())
#: Words beside which `header` names the head of the content itself.
OWN = frozenset("article body content entry post story text".split())
#: Words of class, id or role that mark what is not main text.
NOISE = frozenset("ad ads adv advert advertisement advertisements adverts advertising banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead footer contentinfo sidebar complementary aside widget widgets related recommended recommendations share sharing social comment comments commentlist disqus reply replies respond discussion cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login paywall search form pagination pager skip hidden".split())
#: Words that say where or how such a part is laid out; with one of NOISE they name the same part (site-header, ad-box).
LAYOUT = frozenset("area bar block bottom box button buttons col column container entry global inner item items left link links list mobile outer page panel post primary right secondary section site thread top wrap wrapper".split())
CONTENT = ("article", "main")
#: Elements whose end tag may be missing: which open ones a start tag ends, and which keep it from looking further out.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"})}
ENDS |= {t: ({"td", "th"}, {"table", "tr"}) for t in ("td", "th")} | {t: ({"tr", "td", "th"}, {"table"}) for t in ("tr", "tbody", "thead", "tfoot")}
OPTIONAL = frozenset("p li dt dd tr td th option".split())
#: Blocks inside which a line still counts to the block around them.
INNER = frozenset("blockquote caption center dd details dir dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr li ol p pre summary table tbody td tfoot th thead tr ul".split())


#: What an element says of its text: nothing, that some word of its class does, that it weighs nothing, that it isn't shown.
PLAIN, DOUBT, WEIGHTLESS, HIDDEN = range(4)


def named(token: str) -> int:
    """What a token of class, id or role says: WEIGHTLESS by all of its words, DOUBT by some beside words of layout, or PLAIN, as with-sidebar, related-work or entry-header."""
    words = {w.rstrip("0123456789") for w in token.replace("_", "-").split("-")} - {""}
    if NOISE.isdisjoint(words) or not words <= NOISE | LAYOUT or words & NOISE <= {"header", "masthead"} and words & OWN:
        return PLAIN
    return WEIGHTLESS if words <= NOISE else DOUBT


def noisy(tag: str, attrs: list[tuple[str, str | None]], inside: bool) -> int:
    """What an element says of its text; ``inside`` an article or main element a header is no page header."""
    if tag in UNSEEN:
        return HIDDEN
    level = WEIGHTLESS if tag in LIGHT and not (tag == "header" and inside) else PLAIN
    for name, value in attrs:
        if name in ("class", "id", "role") and tag not in ("html", "body"):
            found = [named(t) for t in (value or "").lower().split() if not (inside and t == "header")]
            level = max(level, min(found, default=PLAIN), DOUBT if any(found) else PLAIN)
        elif name == "hidden" or name == "aria-hidden" and value == "true":
            return HIDDEN
        elif name == "style" and "display:none" in (value or "").replace(" ", "").lower():
            return HIDDEN
    return PLAIN if level == DOUBT and tag in CONTENT else level


@dataclass
class Line:
    """A line: its text, tags, letters in links, whether it weighs something, its block, the content container (0: none) and doubtful elements around it."""

    text: str
    tags: int
    linked: int
    heavy: bool
    block: int
    container: int
    doubts: tuple[int, ...]


@dataclass
class Open:
    """An open element and what holds inside it."""

    tag: str = ""
    level: int = PLAIN
    container: int = 0
    block: int = 0
    doubts: tuple[int, ...] = ()


class Lines(HTMLParser):
    """Collects the lines of a page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.parts: list[str] = []
        self.tags = self.linked = self.containers = self.blocks = self.doubts = 0
        self.open: list[Open] = []

    def state(self) -> Open:
        return self.open[-1] if self.open else Open()

    def close_implied(self, tag: str) -> None:
        """End an open paragraph, item or cell that this start tag ends."""
        for ends, scope in (({"p"}, BLOCKS), ENDS.get(tag, ((), BLOCKS))):
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k].tag in ends:
                    del self.open[k:]
                elif self.open[k].tag in scope:
                    break

    def count_tag(self) -> None:
        """What isn't shown does not weigh on the lines around it."""
        self.tags += self.state().level < HIDDEN

    def end_line(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            now = self.state()
            if text and now.level < HIDDEN:
                self.lines.append(Line(text, self.tags, self.linked, now.level < WEIGHTLESS, now.block, now.container, now.doubts))
            self.parts, self.tags, self.linked = [], 0, 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self.end_line()
            self.close_implied(tag)
        self.count_tag()
        if tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        around = self.state()
        level = noisy(tag, attrs, around.container > 0)
        doubt = level == DOUBT and around.level < WEIGHTLESS
        now = Open(tag, max(around.level, PLAIN if level == DOUBT else level), around.container, around.block, around.doubts)
        if doubt:
            self.doubts += 1
            now.doubts = (*around.doubts, self.doubts)
        if now.level < WEIGHTLESS and tag in CONTENT and not now.container:
            self.containers += 1
            now.container = self.containers
        if tag in OPTIONAL and now.level == around.level and not doubt:
            return  # often left open; they bound lines and hold nothing else
        if tag in BLOCKS or now.level != around.level or doubt or now.level and tag in ("div", "span") or tag == "a":
            if tag in BLOCKS and tag not in INNER or now.level != around.level or doubt:
                self.blocks += 1
                now.block = self.blocks
            self.open.append(now)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.end_line()
        self.count_tag()
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                break
            if tag not in BLOCKS and self.open[k].tag in BLOCKS:
                break

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self.end_line()
        self.count_tag()
        if tag == "br":
            self.parts.append(" ")

    def handle_data(self, data: str) -> None:
        now = self.state()
        if now.level < HIDDEN:
            self.parts.append(data)
            if now.tag == "a":
                self.linked += len(data)


def smooth(ratios: np.ndarray, radius: int = 2) -> np.ndarray:
    """Gaussian smoothing over neighbouring lines, with the ends repeated."""
    kernel = np.exp(-np.arange(-radius, radius + 1) ** 2 / (2 * (radius / 2) ** 2))
    return np.convolve(np.pad(ratios, radius, mode="edge"), kernel / kernel.sum(), mode="valid")


@dataclass
class Density:
    """Per line: letters outside links that weigh, whether its own ratio is over the threshold, and whether the smoothed one is."""

    letters: np.ndarray
    own: np.ndarray
    smoothed: np.ndarray

    @property
    def dense(self) -> np.ndarray:
        return self.own & self.smoothed


def density(lines: list[Line], share: float) -> Density:
    """The lines' ratios against the threshold, ``share`` of their spread."""
    letters = np.array([max(0, len(x.text) - x.linked) * x.heavy for x in lines], float)
    own = letters / np.maximum(1, [x.tags for x in lines])
    ratios = smooth(own)
    least = max(share * ratios.std(), 1e-9)
    return Density(letters, own >= least, ratios >= least)


def settled(lines: list[Line], share: float) -> list[Line]:
    """The lines with doubtful elements decided: one that holds most of the text over the threshold weighs, others don't."""
    if not any(x.doubts for x in lines):
        return lines
    d = density(lines, share)
    counted = np.where(d.smoothed, d.letters, 0)
    held: dict[int, float] = {}
    for x, n in zip(lines, counted):
        for k in x.doubts:
            held[k] = held.get(k, 0) + n
    return [replace(x, heavy=x.heavy and all(held[k] > counted.sum() / 2 for k in x.doubts)) for x in lines]


def clusters(d: Density) -> list[tuple[int, int]]:
    """(first line, end) of runs of smoothed lines over the threshold, cut back to dense ones."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], d.smoothed, [0]]))).reshape(-1, 2)
    inner = [a + np.flatnonzero(d.own[a:b]) for a, b in edges]
    return [(int(x[0]), int(x[-1]) + 1) for x in inner if len(x)]


def regions(lines: list[Line], d: Density) -> np.ndarray:
    """Which lines are content: all of what clusters stand in."""
    block, container = (np.array([getattr(x, k) for x in lines]) for k in ("block", "container"))
    heavy = np.array([x.heavy for x in lines])
    links = np.array([2 * x.linked > len(x.text) for x in lines])
    weight = np.bincount(container, np.where(d.dense, d.letters, 0))
    inside = (container > 0) & (weight[container] > 0) & heavy
    if weight[1:].sum() <= weight[0]:
        inside |= np.isin(block, block[d.dense]) & ~links
        past = None
        for a, b in clusters(d):
            if past is not None and not links[past:a].any() and heavy[past:a].all():
                inside[past:a] = True
            past = b
    return inside


def extract(html: str, share: float = 0.3) -> str:
    """The main text of one page, its blocks joined by an empty line."""
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.end_line()
    if not parser.lines:
        return ""
    lines = settled(parser.lines, share)
    inside = regions(lines, density(lines, share))
    return "\n\n".join(x.text for x, keep in zip(lines, inside) if keep)


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [extract(h) for h in texts(batch, "html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    return extract_pages(pages)
