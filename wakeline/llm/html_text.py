"""Main text of web pages from the standard library's parser events.

A page's events become lines, one for each block: its text, how much of it is
in links, the tags met on the way, and the parts of the page that it stands in.
A line's text-to-tag ratio counts text outside links only; ratios are smoothed
by a Gaussian along runs of lines of one part, and lines above a threshold
cluster into content. The clusters choose the regions: the marked articles that
they touch or, on a page without any, the stretch from the first to the last of
them with the headings before it.

Inside the regions ratios decide too. Runs of lines that are nothing but links
are left out where their smoothed ratio stays under the threshold, and so are
parts whose class or id sounds like a menu, a notice or an advert, if their
ratio falls short of the rest's: a name only lowers a score. A part that holds
most of the page's text is no such part, whatever it is called. Elements that
mean a menu, a footer, an aside or a form, hidden ones, and reader comments
don't count.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Smoothing radius in lines and its standard deviation; the threshold as a share of the ratios' standard deviation.
RADIUS, SIGMA, SHARE = 2, 1.0, 0.5
#: Lines in a row that are nothing but links and make a list of links.
LINKS = 2
#: A part with a telling name counts if its mean ratio is at least this share of the mean of lines without such a name.
NAMED = 0.75
#: Characters fed to the parser at once.
PIECE = 1 << 16
#: Element names and name parts of classes, ids and roles.
_SILENT = set("script style noscript template head title svg iframe object canvas audio video select option datalist textarea button".split())
_OTHER = set("nav footer aside form menu dialog fieldset".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_INLINE_BREAK = {"br", "wbr", "img", "input"}
_REMARKS = set("comment comments commentlist disqus replies respond".split())
_PARTS = set(
    "ad ads adbox advert adverts advertisement advertising adsense sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar footer cookie cookies consent gdpr notice notices alert popup modal overlay share sharing social related recommended recommendations "
    "newsletter subscribe subscription signup login search widget toolbar pagination pager masthead skip copyright disclaimer".split()
)
_OUTSIDE = {"header", "banner", "topbar"}
_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_SPLIT = re.compile(r"[\s_\-:]+|(?<=[a-z])(?=[A-Z])")
_HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}


@dataclass
class Line:
    """A block: its text, the characters of it that are in links, tags met before its end, and where it stands."""

    text: str
    linked: int
    tags: int
    heading: bool
    other: bool
    remarks: bool
    region: int
    parts: tuple[int, ...]

    def plain(self) -> int:
        return max(0, len(self.text) - self.text.count(" ") - self.linked)


@dataclass(frozen=True)
class Place:
    """An open element: whether its text is silent, of another part, of reader comments or in a link; its region and named parts."""

    name: str
    silent: bool = False
    other: bool = False
    remarks: bool = False
    link: bool = False
    region: int = 0
    parts: tuple[int, ...] = ()


class Events(HTMLParser):
    """Collects the lines of a page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.stack = [Place("")]
        self.parts: list[str] = []
        self.tags = self.regions = self.named = self.linked = 0
        self.heading = False

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            at = self.stack[-1]
            self.lines.append(Line(text, self.linked, self.tags, self.heading, at.other, at.remarks, at.region, at.parts))
            self.tags, self.heading = 0, False
        self.parts, self.linked = [], 0

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag in _BLOCK:
            self.flush()
            self.heading = tag in _HEADING
            self.close_open("p")
            if tag in ("li", "td", "th", "tr", "dd", "dt"):
                self.close_open(tag)
        elif tag in _INLINE_BREAK:
            self.parts.append(" ")
        if tag in _VOID:
            return
        at = self.stack[-1]
        own = {k: v or "" for k, v in attrs}
        words = {w.lower() for k in ("class", "id") if k in own for w in _SPLIT.split(own[k])} if own else ()
        other, remarks, region, parts = at.other, at.remarks, at.region, at.parts
        if tag in ("article", "main") or own.get("role") == "main" or own.get("itemprop") == "articleBody":
            remarks = remarks or not _REMARKS.isdisjoint(words)
            outside = other and any(x.name in ("aside", "footer") for x in self.stack)
            if not remarks and not outside:
                other = False
                if not region:
                    self.regions += 1
                    region = self.regions
        elif tag not in ("html", "body"):
            hidden = "hidden" in own or own.get("aria-hidden") == "true" or "display:none" in own.get("style", "").replace(" ", "").lower()
            other = other or hidden or tag in _OTHER or (tag == "header" and not region) or own.get("role") in _ROLES
            remarks = remarks or not _REMARKS.isdisjoint(words)
            if not _PARTS.isdisjoint(words) or (not region and not _OUTSIDE.isdisjoint(words)):
                self.named += 1
                parts = (*parts, self.named)
        self.stack.append(Place(tag, at.silent or tag in _SILENT, other, remarks, at.link or tag == "a", region, parts))

    def close_open(self, tag: str) -> None:
        """A paragraph or item ends where the next block begins, if only inline elements are open in it."""
        for i in range(len(self.stack) - 1, 0, -1):
            name = self.stack[i].name
            if name == tag:
                del self.stack[i:]
                return
            if name in _BLOCK:
                return

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in _BLOCK:
            self.flush()
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].name == tag:
                del self.stack[i:]
                break

    def handle_data(self, data):
        at = self.stack[-1]
        if not at.silent:
            self.parts.append(data)
            if at.link:
                self.linked += sum(map(len, data.split()))


def smooth(values: list[float]) -> list[float]:
    """Gaussian smoothing; at the ends the weights inside are scaled to one."""
    weight = [math.exp(-0.5 * (k / SIGMA) ** 2) for k in range(-RADIUS, RADIUS + 1)]
    out = []
    for i in range(len(values)):
        near = [(weight[k + RADIUS], values[i + k]) for k in range(-RADIUS, RADIUS + 1) if 0 <= i + k < len(values)]
        out.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
    return out


def _named(lines: list[Line]) -> list[int]:
    """The telling part that each line belongs to, 0 for none: its outermost one, but for those that hold most of the text."""
    size: dict[int, int] = {}
    for x in lines:
        for part in x.parts:
            size[part] = size.get(part, 0) + len(x.text)
    whole = sum(len(x.text) for x in lines)
    return [next((p for p in x.parts if 2 * size[p] < whole), 0) for x in lines]


def scores(lines: list[Line], named: list[int]) -> tuple[list[float], list[tuple[int, bool]]]:
    """The smoothed text-to-tag ratio of each line, and the run it was smoothed in: its part, and whether it is a list of links."""
    bare = [not x.plain() and x.linked > 0 and not x.heading for x in lines]
    alike = [[*g] for _, g in groupby(range(len(lines)), key=lambda i: (named[i], bare[i]))]
    links = [False] * len(lines)
    for run in alike:
        for i in run:
            links[i] = bare[i] and len(run) >= LINKS
    kind = list(zip(named, links, strict=True))
    ratio = [0.0] * len(lines)
    for _, g in groupby(range(len(lines)), key=lambda i: kind[i]):
        run = [*g]
        for i, r in zip(run, smooth([lines[i].plain() / max(lines[i].tags, 1) for i in run]), strict=True):
            ratio[i] = r
    return ratio, kind


def content(lines: list[Line]) -> list[Line]:
    """The lines of the regions that the clusters choose, without the lists of links and the named parts whose ratio is too low."""
    own = [x for x in lines if not x.other and not x.remarks] or [x for x in lines if not x.other]
    if not own:
        return []
    named = _named(own)
    ratio, kind = scores(own, named)
    base = [r for r, (part, links) in zip(ratio, kind, strict=True) if not part and not links] or ratio
    mean = sum(base) / len(base)
    least = SHARE * math.sqrt(sum((r - mean) ** 2 for r in base) / len(base))
    parts: dict[int, list[float]] = {}
    for r, part in zip(ratio, named, strict=True):
        parts.setdefault(part, []).append(r)
    low = {p for p, rs in parts.items() if p and sum(rs) / len(rs) < NAMED * mean}
    text = any(x.plain() for x in own)
    kept = [i for i in range(len(own)) if named[i] not in low and not (kind[i][1] and text and ratio[i] <= least)]
    if not kept:
        kept = [*range(len(own))]
    chosen = [i for i in kept if ratio[i] >= least]
    regions = {own[i].region for i in chosen} - {0}
    marked = {own[i].region for i in kept} - {0}
    if marked:
        return [own[i] for i in kept if own[i].region in (regions or marked)]
    # the stretch begins and ends at lines that reach the threshold by themselves, not by their neighbours
    edges = [i for i in chosen if own[i].plain() / max(own[i].tags, 1) >= least] or chosen or kept
    first, last, inside = edges[0], edges[-1], set(kept)
    while first and own[first - 1].heading:
        first -= 1
    return [own[i] for i in range(first, last + 1) if i in inside or (own[i].heading and named[i] not in low)]


def extract(html: str | None) -> str:
    """The page's main text: blocks in page order, two line ends between them; empty if there is none."""
    if not html:
        return ""
    events = Events()
    for begin in range(0, len(html), PIECE):
        events.feed(html[begin : begin + PIECE])
    events.close()
    events.flush()
    return "\n\n".join(x.text for x in content(events.lines))


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract(h) for h in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    A null or empty html, and a page with no content, have the empty text. A
    page counts whole however long it is. Lines of equal ratio are judged alike,
    and a line at the threshold counts. Repeated rows are read alike; an empty
    table gives no rows; other columns, whatever their names, are not read.
    """
    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(_run, "page_id long, url string, text string, n_chars long")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(common.table(spark, sf_dir, "pages", "page_id", "url", "html"))


QUERIES = {"op9_html_text": op9_html_text}
ORACLES: dict[str, str] = {}
