"""Main text of web pages by text density.

Method: the standard library's streaming parser gives events; a block element's
begin or end closes the current line. Each line has a text-to-tag ratio: its
characters outside links over its tags. The logarithms of the ratios are smoothed
by a Gaussian over neighbouring lines and clustered in two by a threshold (the
mean of the two means, to a fixed point; clusters less than four times apart are
one). A sectioning element that directly
holds a line dense by itself and with its neighbours is a content block: its
lines stay, short ones too, but for runs of links. Gaps of at most two lines
between content are filled, and headings that lead to content are taken. Where
articles and main elements hold most of the dense text, blocks outside them go;
elsewhere blocks before the first and after the last one that is also dense by
the plain ratio go, if they are less than a quarter of the text.

Menus, headers, footers, sidebars, notices, adverts, forms and comments that an
element, a role or a whole class or id token names are left out, unless they wrap
an article or main element; scripts, styles and hidden elements always are. Names
of adverts and comments count as parts of a token too. A header inside an article
is the article's. Class names that would leave nothing of a page are not heeded.
Inside an article table cells go with the text around them, and links that close
it in a section with its text are its sources and stay.

Pages are parsed one by one, in time that grows with their length however tags
nest; the largest page bounds a task's memory.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_NO_TEXT = frozenset("script style noscript template head title button select textarea iframe svg object canvas".split())
_LEFT_OUT = frozenset("nav header footer aside form menu dialog".split())  # unless they wrap an article or main
_SECTIONS = frozenset("article main section div td body".split())
_NAMES = frozenset(
    "nav navbar navigation menu header masthead footer sidebar aside notice notices cookie cookies consent banner ad ads advert adverts advertisement "
    "sponsor sponsored promo promotion comment comments reply replies disqus form newsletter subscribe signup login search share sharing social "
    "related breadcrumb breadcrumbs pagination pager popup modal toolbar skip".split()
)
_PARTS = frozenset("ad ads advert adverts advertisement sponsor sponsored comment comments".split())  # also as parts of a token
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_GAP = 2  # lines between content that are filled
_LIST = 3  # links that make a list
_APART = 4  # of the mean ratios of two clusters
_END = 4  # text over text at one end that may go
_BLANK = re.compile(r"\s+")
_PART = re.compile("[-_]")


class _Line(NamedTuple):
    text: str
    plain: int  # characters outside links
    tags: int
    links: int
    section: int
    heading: bool

    @property
    def linked(self) -> bool:
        return 2 * self.plain < len(self.text)


class _Lines(HTMLParser):
    """Blocks of text with their tags, links and enclosing sections."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, int, int]] = []  # tag, without text, innermost left-out element, section
        self.open: Counter = Counter()  # tags on the stack
        self.kind, self.parent = ["body"], [0]  # of sections
        self.article = [False]  # whether an article or main is around
        self.outer = [0]  # of left-out elements, numbered from 1: the next one around
        self.by_class: set[int] = set()  # those that only a class or id names
        self.wraps: set[int] = {0}  # those with an article or main inside
        self.closed: list[tuple] = []  # pieces of text, tags, links, section, heading
        self.text: list[tuple[str, bool, int]] = []  # piece, in a link, innermost left-out element
        self.tags = self.links = 0

    def _top(self) -> tuple[str, bool, int, int]:
        return self.stack[-1] if self.stack else ("", False, 0, 0)

    def _in(self, *tags: str) -> bool:
        return any(self.open[t] for t in tags)

    def close_line(self) -> None:
        if self.text:
            self.closed.append((self.text, self.tags, self.links, self._top()[3], self._in(*_HEADINGS)))
        self.text, self.tags, self.links = [], 0, 0

    def lines(self, heeded: bool = True) -> list[_Line]:
        """Lines that are not left out, by class names only if `heeded`; to be
        called at the end."""
        out = [False]
        for k in range(1, len(self.outer)):
            out.append(out[self.outer[k]] or k not in self.wraps and (heeded or k not in self.by_class))
        found = []
        for pieces, tags, links, section, heading in self.closed:
            own = [(t, link) for t, link, around in pieces if not out[around]]
            if text := _BLANK.sub(" ", "".join(t for t, _ in own)).strip():
                plain = max(0, len(text) - sum(len(t) for t, link in own if link))
                found.append(_Line(text, plain, tags, links, section, heading))
        return found

    def handle_starttag(self, tag, attrs):
        if tag in _BLOCKS:
            self.close_line()
            if tag in ("p", "li", *_HEADINGS, *_SECTIONS) and self._in("p"):
                self._pop("p")
        self.tags += 1
        self.links += tag == "a"
        _, without, around, section = self._top()
        if tag == "br":
            self.text.append((" ", False, around))
        if tag in _VOID:
            return
        without = without or tag in _NO_TEXT
        inside = self._in("article")
        out, named = tag in _LEFT_OUT and not (tag == "header" and inside), False
        for name, value in attrs:
            if name in ("class", "id") and value and tag not in ("html", "body", "article", "main"):
                tokens = value.lower().split()
                known = _NAMES.intersection(tokens)
                if inside:
                    known -= {"header"}
                named = named or bool(known) or not _PARTS.isdisjoint(part for t in tokens for part in _PART.split(t))
            elif name == "role" and (value or "").lower() in _ROLES:
                out = True
            elif name == "hidden" or (name == "aria-hidden" and value == "true"):
                without = True
            elif name == "style" and value and "display:none" in value.replace(" ", "").lower():
                without = True
        if tag in ("article", "main") and not inside:  # an article in an article is a comment or a teaser
            wrapped = around
            while wrapped not in self.wraps:
                self.wraps.add(wrapped)
                wrapped = self.outer[wrapped]
        if out or named:
            self.outer.append(around)
            around = len(self.outer) - 1
            if not out:
                self.by_class.add(around)
        if tag in _SECTIONS:
            self.parent.append(section)
            self.kind.append(tag)
            self.article.append(self.article[section] or tag in ("article", "main"))
            section = len(self.kind) - 1
        self.stack.append((tag, without, around, section))
        self.open[tag] += 1

    def handle_endtag(self, tag):
        if tag in _BLOCKS:
            self.close_line()
        self.tags += 1
        self._pop(tag)

    def _pop(self, tag):
        if not self.open[tag]:
            return
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                self.open.subtract(t[0] for t in self.stack[k:])
                del self.stack[k:]
                return
            if self.stack[k][0] in _SECTIONS and tag not in _SECTIONS and tag not in _LEFT_OUT and tag not in _NO_TEXT:
                return  # an end tag does not close what encloses it

    def handle_data(self, data):
        _, without, around, _ = self._top()
        if not without:
            self.text.append((data, self._in("a"), around))


def _smooth(values: np.ndarray, sigma: float) -> np.ndarray:
    reach = int(3 * sigma)
    weight = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    total = np.convolve(values, weight)[reach : reach + len(values)]
    return total / np.convolve(np.ones(len(values)), weight)[reach : reach + len(values)]


def _threshold(values: np.ndarray) -> float:
    """Border of two clusters on a line, moved until it stays."""
    border = float(values.mean())
    for _ in range(100):
        low, high = values[values < border], values[values >= border]
        moved = (float(low.mean()) + float(high.mean())) / 2 if len(low) and len(high) else border
        if moved == border:
            break
        border = moved
    return border


def main_text(html: str, sigma: float = 1.0) -> str:
    """Content blocks of a page, in order, one a line."""
    parser = _Lines()
    parser.feed(html)
    parser.close()
    parser.close_line()
    lines = parser.lines()
    if not any(line.plain for line in lines):
        lines = parser.lines(heeded=False)
    if not any(line.plain for line in lines):
        return ""
    ratio = np.array([line.plain / max(1, line.tags) for line in lines])
    seeds = _dense(ratio, sigma, np.log1p)
    weight = [0, 0]
    for k in seeds:
        weight[parser.article[lines[k].section]] += lines[k].plain
    blocks = {lines[k].section for k in seeds}
    only = weight[1] > weight[0]
    if only:
        # A cell belongs to the section that its table stands in.
        around = list(range(len(parser.kind)))
        for k, kind in enumerate(parser.kind):
            if kind == "td" and parser.article[k]:
                around[k] = around[parser.parent[k]]
        blocks = {around[s] for s in blocks}
        lines = [line._replace(section=around[line.section]) for line in lines if parser.article[line.section]]
    else:
        blocks -= _ends(lines, blocks, {lines[k].section for k in _dense(ratio, sigma)})
    return "\n".join(lines[k].text for k in _content(lines, blocks, only))


def _dense(ratio: np.ndarray, sigma: float, scale=np.asarray) -> list[int]:
    """Lines in the upper cluster by themselves and with their neighbours.

    Clusters of ratios less than four times apart are one, of dense lines."""
    own = scale(ratio)
    smooth = _smooth(own, sigma)
    border = _threshold(smooth)
    good = (smooth >= border) & (own >= border)
    if not good.any() or good.all() or ratio[good].mean() < _APART * ratio[~good].mean():
        good = ratio > 0
    return np.flatnonzero(good).tolist()


def _ends(lines: list[_Line], blocks: set[int], core: set[int]) -> set[int]:
    """Blocks wholly before or after the core that are a small part of the text."""
    at = [k for k, line in enumerate(lines) if line.section in core]
    total = sum(line.plain for line in lines if line.section in blocks)
    inner = {line.section for line in lines[at[0] : at[-1] + 1]}
    gone = set()
    for side in (lines[: at[0]], lines[at[-1] + 1 :]):
        outer = [line for line in side if line.section in blocks and line.section not in inner]
        if _END * sum(line.plain for line in outer) < total:
            gone.update(line.section for line in outer)
    return gone


def _content(lines: list[_Line], blocks: set[int], article: bool) -> list[int]:
    """Lines of content blocks, of short gaps between them and headings before
    them. Links that close an article, in a section with its text, are its sources."""
    keep = [line.section in blocks for line in lines]
    last = max((k for k in range(len(lines)) if not lines[k].linked), default=-1)
    texts = {line.section for line in lines if article and not line.linked}
    k = 0
    while k < len(lines):  # runs of links in one section
        end = k + 1
        while end < len(lines) and lines[k].linked and lines[end].linked and lines[end].section == lines[k].section:
            end += 1
        lists = lines[k].linked and not (k > last and lines[k].section in texts) and sum(line.links for line in lines[k:end]) >= _LIST
        if lists:
            keep[k:end] = [False] * (end - k)
        k = end
    kept = [-1, *(k for k in range(len(lines)) if keep[k])]
    for before, after in zip(kept, kept[1:], strict=False):
        gap = range(before + 1, after)
        if before >= 0 and len(gap) <= _GAP and not any(lines[k].linked for k in gap):
            start = before + 1
        else:  # a heading and what is between it and the content
            heads = [k for k in gap[-_GAP - 1 :] if lines[k].heading and not any(line.linked and not line.heading for line in lines[k:after])]
            start = min(heads, default=after)
        keep[start:after] = [True] * (after - start)
    return [k for k in range(len(lines)) if keep[k]]


def _extract(batches):
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            part = batch.slice(k, 256)
            text = [main_text(h or "") for h in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars), one row per page.

    Character references are decoded, white space inside a block is one blank,
    blocks are joined by a line feed. Null or empty html: empty text. Null ids
    and urls pass through, repeated rows give repeated results, no rows none.
    Other columns are not read.
    """
    narrow = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return narrow.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
