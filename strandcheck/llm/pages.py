r"""Main text of web pages by the distribution of text over lines.

Markup is stripped first: block elements become lines, inline elements vanish, and lines of menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles and reader comments are left blank. Then the lengths of the lines are summed over windows of three
lines. A surge is where such a sum reaches ``SURGE`` characters, a dive where it falls to zero; the text between is kept. Where one
article element (or a container named like one) holds most of that text, surge and dive are moved to its first and last line, so
that a short headline or closing line stays and what stands beside the article goes.

Pages are worked on one at a time, in time that grows with their length, and nothing is shuffled.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import in_small_parts, text_chunks

#: Lines that a window sums over, and the characters (without white space) at which text begins to count as running text.
WINDOW, SURGE = 3, 80

# Element names of HTML, and words that pages use in class and id for parts beside the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong"
    " sub sup time tt u var wbr img embed picture source track param map area".split()
)
BESIDE = frozenset("nav header footer form dialog menu head".split())
NEVER = frozenset("aside noscript template svg math canvas audio video object select button datalist applet".split())
BESIDE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox adslot banner sponsor sponsored promo promotion cookie cookies consent"
    " gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login sidebar sidenav menu menubar nav navbar"
    " navigation breadcrumb breadcrumbs pager pagination footer header masthead topbar toolbar share sharing social search copyright legal"
    " disclaimer contentinfo complementary".split()
)
NEVER_NAMES = frozenset("comment comments commentlist disqus respond reply replies related recommended recommendations hidden".split())
ARTICLE_NAMES = frozenset("article articlebody content post entry story main".split())
NEGATING = frozenset("has with without no".split())

_TOKEN = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"""
    r"""|<([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)(?:>|\Z)""",
    re.DOTALL,
)
_NAMED = re.compile(r"""(?:^|[\s"'/])(class|id|role|itemprop|style|hidden|aria-hidden|href)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|(?=[\s/]|$))""", re.IGNORECASE)
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*(?:>|\Z)", re.IGNORECASE) for t in RAW}
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_UNSHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
_OWNED = re.compile(r"(?:©|\(c\)|copyright\b)", re.IGNORECASE)

#: How an element is left out: not at all, unless an article begins inside it, or whatever is inside.
SHOWN, BESIDE_TEXT, NEVER_TEXT = 0, 1, 2


class _Lines:
    """Lines of a page: text, characters that count, number of the innermost article-like element (-1: none), whether it is a headline."""

    def __init__(self, by_name: bool):
        self.by_name = by_name
        self.texts: list[str] = []
        self.weights: list[int] = []
        self.zones: list[int] = []
        self.heads: list[bool] = []
        self.parents: list[int] = []  # of each article-like element
        self.strong: list[bool] = []
        self._stack: list[tuple[str, int, int, bool]] = []  # element, left out, zone, inline
        self._open: Counter[str] = Counter()
        self._pieces: list[str] = []
        self._linked = 0
        self._link = self._head = False

    def _state(self) -> tuple[int, int]:
        return self._stack[-1][1:3] if self._stack else (SHOWN, -1)

    def _add(self, text: str, weight: int) -> None:
        self.texts.append(text)
        self.weights.append(weight)
        self.zones.append(self._state()[1])
        self.heads.append(self._head)

    def text(self, raw: str) -> None:
        if self._state()[0] == SHOWN:
            piece = html.unescape(raw) if "&" in raw else raw
            self._pieces.append(piece)
            if self._link:
                self._linked += len("".join(piece.split()))

    def flush(self) -> None:
        """Ends a line. Lines that are links for the most part are kept but don't count."""
        if self._pieces:
            words = "".join(self._pieces).split()
            if words:
                size = sum(map(len, words))
                self._add(" ".join(words), 0 if 2 * self._linked > size else size)
            self._pieces, self._linked = [], 0

    def _push(self, tag: str, out: int, zone: int, inline: bool = False) -> None:
        self._stack.append((tag, out, zone, inline))
        self._open[tag] += 1

    def _pop(self) -> tuple[str, int, int, bool]:
        entry = self._stack.pop()
        self._open[entry[0]] -= 1
        return entry

    def _judge(self, tag: str, attributes: str) -> tuple[int, bool | None, bool]:
        """How the element is left out, whether it holds an article (True: by its kind, False: by its name), whether it is a link."""
        out = NEVER_TEXT if tag in NEVER else BESIDE_TEXT if tag in BESIDE else SHOWN
        article = True if tag in ("article", "main") else None
        if tag == "header" and self._state()[1] >= 0:  # an article's own header
            out = SHOWN
        link = False
        for key, *values in _NAMED.findall(attributes) if attributes.strip() else ():
            key, value = key.lower(), next(filter(None, values), "")
            if key == "href":
                link = True
            elif key in ("hidden", "aria-hidden", "style"):
                if key == "hidden" or (value.lower() == "true" if key == "aria-hidden" else _UNSHOWN.search(value)):
                    out = NEVER_TEXT
            elif tag not in ("html", "body"):
                for name in value.split():
                    words = {w.lower() for w in _WORD.findall(name)} | {name.lower()}
                    if words & NEGATING:
                        continue
                    if self.by_name and tag != "main":
                        if words & NEVER_NAMES:
                            out = NEVER_TEXT
                        elif words & (BESIDE_NAMES - {"header"} if self._state()[1] >= 0 or tag == "article" else BESIDE_NAMES):
                            out = max(out, BESIDE_TEXT)
                    if article is None and words & ARTICLE_NAMES:
                        article = key in ("role", "itemprop")
        return out, article, link

    def start(self, tag: str, attributes: str) -> None:
        inline = tag in INLINE
        if not inline:
            self.flush()
            while self._stack and (self._stack[-1][0] == "p" or self._stack[-1][3]):
                self._pop()
            if tag == "body":
                while self._stack:
                    self._pop()
            for closes, within in ((("li",), ("ul", "ol", "menu")), (("dt", "dd"), ("dl",)), (("td", "th"), ("tr", "table")), (("tr",), ("table",))):
                if tag in closes or (tag == "tr" and "td" in closes):
                    self._close_sibling(closes, within)
        if tag in VOID:
            return
        before, zone = self._state()
        out, article, link = self._judge(tag, attributes)
        if tag == "a":
            self._link = link
        if inline:
            if out != SHOWN or (self._stack and self._stack[-1][3] and self._stack[-1][0] == tag):
                self._push(tag, max(before, out), zone, True)
            return
        if out == SHOWN and article and before != NEVER_TEXT:
            before = SHOWN
        out = max(before, out)
        if out == SHOWN and article is not None:
            self.parents.append(zone)
            self.strong.append(article)
            zone = len(self.parents) - 1
        if out != SHOWN and before == SHOWN:
            for _ in range(WINDOW):
                self._add("", 0)
        elif tag not in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6"):
            self._add("", 0)
        self._push(tag, out, zone)
        self._head = tag == "h1"

    def _close_sibling(self, closes: tuple[str, ...], within: tuple[str, ...]) -> None:
        if any(self._open[t] for t in closes):
            for at in range(len(self._stack) - 1, -1, -1):
                if self._stack[at][0] in within:
                    return
                if self._stack[at][0] in closes:
                    while len(self._stack) > at:
                        self._pop()
                    return

    def end(self, tag: str) -> None:
        if tag in INLINE:
            if tag == "a":
                self._link = False
            if self._stack and self._stack[-1][3] and self._stack[-1][0] == tag:
                self._pop()
            return
        self.flush()
        self._link = self._head = False
        if not self._open[tag]:
            return
        if tag not in ("article", "main", "body", "html", "table"):
            for entry in reversed(self._stack):
                if entry[0] == tag:
                    break
                if entry[0] in ("article", "main", "td", "th"):
                    return  # a stray end tag does not end what lies around
        while self._pop()[0] != tag:
            pass
        if tag not in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6"):
            self._add("", 0)


def lines_of(page: str, by_name: bool = True) -> _Lines:
    lines, at = _Lines(by_name), 0
    while found := _TOKEN.search(page, at):
        if found.start() > at:
            lines.text(page[at : found.start()])
        at = found.end()
        if found[1]:
            lines.end(found[1].lower())
        elif found[2]:
            tag = found[2].lower()
            if tag in RAW:
                close = _RAW_END[tag].search(page, at)
                at = close.end() if close else len(page)
            else:
                lines.start(tag, found[3])
    lines.text(page[at:])
    lines.flush()
    return lines


def surges(weights: list[int], window: int = WINDOW, least: int = SURGE) -> list[tuple[int, int]]:
    """Ranges of lines from a surge to the next dive; the longest range with any text if none surges."""
    sums = np.convolve(np.array([*weights, *[0] * (window - 1)], np.int64), np.ones(window, np.int64), "valid") if weights else np.zeros(0, np.int64)
    edges = np.flatnonzero(np.diff(sums > 0, prepend=False, append=False)).reshape(-1, 2).tolist()
    found = []
    for first, dive in edges:
        high = np.flatnonzero(sums[first:dive] >= least)
        if len(high):
            found.append((first + int(high[0]), dive))
    if not found and edges:
        found.append(max(map(tuple, edges), key=lambda e: (sum(weights[e[0] : e[1]]), -e[0])))
    return found


def _container(lines: _Lines, ranges: list[tuple[int, int]]) -> int:
    """The innermost article-like element with most of the text of such elements, if they hold enough of what lies in ``ranges``; else -1."""
    sums, total = [0] * len(lines.parents), 0
    for first, dive in ranges:
        for zone, text in zip(lines.zones[first:dive], lines.texts[first:dive], strict=True):
            total += len(text)
            if zone >= 0:
                sums[zone] += len(text)
    for zone in range(len(sums) - 1, -1, -1):  # a parent comes before its children
        if lines.parents[zone] >= 0:
            sums[lines.parents[zone]] += sums[zone]
    for strong, share in ((True, 0.3), (False, 0.5)):
        of_kind = {z for z in range(len(sums)) if lines.strong[z] == strong}
        below = _within(lines, of_kind)
        inside = sum(sums[z] for z in of_kind if lines.parents[z] < 0 or not below[lines.parents[z]])
        most = [z for z in of_kind if 2 * sums[z] > inside]
        if most and inside >= share * total:
            return max(most)
    return -1


def _within(lines: _Lines, zones: set[int]) -> list[bool]:
    """Of each article-like element, whether it is one of ``zones`` or lies in one."""
    within: list[bool] = []
    for zone, parent in enumerate(lines.parents):
        within.append(zone in zones or (parent >= 0 and within[parent]))
    return within


def _chosen(lines: _Lines) -> str:
    ranges = surges(lines.weights)
    container = _container(lines, ranges)
    if container >= 0:
        inside = _within(lines, {container})
        at = [k for k, z in enumerate(lines.zones) if z >= 0 and inside[z]]
        around = lines.parents[container]
        above = [k for k in range(at[0]) if lines.heads[k] and lines.zones[k] == around >= 0]
        kept = ([] if any(lines.heads[k] for k in at) else above) + at
        return " ".join(filter(None, (lines.texts[k] for k in kept)))
    kept = []
    for first, dive in ranges:
        texts = [t for t in lines.texts[first:dive] if t]
        while len(texts) > 1 and _OWNED.match(texts[-1]):
            texts.pop()
        kept += texts
    return " ".join(kept)


def main_text(page: str | None) -> str:
    """Main text of one page; if names of classes leave nothing, they are not heeded."""
    return (_chosen(lines_of(page)) or _chosen(lines_of(page, by_name=False))) if page else ""


def extracted(pages: DataFrame, html_column: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Columns ``keep`` of each row of ``pages``, ``text`` and ``n_chars`` (code points).

    A null or empty page, and one without text outside of menus and the like, gives an empty text. Repeated rows come out repeatedly; nulls
    in ``keep`` stay; other columns are ignored; an empty table gives no rows. A reference or tag that is cut off at the end of a page is taken as browsers do.
    """
    ship_package(pages.sparkSession)
    in_small_parts(pages.sparkSession)
    given = pages.select(*keep, F.col(html_column).alias("text"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch):
                texts = pa.array(map(main_text, part.column("text").to_pylist()), pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], texts], names=part.schema.names)

    return given.mapInArrow(extract, given.schema).withColumn("n_chars", F.length("text").cast("bigint"))
