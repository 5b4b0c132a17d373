"""Main text of web pages from the events of the standard library's parser.

The parser's events cut a page into lines, one for each run of text between block-level tags, and
count the tags of each. Lines inside menus, headers, adverts and the like weigh nothing. The
text-to-tag ratios of the lines are smoothed by a Gaussian along the page; lines above a threshold
(the deviation of the smoothed ratios) are the cluster of content, and neighbouring ones a region.
The element that most of the content lies in gives the article: short lines inside it belong to it too.
"""

from __future__ import annotations

from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.shared import slices

#: Standard deviation of the smoothing, in lines.
SIGMA = 1.0
#: Threshold of the content cluster, in standard deviations of the smoothed ratios.
LAMBDA = 1.0

# Elements of the HTML standard by their use, and words of class and id attributes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
NEVER = frozenset("head title script style noscript template iframe object applet svg canvas audio video map nav header footer aside menu select option textarea button datalist dialog".split())
SELDOM = frozenset("form fieldset".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
IN_HEAD = frozenset("base link meta title style script noscript template".split())
MAIN_WORDS = frozenset("article content entry main post story".split())
OTHER_WORDS = frozenset(
    "ad ads adv advert advertisement adverts advertising banner banners breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer "
    "discussion disqus footer gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notices notification overlay pagination pager "
    "popup promo promoted promotion recommended recommendations related replies reply respond responses search share sharing sidebar signup skip social sponsor "
    "sponsored subscribe subscription tags teaser toc toolbar topbar tracking widget widgets".split()
)
OTHER_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation note search status toolbar".split())
#: A start tag ends an open element of these, unless one of the second set lies between.
ENDED_BY = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

_ARTICLE, _SELDOM, _NEVER = 0, 1, 2


def _words(value: str | None) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in (value or "").lower()).split()


class _Page(HTMLParser):
    """Lines of a page: text, tags, characters in links, element, and how far the element is from being article text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parent, self.main, self.lines = [-1], [False], []
        self.open: list[tuple[str, int, int]] = [("", 0, _ARTICLE)]  # tag, element, level
        self.count = Counter()
        self._text, self._tags, self._linked, self._in_link, self._heading = [], 0, 0, False, False

    def line_ends(self):
        if self._text:
            text = " ".join("".join(self._text).split())
            if text:
                _, element, level = self.open[-1]
                self.lines.append((text, self._tags, self._linked, element, level, self._heading))
                self._tags = 0
        self._text, self._linked, self._in_link, self._heading = [], 0, False, False

    def _pop(self, depth: int):
        for tag, _, _ in self.open[depth:]:
            self.count[tag] -= 1
        del self.open[depth:]

    def _level(self, tag: str, attributes: dict, inside: bool) -> int:
        if (tag in NEVER and not (tag == "header" and inside)) or "hidden" in attributes or attributes.get("aria-hidden") == "true":
            return _NEVER
        if "display:none" in (attributes.get("style") or "").replace(" ", "").lower():
            return _NEVER
        if tag in ("html", "body", "main"):
            return _ARTICLE
        if tag in SELDOM:
            return _SELDOM
        if not attributes:
            return _ARTICLE
        words = {*_words(attributes.get("class")), *_words(attributes.get("id"))} & OTHER_WORDS
        if inside or tag in HEADINGS:
            words -= {"header"}
        return _NEVER if words or (attributes.get("role") or "").lower() in OTHER_ROLES else _ARTICLE

    def handle_starttag(self, tag, attrs):
        if self.count["head"] and tag not in IN_HEAD and tag not in ("head", "html"):
            self._end("head")
        self._tags += 1
        if tag in VOID:
            if tag in ("br", "hr"):
                self._text.append("\n")
            return
        attributes = dict(attrs)
        inside = self.count["article"] > 0 or self.count["main"] > 0
        if tag in INLINE:
            self._in_link |= tag == "a"
            level = self._level(tag, attributes, inside)
            if level > self.open[-1][2]:
                self.line_ends()
                self.open.append((tag, self.open[-1][1], level))
                self.count[tag] += 1
            return
        self.line_ends()
        if self.count["p"]:  # a block ends an open paragraph
            self._end("p", {"table", "td", "th", "button"})
        ended, walls = ENDED_BY.get(tag, ((), ()))
        for other in ended:
            if self.count[other]:
                self._end(other, walls)
        if tag in HEADINGS:
            self._heading = True
        level = max(self.open[-1][2], self._level(tag, attributes, inside))
        words = {*_words(attributes.get("class")), *_words(attributes.get("id"))} if attributes else set()
        self.parent.append(self.open[-1][1])
        self.main.append(level == _ARTICLE and (tag in ("article", "main") or (tag in ("div", "section", "td") and bool(words & MAIN_WORDS))))
        self.open.append((tag, len(self.parent) - 1, level))
        self.count[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in ("svg", "math", "iframe"):
            self.handle_endtag(tag)

    def _end(self, tag: str, walls=()):
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth][0] == tag:
                self.line_ends()
                self._pop(depth)
                return
            if self.open[depth][0] in walls:
                return

    def handle_endtag(self, tag):
        self._tags += 1
        if tag in INLINE:
            self._in_link &= tag != "a"
            if self.count[tag] and self.open[-1][0] == tag:
                self.line_ends()
                self._pop(len(self.open) - 1)
            return
        self.line_ends()
        if self.count[tag]:
            self._end(tag)

    def handle_data(self, data):
        self._text.append(data)
        if self._in_link:
            self._linked += len(data.strip())

    def parse_html_declaration(self, i):
        if self.rawdata.startswith("<![", i):  # a comment in HTML; the base class knows some kinds only and raises at others
            return self.parse_bogus_comment(i)
        return super().parse_html_declaration(i)


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing along the page; at its ends the weights inside it are taken as all."""
    reach = int(np.ceil(3 * sigma))
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    full = np.convolve(ratios, weights)[reach : reach + len(ratios)]
    return full / np.convolve(np.ones(len(ratios)), weights)[reach : reach + len(ratios)]


def _article(page: _Page) -> list[str]:
    """Lines of the article, in page order."""
    best = min((level for *_, level, _ in page.lines), default=_NEVER)
    if best == _NEVER:
        return []
    texts, tags, linked, element, level, heading = zip(*page.lines, strict=True)
    usable = np.array(level) == best
    chars, element, tags = np.fromiter(map(len, texts), float), np.array(element), np.array(tags)
    menu = np.array(linked) > 0.5 * chars
    ratio = smoothed(np.where(usable, chars / np.maximum(tags, 1), 0.0))
    content = usable & (ratio >= LAMBDA * ratio.std()) & ~menu
    if not content.any():
        content = usable & ~menu if (usable & ~menu).any() else usable

    last, weight = np.arange(len(page.parent)), np.bincount(element[content], chars[content], len(page.parent))
    for child in range(len(page.parent) - 1, 0, -1):  # elements are numbered as they open
        above = page.parent[child]
        last[above] = max(last[above], last[child])
        weight[above] += weight[child]
    mains = [e for e in range(len(page.parent)) if page.main[e] and 2 * weight[e] >= weight[0]]
    if mains:
        keep = usable & (element >= mains[-1]) & (element <= last[mains[-1]])
    else:
        # No element says that it is the article: from the first to the last line of the cluster, with the headings before it.
        at = np.flatnonzero(content)
        begin = at[0]
        while begin and usable[begin - 1] and heading[begin - 1]:
            begin -= 1
        span = np.arange(len(texts))
        keep = usable & ~menu & (span >= begin) & (span <= at[-1])
    return [t for t, k in zip(texts, keep.tolist(), strict=True) if k]


def main_text(html: str | None) -> str:
    """Main text of one page: blocks in page order, white space in a block as one space, blocks joined by one."""
    html = html or ""
    tail = html.rfind("<")
    if tail > html.rfind(">") and (html[tail + 1 : tail + 2].isalpha() or html[tail + 1 : tail + 2] in ("/", "!", "?")):
        html = html[:tail]  # the page ends inside a tag
    page = _Page()
    page.feed(html)
    page.close()
    page.line_ends()
    return " ".join(_article(page))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text (main text, '' if none) and n_chars (its code points) of every page.

    Menus, page headers, footers, sidebars, notices, adverts, forms, scripts, styles, comments of readers and
    hidden elements are left out; character references are decoded. Broken markup is read as far as it goes: unclosed
    elements end with what holds them, a tag cut off at the end is dropped. If nothing else has text, that of forms
    is taken, since some pages stand in a form as a whole.

    * A null or empty page has the text ''. Null page_id and url stay null, repeated rows are repeated,
      extra columns are ignored, no rows give no rows.
    * A page is parsed whole, however long; a task works on about a megabyte of pages at a time, or on one longer page.
    """
    names = ["page_id", "url", "text", "n_chars"]

    def run(batches):
        for batch in batches:
            for part in slices(batch, "html"):
                texts = [main_text(h) for h in part.column("html").to_pylist()]
                columns = part.column("page_id").cast(pa.int64()), part.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())
                yield pa.RecordBatch.from_arrays([*columns], names=names)

    wanted = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return wanted.mapInArrow(run, "page_id long, url string, text string, n_chars long")
