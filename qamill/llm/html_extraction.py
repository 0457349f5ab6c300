"""Main-text extraction from HTML pages.

Every page is read once by the standard library's streaming parser. Its events
are gathered into lines, one for each block of the page; a line knows its
text, the tags seen in it and the elements around it. Then, per page:

1. each line outside boilerplate elements gets its text-to-tag ratio
   (characters of text over tags, link text not counted as text);
2. the ratios are smoothed over neighbouring lines by a Gaussian kernel;
3. two-means clustering of the smoothed ratios sets a threshold; lines above
   it are content;
4. the content lines choose the region: the article (or main) elements that hold
   at least a fifth as much of their text as the richest one, if these hold half of all
   such text, else the innermost container (div, section, body) that holds four
   fifths of it; every block of that region outside boilerplate elements is kept,
   short paragraphs too.

Boilerplate elements are those whose tag, role or class/id words say so (fixed
values below): menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles and reader comments. A header inside an article keeps its headings.
Words that are also plain English ("search", "share", "related") hide an element only where its
class or id says nothing else ("search-box"); beside other words ("share-price") its blocks
stay if they are content lines. Ids of headings, which repeat their text, hide nothing, and
an aside that is named a quote is text. Elements left open close where a browser
closes them: head at the first element or text of the body, options at the next block.
A wrapper that is only named so (a page layout "with-sidebar", an advert never closed) does not
hide the page's first article, and a page hidden altogether by names is read without them.

Defined results: null, empty or tag-only html gives an empty text; a page
without markup is one block; repeated rows are extracted each on their own;
other columns pass through untouched (a column named like an output column is
replaced). Python runs inside the tasks on one page at a time: no shuffle, no
state, memory bounded by one Arrow batch.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qamill.llm.common import table

# Element names.
BLOCK = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt
fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main
menu nav ol p pre section summary table tbody tfoot thead title tr ul""".split())
VOID = frozenset("""area base br col embed hr img input link meta param source track wbr""".split())
SILENT = frozenset("""script style noscript template head title svg math iframe object canvas audio
video select option datalist button textarea""".split())
BOILER_TAGS = frozenset("nav header footer aside form dialog menu fieldset".split())
BOILER_ROLES = frozenset("""navigation banner contentinfo complementary search form alert dialog
menu menubar alertdialog status""".split())
BOILER_WORDS = frozenset("""ad ads adv advert adverts advertisement advertising adsense banner
sponsor sponsored promo promotion sidebar sidebars menu nav navbar navigation breadcrumb breadcrumbs
header footer masthead cookie cookies consent gdpr notice notices alert alerts popup modal overlay
newsletter subscribe subscription signup login share sharing social related recommended comment
comments commentlist reply replies respond disqus widget toolbar pagination pager skip search
copyright""".split())
#: Boilerplate words that are topics too; they hide alone or beside words of the layout.
TOPIC_WORDS = frozenset("""banner promotion menu navigation header footer cookie cookies consent notice
notices alert alerts modal overlay login share sharing social related recommended widget toolbar
skip search copyright""".split())
LAYOUT_WORDS = frozenset("""and area articles bar block body box btn button buttons card cards
center close col column container content dialog entry field fixed form global group icon icons
info inline inner input item items js large left line link links list main media message mobile
module more outer page panel policy post posts primary right row section site small sticky
stories strip text title to toggle top bottom ui us warning wrap wrapper""".split())
QUOTE_WORDS = frozenset("quote blockquote pullquote epigraph".split())
COMMENT_WORDS = frozenset("comment comments commentlist reply replies respond disqus".split())
REGIONS = frozenset(("article", "main"))
CONTAINERS = frozenset(("article", "main", "body", "div", "section", "center"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
CLOSED_BY_BLOCK = frozenset(("p",))
HEAD_CONTENT = frozenset("base link meta noscript script style template title".split())
CHOICES = frozenset("select datalist optgroup option".split())

_WORD = re.compile(r"[a-z]+")
_WEIGHT = (0, 4, 3, 1)  # what a name does, weakest first


def named(value: str) -> int:
    """What a class or id does: 1 reader comments, 3 boilerplate, 4 doubtful, 0 nothing."""
    found = 0
    for name in value.lower().split():
        words = set(_WORD.findall(name))
        boiler = words & BOILER_WORDS
        if boiler & COMMENT_WORDS:
            return 1
        if boiler:
            sure = boiler - TOPIC_WORDS or words <= BOILER_WORDS | LAYOUT_WORDS
            found = 3 if sure else found or 4
    return found

#: Shares of the content lines' text: of an article against the richest one, of the articles
#: against the page, of the innermost container against the page.
PART = 0.2
HALF = 0.5
INNERMOST = 0.8


class _Lines(HTMLParser):
    """Turns parser events into lines: (text, tags, link chars, region, container, doubtful)."""

    def __init__(self, names: bool = True) -> None:
        super().__init__(convert_charrefs=True)
        self.names = names
        self.lines: list[tuple[str, int, int, int, int, bool]] = []
        # tag, hides (0, 1, 2 = headings show, 3 = by name alone, 4 = doubtful), region, container
        self.stack: list[tuple[str, int, int, int]] = []
        self.parents = [-1]  # of containers; 0 is the page
        self.text: list[str] = []
        self.tags = self.link = 0
        self.hidden = self.quiet = self.doubtful = self.a = self.regions = 0
        self.region, self.container = -1, 0

    def updatepos(self, i: int, j: int) -> int:
        return j  # line numbers are not needed

    def end_line(self) -> None:
        if self.text:
            line = " ".join("".join(self.text).split())
            if line:
                self.lines.append((line, max(1, self.tags), self.link, self.region, self.container,
                                   self.doubtful > 0))
            self.text = []
        self.tags = self.link = 0

    def hides(self, tag: str, attrs: list) -> int:
        if tag in SILENT:
            return 1
        if tag == "header" and self.region >= 0:
            return 2
        if tag in BOILER_TAGS:
            quote = tag == "aside" and any(name == "class" and value and not QUOTE_WORDS.isdisjoint(
                _WORD.findall(value.lower())) for name, value in attrs)
            return 0 if quote else 1
        if tag in ("body", "html", "article", "main") and not self.hidden:
            return 0
        found = 0
        for name, value in attrs:
            if not value:
                if name == "hidden":
                    return 1
            elif name in ("class", "id"):
                if self.names and not (name == "id" and tag in HEADINGS):
                    found = max(found, named(value), key=_WEIGHT.index)
                    if found in (1, 3):
                        return found
            elif name == "role":
                if value.lower() in BOILER_ROLES:
                    return 1
            elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
                return 1
            elif name == "style" and re.search(r"display\s*:\s*none", value.lower()):
                return 1
        return found

    def pop_to(self, index: int) -> None:
        while len(self.stack) > index:
            tag, hides, _, _ = self.stack.pop()
            self.hidden -= hides in (1, 3)
            self.quiet -= hides == 2
            self.doubtful -= hides == 4
            self.a -= tag == "a"
        self.region, self.container = self.stack[-1][2:] if self.stack else (-1, 0)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        block = tag in BLOCK
        if self.stack and self.stack[-1][0] == "head" and tag not in HEAD_CONTENT:
            self.pop_to(len(self.stack) - 1)
        if block:
            self.end_line()
            if tag != "hr":
                for k in range(len(self.stack) - 1, -1, -1):  # a list of choices holds no block
                    if self.stack[k][0] not in CHOICES:
                        self.pop_to(k + 1)
                        break
            for k in range(len(self.stack) - 1, -1, -1):  # an open paragraph ends here
                if self.stack[k][0] in CLOSED_BY_BLOCK or self.stack[k][0] == tag == "li":
                    self.pop_to(k)
                    break
                if self.stack[k][0] in BLOCK:
                    break
        self.tags += 1
        if tag in VOID:
            if not self.hidden:
                self.text.append(" ")
            return
        if tag in REGIONS and self.hidden and not self.regions \
                and not any(x[1] == 1 for x in self.stack):
            self.stack = [(x[0], 0 if x[1] == 3 else x[1], *x[2:]) for x in self.stack]
            self.hidden = 0
        if tag in REGIONS and self.doubtful and not self.hidden and self.region < 0:
            self.stack = [(x[0], 0 if x[1] == 4 else x[1], *x[2:]) for x in self.stack]
            self.doubtful = 0
        hides = self.hides(tag, attrs)
        self.hidden += hides in (1, 3)
        self.quiet += hides == 2
        self.doubtful += hides == 4
        self.a += tag == "a"
        if tag in REGIONS and not self.hidden and self.region < 0:
            self.region, self.regions = self.regions, self.regions + 1
        if tag in CONTAINERS:
            self.parents.append(self.container)
            self.container = len(self.parents) - 1
        self.stack.append((tag, hides, self.region, self.container))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag in VOID:
            self.handle_starttag(tag, attrs)
        else:
            self.handle_starttag(tag, attrs)
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.end_line()
        else:
            self.tags += 1
        if tag in ("td", "th") and not self.hidden:
            self.text.append(" ")
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                self.pop_to(k)
                break

    def handle_data(self, data: str) -> None:
        if self.stack and self.stack[-1][0] == "head" and not data.isspace():
            self.pop_to(len(self.stack) - 1)
        if self.hidden or (self.quiet and not any(x[0] in HEADINGS for x in self.stack)):
            return
        self.text.append(data)
        if self.a:
            self.link += len(data)


def smooth(values: list[float], sigma: float) -> list[float]:
    """Gaussian smoothing; the kernel is cut at three sigma and renormalised at the ends."""
    radius = max(1, round(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    both = np.convolve(values, kernel, "full")[radius:radius + len(values)]
    ends = np.convolve(np.ones(len(values)), kernel, "full")[radius:radius + len(values)]
    return (both / ends).tolist()


def threshold(values: list[float]) -> float:
    """Boundary of two-means clusters on a line (the least value when all agree)."""
    ordered = sorted(values)
    sums = list(accumulate(ordered, initial=0.0))
    n, lo, hi = len(ordered), ordered[0], ordered[-1]
    cut = lo
    while (new := (lo + hi) / 2) != cut:
        cut = new
        k = bisect_left(ordered, cut)
        if k in (0, n):
            break
        lo, hi = sums[k] / k, (sums[n] - sums[k]) / (n - k)
        if bisect_left(ordered, (lo + hi) / 2) == k:
            cut = (lo + hi) / 2
            break
    return cut


def chosen(lines: list[tuple], parents: list[int], content: list[bool]) -> list[str]:
    """Texts of the region that the content lines choose."""
    by_region: dict[int, int] = {}
    total = 0
    lines, content = zip(*[(x, keep) for x, keep in zip(lines, content) if keep or not x[5]])
    for (text, _, link, region, _, _), keep in zip(lines, content):
        size = max(1, len(text) - link) if keep else 0
        total += size
        if keep and region >= 0:
            by_region[region] = by_region.get(region, 0) + size
    if by_region:
        most = max(by_region.values())
        parts = {r for r, size in by_region.items() if size >= PART * most}
        if sum(by_region[r] for r in parts) >= HALF * total:
            return [x[0] for x in lines if x[3] in parts]
    mass = [0] * len(parents)
    for (text, _, link, _, box, _), keep in zip(lines, content):
        while keep and box >= 0:
            mass[box] += max(1, len(text) - link)
            box = parents[box]
    # containers are numbered in page order, so a later one is inside or beside
    best = max(k for k, m in enumerate(mass) if m >= INNERMOST * mass[0])
    inside = [False] * len(parents)
    for k, parent in enumerate(parents):
        inside[k] = k == best or (parent >= 0 and inside[parent])
    return [x[0] for x in lines if inside[x[4]]]


def main_text(html: str | None, sigma: float = 1.0) -> str:
    """The main text of one page, blocks joined by a line feed."""
    if not html:
        return ""
    for names in (True, False):
        parser = _Lines(names)
        parser.feed(html)
        parser.close()
        parser.end_line()
        if lines := parser.lines:
            break
    else:
        return ""
    smoothed = smooth([max(0, len(x[0]) - x[2]) / x[1] for x in lines], sigma)
    cut = threshold(smoothed)
    return "\n".join(chosen(lines, parser.parents, [v >= cut for v in smoothed]))


def extract(pages: DataFrame, html: str = "html", out: str = "text",
            sigma: float = 1.0) -> DataFrame:
    """``pages`` with the main text of ``html`` in ``out`` (never null)."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([main_text(x, sigma) for x in s], dtype=object)

    return pages.withColumn(out, run(F.col(html)))


def query(spark, sf_dir: str) -> DataFrame:
    """op1: main text of every page."""
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    done = extract(pages)
    return done.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
