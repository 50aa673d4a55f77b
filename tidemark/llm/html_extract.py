"""Main text of web pages by text-to-tag ratios.

The standard library's parser streams a page's events into lines, one per block of text, each with its
characters, its tags and the element that holds it.  The logarithm of a line's ratio of characters to
tags is smoothed over neighbouring lines with a Gaussian kernel, and a threshold between two clusters
of the smoothed values marks dense lines.  Dense lines decide the content region: the innermost element
that holds nearly all of their text.  Of the region, lines stay that are dense or lie in a dense cluster: directly in
an element with dense lines or, for what body holds directly, between dense lines.  Sparse lines outside go.

Markup informs in two ways.  What it declares to be something else (menus, adverts, comments and so
on) is no candidate.  Where the dense text lies in an article or main element, that element is the
region and the whole of it stays.  All steps take time in proportion to the page.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import raw_text

# What elements and names of classes say.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CONTAINERS = frozenset("html body div section article main td center table".split())
OTHER = frozenset("head title nav header footer aside form script style noscript template svg math iframe object button select option textarea dialog menu canvas audio video datalist".split())
PAGE = frozenset(["html", "body"])
LISTS = frozenset("ul ol dl".split())
HOLDERS = CONTAINERS | LISTS | frozenset("tr th tbody thead tfoot blockquote figure details fieldset address pre".split())
CLOSED_BY_THEMSELVES = frozenset("li dt dd tr td th option".split())
OTHER_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adbox adslot adsense sponsor sponsors sponsored promo promos promotion promotions"
    " nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager header masthead footer copyright colophon"
    " sidebar sidebars aside rail widget widgets related recommended recommendations trending popular"
    " notice notices cookie cookies consent gdpr alert alerts banner banners disclaimer popup modal overlay toast"
    " comment comments reply replies discussion disqus respond responses"
    " share sharing social subscribe subscription newsletter signup login search form".split()
)
OTHER_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
ARTICLE_ROLES = frozenset("main article".split())
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
NEGATED = frozenset("with has no without".split())


def declared_other(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
    """The element's tag, role, class or id says that it's no part of the article."""
    if tag in OTHER:
        return True
    for key, value in attrs:
        value = value or ""
        if key == "role" and value.strip().lower() in OTHER_ROLES or key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if key in ("class", "id") and tag not in ("html", "body", "article", "main") or key == "class" and tag == "article":
            for name in value.split():
                parts = [p.lower() for p in NAME.findall(name)]
                if any(p in OTHER_NAMES and not (k and parts[k - 1] in NEGATED) for k, p in enumerate(parts)):
                    return True
    return False


class Lines(HTMLParser):
    """``lines``: (text, tags, holder, characters in links).  Of the holders, which are numbered as they begin:
    ``parents``, ``begins`` (their first line), ``regions`` (may be the content region), ``articles``,
    ``wide`` (the page itself)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int]] = []
        self.parents, self.begins, self.regions, self.articles, self.wide = [-1], [0], [True], [False], [True]  # holder 0 is the page
        self.stack: list[tuple[str, int, bool]] = []  # tag, holder, declared other
        # where in the stack: each tag; blocks; elements that a block does not close from within; OTHER elements
        self.places: defaultdict[str, list[int]] = defaultdict(list)
        self.blocks: list[int] = []
        self.barriers: list[int] = []
        self.others: list[int] = []
        self.parts: list[str] = []
        self.tags = self.linked = 0

    def updatepos(self, i: int, j: int) -> int:
        return j  # line numbers aren't asked for

    def _end_line(self) -> None:
        if not self.parts:
            return
        text = " ".join("".join(self.parts).split())
        self.parts.clear()
        if text:
            _, holder, other = self.stack[-1] if self.stack else ("", 0, False)
            if not other:
                self.lines.append((text, self.tags, holder, self.linked))
            self.tags = 0
        self.linked = 0

    def _open(self, tag: str, holder: int, other: bool) -> None:
        k = len(self.stack)
        self.stack.append((tag, holder, other))
        self.places[tag].append(k)
        if tag not in INLINE:
            self.blocks.append(k)
        if tag in CONTAINERS or tag in OTHER or tag in LISTS:
            self.barriers.append(k)
        if tag in OTHER:
            self.others.append(k)

    def _close(self, n: int) -> None:
        """Ends the elements from place ``n`` on."""
        while len(self.stack) > n:
            k = len(self.stack) - 1
            self.places[self.stack.pop()[0]].pop()
            for marks in (self.blocks, self.barriers, self.others):
                if marks and marks[-1] == k:
                    marks.pop()

    def _cut(self, n: int) -> None:
        self._end_line()
        self._close(n)

    def _end_implied(self, tag: str) -> None:
        """Ends what the beginning of a block ends without saying so."""
        own = self.places[tag] if tag in CLOSED_BY_THEMSELVES else []
        if own and self.barriers and own[-1] == self.barriers[-1]:
            self._cut(own[-1])
        floor = self.barriers[-1] if self.barriers else -1
        for places in (self.places["p"], own):
            if places and places[-1] > floor:
                self._cut(places[bisect_right(places, floor)])

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        inline = tag in INLINE
        if not inline:
            if self.parts:
                self._end_line()
            self._end_implied(tag)
        self.tags += 1
        if tag in VOID:
            if tag == "br":
                self.parts.append(" ")
            return
        _, holder, other = self.stack[-1] if self.stack else ("", 0, False)
        hidden = other or tag in OTHER or bool(attrs) and declared_other(tag, attrs)
        if hidden and not other and inline:
            self._end_line()
        role = dict(attrs).get("role") if attrs else None
        article = tag in ("article", "main") or role in ARTICLE_ROLES
        if tag in HOLDERS or article:
            self.parents.append(holder)
            self.begins.append(len(self.lines))
            self.regions.append(tag in CONTAINERS or article)
            self.articles.append(article)
            self.wide.append(tag in PAGE)
            holder = len(self.parents) - 1
        self._open(tag, holder, hidden)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        inline = tag in INLINE
        if self.parts and not inline:
            self._end_line()
        self.tags += 1
        if not self.places[tag]:
            return
        k = self.places[tag][-1]
        if inline and self.blocks and self.blocks[-1] > k or tag not in CONTAINERS and tag not in OTHER and self.others and self.others[-1] > k:
            return  # a stray end inside another block
        if not inline or self.stack[k][2] and not (k and self.stack[k - 1][2]):
            self._cut(k)
        else:
            self._close(k)

    def handle_data(self, data: str) -> None:
        self.parts.append(data)
        if self.places["a"]:
            self.linked += len(data)

    def close(self) -> None:
        super().close()
        self._end_line()


def smoothed(values: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing; at the page's ends the kernel is cut and renormalised."""
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    here = slice(reach, reach + len(values))
    return np.convolve(values, kernel)[here] / np.convolve(np.ones(len(values)), kernel)[here]


def dense(values: np.ndarray, *, rounds: int = 20, apart: float = 1.0) -> np.ndarray:
    """Lines above the threshold between two clusters (midway between their means, by iteration).

    Clusters whose means are less than ``apart`` from each other are one: every line is dense.
    """
    low, high = values.min(), values.max()
    for _ in range(rounds):
        above = values >= (low + high) / 2
        if above.all() or not above.any():
            break
        new = values[~above].mean(), values[above].mean()
        if new == (low, high):
            break
        low, high = new
    return values >= (low + high) / 2 if high - low >= apart else np.ones(len(values), bool)


def ratios(page: Lines) -> np.ndarray:
    """Characters per tag of each line."""
    return np.array([len(t) / max(n, 1) for t, n, _, _ in page.lines])


def content(page: Lines, thick: np.ndarray, share: float) -> np.ndarray:
    """Which lines are content, given which are dense.

    Holders are numbered as they begin, so sums go up and marks go down in one pass over the numbers.
    """
    parents, n = page.parents, len(page.parents)
    within, first, last = [0] * n, [len(page.lines)] * n, [-1] * n  # dense characters; first, last dense line directly in a holder
    for i in np.flatnonzero(thick).tolist():
        text, _, h, _ = page.lines[i]
        within[h] += len(text)
        first[h], last[h] = min(first[h], i), i
    for h in range(n - 1, 0, -1):
        within[parents[h]] += within[h]

    def innermost(top: int, of: list[bool]) -> int:
        """The innermost of the holders marked in ``of`` with nearly all that ``top`` has: the last of a chain."""
        inside, chosen = [False] * n, top
        inside[top] = True
        for h in range(top + 1, n):
            if inside[parents[h]] and within[h] >= share * within[top] and within[h]:
                inside[h] = True
                if of[h]:
                    chosen = h
        return chosen

    articles = [h for h in range(n) if page.articles[h] and within[h]]
    chosen = innermost(max(articles, key=lambda h: (within[h], -h)), page.articles) if articles else innermost(0, page.regions)
    inside, between = [False] * n, [False] * n
    inside[chosen] = True
    for h in range(chosen + 1, n):
        up = parents[h]
        if up >= 0 and inside[up]:
            inside[h] = True
            between[h] = between[up] or first[up] < page.begins[h] <= last[up]
    if page.articles[chosen]:
        return np.array([inside[h] for _, _, h, _ in page.lines])

    def stays(i: int, text: str, h: int, linked: int) -> bool:
        if not inside[h] or thick[i]:
            return inside[h]
        if last[h] >= 0 and not page.wide[h]:
            return True
        return (between[h] or first[h] < i < last[h]) and 2 * linked < len(text)

    return np.array([stays(i, t, h, linked) for i, (t, _, h, linked) in enumerate(page.lines)])


def main_text(html: str, *, sigma: float = 1.0, share: float = 0.8) -> str:
    """The article's blocks, joined by one space."""
    page = Lines()
    page.feed(html)
    page.close()
    if not page.lines:
        return ""
    thick = dense(smoothed(np.log1p(ratios(page)), sigma))
    return " ".join(t for (t, _, _, _), kept in zip(page.lines, content(page, thick, share), strict=True) if kept)


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A row per page: id, url, ``text``, ``n_chars``.

    The whole html is parsed.  Null or empty html, and pages without text, have an empty text; invalid
    UTF-8 is replaced.  Repeated rows and null ids stay; other columns are not read.  An empty table
    gives no rows.
    """
    kind = lambda c: pages.schema[c].dataType.simpleString()
    schema = f"{id_col} {kind(id_col)}, {url_col} {kind(url_col)}, text string, n_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(raw.as_py().decode("utf-8", "replace")) for raw in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    return pages.select(F.col(id_col), F.col(url_col), raw_text(html_col).alias("html")).mapInArrow(run, schema)
