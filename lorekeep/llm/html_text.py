"""Main text of web pages, from streaming parser events and text-to-tag ratios.

The standard library's parser turns a page into elements (with the end tags that HTML leaves out) and lines: runs of text
between block boundaries, each with its number of tags and its share of link text. Text that no reader sees as text (scripts,
styles, controls, hidden parts) makes no lines. The text-to-tag ratios of the lines (link text counts as none) are smoothed
by a Gaussian; lines whose smoothed ratio reaches a threshold (mean less half a deviation) are the content cluster, and an
element's mass is the text of the cluster in it.

An element is boilerplate if it is a menu, sidebar, footer, page header or form, if a class, id or role names it so, or if it
is a list of links (three or more that make up most of its text) outside an article and not between paragraphs. Names count
by whole tokens, or as parts joined by ``-`` or ``_`` if no part turns the meaning round (``no-sidebar``, ``with-related``); a
paragraph between others is only taken for an advert or a comment by its name. Reader comments are told by their build as well: two or more
siblings of one kind after other text, without headings, each short and with a name and a date. Except for comments and
menus, what holds the ``article`` or ``main`` of most mass, or most of the page's mass, is no boilerplate whatever its name.
If nothing is left, names do not count.

If the page has one outermost ``article`` or ``main`` outside the boilerplate, only what is in it counts, however much stands
beside it. The region is the smallest element with ``SHARE`` of the mass that is left, widened to the outermost ``main`` or
``article`` around it; of a region that holds articles with that share beside other things, the articles. All its lines
outside the boilerplate are the main text, in page order, short ones and links included, and so is the top heading before it.

Defined results: null, empty and textless pages give an empty string; a tag cut off at the end of a page and a comment that is
never closed are dropped; the time grows with the page's length, however deep its elements are nested; repeated
rows give equal results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements without text of the page.
SILENT = frozenset("script style template noscript link meta".split())
UNREAD = frozenset("script style noscript template head title button select option optgroup datalist textarea input iframe object embed svg canvas audio video map dialog menu".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
ARTICLE = frozenset(("article", "main"))
#: Elements that are boilerplate by themselves; the first ones whatever they hold.
MENUS, FRAMES = frozenset(("nav", "aside", "footer")), frozenset(("header", "form"))
#: Words of class, id or role that mark what is not the article; the first ones whatever the element holds.
COMMENTS = frozenset("comment comments comentarios disqus discussion reply replies respond responses".split())
ADVERTS = frozenset("ad ads advert adverts advertisement advertising promo promoted sponsor sponsored".split())
MARKS = COMMENTS | frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs consent cookie cookies disclaimer foot footer header masthead menu modal nav navbar navigation newsletter "
    "notice notification pagination pager popup promo promoted recommended related share sharing sidebar social sponsor sponsored subscribe toolbar widget widgets complementary contentinfo search alert".split()
)
#: Words beside a mark that turn its meaning round.
TURNED = frozenset("no not non with without has have free off open closed enabled disabled hide hides inside layout default".split())
#: What a start tag ends if it is open: the elements, and those that they are looked for within.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tr": (("tr",), ("table",)),
    "tbody": (("thead", "tbody", "tfoot"), ("table",)),
    "tfoot": (("thead", "tbody"), ("table",)),
    "option": (("option",), ("select", "datalist")),
}
#: Elements over which an end tag of another one does not reach.
CELLS = frozenset(("td", "th", "table", "caption"))
PARTS, TOKEN = re.compile(r"[A-Za-z0-9]+"), re.compile(r"\S+")
CUT_OFF = re.compile(r"<[A-Za-z/!?][^<>]*\Z")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
RAW_TEXT = re.compile(r"<(script|style|textarea|title)\b", re.I)
#: What names and dates of comments are marked by.
NAMES, DATES = frozenset("author byline name nick nickname user username who".split()), frozenset("ago date datetime posted time timestamp when".split())
DATE = re.compile(r"\b(?:\d{1,2}[./ -](?:\d{1,2}|[A-Za-z]{3,9})[./ -]\d{2,4}|\d{4}-\d\d-\d\d|[A-Za-z]{3,9} \d{1,2}, \d{4}|\d+ \w+ ago)\b")
HEADINGS = frozenset(("h1", "h2", "h3", "h4"))
#: Characters of a comment, at most on average.
COMMENT = 800
WRAPPERS = ARTICLE | frozenset(("#page", "html", "body", "div", "section", "td"))
SIGMA, SHARE, LINKS = 1.0, 0.9, 0.7


def named(value: str, marks: frozenset[str]) -> bool:
    """Whether one of the tokens of a class, id or role is a mark."""
    for token in TOKEN.findall(value.lower()):
        parts = PARTS.findall(token)
        if token in marks or not marks.isdisjoint(parts) and TURNED.isdisjoint(parts):
            return True
    return False


class Page(HTMLParser):
    """The page's elements and lines.

    tags, parents: name and parent's number of each element, 0 being the whole page; kinds: 2 for comments and menus, 1 for
    other boilerplate, 0 for the rest; by_name: whether only a name says so; lines: (text, tags, link characters, element).
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tags, self.parents, self.kinds, self.by_name = ["#page"], [-1], [0], [0]
        self.links: list[int] = [0]
        self.builds: list[tuple] = [("#page", "")]
        self.who, self.dated = [False], [False]
        self.lines: list[tuple[str, int, int, int]] = []
        self.stack: list[int] = [0]
        self.places: dict[str, list[int]] = {}  # of each tag, where it is in the stack
        self.blocks: list[int] = [0]  # where the stack has elements that are not inline
        self.parts: list[str] = []
        self.seen = self.linked = self.unread = self.anchors = 0

    def end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append((text, self.seen, self.linked, self._block()))
            self.seen = 0
        self.parts.clear()
        self.linked = 0

    def _block(self) -> int:
        return self.stack[self.blocks[-1]]

    def _last(self, names: frozenset[str] | tuple[str, ...]) -> int:
        """The highest place of the stack that has one of the names; -1: none."""
        return max((self.places[x][-1] for x in names if self.places.get(x)), default=-1)

    def _pop(self, at: int) -> None:
        """Ends the open elements from the place at of the stack on."""
        for e in reversed(self.stack[at:]):
            self.unread -= self.kinds[e] == 3
            self.anchors -= self.tags[e] == "a"
            self.places[self.tags[e]].pop()
        while self.blocks[-1] >= at:
            self.blocks.pop()
        del self.stack[at:]

    def _end(self, names: tuple[str, ...], within: frozenset[str] | tuple[str, ...]) -> None:
        at = self._last(names)
        if at > self._last(within):
            self._pop(at)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.seen += 1
        if tag not in INLINE and tag not in SILENT:
            self.end_line()
            if tag not in UNREAD:
                self._end(("p",), CELLS)
        elif tag == "br":
            self.parts.append(" ")
        if tag in ENDS:
            self._end(*ENDS[tag])
        elif tag == "a":
            if (at := self._last(("a",))) > self.blocks[-1]:  # links do not nest
                self._pop(at)
            self.links[self._block()] += 1
        if tag in VOID:
            return
        kind, by_name = self._kind(tag, attrs)
        self.tags.append(tag)
        self.parents.append(self.stack[-1])
        self.kinds.append(kind)
        self.by_name.append(by_name)
        self.links.append(0)
        words = {w for name, value in attrs if name in ("class", "itemprop") and value for w in PARTS.findall(value.lower())}
        self.builds.append((tag, next((v for name, v in attrs if name == "class"), None)))
        self.who.append(not words.isdisjoint(NAMES))
        self.dated.append(tag == "time" or not words.isdisjoint(DATES))
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag not in INLINE:
            self.blocks.append(len(self.stack))
        self.stack.append(len(self.tags) - 1)
        self.unread += kind == 3
        self.anchors += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # HTML has no such tags but for void elements

    @staticmethod
    def _kind(tag: str, attrs: list) -> tuple[int, int]:
        """(3 unread, 2 comments or menu, 1 other boilerplate, 0 none; 1 if by name only, 2 if so and it may be a paragraph)."""
        if tag in UNREAD:
            return 3, 0
        kind = 2 if tag in MENUS else 1 if tag in FRAMES else 0
        by_name = 0
        for name, value in attrs:
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and value and HIDDEN.search(value):
                return 3, 0
            if kind < 2 and name in ("class", "id", "role") and value and tag not in ARTICLE and tag not in ("html", "body"):
                found = 2 if named(value, COMMENTS) else 1 if named(value, MARKS) else 0
                if found > kind:
                    by_name = 2 if tag == "p" and found == 1 and not named(value, ADVERTS) else 1
                kind = max(kind, found)
        return kind, by_name

    def handle_endtag(self, tag: str) -> None:
        self.seen += 1
        if tag in INLINE:
            if (at := self._last((tag,))) > self.blocks[-1]:
                self._pop(at)
            return
        if tag in SILENT:
            self._end((tag,), ())
            return
        self.end_line()
        if tag in ("html", "body"):  # what follows is still of the body
            return
        names = ("h1", "h2", "h3", "h4", "h5", "h6") if tag in ("h1", "h2", "h3", "h4", "h5", "h6") else (tag,)
        self._end(names, () if tag in CELLS else CELLS)

    def handle_data(self, data: str) -> None:
        if not self.unread:
            self.parts.append(data)
            if self.anchors:
                self.linked += len(data)


def cluster(lines: list[tuple[str, int, int, int]]) -> np.ndarray:
    """True for the lines whose smoothed text-to-tag ratio reaches the threshold."""
    ratio = np.array([max(0, len(t) - links) / max(1, tags) for t, tags, links, _ in lines])
    reach = np.arange(-3, 4)
    kernel = np.exp(-0.5 * (reach / SIGMA) ** 2)
    smooth = np.convolve(np.pad(ratio, 3, mode="edge"), kernel / kernel.sum(), mode="valid")
    return smooth >= smooth.mean() - 0.5 * smooth.std()


def sums(page: Page, values: dict[int, float] | list[float]) -> np.ndarray:
    """Of each element, the values of it and of all elements in it. Parents come before their children."""
    total = np.zeros(len(page.tags))
    for e, v in values.items() if isinstance(values, dict) else enumerate(values):
        total[e] += v
    for e in range(len(page.tags) - 1, 0, -1):
        total[page.parents[e]] += total[e]
    return total


def reader_comments(page: Page, lines: list[tuple[str, int, int, int]], text: np.ndarray, inside: np.ndarray) -> list[int]:
    """The elements that are reader comments by their build."""
    heads = sums(page, [float(t in HEADINGS) for t in page.tags])
    who, when = [float(x) for x in page.who], [float(x) for x in page.dated]
    for t, _, _, e in lines:
        when[e] += DATE.search(t[:200]) is not None
    first = {}
    for e in range(len(page.tags) - 1, 0, -1):
        first[page.parents[e]] = e
    for e in range(len(page.tags) - 1, 0, -1):  # a block that begins with a short name in bold or as a link
        f = first.get(e)
        while f is not None and page.tags[f] not in INLINE and f in first:
            f = first[f] if page.tags[first[f]] in INLINE else None
        who[e] += f is not None and page.tags[f] in ("a", "b", "strong", "cite")
    who, when = sums(page, who), sums(page, when)
    start = {}  # of each element, its first line
    for k, (*_, e) in enumerate(lines):
        while e >= 0 and e not in start:
            start[e] = k
            e = page.parents[e]
    before = np.concatenate(([0], np.cumsum([t not in HEADINGS and (near or t == "p") for near, t in zip(inside, (page.tags[e] for *_, e in lines))])))
    groups: dict[tuple, list[int]] = {}
    for e in range(1, len(page.tags)):
        if page.tags[e] not in INLINE and text[e] > 0:
            groups.setdefault((page.parents[e], *page.builds[e]), []).append(e)
    out = []
    for kind, same in groups.items():
        if len(same) < 2 or kind[1] in ("td", "th", "tr") or any(heads[e] for e in same):
            continue
        if all(who[e] and when[e] for e in same) and sum(text[e] for e in same) <= COMMENT * len(same) and before[start[same[0]]] > 0:
            out += same
    return out


def content(page: Page) -> list[str]:
    """The texts of the main region's lines."""
    lines = page.lines
    if not lines:
        return []
    inside = cluster(lines)
    text, linked, mass = {}, {}, {}
    for (t, _, links, e), near in zip(lines, inside):
        text[e] = text.get(e, 0) + len(t)
        linked[e] = linked.get(e, 0) + min(links, len(t))
        mass[e] = mass.get(e, 0) + (max(0, len(t) - links) if near else 0)
    text, linked, every = sums(page, text), sums(page, linked), sums(page, mass)
    anchors = sums(page, page.links)
    for e in reader_comments(page, lines, text, inside):
        page.kinds[e], page.by_name[e] = 2, 0
    # the article or main element of most mass outside comments and menus, and all that holds it
    shut = np.zeros(len(page.tags), bool)
    for e in range(1, len(page.tags)):
        shut[e] = shut[page.parents[e]] or page.kinds[e] >= 2
    chief = max((e for e in range(1, len(page.tags)) if page.tags[e] in ARTICLE and not shut[e]), key=lambda e: every[e], default=0)
    holds = {0}
    while chief > 0:
        holds.add(chief)
        chief = page.parents[chief]

    tops = np.array([near and page.tags[e] not in HEADINGS for near, (*_, e) in zip(inside, lines)])
    first_line, last_line = {}, {}
    for k, (*_, e) in enumerate(lines):
        while e >= 0 and e not in first_line:
            first_line[e] = k
            e = page.parents[e]
    for k in range(len(lines) - 1, -1, -1):
        e = lines[k][3]
        while e >= 0 and e not in last_line:
            last_line[e] = k
            e = page.parents[e]

    def between(e: int, any_: bool = False) -> bool:
        """Whether paragraphs of the cluster (any_: or others without a name), siblings of e, stand right before and after it."""
        if e not in first_line:
            return False
        a, b = first_line[e] - 1, last_line[e] + 1
        beside = lambda k: 0 <= k < len(lines) and (tops[k] or any_) and page.parents[lines[k][3]] == page.parents[e] and page.tags[lines[k][3]] == "p" and not page.kinds[lines[k][3]]
        return beside(a) and beside(b)

    def off(names: bool) -> np.ndarray:
        """Of each element, whether it is or lies in boilerplate. names: whether those marked only by name count."""
        out, in_article = np.zeros(len(page.tags), bool), np.zeros(len(page.tags), bool)
        for e in range(1, len(page.tags)):
            p, kind = page.parents[e], page.kinds[e]
            in_article[e] = in_article[p] or page.tags[e] in ARTICLE
            if page.tags[e] == "header" and not page.by_name[e] and in_article[p] or page.by_name[e] and not names:
                kind = 0
            if page.by_name[e] == 2 and kind == 1 and between(e, True):
                kind = 0
            needed = e in holds or 2 * every[e] > every[0]
            if kind == 1 and needed:
                kind = 0
            if not kind and not needed and not in_article[e] and page.tags[e] not in INLINE:
                kind = int(anchors[e] >= 3 and linked[e] > LINKS * text[e] and not between(e))
            out[e] = out[p] or kind > 0
        return out

    for names in (True, False):
        out = off(names)
        left = [not out[e] for *_, e in lines]
        if any(left):
            break
    else:
        return []
    outer = np.zeros(len(page.tags), int)  # the outermost article or main around each element, 0: none
    for e in range(1, len(page.tags)):
        outer[e] = outer[page.parents[e]] or (e if page.tags[e] in ARTICLE else 0)
    if len({int(outer[e]) for (*_, e), stays in zip(lines, left) if stays} - {0}) == 1:
        only = next(int(outer[e]) for (*_, e), stays in zip(lines, left) if stays and outer[e])
        if any(stays and outer[e] == only and page.tags[e] not in HEADINGS for (*_, e), stays in zip(lines, left)):
            left = [stays and (outer[e] == only or page.tags[e] == "h1") for (*_, e), stays in zip(lines, left)]
    mass = {}
    for (t, _, links, e), near, stays in zip(lines, inside, left):
        if stays:
            mass[e] = mass.get(e, 0) + (max(0, len(t) - links) if near and (outer[e] or page.tags[e] != "h1") else 0)
    if not sum(mass.values()):  # only links or lines outside the cluster are left: all text counts
        mass = {}
        for (t, *_, e), stays in zip(lines, left):
            mass[e] = mass.get(e, 0) + (len(t) if stays else 0)
    mass = sums(page, mass)
    region = 0
    children: list[list[int]] = [[] for _ in page.tags]
    for e in range(1, len(page.tags)):
        children[page.parents[e]].append(e)
    while True:
        best = max(children[region], key=lambda e: mass[e], default=None)
        if best is None or mass[best] < SHARE * mass[0] or page.tags[best] in INLINE:
            break
        region = best
    around = region
    while around > 0:
        if page.tags[around] in ARTICLE:
            region = around
        around = page.parents[around]
    while page.tags[region] not in WRAPPERS:
        region = page.parents[region]  # a lone paragraph or list: what stands around it belongs to it
    within, inner = np.zeros(len(page.tags), bool), np.zeros(len(page.tags), bool)
    within[region] = True
    for e in range(region + 1, len(page.tags)):
        within[e] = within[page.parents[e]]
        inner[e] = inner[page.parents[e]] or within[e] and page.tags[e] in ARTICLE
    if page.tags[region] not in ARTICLE and sum(mass[e] for e in range(len(inner)) if inner[e] and not inner[page.parents[e]]) >= SHARE * mass[0]:
        within = inner
    first = next((k for k, (*_, e) in enumerate(lines) if within[e] and left[k]), len(lines))
    top = max((k for k in range(first) if left[k] and page.tags[lines[k][3]] == "h1"), default=-1)
    return [t for k, (t, *_, e) in enumerate(lines) if left[k] and (within[e] or k == top)]


def without_open_comment(html: str) -> str:
    """The page up to a comment that is never closed."""
    at = html.find("<!--", html.rfind("-->") + 3 if "-->" in html else 0)
    if at < 0:
        return html
    raw = None
    for raw in RAW_TEXT.finditer(html, 0, at):
        pass
    inside = raw is not None and html.lower().find(f"</{raw[1].lower()}", raw.end(), at) < 0
    return html if inside else html[:at]


def main_text(html: str | None) -> str:
    if not html:
        return ""
    page = Page()
    page.feed(CUT_OFF.sub("", without_open_comment(html)))
    page.close()
    page.end_line()
    return " ".join(content(page))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
