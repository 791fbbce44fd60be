"""Main text of web pages by line-block distribution.

Markup is stripped, each block of text on a line of its own. Characters count if they stand in no link; elements that are never
article text, by name or by the words of their class, id or role, become empty lines. The counts summed over windows of lines
rise where text begins (a surge) and are zero where it ends (a dive): the lines from dive to dive around a surge are a
stretch. The stretch with the most text is the article, with other text within its element up to the last dive.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches

WINDOW = 3
#: A window surges at this share of the mean of the windows with text, or at this many characters.
SURGE_SHARE, SURGE_CHARS = 0.5, 120

# Elements by what HTML says of them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template xmp iframe noembed noframes".split())
LEFT_OUT = frozenset(
    "script style noscript template head title nav header footer aside form button select option textarea input label fieldset iframe object svg canvas audio video map menu dialog datalist".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
ENDS_PARAGRAPH = BLOCKS - {"body", "html", "caption", "td", "th", "tr", "tbody", "thead", "tfoot"}
#: Words of a class, id or role that say an element is no article text.
ASIDES = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar aside rail widget widgets header masthead footer comment comments disqus reply replies respond discussion feedback notice notices cookie cookies consent gdpr popup modal overlay subscribe subscription newsletter signup login share sharing social related recommended recommendations pagination pager toolbar contentinfo complementary search skip copyright legal disclaimer tags outbrain taboola".split()
)
#: Elements that hold the article itself, whatever their class says.
CONTAINERS = frozenset("html body main article".split())

ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
#: Elements that hold the article; within them, only whole names count, and no ids or classes of what is text by its element.
ARTICLES = frozenset("main article".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TEXTS = HEADINGS | {"section", "p"}
WORDS = re.compile(r"[a-z]+")
#: The name here of an `a` element that is a link.
LINK = "a href"
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
PLAIN = re.compile(r"[^>\"']*")
# What ends an open element: elements of these names, unless one of the limits is nearer.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th")}
LIMITS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}


def sidelined(name: str, attributes: str, within: bool = False) -> bool:
    """Whether an element is no article text, by its name or attributes; within: it stands in an element that holds the article."""
    if name in LEFT_OUT:
        return True
    if not attributes or name in ("html", "body"):
        return False
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if key not in ("class", "id", "role") or name in CONTAINERS or key == "id" and name in HEADINGS or within and key != "role" and name in TEXTS:
            continue
        if not ASIDES.isdisjoint(value.split() if within else WORDS.findall(value)):
            return True
    return False


def tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """Pieces of a page in order: (text, "", "") or ("", name, attributes), the name of an end tag with a / in front.

    Every character is passed over a bounded number of times: a tag whose quotes never close ends the reading of quotes.
    """
    at, size, quotes = 0, len(html), True
    while at < size:
        begin = html.find("<", at)
        if begin < 0:
            yield html[at:], "", ""
            return
        if begin > at:
            yield html[at:begin], "", ""
        if html.startswith("<!--", begin):
            end = html.find("-->", begin + 4)
            at = size if end < 0 else end + 3
            continue
        ending = html.startswith("/", begin + 1)
        name = NAME.match(html, begin + 1 + ending)
        if name is None:
            if html[begin + 1 : begin + 2] in ("!", "?", "/"):
                end = html.find(">", begin)
                at = size if end < 0 else end + 1
            else:
                yield "<", "", ""
                at = begin + 1
            continue
        end = tag_end(html, name.end()) if quotes else -1
        if end < 0:
            quotes, end = False, html.find(">", name.end())
            if end < 0:  # an unfinished tag
                return
        at = end + 1
        lower = name[0].lower()
        yield "", "/" * ending + lower, html[name.end() : end]
        if not ending and lower in RAW:
            close = re.compile(rf"</{re.escape(lower)}\b[^>]*>", re.I).search(html, at)
            if lower not in LEFT_OUT:
                yield html[at : close.start() if close else size], "", ""
            at = close.end() if close else size
            yield "", f"/{lower}", ""


def tag_end(html: str, at: int) -> int:
    """Where the > of a tag stands, outside of quotes; -1 if nowhere."""
    while True:
        at = PLAIN.match(html, at).end()
        if at >= len(html):
            return -1
        if html[at] == ">":
            return at
        at = html.find(html[at], at + 1) + 1
        if not at:
            return -1


@dataclass
class Line:
    text: str
    weight: int  # characters outside of links; all of a heading
    element: int  # the block element around it


class Page:
    """The lines of a page, and its block elements: the element around each, and the last element that begins within it."""

    def __init__(self, html: str) -> None:
        self.lines: list[Line] = []
        self.parent, self.last = [0], [0]
        self._stack: list[tuple[str, int]] = []  # open elements and their numbers (0 for those without one); "" once closed
        self._open: dict[str, list[int]] = {}  # places in the stack by name
        self._blocks: list[int] = []  # places of block elements
        self._element, self._skip = 0, -1  # the innermost numbered element; the place where one that is left out began
        self._text: list[str] = []
        self._linked, self._links, self._inside = 0, 0, 0  # characters in links; open links; open elements that hold an article
        for text, name, attributes in tokens(html):
            if text:
                if self._skip < 0:
                    self._text.append(text)
                    if self._links:
                        self._linked += len(text)
            elif name.startswith("/"):
                self._end(name[1:])
            else:
                self._begin(name, attributes)
        self._close(0)
        self._flush()

    def _flush(self, heading: bool = False) -> None:
        if self._text:
            raw = "".join(self._text)
            line = " ".join(unescape(raw).split())
            if line:
                weight = len(line) if heading or self._linked < 0.9 * len(raw) else 0
                self.lines.append(Line(line, weight, self._element))
            self._text, self._linked = [], 0

    def _nearest(self, names: Iterable[str]) -> int:
        return max((self._open[n][-1] for n in names if self._open.get(n)), default=-1)

    def _begin(self, name: str, attributes: str) -> None:
        if name in VOID:
            if name == "br":
                self._text.append(" ")
            elif name == "hr" and self._skip < 0:
                self._flush()
            return
        if name in ENDS:
            same = self._nearest(ENDS[name])
            if same > self._nearest(LIMITS[name]):
                self._close(same)
        if name in ENDS_PARAGRAPH and self._blocks and self._stack[self._blocks[-1]][0] == "p":
            self._close(self._blocks[-1])
        if name == "a":
            if self._links:
                self._end("a")
            if "href" in attributes.lower():
                name = LINK
        block = name in BLOCKS
        if block and self._skip < 0:
            self._flush()
        if attributes.rstrip().endswith("/") and not block:
            return
        place, number = len(self._stack), 0
        if self._skip < 0 and sidelined(name, attributes, self._inside > 0):
            if block:
                self.lines += [Line("", 0, self._element)] * WINDOW
            self._skip = place
        if block:
            self._blocks.append(place)
            if name not in ("html", "body"):
                number = len(self.parent)
                self.parent.append(self._element)
                self.last.append(number)
                self._element = number
        self._inside += name in ARTICLES
        self._links += name == LINK
        self._stack.append((name, number))
        self._open.setdefault(name, []).append(place)

    def _end(self, name: str) -> None:
        place = self._nearest([name, LINK] if name == "a" else [name])
        if place < 0:
            if name == "p" and self._skip < 0:
                self._flush()
        elif name in BLOCKS or not self._blocks or self._blocks[-1] < place:
            self._close(place)
        elif self._skip != place:  # an inline element closed across blocks
            name = self._stack[place][0]
            self._stack[place] = ("", 0)
            self._open[name].pop()
            self._links -= name == LINK

    def _close(self, place: int) -> None:
        """Closes all elements from a place of the stack on."""
        while len(self._stack) > place:
            name, number = self._stack.pop()
            here = len(self._stack)
            if name and self._open[name][-1:] == [here]:
                self._open[name].pop()
            if self._blocks and self._blocks[-1] == here:
                if self._skip < 0:
                    self._flush(name in HEADINGS)
                self._blocks.pop()
            if number:
                self.last[number] = len(self.parent) - 1
                self._element = self.parent[number]
            self._inside -= name in ARTICLES
            self._links -= name == LINK
            if self._skip >= here:
                self._skip = -1

    def holds(self, element: int, line: Line) -> bool:
        return not element or element <= line.element <= self.last[element]

    def joins(self, at: int, element: int) -> bool:
        """Whether a line without weight belongs to an element: it has text, and no window around it is all links."""
        near = self.lines[max(0, at - WINDOW + 1) : at + WINDOW]
        links = sum(bool(line.text) and not line.weight and self.holds(element, line) for line in near)
        return bool(self.lines[at].text) and element > 0 and self.holds(element, self.lines[at]) and links < WINDOW

    def around(self, lines: list[Line]) -> int:
        """The innermost element that holds all lines, 0 for the body."""
        found = lines[0].element if lines else 0
        for line in lines:
            while not self.holds(found, line):
                found = self.parent[found]
        return self.parent[found] if len(lines) == 1 else found


def windows(weights: list[int], window: int = WINDOW) -> list[int]:
    """The characters of the window that ends at each line; behind the last line, lines are empty."""
    sums = np.concatenate([np.zeros(window, np.int64), np.cumsum([*weights, *[0] * (window - 1)])])
    return (sums[window:] - sums[:-window]).tolist()


def runs(weights: list[int], window: int = WINDOW) -> list[tuple[int, int, int]]:
    """First and last line of each run of text, from where windows leave zero to where they are zero again, and its largest window."""
    sums = windows(weights, window)
    out, i = [], 0
    while i < len(sums):
        start = i
        while i < len(sums) and sums[i]:
            i += 1
        if i > start:
            out.append((start, i - window, max(sums[start:i])))
        i += i == start
    return out


def stretches(weights: list[int], window: int = WINDOW) -> list[tuple[int, int]]:
    """The runs in which a window surges."""
    some = [s for s in windows(weights, window) if s]
    level = min(SURGE_CHARS, SURGE_SHARE * sum(some) / max(1, len(some)))
    return [(start, end) for start, end, most in runs(weights, window) if most >= level]


def main_text(html: str | None) -> str:
    """The article of a page: its blocks in page order, joined by two line feeds; empty if there is none."""
    page = Page(html or "")
    weights = [line.weight for line in page.lines]
    found = stretches(weights)
    if not found:
        return ""
    article = first, last = max(found, key=lambda s: sum(weights[s[0] : s[1] + 1]))
    element = page.around([line for line in page.lines[first : last + 1] if line.weight])
    # What else the element holds is interrupted text: a dive at an advert does not end the article. The body holds all else too.
    for start, end in [r[:2] for r in runs(weights)] if element else found:
        if (end < article[0] or start > article[1]) and all(page.holds(element, line) for line in page.lines[start : end + 1] if line.weight):
            first, last = min(first, start), max(last, end)
    # Lines next to the ends that are all link: fewer than would make a window of no text.
    for _ in range(WINDOW - 1):
        first -= first > 0 and page.joins(first - 1, element)
        last += last + 1 < len(page.lines) and page.joins(last + 1, element)
    return "\n\n".join(line.text for line in page.lines[first : last + 1] if line.text)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html).

    Null, empty and textless pages give an empty text. Broken markup is read as far as it goes. Repeated rows repeat; nulls in
    page_id and url are kept; an empty table gives no rows; more columns are ignored. Nothing is cut by length.
    """

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(h) for h in batch.column("html").to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column("page_id").cast(pa.int64()), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"]
        )

    return map_batches(pages.select("page_id", "url", "html"), one, "page_id bigint, url string, text string, n_chars bigint")
