"""HTML as blocks with inline markup.

The parser keeps one stack of open elements; what an element means for the text within it (hidden, list, quote, cell, code) is
looked up there, so that an element that is left out hides exactly its own content.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable
from html import unescape
from html.parser import HTMLParser

from .builder import Book, marked, tidy, title_text

# What elements mean.
HIDDEN = frozenset("script style head title nav noscript template rt rp".split())
CODE = frozenset("code kbd samp tt var".split())
BOLD, ITALIC = frozenset("b strong".split()), frozenset("i em cite dfn".split())
BLOCKS = frozenset(
    "p div section article header footer aside main body li dd dt blockquote figure figcaption td th tr table pre ul ol dl hr br h1 h2 h3 h4 h5 h6 caption center address".split()
)
VOID = frozenset("area base br col embed hr img image input link meta source track wbr".split())
HEADING = re.compile(r"h([1-6])")
LINKED = re.compile(r"(?:https?|mailto|ftp):")


def finished(text: str) -> str:
    """Inline markup without empty code, bold and links."""
    text = re.sub(r"``|\*\*\s*\*\*", "", text)
    return tidy(re.sub(r"\[\s*\]\([^)]*\)", "", text))


class Parser(HTMLParser):
    def __init__(self, book: Book, chapter_level: int, image: Callable[[str], str | None]) -> None:
        super().__init__(convert_charrefs=True)
        self.book, self.chapter_level, self.image = book, chapter_level, image
        self.open: list[str] = []
        self.hidden_at: int | None = None
        self.text: list[str] = []
        self.tables: list[dict] = []
        self.links: list[str | None] = []
        self.heading: int | None = None

    # What the open elements say.
    def inside(self, names: frozenset | set | str) -> bool:
        return any(n in names if not isinstance(names, str) else n == names for n in self.open)

    @property
    def lists(self) -> list[str]:
        return [n for n in self.open if n in ("ul", "ol")]

    @property
    def cell(self) -> bool:
        return bool(self.tables) and self.tables[-1]["cell"]

    def emit(self) -> None:
        """The text so far as a block of the kind that the open elements say."""
        if self.cell:
            self.text.append(" ")
            return
        text, self.text = finished("".join(self.text)), []
        if not text:
            return
        if self.heading is not None:
            if self.heading <= self.chapter_level:
                self.book.open_chapter(title_text(text))
            else:
                self.book.add("heading", level=self.heading, text=text)
        elif self.inside("figcaption"):
            self.book.add("caption", text=text)
        elif self.lists:
            self.book.add("item", text=text, ordered=self.lists[-1] == "ol", depth=len(self.lists) - 1)
        else:
            self.book.add("quote" if self.inside("blockquote") else "para", text=text)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        given = {k: v or "" for k, v in attrs}
        if tag in BLOCKS and tag not in ("br", "tr", "td", "th") and self.hidden_at is None and not self.inside("pre"):
            self.emit()  # while the open elements are still those of the text
        if tag not in VOID:
            self.open.append(tag)
        if self.hidden_at is not None:
            return
        if tag in HIDDEN or "hidden" in given or "display:none" in given.get("style", "").replace(" ", "").lower():
            if tag not in VOID:
                self.hidden_at = len(self.open) - 1
            return
        if self.inside("pre"):
            if tag == "pre":
                self.emit()
                self.text = []
            elif tag == "br":
                self.text.append("\n")
        elif tag in ("img", "image"):
            source = given.get("src") or given.get("xlink:href") or given.get("href")
            file = self.image(source) if source else None
            if file:
                self.emit()
                self.book.add("figure", file=file, alt=tidy(given.get("alt", "")), labels=[])
        elif tag == "br":
            self.text.append(" ")
        elif tag == "hr":
            self.emit()
            self.book.add("rule")
        elif tag == "table":
            self.emit()
            self.tables.append({"rows": [], "row": None, "cell": False, "header": False})
        elif tag == "tr" and self.tables:
            self.tables[-1]["row"] = []
        elif tag in ("td", "th") and self.tables and self.tables[-1]["row"] is not None:
            here = self.tables[-1]
            here["cell"], self.text = True, []
            here["header"] |= tag == "th" and not here["rows"]
        elif m := HEADING.fullmatch(tag):
            self.emit()
            self.heading = int(m[1])
        elif tag in BLOCKS:
            self.emit()
            self.heading = None
        elif tag in CODE:
            if sum(n in CODE for n in self.open) == 1:
                self.text.append("`")
        elif not self.inside(CODE):
            if tag in BOLD:
                self.text.append("**")
            elif tag in ITALIC:
                self.text.append("*")
            elif tag == "sup":
                self.text.append("^")
            elif tag == "a":
                self.links.append(given["href"] if LINKED.match(given.get("href", "")) else None)
                self.text.append("[" if self.links[-1] else "")

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag not in self.open:
            if tag in BOLD | ITALIC and self.hidden_at is None and not self.inside(CODE | {"pre"}):
                self.text.append("**" if tag in BOLD else "*")
            return
        at = len(self.open) - 1 - self.open[::-1].index(tag)
        if self.hidden_at is not None:
            if at >= self.hidden_at:
                del self.open[at:]
            if len(self.open) <= self.hidden_at:
                self.hidden_at = None
            return
        if tag == "pre":
            code, self.text = "".join(self.text).strip("\n"), []
            if self.cell:
                self.text.append(f"`{tidy(code)}`")
            else:
                self.book.add("code", text=code)
        elif self.inside("pre"):
            pass
        elif tag in CODE:
            if sum(n in CODE for n in self.open) == 1:
                self.text.append("`")
        elif self.inside(CODE):
            pass
        elif tag in BOLD:
            self.text.append("**")
        elif tag in ITALIC:
            self.text.append("*")
        elif tag == "a":
            target = self.links.pop() if self.links else None
            self.text.append(f"]({target})" if target else "")
        elif tag in ("td", "th") and self.cell:
            self.tables[-1]["row"].append(finished("".join(self.text)))
            self.tables[-1]["cell"], self.text = False, []
        elif tag == "tr" and self.tables and self.tables[-1]["row"] is not None:
            self.tables[-1]["rows"] += [r for r in [self.tables[-1]["row"]] if any(r)]
            self.tables[-1]["row"] = None
        elif tag == "table" and self.tables:
            done = self.tables.pop()
            width = max(map(len, done["rows"]), default=0)
            if width:
                self.book.add("table", rows=[r + [""] * (width - len(r)) for r in done["rows"]], header=done["header"])
        elif tag in BLOCKS:
            self.emit()
            if HEADING.fullmatch(tag):
                self.heading = None
        # Block elements close what is open within them; inline ones only themselves.
        if tag in BLOCKS or tag in HIDDEN:
            del self.open[at:]
        else:
            del self.open[at]

    def handle_data(self, data: str) -> None:
        if self.hidden_at is not None:
            return
        if self.inside("pre"):
            self.text.append(data)
        elif self.inside(CODE):
            self.text.append(data.replace("`", "'"))
        else:
            self.text.append(marked(data))

    def close(self) -> None:
        super().close()
        self.emit()


def embedded_images(book: Book) -> Callable[[str], str | None]:
    """Takes images that stand in the page itself; others are noted."""

    def image(source: str) -> str | None:
        if m := re.match(r"data:image/(\w+);base64,(.*)", source, re.S):
            return book.image(base64.b64decode(m[2]), m[1])
        if not source.startswith("data:"):
            book.notes.append(f"image not taken: {source[:80]}")
        return None

    return image


def parse(text: str, chapter_level: int | None = None, book: Book | None = None, image: Callable[[str], str | None] | None = None) -> Book:
    book = book or Book()
    if chapter_level is None:
        counts = {k: len(re.findall(rf"<h{k}[\s>]", text, re.I)) for k in (1, 2)}
        chapter_level = next((k for k in (1, 2) if counts[k] >= 2), 0)
    if m := re.search(r"<html[^>]*\blang=[\"']([\w-]+)", text, re.I):
        book.language = book.language or m[1]
    if m := re.search(r"<title>(.*?)</title>", text, re.I | re.S):
        book.title = book.title or tidy(unescape(re.sub("<[^>]+>", "", m[1])))
    parser = Parser(book, chapter_level, image or embedded_images(book))
    parser.feed(text)
    parser.close()
    return book
