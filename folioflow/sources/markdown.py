"""Markdown as blocks, in two passes: each line is told by how it opens, then neighbouring lines fold into blocks.

What opens a block is looked up by the first character of the line; a line that opens none continues a paragraph.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from ..functions.text import MARKDOWN_MARKS
from .builder import Book, tidy

FENCES = ("```", "~~~")
#: Columns of a code block's indent, and of a step in the depth of lists; the deepest list.
CODE_INDENT, STEP, DEEPEST = 4, 2, 3
# The fields that front matter may set, by the book's attribute.
FIELDS = {"title": "title", "author": "author", "language": "language", "lang": "language"}
QUOTES = ("'", '"')


def inline(text: str) -> str:
    """Underscores to stars, images to their text, bare addresses to links."""
    for pattern, by in MARKDOWN_MARKS:
        text = re.sub(pattern.replace("{word}", r"\w"), by.replace("{1}", r"\1"), text)
    return tidy(text)


@dataclass(frozen=True)
class Line:
    """A line and what its opening says of it."""

    raw: str

    @cached_property
    def bare(self) -> str:
        return self.raw.strip()

    @cached_property
    def level(self) -> int:
        """The level of a heading: 1 to 6 marks at the very start, then white space; 0 for other lines."""
        marks = len(self.raw) - len(self.raw.lstrip("#"))
        return marks if 1 <= marks <= 6 and self.raw[marks : marks + 1].isspace() else 0

    @property
    def title(self) -> str:
        return self.raw[self.level :].strip().rstrip("#").rstrip()

    @property
    def fence(self) -> str:
        return next((f for f in FENCES if self.bare.startswith(f)), "")

    @property
    def underline(self) -> int:
        """The level that a line below gives a heading: only equals signs, or only dashes."""
        return {frozenset("="): 1, frozenset("-"): 2}.get(frozenset(self.bare), 0)

    @property
    def is_rule(self) -> bool:
        marks = "".join(self.bare.split())
        return len(marks) >= 3 and len(set(marks)) == 1 and marks[0] in "*-_"

    @property
    def is_table_rule(self) -> bool:
        return self.bare.removeprefix("|").lstrip().removeprefix(":").startswith("--")

    @cached_property
    def item(self) -> tuple[str, str, str] | None:
        """Indent, mark and text of a list item: a bullet, or up to three digits with a dot or a bracket."""
        body = self.raw.lstrip()
        digits = len(body) - len(body.lstrip("0123456789"))
        size = 1 if body[:1] in ("-", "*", "+") else digits + 1 if 1 <= digits <= 3 and body[digits : digits + 1] in (".", ")") else 0
        if not size or not body[size : size + 1].isspace():
            return None
        return self.raw[: len(self.raw) - len(body)], body[:size], body[size:].lstrip()


class Reader:
    """Folds lines into the blocks of a book."""

    def __init__(self, text: str, chapter_level: int | None = None) -> None:
        self.book, self.paragraph = Book(), []
        self.lines = [Line(x) for x in self.front_matter(text.removeprefix("\ufeff").splitlines())]
        levels = Counter(line.level for line in self.lines)
        self.lone = levels[1] == 1
        self.level = next((n for n in (1, 2) if levels[n] >= 2), 0) if chapter_level is None else chapter_level
        if self.lone and not self.book.title:
            self.book.title = next(line.title for line in self.lines if line.level == 1)

    def front_matter(self, lines: list[str]) -> list[str]:
        """Sets the book's fields from a header between rules, if there is one; the lines behind it."""
        bare = [x.strip() for x in lines]
        end = next((i for i, x in enumerate(bare) if i and x in ("---", "...")), 0) if bare[:1] == ["---"] else 0
        for line in lines[1:end]:
            name, colon, value = line.partition(":")
            if colon and (field := FIELDS.get(name.rstrip().lower())):
                value = value.strip()
                value = value[value[:1] in QUOTES :]
                setattr(self.book, field, value[:-1] if value[-1:] in QUOTES else value)
        return lines[end + 1 :] if end else lines

    def run(self, at: int, belongs: Callable[[Line], bool]) -> int:
        """The end of the run of lines from at on that belong together."""
        while at < len(self.lines) and belongs(self.lines[at]):
            at += 1
        return at

    def flush(self) -> None:
        if self.paragraph:
            self.book.add("para", text=inline(" ".join(self.paragraph)))
            self.paragraph = []

    def title(self, level: int, text: str) -> None:
        if level <= self.level:
            self.book.open_chapter(text.translate(str.maketrans("", "", "*`")))
        elif not (level == 1 and self.lone and text == self.book.title):
            self.book.add("heading", level=level, text=inline(text))

    # Each folder takes the place of a line and gives that behind its block, or None if the line does not open such a block.

    def fenced(self, at: int) -> int | None:
        fence = self.lines[at].fence
        if not fence:
            return None
        end = self.run(at + 1, lambda x: not x.bare.startswith(fence))
        self.flush()
        self.book.add("code", text="\n".join(x.raw for x in self.lines[at + 1 : end]))
        return end + 1

    def heading(self, at: int) -> int | None:
        line = self.lines[at]
        if not line.level:
            return None
        self.flush()
        self.title(line.level, line.title)
        return at + 1

    def underlined(self, at: int) -> int | None:
        level = self.lines[at + 1].underline if at + 1 < len(self.lines) and not self.paragraph else 0
        if not level:
            return None
        self.title(level, self.lines[at].bare)
        return at + 2

    def rule(self, at: int) -> int | None:
        if not self.lines[at].is_rule:
            return None
        self.flush()
        self.book.add("rule")
        return at + 1

    def image(self, at: int) -> int | None:
        """A picture alone on its line; files beside the text cannot be reached from a table of texts."""
        alt, between, rest = self.lines[at].bare.removeprefix("![").partition("](")
        place, _, caption = rest.removesuffix(")").partition(" ")
        caption = caption.strip()
        quoted = not caption or len(caption) > 1 and caption[0] == caption[-1] == '"' and '"' not in caption[1:-1]
        if not (between and rest.endswith(")") and "]" not in alt and place and ")" not in place and len(place.split()) == 1 and quoted and (caption or " " not in rest)):
            return None
        self.flush()
        self.book.notes.append(f"image not found: {place}")
        return at + 1

    def table(self, at: int) -> int | None:
        if at + 1 >= len(self.lines) or not self.lines[at + 1].is_table_rule:
            return None
        end = self.run(at, lambda x: x.bare.startswith("|"))
        rows = [x.bare.strip("|") for x in self.lines[at:end]]
        self.flush()
        self.book.add("table", rows=[[inline(c.strip()) for c in cells_of(r)] for r in rows if not r or r.translate(RULE_MARKS).strip()], header=True)
        return end

    def item(self, at: int) -> int | None:
        if self.lines[at].item is None:
            return None
        indent, mark, text = self.lines[at].item
        end = self.run(at + 1, lambda x: x.bare and x.item is None and x.raw[0] in " \t")
        depth = min(DEEPEST, len(indent.expandtabs(4)) // STEP)
        self.flush()
        self.book.add("item", text=inline(" ".join([text, *(x.bare for x in self.lines[at + 1 : end])])), ordered=mark[0].isdigit(), depth=depth)
        return end

    def quote(self, at: int) -> int | None:
        end = self.run(at, lambda x: x.bare.startswith(">"))
        said = (x.bare.lstrip(">").strip() for x in self.lines[at:end])
        self.flush()
        self.book.add("quote", text=inline(" ".join(filter(None, said))))
        return end

    def indented(self, at: int) -> int | None:
        indent = " " * CODE_INDENT
        if self.paragraph or not self.lines[at].raw.startswith(indent):
            return None
        end = self.run(at, lambda x: x.raw.startswith(indent) or not x.bare)
        self.book.add("code", text="\n".join(x.raw[CODE_INDENT:] for x in self.lines[at:end]).rstrip("\n"))
        return end

    #: What a line may open, by its first character.
    OPENERS = {
        "`": (fenced,), "~": (fenced,), "#": (heading,), "!": (image,), "|": (table,), ">": (quote,),
        "*": (rule, item), "-": (rule, item), "_": (rule,), "+": (item,), **dict.fromkeys("0123456789", (item,)),
    }
    #: What also may open: a heading by the line below goes before all but fences and marked headings, indented code is last.
    SURE = (fenced, heading)

    def opened(self, at: int) -> int | None:
        own = self.OPENERS.get(self.lines[at].bare[0], ())
        order = [f for f in own if f in self.SURE] + [Reader.underlined] + [f for f in own if f not in self.SURE] + [Reader.indented]
        return next((end for f in order if (end := f(self, at)) is not None), None)

    def read(self) -> Book:
        at = 0
        while at < len(self.lines):
            line = self.lines[at]
            end = self.opened(at) if line.bare else None
            if not line.bare:
                self.flush()
            elif end is None:
                self.paragraph.append(line.bare)
            at = end or at + 1
        self.flush()
        return self.book


RULE_MARKS = str.maketrans("", "", ":|-")


def cells_of(row: str) -> list[str]:
    """Cells between bars that no backslash escapes."""
    cells = [""]
    for part in re.split(r"(\\?\|)", row):
        if part == "|":
            cells.append("")
        else:
            cells[-1] += part
    return cells


def parse(text: str, chapter_level: int | None = None) -> Book:
    return Reader(text, chapter_level).read()
