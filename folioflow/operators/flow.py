"""What stands on pages, in reading order, as the blocks of books."""

from __future__ import annotations

import re
from collections.abc import Iterator
from types import SimpleNamespace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..schemas import PARSED
from ..sources.builder import Book, joined, tidy

# The marks of list items, and what a sentence ends with.
ITEM = re.compile(r"\s*\\?(?:[•●○◦▪■‣⁃–—\-*·]|(?P<number>\d{1,3}[.)]|[a-zA-Z][.)]|[ivxIVX]{1,4}[.)]))\s+(?=\S)")
ENDS = tuple('.!?:;"”»)…。！？؟۔।')
GOES_ON = re.compile(r"[a-zà-ɏ(]")
NO_OUTLINE = "no usable outline: chapters begin at the largest headings"


def plain(text: str) -> str:
    return re.sub(r"[\W_]+", "", text.lower())


class Flow:
    """Writes a book from its pieces. A block stays open as long as the next line may go on with it."""

    def __init__(self, titles: list[str]) -> None:
        self.book, self.titles, self.opened = Book(), titles, 0
        self.title: str | None = None  # of the chapter just opened, whose heading may follow
        self.block: dict | None = None
        self.line = None
        self.left = 0.0  # where the open block began
        if not titles:
            self.book.notes.append(NO_OUTLINE)

    def open(self, kind: str, left: float, **fields) -> None:
        self.book.add(kind, **fields)
        blocks = self.book.chapters[-1]["blocks"]
        self.block, self.left = (blocks[-1] if blocks else None), left

    def close(self) -> None:
        self.block = self.line = None

    def take(self, piece) -> None:
        while self.opened < piece.ch_no:
            title = self.titles[self.opened]
            self.book.open_chapter(title)
            self.opened, self.title = self.opened + 1, plain(title)
            self.close()
        if piece.kind == "line":
            self.read(piece)
            return
        if piece.kind == "figure":
            self.book.add("figure", file=piece.file, alt="", labels=list(piece.labels))
        elif piece.kind == "items":
            for row in piece.rows:
                self.book.add("item", text=row[0], ordered=True, depth=0)
        else:
            self.book.add("table", rows=[list(r) for r in piece.rows], header=piece.kind == "table")
        self.close()

    def read(self, line) -> None:
        text = line.text.strip()
        if self.title is not None:
            own = plain(text)
            if line.level and own and (own in self.title or self.title in own):
                self.line = line
                return
            self.title = None
        if line.level == 1 and not self.titles:
            self.book.open_chapter(re.sub(r"\s+", " ", text))
            self.close()
            return
        turned = self.line is not None and self.line.page != line.page
        gap = line.y0 - self.line.y1 if self.line is not None else 999.0
        if line.mono >= 0.8:
            self.code(line, turned, gap)
        elif line.level:
            self.heading(line, gap)
        else:
            self.prose(line, text, turned, gap)
        self.line = line

    def goes_on(self, *kinds: str) -> bool:
        return self.block is not None and self.block["type"] in kinds

    def code(self, line, turned: bool, gap: float) -> None:
        raw = line.text.rstrip()
        if not self.goes_on("code"):
            self.open("code", line.x0, text=raw)
            return
        deeper = round((line.x0 - self.left) / max(0.6 * line.size, 1))
        raw = (" " * deeper if not raw.startswith(" ") else "") + raw
        if turned or gap < 2.6 * line.size:
            blank = 0 if turned or gap <= 0.9 * line.size else max(0, round(gap / (1.25 * line.size)))
            self.block["text"] += "\n" * (1 + blank) + raw
        else:
            self.open("code", line.x0, text=line.text.rstrip())

    def heading(self, line, gap: float) -> None:
        if self.goes_on("heading") and self.block["level"] == line.level and gap < 0.8 * line.size:
            self.block["text"] = joined(self.block["text"], line.marked)
        else:
            self.open("heading", line.x0, level=int(line.level), text=line.marked)

    def prose(self, line, text: str, turned: bool, gap: float) -> None:
        bold, mark = line.bold > 0.9, ITEM.match(text)
        if mark and not bold or line.bullet:
            body = tidy(ITEM.sub("", line.marked, count=1)) if mark else line.marked
            self.open("item", line.x0, text=body, ordered=bool(mark and mark["number"]), depth=0)
        elif self.goes_on("para", "item", "quote") and self.line is not None and self.continues(line, text, turned, gap):
            self.block["text"] = joined(self.block["text"], line.marked)
        elif bold and len(text.split()) <= 12 and not text.endswith(ENDS[:3]):
            self.open("heading", line.x0, level=4, text=line.marked)
        else:
            self.open("para", line.x0, text=line.marked)

    def continues(self, line, text: str, turned: bool, gap: float) -> bool:
        ended = self.block["text"].rstrip().endswith(ENDS)
        if turned:
            return not ended and bool(GOES_ON.match(text))
        if self.block["type"] == "item" and line.x0 < self.left - 1:
            return False
        indented = self.block["type"] == "para" and line.x0 > self.line.x0 + 0.9 * line.size
        return gap < 0.55 * line.size and not (indented and ended)

    def done(self, stem: str) -> dict:
        """The parsed record: chapters without a title take that of the heading they begin with, the book that of its first chapter."""
        for chapter in self.book.chapters:
            if not chapter["title"] and chapter["blocks"] and chapter["blocks"][0]["type"] == "heading":
                chapter["title"] = chapter["blocks"].pop(0)["text"]
        chapters = [c for c in self.book.chapters if c["blocks"] or c["title"]]
        self.book.title = chapters[0]["title"] if chapters else ""
        return self.book.done(stem)


def books(pieces: DataFrame, marks: DataFrame) -> DataFrame:
    """book_id and the fields of a parsed book, a book in a row.

    pieces (book_id, line_no, page, ch_no, kind, x0, y0, y1, text, size, level, mono, bold, bullet, marked, file, labels, rows); marks
    (book_id, mark_no, title) are the chapters of an outline. Their ids must be of one type.
    """
    schema = StructType([pieces.select("book_id").schema[0], *StructType.fromDDL(f"{PARSED}, format string").fields])
    arrow, mark = to_arrow_schema(schema), F.struct("mark_no", "title")
    own = [c for c in pieces.columns if c != "book_id"]
    both = pieces.select("book_id", F.struct(*own).alias("piece"), F.lit(None).alias("mark")).unionByName(marks.select("book_id", F.lit(None).alias("piece"), mark.alias("mark")))
    rows = both.groupBy("book_id").agg(F.collect_list("piece").alias("pieces"), F.collect_list("mark").alias("marks"))

    def book(key, read: list[dict], titles: list[dict]) -> dict:
        flow = Flow([t["title"] for t in sorted(titles, key=lambda t: t["mark_no"])])
        for piece in sorted(read, key=lambda v: v["line_no"]):
            flow.take(SimpleNamespace(**piece))
        return {"book_id": key, **flow.done(str(key)), "format": "pages"}

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 20):
                yield pa.RecordBatch.from_pylist([book(r["book_id"], r["pieces"], r["marks"]) for r in batch.slice(at, 20).to_pylist()], schema=arrow)

    return rows.mapInArrow(each, schema)
