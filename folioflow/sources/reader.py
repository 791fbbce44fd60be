"""Files of any supported format as tables of books, chapters, blocks and assets."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..schemas import PARSED
from . import html, markdown, packages
from .builder import Book, marked, tidy

FORMATS = {"epub": "epub", "html": "html", "htm": "html", "xhtml": "html", "docx": "docx", "md": "markdown", "markdown": "markdown", "txt": "text", "pdf": "pdf"}
SUFFIX = re.compile(r"([^/]*?)\.(\w+)$")


def text_book(text: str) -> Book:
    """Plain text by the rules of txt.read_txt(), for files that come among others."""
    from .txt import CHAPTER_WORDS

    chapter, book = re.compile(rf"(?:{CHAPTER_WORDS})(?:\W.{{0,79}})?$", re.I), Book()
    text = text.removeprefix("\ufeff").replace("\r\n", "\n")
    for part in re.split(r"\n\s*\n", text) if "\n\n" in text else text.split("\n"):
        line = tidy(part.replace("\n", " "))
        if chapter.match(line) and len(line) < 90:
            book.open_chapter(line)
        elif len(line) < 60 and line.isupper() and len(line.split()) <= 8:
            book.add("heading", level=2, text=marked(line))
        elif line:
            book.add("para", text=marked(line))
    return book


def parse(name: str, content: bytes, chapter_level: int | None = None) -> dict:
    """The record of one file; a file that cannot be read has no chapters and a note that says why."""
    m = SUFFIX.search(name)
    kind = FORMATS.get(m[2].lower()) if m else None
    try:
        if kind in ("epub", "docx"):
            book = packages.epub(content) if kind == "epub" else packages.docx(content, chapter_level)
        elif kind in ("html", "markdown", "text"):
            text = content.decode("utf-8-sig", "replace")
            book = html.parse(text, chapter_level) if kind == "html" else markdown.parse(text, chapter_level) if kind == "markdown" else text_book(text)
        else:
            raise ValueError(f"no reader for {name}")
        if not any(c["blocks"] or c["title"] for c in book.chapters):
            raise ValueError(f"no text in {name}")
    except Exception as error:  # one bad file must not end a job over many
        book = Book(notes=[f"error: {error}"])
    return book.done(m[1] if m else name) | {"format": kind or ""}


def parsed(files: DataFrame, name: str = "path", content: str = "content", chapter_level: int | None = None) -> DataFrame:
    """files (book_id, name, content as text or bytes) with the fields of a parsed book."""
    schema = StructType([files.select("book_id").schema[0], *StructType.fromDDL(f"{PARSED}, format string").fields])
    arrow = to_arrow_schema(schema)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):  # a book may be large: each is a batch of its own
                key, where, data = (batch.column(k)[at].as_py() for k in range(3))
                record = parse(where or "", data.encode() if isinstance(data, str) else data or b"", chapter_level)
                yield pa.RecordBatch.from_pylist([{"book_id": key} | record], schema=arrow)

    return files.select("book_id", name, content).mapInArrow(each, schema)


def tables(rows: DataFrame) -> dict[str, DataFrame]:
    """books, chapters, blocks and assets of parsed()."""
    books = rows.select("book_id", "title", "author", "language", "format", "notes")
    each = rows.select("book_id", F.posexplode("chapters").alias("i", "c")).withColumn("ch_no", F.col("i") + 1).withColumn("ch_id", F.format_string("c%03d", "ch_no"))
    chapters = each.select("book_id", "ch_no", "ch_id", "c.title")
    blocks = each.select("book_id", "ch_no", "ch_id", F.posexplode("c.blocks").alias("pos", "b")).select("book_id", "ch_no", "ch_id", "pos", "b.*")
    assets = rows.select("book_id", F.explode("assets").alias("a")).select("book_id", "a.*")
    return {"books": books, "chapters": chapters, "blocks": blocks, "assets": assets}


def read_files(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Tables of all files below a folder, whose paths are the books' ids."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return tables(parsed(files.select(F.col("path").alias("book_id"), "path", "content")))
