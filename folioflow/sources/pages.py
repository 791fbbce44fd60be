"""Pages of positioned spans as books: what is behind a reader of page files.

Any reader that gives these tables can stand in front: spans, links, pages, drawings (book_id, page, x0, y0, x1, y1, filled), images
(book_id, page, x0, y0, x1, y1), grids (the same with rows: cells between rules) and outline (book_id, level, title, page, y). Books
that look scanned give no text and a note. Spans, pages, lines, figures and tables are read in several places: each is written once to the scratch folder.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import SIDES
from ..operators import columns as tables
from ..operators import flow, layout
from ..operators import spans as sp
from ..scratch import saved
from . import reader

SCANNED = "most pages have no text: recognise it first"


@dataclass
class Pages:
    spans: DataFrame
    links: DataFrame
    pages: DataFrame
    drawings: DataFrame
    images: DataFrame
    grids: DataFrame
    outline: DataFrame


def pieces(source: Pages, columns: int = 1, with_tables: bool = True) -> DataFrame:
    """book_id, page, kind, box and the fields of each kind: lines, figures, tables and lists."""
    lines = saved(sp.lines(source.spans, source.links, source.pages), "page-lines")
    lines = saved(layout.without_bullets(layout.without_furniture(layout.levelled(lines, source.pages), source.pages), source.drawings), "page-texts")
    figures = saved(layout.labelled(layout.figures(source.images, source.drawings, lines, source.pages), lines), "page-figures")
    at = ["book_id", "page", *SIDES]
    name = F.format_string("assets/fig_%04d_%02d.png", "page", F.row_number().over(layout.in_page()))
    parts = [figures.select(*at, F.lit("figure").alias("kind"), name.alias("file"), "labels")]
    free = layout.outside(lines, figures)
    if with_tables:
        ruled = layout.ruled_tables(source.grids, lines)
        free = layout.outside(free, ruled)
        parts.append(ruled.select(*at, F.lit("table").alias("kind"), "rows"))
        if columns == 1:
            found = saved(tables.tables(free), "page-tables")
            free = free.join(found.select("book_id", F.explode("used").alias("line_id")), ["book_id", "line_id"], "left_anti")
            parts.append(found.select(*at, "kind", "rows"))
    every = free.withColumn("kind", F.lit("line"))
    for part in parts:
        every = every.unionByName(part, allowMissingColumns=True)
    size = source.pages.select("book_id", "page", F.col("width").alias("_width"))
    return every.join(size, ["book_id", "page"]).withColumn("width", F.col("_width")).drop("_width")


def read_pages(source: Pages, columns: int = 1, with_tables: bool = True, chapter_level: int | None = None) -> dict[str, DataFrame]:
    """books, chapters, blocks and assets, as reader.tables() gives them. Figures name a file by page and number; the pictures are the reader's to cut out."""
    source = replace(source, spans=saved(source.spans, "page-spans"), pages=saved(source.pages, "page-sizes"))
    marks = layout.outline_marks(source.outline, source.pages, chapter_level)
    placed = layout.in_chapters(layout.reading_order(pieces(source, columns, with_tables), columns), marks)
    wanted = ["book_id", "line_no", "page", "ch_no", "kind", "x0", "y0", "y1", "text", "size", "level", "mono", "bold", "bullet", "marked", "file", "labels", "rows"]
    rows = placed.withColumn("text", F.when(F.col("kind") == "line", layout.T.without_ligatures("text"))).select(*wanted)
    texts = source.spans.select("book_id", "page", "text")
    scans = layout.scanned(texts, source.pages).where("is_scan").select("book_id")
    out = flow.books(rows.join(scans, "book_id", "left_anti"), marks.join(scans, "book_id", "left_anti").select("book_id", "mark_no", "title"))
    empty = scans.select("book_id", F.lit("").alias("title"), F.lit("").alias("author"), F.lit("").alias("language"), F.array(F.lit(f"error: {SCANNED}")).alias("notes"), F.lit("pages").alias("format"))
    read = reader.tables(out)
    return read | {"books": read["books"].unionByName(empty)}
