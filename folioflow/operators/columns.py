"""Tables without rules: lines of a page that stand side by side in columns."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.geometry import SIDES
from ..sources.builder import joined, tidy

# What stands in a column that only marks the items of a list.
ITEM_MARK = re.compile(r"(?:\d{1,3}|[a-zA-Z]|[ivxIVX]{1,4})[.)]|[•●○◦▪■–\-*·]")
#: Points by which starts in one column differ within a row and between rows, and the most columns.
SAME_START, SAME_COLUMN, MOST_COLUMNS = 12, 14, 6
LEAST_ROWS = 3


class Line(NamedTuple):
    x0: float
    y0: float
    x1: float
    y1: float
    line_id: int
    text: str
    size: float
    bold: float
    cell: str
    head: str


@dataclass
class Row:
    """Lines whose heights overlap."""

    lines: list[Line]
    page_width: float

    @property
    def top(self) -> float:
        return self.lines[0].y0

    @property
    def bottom(self) -> float:
        return max(x.y1 for x in self.lines)

    def starts(self) -> list[int]:
        out: list[int] = []
        for x in sorted({round(v.x0) for v in self.lines}):
            if not out or x - out[-1] > SAME_START:
                out.append(x)
        return out

    def tabular(self) -> bool:
        """Whether there are several columns, and the first holds no running text."""
        starts = self.starts()
        if not 2 <= len(starts) <= MOST_COLUMNS:
            return False
        first = [v for v in self.lines if abs(v.x0 - starts[0]) <= SAME_START]
        words = sum(len(v.text.split()) for v in first) / len({round(v.y0) for v in first})
        return max(v.x1 for v in first) - starts[0] < 0.32 * self.page_width and words <= 6

    def continues(self, starts: list[int]) -> bool:
        """Whether this is a further line of a cell that is not in the first column."""
        own = self.starts()
        return len(own) == 1 and any(abs(own[0] - x) <= SAME_COLUMN for x in starts[1:])

    def fits(self, starts: list[int]) -> bool:
        own = self.starts()
        return self.tabular() and len(own) == len(starts) and all(abs(a - b) <= SAME_COLUMN for a, b in zip(own, starts, strict=True))


def visual_rows(lines: list[Line], page_width: float) -> list[Row]:
    out: list[Row] = []
    for line in sorted(lines, key=lambda v: (v.y0, v.x0)):
        if out and line.y0 < out[-1].bottom - 1.5:
            out[-1].lines.append(line)
        else:
            out.append(Row([line], page_width))
    return out


def cell_text(lines: list[Line]) -> str:
    text = ""
    for line in sorted(lines, key=lambda v: (v.y0, v.x0)):
        text = joined(text, tidy(line.cell))
    return text


def grid(lines: list[Line], starts: list[int]) -> list[list[str]]:
    """The texts of cells. Blocks of the first column are the rows; other lines go to the row beside them, or else the nearest."""
    column = lambda v: min(range(len(starts)), key=lambda k: abs(starts[k] - v.x0))
    blocks: list[list[Line]] = []
    rest = []
    for line in sorted(lines, key=lambda v: v.y0):
        if column(line):
            rest.append(line)
        elif blocks and line.y0 - blocks[-1][-1].y1 < 0.3 * line.size:
            blocks[-1].append(line)
        else:
            blocks.append([line])
    cells = [[list(b)] + [[] for _ in starts[1:]] for b in blocks]
    for line in rest:
        middle = (line.y0 + line.y1) / 2
        beside = [k for k, b in enumerate(blocks) if min(line.y1, b[-1].y1) - max(line.y0, b[0].y0) > 0.3 * (line.y1 - line.y0)]
        nearest = min(beside or range(len(blocks)), key=lambda k: abs((blocks[k][0].y0 + blocks[k][-1].y1) / 2 - middle))
        cells[nearest][column(line)].append(line)
    return [[cell_text(c) for c in row] for row in cells]


def found(lines: list[Line], page_width: float) -> list[tuple[str, list[Line], list[list[str]]]]:
    """kind (table, headless or items), lines and rows of each table of a page."""
    rows, out, at = visual_rows(lines, page_width), [], 0
    while at < len(rows):
        starts, end, count = rows[at].starts(), at, 0
        if rows[at].tabular():
            while end < len(rows) and (rows[end].fits(starts) or end > at and rows[end].continues(starts)):
                count += rows[end].fits(starts)
                end += 1
        if count < LEAST_ROWS:
            at += 1
            continue
        first, head = at, None
        gap = lambda k: rows[k].top - rows[k - 1].bottom
        if first and rows[first - 1].continues(starts) and gap(first) < 0.6 * rows[first - 1].lines[0].size:
            first -= 1  # the upper line of a cell whose row's name is set at half height
        if first:
            above = rows[first - 1]
            if len(above.lines) == len(starts) and all(v.bold > 0.9 for v in above.lines) and gap(first) < 1.5 * above.lines[0].size:
                head = sorted(above.lines, key=lambda v: v.x0)
        region = [v for row in rows[first:end] for v in row.lines]
        table = grid(region, starts)
        marks = [m for row in table if (m := re.sub(r"[\\*`]", "", row[0]).strip())]
        if head:
            out.append(("table", region + head, [[tidy(v.head) for v in head], *table]))
        elif len(starts) == 2 and marks and all(map(ITEM_MARK.fullmatch, marks)):
            out.append(("items", region, [[row[1]] for row in table]))
        else:
            out.append(("headless", region, table))
        at = end
    return out


def tables(lines: DataFrame) -> DataFrame:
    """book_id, page, kind, x0, y0, x1, y1, rows, used (line_id) of lines (spans.lines()): a page in a row.

    Pages whose lines all start at one place have no columns, and are not read.
    """
    types = dict(lines.dtypes)
    ddl = f"book_id {types['book_id']}, page {types['page']}, kind string, x0 double, y0 double, x1 double, y1 double, rows array<array<string>>, used array<bigint>"
    schema = StructType.fromDDL(ddl)
    arrow = to_arrow_schema(schema)
    several = lines.groupBy("book_id", "page").agg((F.max("x0") - F.min("x0")).alias("spread")).where(F.col("spread") > SAME_START - 1).select("book_id", "page")
    if several.isEmpty():
        return lines.sparkSession.createDataFrame([], schema)
    rows = lines.join(several, ["book_id", "page"], "left_semi").groupBy("book_id", "page").agg(F.first("width").alias("width"), F.collect_list(F.struct(*Line._fields)).alias("lines"))

    def of_page(page: dict) -> Iterator[dict]:
        own = [Line(**v) for v in page["lines"]]
        for kind, used, cells in found(own, float(page["width"])):
            sides = {s: float(f(getattr(v, s) for v in used)) for s, f in zip(SIDES, (min, min, max, max), strict=True)}
            yield {"book_id": page["book_id"], "page": page["page"], "kind": kind, **sides, "rows": cells, "used": [int(v.line_id) for v in used]}

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                yield pa.RecordBatch.from_pylist([t for page in batch.slice(at, 100).to_pylist() for t in of_page(page)], schema=arrow)

    return rows.mapInArrow(each, schema)
