"""Page layout as relations: lines of pages (book_id, page, x0, y0, x1, y1, text, size, mono, width, height) to blocks.

The lines come from whatever reads the pages, or from spans.lines(); no such reader is needed here. Joins of lines with rectangles
are within a page.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import chars as C
from ..functions import geometry as G
from ..functions import text as T
from ..functions.geometry import SIDES

# Glyphs that are bullets where they stand alone in a line.
LONE_BULLETS = "•●◦▪■‣⁃·-*–"


def mono_line():
    """Whether a line is code; the share of its characters tells, or a flag."""
    return F.col("mono").cast("double") >= 0.8


def scanned(lines: DataFrame, pages: DataFrame, least: int = 20) -> DataFrame:
    """book_id, empty_share, is_scan: books of which more than half of the pages have hardly any text."""
    sized = pages.join(lines.groupBy("book_id", "page").agg(F.sum(F.length(T.strip("text"))).alias("n")), ["book_id", "page"], "left")
    share = F.avg((F.coalesce("n", F.lit(0)) < least).cast("double"))
    return sized.groupBy("book_id").agg(share.alias("empty_share"), (share > 0.5).alias("is_scan"))


def body_size(lines: DataFrame) -> DataFrame:
    """book_id, body: the size, in half points, of most characters that are not monospaced."""
    half = F.bround(F.col("size") * 2) / 2
    sizes = lines.where(~mono_line()).groupBy("book_id", half.alias("body")).agg(F.sum(F.length("text")).alias("n"))
    return sizes.groupBy("book_id").agg(F.max_by("body", F.struct("n", -F.col("body"))).alias("body"))


def furniture(lines: DataFrame, pages: DataFrame, share: float = 0.2, edge: float = 0.085) -> DataFrame:
    """book_id, norm: texts at the pages' edges that repeat on so many pages, with digits taken as one."""
    at_edge = lines.where((F.col("y1") < edge * F.col("height")) | (F.col("y0") > (1 - edge) * F.col("height")))
    counts = at_edge.groupBy("book_id", furniture_key().alias("norm")).agg(F.countDistinct("page").alias("n"))
    total = pages.groupBy("book_id").agg(F.count(F.lit(1)).alias("pages"))
    return counts.join(total, "book_id").where((F.col("n") >= 3) & (F.col("n") >= share * F.col("pages"))).select("book_id", "norm")


def furniture_key():
    return F.lower(F.regexp_replace(T.strip("text"), f"[{C.DIGIT}]+", "#"))


def without_furniture(lines: DataFrame, pages: DataFrame, edge: float = 0.085) -> DataFrame:
    """lines without running heads and page numbers."""
    outer = (F.col("y1") < edge * F.col("height")) | (F.col("y0") > (1 - edge) * F.col("height"))
    numeral = outer & T.strip("text").rlike(rf"^[{C.DIGIT}ivxlcIVXLC.\-–— ]+$")
    rows = lines.where(~numeral).withColumns({"norm": furniture_key(), "outer": outer})
    gone = furniture(lines, pages, edge=edge).withColumn("gone", F.lit(True))
    return rows.join(gone, ["book_id", "norm"], "left").where(~(F.col("outer") & F.coalesce("gone", F.lit(False)))).select(*lines.columns)


def heading_sizes(lines: DataFrame, pages: DataFrame, large: float = 1.15) -> DataFrame:
    """book_id, sizes: those well above the body's, the largest first, that have three characters and stand on two pages (or on the only one)."""
    half = (F.bround(F.col("size") * 2) / 2).alias("size")
    sized = lines.where(~mono_line() & (T.strip("text") != "")).groupBy("book_id", half).agg(F.count_distinct("page").alias("on"), F.sum(F.length("text")).alias("n"))
    total = pages.groupBy("book_id").agg(F.count(F.lit(1)).alias("total"))
    kept = sized.join(body_size(lines), "book_id").join(total, "book_id").where((F.col("size") >= large * F.col("body")) & (F.col("n") >= 3) & (F.col("on") >= F.least(F.lit(2), "total")))
    return kept.groupBy("book_id").agg(F.sort_array(F.collect_set("size"), asc=False).alias("sizes"))


def levelled(lines: DataFrame, pages: DataFrame, deepest: int = 4, tolerance: float = 0.25) -> DataFrame:
    """lines with level: that of the first heading size which the line reaches, 0 if none."""
    rows = lines.join(heading_sizes(lines, pages), "book_id", "left")
    above = F.size(F.filter("sizes", lambda s: s - tolerance > F.col("size")))
    level = F.when(above < F.size("sizes"), F.least(above + 1, F.lit(deepest))).otherwise(0)
    return rows.withColumn("level", F.when(mono_line(), 0).otherwise(F.coalesce(level, F.lit(0)))).drop("sizes")


def column_of(columns: int):
    """The column of text that a box's middle lies in."""
    return F.least(F.floor((F.col("x0") + F.col("x1")) / 2 / F.col("width") * columns), F.lit(columns - 1)) if columns > 1 else F.lit(0)


def reading_order(lines: DataFrame, columns: int = 1) -> DataFrame:
    """lines with line_no: by page, column, row of three points and place in the row."""
    order = [F.col("page"), column_of(columns), F.bround(F.col("y0") / 3), F.col("x0")]
    return lines.withColumn("line_no", F.row_number().over(Window.partitionBy("book_id").orderBy(*order)))


def outline_marks(outline: DataFrame, pages: DataFrame, level: int | None = None) -> DataFrame:
    """book_id, mark_no, page, y, title: the entries of an outline (book_id, level, title, page, y) that open chapters.

    They are those of one level, the first that has two entries, or else the first. A book with fewer than two marks has none.
    """
    counts = outline.groupBy("book_id", "level").agg(F.count(F.lit(1)).alias("n"))
    chosen = counts.groupBy("book_id").agg(F.coalesce(F.lit(level), F.min(F.when(F.col("n") >= 2, F.col("level"))), F.lit(1)).alias("level"))
    height = pages.select("book_id", "page", "height")
    rows = outline.join(chosen, ["book_id", "level"]).where("page >= 1").join(height, ["book_id", "page"], "left")
    y = F.least(F.greatest(F.coalesce("y", F.lit(0.0)), F.lit(0.0)), "height")
    rows = rows.select("book_id", "page", y.alias("y"), T.strip(T.without_ligatures("title")).alias("title"))
    rows = rows.withColumn("mark_no", F.row_number().over(Window.partitionBy("book_id").orderBy("page", "y", "title")))
    return rows.withColumn("_n", F.max("mark_no").over(Window.partitionBy("book_id"))).where("_n >= 2").select("book_id", "mark_no", "page", "y", "title")


def in_chapters(lines: DataFrame, outline: DataFrame, above: float = 40.0) -> DataFrame:
    """lines (with line_no) and ch_no: the last entry of the outline (book_id, mark_no, page, y) that a line has come to.

    Lines and marks are put in one row by page and height. The pointer never goes back, whatever the order of columns: a running
    maximum in reading order.
    """
    spots = lines.withColumns({"_y": F.col("y0"), "_mark": F.lit(None).cast("int")})
    marks = outline.select("book_id", "page", (F.col("y") - above).alias("_y"), F.col("mark_no").cast("int").alias("_mark"))
    both = spots.unionByName(marks, allowMissingColumns=True)
    passed = Window.partitionBy("book_id").orderBy("page", "_y", F.col("_mark").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    here = both.withColumn("_passed", F.max("_mark").over(passed)).where("_mark is null")
    read = Window.partitionBy("book_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return here.withColumn("ch_no", F.coalesce(F.max("_passed").over(read), F.lit(0))).drop("_y", "_mark", "_passed")


def paragraphs(lines: DataFrame, gap: float = 0.6) -> DataFrame:
    """book_id, para_no, text, size, mono of lines in reading order: gaps and islands.

    A line goes on with the paragraph above it on the same page if size and spacing agree and it is not indented; at the top of a
    page it goes on if the paragraph does not end there.
    """
    w = Window.partitionBy("book_id").orderBy("line_no")
    before = lambda c: F.lag(c).over(w)
    same = (before("page") == F.col("page")) & (F.col("y0") - before("y1") < gap * F.col("size")) & (F.col("x0") - before("x0") < F.col("size"))
    over = (before("page") < F.col("page")) & ~T.strip(before("text")).rlike(r"[.!?:;\"”»)…。！？؟۔।]$")
    goes_on = F.coalesce((same | over) & (before("size") == F.col("size")) & (before("mono") == F.col("mono")), F.lit(False))
    marked = lines.withColumn("para_no", F.sum((~goes_on).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"])
    grouped = marked.groupBy("book_id", "para_no").agg(ordered.alias("lines"), F.first("size").alias("size"), F.first("mono").alias("mono"))
    return grouped.select("book_id", "para_no", F.when(F.col("mono"), F.array_join("lines", "\n")).otherwise(T.joined_lines(F.col("lines"))).alias("text"), "size", "mono")


def merged_boxes(boxes: DataFrame, pad: float = 3.0) -> DataFrame:
    """book_id, page, x0, y0, x1, y1, n: boxes of a page that come within pad of each other, directly or through others, as one.

    n is how many there are in it, or the sum of an n that boxes have. A merged box reaches as far as the rectangle around its parts.
    """
    book_type = dict(boxes.dtypes)["book_id"]
    rows = boxes.select("book_id", "page", *SIDES, (F.col("n") if "n" in boxes.columns else F.lit(1)).cast("bigint").alias("n"))

    def union(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        left, out = frame[[*SIDES, "n"]].to_numpy("float64"), []
        while len(left):
            box, left = left[0], left[1:]
            while True:
                near = (left[:, :2] - pad <= box[2:4]).all(1) & (box[:2] - pad <= left[:, 2:4]).all(1)
                if not near.any():
                    break
                parts, left = np.vstack([box[None], left[near]]), left[~near]
                box = np.concatenate([parts[:, :2].min(0), parts[:, 2:4].max(0), parts[:, 4:].sum(0)])
            out.append((*key, *box))
        out.sort(key=lambda b: b[2:])
        return pd.DataFrame(out, columns=["book_id", "page", *SIDES, "n"]).astype({"n": "int64"})

    # A box that has taken up others can reach boxes that were set aside: once more until nothing merges.
    def settled(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        while True:
            out = union(key, frame)
            if len(out) == len(frame):
                return out
            frame = out

    return rows.groupBy("book_id", "page").applyInPandas(settled, f"book_id {book_type}, page int, x0 double, y0 double, x1 double, y1 double, n bigint")


def without_bullets(lines: DataFrame, drawings: DataFrame) -> DataFrame:
    """lines with bullet: whether a small filled shape, or a line of a bullet alone, stands left of it. Such lines are left out."""
    dot = G.box()
    dots = drawings.where(F.col("filled") & G.width(dot).between(1.5, 7.5) & G.height(dot).between(1.5, 7.5) & ~G.width(dot).isin(1.5, 7.5) & ~G.height(dot).isin(1.5, 7.5))
    alone = T.strip("text").isin(*LONE_BULLETS)
    marks = dots.select("book_id", "page", *G.boxes_as("m_")).unionByName(lines.where(alone).select("book_id", "page", *G.boxes_as("m_")))
    texts, mark = lines.where(~alone), G.box("m_")
    middle = (mark[1] + mark[3]) / 2
    beside = (mark[2] <= F.col("x0") + 1) & (F.col("x0") - mark[0] < 28) & middle.between(F.col("y0") - 1, F.col("y1") + 1)
    hit = texts.join(marks, ["book_id", "page"]).where(beside).select("book_id", "line_id").distinct().withColumn("bullet", F.lit(True))
    return texts.join(hit, ["book_id", "line_id"], "left").withColumn("bullet", F.coalesce("bullet", F.lit(False)))


def _with_lines(regions: DataFrame, lines: DataFrame, share: float) -> DataFrame:
    """regions (with region) and what lies in them or crosses their edge: inside, words, mono, text_area, crossing."""
    page = lines.select("book_id", "page", F.col("mono").alias("l_mono"), F.size(F.filter(F.split("text", f"[{C.WS}]+"), lambda w: w != "")).alias("words"), *G.boxes_as("l_"))
    line, region = G.box("l_"), G.box()
    inside, both = G.within(line, region, share), G.shared(line, region)
    met = regions.join(page, ["book_id", "page"]).where(both > 0)
    counted = met.groupBy("book_id", "page", "region").agg(
        F.count_if(inside).alias("inside"), F.max(F.when(inside, F.col("words"))).alias("words"), F.avg(F.when(inside, F.col("l_mono"))).alias("mono"),
        F.sum(F.when(inside, G.area(line))).alias("text_area"),
        F.count_if(~inside & (both > 0.1 * F.least(G.area(line), G.area(region)))).alias("crossing"), F.count_if(~inside & (both > 0.1 * G.area(line))).alias("behind"),
    )
    return regions.join(counted, ["book_id", "page", "region"], "left").fillna(0, ["inside", "words", "mono", "text_area", "crossing", "behind"])


def in_page() -> Window:
    return Window.partitionBy("book_id", "page").orderBy(*SIDES)


def _numbered(boxes: DataFrame) -> DataFrame:
    return boxes.withColumn("region", F.row_number().over(in_page()))


def figures(images: DataFrame, drawings: DataFrame, lines: DataFrame, pages: DataFrame) -> DataFrame:
    """book_id, page, x0, y0, x1, y1: images, and drawings that are neither boxes behind text nor decoration.

    A group of shapes is a figure if it has no text, or a few short labels among more shapes, and no line crosses its edge.
    """
    size, b = pages.select("book_id", "page", "width", "height"), G.box()
    page_area = F.col("width") * F.col("height")
    filled = lines.select("book_id", "page").distinct().withColumn("has_text", F.lit(True))
    raster = images.join(size, ["book_id", "page"]).join(filled, ["book_id", "page"], "left").where((G.width(b) >= 24) & (G.height(b) >= 24))
    raster = raster.where(~((G.area(b) > 0.85 * page_area) & F.coalesce("has_text", F.lit(False)))).select("book_id", "page", *SIDES)
    drawn = drawings.join(size, ["book_id", "page"]).where(((G.width(b) >= 1) | (G.height(b) >= 1)) & (G.width(b) * G.height(b) <= 0.5 * page_area))
    groups = merged_boxes(drawn.select("book_id", "page", *SIDES)).join(size, ["book_id", "page"])
    groups = groups.where((G.width(b) >= 15) & (G.height(b) >= 15) & (G.area(b) >= 900) & (b[0] >= 2) & (b[1] >= 2) & (b[2] <= F.col("width") - 2) & (b[3] <= F.col("height") - 2))
    told = _with_lines(_numbered(groups), lines, 0.7).where("crossing = 0")
    bare = (F.col("inside") == 0) & (F.col("n") >= 2) & (G.area(b) > 2500)
    labelled = F.col("inside").between(1, 12) & (F.col("n") >= 4) & (F.col("text_area") < 0.25 * G.area(b)) & (F.col("mono") < 0.5) & (F.col("words") < 6)
    return merged_boxes(raster.unionByName(told.where(bare | labelled).select("book_id", "page", *SIDES)), pad=2.0).drop("n")


def ruled_tables(grids: DataFrame, lines: DataFrame) -> DataFrame:
    """book_id, page, x0, y0, x1, y1, rows: grids (with rows as found between rules) that are tables: not code boxes, not boxes behind text, not mostly empty."""
    tidy = F.transform("rows", lambda row: F.transform(row, lambda c: F.replace(T.clean(T.without_ligatures(F.coalesce(c, F.lit("")))), F.lit("\n"), F.lit(" "))))
    wide = F.array_max(F.transform("rows", lambda row: F.size(row)))
    cells = F.flatten("rows")
    full = F.size(F.filter(cells, lambda c: c != ""))
    shaped = _numbered(grids.withColumn("rows", tidy).where((F.size("rows") >= 2) & (wide >= 2)))
    kept = _with_lines(shaped, lines, 0.6).where("mono <= 0.6 and behind = 0").where((full >= 3) & (F.size(cells) - full <= 0.4 * F.size(cells)))
    return kept.select("book_id", "page", *SIDES, "rows")


def outside(lines: DataFrame, regions: DataFrame, share: float = 0.6) -> DataFrame:
    """lines that do not lie in one of the regions of their page."""
    taken = lines.join(regions.select("book_id", "page", *G.boxes_as("r_")), ["book_id", "page"]).where(G.within(G.box(), G.box("r_"), share))
    return lines.join(taken.select("book_id", "line_id").distinct(), ["book_id", "line_id"], "left_anti")


def labelled(regions: DataFrame, lines: DataFrame, most: int = 40) -> DataFrame:
    """regions with labels: the first texts that lie in each."""
    rows = _numbered(regions)
    texts = lines.select("book_id", "page", "line_id", T.strip("text").alias("label"), *G.boxes_as("l_"))
    found = rows.join(texts, ["book_id", "page"]).where(G.within(G.box("l_"), G.box()))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line_id", "label"))), lambda x: x["label"])
    told = found.groupBy("book_id", "page", "region").agg(F.slice(ordered, 1, most).alias("labels"))
    return rows.join(told, ["book_id", "page", "region"], "left").withColumn("labels", F.coalesce("labels", F.array().cast("array<string>"))).drop("region")
