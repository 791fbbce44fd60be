"""Spans of one style to lines of marked text.

spans (book_id, page, line_id, span_no, text, size, font, flags, x0, y0, x1, y1, dir_x, dir_y): what a reader of pages gives, the line_id
being unique in a book; links (book_id, page, link_no, x0, y0, x1, y1, uri); pages (book_id, page, width, height).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import chars as C
from ..functions import geometry as G
from ..functions import text as T

# Parts of the names of fonts, and the bits of a span's flags, that tell its style.
MONO_NAMES = "mono courier consol menlo inconsolata code fixed lucidaconsole typewriter cascadia firacode".split()
BOLD_NAMES = "bold black heavy".split()
ITALIC_NAMES = "italic oblique".split()
ITALIC_BIT, MONO_BIT, BOLD_BIT = 2, 8, 16


def named(font: Column, names: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(font, F.lit(n)) for n in names))


def styled(spans: DataFrame) -> DataFrame:
    """spans with mono, bold and italic."""
    font, flags = F.lower(F.coalesce("font", F.lit(""))), F.coalesce("flags", F.lit(0))
    has = lambda bit: flags.bitwiseAND(bit) > 0
    return spans.withColumns({"mono": has(MONO_BIT) | named(F.replace(font, F.lit(" ")), MONO_NAMES), "bold": has(BOLD_BIT) | named(font, BOLD_NAMES), "italic": has(ITALIC_BIT) | named(font, ITALIC_NAMES)})


def linked(spans: DataFrame, links: DataFrame) -> DataFrame:
    """spans with url: that of the first link whose rectangle holds the span's centre."""
    key = ["book_id", "line_id", "span_no"]
    areas = links.select("book_id", "page", "link_no", "uri", *G.boxes_as("l_"))
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    hits = spans.select(*key, "page", x.alias("x"), y.alias("y")).join(areas, ["book_id", "page"]).where(G.holds(G.box("l_"), F.col("x"), F.col("y")))
    first = hits.groupBy(*key).agg(F.min_by("uri", "link_no").alias("url"))
    return spans.join(first, key, "left")


def markup(spans: Column, all_bold: Column, all_italic: Column) -> Column:
    """The text of an array of spans with marks for code, bold, italic and links; a style that the whole line has needs no mark.

    Neighbours of one style and link are one run. Blanks at a run's ends stay outside of its marks, and runs without a letter or
    digit get none.
    """
    style = lambda s: F.when(s["mono"], "code").when(s["bold"] & ~all_bold, "**").when(s["italic"] & ~all_italic, "*").otherwise("")
    parts = F.transform(spans, lambda s: F.struct(T.without_ligatures(s["text"]).alias("text"), style(s).alias("style"), s["url"].alias("url")))

    def add(runs: Column, part: Column) -> Column:
        last = F.try_element_at(runs, F.lit(-1))
        longer = F.struct(F.concat(last["text"], part["text"]).alias("text"), part["style"].alias("style"), part["url"].alias("url"))
        same = (F.size(runs) > 0) & (last["style"] == part["style"]) & last["url"].eqNullSafe(part["url"])
        return F.when(same, F.concat(F.slice(runs, 1, F.greatest(F.size(runs) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(runs, F.array(part)))

    def shown(run: Column) -> Column:
        return T.let(T.strip(run["text"]), lambda core: around(run, core))

    def around(run: Column, core: Column) -> Column:
        blank = f"[{C.WS}]*"
        wordy, plain = core.rlike(f"[{C.WORD}]"), T.escape_marks(core)
        code = F.concat(F.lit("`"), F.replace(core, F.lit("`"), F.lit("'")), F.lit("`"))
        inner = F.when(~wordy, plain).when(run["style"] == "code", code).otherwise(F.concat(run["style"], plain, run["style"]))
        inner = F.when(run["url"].isNull(), inner).otherwise(F.concat(F.lit("["), inner, F.lit("]("), run["url"], F.lit(")")))
        whole = F.concat(F.regexp_extract(run["text"], f"^{blank}", 0), inner, F.regexp_extract(run["text"], f"{blank}$", 0))
        return F.when(core == "", run["text"]).otherwise(whole)

    empty = F.expr("cast(array() as array<struct<text: string, style: string, url: string>>)")
    return T.clean(F.array_join(F.transform(F.aggregate(parts, empty, add), shown), ""))


def lines(spans: DataFrame, links: DataFrame, pages: DataFrame) -> DataFrame:
    """book_id, page, line_id, box, width, height, text, size, mono, bold, italic, marked, cell, head.

    Shares of characters tell the styles; the size is that of the longest span. marked leaves out styles of the whole line, cell none,
    head only bold. Lines that run upwards or down, and blank ones, are left out.
    """
    flat = spans.where("not (dir_x < 0.9 and abs(dir_y) > 0.1) and text <> ''")
    n = F.length(T.strip("text"))
    share = lambda c: F.sum(F.when(F.col(c), n).otherwise(0))
    fields = ("span_no", "text", "mono", "bold", "italic", "url")
    rows = linked(styled(flat), links).groupBy("book_id", "page", "line_id").agg(
        *(f(side).alias(side) for f, side in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))),
        F.array_sort(F.collect_list(F.struct(*fields))).alias("spans"), F.max_by("size", F.struct(n, -F.col("span_no"))).alias("size"),
        F.greatest(F.sum(n), F.lit(1)).alias("n"), *(share(c).alias(c) for c in ("mono", "bold", "italic")),
    )
    rows = rows.withColumns({c: F.col(c) / F.col("n") for c in ("mono", "bold", "italic")})
    rows = rows.withColumn("text", F.array_join(F.transform("spans", lambda s: s["text"]), "")).where(T.strip("text") != "")
    bold, italic, no = F.col("bold") > 0.9, F.col("italic") > 0.9, F.lit(False)
    told = {"marked": markup(F.col("spans"), bold, italic), "cell": markup(F.col("spans"), no, no), "head": markup(F.col("spans"), F.lit(True), no)}
    return rows.withColumns(told).drop("spans", "n").join(pages.select("book_id", "page", "width", "height"), ["book_id", "page"])
