"""Blocks as segments: every translatable unit of a book, in reading order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import chars as C
from ..functions import text as T
from ..schemas import TEXT_TYPES

CONTENTS = "Contents"


def segments(books: DataFrame, chapters: DataFrame, blocks: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """book_id, seg_no (from 1), seg_id, kind, text, ch_id of books (book_id, title), chapters and blocks.

    Chapters in excluded (book_id, ch_id) are left out before their blocks are taken apart.
    """
    if excluded is not None:
        gone = excluded.select("book_id", "ch_id").distinct()
        chapters, blocks = (x.join(gone, ["book_id", "ch_id"], "left_anti") for x in (chapters, blocks))
    key = lambda ch, pos=-1, r=-1, c=-1: F.struct(*(F.lit(v).cast("int") if isinstance(v, int) else v.cast("int") for v in (ch, pos, r, c)))
    meta = F.inline(
        F.array(
            F.struct(F.lit("meta.title").alias("seg_id"), F.lit("book-title").alias("kind"), F.col("title").alias("text"), key(-2).alias("at")),
            F.struct(F.lit("meta.toc").alias("seg_id"), F.lit("ui-label").alias("kind"), F.lit(CONTENTS).alias("text"), key(-1).alias("at")),
        )
    )
    out = books.select("book_id", meta).withColumn("ch_id", F.lit("meta"))
    titles = chapters.where("title <> ''").select("book_id", F.concat("ch_id", F.lit(".t")).alias("seg_id"), F.lit("chapter-title").alias("kind"), F.col("title").alias("text"), key(F.col("ch_no")).alias("at"), "ch_id")
    block_id = F.concat("ch_id", F.format_string(".b%04d", "pos"))
    kind = F.when(F.col("type") == "heading", F.concat(F.lit("h"), "level")).otherwise(F.col("type"))
    kind = F.when(F.col("type") == "figure", "image-alt").otherwise(kind)
    plain = F.col("type").isin(*TEXT_TYPES) | (F.col("type") == "figure") & F.coalesce(F.col("alt").rlike(f"[{C.LETTER}]"), F.lit(False))
    figure = F.col("type") == "figure"
    texts = blocks.where(plain).select(
        "book_id", F.when(figure, F.concat(block_id, F.lit(".alt"))).otherwise(block_id).alias("seg_id"), kind.alias("kind"),
        F.when(figure, F.col("alt")).otherwise(F.col("text")).alias("text"), key(F.col("ch_no"), F.col("pos")).alias("at"), "ch_id",
    )
    rows = blocks.where("type = 'table'").select("book_id", "ch_no", "ch_id", "pos", block_id.alias("block_id"), F.posexplode("rows").alias("r", "row"))
    cells = rows.select("*", F.posexplode("row").alias("c", "cell")).where(T.strip("cell") != "")
    cells = cells.select("book_id", F.concat("block_id", F.format_string(".r%dc%d", "r", "c")).alias("seg_id"), F.lit("table-cell").alias("kind"), F.col("cell").alias("text"), key(F.col("ch_no"), F.col("pos"), F.col("r"), F.col("c")).alias("at"), "ch_id")
    every = out.unionByName(titles).unionByName(texts).unionByName(cells)
    return every.withColumn("seg_no", F.row_number().over(Window.partitionBy("book_id").orderBy("at"))).select("book_id", "seg_no", "seg_id", "kind", "text", "ch_id")


def kinds(segs: DataFrame) -> DataFrame:
    """How many segments each kind has, with the words and tokens in them."""
    return segs.groupBy("kind").agg(F.count(F.lit(1)).alias("segments"), F.sum(T.word_count("text")).alias("words"), F.sum(T.estimate_tokens("text")).alias("tokens"))


def suggest_excludes(chapters: DataFrame, blocks: DataFrame) -> DataFrame:
    """book_id, ch_id, reason of chapters that look like contents, an index or advertising, by their title or their lines."""
    # Titles of such chapters.
    words = (
        "contents?|content list|table of contents|toc|index|credits|you may also like|also by|about the author|copyright|"
        "table des mati[eè]res|inhaltsverzeichnis|[ií]ndice|sommaire|содержание|оглавление"
    )
    named = rf"(?:^|[^{C.WORD}])(?:{words})(?:$|[^{C.WORD}])|فهرس|المحتويات|目录|目次|목차"
    by_title = chapters.where(F.lower("title").rlike(named)).select("book_id", "ch_id", F.lit("title").alias("reason"))
    counted = listed_lines(chapters, blocks).join(by_title, ["book_id", "ch_id"], "left_anti")
    return by_title.unionByName(counted.where("n >= 8 and hits > 0.5 * n").select("book_id", "ch_id", F.lit("lines").alias("reason")))


def listed_lines(chapters: DataFrame, blocks: DataFrame) -> DataFrame:
    """book_id, ch_id, n, hits: blocks of text, and those that equal a chapter's title or end in a page number."""
    titles = chapters.where("title <> ''").select("book_id", T.normal_title("title").alias("norm")).distinct()
    texts = blocks.where(F.col("type").isin(*TEXT_TYPES))
    bare = T.normal_title(F.regexp_replace("text", rf"[{C.DIGIT}]+[{C.WS}]*$", ""))
    d, ws = f"[{C.DIGIT}]", f"[{C.WS}]"
    listed = F.col("text").rlike(rf"(\.{{3,}}|{ws}){d}{{1,4}}{ws}*$") | F.col("text").rlike(rf"(?:\.{ws}?){{4,}}{ws}*{d}") | F.col("text").rlike(rf"^{ws}*{d}{{1,3}}\.?{ws}*$")
    hits = texts.select("book_id", "ch_id", bare.alias("norm"), listed.alias("listed")).join(titles.withColumn("titled", F.lit(True)), ["book_id", "norm"], "left")
    hit = (F.col("listed") | F.coalesce("titled", F.lit(False))).cast("int")
    return hits.groupBy("book_id", "ch_id").agg(F.count(F.lit(1)).alias("n"), F.sum(hit).alias("hits"))


def show(blocks: DataFrame, ch_id: str, first: int = 0, last: int | None = None, translations: DataFrame | None = None, width: int = 160) -> DataFrame:
    """The blocks of a chapter, from first to last, cut to a preview, with their translations if given."""
    part = blocks.where((F.col("ch_id") == ch_id) & (F.col("pos") >= first))
    part = part if last is None else part.where(F.col("pos") <= last)
    shown = F.coalesce("text", "alt", F.to_json("rows"), F.lit(""))
    out = part.select("book_id", "pos", "type", F.concat("ch_id", F.format_string(".b%04d", "pos")).alias("seg_id"), F.substring(shown, 1, width).alias("preview"))
    if translations is not None:
        out = out.join(translations.select("book_id", "seg_id", F.substring("text", 1, width).alias("translation")), ["book_id", "seg_id"], "left")
    return out
