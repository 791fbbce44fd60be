"""Plain text as blocks, without Python and without a shuffle: each document is one row until its lines are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import chars as C
from ..functions import text as T

# Words that open a chapter's line.
CHAPTER_WORDS = (
    "chapter|part|book|prologue|epilogue|introduction|preface|cap[ií]tulo|chapitre|kapitel|"
    "capitolo|hoofdstuk|rozdzia[lł]|глава|часть|الفصل|الباب|פרק|第.{1,8}[章回节節部]"
)
#: The level of headings that plain text has.
LEVEL = 2
CHAPTER_LINE = rf"(?i)^(?:{CHAPTER_WORDS})(?:$|[^{C.WORD}].{{0,79}}$)"


def is_chapter(line: Column) -> Column:
    return (F.length(line) < 90) & line.rlike(CHAPTER_LINE)


def is_heading(line: Column) -> Column:
    shouted = (line == F.upper(line)) & (line != F.lower(line))
    # Without a small ASCII letter, which most lines have: the cases of others take long to tell.
    return (F.length(line) < 60) & ~line.rlike("[a-z]") & shouted & (T.count_of(line, f"[^{C.WS}]+") <= 8)


def chaptered(text: Column) -> Column:
    """The chapters of a text, in order: titled (whether the first line is its title), lines.

    Blocks are parted by blank lines if there are any, else by line ends. Text before the first chapter's line is an untitled
    chapter. Null and empty texts have none. Each line is read once: the starts of chapters cut the array of all lines.
    """
    whole = F.replace(F.when(F.startswith(text, F.lit("\ufeff")), F.substring(text, 2, 2**31 - 1)).otherwise(text), F.lit("\r\n"), F.lit("\n"))
    parts = T.let(whole, lambda w: F.when(F.contains(w, F.lit("\n\n")), F.split(w, rf"\n[{C.WS}]*\n")).otherwise(F.split(w, "\n")))
    tidy = F.filter(F.transform(parts, lambda p: T.let(F.replace(p, F.lit("\n"), F.lit(" ")), T.clean)), lambda s: s != "")

    def cut(rows: Column) -> Column:
        titles = F.filter(F.transform(rows, lambda s, i: F.when(is_chapter(s), i)), lambda i: i.isNotNull())
        first = F.array(F.lit(0))
        starts = T.let(titles, lambda t: F.when(F.try_element_at(t, F.lit(1)) == 0, F.struct(F.lit(True).alias("titled"), t.alias("at"))).otherwise(F.struct(F.lit(False).alias("titled"), F.concat(first, t).alias("at"))))
        chapter = lambda s, b, k: F.struct((s["titled"] | (k > 0)).alias("titled"), F.slice(rows, b + 1, F.coalesce(F.try_element_at(s["at"], k + 2), F.size(rows)) - b).alias("lines"))
        return T.let(starts, lambda s: F.transform(s["at"], lambda b, k: chapter(s, b, k)))

    return F.filter(T.let(tidy, cut), lambda c: F.size(c["lines"]) > 0)


def lines(docs: DataFrame, book: str = "doc_id", text: str = "text") -> DataFrame:
    """book_id, ch_no, titled, i (place in the chapter, from 0, its title included), line of each block, as chaptered() tells."""
    # Outer: else Spark puts a filter on the array's size in front, and computes the array twice.
    rows = docs.select(F.col(book).alias("book_id"), F.posexplode_outer(chaptered(F.col(text))).alias("k", "c")).where("k is not null")
    return rows.select("book_id", (F.col("k") + 1).alias("ch_no"), F.col("c.titled").alias("titled"), F.posexplode("c.lines").alias("i", "line"))


def book_segments(docs: DataFrame, title: Column, label: str, book: str = "doc_id", text: str = "text") -> DataFrame:
    """book_id, segs: the segments of each text as one array of (seg_no, seg_id, kind, text, ch_id), without a shuffle.

    What segments.segments() gives for read_txt(), for books that are one row each: every line is one segment.
    """
    of = lambda no, seg_id, kind, value, ch_id: F.struct(no.alias("seg_no"), seg_id.alias("seg_id"), kind.alias("kind"), value.alias("text"), ch_id.alias("ch_id"))
    meta = F.array(
        of(F.lit(1), F.lit("meta.title"), F.lit("book-title"), title, F.lit("meta")), of(F.lit(2), F.lit("meta.toc"), F.lit("ui-label"), F.lit(label), F.lit("meta"))
    )

    def line(c: Column, ch_id: Column, s: Column, i: Column) -> Column:
        block = F.struct(F.concat(ch_id, F.format_string(".b%04d", i - c["titled"].cast("int"))).alias("seg_id"), F.when(is_heading(s), f"h{LEVEL}").otherwise("para").alias("kind"), T.escape_marks(s).alias("text"), ch_id.alias("ch_id"))
        return F.when(c["titled"] & (i == 0), F.struct(F.concat(ch_id, F.lit(".t")).alias("seg_id"), F.lit("chapter-title").alias("kind"), s.alias("text"), ch_id.alias("ch_id"))).otherwise(block)

    chapter = lambda c, k: T.let(F.format_string("c%03d", k + 1), lambda ch_id: F.transform(c["lines"], lambda s, i: line(c, ch_id, s, i)))
    own = F.transform(F.flatten(F.transform(chaptered(F.col(text)), chapter)), lambda x, i: of(i + 3, x["seg_id"], x["kind"], x["text"], x["ch_id"]))
    none = F.array().cast("array<struct<seg_no: int, seg_id: string, kind: string, text: string, ch_id: string>>")
    return docs.select(F.col(book).alias("book_id"), F.concat(meta, F.coalesce(own, none)).alias("segs"))


def chapter_id(ch_no: Column | str) -> Column:
    return F.format_string("c%03d", T.col(ch_no))


def read_txt(docs: DataFrame, book: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Chapters (book_id, ch_no, ch_id, title) and blocks (book_id, ch_no, ch_id, pos, type, level, text and the other fields, null)."""
    return tables(lines(docs, book, text))


def tables(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """read_txt() of lines(), which may have been written first: then the texts are read once for both tables."""
    found = found.withColumn("ch_id", chapter_id("ch_no"))
    chapters = found.where("i = 0").select("book_id", "ch_no", "ch_id", F.when(F.col("titled"), F.col("line")).otherwise("").alias("title"))
    heading, at = is_heading(F.col("line")), F.col("i") - F.col("titled").cast("int")
    blocks = found.where(at >= 0).select(
        "book_id", "ch_no", "ch_id", at.alias("pos"),
        F.when(heading, "heading").otherwise("para").alias("type"), F.when(heading, LEVEL).alias("level"), T.escape_marks("line").alias("text"),
        *(F.lit(None).cast(t).alias(n) for n, t in (("ordered", "boolean"), ("depth", "int"), ("rows", "array<array<string>>"), ("header", "boolean"), ("file", "string"), ("alt", "string"), ("labels", "array<string>"))),
    )
    return chapters, blocks
