"""The translated book as tables: blocks with target texts, notes behind their blocks, and a gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..schemas import TEXT_TYPES


def translated_blocks(blocks: DataFrame, merged: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """blocks with texts, cells and image texts replaced by their translations; notes follow as blocks of their own (sub 1)."""
    bid = F.concat("ch_id", F.format_string(".b%04d", "pos"))
    cells = merged.where(F.col("seg_id").rlike(r"\.r\d+c\d+$") & ~F.col("is_keep"))
    cells = cells.groupBy("book_id", F.regexp_replace("seg_id", r"\.r\d+c\d+$", "").alias("bid")).agg(F.map_from_entries(F.collect_list(F.struct(F.regexp_extract("seg_id", r"\.(r\d+c\d+)$", 1), "text"))).alias("cells"))
    texts = merged.where(~F.col("seg_id").rlike(r"\.r\d+c\d+$") & ~F.col("is_keep")).select("book_id", "seg_id", F.col("text").alias("new"))
    key = F.when(F.col("type") == "figure", F.concat(bid, F.lit(".alt"))).otherwise(bid)
    rows = blocks.withColumns({"bid": bid, "seg_id": key}).join(texts, ["book_id", "seg_id"], "left").join(cells, ["book_id", "bid"], "left")
    cell = lambda row, r: F.transform(row, lambda x, c: F.coalesce(F.try_element_at(F.col("cells"), F.concat(F.lit("r"), r, F.lit("c"), c)), x))
    rows = rows.withColumns(
        {
            "text": F.when(F.col("type").isin(*TEXT_TYPES), F.coalesce("new", "text")).otherwise(F.col("text")),
            "alt": F.when(F.col("type") == "figure", F.coalesce("new", "alt")).otherwise(F.col("alt")),
            "rows": F.when(F.col("cells").isNotNull(), F.transform("rows", cell)).otherwise(F.col("rows")),
        }
    )
    rows = rows.withColumn("sub", F.lit(0)).select(*blocks.columns, "sub")
    if notes is None:
        return rows
    at = F.regexp_extract("seg_id", r"^(c\d+)\.b(\d+)", 2)
    noted = notes.where(at != "").select("book_id", F.regexp_extract("seg_id", r"^(c\d+)", 1).alias("ch_id"), at.cast("int").alias("pos"), F.col("note").alias("_note"))
    extra = rows.drop("type", "text").join(noted, ["book_id", "ch_id", "pos"]).withColumns({"type": F.lit("note"), "text": F.col("_note"), "sub": F.lit(1)})
    return rows.unionByName(extra.select(*rows.columns))


def translated_chapters(chapters: DataFrame, merged: DataFrame) -> DataFrame:
    """chapters with title translated and the source's title as title_src."""
    titles = merged.where(~F.col("is_keep")).select("book_id", "seg_id", F.col("text").alias("new"))
    rows = chapters.withColumn("seg_id", F.concat("ch_id", F.lit(".t"))).join(titles, ["book_id", "seg_id"], "left")
    return rows.select("book_id", "ch_no", "ch_id", F.coalesce("new", "title").alias("title"), F.col("title").alias("title_src"))


def translated_books(books: DataFrame, merged: DataFrame) -> DataFrame:
    """books with the translated title, the source's as title_src, and the label of the contents."""
    of = lambda seg, name: merged.where((F.col("seg_id") == seg) & ~F.col("is_keep")).select("book_id", F.col("text").alias(name))
    rows = books.join(of("meta.title", "_t"), "book_id", "left").join(of("meta.toc", "_toc"), "book_id", "left")
    return rows.select("book_id", F.coalesce("_t", "title").alias("title"), F.col("title").alias("title_src"), F.coalesce("author", F.lit("")).alias("author"), F.coalesce("_toc", F.lit("Contents")).alias("toc"))


def missing(segs: DataFrame, merged: DataFrame) -> DataFrame:
    """book_id, missing: segments that need a translation and have none. A book may be built if it has no row here."""
    lacking = segs.where(T.needs_translation("text")).join(merged, ["book_id", "seg_id"], "left_anti")
    return lacking.groupBy("book_id").agg(F.count(F.lit(1)).alias("missing"))
