"""Parsed translation entries brought together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_file(entries: DataFrame) -> DataFrame:
    """book_id, file, n, seg_id, text (null where the source is kept), is_keep, doubled: what each file says of a segment.

    `=` wins over texts of the same file, else the last text wins. A text for an id that the file had before doubles it.
    """
    segs = entries.where("entry_type = 'seg'")
    rows = segs.groupBy("book_id", "file", "n", F.col("key").alias("seg_id"))
    # Aggregates only: a window would move and sort all texts once more.
    own = F.when(~F.col("is_keep"), F.col("ord"))
    doubled = F.coalesce(F.max(own) > F.min("ord"), F.lit(False)) | (F.count(own) > 1)
    rows = rows.agg(F.max("is_keep").alias("is_keep"), F.max_by("body", F.struct(~F.col("is_keep"), "ord")).alias("text"), doubled.alias("doubled"))
    return rows.withColumn("text", F.when(~F.col("is_keep"), F.col("text")))


def merged(entries: DataFrame) -> DataFrame:
    """book_id, seg_id, text, is_keep over all files: the last file by name wins."""
    files = by_file(entries).groupBy("book_id", "seg_id").agg(F.max_by(F.struct("text", "is_keep"), "file").alias("w"))
    return files.select("book_id", "seg_id", "w.text", "w.is_keep")


def notes(entries: DataFrame) -> DataFrame:
    """book_id, seg_id, note: the last one of each segment."""
    rows = entries.where("entry_type = 'note'")
    return rows.groupBy("book_id", F.col("key").alias("seg_id")).agg(F.max_by("body", F.struct("file", "ord")).alias("note"))


def proposals(entries: DataFrame) -> DataFrame:
    """book_id, n, ord, term, rendering proposed for the glossary; of lines for one term in a file the last."""
    rows = entries.where("entry_type = 'glossary'")
    return rows.groupBy("book_id", "n", F.col("key").alias("term")).agg(F.max("ord").alias("ord"), F.max_by("body", "ord").alias("rendering"))


def translated(segs: DataFrame, merged_: DataFrame) -> DataFrame:
    """Segments with the text to print: the translation, the source where it is kept, and the source, marked, where none is there."""
    rows = segs.join(merged_.select("book_id", "seg_id", F.col("text").alias("_t"), F.col("is_keep").alias("_k")), ["book_id", "seg_id"], "left")
    return rows.select(*segs.columns, F.coalesce("_t", "text").alias("target"), F.col("_k").isNull().alias("missing"))
