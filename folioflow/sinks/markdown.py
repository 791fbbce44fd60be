"""Books as Markdown: an expression for each block, then texts in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import inline
from ..functions import text as T


def _row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def block_text() -> Column:
    """The lines of a block, a blank one behind all but list items."""
    c = F.col
    hashes = F.repeat(F.lit("#"), F.least(F.coalesce("level", F.lit(2)) + 2, F.lit(6)))
    fence = F.when(F.contains("text", F.lit("```")), "````").otherwise("```")
    width = F.array_max(F.transform("rows", F.size))
    padded = F.transform("rows", lambda r: F.concat(F.transform(r, lambda x: F.replace(x, F.lit("|"), F.lit("\\|"))), F.array_repeat(F.lit(""), width - F.size(r))))
    table = F.concat_ws("\n", _row(F.element_at(padded, 1)), F.concat(F.lit("|"), F.repeat(F.lit("---|"), width)), F.array_join(F.transform(F.slice(padded, 2, F.greatest(F.size("rows") - 1, F.lit(0))), _row), "\n"))
    table = F.regexp_replace(table, r"\n+\z", "")
    item = F.concat(F.repeat(F.lit("  "), F.coalesce("depth", F.lit(0))), F.when(c("ordered"), "1. ").otherwise("- "), "text")
    cases = {
        "heading": F.concat(hashes, F.lit(" "), "text"),
        "para": c("text"),
        "caption": c("text"),
        "quote": F.concat(F.lit("> "), "text"),
        "note": F.concat(F.lit("> ✎ "), "text"),
        "item": item,
        "code": F.concat(fence, F.lit("\n"), "text", F.lit("\n"), fence),
        "table": F.when(F.size("rows") > 0, table),
        "figure": F.concat(F.lit("!["), F.coalesce("alt_plain", F.lit("")), F.lit("]("), "file", F.lit(")")),
        "rule": F.lit("---"),
    }
    out = None
    for kind, text in cases.items():
        out = F.when(c("type") == kind, text) if out is None else out.when(c("type") == kind, text)
    return F.concat(out, F.when(c("type") == "item", "").otherwise("\n"))


def render(books: DataFrame, chapters: DataFrame, blocks: DataFrame) -> DataFrame:
    """book_id, text of books (title, author), chapters (title) and blocks (with sub, as translated_blocks() gives them)."""
    plain = F.when(inline.unmarked(F.col("alt")), F.col("alt")).otherwise(F.regexp_replace("alt", r"\\([*`\[\]\\])", "$1"))
    own = blocks.withColumn("alt_plain", plain).select("book_id", "ch_no", F.col("pos").alias("pos"), "sub", block_text().alias("line")).where("line is not null")
    # A chapter's title and its end in one pass over the chapters.
    edge = lambda pos, line: F.struct(F.lit(pos).alias("pos"), F.lit(0).alias("sub"), line.alias("line"))
    title = F.when(F.col("title") != "", F.concat(F.lit("## "), "title", F.lit("\n")))
    edges = chapters.select("book_id", "ch_no", F.inline(F.array(edge(-1, title), edge(2**31 - 1, F.lit(""))))).where("line is not null")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("ch_no", "pos", "sub", "line"))), lambda x: x["line"])
    body = own.unionByName(edges).groupBy("book_id").agg(F.array_join(lines, "\n").alias("body"))
    author = F.when(F.coalesce("author", F.lit("")) != "", F.concat("author", F.lit("\n\n"))).otherwise("")
    text = F.concat(F.lit("# "), "title", F.lit("\n\n"), author, F.coalesce("body", F.lit("")))
    # A list ends with a blank line.
    text = F.regexp_replace(text, r"(\n[ \t]*(?:-|1\.) [^\n]*)\n(?=[^\s\-1])", "$1\n\n")
    return books.join(body, "book_id", "left").select("book_id", text.alias("text"))
