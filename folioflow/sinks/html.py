"""Books as HTML: fragments of blocks, lists nested by a fold over each chapter, chapters put in order."""

from __future__ import annotations

import html
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import inline, languages

STYLE = """body{font-family:"Segoe UI","Noto Sans",Arial,sans-serif;line-height:1.6;max-width:46rem;margin:2rem auto;padding:0 1rem}
h1.chapter{border-bottom:1px solid #999;margin-top:4rem}pre,code{font-family:Consolas,"DejaVu Sans Mono",monospace;direction:ltr;unicode-bidi:isolate}
pre{white-space:pre-wrap;background:#f5f5f5;padding:.7em}table{border-collapse:collapse}td,th{border:1px solid #999;padding:.3em .6em}
blockquote{border-inline-start:3px solid #999;margin-inline:0;padding-inline-start:1em}aside.tnote{background:#fff8dc;padding:.5em 1em}
p.caption{font-size:.9em;text-align:center}figure img{max-width:100%}.cover{text-align:center;margin:4rem 0}nav.toc ol{list-style:none}"""


class Lists:
    """Opens and closes lists as items of different depth and kind follow one another."""

    def __init__(self) -> None:
        self.open: list[str] = []

    def close(self, keep: int = 0) -> str:
        ends = [f"</li></{name}>" for name in reversed(self.open[keep:])]
        del self.open[keep:]
        return "".join(ends)

    def item(self, depth: int, ordered: bool) -> str:
        name = "ol" if ordered else "ul"
        out = self.close(depth + 1)
        if len(self.open) == depth + 1:
            if self.open[-1] == name:
                return out + "</li><li>"
            out += self.close(depth)
        while len(self.open) <= depth:
            self.open.append(name)
            out += f"<{name}><li>"
        return out


def direction(text: str, rtl: bool) -> str:
    return ' dir="ltr"' if rtl and not inline.RTL_LETTER.search(inline.plain(text)) else ""


def fragment(b: dict, rtl: bool = False, section: str = "") -> str:
    """One block; items without their list."""
    kind, text = b["type"], b.get("text") or ""
    d = direction(text, rtl)
    if kind == "heading":
        level = min(max(int(b.get("level") or 2), 1) + 1, 5)
        return f"<h{level}{section}{d}>{inline.to_html(text)}</h{level}>"
    if kind == "code":
        short = ' class="short"' if text.count("\n") < 30 else ""
        return f'<pre dir="ltr"{short}><code>{html.escape(text)}</code></pre>'
    if kind == "table":
        row = lambda cells, tag: "<tr>" + "".join(f"<{tag}>{inline.to_html(c)}</{tag}>" for c in cells) + "</tr>"
        rows = [list(r) for r in (b["rows"] if b.get("rows") is not None else [])]
        head = bool(b.get("header")) and bool(rows)
        top = f"<thead>{row(rows[0], 'th')}</thead>" if head else ""
        return f"<table>{top}<tbody>{''.join(row(r, 'td') for r in rows[head:])}</tbody></table>"
    if kind == "figure":
        return f'<figure><img src="{html.escape(b["file"] or "")}" alt="{html.escape(inline.plain(b.get("alt")))}"></figure>'
    inner = inline.to_html(text)
    return {
        "para": f"<p{d}>{inner}</p>",
        "quote": f"<blockquote><p{d}>{inner}</p></blockquote>",
        "caption": f'<p class="caption"{d}>{inner}</p>',
        "note": f'<aside class="tnote">{inner}</aside>',
        "item": f"<span{d}>{inner}</span>" if d else inner,
        "rule": "<hr>",
    }.get(kind, "")


def chapter_body(blocks: list[dict], rtl: bool = False, ch_id: str = "") -> str:
    lists, out = Lists(), []
    for b in blocks:
        if b["type"] == "item":
            out.append(lists.item(int(b.get("depth") or 0), bool(b.get("ordered"))))
        elif lists.open:
            out.append(lists.close())
        out.append(fragment(b, rtl, f' id="{ch_id}-s{b["pos"]}"' if ch_id else ""))
    return "\n".join(x for x in [*out, lists.close()] if x)


FIELDS = ("pos", "sub", "type", "level", "text", "ordered", "depth", "rows", "header", "file", "alt")


def chapter_bodies(blocks: DataFrame, rtl: bool = False) -> DataFrame:
    """book_id, ch_no, ch_id, body: a chapter is one group; books and chapters spread over the cluster."""
    gathered = blocks.groupBy("book_id", "ch_no", "ch_id").agg(F.collect_list(F.struct(*FIELDS)).alias("blocks"))
    id_type = dict(blocks.dtypes)["book_id"]

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            bodies = [chapter_body(sorted(b, key=lambda x: (x["pos"], x["sub"])), rtl, c) for b, c in zip(frame.blocks, frame.ch_id, strict=True)]
            yield frame[["book_id", "ch_no", "ch_id"]].assign(body=bodies)

    return gathered.mapInPandas(each, f"book_id {id_type}, ch_no int, ch_id string, body string")


def render(books: DataFrame, chapters: DataFrame, blocks: DataFrame, target_lang: str = "fr", source_lang: str = "en") -> DataFrame:
    """book_id, text: a page for each book, with cover, contents and chapters."""
    lang = languages.describe(target_lang)
    bodies = chapter_bodies(blocks, lang["dir"] == "rtl")
    rows = chapters.join(bodies.select("book_id", "ch_id", "body"), ["book_id", "ch_id"], "left").withColumn("shown", inline.html_of("title"))
    heading = F.concat(F.lit('<h1 class="chapter" id="'), "ch_id", F.lit('"'), F.when(F.col("title") == "", ' style="border:0"').otherwise(""), F.lit(">"), "shown", F.lit("</h1>"))
    section = F.concat(F.lit('<section class="chapter-body">'), heading, F.lit("\n"), F.coalesce("body", F.lit("")), F.lit("</section>"))
    entry = F.when(F.col("title") != "", F.concat(F.lit('<li><a href="#'), "ch_id", F.lit('">'), "shown", F.lit("</a></li>"))).otherwise("")
    ordered = F.array_sort(F.collect_list(F.struct("ch_no", section.alias("section"), entry.alias("entry"))))
    parts = rows.groupBy("book_id").agg(F.array_join(F.transform(ordered, lambda x: x["section"]), "\n").alias("sections"), F.array_join(F.transform(ordered, lambda x: x["entry"]), "").alias("entries"))
    shown = books.join(parts, "book_id", "left").withColumns({"t": inline.html_of("title"), "p": inline.plain_of("title"), "s": inline.plain_of("title_src"), "label": inline.html_of("toc")})
    from ..functions import text as T

    original = F.when(F.col("s") != F.col("p"), F.concat(F.lit(f'<div class="orig" lang="{languages.normal_code(source_lang)}" dir="auto">'), T.html_escape("s"), F.lit("</div>"))).otherwise("")
    author = F.when(F.col("author") != "", F.concat(F.lit('<div class="author" dir="auto">'), T.html_escape("author"), F.lit("</div>"))).otherwise("")
    text = F.concat(
        F.lit(f'<!DOCTYPE html>\n<html lang="{lang["code"]}" dir="{lang["dir"]}">\n<head>\n<meta charset="utf-8">\n<title>'), T.html_escape("p"),
        F.lit(f'</title>\n<meta name="viewport" content="width=device-width, initial-scale=1">\n<style>{STYLE}</style>\n</head>\n<body>\n<main>\n<section class="cover"><h1>'), "t", F.lit("</h1>"), original, author,
        F.lit('</section>\n<nav class="toc"><h2>'), "label", F.lit("</h2><ol>"), F.coalesce("entries", F.lit("")), F.lit("</ol></nav>\n"), F.coalesce("sections", F.lit("")), F.lit("\n</main>\n</body>\n</html>\n"),
    )
    return shown.select("book_id", text.alias("text"))
