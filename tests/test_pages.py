"""Pages of spans as books: the layout operators by hand-made pages."""

import pytest
from pyspark.sql import functions as F

from folioflow.operators import columns, flow, layout, spans
from folioflow.sources import pages as source

SPAN = "book_id int, page int, line_id bigint, span_no int, text string, size double, font string, flags int, x0 double, y0 double, x1 double, y1 double, dir_x double, dir_y double"
BOX = "book_id int, page int, x0 double, y0 double, x1 double, y1 double"


def span(line, text, y, x=72.0, page=1, size=10.0, font="Helvetica", flags=0, no=0, width=None, dir_x=1.0, dir_y=0.0):
    return (1, page, line, no, text, size, font, flags, x, y, x + (width or 0.5 * size * len(text)), y + size, dir_x, dir_y)


@pytest.fixture()
def made(spark):
    def make(rows, links=(), drawings=(), images=(), grids=(), outline=(), n=2):
        return source.Pages(
            spark.createDataFrame(list(rows), SPAN),
            spark.createDataFrame(list(links), f"{BOX}, link_no int, uri string"),
            spark.createDataFrame([(1, p, 600.0, 800.0) for p in range(1, n + 1)], "book_id int, page int, width double, height double"),
            spark.createDataFrame(list(drawings), f"{BOX}, filled boolean"),
            spark.createDataFrame(list(images), BOX),
            spark.createDataFrame(list(grids), f"{BOX}, rows array<array<string>>"),
            spark.createDataFrame(list(outline), "book_id int, level int, title string, page int, y double"),
        )

    return make


def chapter(n):
    at = 100 * n
    return [
        span(at, f"Chapter {n}: Topic {n}", 80.0, page=n, size=22.0, font="Helvetica-Bold"), span(at + 1, f"The body of chapter {n} in a nor-", 130.0, page=n),
        span(at + 2, "mal font.", 142.0, page=n), span(at + 3, "ls -la /var/log", 170.0, page=n, font="Courier"), span(at + 4, "cat x", 182.0, x=84.0, page=n, font="Courier"),
        span(at + 5, "• first point", 210.0, page=n), span(at + 6, "2. second point", 225.0, page=n), span(at + 7, "up the side", 300.0, page=n, dir_x=0.0, dir_y=1.0),
    ]


def test_outline_code_and_lists(made):
    outline = [(1, 1, "The Book", 1, 0.0), (1, 2, "Chapter 1: Topic 1", 1, 80.0), (1, 2, "Chapter 2: Topic 2", 2, 80.0), (1, 2, "nowhere", 0, 0.0)]
    read = source.read_pages(made(chapter(1) + chapter(2), outline=outline))
    assert [(r.ch_id, r.title) for r in read["chapters"].orderBy("ch_no").collect()] == [("c001", "Chapter 1: Topic 1"), ("c002", "Chapter 2: Topic 2")]
    got = [(r.type, r.text, r.ordered) for r in read["blocks"].where("ch_no = 1").orderBy("pos").collect()]
    assert got == [("para", "The body of chapter 1 in a normal font.", None), ("code", "ls -la /var/log\n  cat x", None), ("item", "first point", False), ("item", "second point", True)]
    assert read["books"].first().title == "Chapter 1: Topic 1" and read["blocks"].where("ch_no = 2").count() == 4


def test_chapters_without_outline(made):
    read = source.read_pages(made(chapter(1) + chapter(2)))
    assert [r.title for r in read["chapters"].orderBy("ch_no").collect()] == ["Chapter 1: Topic 1", "Chapter 2: Topic 2"]
    assert read["books"].first().notes == [flow.NO_OUTLINE]


def test_scanned_books_give_a_note(made):
    book = source.read_pages(made([span(1, "7", 400.0)]))
    assert book["blocks"].count() == 0 and book["books"].first().notes == [f"error: {source.SCANNED}"]


def test_spans(made):
    rows = [
        span(1, "See ", 100.0), span(1, "the ", 100.0, x=92.0, no=1, flags=16), span(1, "site", 100.0, x=112.0, no=2, font="X-Black"), span(1, ", run ", 100.0, x=132.0, no=3),
        span(1, "ls`", 100.0, x=162.0, no=4, flags=8), span(1, " * ", 100.0, x=177.0, no=5, flags=2), span(1, "now", 100.0, x=192.0, no=6), span(2, "All bold ﬁne", 130.0, flags=16),
    ]
    links = [(1, 1, 160.0, 95.0, 180.0, 115.0, 2, "https://b.c"), (1, 1, 190.0, 95.0, 220.0, 115.0, 1, "https://d.e")]
    page = made(rows, links)
    got = {r.line_id: r for r in spans.lines(page.spans, page.links, page.pages).collect()}
    assert got[1].marked == "See **the site**, run [`ls'`](https://b.c) \\* [now](https://d.e)" and got[1].text == "See the site, run ls` * now"
    assert got[2].marked == "All bold fine" and got[2].cell == "**All bold fine**" and got[2].head == "All bold fine" and got[2].bold == 1.0


def test_figures_tables_and_bullets(made):
    prose = [span(10 + k, f"Some words of running text number {k} that go on for a line.", 300.0 + 30 * k) for k in range(4)]
    label = span(30, "a label", 140.0, x=320.0)
    drawings = [(1, 1, 60.0, 303.0, 64.0, 307.0, True), (1, 1, 60.0, 333.0, 64.0, 337.0, False)]  # a dot, and one without a fill
    drawings += [(1, 1, 300.0 + 20 * k, 120.0, 320.0 + 20 * k, 200.0, False) for k in range(5)]  # a diagram with a label
    drawings += [(1, 1, 70.0, 355.0, 300.0, 375.0, True)]  # a box behind text
    drawings += [(1, 1, 0.0, 0.0, 600.0, 800.0, True)]  # the page's ground
    page = made([*prose, label], drawings=drawings, images=[(1, 1, 100.0, 500.0, 200.0, 600.0), (1, 1, 0.0, 0.0, 10.0, 10.0)], grids=[(1, 1, 300.0, 600.0, 400.0, 700.0, [["a", None], ["b\nc", "d"]]), (1, 1, 300.0, 710.0, 400.0, 720.0, [["", ""], ["", "x"]])])
    lines = spans.lines(page.spans, page.links, page.pages)
    bulleted = layout.without_bullets(lines, page.drawings)
    assert [r.line_id for r in bulleted.where("bullet").collect()] == [10]
    found = layout.labelled(layout.figures(page.images, page.drawings, lines, page.pages), lines)
    assert [(r.x0, r.y0, r.x1, r.y1, r.labels) for r in found.orderBy("x0").collect()] == [(100.0, 500.0, 200.0, 600.0, []), (300.0, 120.0, 400.0, 200.0, ["a label"])]
    assert [r.rows for r in layout.ruled_tables(page.grids, lines).collect()] == [[["a", ""], ["b c", "d"]]]
    read = source.read_pages(page)
    got = [(r.type, r.text) for r in read["blocks"].orderBy("pos").collect()]
    assert [t for t, _ in got] == ["figure", "item", "para", "para", "para", "figure", "table"]


def test_columns(made):
    # Heads in the middle of their columns: a row that does not begin where the others do.
    head = [span(1, "Name", 100.0, x=90.0, flags=16), span(2, "What it does", 100.0, x=220.0, flags=16)]
    body = [v for k in range(3) for v in (span(10 + 10 * k, f"term{k}", 120.0 + 40 * k), span(11 + 10 * k, "It does a thing of ki-", 114.0 + 40 * k, x=200.0), span(12 + 10 * k, f"nd {k}", 126.0 + 40 * k, x=200.0))]
    marks = [v for k in range(3) for v in (span(60 + 2 * k, f"{k + 1}.", 400.0 + 14 * k), span(61 + 2 * k, f"step {k}", 400.0 + 14 * k, x=100.0))]
    prose = [span(90, "Text of one line after the others.", 500.0)]
    page = made(head + body + marks + prose)
    found = columns.tables(spans.lines(page.spans, page.links, page.pages)).orderBy("y0").collect()
    assert found[0].kind == "table" and found[0].rows == [["Name", "What it does"], *([f"term{k}", f"It does a thing of kind {k}"] for k in range(3))]
    assert (found[1].kind, found[1].rows) == ("items", [[f"step {k}"] for k in range(3)]) and len(found) == 2
    types = [(r.type, r.ordered) for r in source.read_pages(page)["blocks"].orderBy("pos").collect()]
    assert types == [("table", None), *[("item", True)] * 3, ("para", None)]


def test_paragraphs_across_pages(made):
    rows = [span(1, "It goes on", 700.0), span(2, "to the next page.", 100.0, page=2), span(3, "Short and bold", 130.0, page=2, flags=16), span(4, "New one.", 160.0, page=2), span(5, "indented", 172.0, x=90.0, page=2)]
    got = [(r.type, r.text) for r in source.read_pages(made(rows))["blocks"].orderBy("pos").collect()]
    assert got == [("para", "It goes on to the next page."), ("heading", "Short and bold"), ("para", "New one."), ("para", "indented")]


def test_outline_levels_and_columns(made, spark):
    page = made(chapter(1), outline=[(1, 1, "only", 1, 0.0), (1, 2, "a", 1, 900.0), (1, 2, "b", 2, -5.0)])
    assert [(r.title, r.y) for r in layout.outline_marks(page.outline, page.pages).orderBy("mark_no").collect()] == [("a", 800.0), ("b", 0.0)]
    assert layout.outline_marks(page.outline, page.pages, 1).count() == 0
    rows = spark.createDataFrame([(1, 1, "right", 350.0, 100.0, 500.0, 600.0), (1, 1, "left", 50.0, 300.0, 200.0, 600.0)], "book_id int, page int, text string, x0 double, y0 double, x1 double, width double")
    assert [r.text for r in layout.reading_order(rows, 2).orderBy("line_no").collect()] == ["left", "right"]
