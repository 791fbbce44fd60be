import io
import zipfile
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from folioflow.operators import checks, chunks, layout, lifecycle, segments, terms, translations
from folioflow.sinks import html, markdown, model, packages
from folioflow.sources import reader, txt
from folioflow.sources.translations import entries

MD = """---
title: "A Book"
author: Ann Author
---
# One

Hello **bold** and *it*, see [site](https://a.b) or me@x.org.

## Part

- first
- second
  - nested

| Name | Size |
|---|---|
| one | 1 |

Run `ls -l` now:

```bash
ls -l
```

# Two

The end of it.
"""
FR = """@@ meta.title
Un livre
@@ meta.toc
Table
@@ c001.t
Un
@@ c001.b0000
Bonjour **gras** et *it*, voir [site](https://a.b) ou me@x.org.
@@ c001.b0001
Partie
@@ c001.b0002
premier
@@ c001.b0003
second point
@@ c001.b0004
imbriqué
@@ c001.b0005.r0c0
Nom
@@ c001.b0005.r0c1
Taille
@@ c001.b0005.r1c0
un
@@ c001.b0006
Lancez `ls -l` maintenant :
@@ c002.t
Deux
@@ c002.b0000
La fin.
"""


def read(spark, name, data):
    files = spark.createDataFrame([(1, name, bytearray(data if isinstance(data, bytes) else data.encode()))], "book_id long, path string, content binary")
    return reader.tables(reader.parsed(files))


@pytest.fixture(scope="module")
def book(spark):
    t = {k: v.cache() for k, v in read(spark, "x/book.md", MD).items()}
    t["segs"] = segments.segments(t["books"], t["chapters"], t["blocks"]).cache()
    t["members"] = chunks.chunk_segments(t["segs"], 2500).cache()
    return t


def files(spark, text, n=1):
    return entries(spark.createDataFrame([(1, f"{n:04d}.txt", n, text)], "book_id long, file string, n int, text string"))


def found(book, spark, text, **more):
    none = spark.createDataFrame([], "book_id long, term string, rendering string")
    options = {"glossary": none, "keep": none.select("book_id", "term")} | more
    return [(r.rule, r.seg_id, r.detail) for r in checks.check(book["members"], book["segs"], files(spark, text), **options).collect()]


def test_markdown_blocks(book):
    assert book["books"].first().title == "A Book" and [r.title for r in book["chapters"].orderBy("ch_no").collect()] == ["One", "Two"]
    kinds = [(r.type, r.depth) for r in book["blocks"].where("ch_no = 1").orderBy("pos").collect()]
    assert kinds == [("para", None), ("heading", None), ("item", 0), ("item", 0), ("item", 1), ("table", None), ("para", None), ("code", None)]


def test_segments_and_chunks(book):
    ids = [r.seg_id for r in book["segs"].orderBy("seg_no").collect()]
    assert ids[:4] == ["meta.title", "meta.toc", "c001.t", "c001.b0000"] and ids[-1] == "c002.b0000" and len(ids) == 15
    assert book["members"].count() == 14 and chunks.automatic(book["segs"]).first().seg_id == "c001.b0005.r1c1"
    small = chunks.chunk_segments(book["segs"], 12)
    assert [r.seg_no for r in small.orderBy("n", "seg_no").collect()] == sorted(r.seg_no for r in small.collect())
    assert all(r.tokens <= 12 or len(r.ids) == 1 for r in chunks.chunks(small).collect())


def test_good_translation_has_no_findings(book, spark):
    assert found(book, spark, FR) == []


def test_findings(book, spark):
    bad = FR.replace("(https://a.b)", "").replace("@@ c002.b0000\nLa fin.\n", "@@ c009.b0000\nx\n").replace("`ls -l` maintenant", "ls maintenant")
    rules = found(book, spark, bad)
    assert ("E-VERBATIM", "c001.b0000", ["https://a.b"]) in rules and ("E-VERBATIM", "c001.b0006", ["`ls -l`"]) in rules
    assert ("E-MISSING", "c002.b0000", []) in rules and ("E-FOREIGN", "c009.b0000", []) in rules and ("W-LINK", "c001.b0000", []) in rules
    assert ("E-EMPTY", "c002.b0000", []) in found(book, spark, FR.replace("La fin.", ""))
    assert ("E-IDENTICAL", "c002.b0000", []) in found(book, spark, FR.replace("La fin.", "The end of it."))
    assert ("E-DUP", "c002.t", []) in found(book, spark, FR + "@@ c002.t\nDeux\n")
    assert ("E-NOTES-OFF", None, ["1"]) in found(book, spark, FR + "@@ note c002.t\nhm\n")
    assert found(book, spark, FR + "@@ note c002.t\nhm\n", notes_allowed=True) == []
    assert ("E-SCRIPT", "c002.b0000", []) in found(book, spark, FR, target_lang="ar")
    terms_ = spark.createDataFrame([(1, "end", "bout"), (1, "hello (word)", "bonjour")], "book_id long, term string, rendering string")
    assert [r for r in found(book, spark, FR, glossary=terms_) if r[0] == "W-GLOSSARY"] == [("W-GLOSSARY", "c002.b0000", ["end", "bout"])]


def test_translation_grammar(spark):
    rows = files(spark, "@@ a.1 para\nHello\nworld\n\n@@ a.2 =\n@@ -- code\nx\n@@ glossary\nfoo => bar\nno\n@@ note a.1\nhm\n@@ a.1\nagain")
    assert [(r.entry_type, r.key, r.body, r.is_keep) for r in rows.orderBy("ord").collect()] == [
        ("seg", "a.1", "Hello\nworld", False), ("seg", "a.2", None, True), ("glossary", "foo", "bar", False), ("note", "a.1", "hm", False), ("seg", "a.1", "again", False),
    ]
    by = {r.seg_id: r for r in translations.by_file(rows).collect()}
    assert by["a.1"].text == "again" and by["a.1"].doubled and by["a.2"].is_keep and not by["a.2"].doubled
    both = rows.unionByName(entries(spark.createDataFrame([(1, "0002.txt", 2, "@@ a.1 =")], "book_id long, file string, n int, text string")))
    assert {r.seg_id: r.is_keep for r in translations.merged(both).collect()} == {"a.1": True, "a.2": True}


def test_glossary_paths_agree(book, spark):
    rows = [(1, t, "x") for t in ("end", "the end", "Bold", "ls", "C#", "site", "part", "of it", "a b c d e")]
    g = spark.createDataFrame(rows, "book_id long, term string, rendering string")
    fast, plain = ({(r.seg_id, r.term) for r in f(book["segs"], g).collect()} for f in (terms.glossary_hits, terms.glossary_hits_plain))
    assert fast == plain and ("c002.b0000", "the end") in fast and not any(t == "ls" for _, t in fast)
    odd = spark.createDataFrame([(1, "a", "see /etc/os-release, os-release, C# and a-b-a")], "book_id long, seg_id string, text string")
    g = spark.createDataFrame([(1, t, "x") for t in ("os", "release", "c#", "a b", "a", "c")], "book_id long, term string, rendering string")
    fast, plain = ({r.term for r in f(odd, g).collect()} for f in (terms.glossary_hits, terms.glossary_hits_plain))
    assert fast == plain == {"os", "release", "c#", "a", "c"}


def test_rendering(book, spark):
    merged = translations.merged(files(spark, FR)).cache()
    notes = spark.createDataFrame([(1, "c002.b0000", "a note")], "book_id long, seg_id string, note string")
    blocks = model.translated_blocks(book["blocks"], merged, notes).cache()
    books, chapters = model.translated_books(book["books"], merged), model.translated_chapters(book["chapters"], merged)
    text = markdown.render(books, chapters, blocks).first().text
    assert text.startswith("# Un livre\n\nAnn Author\n\n## Un\n") and "| Nom | Taille |\n|---|---|\n| un | 1 |" in text and "```\nls -l\n```" in text and "> ✎ a note" in text
    page = html.render(books, chapters, blocks, "fr").first().text
    assert '<html lang="fr" dir="ltr">' in page and "<ul><li>premier" in page.replace("\n", "") and "</li></ul></li></ul>" in page and '<a href="#c002">Deux</a>' in page
    gathered = packages.gathered(books, chapters, blocks, book["assets"])
    with zipfile.ZipFile(io.BytesIO(packages.render(gathered, packages.epub, "ar").first().content)) as z:
        assert z.namelist()[0] == "mimetype" and z.infolist()[0].compress_type == zipfile.ZIP_STORED
        for name in z.namelist():
            if name.endswith(("xhtml", "opf", "ncx", "xml")):
                ElementTree.fromstring(z.read(name))
        assert 'page-progression-direction="rtl"' in z.read("OEBPS/content.opf").decode()
        epub = packages.render(gathered, packages.epub, "fr").first().content
    again = read(spark, "b.epub", bytes(epub))
    assert [r.title for r in again["chapters"].orderBy("ch_no").collect()][-2:] == ["Un", "Deux"] and again["books"].first().language == "fr"
    with zipfile.ZipFile(io.BytesIO(packages.render(gathered, packages.docx, "ar").first().content)) as z:
        document = z.read("word/document.xml").decode()
        assert "<w:bidi/>" in document and "<w:bidiVisual/>" in document and all(ElementTree.fromstring(z.read(n)) is not None for n in z.namelist())
    docx = read(spark, "b.docx", bytes(packages.render(gathered, packages.docx, "fr").first().content))
    assert docx["blocks"].where("type = 'item'").count() == 3 and docx["blocks"].where("text like '%**gras**%'").count() == 1
    assert model.missing(book["segs"], merged).count() == 0


def test_html_reader(spark):
    page = """<html lang="en"><title>T</title><h1>A</h1><p>A <b>bold</b> word, <code>x = 1</code> and <a href="https://a.b">a link</a>.</p>
    <div hidden>no</div><p>yes</p><div style="display: none">no<p>no</p></div><p>also</p><pre>  a
   b</pre><h1>B</h1><blockquote>z</blockquote>"""
    t = read(spark, "p.html", page)
    rows = [(r.type, r.text) for r in t["blocks"].orderBy("ch_no", "pos").collect()]
    assert rows == [("para", "A **bold** word, `x = 1` and [a link](https://a.b)."), ("para", "yes"), ("para", "also"), ("code", "  a\n   b"), ("quote", "z")]
    assert read(spark, "p.xyz", "q")["books"].first().notes == ["error: no reader for p.xyz"]


def test_txt_reader(spark):
    docs = spark.createDataFrame([(1, "CHAPTER 1\n\nOne\nline.\n\nCHAPTER 2\n\nBIG WORDS\n\nTwo."), (2, "a\nb"), (3, None), (4, "")], "doc_id long, text string")
    chapters, blocks = txt.read_txt(docs)
    assert {(r.book_id, r.ch_id, r.title) for r in chapters.collect()} == {(1, "c001", "CHAPTER 1"), (1, "c002", "CHAPTER 2"), (2, "c001", "")}
    assert [(r.ch_id, r.pos, r.type, r.text) for r in blocks.where("book_id = 1").orderBy("ch_no", "pos").collect()] == [("c001", 0, "para", "One line."), ("c002", 0, "heading", "BIG WORDS"), ("c002", 1, "para", "Two.")]
    same = read(spark, "d.txt", docs.first().text)
    assert [r.text for r in same["blocks"].orderBy("ch_no", "pos").collect()] == ["One line.", "BIG WORDS", "Two."]


def test_lifecycle(book, spark):
    members = chunks.chunk_segments(book["segs"], 12)
    plan = chunks.chunks(members).cache()
    assert plan.count() > 2
    state = spark.createDataFrame([(1, 2, "2020", 0, 5.0)], "book_id long, n int, claimed_at string, errors int, checked_mtime double")
    mtimes = spark.createDataFrame([(1, 1, 9.0), (1, 2, 5.0)], "book_id long, n int, file_mtime double")
    row = lifecycle.status(lifecycle.chunk_states(plan, mtimes, state)).first()
    assert (row.ok, row.stale, row.stale_chunks, row.pending) == (1, 1, [1], plan.count() - 2)
    some = files(spark, "@@ meta.title\nT\n")
    assert [r.n for r in lifecycle.next_chunks(members, plan, some, state, 2).orderBy("n").collect()] == [1, 3]
    tasks = {r.n: r for r in lifecycle.task_texts(members, book["segs"], some, blocks=book["blocks"]).collect()}
    assert tasks[1].partial and "@@ meta.title" not in tasks[1].text.split("## Segments")[1] and "@@ -- meta.title\nT" in tasks[2].text
    assert any("@@ -- code (context only, stays as it is)\nls -l" in t.text for t in tasks.values())
    assert "SRC: A Book\nTGT: T\n" in lifecycle.review_sheets(members, book["segs"], some).first().text
    assert "2 Two" not in lifecycle.report(book["chapters"], book["blocks"], book["segs"], plan, chunks.automatic(book["segs"])).first().report


def test_remap(book, spark):
    t = read(spark, "x/book.md", MD.replace("# One\n", "# One\n\nA new first paragraph.\n"))
    new = segments.segments(t["books"], t["chapters"], t["blocks"])
    moved = {r.old_id: r.new_id for r in lifecycle.remap(book["segs"], new).collect()}
    assert moved["c001.b0000"] == "c001.b0001" and moved["c002.b0000"] == "c002.b0000" and len(moved) == 15
    members = chunks.chunk_segments(new)
    carried = lifecycle.carried_over(translations.merged(files(spark, FR)), lifecycle.remap(book["segs"], new), members)
    lacking = lifecycle.to_do(members, entries(carried.withColumn("file", F.lit("0001.txt"))))
    assert [(r.seg_id, r.partial) for r in lacking.collect()] == [("c001.b0000", True)]


def test_layout(spark):
    lines = [(1, p, x, y, x + 100, y + 10, t, s, m, 800.0, 600.0) for p in (1, 2, 3) for x, y, t, s, m in ((50.0, 20.0, f"My Book {p}", 10.0, False), (50.0, 100.0, "A large title", 22.0, False), (50.0, 200.0, "Some text that is broken by a hy-", 10.0, False), (50.0, 212.0, "phen here.", 10.0, False), (50.0, 300.0, "x = 1", 9.0, True))]
    rows = spark.createDataFrame(lines, "book_id int, page int, x0 double, y0 double, x1 double, y1 double, text string, size double, mono boolean, height double, width double")
    pages = rows.select("book_id", "page").distinct()
    assert layout.body_size(rows).first().body == 10.0 and not layout.scanned(rows, pages).first().is_scan
    kept = layout.reading_order(layout.without_furniture(rows, pages))
    assert kept.where("text like 'My Book%'").count() == 0 and [r.sizes for r in layout.heading_sizes(kept, pages).collect()] == [[22.0]]
    assert {(r.size, r.level) for r in layout.levelled(kept, pages).collect()} == {(22.0, 1), (10.0, 0), (9.0, 0)}
    paras = [r.text for r in layout.paragraphs(kept).orderBy("para_no").collect()]
    assert paras[:3] == ["A large title", "Some text that is broken by a hyphen here.", "x = 1"]
    outline = spark.createDataFrame([(1, 1, 1, 90.0), (1, 2, 3, 90.0)], "book_id int, mark_no int, page int, y double")
    assert [r.ch_no for r in layout.in_chapters(kept, outline).orderBy("line_no").collect()] == [1] * 8 + [2] * 4
    boxes = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0), (1, 1, 12.0, 0.0, 20.0, 10.0), (1, 1, 90.0, 90.0, 95.0, 95.0)], "book_id int, page int, x0 double, y0 double, x1 double, y1 double")
    assert sorted(r.n for r in layout.merged_boxes(boxes).collect()) == [1, 2]


def test_streaming(spark, tmp_path):
    from folioflow.streaming import checks as stream

    (tmp_path / "in/b1").mkdir(parents=True)
    (tmp_path / "in/b1/0001.txt").write_text("@@ a\nx\n@@ a\ny\n")
    for _ in range(2):
        stream.watch(spark, f"file://{tmp_path}/in", lambda e: translations.by_file(e).where("doubled"), f"file://{tmp_path}/out", f"file://{tmp_path}/state").awaitTermination()
    assert [r.seg_id for r in spark.read.parquet(f"file://{tmp_path}/out").collect()] == ["a"]
