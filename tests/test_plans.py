import io
import struct
import zipfile
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from folioflow.functions import languages, text
from folioflow.plans import project
from folioflow.shipping import ship
from folioflow.sinks import packages
from folioflow.sources.translations import entries

from test_books import FR, MD


def test_settings():
    s = project.Settings("FR_fr", chunk_tokens="100")
    assert s.target_lang == "fr" and s.changed(notes="allowed").notes == "allowed"
    for bad in ({"notes": "x"}, {"formats": ["pdf"]}, {"chunk_tokens": 0}, {"colour": 1}):
        with pytest.raises(ValueError):
            s.changed(**bad)


def test_from_files_to_books(spark, tmp_path):
    ship(spark)
    (tmp_path / "in").mkdir()
    (tmp_path / "in/book.md").write_text(MD)
    (tmp_path / "tr").mkdir()
    (tmp_path / "tr/0001.txt").write_text(FR)
    plan = project.ingest(spark, f"file://{tmp_path}/in", project.Settings("fr", formats=["md", "epub"]))
    book = plan.books.first().book_id
    assert [r.language for r in project.source_languages(plan).collect()] == ["en"]
    said = project.said_in(spark, f"file://{tmp_path}/tr", book)
    none = spark.createDataFrame([], "book_id string, term string, rendering string")
    assert plan.check(said, none, none.select("book_id", "term")).count() == 0
    built = plan.build(said)
    assert built["md"].first().text.startswith("# Un livre") and bytes(built["epub"].first().content)[:2] == b"PK"
    part = said.where("key <> 'c002.b0000'")
    assert plan.build(part)["md"].count() == 0 and plan.build(part, force=True)["md"].count() == 1
    state = spark.createDataFrame([], "book_id string, n int, claimed_at string, errors int, checked_mtime double")
    assert "@@ c002.b0000 para" in plan.tasks(part, state).first().text
    fewer = plan.exclude(plan.chapters.where("ch_id = 'c002'").select("book_id", "ch_id"))
    assert fewer.segs.where(F.col("ch_id") == "c002").count() == 0 and fewer.build(part)["md"].count() == 1
    assert plan.terms().count() >= 0 and plan.suggestions().count() == 0
    assert [(r.book_id, r.missing) for r in plan.drafts(part).collect()] == [(book, 1)]
    error = spark.createDataFrame([(book, "E-EMPTY")], "book_id string, rule string")
    assert plan.build(said, findings=error)["md"].count() == 0 and plan.build(said, findings=error.where("rule = 'W-SHORT'"))["md"].count() == 1
    project.save(fewer, f"file://{tmp_path}/plan")
    again = project.load(spark, f"file://{tmp_path}/plan", notes="allowed")
    assert again.settings == plan.settings.changed(notes="allowed") and again.segs.exceptAll(fewer.segs).count() == 0
    assert "- c002: Two - 1 blocks [excluded]" in again.report().first().report
    project.save(plan, f"file://{tmp_path}/old")
    old = project.load(spark, f"file://{tmp_path}/old")
    (tmp_path / "in/book.md").write_text(MD.replace("# One\n", "# One\n\nA new first paragraph.\n"))
    new = project.ingest(spark, f"file://{tmp_path}/in", plan.settings)
    lacking = new.drafts(entries(old.carry(said, new).withColumn("file", F.lit("0001.txt"))))
    assert [r.missing for r in lacking.collect()] == [1]


def test_sampled_pages():
    assert text.sampled_pages(10, 4) == [1, 4, 7, 10] and text.sampled_pages(2, 9) == [1, 2] and text.sampled_pages(5, 1) == [1] and text.sampled_pages(0, 3) == []


def test_picture_sizes():
    assert packages.picture_size(b"\x89PNG\r\n\x1a\n" + bytes(8) + struct.pack(">II", 3, 5)) == (3, 5)
    assert packages.picture_size(b"GIF89a" + struct.pack("<HH", 7, 8)) == (7, 8) and packages.picture_size(b"") is None and packages.picture_size(b"<svg/>") is None
    jpeg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"JF" + b"\xff\xc0" + struct.pack(">HBHH", 11, 8, 20, 30)
    assert packages.picture_size(jpeg) == (30, 20) and packages.picture_size(b"\xff\xd8\xff\xe0\x00") is None


def test_pictures_in_documents():
    png = b"\x89PNG\r\n\x1a\n" + bytes(8) + struct.pack(">II", 400, 200)
    block = {"type": "figure", "alt": "A *picture*", "file": "assets/a.png"}
    book = {"title": "T", "title_src": "T", "author": "", "toc": "Contents", "chapters": [{"title": "", "blocks": [block, block | {"file": "gone.png"}]}], "assets": {"assets/a.png": png}}
    with zipfile.ZipFile(io.BytesIO(packages.docx(book, languages.describe("fr")))) as z:
        document = z.read("word/document.xml").decode()
        ElementTree.fromstring(document)
        assert z.read("word/media/image1.png") == png and 'Target="media/image1.png"' in z.read("word/_rels/document.xml.rels").decode()
        assert 'Extension="png"' in z.read("[Content_Types].xml").decode() and "[A *picture*]" in document and document.count("<pic:pic ") == 1
