"""What keeps the work per book the same as tables grow: one pass over texts, no group of its own in Python for each book."""

import re
import sys

import pytest
from pyspark.sql import functions as F

from folioflow import queries
from folioflow.functions import inline
from folioflow.operators import chunks, lifecycle, segments, terms, translations
from folioflow.sources import txt

TEXTS = [
    (1, "one\nCHAPTER 1\n\n  two  words \nTHREE FOUR\n[x] *y* `z`\nCHAPTER 2\nfive"), (2, "CHAPTER 1\nsix\nseven a@b.org"), (3, None), (4, ""), (5, "﻿one\r\ntwo\r\n\r\nPART ONE\n\nthree\nfour"),
    (6, "\n".join(f"line {i} of this long text" for i in range(400))), (7, "漢字かな一二三\nÄÖÜ ÉÈ"), (8, "CHAPTER 1"),
]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def docs_of(spark):
    return spark.createDataFrame(TEXTS, "doc_id int, text string")


def test_text_is_read_in_one_pass(spark):
    docs = docs_of(spark)
    title = F.concat(F.lit("document "), "doc_id")
    books = txt.book_segments(docs, title, segments.CONTENTS)
    expected = segments.segments(docs.select(F.col("doc_id").alias("book_id"), title.alias("title")), *txt.read_txt(docs))
    own = books.select("book_id", F.inline("segs"))
    assert sorted(own.collect()) == sorted(expected.select(*own.columns).collect())
    planned = chunks.planned(books, 50)
    assert "Exchange" not in plan_of(planned)
    members = chunks.chunk_segments(expected, 50)
    assert sorted(planned.where("n is not null").select(*members.columns).collect()) == sorted(members.collect())
    chapters, blocks = txt.read_txt(docs)
    assert "Exchange" not in plan_of(chapters) and "Exchange" not in plan_of(blocks)


def test_remap_takes_books_in_batches(spark):
    old = [(b, i, f"s{i}", "para", t) for b in (1, 2) for i, t in enumerate(["a", "b", "a", "c", None, "x"], 1)]
    new = [(b, i, f"n{i}", "para", t) for b in (1, 2) for i, t in enumerate(["c", "a", None, "a", "b"], 1)]
    schema = "book_id int, seg_no int, seg_id string, kind string, text string"
    moved = lifecycle.remap(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema))
    assert "FlatMapCoGroups" not in plan_of(moved) and "MapInArrow" in plan_of(moved)
    rows = sorted(moved.collect())
    assert [tuple(r)[1:] for r in rows if r.book_id == 1] == [tuple(r)[1:] for r in rows if r.book_id == 2]
    assert {(r.old_id, r.new_id) for r in rows if r.book_id == 1} == {("s1", "n4"), ("s2", "n5"), ("s3", "n2"), ("s4", "n1")}


def test_glossary_and_keep_lists_of_all_books(spark, monkeypatch):
    segs = spark.createDataFrame([(1, "a", "The end of the line/x here."), (2, "b", "the END"), (2, "c", None)], "book_id int, seg_id string, text string")
    shared = spark.createDataFrame([("the", "le"), ("end (noun)", "fin"), ("of the", "du"), ("c++", "c")], "term string, rendering string")
    own = segs.select("book_id").distinct().crossJoin(shared)
    found = terms.glossary_hits(segs, shared, carry=("text",))
    assert sorted(found.drop("text").collect()) == sorted(terms.glossary_hits(segs, own).collect())
    assert sorted(found.drop("text").collect()) == sorted(terms.glossary_hits_plain(segs, own).collect())
    assert "Exchange hashpartitioning" not in plan_of(terms.glossary_hits(segs, shared.where("term <> 'c++'")))
    monkeypatch.setattr(terms, "FEW_SPELLINGS", 0)
    assert sorted(found.drop("text").collect()) == sorted(terms.glossary_hits(segs, shared).collect()) == sorted(terms.glossary_hits(segs, own).collect())
    keep = spark.createDataFrame([("LINE",), ("nd",)], "term string")
    assert {tuple(r) for r in terms.keep_hits(segs, keep).collect()} == {(1, "a", "LINE"), (1, "a", "nd"), (2, "b", "nd")}


def test_by_file_moves_texts_once(spark):
    schema = "book_id int, file string, n int, ord int, entry_type string, key string, body string, is_keep boolean"
    rows = [(1, "f", 1, 0, "seg", "a", "x", False), (1, "f", 1, 1, "seg", "a", "y", False), (1, "f", 1, 2, "seg", "b", None, True), (1, "f", 1, 3, "seg", "b", "z", False), (1, "f", 1, 4, "seg", "c", "u", False), (1, "f", 1, 5, "seg", "c", None, True), (1, "f", 1, 6, "seg", "d", None, True)]
    said = translations.by_file(spark.createDataFrame(rows, schema))
    assert "Window" not in plan_of(said)
    assert {r.seg_id: (r.text, r.is_keep, r.doubled) for r in said.collect()} == {"a": ("y", False, True), "b": (None, True, True), "c": (None, True, False), "d": (None, True, False)}


@pytest.mark.parametrize("name", ["markdown_books", "html_books", "extraction_report"])
def test_texts_of_books_are_not_read_again_by_each_step(spark, tmp_path, name):
    docs_of(spark).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").write.parquet(f"{tmp_path}/documents.parquet")
    found = plan_of(queries.QUERIES[name](spark, str(tmp_path)))
    assert "ReadSchema" in found and not re.search(r"ReadSchema: struct<doc_id:bigint,text", found)


def test_lines_written_first_give_the_same_books(spark, tmp_path):
    docs = docs_of(spark)
    txt.lines(docs).write.parquet(f"{tmp_path}/lines")
    for own, written in zip(txt.read_txt(docs), txt.tables(spark.read.parquet(f"{tmp_path}/lines")), strict=True):
        assert sorted(map(str, own.collect())) == sorted(map(str, written.collect()))
    assert [tuple(r)[1:] for r in txt.read_txt(docs)[0].where("book_id = 5").orderBy("ch_no").collect()] == [(1, "c001", ""), (2, "c002", "PART ONE")]


def calls_of(work):
    """How many functions a piece of work calls."""
    counted = [0]
    sys.setprofile(lambda frame, event, arg: counted.__setitem__(0, counted[0] + (event in ("call", "c_call"))))
    try:
        work()
    finally:
        sys.setprofile(None)
    return counted[0]


def test_markup_is_not_read_by_the_character():
    text = "*it* and " + "plain words " * 1000 + "`x` [l](u)"
    assert calls_of(lambda: inline.parse(text)) < 1000
    assert "".join(r.text for r in inline.parse(text)) == "it and " + "plain words " * 1000 + "x l"
    assert inline.to_html("plain words") == "plain words" and inline.parse(None) == []


def test_terms_of_whole_books_are_counted_in_their_row(spark):
    texts = ["CHAPTER Spark engine\nspark engine runs\nSpark engine, spark Engine\nSPARK ENGINE\nwhich would could\nunique thing", "`spark` x@y.org\nspark", None, "Ärger Ärger ärger 漢字かな"]
    docs = spark.createDataFrame([*enumerate(texts, 20), *TEXTS], "doc_id int, text string")
    books = txt.book_segments(docs, F.lit("document of engine parts"), segments.CONTENTS)
    counted, expected = terms.book_term_counts(books), terms.term_counts(books.select("book_id", F.inline("segs")))
    assert "Exchange" not in plan_of(counted)
    rows = sorted(map(tuple, counted.collect()))
    assert rows == sorted(map(tuple, expected.select(*counted.columns).collect()))
    assert (20, "engine", 6, 2, 12) in rows and counted.dtypes == expected.select(*counted.columns).dtypes


def test_report_counts_blocks_once(spark):
    chapters = spark.createDataFrame([(1, 1, "c001", ""), (1, 2, "c002", "Two"), (1, 3, "c003", "Three"), (2, 1, "c001", "One")], "book_id int, ch_no int, ch_id string, title string")
    blocks = spark.createDataFrame([(1, 1, "c001", 0, "para"), (1, 1, "c001", 1, "item"), (1, 2, "c002", 0, "heading"), (1, 2, "c002", 1, "item"), (1, 2, "c002", 2, "para")], "book_id int, ch_no int, ch_id string, pos int, type string")
    segs = spark.createDataFrame([(b, 1, "s", "para", "two words", "c001") for b in (1, 2, 3)], "book_id int, seg_no int, seg_id string, kind string, text string, ch_id string")
    chunk, none = spark.createDataFrame([(1, 1)], "book_id int, n int"), segs.limit(0)
    report = lifecycle.report(chapters, blocks, segs, chunk, none)
    assert sum("pos#" in line and "Scan" in line for line in plan_of(report).splitlines()) == 1
    rows = {r.book_id: r.report for r in report.collect()}
    assert rows[1].startswith("- chapters: 3 | blocks: para 2, item 2, heading 1\n") and rows[1].endswith("## Chapters\n- c001: (untitled) - 2 blocks\n- c002: Two - 3 blocks\n- c003: Three - 0 blocks")
    assert rows[2].startswith("- chapters: 1 | blocks: none\n") and rows[2].endswith("- c001: One - 0 blocks") and rows[3].startswith("- chapters: 0 | blocks: none\n")


def test_directions_are_not_told_by_the_character():
    text = "مرحبا " + "plain words (v2) C# " * 500 + "عالم"
    inline.directions("a")  # what is looked up is made once for a worker
    assert calls_of(lambda: inline.split_rtl(text)) < len(text)
    assert inline.split_rtl(text) == [("مرحبا ", True), (text[6:-5], False), (" عالم", True)]
    assert inline.directions("C# (x)") == [False] * 6 and inline.split_rtl(None) == []
