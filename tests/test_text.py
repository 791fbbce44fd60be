from pyspark.sql import functions as F

from folioflow.functions import inline, languages
from folioflow.functions import text as T


def values(spark, texts, *columns):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [tuple(r)[1:] for r in rows.select("i", *(c.alias(f"c{k}") for k, c in enumerate(columns))).orderBy("i").collect()]


def test_scalars(spark):
    texts = ["", "Hello world, this is it.", "漢字かな", "`a b` https://x.org/y. [z](u:v)", "e.g. it is 3.5 long. Dr. No went! Yes?", "٣٫٥ and 1,000", None]
    got = values(spark, texts, T.estimate_tokens("t"), T.word_count("t"), T.needs_translation("t"), T.sentences("t"), T.numbers("t"))
    assert got[0] == (0, 0, False, 0, [])
    assert got[1] == (int(24 / 4) + 1, 5, True, 1, [])
    assert got[2][:2] == (int(4 / 1.2) + 1, 2)
    assert got[3][2] is True
    assert got[4][3:] == (3, ["3.5"])
    assert got[5][4] == ["3.5", "1,000"]


def test_verbatim_and_marks(spark):
    text = "Run `ls -l` at [here](https://a.b/c), mail me@x.org or see http://q.r. Keep Foo but not Foobar. ``"
    got = values(spark, [text], T.verbatim_tokens("t", ["Foo", "C#"]), T.escape_marks("t"), T.clean(F.lit(" a\t  b\n ")))[0]
    assert got[0] == ["`ls -l`", "https://a.b/c", "me@x.org", "http://q.r", "Foo"]
    assert got[1].startswith("Run \\`ls -l\\` at \\[here\\]")
    assert got[2] == "a b"


def test_language(spark):
    texts = ["the cat and the dog", "le chat et la souris", "der Hund und die Katze", "привет мир", "日本語です", "漢字", "123", None]
    assert [r[0] for r in values(spark, texts, T.detect_language("t"))][:7] == ["en", "fr", "de", "ru", "ja", "zh", "en"]
    assert languages.normal_code(" ZH_Hant ") == "zh-tw" and languages.normal_code("en-AU") == "en" and languages.normal_code("xx") == "xx"
    assert languages.describe("ar")["dir"] == "rtl" and languages.describe("ja")["unspaced"] and not languages.describe("xx")["known"]
    assert languages.language_table(spark).where("dir = 'rtl'").count() == 9


def test_lines_and_slugs(spark):
    got = values(spark, ["x"], T.joined_lines(F.array(F.lit("a beau-"), F.lit("tiful day"), F.lit("X-"), F.lit("Ray"))), T.slug(F.lit("A b/c!")), T.slug(F.lit("//")), T.without_ligatures(F.lit("ﬁne­")), T.markdown_inline(F.lit("__a__ _b_ <http://c.d> ![e](f)")))
    assert got == [("a beautiful day X- Ray", "A-b-c", "book", "fine", "**a** *b* [http://c.d](http://c.d) e")]
    assert T.page_numbers("1-3, 10") == [1, 2, 3, 10] and T.page_numbers(None) == []


def test_inline_runs():
    runs = inline.parse("**bold** and *it* `a*b` [link](https://x.y) \\*star")
    assert [(r.text, r.b, r.i, r.code, r.url) for r in runs if r.text.strip()] == [
        ("bold", True, False, False, None), (" and ", False, False, False, None), ("it", False, True, False, None),
        ("a*b", False, False, True, None), ("link", False, False, False, "https://x.y"), (" *star", False, False, False, None),
    ]
    assert inline.plain("a ** b") == "a  b" and inline.plain("2 * 3") == "2 * 3"
    # A pair of stars that nothing closes is read as two single ones, which open and close.
    assert inline.plain("**x") == "x" and inline.plain("*x") == "*x" and inline.plain("\\**x") == "*" + inline.plain("*x") and inline.plain("`x") == "`x" and inline.plain("[x](y") == "[x](y"
    assert inline.to_html("**a** `<`") == '<strong>a</strong> <code dir="ltr">&lt;</code>'
    assert [r.text for r in inline.parse("**[a *b*](c)**") if r.b] == ["a ", "b"]


def test_split_rtl():
    runs = inline.split_rtl("استخدم C# مع .NET أو DECIMAL(5,2) هنا")
    assert [t for t, rtl in runs if not rtl] == ["C#", ".NET", "DECIMAL(5,2)"]
    assert "".join(t for t, _ in runs) == "استخدم C# مع .NET أو DECIMAL(5,2) هنا" and inline.split_rtl("") == []


def test_columns_of_runs(spark):
    row = spark.createDataFrame([("**a** b",)], "t string").select(inline.runs("t").alias("r"), inline.html_of("t").alias("h"), inline.plain_of("t").alias("p"), inline.rtl_runs("t").alias("d")).first()
    assert [x.text for x in row.r] == ["a", " b"] and row.h == "<strong>a</strong> b" and row.p == "a b" and row.d[0].text


def test_rtl_runs_of_whole_documents(spark, tmp_path):
    from folioflow import queries
    from folioflow.shipping import ship

    text = "Latin words come first in this long line, and שלום stands behind them."
    spark.createDataFrame([(1, text, "en", "s", len(text))], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.rtl_runs(ship(spark), str(tmp_path)).collect()
    assert "שלום" in "".join(str(v) for r in sorted(rows, key=lambda r: r.k) for v in r)
