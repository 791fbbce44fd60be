"""Whole tasks over a corpus of books: read and plan, hand out, check, follow, build."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import languages
from ..functions import text as T
from ..operators import checks, chunks, lifecycle, segments, terms, translations
from ..sinks import html, markdown, model, packages
from ..sources import reader
from ..sources.translations import entries, read_translations

FORMATS = ("html", "epub", "docx", "md")
#: How much of a book tells its language: blocks of a chapter, and characters.
SAMPLE_BLOCKS, SAMPLE_CHARS = 40, 20_000
#: The tables of a plan that are read, not derived.
TABLES = ("books", "chapters", "blocks", "assets", "excluded")


@dataclass
class Settings:
    """What a project of books is translated with."""

    target_lang: str
    source_lang: str = ""
    chunk_tokens: int = chunks.BUDGET
    notes: str = "forbidden"
    numerals: str = "keep"
    formats: list[str] = field(default_factory=lambda: ["html"])
    style: str = ""
    title: str = ""
    author: str = ""
    translator: str = ""
    page_size: str = "A4"

    def __post_init__(self) -> None:
        self.target_lang = languages.normal_code(self.target_lang)
        self.chunk_tokens = int(self.chunk_tokens)
        if self.chunk_tokens < 1:
            raise ValueError("chunk_tokens must be positive")
        for name, allowed in (("notes", ("allowed", "forbidden")), ("numerals", ("keep", "native"))):
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} must be one of {', '.join(allowed)}")
        if unknown := [f for f in self.formats if f not in FORMATS]:
            raise ValueError(f"unknown format: {', '.join(unknown)}")

    def changed(self, **values: object) -> Settings:
        if unknown := values.keys() - {f.name for f in fields(self)}:
            raise ValueError(f"unknown setting: {', '.join(sorted(unknown))}")
        return Settings(**{f.name: values.get(f.name, getattr(self, f.name)) for f in fields(self)})


@dataclass
class Plan:
    """The tables of books that have been read: what all other steps take."""

    settings: Settings
    books: DataFrame
    chapters: DataFrame
    blocks: DataFrame
    assets: DataFrame | None
    segs: DataFrame
    members: DataFrame
    excluded: DataFrame | None = None

    @property
    def chunks(self) -> DataFrame:
        return chunks.chunks(self.members)

    def suggestions(self) -> DataFrame:
        return segments.suggest_excludes(self.chapters, self.blocks)

    def exclude(self, excluded: DataFrame) -> Plan:
        """The plan without chapters (book_id, ch_id)."""
        return plan(self.settings, {"books": self.books, "chapters": self.chapters, "blocks": self.blocks, "assets": self.assets}, excluded)

    def terms(self, top: int = 50, known: DataFrame | None = None) -> DataFrame:
        return terms.top_terms(terms.term_counts(self.segs), top, known)

    def tasks(self, said: DataFrame, state: DataFrame, count: int = 1, reclaim: bool = False, glossary: DataFrame | None = None, keep: DataFrame | None = None) -> DataFrame:
        """The texts of the next tasks of each book, with glossary (book_id, term, rendering) and keep (book_id, term) where they bear on them."""
        chosen = lifecycle.next_chunks(self.members, self.chunks, said, state, count, reclaim, self.excluded)
        none = self.books.select("book_id", F.lit("").alias("term"), F.lit("").alias("rendering")).limit(0)
        frame = lifecycle.task_frame(self.settings.source_lang or "en", self.settings.target_lang, self.settings.notes == "allowed", self.settings.numerals == "native", self.settings.style)
        tasks = lifecycle.full_tasks(self.members, self.segs, said, self.books, none if glossary is None else glossary, none.select("book_id", "term") if keep is None else keep, frame, self.blocks)
        return tasks.join(chosen, ["book_id", "n"], "left_semi")

    def check(self, said: DataFrame, glossary: DataFrame, keep: DataFrame) -> DataFrame:
        return checks.check(self.members, self.segs, said, glossary, keep, self.settings.target_lang, self.settings.notes == "allowed", self.excluded)

    def report(self) -> DataFrame:
        """book_id, report: what was read and planned, which chapters may be left out, and the readers' notes."""
        return lifecycle.report(self.chapters, self.blocks, self.segs, self.chunks, chunks.automatic(self.segs), self.suggestions(), self.excluded, self.books.select("book_id", "notes"))

    def carry(self, said: DataFrame, new: Plan) -> DataFrame:
        """book_id, n, text: the translations of these books as files for the chunks of a plan of the same books, read again.

        This plan must be a saved one: files are read when they are needed, and would by now be the new ones.
        """
        return lifecycle.carried_over(translations.merged(said), lifecycle.remap(self.segs, new.segs), new.members)

    def drafts(self, said: DataFrame) -> DataFrame:
        """Books that lack segments, which a forced build gives in the source's words."""
        return model.missing(self.segs, translations.merged(said))

    def build(self, said: DataFrame, force: bool = False, findings: DataFrame | None = None) -> dict[str, DataFrame]:
        """A table (book_id, text or content) for each format, of books without missing segments, or of all if forced.

        With findings (check()), books that have errors are not built either.
        """
        merged = translations.merged(said)
        ready = self.books if force else self.books.join(self.drafts(said), "book_id", "left_anti")
        if findings is not None and not force:
            ready = ready.join(findings.where("rule like 'E-%'").select("book_id").distinct(), "book_id", "left_anti")
        only = lambda df: df.join(ready.select("book_id"), "book_id", "left_semi")
        books, chapters = model.translated_books(ready, merged), only(model.translated_chapters(self.chapters, merged))
        blocks = only(model.translated_blocks(self.blocks, merged, translations.notes(said)))
        if self.excluded is not None:
            chapters, blocks = (x.join(self.excluded, ["book_id", "ch_id"], "left_anti") for x in (chapters, blocks))
        if self.settings.author:
            books = books.withColumn("author", F.lit(self.settings.author))
        target, out = self.settings.target_lang, {}
        for name in self.settings.formats:
            if name == "md":
                out[name] = markdown.render(books, chapters, blocks)
            elif name == "html":
                out[name] = html.render(books, chapters, blocks, target, self.settings.source_lang or "en")
            else:
                out[name] = packages.render(packages.gathered(books, chapters, blocks, self.assets), packages.epub if name == "epub" else packages.docx, target)
        return out


def plan(settings: Settings, tables: dict[str, DataFrame], excluded: DataFrame | None = None) -> Plan:
    segs = segments.segments(tables["books"], tables["chapters"], tables["blocks"], excluded)
    return Plan(settings, tables["books"], tables["chapters"], tables["blocks"], tables.get("assets"), segs, chunks.chunk_segments(segs, settings.chunk_tokens), excluded)


def ingest(spark: SparkSession, folder: str, settings: Settings) -> Plan:
    """Reads all files below a folder and plans their chunks."""
    return plan(settings, reader.read_files(spark, folder))


def save(plan_: Plan, folder: str) -> None:
    """Writes a plan's settings and tables below a folder; a table that is there is replaced as a whole."""
    spark = plan_.books.sparkSession
    spark.createDataFrame([(json.dumps(asdict(plan_.settings)),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/settings")
    for name in TABLES:
        if getattr(plan_, name) is not None:
            getattr(plan_, name).write.mode("overwrite").parquet(f"{folder}/{name}")


def load(spark: SparkSession, folder: str, **changes: object) -> Plan:
    """The plan that save() wrote; settings that are not named there have their defaults, and changes replace others."""
    told = json.loads(spark.read.text(f"{folder}/settings").first().value)
    known = {f.name for f in fields(Settings)}
    settings = Settings(**{k: v for k, v in told.items() if k in known}).changed(**changes)
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    there = lambda name: files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}"))
    tables = {name: spark.read.parquet(f"{folder}/{name}") for name in TABLES if there(name)}
    return plan(settings, tables, tables.get("excluded"))


def source_languages(plan_: Plan) -> DataFrame:
    """book_id, language: as the book declares it, else as its first blocks tell."""
    sample = plan_.blocks.where((F.col("pos") < SAMPLE_BLOCKS) & F.col("text").isNotNull() & (F.col("type") != "code")).groupBy("book_id")
    ordered = F.array_sort(F.collect_list(F.struct("ch_no", "pos", "text")))
    told = sample.agg(F.substring(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n"), 1, SAMPLE_CHARS).alias("sample"))
    rows = plan_.books.join(told, "book_id", "left")
    declared = F.when(F.col("language") != "", F.lower(F.regexp_extract("language", "^[A-Za-z]+", 0)))
    return rows.select("book_id", F.coalesce(declared, T.detect_language(F.coalesce("sample", F.lit("")))).alias("language"))


def said_in(spark: SparkSession, folder: str, book_id: str) -> DataFrame:
    """The entries of a book's folder of translation files."""
    return entries(read_translations(spark, folder).drop("file_mtime").withColumn("book_id", F.lit(book_id)))
