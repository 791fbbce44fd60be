"""Checks of translations against their sources: findings as rows.

What rules need is computed once for a pair of texts; the rules are predicates over it and come out of one projection.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import languages as L
from ..functions import text as T
from . import terms as terms_
from . import translations as tr

#: Shortest source for length rules; fewest pairs for a baseline; shares of the baseline.
LONG, SAMPLES = 80, 20
DROPPED, SHORT, TOO_LONG = 0.6, 0.45, 2.2
FINDING = "struct<seg_id: string, severity: string, rule: string, message: string, detail: array<string>>"


def ratio_baseline(pairs: DataFrame) -> DataFrame:
    """book_id, baseline: the median of target over source lengths; 0 with fewer than SAMPLES pairs of long sources."""
    used = pairs.where(f"length(target) > 0 and length(source) >= {LONG}")
    ratio = F.length("target") / F.length("source")
    return used.groupBy("book_id").agg(F.when(F.count(F.lit(1)) >= SAMPLES, F.median(ratio)).otherwise(0.0).alias("baseline"))


def missing_numbers(source: Column, target: Column) -> Column:
    """Numbers that the source has more often than the target, sorted, each once."""
    n = lambda xs, v: F.size(F.filter(xs, lambda x: x == v))
    return F.array_sort(F.filter(F.array_distinct(source), lambda v: n(source, v) > n(target, v)))


def features(pairs: DataFrame) -> DataFrame:
    """pairs (source, target) with what the rules read."""
    return pairs.withColumns(
        {
            "s_words": T.source_words("source"),
            "same": T.strip("source") == T.strip("target"),
            "lost": F.filter(T.verbatim_tokens("source"), lambda t: ~F.contains(F.col("target"), t)),
            "no_numbers": missing_numbers(T.numbers("source"), T.numbers("target")),
            "s_sentences": T.sentences("source"),
            "t_sentences": T.sentences("target"),
            "ratio": F.try_divide(F.length("target"), F.length("source")),
            "measured": (F.length("source") >= LONG) & (F.col("baseline") > 0),
        }
    )


def pair_findings(pairs: DataFrame, target_scripts: list[str] | None = None) -> DataFrame:
    """Findings of pairs (book_id, n, seg_id, source, target, baseline), one row each; pairs that keep their source have none."""
    rows = features(pairs)
    script = L.class_body(*(s for s in target_scripts or [] if s != "latin"))
    filled = T.strip("target") != ""

    def say(when: Column, severity: str, rule: str, message: str, detail: Column | None = None) -> Column:
        none = F.array().cast("array<string>")
        given = F.struct(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), F.lit(message).alias("message"), (none if detail is None else detail).alias("detail"))
        return F.when(F.coalesce(when, F.lit(False)), given)

    c = F.col
    dropped = (c("s_sentences") >= 3) & (c("t_sentences") < 0.5 * c("s_sentences"))
    short = c("measured") & (c("ratio") < DROPPED * c("baseline"))
    counts = F.array(c("s_sentences").cast("string"), c("t_sentences").cast("string"))
    rules = [
        say(~filled, "error", "E-EMPTY", "the translation is empty"),
        say(filled & (c("target").rlike(terms_header()) | F.contains("target", F.lit("\n@@"))), "error", "E-HEADER", "the translation holds an entry's header"),
        say(filled & (F.size("lost") > 0), "error", "E-VERBATIM", "text that must stay was lost or changed", c("lost")),
        say(filled & c("same") & (c("s_words") >= 4), "error", "E-IDENTICAL", "equal to the source, not translated"),
        say(filled & c("same") & c("s_words").between(2, 3), "warning", "W-IDENTICAL", "equal to the source"),
        say(filled & (c("s_words") >= 2) & ~T.without_code("target").rlike(f"[{script}]"), "error", "E-SCRIPT", "no text in the target's script") if script else F.lit(None).cast("struct<severity: string, rule: string, message: string, detail: array<string>>"),
        say(filled & (T.literal_count("source", "**") != T.literal_count("target", "**")), "warning", "W-BOLD", "marks of bold text differ in number"),
        say(filled & (T.literal_count("source", "](") != T.literal_count("target", "](")), "warning", "W-LINK", "links differ in number"),
        say(filled & (F.size("no_numbers") > 0), "warning", "W-NUMBERS", "numbers are missing", c("no_numbers")),
        say(filled & dropped & short, "error", "E-SENT-DROP", "sentences were dropped", counts),
        say(filled & dropped & ~short, "warning", "W-SENT-DROP", "sentences may be missing", counts),
        say(filled & (c("t_sentences") >= 4) & (c("t_sentences") > 2 * F.greatest(c("s_sentences"), F.lit(1))), "warning", "W-SENT-ADD", "sentences may have been added", counts),
        say(filled & c("measured") & (c("ratio") < SHORT * c("baseline")), "warning", "W-SHORT", "much shorter than usual"),
        say(filled & c("measured") & (c("ratio") > TOO_LONG * c("baseline")), "warning", "W-LONG", "much longer than usual"),
    ]
    found = F.filter(F.array(*rules), lambda x: x.isNotNull())
    return rows.select("book_id", "n", "seg_id", F.inline(found)).select("book_id", "n", "seg_id", "severity", "rule", "message", "detail")


def terms_header() -> str:
    from ..sources.translations import HEADER

    return HEADER


def coverage(members: DataFrame, entries: DataFrame, excluded: DataFrame | None = None, chunks_wanted: DataFrame | None = None) -> DataFrame:
    """Findings on what files hold: chunks, files and segments that are missing, foreign or doubled.

    One table of what is planned and what is given, by segment, and of chunks and files themselves (without a segment).
    """
    flag = lambda frame, *on: frame.select("book_id", "n", "seg_id", *(F.lit(f in on).alias(f) for f in ("planned", "given", "awaited")), *(F.col(c) if c in frame.columns else F.lit(False).alias(c) for c in ("wanted", "doubled")))
    whole = lambda frame: frame.select("book_id", "n", F.lit(None).cast("string").alias("seg_id")).distinct()
    asked = members.select("book_id", "n", "seg_id", "ch_id").withColumn("wanted", F.lit(True))
    if excluded is not None:
        gone = excluded.select("book_id", "ch_id", F.lit(False).alias("_in")).distinct()
        asked = asked.join(gone, ["book_id", "ch_id"], "left").withColumn("wanted", F.coalesce("_in", F.lit(True)))
    parts = [flag(asked, "planned"), flag(tr.by_file(entries).select("book_id", "n", "seg_id", "doubled"), "given"), flag(whole(entries), "given")]
    if chunks_wanted is not None:
        parts.append(flag(whole(chunks_wanted), "awaited"))
    every = reduce(DataFrame.unionByName, parts).groupBy("book_id", "n", "seg_id").agg(*(F.max(f).alias(f) for f in ("planned", "given", "awaited", "wanted", "doubled")))
    chunk, seg = Window.partitionBy("book_id", "n"), Window.partitionBy("book_id", "seg_id")
    every = every.withColumn("owner", F.max(F.when(F.col("planned"), F.col("n"))).over(seg))
    every = every.withColumns({"is_chunk": F.max("planned").over(chunk), "has_file": F.max("given").over(chunk)})
    none = F.array().cast("array<string>")
    is_seg = F.col("seg_id").isNotNull()

    def say(when: Column, rule: str, message: str, detail: Column = none) -> Column:
        return F.when(when, F.struct(F.lit("error").alias("severity"), F.lit(rule).alias("rule"), F.lit(message).alias("message"), detail.alias("detail")))

    rules = [
        say(~is_seg & F.col("given") & ~F.col("is_chunk"), "E-CHUNK", "no such chunk"),
        say(~is_seg & F.col("awaited") & ~F.col("has_file"), "E-FILE", "the translation file is missing"),
        say(is_seg & F.col("doubled"), "E-DUP", "the segment appears more than once"),
        say(is_seg & F.col("wanted") & F.col("has_file") & ~F.col("given"), "E-MISSING", "the segment is missing"),
        say(is_seg & F.col("given") & F.col("is_chunk") & ~F.col("planned"), "E-FOREIGN", "the segment is not of this chunk", F.when(F.col("owner").isNotNull(), F.array(F.col("owner").cast("string"))).otherwise(none)),
    ]
    found = F.filter(F.array(*rules), lambda x: x.isNotNull())
    return every.select("book_id", "n", "seg_id", F.inline(found)).select("book_id", "n", "seg_id", "severity", "rule", "message", "detail")


def check(
    members: DataFrame,
    segs: DataFrame,
    entries: DataFrame,
    glossary: DataFrame,
    keep: DataFrame,
    target_lang: str = "fr",
    notes_allowed: bool = False,
    excluded: DataFrame | None = None,
    chunks_wanted: DataFrame | None = None,
) -> DataFrame:
    """All findings (book_id, n, seg_id, severity, rule, message, detail) of the translation files of entries.

    members are chunk_segments(), segs segments(); glossary (book_id, term, rendering), keep (book_id, term). chunks_wanted
    (book_id, n) are chunks that must have a file. Segments of excluded chapters (book_id, ch_id) are neither asked for nor foreign.
    """
    none = F.array().cast("array<string>")

    def rows(frame: DataFrame, rule: str, message: str, seg=F.lit(None).cast("string"), detail: Column = none, severity: str = "error") -> DataFrame:
        return frame.select("book_id", "n", seg.alias("seg_id"), F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), F.lit(message).alias("message"), detail.alias("detail"))

    seg = F.col("seg_id")
    files = entries.select("book_id", "n").distinct()
    wanted = members.select("book_id", "n", "seg_id", "ch_id")
    if excluded is not None:
        wanted = wanted.join(excluded.select("book_id", "ch_id"), ["book_id", "ch_id"], "left_anti")
    got = tr.by_file(entries)
    here = wanted.join(files, ["book_id", "n"], "left_semi")
    out = [coverage(members, entries, excluded, chunks_wanted)]
    noted = entries.where("entry_type = 'note'").select("book_id", "n", F.col("key").alias("seg_id"))
    if not notes_allowed:
        out.append(rows(noted.groupBy("book_id", "n").agg(F.count(F.lit(1)).alias("notes")), "E-NOTES-OFF", "notes are not allowed", detail=F.array(F.col("notes").cast("string"))))
    out.append(rows(noted.distinct().join(wanted, ["book_id", "n", "seg_id"], "left_anti"), "E-NOTE-TARGET", "the note's segment is not of this chunk", seg))
    sources = segs.select("book_id", "seg_id", F.col("text").alias("source"))
    everything = tr.merged(entries).join(sources, ["book_id", "seg_id"]).select("book_id", "seg_id", "source", F.col("text").alias("target"))
    baseline = ratio_baseline(everything)
    pairs = here.join(got.where("not is_keep"), ["book_id", "n", "seg_id"]).join(sources, ["book_id", "seg_id"])
    pairs = pairs.join(baseline, "book_id", "left").select("book_id", "n", "seg_id", "source", F.coalesce("text", F.lit("")).alias("target"), F.coalesce("baseline", F.lit(0.0)).alias("baseline"))
    out.append(pair_findings(pairs, L.describe(target_lang)["scripts"]))
    texts = pairs.where(T.strip("target") != "")
    kept = texts.join(keep.select("book_id", "term"), "book_id").where(F.regexp_like(T.without_code("source"), terms_._bounded("term")) & ~F.contains("target", "term"))
    out.append(rows(kept, "E-VERBATIM", "text that must stay was lost or changed", seg, F.array("term")))
    hits = terms_.glossary_hits(texts.select("book_id", "seg_id", F.col("source").alias("text")), glossary).join(texts, ["book_id", "seg_id"])
    missed = hits.where(~F.contains(F.lower("target"), F.lower("rendering")))
    out.append(rows(missed, "W-GLOSSARY", "a glossary term is not rendered as agreed", seg, F.array("term", "rendering"), "warning"))
    clash = terms_.conflicts(tr.proposals(entries), glossary)
    out.append(rows(clash, "W-CONFLICT", "a proposal differs from the glossary", detail=F.array("term", "rendering", "accepted"), severity="warning"))
    found = out[0]
    for other in out[1:]:
        found = found.unionByName(other)
    return found


def by_chunk(findings: DataFrame) -> DataFrame:
    """book_id, n, errors, warnings."""
    return findings.groupBy("book_id", "n").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
