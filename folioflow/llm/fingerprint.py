"""Document fingerprints by I-Match over many randomised lexicons.

Terms whose inverse document frequency lies within a band make up the lexicon. A fingerprint hashes the sorted distinct terms of
a text that are in the lexicon, and those in random subsets of it; subsets come in sizes from all to few terms, so that two
texts share some hashes if they share part of their terms. The band's upper end bounds the lexicon: a term in it stands in
at least a fixed share of all documents, and so there are at most (mean distinct terms of a document) / share of them.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import BATCH_ROWS, in_arrow, saved

#: The band: terms in at most and at least this share of documents (idf 1.6 to 7.6).
MOST_SHARE, LEAST_SHARE = 0.2, 0.0005
#: The shares of the lexicon that subsets keep, by powers of two, and how many subsets have each.
SUBSETS = tuple(2.0**-k for k, n in enumerate((1, 1, 2, 3, 3, 4, 4, 4, 4, 4, 3, 2, 1)) for _ in range(n))
#: Characters of a fingerprint for a subset.
WIDTH = 6
EMPTY = "0" * WIDTH
TOLD_BY = 12
#: Terms whose counts a task holds before it hands them on; rows of a block of neighbours.
HELD_TERMS, BLOCK_ROWS = 400_000, 2000
MOST_RANGES = 100_000
REMEMBERED_TERMS = 300_000
#: A text with fewer terms in the band is told by all its terms.
FEW_TERMS = 8
#: Bits of the filter that finds texts which may have copies.
FILTER_BITS = 1 << 26
#: ASCII marks become spaces; bytes of other characters stay.
SPACES = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms(text: str | None) -> set[bytes]:
    """Distinct terms: lower-cased runs without ASCII marks and white space, in UTF-8."""
    return set((text or "").lower().encode("utf-8", "replace").translate(SPACES).split())


def text_hashes(docs: DataFrame) -> DataFrame:
    """h, n: the hash of each distinct text, and its copies."""
    return saved(docs.groupBy(F.xxhash64("text").alias("h")).agg(F.count(F.lit(1)).alias("n")), "texts")


def distinct_texts(docs: DataFrame, hashes: DataFrame) -> DataFrame:
    """Each text of docs once. Only texts that may have copies are shuffled: those that a filter of bounded size lets through."""
    bit = F.pmod("h", F.lit(FILTER_BITS))
    words = hashes.where("n > 1").select(bit.alias("bit")).groupBy(F.expr("bit div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, int(bit % 64)))").alias("mask"))
    rows = docs.select("text", F.xxhash64("text").alias("h")).withColumn("bit", bit).withColumn("word", F.expr("bit div 64"))
    rows = rows.join(F.broadcast(words), "word", "left").withColumn("maybe", F.expr("coalesce((mask & shiftleft(1L, int(bit % 64))) <> 0, false)"))
    once = rows.where("maybe").groupBy("h").agg(F.first("text").alias("text"))
    return rows.where("not maybe").select("text").unionByName(once.select("text"))


def document_frequencies(docs: DataFrame, hashes: DataFrame | None = None) -> DataFrame:
    """term, n: how many distinct texts hold each term. Tasks count beforehand, within a bound of memory."""
    docs = distinct_texts(docs, text_hashes(docs) if hashes is None else hashes)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()).cast(pa.string()), pa.array(held.values(), pa.int64())], ["term", "n"])
            held.clear()
            return batch

        for batch in batches:
            for text in batch.column("text"):
                held.update(terms(text.as_py()))
                if len(held) > HELD_TERMS:
                    yield out()
        if held:
            yield out()

    return in_arrow(docs.select("text"), each, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n"))


def lexicon(docs: DataFrame, most: float = MOST_SHARE, least: float = LEAST_SHARE) -> np.ndarray:
    """Sorted hashes of the terms within the band, by shares of distinct texts."""
    hashes = text_hashes(docs)
    rows = hashes.count()
    low, high = max(2, math.ceil(least * rows)), max(2, math.floor(most * rows))
    found = document_frequencies(docs, hashes).where((F.col("n") >= low) & (F.col("n") <= high))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = np.array([xxhash.xxh64_intdigest(t) for t in batch.column("term").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["h"])

    got = in_arrow(found.select("term"), each, "h bigint").toArrow().column("h").to_numpy()
    return np.unique(got.astype(np.int64).view(np.uint64))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


SALTS = np.array([(i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF for i in range(len(SUBSETS))], np.uint64)
BELOW = np.array([min(int(p * 2.0**64), 2**64 - 1) for p in SUBSETS], np.uint64)


def memberships(h: np.ndarray) -> np.ndarray:
    """For each term hash, which subsets keep it (terms x subsets)."""
    return mixed(h[:, None] + SALTS[None]) <= BELOW


class Terms(dict):
    """Terms to their places in the lexicon; -1 for those that it does not have."""

    def __init__(self, known: np.ndarray) -> None:
        super().__init__()
        self.known, self.kept_by = known, memberships(known)

    def __missing__(self, term: bytes) -> int:
        h = np.uint64(xxhash.xxh64_intdigest(term))
        at = int(np.searchsorted(self.known, h))
        found = at if at < len(self.known) and self.known[at] == h else -1
        if len(self) < REMEMBERED_TERMS:
            self[term] = found
        return found

    def mark(self, found: set[bytes]) -> Mark:
        """The fingerprint of a text by its terms in the band, or by all its terms if it has few of those."""
        at = np.fromiter(map(self.__getitem__, found), np.int64, len(found))
        at = np.sort(at[at >= 0])  # the lexicon is sorted by hash, and so are the terms
        if len(at) < FEW_TERMS:
            return Mark(whole(found), True, found)
        return Mark(hashes_of(self.known[at], self.kept_by[at]), False, found)


@dataclass
class Mark:
    fingerprint: str
    thin: bool
    found: set[bytes]


def whole(found: set[bytes]) -> str:
    """The fingerprint by all terms, whatever the band."""
    h = np.sort(np.array([xxhash.xxh64_intdigest(t) for t in found], np.uint64))
    return hashes_of(h, memberships(h))


def hashes_of(h: np.ndarray, keep: np.ndarray) -> str:
    """Hashes for each subset; all EMPTY without terms."""
    out = []
    for i in range(len(SUBSETS)):
        part = h[keep[:, i]]
        out.append(f"{xxhash.xxh64_intdigest(part.tobytes()) % (16**WIDTH - 1) + 1:0{WIDTH}x}" if len(part) else EMPTY)
    return "".join(out)


def nearness(a: Mark, b: Mark) -> float:
    """likeness(); if one text is told by all its terms, so is the other."""
    if a.thin == b.thin:
        return likeness(a.fingerprint, b.fingerprint)
    return likeness(whole(a.found), whole(b.found))


def likeness(a: str, b: str) -> float:
    """The share of equal hashes, among the TOLD_BY smallest subsets that hold a term of either text; 1 if the fingerprints are equal.

    A subset with one term of the two texts is equal as often as they share a term; large subsets are equal for copies only.
    """
    if a == b:
        return 1.0
    parts = [(a[i : i + WIDTH], b[i : i + WIDTH]) for i in range(len(a) - WIDTH, -1, -WIDTH)]
    told = [x == y for x, y in parts if x != EMPTY or y != EMPTY][:TOLD_BY]
    return min(sum(told) / len(told), 1 - 1 / len(parts)) if told else 0.0


def neighbours(docs: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows (doc_id, packed, range, guest) dealt out so that each range holds documents that follow one another in falling doc_id,
    sorted, behind them as a guest the document that comes next; behind the last range comes the first again.

    Texts travel compressed (packed; null for null). The ranges are cut by ids alone, one number for each block_rows rows. Equal ids follow in an order of their texts; null ids come last.
    """
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"))
    blocks = min(MOST_RANGES, -(-ids.count() // block_rows))
    cuts: list[int] = []
    if blocks > 1:
        shares = F.array(*(F.lit(k / blocks) for k in range(1, blocks)))
        cuts = sorted(set(ids.agg(F.percentile_approx("doc_id", shares, max(10_000, 10 * blocks)).alias("c")).first()["c"] or []))
    edges = np.array(cuts, np.int64)

    def numbered(rows: DataFrame) -> DataFrame:
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids_ = batch.column("doc_id")
                at = len(edges) - np.searchsorted(edges, ids_.fill_null(0).to_numpy(zero_copy_only=False), side="left")
                at = np.where(ids_.is_null().to_numpy(zero_copy_only=False), len(edges) + 1, at)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int64())], [*batch.schema.names, "range"])

        return in_arrow(rows, each, StructType([*rows.schema.fields, StructField("range", LongType())]))

    tops = {r["range"]: r["top"] for r in numbered(ids).groupBy("range").agg(F.max("doc_id").alias("top")).collect()}
    order = sorted(tops)
    hosts = {r: order[i - 1] for i, r in enumerate(order)}
    rows = numbered(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"))

    def invited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        names, types = ["doc_id", "packed", "range", "guest"], (pa.int64(), pa.binary(), pa.int64(), pa.bool_())
        for batch in batches:
            if not batch.num_rows:
                continue
            out = []
            for doc, text, at in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "range")), strict=True):
                packed = None if text is None else pack(text.encode("utf-8", "replace"))
                out.append((doc, packed, at, False))
                if doc == tops[at]:
                    out.append((doc, packed, hosts[at], True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    dealt = in_arrow(rows, invited, "doc_id bigint, packed binary, range bigint, guest boolean")
    return dealt.repartition("range").sortWithinPartitions("range", "guest", F.desc_nulls_last("doc_id"), F.asc_nulls_first("packed"))


def fingerprinted(docs: DataFrame, known: np.ndarray | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row of docs (doc_id, text).

    The edited text is the text without its last floor(n_chars / 2) characters, followed by as many (or all) of the next
    document's first ones. Null texts are empty; a text without terms has a fingerprint of zeros. Null ids stand behind all
    others. Repeated rows repeat and are each other's neighbours. Alone, a document is its own neighbour. An empty table gives no
    rows. More columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(lexicon(docs) if known is None else known)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, out, unpack = Terms(shared.value), [], zstandard.ZstdDecompressor().decompress
        last: tuple | None = None  # the row that waits for its next: range, guest, id, text, mark
        for batch in batches:
            for doc, packed, at, guest in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "packed", "range", "guest")), strict=True):
                if guest and last and last[1] and last[0] == at:
                    continue  # of guests with one id, the first
                text = unpack(packed).decode() if packed else ""
                mark = table.mark(terms(text))
                if last and not last[1]:
                    _, _, id_, own, before = last
                    half = len(own) // 2
                    edited = own[: len(own) - half] + text[:half]
                    other = table.mark(terms(edited))
                    out.append((id_, len(own), hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest(), before.fingerprint, other.fingerprint, nearness(before, other), nearness(before, mark)))
                last = at, guest, doc, text, mark
                if len(out) >= BATCH_ROWS:
                    yield rows_of(out)
                    out = []
        if out:
            yield rows_of(out)

    return in_arrow(neighbours(docs), each, RESULT)


RESULT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def rows_of(out: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], [c.split()[0] for c in RESULT.split(", ")])
