"""Best-fit packing of token pieces by the sum-of-squares rule.

Documents become pieces of at most `capacity` tokens. The number of distinct lengths is bounded by `capacity`, so the
placement is planned on the histogram of lengths and never on rows: sum-of-squares packing of one block of at most
BLOCK_ITEMS pieces, whose length profile is that of the whole table, gives slots that all copies of the block share. What
division by the number of copies leaves over, and at first what lay in bins of the block that stayed too empty, is planned again, as
smaller blocks, until one block holds the rest. Rows then take slots by their rank within their length.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_bpe, map_batches, saved

CAPACITY, END_ID = 1024, 2
#: Pieces of a planned block, about. Each level leaves less than one piece of each length for each copy of its block, so that n
#: pieces take at most LEVELS_BACK + 1 + log(n / BLOCK_ITEMS) / log(BLOCK_ITEMS / capacity) levels: 12 for 10 ** 10 pieces, with 8
#: bytes for each slot that is broadcast (6 MB; as measured, 2 MB).
BLOCK_ITEMS = 1 << 16
#: In the first levels, a bin of a repeated block keeps its pieces only if at most this share of it is empty.
LEVELS_BACK, SLACK = 8, 0.01
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: all but the first are full, so that the rest stands in front."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] * (n > 0) + [(at, capacity) for at in range(first, n, capacity)]


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """A row for each piece of each document. Null and empty texts are the end id alone; extra columns are ignored."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode, out = byte_bpe(vocabulary), []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            ids = np.array([*encode(text or ""), end_id], dtype="<u4").tobytes()
            out += [(doc, i, at, n, zlib.crc32(ids[4 * at : 4 * (at + n)])) for i, (at, n) in enumerate(cut(len(ids) // 4, capacity))]
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        columns = zip(*out, strict=True) if out else [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_batches(docs.select("doc_id", "text"), one, PIECES)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each length, in falling order of length, and the number of bins.

    A piece goes to the open bin whose choice makes the sum of squared counts of open bins, by residual gap, smallest (of
    equals, the smallest gap). A bin is opened only if no open one has room.
    """
    counts = np.zeros(capacity + 1, np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bin_of, offset_of, bins = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    far = np.int64(1) << 60
    for i, s in enumerate(lengths.tolist()):
        here = counts[s:capacity]
        # Moving a bin from gap g to g - s changes the sum by 2 (N[g - s] - N[g]) + 2; a filled bin leaves the count.
        change = 2 * (counts[: capacity - s] - here) + 2
        if s < capacity:
            change[0] = 1 - 2 * here[0]
            change[here == 0] = far
        j = int(change.argmin()) if s < capacity else 0
        if s == capacity or change[j] == far:
            b, gap, bins = bins, capacity, bins + 1
        else:
            gap = s + j
            b = stacks[gap].pop()
            counts[gap] -= 1
        bin_of[i], offset_of[i] = b, capacity - gap
        if gap > s:
            counts[gap - s] += 1
            stacks[gap - s].append(b)
    return bin_of, offset_of, bins


def plan(histogram: dict[int, int], capacity: int = CAPACITY, block_items: int = BLOCK_ITEMS, slack: float = SLACK) -> tuple[list[tuple], list[tuple], int]:
    """Spans (length, level, first rank, copies, per copy, first sequence, bins of a copy), slots (length, level, bins, offsets), sequences."""
    left = np.zeros(capacity + 1, np.int64)
    for length, count in histogram.items():
        left[length] = count
    taken, spans, slots, sequence, level = np.zeros_like(left), [], [], 0, 0
    while left.sum():
        copies = max(1, int(left.sum()) // block_items)
        quota = left // copies
        while not quota.any():  # many lengths with few pieces each
            copies = max(1, copies // 2)
            quota = left // copies
        lengths = np.repeat(np.arange(capacity, 0, -1), quota[:0:-1])
        bin_of, offset_of, bins = sum_of_squares(lengths, capacity)
        if copies > 1 and level < LEVELS_BACK:  # poorly filled bins of a block that repeats go back; the fullest stays
            filled = np.bincount(bin_of, weights=lengths, minlength=bins)
            keep = filled >= min(filled.max(), capacity * (1 - slack))
            number = np.cumsum(keep) - 1
            chosen = keep[bin_of]
            if 4 * chosen.sum() < len(lengths):  # little fits well: the block stays as it is
                chosen[:] = keep[:] = True
                number = np.arange(bins)
            lengths, offset_of, bin_of, bins = lengths[chosen], offset_of[chosen], number[bin_of[chosen]], int(keep.sum())
            quota = np.bincount(lengths, minlength=capacity + 1)
        first = np.r_[0, np.flatnonzero(np.diff(lengths)) + 1, len(lengths)]
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            s = int(lengths[a])
            spans.append((s, level, int(taken[s]), copies, b - a, sequence, bins))
            slots.append((s, level, bin_of[a:b].tolist(), offset_of[a:b].tolist()))
        taken += quota * copies
        left -= quota * copies
        sequence, level = sequence + bins * copies, level + 1
    return spans, slots, sequence


def ranked(rows: DataFrame, key: str, order: list[str], salts: int) -> DataFrame:
    """rows with `rank` from 0 within key: ranks within salted parts of a key, moved by the sizes of the parts before."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    sizes = salted.groupBy(key, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy(key).orderBy("_salt")) - F.col("_n")).drop("_n")
    inner = F.row_number().over(Window.partitionBy(key, "_salt").orderBy(*order))
    return salted.withColumn("_row", inner).join(before, [key, "_salt"]).withColumn("rank", F.col("_before") + F.col("_row") - 1).drop("_salt", "_row", "_before")


def place(rows: DataFrame, capacity: int = CAPACITY, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """rows (of pieces(), saved) with sequence_id and offset."""
    spark = rows.sparkSession
    histogram = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    full = histogram.pop(capacity, 0)
    spans, slots, sequences = plan(histogram, capacity, block_items)
    whole = rows.where(F.col("length") == capacity)
    parts = rows.where(F.col("length") < capacity)
    # Parts of a length are ranked apart; the table of their sizes has a row for each of at most 10 000 parts of a length.
    salts = max(1, min(10_000, (full + sum(histogram.values())) // 20_000))
    order = ["doc_id", "piece", "start", "ids_crc32"]
    alone = ranked(whole, "length", order, salts * 4).select(*rows.columns, (F.lit(sequences) + F.col("rank")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    span_table = spark.createDataFrame(spans, "length bigint, level int, first bigint, copies bigint, per_copy bigint, sequence bigint, bins bigint")
    slot_table = spark.createDataFrame(slots, "length bigint, level int, bins array<int>, offsets array<int>")
    # Both tables are bounded: a row for each length and level, two numbers for each piece of a block and level.
    spans_by_length = span_table.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("first", "level", "copies", "per_copy", "sequence", "bins"))).alias("spans"))
    at = ranked(parts, "length", order, salts).join(F.broadcast(spans_by_length), "length")
    at = at.withColumn("s", F.element_at(F.filter("spans", lambda s: s["first"] <= F.col("rank")), -1)).drop("spans")
    local = F.col("rank") - F.col("s.first")
    at = at.withColumns({"level": F.col("s.level"), "slot": (local % F.col("s.per_copy") + 1).cast("int"), "base": F.col("s.sequence") + F.floor(local / F.col("s.per_copy")) * F.col("s.bins")})
    placed = at.join(F.broadcast(slot_table), ["length", "level"])
    bin_, offset = (F.element_at(c, F.col("slot")).cast("bigint") for c in ("bins", "offsets"))
    return placed.select(*rows.columns, (F.col("base") + bin_).cast("bigint").alias("sequence_id"), offset.alias("offset")).unionByName(alone)


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of docs (doc_id, text).

    Null or empty text: one piece, the end id. Repeated rows and repeated ids: each row is packed by itself. Null doc_id: kept.
    Empty table: no rows. Extra columns are ignored. Very long texts: cut into full pieces behind a shorter first one.
    """
    return place(saved(pieces(docs, vocabulary, capacity, end_id), "pieces"), capacity, block_items)


def sequences(docs: DataFrame, placed: DataFrame, vocabulary: str, end_id: int = END_ID) -> DataFrame:
    """sequence_id and its token ids, in order of offset: the training input itself. doc_id must be unique here."""
    ids = "doc_id bigint, ids array<int>"

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode = byte_bpe(vocabulary)
        tokens = [[*encode(x or ""), end_id] for x in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(tokens, pa.list_(pa.int32()))], ["doc_id", "ids"])

    parts = placed.join(map_batches(docs.select("doc_id", "text"), one, ids), "doc_id")
    part = F.struct("offset", F.expr("slice(ids, int(start) + 1, int(length))").alias("ids"))
    return parts.groupBy("sequence_id").agg(F.sort_array(F.collect_list(part)).alias("parts")).select("sequence_id", F.flatten("parts.ids").alias("ids"))
