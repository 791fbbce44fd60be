"""Sharding by a two-pass external shuffle, with DataFrame functions only.

First pass: a seeded hash scatters records evenly into buckets that fit in memory. Second pass: each bucket is shuffled by
itself (`shuffle` draws a Fisher-Yates permutation) and its records take consecutive places. The buckets, one behind the
other, are a random order of the whole table, which is cut into shards of equal counts.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, small

SHARDS, SEED = 8, 20_251
#: Records and bytes of a bucket. The scatter is even, so that no bucket is far above them but for single long records.
BUCKET_RECORDS, BUCKET_BYTES = 8_000, 8_000_000
#: Two numbers for each of at most so many buckets (16 MB) are broadcast; beyond them they are shuffled.
MOST_BUCKETS = 1_000_000
#: Parts in which copies of a record are numbered; buckets of a block.
PARTS, BLOCK = 1024, 4096


def bytes_of(records: DataFrame) -> Column:
    """About how many bytes a record takes up."""
    parts = [F.coalesce(F.octet_length(c), F.lit(0)) if kind in ("string", "binary") else F.lit(8) for c, kind in records.dtypes]
    return functools.reduce(operator.add, parts, F.lit(0)).cast("bigint")


def shuffled(records: DataFrame, seed: int = SEED, bucket_records: int = BUCKET_RECORDS, bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, int]:
    """records with `position` (gapless from 0), in a random order that seed and records decide, and their number.

    Wholly equal records are numbered, so that a group of copies spreads over all buckets whatever the partitions of the input.
    Nulls are values like others. Empty table: no rows. All columns are kept; a column named `position` is replaced.
    """
    columns = [c for c in records.columns if c != "position"]
    rows, size = records.agg(F.count(F.lit(1)), F.coalesce(F.sum(bytes_of(records)), F.lit(0))).first()
    buckets = max(1, -(-rows // bucket_records), -(-size // bucket_bytes))
    keyed = records.select(*columns).withColumn("__key", F.xxhash64(F.lit(seed), *columns))
    scattered = numbered(keyed).withColumn("__bucket", F.pmod(F.xxhash64(F.lit(seed + 1), "__key", "__copy"), F.lit(buckets)))
    scattered = saved(scattered, "buckets", compression="zstd")  # what is drawn below is read from here, once scattered
    # Sorted arrays, in sorted order within a partition, make the seeded draw the same each time.
    gathered = scattered.repartition(buckets, "__bucket").groupBy("__bucket").agg(F.array_sort(F.collect_list(F.struct("__key", *columns))).alias("__all")).sortWithinPartitions("__bucket")
    drawn = gathered.select("__bucket", F.posexplode(F.shuffle("__all", seed)).alias("__at", "__record"))
    before = small(saved(places(scattered), "places"), MOST_BUCKETS)
    out = drawn.join(before, "__bucket").select(*(F.col("__record")[c].alias(c) for c in columns), (F.col("__before") + F.col("__at")).alias("position"))
    out._scratch_path = scattered._scratch_path
    return out, rows


def numbered(keyed: DataFrame) -> DataFrame:
    """keyed (__key, ...) with __copy: 0, or 0 to n - 1 for rows that share a key. Only the latter are shuffled, if any, in parts."""
    repeats = small(saved(keyed.groupBy("__key").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("__key"), "repeats"))
    alone = keyed.join(repeats, "__key", "left_anti").withColumn("__copy", F.lit(0).cast("bigint"))
    if not repeats.count():
        return alone
    # Which of equal rows gets which number has no effect, as they are equal; where a row stands may deal them to parts.
    many = keyed.join(repeats, "__key").withColumn("__part", F.pmod(F.xxhash64(F.spark_partition_id(), F.monotonically_increasing_id()), F.lit(PARTS)))
    many = saved(many, "copies", compression="zstd")
    sizes = many.groupBy("__key", "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__key", "__part", (F.sum("__n").over(Window.partitionBy("__key").orderBy("__part")) - F.col("__n")).alias("__before"))
    inner = F.row_number().over(Window.partitionBy("__key", "__part").orderBy("__part"))
    ranked = many.withColumn("__row", inner).join(before, ["__key", "__part"])
    return alone.unionByName(ranked.withColumn("__copy", F.col("__before") + F.col("__row") - 1).select(*alone.columns))


def places(scattered: DataFrame) -> DataFrame:
    """__bucket, __before: how many rows lie in earlier buckets. Sums of blocks of buckets first, so that no task sees all buckets."""
    sizes = scattered.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n")).withColumn("__block", F.floor(F.col("__bucket") / F.lit(BLOCK)))
    blocks = sizes.groupBy("__block").agg(F.sum("__n").alias("__n"))
    starts = blocks.select("__block", (F.sum("__n").over(Window.orderBy("__block")) - F.col("__n")).alias("__start"))
    within = sizes.withColumn("__within", F.sum("__n").over(Window.partitionBy("__block").orderBy("__bucket")) - F.col("__n"))
    return within.join(starts, "__block").select("__bucket", (F.col("__start") + F.col("__within")).alias("__before"))


def shard_rows(records: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_records: int = BUCKET_RECORDS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """records with shard (0 to shards - 1; counts at most one apart) and slot (gapless from 0 within the shard)."""
    out, rows = shuffled(records.drop("shard", "slot"), seed, bucket_records, bucket_bytes)
    path = out._scratch_path
    n, k = F.lit(max(rows, 1)), F.lit(shards)
    shard = F.expr(f"position * {shards} div {max(rows, 1)}")
    out = out.withColumn("shard", shard.cast("int"))
    first = F.floor((F.col("shard") * n + k - 1) / k)
    out = out.withColumn("slot", F.col("position") - first.cast("bigint")).drop("position")
    out._scratch_path = path
    return out


def write_shards(sharded: DataFrame, path: str) -> None:
    """A folder of Parquet for each shard, each file in order of slot. A bucket lies in few shards, so that nothing is shuffled again."""
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").option("compression", "zstd").parquet(path)
