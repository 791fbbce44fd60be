"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import extract, fingerprint, language, neardup, pack, pieces, quality, rollup, shard, toxicity
from .common import forget, scratch_dir, table, vocabulary


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op6_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(table(spark, sf_dir, "pages"))


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprinted(table(spark, sf_dir, "documents"))


def op8_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.grouped(table(spark, sf_dir, "documents"), words=2)


def op9_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of the shards of whole documents, as they were written."""
    sharded = shard.shard_rows(table(spark, sf_dir, "documents"))
    path = f"{scratch_dir(spark)}/shards-{uuid.uuid4().hex}"
    shard.write_shards(sharded, path)
    forget(sharded)
    text = F.coalesce("text", F.lit("")).cast("binary")
    size = (F.octet_length(text) + 1).cast("bigint").alias("size")
    out = spark.read.schema(sharded.schema).parquet(path)
    return out.select("doc_id", size, F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.rate(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lang", "perplexity", "lower", "upper")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op10_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The totals after a history of batches, each committed twice."""
    kept = rollup.Rollup(spark, f"{scratch_dir(spark)}/rollup-{uuid.uuid4().hex}", merge_after=3)
    for batch, changes in rollup.history(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json")):
        kept.commit(batch, changes)
        kept.commit(batch, changes)
    return kept.totals()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pack": op1_pack,
    "op2_pieces": op2_pieces,
    "op3_language": op3_language,
    "op4_quality": op4_quality,
    "op5_toxicity": op5_toxicity,
    "op6_extract": op6_extract,
    "op7_fingerprint": op7_fingerprint,
    "op8_neardup": op8_neardup,
    "op9_shard": op9_shard,
    "op10_rollup": op10_rollup,
}

ORACLE_SQL: dict[str, str] = {}
