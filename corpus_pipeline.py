"""The corpus pipeline: each stage applies an operator to what its predecessor kept.

All stages but the last keep the columns of documents, whatever they are called, and only leave rows out. An empty table gives an
empty one. Null texts count as empty, and texts are read whole, however long.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioflow.llm import neardup, pack, quality, toxicity
from folioflow.llm.common import saved, table, vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold, by a model learned from the labels of these documents.

    Each row is judged by its own text: rows that repeat share a verdict, rows with a null id are judged like others, and a
    score at the threshold goes. Without labels nothing goes.
    """
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the word rules and lie within the perplexity band of their language.

    Each row is judged by its own text and language (a null one is a language of its own); empty texts go. Rows that repeat, with an
    id or without, stay or go together; a perplexity at the edge of the band stays.
    """
    return quality.passing(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies: shingles of five words, similarity 0.8.

    Of rows that repeat an id one stays, the first by text. Rows with a null id and texts without words are in no group and stay.
    """
    return neardup.first_of_group(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents and their places in sequences of 1024 tokens. Every row is packed, also one with a null id."""
    return pack.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("quality", keep_quality),
    ("near duplicates", drop_near_copies),
    ("packing", pack_sequences),
]

#: The stages learn models, draw signatures and pack; SQL cannot say them. A brute-force version is in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs, f"stage-{name.replace(' ', '-')}")
    return docs
