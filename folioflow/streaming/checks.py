"""Checks that run as translation files arrive: an extension, on Structured Streaming's file source.

Each micro-batch parses the files that are new and writes their findings under the batch's number, so that a batch which runs again
replaces what it wrote.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.translations import entries


def arriving(spark: SparkSession, folder: str, files_a_batch: int = 1000) -> DataFrame:
    """book_id, file, n, text of files named <book>/<number>.txt below a folder, as they come."""
    rows = spark.readStream.format("text").schema("value string").option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").option("maxFilesPerTrigger", files_a_batch).load(folder)
    path = F.col("_metadata.file_path")
    rows = rows.select(F.regexp_extract(path, r"([^/]+)/[^/]+$", 1).alias("book_id"), F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))
    return rows.withColumn("n", F.expr("try_cast(regexp_extract(file, '^([0-9]+)[.]txt$', 1) as int)"))


def watch(spark: SparkSession, folder: str, check: Callable[[DataFrame], DataFrame], out: str, state: str) -> StreamingQuery:
    """Starts a query that checks the entries of all files there are, then ends; files already seen are not read again."""

    def one(batch: DataFrame, number: int) -> None:
        check(entries(batch)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return arriving(spark, folder).writeStream.foreachBatch(one).option("checkpointLocation", state).trigger(availableNow=True).start()
