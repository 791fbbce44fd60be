"""Helpers shared by the operators: tables, scratch tables, words and the tokenizer."""

from __future__ import annotations

import base64
import ctypes
import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A word is a run of characters that are none of space, tab, \n, \v, \f and \r.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
WORD = re.compile(WORD_PATTERN)
#: Rows of an Arrow batch. Texts can be long, so that batches are kept short.
BATCH_ROWS = 1000
BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: The most rows of a table of few numbers a row that is broadcast (under 1 MB).
SMALL_ROWS = 10_000


_own_folders: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the session for tables that cut lineage; a temporary one only where none is named and all runs here."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
    return _own_folders.setdefault(context.applicationId, f"file://{tempfile.mkdtemp(prefix='scratch-')}")


def saved(df: DataFrame, label: str, **options: str) -> DataFrame:
    """df written once to the shared folder and read again: lost executors cost no recomputation, and later uses read the file."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    give_back()
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes the files of saved() tables that no later result reads."""
    for df in tables:
        spark, path = df.sparkSession, getattr(df, "_scratch_path", None)
        if path:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def in_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """df.mapInArrow(), with batches of BATCH_ROWS rows at most: buffers on both sides grow with the texts of a batch."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(BATCH_CONF)) <= BATCH_ROWS:
        conf.set(BATCH_CONF, str(BATCH_ROWS))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        give_back()

    return df.mapInArrow(each, schema)


def give_back() -> None:
    """Returns freed memory to the system: workers live on, and the next stage's need would come on top."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | StructType) -> DataFrame:
    """function over every Arrow batch of df."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                out = function(batch.slice(at, BATCH_ROWS))
                if out.num_rows:
                    yield out

    return in_arrow(df, each, schema)


def small(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """A saved() table, to be broadcast if it has at most so many rows; beyond that, joins shuffle."""
    return F.broadcast(df) if df.count() <= most else df


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text or "")


@functools.lru_cache(maxsize=4)
def byte_bpe(path: str):
    """Encoder for a byte-level BPE file of the `tokenizers` library, with the ids that library gives without special tokens added.

    The ranks file beside it holds the same vocabulary, which tiktoken encodes about four times as fast; where that file is
    missing, the library itself encodes. It also encodes texts that hold the string of an added token, which has an id of its own.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]

    def by_library(text: str) -> list[int]:
        return tokenizer.encode(text, add_special_tokens=False).ids

    try:
        with open(path.removesuffix(".json") + ".tiktoken", "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
    except FileNotFoundError:
        return by_library
    import tiktoken

    # The pattern of this family of vocabularies, a fixed value, with possessive runs where no backtracking can help.
    pattern = r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s+"
    plain = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return lambda text: by_library(text) if any(t in text for t in added) else plain(text)


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def crc_part(key: str = "doc_id", parts: int = 4):
    """crc32 of a key as text, modulo parts; null keys count as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % parts
