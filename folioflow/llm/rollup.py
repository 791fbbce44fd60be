"""Token counts kept by deltas.

A batch holds signed changes: inserts add a document's tokens, deletes take them away, revisions do both with the old and the
new count. Totals by source, language and tokenizer version are sums of such deltas, so that batches may come in any order and
in parts, and applying one costs what it holds, not what is stored. Totals are stored, with the names of the batches that they
hold; reading them adds the few batches that came later, and every so many commits both are merged into new totals.

A commit is the creation of one empty file whose name says all: the batch (or the number of the totals) and the folder that holds
its rows. That is one step on any file system, without renames. A batch counts once, however often it was written.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_bpe, map_batches, saved, words_of

KEYS = ["source", "lang", "tokenizer_version"]
SUMS = ["documents", "tokens"]
UNKNOWN = "und"
#: Batches after which stored totals take up the new ones.
MERGE_AFTER = 16
ROWS = "source string, lang string, tokenizer_version string, documents bigint, tokens bigint"
CHANGES = "op string, source string, lang string, tokenizer_version string, tokens bigint, old_tokens bigint"


def counted(docs: DataFrame, vocabulary: str, version: str) -> DataFrame:
    """doc_id, source, lang, tokenizer_version, tokens, words of every row of docs (doc_id, text, source, lang). Null texts have none."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode, texts = byte_bpe(vocabulary), batch.column("text").to_pylist()
        counts = [pa.array(x, pa.int64()) for x in ([len(encode(t)) if t else 0 for t in texts], [len(words_of(t)) for t in texts])]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "source", "lang")), pa.array([version] * batch.num_rows), *counts], ["doc_id", *KEYS, "tokens", "words"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("source", F.lit(UNKNOWN)).alias("source"), F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text")
    return map_batches(rows, one, "doc_id bigint, source string, lang string, tokenizer_version string, tokens bigint, words bigint")


def deltas(changes: DataFrame) -> DataFrame:
    """Sums of signed deltas by KEYS of changes (op, KEYS, tokens, old_tokens).

    op is insert, delete or revise; a revision takes old_tokens away and adds tokens. Null keys count as `und`, null counts as 0;
    other ops are an error of the job. Rows are summed before the shuffle, so that a hot source costs one row a task.
    """
    sign = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).when(F.col("op") == "revise", 0)
    sign = F.coalesce(sign, F.raise_error(F.concat(F.lit("unknown change: "), F.coalesce("op", F.lit("null")))).cast("int"))
    tokens, old = F.coalesce("tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0))
    change = F.when(F.col("op") == "revise", tokens - old).otherwise(sign * tokens)
    keys = [F.coalesce(k, F.lit(UNKNOWN)).alias(k) for k in KEYS]
    signed = changes.select(*keys, sign.cast("bigint").alias("documents"), change.cast("bigint").alias("tokens"))
    return signed.groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in SUMS))


def total(parts: DataFrame) -> DataFrame:
    """Totals of summed deltas; groups that hold nothing any more are left out."""
    return parts.groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in SUMS)).where("documents <> 0 or tokens <> 0")


class Rollup:
    """Totals kept in a folder: `rows/` has a folder of sums for each batch and for each version of the totals; empty files in
    `commits/` (batch=folder) and `merges/` (number=folder) say which of them count."""

    def __init__(self, spark: SparkSession, path: str, merge_after: int = MERGE_AFTER) -> None:
        self.spark, self.path, self.merge_after = spark, path.rstrip("/"), merge_after
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))

    def _marks(self, kind: str) -> dict[str, str]:
        """What the files of a kind say. Of several writers of one name, the first by name counts: their rows are the same."""
        if not self._fs.exists(self._at(kind)):
            return {}
        names = sorted((f.getPath().getName() for f in self._fs.listStatus(self._at(kind))), reverse=True)
        return dict(name.split("=") for name in names)

    def _mark(self, kind: str, name: str, folder: str) -> bool:
        self._fs.mkdirs(self._at(kind))
        self._fs.createNewFile(self._at(f"{kind}/{name}={folder}"))
        return self._marks(kind).get(name) == folder

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], ROWS)
        return self.spark.read.schema(ROWS).parquet(*(f"{self.path}/rows/{f}" for f in folders))

    def _state(self) -> tuple[int, str | None, set[str], dict[str, str]]:
        """Number and folder of the newest totals, the batches that they hold, and the folders of those that came later."""
        merges, commits = self._marks("merges"), self._marks("commits")
        if not merges:
            return 0, None, set(), commits
        newest = max(map(int, merges))
        folder = merges[str(newest)]
        held = {r["batch"] for r in self.spark.read.schema("batch string").parquet(f"{self.path}/rows/{folder}-held").collect()}
        return newest, folder, held, {b: f for b, f in commits.items() if b not in held}

    def committed(self, batch: str) -> bool:
        _, _, held, later = self._state()
        return batch in held or batch in later

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Adds a batch; False, without effect, if it was committed before. A failed or doubled writer leaves nothing that counts."""
        if not batch.replace("-", "").replace("_", "").isalnum():
            raise ValueError(f"a batch is named by letters, digits, - and _: {batch!r}")
        if self.committed(batch):
            return False
        folder = uuid.uuid4().hex
        deltas(changes).coalesce(1).write.parquet(f"{self.path}/rows/{folder}")  # a row for each source, language and version of the batch
        won = self._mark("commits", batch, folder)
        if won and len(self._state()[3]) >= self.merge_after:
            self.merge()
        return won

    def merge(self) -> None:
        """Stores new totals that hold all batches so far, and removes what only the totals before the last ones needed."""
        newest, folder, held, later = self._state()
        new = uuid.uuid4().hex
        total(self._read([*later.values(), *([folder] if folder else [])])).coalesce(1).write.parquet(f"{self.path}/rows/{new}")
        batches = self.spark.createDataFrame([(b,) for b in sorted(held | later.keys())], "batch string")
        batches.coalesce(1).write.parquet(f"{self.path}/rows/{new}-held")
        if self._mark("merges", str(newest + 1), new):
            commits = self._marks("commits")
            for batch in held & commits.keys():  # readers of the totals before may still read the later ones
                self._fs.delete(self._at(f"rows/{commits[batch]}"), True)
                self._fs.delete(self._at(f"commits/{batch}={commits[batch]}"), False)

    def totals(self) -> DataFrame:
        _, folder, _, later = self._state()
        return total(self._read([*later.values(), *([folder] if folder else [])]))


def history(docs: DataFrame, vocabulary: str, versions: tuple[str, str] = ("byte_bpe_50k@1", "byte_bpe_50k@2")) -> list[tuple[str, DataFrame]]:
    """Batches that bring docs in, correct and partly move them: what a maintained rollup of the table has gone through.

    All rows are inserted with the count of their words, as a first estimate; all are revised to their tokens; every tenth id
    is deleted; every tenth id plus one moves to the second version, which counts the end mark too.
    """
    first, second = versions
    rows = saved(counted(docs, vocabulary, first), "tokens")
    tenth = F.pmod("doc_id", F.lit(10))

    def changes(rows: DataFrame, op: str, tokens: Column, version: str = first, old: Column | None = None) -> DataFrame:
        before = F.lit(None).cast("bigint") if old is None else old
        return rows.select(F.lit(op).alias("op"), "source", "lang", F.lit(version).alias("tokenizer_version"), tokens.alias("tokens"), before.alias("old_tokens"))

    deleted, moved, tokens, words = rows.where(tenth == 0), rows.where(tenth == 1), F.col("tokens"), F.col("words")
    return [
        ("insert", changes(rows, "insert", words)),
        ("revise", changes(rows, "revise", tokens, old=words)),
        ("delete", changes(deleted, "delete", tokens)),
        ("move", changes(moved, "delete", tokens).unionByName(changes(moved, "insert", tokens + 1, second))),
    ]
