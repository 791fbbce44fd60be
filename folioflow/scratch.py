"""Tables written to the folder that all executors share, for plans that read one result in many places."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one only where none is named and all runs on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
    return _own.setdefault(context.applicationId, f"file://{tempfile.mkdtemp(prefix='scratch-')}")


def saved(df: DataFrame, label: str) -> DataFrame:
    """df as a written table: its lineage ends there, and a lost executor costs no recomputation."""
    path = f"{folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
