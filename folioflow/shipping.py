"""Sends the package to Python workers that would not find it by their own path."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Adds the package's sources to the session's workers, once for an application."""
    context = spark.sparkContext
    if context.applicationId not in _sent:
        root = Path(__file__).resolve().parent
        target = os.path.join(tempfile.mkdtemp(prefix="sources-"), f"{root.name}.zip")
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
            for path in sorted(root.rglob("*.py")):
                out.write(path, path.relative_to(root.parent).as_posix())
        context.addPyFile(target)
        _sent.add(context.applicationId)
    return spark
