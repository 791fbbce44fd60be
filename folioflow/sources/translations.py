"""Translation files: a text grammar of headed entries, read without Python.

    @@ <segment-id>      the translation, on the lines that follow
    @@ <segment-id> =    the source stays as it is
    @@ note <segment-id> a translator's note
    @@ glossary          lines `source term => translation`
    @@ -- anything       left out
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chars as C
from ..functions import text as T

HEADER = rf"^@@[{C.WS}]+(.*?)[{C.WS}]*$"


def entries(files: DataFrame) -> DataFrame:
    """ord, entry_type (seg, note, glossary), key, body, is_keep for each entry of files (any columns, and text)."""
    others = [c for c in files.columns if c != "text"]
    lines = F.split(F.col("text"), C.LINE_BREAK)
    rows = files.select(*others, lines.alias("_lines"))
    heads = F.filter(F.transform("_lines", lambda x, i: F.when(x.rlike(HEADER), i + 1)), lambda i: i.isNotNull())
    rows = rows.withColumn("_heads", heads).select(*others, "_lines", "_heads", F.posexplode("_heads").alias("ord", "_at"))
    following = F.coalesce(F.try_element_at("_heads", F.col("ord") + 2), F.size("_lines") + 1)
    body = T.strip(F.array_join(F.slice("_lines", F.col("_at") + 1, following - F.col("_at") - 1), "\n"))
    words = F.filter(F.split(F.regexp_extract(F.element_at("_lines", F.col("_at")), HEADER, 1), f"[{C.WS}]+"), lambda w: w != "")
    rows = rows.select(*others, "ord", words.alias("_w"), body.alias("body")).where("size(_w) > 0").withColumn("_first", F.element_at("_w", 1))
    rows = rows.where(~F.startswith("_first", F.lit("--")))
    noted = (F.col("_first") == "note") & (F.size("_w") > 1)
    kind = F.when(F.col("_first") == "glossary", "glossary").when(noted, "note").otherwise("seg")
    keep = (kind == "seg") & F.array_contains(F.slice("_w", 2, F.greatest(F.size("_w") - 1, F.lit(0))), "=")
    rows = rows.select(*others, "ord", kind.alias("entry_type"), F.when(noted, F.element_at("_w", 2)).otherwise(F.col("_first")).alias("key"), "body", keep.alias("is_keep"))
    plain = rows.where("entry_type = 'seg' or entry_type = 'note' and body <> ''").withColumn("body", F.when(~F.col("is_keep"), F.col("body")))
    lines = rows.where("entry_type = 'glossary'").withColumn("_line", F.explode(F.split("body", C.LINE_BREAK)))
    term, rendering = T.strip(F.substring_index("_line", "=>", 1)), T.strip(F.expr("substring(_line, instr(_line, '=>') + 2)"))
    lines = lines.where(F.contains("_line", F.lit("=>"))).withColumn("key", term).withColumn("body", rendering).where("key <> '' and body <> ''")
    return plain.unionByName(lines.select(*plain.columns))


def read_translations(spark: SparkSession, folder: str) -> DataFrame:
    """file, n, file_mtime, text of the numbered .txt files of a folder."""
    rows = spark.read.text(folder, wholetext=True, pathGlobFilter="*.txt").select("value", "_metadata.file_name", "_metadata.file_modification_time")
    number = F.expr("try_cast(regexp_extract(file_name, '^([0-9]+)[.]txt$', 1) as int)")
    return rows.select(F.col("file_name").alias("file"), number.alias("n"), (F.unix_micros("file_modification_time") / 1e6).alias("file_mtime"), F.col("value").alias("text"))
