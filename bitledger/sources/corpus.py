"""Text corpora by name, and listings of output files."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_corpus(
    spark: SparkSession, name: str, catalog: Mapping[str, str | DataFrame], order: str = "doc_id"
) -> DataFrame:
    """The corpus called ``name`` as ``(doc_id, text)``; an unknown name means the first one.

    Catalog entries are DataFrames, table names or Parquet paths. The text is column
    ``text`` or else the first column other than ``order``, the column that orders the texts and
    becomes ``doc_id``. A corpus without it is refused: row numbers given while reading
    would move from run to run.
    """
    entry = catalog.get(name, next(iter(catalog.values())))
    if isinstance(entry, str):
        entry = spark.read.parquet(entry) if "/" in entry else spark.table(entry)
    columns = entry.columns
    if order not in columns:
        raise ValueError(f"corpus {name} has no column {order} to order its texts by")
    text = "text" if "text" in columns else next(c for c in columns if c != order)
    return entry.select(F.col(order).alias("doc_id"), F.col(text).alias("text"))


def file_inventory(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files sorted by name with their size in MB, and the values that their folders are named
    by (``lang=en``) as columns; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    known = {"path", "modificationTime", "length", "content"}
    return files.select(
        *[c for c in files.columns if c not in known],
        F.substring_index("path", "/", -1).alias("file_name"),
        (F.col("length") / F.lit(1024.0 * 1024.0)).alias("size_mb"),
    ).orderBy("file_name")
