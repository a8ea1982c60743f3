"""Task-accuracy result files: ``results -> task -> "metric,filter" -> value``."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bitledger.functions import fixed_values as fixed
from bitledger.functions.columns import missing_if_nan, strip
from bitledger.schemas import EVALUATION_RESULT


def read_eval_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per file: name, modification time and the whole ``results`` map."""
    return (
        spark.read.schema(EVALUATION_RESULT)
        .option("multiLine", True)
        .json(path)
        .select(
            F.col("_metadata.file_name").alias("file_name"),
            F.col("_metadata.file_modification_time").alias("file_mtime"),
            "results",
        )
    )


def metric_rows(files: DataFrame) -> DataFrame:
    """Unfold ``results``; a file or task without entries keeps one row with null keys."""
    kept = [c for c in files.columns if c != "results"]
    tasks = files.select(*kept, F.explode_outer("results").alias("task", "metrics"))
    return tasks.select(
        *kept, "task", F.explode_outer("metrics").alias("metric_key", "raw_value")
    ).select(
        *kept,
        "task",
        "metric_key",
        missing_if_nan(F.col("raw_value").try_cast("double")).alias("value"),
    )


def read_eval_results(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Long rows of all result files; text values become null, files without results vanish."""
    return metric_rows(read_eval_files(spark, path)).where(F.col("metric_key").isNotNull())


def with_label_and_part(files: DataFrame, prefix: str, labels: list[str]) -> DataFrame:
    """Read label and part from names like ``<prefix>_<label>_<part>[_<suffix>].json``.

    Files of other experiments are left out.
    """
    pattern = (
        f"^{re.escape(prefix)}_({'|'.join(map(re.escape, labels))})"
        f"_({'|'.join(fixed.PARTS)})(_.*)?\\.json$"
    )
    name = F.col("file_name")
    return files.where(name.rlike(pattern)).withColumns(
        {
            "label": F.regexp_extract(name, pattern, 1),
            "part": F.regexp_extract(name, pattern, 2),
        }
    )


def _parses(text: Column) -> Column:
    """True for JSON text that can be read to its end.

    Objects may repeat a key or hold NaN, as result writers produce them; the strict variant
    parser, which refuses both, only sees other texts.
    """
    body = strip(text)
    options = {"columnNameOfCorruptRecord": "_corrupt", "allowSingleQuotes": "false"}
    record = F.from_json(body, "results STRING, _corrupt STRING", options)
    whole_object = record.isNotNull() & record["_corrupt"].isNull() & body.endswith("}")
    return F.when(body.startswith("{"), whole_object).otherwise(
        F.try_parse_json(body).isNotNull()
    )


def result_texts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Result files as ``(file_name, text)``; each is one small JSON document."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("text")
    )


def valid_results(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split ``(file_name, text)`` into files whose JSON parses and corrupt ones.

    Corrupt files are reported so that their jobs run again; nothing is deleted.
    """
    checked = files.withColumn("ok", F.coalesce(_parses(F.col("text")), F.lit(False)))
    return checked.where("ok").drop("ok", "text"), checked.where("NOT ok").drop("ok", "text")


def matches_output(name: Column, output: Column) -> Column:
    """A result belongs to ``x.json`` if it is called ``x.json`` or ``x_<anything>.json``."""
    stem = F.regexp_replace(output, r"\.json$", "")
    return (name == output) | (
        name.startswith(F.concat(stem, F.lit("_"))) & name.endswith(".json")
    )
