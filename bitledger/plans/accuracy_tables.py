"""The two accuracy tables: by quantization method and by file scheme."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bitledger.functions import fixed_values as fixed
from bitledger.operators.accuracy import accuracy_table, method_dimension, scheme_dimension
from bitledger.sources.evaluations import metric_rows, read_eval_files, with_label_and_part

_SCORES = [c for task in fixed.TASKS for c in (task, f"{task}_stderr")]
_AUDIT = ["n_tasks_completed", "_status", *fixed.PART_AUDIT_COLUMNS.values()]
METHOD_TABLE_COLUMNS = [
    "model", "method_label", "method", "bits", *_SCORES, "avg", "delta_vs_fp16_pp", *_AUDIT,
]
SCHEME_TABLE_COLUMNS = [
    "model", "engine", "scheme", *_SCORES, "avg", "delta_vs_f16_gguf_pp", *_AUDIT,
]


def accuracy_by_method(metrics: DataFrame) -> DataFrame:
    """Accuracy per method label against ``fp16``; ``ord`` is the table order."""
    labels = [row[0] for row in fixed.METHOD_ROWS]
    table = accuracy_table(
        metrics, method_dimension(metrics.sparkSession), labels, "fp16", "delta_vs_fp16_pp"
    ).withColumnRenamed("label", "method_label")
    return table.select("ord", *METHOD_TABLE_COLUMNS)


def accuracy_by_scheme(metrics: DataFrame) -> DataFrame:
    """Accuracy per file scheme against ``F16``; ``ord`` is the table order."""
    table = accuracy_table(
        metrics, scheme_dimension(metrics.sparkSession), fixed.SCHEME_ROWS, "F16",
        "delta_vs_f16_gguf_pp",
    ).withColumnRenamed("label", "scheme")
    return table.select("ord", *SCHEME_TABLE_COLUMNS)


def evaluation_metrics(
    spark: SparkSession, path: str | list[str], prefix: str, labels: list[str]
) -> DataFrame:
    """Metric rows of the result files ``<prefix>_<label>_<part>...json``."""
    files = with_label_and_part(read_eval_files(spark, path), prefix, labels)
    return metric_rows(files)


def accuracy_by_method_files(
    spark: SparkSession, path: str, prefix: str = fixed.METHOD_FILE_PREFIX
) -> DataFrame:
    labels = [row[0] for row in fixed.METHOD_ROWS]
    table = accuracy_by_method(evaluation_metrics(spark, path, prefix, labels))
    return table.orderBy("ord")


def accuracy_by_scheme_files(
    spark: SparkSession, path: str, prefix: str = fixed.SCHEME_FILE_PREFIX
) -> DataFrame:
    table = accuracy_by_scheme(evaluation_metrics(spark, path, prefix, fixed.SCHEME_ROWS))
    return table.orderBy("ord")
