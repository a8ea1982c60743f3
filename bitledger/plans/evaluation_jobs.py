"""What is left to evaluate, from the result files that are there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bitledger.functions import fixed_values as fixed
from bitledger.operators.jobs import completed_groups, pending_jobs
from bitledger.sources.evaluations import result_texts, valid_results, with_label_and_part


def finished_parts(
    spark: SparkSession, path: str | list[str], prefix: str, labels: list[str]
) -> DataFrame:
    """(label, part) of every result file that parses; corrupt files count as not done."""
    valid, _ = valid_results(result_texts(spark, path))
    return with_label_and_part(valid, prefix, labels).select("label", "part").distinct()


def pending_evaluations(
    spark: SparkSession,
    path: str | list[str],
    models: DataFrame,
    prefix: str,
    labels: list[str],
    parts: list[str] = fixed.PARTS,
    force: bool = False,
) -> DataFrame:
    """Model parts to run: those without a valid result, or all of them when forced."""
    return pending_jobs(models, finished_parts(spark, path, prefix, labels), parts, force)


def finished_models(
    spark: SparkSession, path: str | list[str], prefix: str, labels: list[str]
) -> DataFrame:
    """Labels with all their parts done, for which nothing has to be started."""
    return completed_groups(finished_parts(spark, path, prefix, labels))
