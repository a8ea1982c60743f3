"""Engine performance of all labels in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitledger.functions import fixed_values as fixed
from bitledger.operators.engine import engine_performance_table
from bitledger.sinks.tables import append_summary_csv
from bitledger.sources.engine import (
    parse_engine_bench,
    parse_telemetry,
    read_engine_bench,
    read_telemetry,
)


def engine_tests(spark: SparkSession, path: str, label_pattern: str = r"([^/]+)/[^/]+$") -> DataFrame:
    """Tests of the engine output files; the label is read from the file's path."""
    files = spark.read.text(path, wholetext=True).select(
        F.regexp_extract(F.col("_metadata.file_path"), label_pattern, 1).alias("label"),
        F.col("value").alias("json"),
    )
    return read_engine_bench(parse_engine_bench(files))


def engine_summary(
    spark: SparkSession,
    bench_json: str,
    telemetry_log: str,
    summary_csv: str | None = None,
) -> DataFrame:
    """One row per label from ``<label>/<bench>.json`` and ``<label>/<telemetry>.log`` files;
    appended to ``summary_csv`` if given."""
    samples = parse_telemetry(read_telemetry(spark, telemetry_log))
    table = engine_performance_table(engine_tests(spark, bench_json), samples)
    if summary_csv:
        append_engine_summary(table, summary_csv)
    return table


def append_engine_summary(table: DataFrame, summary_csv: str) -> None:
    append_summary_csv(table.select(*fixed.ENGINE_SUMMARY_COLUMNS), summary_csv)
