"""Benchmark-run CSV files and perplexity JSON files."""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator
from functools import reduce
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bitledger.functions.columns import missing_if_nan, path_basename
from bitledger.schemas import BENCHMARK_RUN, PERPLEXITY_RESULT, RUN_TIMESTAMP_FORMAT
from bitledger.sources.stores import open_path


# Bytes that a task takes of a file at a time, until it has the header.
_HEAD_BYTES = 1 << 14
_NAMED = re.compile(rb'(^|,)"?model_name"?(,|$)')


def first_header(file: BinaryIO) -> bytes | None:
    """The first line that names column ``model_name``; no more of the file is read than it takes."""
    rest = b""
    while block := file.read(_HEAD_BYTES):
        *lines, rest = (rest + block).split(b"\n")
        for line in lines:
            if _NAMED.search(line.rstrip(b"\r")):
                return line.rstrip(b"\r")
    return rest.rstrip(b"\r") if _NAMED.search(rest.rstrip(b"\r")) else None


def _file_headers(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(file, header)`` of every CSV file, header null where no line names ``model_name``.

    The listing is Spark's, which reads no content for a path alone; tasks then open the files
    and read their first lines.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            headers = []
            for name in batch.column(0).to_pylist():
                store, inner = open_path(name)
                with store.open_input_stream(inner) as file:
                    header = first_header(file)
                headers.append(None if header is None else header.decode("utf-8-sig"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(headers, pa.string())], ["file", "header"])

    files = spark.read.format("binaryFile").load(path).where("length > 0").select("path")
    # Listed files come in few partitions, since they are sized by bytes.
    return files.repartition(spark.sparkContext.defaultParallelism).mapInArrow(read, "file string, header string")


def _schema_for(header: str) -> T.StructType:
    known = {field.name: field.dataType for field in BENCHMARK_RUN}
    names = next(csv.reader([header]))
    return T.StructType([T.StructField(n, known.get(n, T.StringType())) for n in names])


def read_benchmark_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All benchmark CSV files of a path or glob as one table, matched by column name.

    Files may differ in their columns; those a file lacks are null. One scan is planned per
    distinct header. File names reach the driver only where headers differ, and are no more
    than the listing its planner holds anyway.
    """
    files = _file_headers(spark, path).cache()
    counts = files.groupBy("header").agg(F.count("*").alias("n")).orderBy("header").collect()
    n_unnamed = sum(row.n for row in counts if row.header is None)
    if n_unnamed:
        raise ValueError(f"{n_unnamed} files have no header with model_name")
    if not counts:
        return spark.createDataFrame([], BENCHMARK_RUN)
    if len(counts) == 1:
        parts = [(counts[0].header, path)]
    else:
        names = [
            [row.file for row in files.where(F.col("header") == c.header).orderBy("file").collect()]
            for c in counts
        ]
        parts = [(c.header, paths) for c, paths in zip(counts, names)]
    files.unpersist()
    tables = [
        spark.read.schema(_schema_for(header)).option("header", True).csv(paths)
        for header, paths in parts
    ]
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    numeric = [f.name for f in merged.schema if isinstance(f.dataType, T.DoubleType)]
    return merged.withColumns({name: missing_if_nan(F.col(name)) for name in numeric})


def with_run_time(runs: DataFrame) -> DataFrame:
    """Fill a missing or empty ``timestamp`` with the present time; add it parsed as ``run_time``."""
    now = F.date_format(F.current_timestamp(), RUN_TIMESTAMP_FORMAT)
    stamped = runs.withColumn("timestamp", F.coalesce(F.nullif("timestamp", F.lit("")), now))
    return stamped.withColumn("run_time", F.to_timestamp("timestamp", RUN_TIMESTAMP_FORMAT))


def read_ppl_json(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Perplexity files as ``(model_dir, perplexity, ppl_dataset)``, one JSON object per file.

    A file without a model takes the part of its own name ahead of ``__ppl_``. A file that is
    no complete JSON object fails the query that reads it.
    """
    name_part = F.split(
        F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", ""), "__ppl_", 2
    )
    return (
        spark.read.schema(PERPLEXITY_RESULT)
        .option("multiLine", True)
        .option("mode", "FAILFAST")
        .json(path)
        .select(
            path_basename(F.coalesce("model", F.get(name_part, 0))).alias("model_dir"),
            missing_if_nan(F.col("perplexity")).alias("perplexity"),
            F.col("dataset").alias("ppl_dataset"),
        )
    )


def load_counts(df: DataFrame, source_col: str, file_col: str) -> DataFrame:
    """Rows and distinct files loaded per source."""
    return df.groupBy(F.col(source_col).alias("source")).agg(
        F.count("*").alias("n_rows"),
        F.count_distinct(file_col).alias("n_files"),
    )
