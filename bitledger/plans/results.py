"""From result files to the merged table and its charts' input tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from bitledger.operators.merge import drop_and_derive, join_and_derive, with_model_dir
from bitledger.schemas import BENCHMARK_RUN
from bitledger.sources.runs import read_benchmark_csv, read_ppl_json


def merge_results(
    bench: DataFrame | None, ppl: DataFrame | None, prefer_recorded_method: bool = False
) -> DataFrame:
    """Runs and perplexities in one table with family, method and scheme; either may be absent."""
    if bench is None and ppl is None:
        raise ValueError("neither benchmark runs nor perplexity results were given")
    if bench is not None and "model_dir" not in bench.columns:
        bench = with_model_dir(bench)
    if bench is not None and ppl is not None:
        return join_and_derive(bench, ppl, prefer_recorded_method)
    return drop_and_derive(ppl if bench is None else bench, prefer_recorded_method)


def _if_any(
    read: Callable[[SparkSession, str], DataFrame], spark: SparkSession, path: str | None
) -> DataFrame | None:
    """What ``read`` finds at a path; None where no file matches it."""
    if not path:
        return None
    try:
        return read(spark, path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def load_results(
    spark: SparkSession,
    benchmark_glob: str | None = "./results/benchmark_*.csv",
    ppl_glob: str | None = "./results/eval/*__ppl_*.json",
) -> DataFrame:
    """Read both kinds of result files and merge them. Edge-device runs need their own glob.

    Where one kind has no files the other is loaded alone; without any there are no rows.
    """
    bench = _if_any(read_benchmark_csv, spark, benchmark_glob)
    ppl = _if_any(read_ppl_json, spark, ppl_glob)
    if bench is None and ppl is None:
        bench = spark.createDataFrame([], BENCHMARK_RUN)
    return merge_results(bench, ppl)
