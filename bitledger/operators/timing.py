"""Statistics over repeated timed runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def number_iterations(runs: DataFrame, order_col: str, first: int) -> DataFrame:
    """Number the runs of each group from 1 and keep the first ``first``.

    The bound reaches the window, so each task forwards at most ``first`` runs per group.
    """
    order = Window.partitionBy("run_group").orderBy(order_col)
    return runs.withColumn("iteration", F.row_number().over(order)).where(
        F.col("iteration") <= first
    )


def _timed(runs: DataFrame, warmup: int, timed: int) -> DataFrame:
    return runs.where((F.col("iteration") > warmup) & (F.col("iteration") <= warmup + timed))


def timing_stats(
    runs: DataFrame, output_len: int = 64, warmup: int = 2, timed: int = 5
) -> DataFrame:
    """Mean, population deviation and throughput of the runs after warm-up."""
    mean = F.avg("latency_ms")
    return (
        _timed(runs, warmup, timed)
        .groupBy("run_group")
        .agg(
            F.count("*").alias("n_runs"),
            mean.alias("latency_ms"),
            F.stddev_pop("latency_ms").alias("latency_std_ms"),
            F.try_divide(F.lit(float(output_len)), mean / 1000.0).alias("throughput_tok_per_sec"),
        )
    )


def timing_stats_batched(
    runs: DataFrame,
    output_len: int = 128,
    batch_size: int = 1,
    warmup: int = 3,
    timed: int = 10,
) -> DataFrame:
    """Elapsed time per run, throughput over the whole batch and peak memory after warm-up."""
    per_run = F.sum("latency_ms") / F.count("*")
    return (
        _timed(runs, warmup, timed)
        .groupBy("run_group")
        .agg(
            F.count("*").alias("n_runs"),
            per_run.alias("latency_ms"),
            F.try_divide(F.lit(float(output_len * batch_size)), per_run / 1000.0).alias(
                "throughput_tok_per_sec"
            ),
            (F.max("memory_bytes") / F.lit(1024.0 * 1024.0)).alias("peak_memory_mb"),
        )
    )
