"""Means, pivots and point sets over benchmark runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitledger.operators.filters import dropna_metric, present
from bitledger.operators.merge import drop_and_derive, merged_sums, parse_model_dir, with_labels
from bitledger.operators.prefix import number_rows, rank_of_values


def _mean(metric: str) -> Column:
    return F.try_divide(F.sum(f"{metric}_sum"), F.sum(f"{metric}_n"))


def _listed(col: str, values: list[str] | None) -> Column:
    """True for listed values; any other value fails the query instead of vanishing from it."""
    if values is None:
        return F.lit(True)
    shown = F.concat(F.lit(f"{col} has a value that is not listed: "), F.col(col).cast("string"))
    return F.when(F.col(col).isin(values), F.lit(True)).otherwise(F.raise_error(shown).cast("boolean"))


def pivot_metric(
    df: DataFrame, metric: str, row: str, col: str, values: list[str] | None = None
) -> DataFrame:
    """Mean of ``metric`` with one line per ``row`` value and one column per ``col`` value.

    With ``values`` the plan is one pass and the schema is fixed, and a value outside the list
    is an error; without, Spark looks the values up first. ``mean_by`` is the long form.
    """
    means = mean_by(df, metric, row, col).where(_listed(col, values))
    return means.groupBy(row).pivot(col, values).agg(F.first("mean"))


def mean_by(df: DataFrame, metric: str, row: str, col: str) -> DataFrame:
    """Mean of ``metric`` as ``(row, col, mean)``, whatever values there are."""
    kept = present(dropna_metric(df, [metric]), [row, col])
    return kept.groupBy(row, col).agg(F.avg(metric).alias("mean"))


def merged_mean_by(bench: DataFrame, ppl: DataFrame, metric: str, col: str) -> DataFrame:
    """Mean of a metric over the merged rows as ``(model_family, col, mean)``.

    A run counts once per result of its directory and a result once per run of it, but their
    product is never built: the mean comes from sums per directory. Keys read from a name are
    never missing.
    """
    metrics = [] if metric == "perplexity" else [metric]
    named = with_labels(drop_and_derive(merged_sums(bench, ppl, [], metrics), one_row_per_name=True))
    found = named.groupBy("model_family", col).agg(_mean(metric).alias("mean"))
    return found.where(F.col("mean").isNotNull())


def pivot_merged(
    bench: DataFrame, ppl: DataFrame, metric: str, col: str, values: list[str] | None = None
) -> DataFrame:
    """:func:`merged_mean_by` with one line per family and one column per value."""
    means = merged_mean_by(bench, ppl, metric, col).where(_listed(col, values))
    return means.groupBy("model_family").pivot(col, values).agg(F.first("mean"))


def pivot_perplexity(
    bench: DataFrame, ppl: DataFrame, values: list[str] | None = None
) -> DataFrame:
    """Mean perplexity over the merged rows, model family by ``label (scheme)``."""
    return pivot_merged(bench, ppl, "perplexity", "method_scheme", values)


def summary_by_hardware_method(bench: DataFrame) -> DataFrame:
    """Means of latency, throughput, memory and recorded perplexity per hardware and recorded method."""
    return present(bench, ["hardware", "method"]).groupBy("hardware", "method").agg(
        F.avg("latency_ms").alias("latency_ms"),
        F.avg("throughput_tok_per_sec").alias("throughput"),
        F.avg("peak_memory_mb").alias("memory_mb"),
        F.avg("perplexity").alias("perplexity"),
    )


def complete_families(bench: DataFrame, ppl: DataFrame) -> DataFrame:
    """Families with a complete point, from directories alone: those with a memory value and a result."""
    measured = bench.where(F.col("peak_memory_mb").isNotNull()).select("model_dir").distinct()
    rated = ppl.where(F.col("perplexity").isNotNull()).select("model_dir").distinct()
    return parse_model_dir(measured.join(rated, "model_dir", "left_semi")).select("model_family").distinct()


def memory_perplexity_points(merged: DataFrame, families: DataFrame | None = None) -> DataFrame:
    """Points (memory, perplexity) with the label and marker of their group.

    Groups are ranked over ``families`` (see :func:`complete_families`), else over the points.

    ``family_rank`` and ``method_label`` give the order of the groups; seven markers repeat
    over the families.
    """
    points = with_labels(dropna_metric(merged, ["peak_memory_mb", "perplexity"]))
    ranked = rank_of_values(points, "model_family", "family_rank", families)
    return ranked.select(
        "model_family",
        "method_label",
        "family_rank",
        (F.col("family_rank") % 7).alias("marker"),
        F.concat("model_family", F.lit(" / "), "method_label").alias("point_label"),
        "peak_memory_mb",
        "perplexity",
    )


def memory_perplexity_by_method(bench: DataFrame) -> DataFrame:
    """Memory and recorded perplexity of the runs, grouped by recorded method only, five markers.

    Incomplete points stay in; runs without a method belong to no group.
    """
    ranked = rank_of_values(bench, "method", "method_rank")
    return ranked.select(
        "method",
        "method_rank",
        (F.col("method_rank") % 5).alias("marker"),
        "peak_memory_mb",
        "perplexity",
    )


def latency_rank_by_hardware(bench: DataFrame) -> DataFrame:
    """Runs of each hardware ranked by latency, fastest first; ties by the other columns."""
    runs = present(bench, ["hardware"]).select("hardware", "latency_ms", "method", "model_name")
    return number_rows(runs, ["hardware"], ["latency_ms"], "latency_rank")
