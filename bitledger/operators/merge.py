"""Joining benchmark runs with perplexity results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitledger.functions.columns import (
    family_and_method,
    method_label,
    method_scheme_label,
    model_scheme,
    path_basename,
)


# What a missing model name is called; directory names and what is read from them are never null.
NO_NAME = "nan"


def with_model_dir(df: DataFrame, col: str = "model_name") -> DataFrame:
    return df.withColumn("model_dir", F.coalesce(path_basename(F.col(col)), F.lit(NO_NAME)))


def parse_model_dir(df: DataFrame, col: str = "model_dir") -> DataFrame:
    """Family, method and scheme read from a model directory's name.

    Results cannot be null: the planner would push null tests on them, which joins imply,
    down to the scan and parse every name there again.
    """
    name = F.coalesce(F.col(col), F.lit(NO_NAME))
    return (
        df.withColumn("_parsed", family_and_method(name))
        .withColumns(
            {
                "model_family": F.coalesce("_parsed.model_family", F.lit(NO_NAME)),
                "method": F.coalesce("_parsed.method", F.lit("unknown")),
                "scheme": model_scheme(name),
            }
        )
        .drop("_parsed")
    )


def drop_recorded_perplexity(bench: DataFrame, ppl: DataFrame) -> DataFrame:
    """Benchmark rows without their own perplexity, which the perplexity results replace.

    It is kept when there are no perplexity results at all: a scalar subquery looks for one.
    """
    if "perplexity" not in bench.columns:
        return bench
    any_result = ppl.select(F.lit(1).alias("one")).limit(1).agg(F.count("*")).scalar()
    own = F.when(any_result == 0, F.col("perplexity"))
    return bench.withColumn("_own_perplexity", own).drop("perplexity")


def _parsed_names(dirs: DataFrame) -> DataFrame:
    """Each directory once, parsed.

    The parsed text depends on an aggregate's result (a count, which hashes) and not on its
    key alone: filters on the parsed columns therefore stay above the aggregate and do not
    parse the name of every row.
    """
    counted = dirs.groupBy("model_dir").agg(F.count("*").alias("_n"))
    named = counted.withColumn("_name", F.when(F.col("_n") > 0, F.col("model_dir")))
    return parse_model_dir(named, "_name").drop("_n", "_name")


def _unite(
    bench: DataFrame, results: DataFrame, bench_dirs: DataFrame, how: str
) -> DataFrame:
    """Runs with their results, then the results of directories without a run."""
    matched = bench.join(results, "model_dir", how)
    alone = results.join(bench_dirs, "model_dir", "left_anti")
    merged = matched.unionByName(alone, allowMissingColumns=True)
    if "_own_perplexity" not in merged.columns:
        return merged
    own = F.coalesce("perplexity", "_own_perplexity")
    return merged.withColumn("perplexity", own).drop("_own_perplexity")


def join_bench_ppl(bench: DataFrame, ppl: DataFrame) -> DataFrame:
    """Full outer join on ``model_dir``, many to many.

    Written as a left join plus the perplexity rows without a run: unlike a full outer
    join, a left join can split a hot directory or broadcast a small side, and the second
    branch sees only the distinct directories of the runs.
    """
    bench_dirs = bench.select("model_dir").distinct()
    return _unite(drop_recorded_perplexity(bench, ppl), ppl, bench_dirs, "left")


def join_and_derive(
    bench: DataFrame, ppl: DataFrame, prefer_recorded_method: bool = False
) -> DataFrame:
    """:func:`join_bench_ppl` with the names parsed: ``drop_and_derive`` in the same join.

    Names are parsed once per directory and joined with the results there, where both are
    small; the runs then meet names and results in one join.
    """
    bench_dirs = bench.select("model_dir").distinct()
    names = _parsed_names(bench_dirs.union(ppl.select("model_dir")))
    named_results = names.join(ppl, "model_dir", "left")
    runs = _set_aside_recorded(drop_recorded_perplexity(bench, ppl))
    merged = _unite(runs, named_results, bench_dirs, "inner")
    return _settle_method(merged, prefer_recorded_method)


def _set_aside_recorded(df: DataFrame) -> DataFrame:
    if "method" in df.columns:
        df = df.withColumnRenamed("method", "_recorded")
    return df.drop("model_family", "scheme")


def _settle_method(df: DataFrame, prefer_recorded: bool) -> DataFrame:
    if prefer_recorded and "_recorded" in df.columns:
        df = df.withColumn("method", F.coalesce("_recorded", "method"))
    return df.drop("_recorded")


def drop_and_derive(
    df: DataFrame, prefer_recorded_method: bool = False, one_row_per_name: bool = False
) -> DataFrame:
    """Replace family, method and scheme by those read from the directory name.

    A run recorded as ``fp16`` whose directory names no method becomes ``unknown``; with
    ``prefer_recorded_method`` the recorded one is kept where there is one. Names are parsed
    once each and joined back, unless the rows are known to be one per name.
    """
    df = _set_aside_recorded(df)
    if one_row_per_name:
        derived = parse_model_dir(df)
    else:
        df = df.withColumn("model_dir", F.coalesce("model_dir", F.lit(NO_NAME)))
        derived = df.join(_parsed_names(df.select("model_dir")), "model_dir")
    return _settle_method(derived, prefer_recorded_method)


def with_labels(df: DataFrame) -> DataFrame:
    """Add ``method_label`` and ``method_scheme`` for display."""
    label = method_label(F.col("method"))
    return df.withColumns(
        {
            "method_label": label,
            "method_scheme": method_scheme_label(label, F.col("scheme")),
        }
    )


def merged_sums(
    bench: DataFrame, ppl: DataFrame, keys: list[str], metrics: list[str]
) -> DataFrame:
    """Sums and counts of metrics over the rows of the bench/perplexity join, not joined row by row.

    Runs are added up per ``(keys, model_dir)`` and perplexities per ``model_dir`` before
    they meet, so the many-to-many product of a hot directory is never built: a run counts
    once per perplexity row of its directory, and the other way round. Columns are
    ``<metric>_sum`` and ``<metric>_n``, and the same for ``perplexity``.
    """
    run_aggs = [F.count("*").alias("_runs")]
    for m in metrics:
        run_aggs += [F.sum(m).alias(f"{m}_sum"), F.count(m).alias(f"{m}_n")]
    runs = bench.groupBy(*keys, "model_dir").agg(*run_aggs)
    results = ppl.groupBy("model_dir").agg(
        F.count("*").alias("_results"),
        F.sum("perplexity").alias("perplexity_sum"),
        F.count("perplexity").alias("perplexity_n"),
    )
    joined = runs.join(results, "model_dir", "full")
    times_run = F.coalesce("_runs", F.lit(1))
    times_result = F.coalesce("_results", F.lit(1))
    scaled = {
        "perplexity_sum": F.col("perplexity_sum") * times_run,
        "perplexity_n": F.coalesce("perplexity_n", F.lit(0)) * times_run,
    }
    for m in metrics:
        scaled[f"{m}_sum"] = F.col(f"{m}_sum") * times_result
        scaled[f"{m}_n"] = F.coalesce(f"{m}_n", F.lit(0)) * times_result
    return joined.withColumns(scaled).drop("_runs", "_results")
