"""Registered queries: names, filters, joins, pivots and point sets over benchmark runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitledger.catalog.bindings import bind, cte
from bitledger.catalog.common import BASENAME, LABEL_CASE, Query, name_parts, r, rounded
from bitledger.functions import fixed_values as fixed
from bitledger.functions.columns import method_label, path_basename, round_half_up
from bitledger.operators import filters, merge, pivots
from bitledger.plans.results import merge_results

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

_METHOD_SCHEMES = [
    label + scheme
    for label in fixed.PARSED_METHOD_LABELS
    for scheme in ["", " (W3A16)", " (W4A16)", " (W8A16)", " (W8A8)"]
]


def _bench(spark: SparkSession, sf: str) -> DataFrame:
    return merge.with_model_dir(bind(spark, sf, "bench_runs"))


def _ppl(spark: SparkSession, sf: str) -> DataFrame:
    return bind(spark, sf, "ppl_results").select(
        path_basename(F.col("model")).alias("model_dir"),
        "perplexity",
        F.col("dataset").alias("ppl_dataset"),
    )


def _merged(spark: SparkSession, sf: str) -> DataFrame:
    return merge_results(_bench(spark, sf), _ppl(spark, sf))


_P = name_parts("model_dir")
_B = f"SELECT * EXCLUDE (perplexity), {BASENAME.format('model_name')} AS model_dir FROM bench_runs"
_PPL = f"SELECT {BASENAME.format('model')} AS model_dir, perplexity, dataset AS ppl_dataset FROM ppl_results"
# The merged table, with a plain full outer join.
_MERGED = (
    cte("bench_runs", "ppl_results")
    + f", b AS ({_B}), p AS ({_PPL}), j AS (SELECT * EXCLUDE (method) FROM b FULL OUTER JOIN p USING (model_dir)), "
    + f"m0 AS (SELECT *, {_P['model_family']} AS model_family, {_P['method']} AS method, {_P['scheme']} AS scheme FROM j), "
    + f"m AS (SELECT *, {LABEL_CASE.format('method')} AS method_label FROM m0) "
)
_BENCH = cte("bench_runs")
_NAMED = (
    _BENCH
    + f", b AS ({_B}), n0 AS (SELECT * EXCLUDE (method), {_P['model_family']} AS model_family, {_P['method']} AS method, {_P['scheme']} AS scheme FROM b), "
    + f"n AS (SELECT *, {LABEL_CASE.format('method')} AS method_label FROM n0) "
)


# --- projections -------------------------------------------------------------------
def _path_basename(spark, sf):
    return (
        bind(spark, sf, "bench_runs")
        .groupBy("model_name")
        .agg(F.count("*").alias("n"))
        .withColumn("model_dir", path_basename(F.concat("model_name", F.lit("/"))))
    )


QUERIES["path_basename"] = _path_basename
ORACLE["path_basename"] = (
    _BENCH + f"SELECT model_name, COUNT(*) AS n, {BASENAME.format('model_name')} AS model_dir FROM bench_runs GROUP BY model_name"
)


def _parse_model_dir(spark, sf):
    names = _bench(spark, sf).select("model_dir").unionByName(bind(spark, sf, "odd_names"))
    counted = names.groupBy("model_dir").agg(F.count("*").alias("n"))
    return merge.parse_model_dir(counted)


QUERIES["parse_model_dir"] = _parse_model_dir
ORACLE["parse_model_dir"] = (
    cte("bench_runs", "odd_names")
    + f", names AS (SELECT {BASENAME.format('model_name')} AS model_dir FROM bench_runs UNION ALL SELECT model_dir FROM odd_names) "
    + f"SELECT model_dir, COUNT(*) AS n, {_P['model_family']} AS model_family, {_P['method']} AS method, {_P['scheme']} AS scheme FROM names GROUP BY model_dir"
)


def _method_label(spark, sf):
    runs = bind(spark, sf, "bench_runs")
    return (
        runs.groupBy("method")
        .agg(F.count("*").alias("n"))
        .withColumn("method_label", method_label(F.col("method")))
    )


QUERIES["method_label"] = _method_label
ORACLE["method_label"] = (
    _BENCH + f"SELECT method, {LABEL_CASE.format('method')} AS method_label, COUNT(*) AS n FROM bench_runs GROUP BY method"
)


def _method_scheme_label(spark, sf):
    by_dir = _bench(spark, sf).groupBy("model_dir").agg(F.count("*").alias("n"))
    return merge.with_labels(merge.parse_model_dir(by_dir)).select("model_dir", "method_scheme", "n")


QUERIES["method_scheme_label"] = _method_scheme_label
ORACLE["method_scheme_label"] = (
    _NAMED + "SELECT model_dir, CASE WHEN scheme = 'unknown' THEN method_label ELSE method_label || ' (' || scheme || ')' END AS method_scheme, COUNT(*) AS n FROM n GROUP BY ALL"
)


# Negative, very large and infinite numbers.
_EXTREME = "CASE WHEN latency_ms > 60000 THEN CAST('Infinity' AS DOUBLE) WHEN latency_ms > 40000 THEN latency_ms * 1.0e13 ELSE -latency_ms / 7.0e0 END"


def _round_metrics(spark, sf):
    runs = bind(spark, sf, "bench_runs")
    return runs.select(
        "model_name",
        round_half_up(F.col("latency_ms") / 7.0, 1).alias("latency_1"),
        round_half_up(F.col("throughput_tok_per_sec"), 2).alias("throughput_2"),
        round_half_up(F.col("peak_memory_mb"), 0).alias("memory_0"),
        round_half_up(F.col("throughput_tok_per_sec"), 4).alias("throughput_4"),
        round_half_up(F.expr(_EXTREME), 2).alias("extreme_2"),
    )


QUERIES["round_metrics"] = _round_metrics
ORACLE["round_metrics"] = (
    _BENCH
    + f"SELECT model_name, {r('latency_ms / 7.0e0', 1)} AS latency_1, {r('throughput_tok_per_sec', 2)} AS throughput_2, "
    + f"{r('peak_memory_mb', 0)} AS memory_0, {r('throughput_tok_per_sec', 4)} AS throughput_4, {r(_EXTREME, 2)} AS extreme_2 FROM bench_runs"
)


def _drop_and_derive(spark, sf):
    bench, ppl = _bench(spark, sf), _ppl(spark, sf)
    derived = merge.drop_and_derive(merge.drop_recorded_perplexity(bench, ppl))
    return derived.select("model_name", "model_family", "method", "scheme", "latency_ms")


QUERIES["drop_and_derive"] = _drop_and_derive
ORACLE["drop_and_derive"] = _NAMED + "SELECT model_name, model_family, method, scheme, latency_ms FROM n"


# --- filters -----------------------------------------------------------------------
def _dropna_metric(spark, sf):
    runs = filters.dropna_metric(bind(spark, sf, "bench_runs"), ["peak_memory_mb", "latency_ms"])
    return runs.select("model_name", "hardware", "latency_ms", "peak_memory_mb")


QUERIES["dropna_metric"] = _dropna_metric
ORACLE["dropna_metric"] = (
    _BENCH + "SELECT model_name, hardware, latency_ms, peak_memory_mb FROM bench_runs WHERE peak_memory_mb IS NOT NULL AND latency_ms IS NOT NULL"
)


def _filter_by_substring(spark, sf):
    kept, _ = filters.filter_by_substring(bind(spark, sf, "bench_runs"), "model_name", "instruct")
    return kept.select("model_name", "latency_ms")


def _filter_by_substring_skipped(spark, sf):
    return filters.filter_by_substring(bind(spark, sf, "bench_runs"), "model_name", "instruct")[1]


QUERIES["filter_by_substring"] = _filter_by_substring
ORACLE["filter_by_substring"] = (
    _BENCH + "SELECT model_name, latency_ms FROM bench_runs WHERE contains(model_name, 'instruct')"
)
QUERIES["filter_by_substring_skipped"] = _filter_by_substring_skipped
ORACLE["filter_by_substring_skipped"] = (
    _BENCH + "SELECT COUNT(*) AS n_skipped FROM bench_runs WHERE NOT contains(model_name, 'instruct')"
)


# --- joins -------------------------------------------------------------------------
def _join_bench_ppl(spark, sf):
    merged = merge.join_bench_ppl(_bench(spark, sf), _ppl(spark, sf))
    return merged.select("model_dir", "hardware", "latency_ms", "perplexity", "ppl_dataset")


QUERIES["join_bench_ppl"] = _join_bench_ppl
ORACLE["join_bench_ppl"] = _MERGED + "SELECT model_dir, hardware, latency_ms, perplexity, ppl_dataset FROM m"


# --- aggregates and pivots ---------------------------------------------------------
def _summary(spark, sf):
    summary = pivots.summary_by_hardware_method(bind(spark, sf, "bench_runs"))
    return rounded(summary, 2, "latency_ms", "throughput", "memory_mb", "perplexity")


QUERIES["summary_by_hardware_method"] = _summary
ORACLE["summary_by_hardware_method"] = (
    _BENCH
    + f"SELECT hardware, method, {r('AVG(latency_ms)', 2)} AS latency_ms, {r('AVG(throughput_tok_per_sec)', 2)} AS throughput, "
    + f"{r('AVG(peak_memory_mb)', 2)} AS memory_mb, {r('AVG(perplexity)', 2)} AS perplexity FROM bench_runs GROUP BY hardware, method"
)


def _pivot_sql(row: str, col: str, metric: str, values: list[str], source: str, digits: int) -> str:
    cells = ", ".join(
        f"{r(f'AVG(CASE WHEN {col} = {chr(39)}{v}{chr(39)} THEN {metric} END)', digits)} AS \"{v}\"" for v in values
    )
    return f"SELECT {row}, {cells} FROM {source} WHERE {metric} IS NOT NULL GROUP BY {row}"


def _merged_pivot(spark: SparkSession, sf: str, metric: str, digits: int) -> DataFrame:
    table = pivots.pivot_merged(
        _bench(spark, sf), _ppl(spark, sf), metric, "method_label", fixed.PARSED_METHOD_LABELS
    )
    return rounded(table, digits, *fixed.PARSED_METHOD_LABELS)


def _pivot_latency(spark, sf):
    return _merged_pivot(spark, sf, "latency_ms", 4)


def _pivot_throughput(spark, sf):
    return _merged_pivot(spark, sf, "throughput_tok_per_sec", 6)


def _pivot_throughput_by_model(spark, sf):
    table = pivots.pivot_metric(
        bind(spark, sf, "bench_runs"), "throughput_tok_per_sec", "model_name", "method",
        fixed.RECORDED_METHODS,
    )
    return rounded(table, 6, *fixed.RECORDED_METHODS)


def _pivot_perplexity(spark, sf):
    table = pivots.pivot_perplexity(_bench(spark, sf), _ppl(spark, sf), _METHOD_SCHEMES)
    return rounded(table, 8, *_METHOD_SCHEMES)


QUERIES["pivot_latency"] = _pivot_latency
ORACLE["pivot_latency"] = _MERGED + _pivot_sql(
    "model_family", "method_label", "latency_ms", fixed.PARSED_METHOD_LABELS, "m", 4
)
QUERIES["pivot_throughput"] = _pivot_throughput
ORACLE["pivot_throughput"] = _MERGED + _pivot_sql(
    "model_family", "method_label", "throughput_tok_per_sec", fixed.PARSED_METHOD_LABELS, "m", 6
)
QUERIES["pivot_throughput_by_model"] = _pivot_throughput_by_model
ORACLE["pivot_throughput_by_model"] = _BENCH + _pivot_sql(
    "model_name", "method", "throughput_tok_per_sec", fixed.RECORDED_METHODS, "bench_runs", 6
)
QUERIES["pivot_perplexity"] = _pivot_perplexity
ORACLE["pivot_perplexity"] = _MERGED + _pivot_sql(
    "model_family",
    "(CASE WHEN scheme = 'unknown' THEN method_label ELSE method_label || ' (' || scheme || ')' END)",
    "perplexity", _METHOD_SCHEMES, "m", 8,
)


# The complete results in long form, whatever methods and schemes there are.
_SCHEME_LABEL = "(CASE WHEN scheme = 'unknown' THEN method_label ELSE method_label || ' (' || scheme || ')' END)"


def _mean_perplexity(spark, sf):
    means = pivots.merged_mean_by(_bench(spark, sf), _ppl(spark, sf), "perplexity", "method_scheme")
    return rounded(means, 8, "mean")


def _mean_throughput_by_model(spark, sf):
    means = pivots.mean_by(bind(spark, sf, "bench_runs"), "throughput_tok_per_sec", "model_name", "method")
    return rounded(means, 6, "mean")


QUERIES["mean_perplexity"] = _mean_perplexity
ORACLE["mean_perplexity"] = (
    _MERGED + f"SELECT model_family, {_SCHEME_LABEL} AS method_scheme, {r('AVG(perplexity)', 8)} AS mean FROM m WHERE perplexity IS NOT NULL GROUP BY ALL"
)
QUERIES["mean_throughput_by_model"] = _mean_throughput_by_model
ORACLE["mean_throughput_by_model"] = (
    _BENCH + f"SELECT model_name, method, {r('AVG(throughput_tok_per_sec)', 6)} AS mean FROM bench_runs WHERE throughput_tok_per_sec IS NOT NULL GROUP BY ALL"
)


def _points(spark, sf):
    families = pivots.complete_families(_bench(spark, sf), _ppl(spark, sf))
    return pivots.memory_perplexity_points(_merged(spark, sf), families)


QUERIES["memory_perplexity_points"] = _points
ORACLE["memory_perplexity_points"] = (
    _MERGED
    + ", k AS (SELECT *, DENSE_RANK() OVER (ORDER BY model_family) - 1 AS family_rank FROM m WHERE peak_memory_mb IS NOT NULL AND perplexity IS NOT NULL) "
    + "SELECT model_family, method_label, family_rank, family_rank % 7 AS marker, model_family || ' / ' || method_label AS point_label, peak_memory_mb, perplexity FROM k"
)


def _points_by_method(spark, sf):
    return pivots.memory_perplexity_by_method(bind(spark, sf, "bench_runs"))


QUERIES["memory_perplexity_by_method"] = _points_by_method
ORACLE["memory_perplexity_by_method"] = (
    _BENCH
    + ", k AS (SELECT *, DENSE_RANK() OVER (ORDER BY method) - 1 AS method_rank FROM bench_runs) "
    + "SELECT method, method_rank, method_rank % 5 AS marker, peak_memory_mb, perplexity FROM k"
)


def _latency_rank(spark, sf):
    return pivots.latency_rank_by_hardware(bind(spark, sf, "bench_runs"))


QUERIES["latency_rank_by_hardware"] = _latency_rank
ORACLE["latency_rank_by_hardware"] = (
    _BENCH
    + "SELECT hardware, latency_ms, method, model_name, ROW_NUMBER() OVER (PARTITION BY hardware ORDER BY latency_ms, method, model_name) AS latency_rank FROM bench_runs"
)
