"""Registered queries: sources and sinks, by writing whole tables and reading them back.

Files go to the folder the cluster names for checkpoints.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitledger.catalog import accuracy as accuracy_queries
from bitledger.catalog import engine as engine_queries
from bitledger.catalog.bindings import bind, cte
from bitledger.catalog.common import BASENAME, Query
from bitledger.functions import fixed_values as fixed
from bitledger.plans.accuracy_tables import METHOD_TABLE_COLUMNS
from bitledger.session import scratch_path
from bitledger.sinks import reports, tables
from bitledger.sources import corpus, evaluations, runs
from bitledger.operators.accuracy import with_stderr_rows

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

_RUN_COLUMNS = [
    "model_name", "method", "hardware", "input_length", "output_length", "batch_size",
    "latency_ms", "throughput_tok_per_sec", "peak_memory_mb", "perplexity", "timestamp",
]
_RUNS = cte("bench_runs") + ", runs AS (SELECT * RENAME (run_ts AS timestamp) FROM bench_runs) "
_SELECT = ", ".join(_RUN_COLUMNS)


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    return bind(spark, sf, "bench_runs").withColumnRenamed("run_ts", "timestamp").select(*_RUN_COLUMNS)


# --- sources -----------------------------------------------------------------------
def _read_benchmark_csv(spark, sf):
    """Runs in two folders; the files of one lack two columns and order the rest differently."""
    path = scratch_path(spark, "runs")
    all_runs = _runs(spark, sf)
    edge = F.col("hardware") == "Jetson"
    tables.write_results_csv(all_runs.where(~edge), f"{path}/a")
    tables.write_results_csv(
        all_runs.where(edge).select("latency_ms", *[c for c in _RUN_COLUMNS if c not in {"latency_ms", "peak_memory_mb", "batch_size"}]),
        f"{path}/b",
    )
    return runs.read_benchmark_csv(spark, f"{path}/*")


QUERIES["read_benchmark_csv"] = _read_benchmark_csv
ORACLE["read_benchmark_csv"] = (
    _RUNS + "SELECT * REPLACE (CASE WHEN hardware <> 'Jetson' THEN peak_memory_mb END AS peak_memory_mb, CASE WHEN hardware <> 'Jetson' THEN batch_size END AS batch_size) FROM runs"
)


def _read_ppl_json(spark, sf):
    path = scratch_path(spark, "ppl")
    bind(spark, sf, "ppl_results").write.option("maxRecordsPerFile", 1).json(path)
    return runs.read_ppl_json(spark, path)


QUERIES["read_ppl_json"] = _read_ppl_json
ORACLE["read_ppl_json"] = (
    cte("ppl_results") + f"SELECT {BASENAME.format('model')} AS model_dir, perplexity, dataset AS ppl_dataset FROM ppl_results"
)


def _eval_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Result files as JSON documents. A file holds the metrics of at most eight tasks."""
    rows = with_stderr_rows(bind(spark, sf, "eval_files"))
    tasks = rows.groupBy("file_name", "task").agg(
        F.map_from_entries(F.collect_list(F.struct("metric_key", "value"))).alias("metrics")
    )
    return tasks.groupBy("file_name").agg(
        F.map_from_entries(F.collect_list(F.struct("task", "metrics"))).alias("results")
    )


def _read_eval_results(spark, sf):
    path = scratch_path(spark, "eval")
    documents = _eval_documents(spark, sf).select("results")
    documents.write.option("maxRecordsPerFile", 1).json(path)
    return evaluations.read_eval_results(spark, path).select("task", "metric_key", "value")


QUERIES["read_eval_results"] = _read_eval_results
ORACLE["read_eval_results"] = (
    cte("eval_files")
    + "SELECT task, metric_key, value FROM eval_files UNION ALL SELECT task, replace(metric_key, ',', '_stderr,'), stderr FROM eval_files"
)


def _json_texts(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(
        "SELECT 'r' || CAST(o_orderkey AS STRING) || '.json' AS file_name, "
        "substr(text, 1, CASE WHEN o_orderstatus = 'P' THEN o_custkey % 12 ELSE 100 END) AS text FROM "
        "(SELECT *, '{{\"results\": ' || CAST(o_orderkey AS STRING) || '}}' AS text FROM {orders}) t",
        orders=spark.read.parquet(f"{sf}/orders.parquet"),
    )


def _valid_results(spark, sf):
    valid, corrupt = evaluations.valid_results(_json_texts(spark, sf))
    return valid.withColumn("valid", F.lit(True)).unionByName(
        corrupt.withColumn("valid", F.lit(False))
    )


QUERIES["valid_results"] = _valid_results
ORACLE["valid_results"] = (
    "SELECT 'r' || CAST(o_orderkey AS VARCHAR) || '.json' AS file_name, json_valid(substr('{\"results\": ' || CAST(o_orderkey AS VARCHAR) || '}', 1, CASE WHEN o_orderstatus = 'P' THEN o_custkey % 12 ELSE 100 END)) AS valid FROM orders"
)


def _load_counts(spark, sf):
    bench = bind(spark, sf, "bench_runs").select(F.lit("benchmark").alias("kind"), F.col("model_name").alias("file"))
    ppl = bind(spark, sf, "ppl_results").select(F.lit("perplexity").alias("kind"), F.col("model").alias("file"))
    return runs.load_counts(bench.unionByName(ppl), "kind", "file")


QUERIES["load_counts"] = _load_counts
ORACLE["load_counts"] = (
    cte("bench_runs", "ppl_results")
    + "SELECT 'benchmark' AS source, COUNT(*) AS n_rows, COUNT(DISTINCT model_name) AS n_files FROM bench_runs UNION ALL SELECT 'perplexity', COUNT(*), COUNT(DISTINCT model) FROM ppl_results"
)


def _file_inventory(spark, sf):
    """Files of the texts written by language: each takes its bytes and one line end a text."""
    path = scratch_path(spark, "texts")
    texts = spark.read.parquet(f"{sf}/documents.parquet").where("text IS NOT NULL")
    texts.select("lang", "text").write.partitionBy("lang").text(path)
    files = corpus.file_inventory(spark, path, "part-*")
    return files.groupBy("lang").agg((F.sum("size_mb") * 1048576.0).cast("bigint").alias("n_bytes"))


QUERIES["file_inventory"] = _file_inventory
ORACLE["file_inventory"] = (
    "SELECT lang, CAST(SUM(strlen(text) + 1) AS BIGINT) AS n_bytes FROM documents WHERE text IS NOT NULL GROUP BY lang"
)


# --- sinks -------------------------------------------------------------------------
def _write_results_csv(spark, sf):
    path = scratch_path(spark, "csv")
    tables.write_results_csv(_runs(spark, sf), path)
    return runs.read_benchmark_csv(spark, path)


QUERIES["write_results_csv"] = _write_results_csv
ORACLE["write_results_csv"] = _RUNS + f"SELECT {_SELECT} FROM runs"


def _append_summary_csv(spark, sf):
    path = scratch_path(spark, "append")
    all_runs = _runs(spark, sf)
    for hardware in ["CPU", "Jetson", "RTX 3090"]:
        tables.append_summary_csv(all_runs.where(F.col("hardware") == hardware), path)
    return runs.read_benchmark_csv(spark, path)


QUERIES["append_summary_csv"] = _append_summary_csv
ORACLE["append_summary_csv"] = ORACLE["write_results_csv"]


def _append_once(spark, sf):
    """Runs appended by hardware, each twice, as a job that is run again does."""
    path = scratch_path(spark, "append-once")
    all_runs = _runs(spark, sf)
    for hardware in ["CPU", "Jetson", "RTX 3090", "CPU", "Jetson", "RTX 3090"]:
        tables.append_once(all_runs.where(F.col("hardware") == hardware), path, f"runs on {hardware}")
    return tables.read_appended(spark, path, all_runs.schema)


QUERIES["append_once"] = _append_once
ORACLE["append_once"] = ORACLE["write_results_csv"]


def _write_results_json(spark, sf):
    path = scratch_path(spark, "json")
    written = _runs(spark, sf)
    tables.write_results_json(written, path)
    return spark.read.schema(written.schema).json(path)


QUERIES["write_results_json"] = _write_results_json
ORACLE["write_results_json"] = ORACLE["write_results_csv"]


def _write_table_csv(spark, sf):
    path = scratch_path(spark, "table")
    table = accuracy_queries.method_table(spark, sf)
    tables.write_table_csv(table, [*METHOD_TABLE_COLUMNS, "remark"], path, one_file=True)
    columns = "method_label STRING, method STRING, avg DOUBLE, delta_vs_fp16_pp DOUBLE, _status STRING, remark STRING"
    schema = ", ".join(
        f"`{c}` DOUBLE" if c in {"avg", "delta_vs_fp16_pp"} else f"`{c}` STRING"
        for c in [*METHOD_TABLE_COLUMNS, "remark"]
    )
    back = spark.read.schema(schema).option("header", True).csv(path)
    return back.select(*[c.split()[0] for c in columns.split(", ")])


QUERIES["write_table_csv"] = _write_table_csv
ORACLE["write_table_csv"] = (
    f"SELECT method_label, method, avg, delta_vs_fp16_pp, _status, CAST(NULL AS VARCHAR) AS remark FROM ({accuracy_queries.METHOD_TABLE_SQL})"
)


# --- reports -----------------------------------------------------------------------
def _num(value: str, digits: int) -> str:
    return f"printf('%.{digits}f', FLOOR({value} * {10**digits}.0e0 + 0.5e0) / {10**digits}.0e0)"


def _pad(text: str, width: int, side: str) -> str:
    return f"{side}({text}, CAST(GREATEST({width}, length({text})) AS INTEGER), ' ')"


def _format_report(spark, sf):
    return reports.accuracy_lines(
        accuracy_queries.method_table(spark, sf), {"method": 14, "bits": 8}, "delta_vs_fp16_pp"
    )


_CELLS = [_pad("method", 14, "rpad"), _pad("bits", 8, "rpad")]
_CELLS += [f"COALESCE({_pad(_num(t, 4), 9, 'lpad')}, '        -')" for t in [*fixed.TASKS, "avg"]]
_DELTA = f"(CASE WHEN delta_vs_fp16_pp >= 0 THEN '+' ELSE '' END || {_num('delta_vs_fp16_pp', 2)})"
_CELLS.append(f"COALESCE({_pad(_DELTA, 10, 'lpad')} || 'pp', '          -')")
_CELLS.append(_pad("_status", 14, "lpad"))
QUERIES["format_report"] = _format_report
ORACLE["format_report"] = (
    f"SELECT ord, {' || '.join(_CELLS)} AS line FROM ({accuracy_queries.METHOD_TABLE_SQL})"
)


def _format_report_runs(spark, sf):
    """All runs; about half report memory, and half have a perplexity."""
    with_ppl = _runs(spark, sf).withColumn(
        "perplexity", F.expr("CASE WHEN latency_ms > 50000 THEN latency_ms / 10000 ELSE 0 END")
    )
    return reports.run_lines(with_ppl, ["timestamp"])


QUERIES["format_report_runs"] = _format_report_runs
ORACLE["format_report_runs"] = (
    _RUNS
    + f"SELECT timestamp, {_pad('method', 12, 'rpad')} || ' ' || {_pad(_num('latency_ms', 1), 14, 'rpad')} || ' ' || {_pad(_num('throughput_tok_per_sec', 1), 14, 'rpad')} || ' ' || COALESCE({_pad(_num('peak_memory_mb', 1), 12, 'rpad')}, '-           ') || ' ' || "
    + f"CASE WHEN latency_ms > 50000 THEN {_num('(latency_ms / 10000)', 2)} ELSE 'N/A' END AS line FROM runs"
)
QUERIES["format_report_engine"] = lambda spark, sf: reports.engine_lines(
    engine_queries.performance(spark, sf)
)
_ENGINE_TEXTS = [
    "label",
    f"{_num('prompt_eval_tok_s', 2)} || ' ± ' || {_num('prompt_eval_std', 2)} || ' tok/s'",
    f"{_num('generation_tok_s', 2)} || ' ± ' || {_num('generation_std', 2)} || ' tok/s'",
    f"{_num('latency_total_ms', 1)} || ' ms'",
    f"{_num('throughput_overall_tok_s', 2)} || ' tok/s'",
    "CAST(peak_ram_mb AS VARCHAR) || ' MB  (Δ ' || CAST(ram_delta_mb AS VARCHAR) || ' MB)'",
    f"{_num('avg_power_mw', 0)} || ' mW  (' || CAST(n_samples AS VARCHAR) || ' samples)'",
    f"{_num('avg_gpu_util_pct', 1)} || ' %'",
    f"{_num('energy_per_token_mj', 2)} || ' mJ'",
    f"{_num('speedup_vs_hf_fp16', 2)} || 'x  (HF baseline = 11.5 tok/s)'",
]
ORACLE["format_report_engine"] = " UNION ALL ".join(
    f"SELECT label, {i} AS ord, '  {title:<{fixed.ENGINE_REPORT_WIDTH}}: ' || {text} AS line FROM ({engine_queries.RATES_SQL}{engine_queries.PERFORMANCE_SQL})"
    for i, (title, text) in enumerate(zip(fixed.ENGINE_REPORT_TITLES, _ENGINE_TEXTS))
)
