"""Registered queries: task-accuracy tables and job planning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitledger.catalog import engine as engine_queries
from bitledger.catalog.bindings import bind, cte
from bitledger.catalog.common import Query, r, rounded, values
from bitledger.functions import fixed_values as fixed
from bitledger.functions.columns import metric_key_parts
from bitledger.operators import accuracy, filters, jobs
from bitledger.plans.accuracy_tables import accuracy_by_method, accuracy_by_scheme
from bitledger.session import lookup

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def _metrics(spark: SparkSession, sf: str, binding: str = "eval_files") -> DataFrame:
    return accuracy.with_stderr_rows(bind(spark, sf, binding))


def _labels(spark: SparkSession) -> DataFrame:
    return accuracy.method_dimension(spark)


_KEY = "substr(metric_key, 1, instr(metric_key, ',') - 1)"
_FILTER = "substr(metric_key, instr(metric_key, ',') + 1)"
_METHOD_ROWS = values("d", ["ord", "label", "method", "bits"], [(k, *row) for k, row in enumerate(fixed.METHOD_ROWS)])
_SCHEME_ROWS = values(
    "d", ["ord", "label", "engine"], [(k, s, fixed.SCHEME_ENGINE) for k, s in enumerate(fixed.SCHEME_ROWS)]
)
_CANDIDATES = values(
    "c",
    ["task", "rank", "metric_key"],
    [(task, rank, key) for task, keys in fixed.TASK_METRICS for rank, key in enumerate(keys)],
)


_PART_ORDER = "CASE part " + " ".join(f"WHEN '{p}' THEN {k}" for k, p in enumerate(fixed.PARTS)) + " END"


def _latest_sql(binding: str) -> str:
    return (
        f"latest AS (SELECT label, part, file_name, file_mtime FROM (SELECT DISTINCT label, part, file_name, file_mtime FROM {binding}) "
        "QUALIFY ROW_NUMBER() OVER (PARTITION BY label, part ORDER BY file_mtime DESC, file_name) = 1)"
    )


def _picked_sql(binding: str) -> str:
    """Newest files, parts merged, first present candidate per task."""
    return (
        cte(binding)
        + f", {_latest_sql(binding)}, rows_ AS (SELECT e.* FROM {binding} e JOIN latest USING (label, part, file_name, file_mtime)), "
        + f"merged AS (SELECT * FROM rows_ QUALIFY RANK() OVER (PARTITION BY label, task ORDER BY {_PART_ORDER} DESC) = 1), "
        + f"picked AS (SELECT label, task, metric_key, value, stderr FROM (SELECT m.*, ROW_NUMBER() OVER (PARTITION BY m.label, m.task ORDER BY c.rank) AS k FROM merged m JOIN {_CANDIDATES} ON m.task = c.task AND m.metric_key = c.metric_key) WHERE k = 1) "
    )


# --- keys and labels ---------------------------------------------------------------
def _metric_key_parts(spark, sf):
    parts = metric_key_parts(F.col("metric_key"))
    return bind(spark, sf, "eval_files").select(
        "label", "task", "file_mtime", "metric_key", *[c.alias(n) for n, c in parts.items()]
    )


QUERIES["metric_key_parts"] = _metric_key_parts
ORACLE["metric_key_parts"] = (
    cte("eval_files")
    + f'SELECT label, task, file_mtime, metric_key, {_KEY} AS base, {_FILTER} AS "filter", {_KEY} || \'_stderr,\' || {_FILTER} AS stderr_key FROM eval_files'
)


def _label_to_method_bits(spark, sf):
    counts = bind(spark, sf, "eval_files").groupBy("label").agg(F.count("*").alias("n"))
    return accuracy.with_method_bits(counts, _labels(spark))


QUERIES["label_to_method_bits"] = _label_to_method_bits
ORACLE["label_to_method_bits"] = (
    cte("eval_files") + f"SELECT label, n, method, bits FROM (SELECT label, COUNT(*) AS n FROM eval_files GROUP BY label) e LEFT JOIN {_METHOD_ROWS} USING (label)"
)

# --- from files to scores ----------------------------------------------------------
QUERIES["latest_result_file"] = lambda spark, sf: accuracy.latest_result_file(
    bind(spark, sf, "eval_files")
)
ORACLE["latest_result_file"] = cte("eval_files") + f", {_latest_sql('eval_files')} SELECT * FROM latest"


def _merge_parts(spark, sf):
    """Metrics of every file; parts are read as if each also carried the task of the part before."""
    files = bind(spark, sf, "eval_files")
    shared = files.withColumn(
        "task", F.when(F.col("task").isin("mmlu", "ifeval"), "gsm8k").otherwise(F.col("task"))
    )
    return accuracy.merge_parts(shared).select("label", "part", "task", "metric_key", "file_mtime", "value")


QUERIES["merge_parts"] = _merge_parts
ORACLE["merge_parts"] = (
    cte("eval_files")
    + ", s AS (SELECT * REPLACE (CASE WHEN task IN ('mmlu', 'ifeval') THEN 'gsm8k' ELSE task END AS task) FROM eval_files) "
    + f"SELECT label, part, task, metric_key, file_mtime, value FROM s QUALIFY RANK() OVER (PARTITION BY label, task ORDER BY {_PART_ORDER} DESC) = 1"
)


def _pick_task_metric(spark, sf):
    metrics = _metrics(spark, sf)
    newest = accuracy.latest_result_file(metrics)
    rows = metrics.join(newest, accuracy.FILE_KEYS)
    return rounded(accuracy.pick_task_metric(rows), 6, "value", "stderr")


QUERIES["pick_task_metric"] = _pick_task_metric
ORACLE["pick_task_metric"] = (
    _picked_sql("eval_files") + f"SELECT label, task, metric_key, {r('value', 6)} AS value, {r('stderr', 6)} AS stderr FROM picked"
)


def _table_sql(binding: str, dim: str, key: str, delta: str, baseline: str, names: list[str]) -> str:
    tasks = fixed.TASKS
    wide = ", ".join(
        f"MAX(CASE WHEN task = '{t}' THEN value END) AS v_{t}, MAX(CASE WHEN task = '{t}' THEN stderr END) AS e_{t}" for t in tasks
    )
    n = " + ".join(f"CASE WHEN v_{t} IS NULL THEN 0 ELSE 1 END" for t in tasks)
    total = " + ".join(f"COALESCE(v_{t}, 0.0e0)" for t in tasks)
    scores = ", ".join(f"{r(f'v_{t}', 4)} AS {t}, {r(f'e_{t}', 4)} AS {t}_stderr" for t in tasks)
    audit = ", ".join(
        f"COALESCE(MAX(CASE WHEN part = '{p}' THEN file_name END), 'MISSING') AS {c}"
        for p, c in fixed.PART_AUDIT_COLUMNS.items()
    )
    return (
        _picked_sql(binding)
        + f", wide AS (SELECT label, {wide} FROM picked GROUP BY label), audit AS (SELECT label, {audit} FROM latest GROUP BY label), "
        + f"t0 AS (SELECT d.*, _lh_file, _gsm8k_file, _ifeval_file, {scores}, CASE WHEN _lh_file IS NOT NULL THEN {n} END AS n_tasks_completed, "
        + f"{r(f'({total}) / NULLIF({n}, 0)', 4)} AS avg FROM {dim} LEFT JOIN audit USING (label) LEFT JOIN wide USING (label)) "
        + f"SELECT ord, '{fixed.ACCURACY_MODEL}' AS model, label AS {key}, {', '.join(names)}, {', '.join(f'{t}, {t}_stderr' for t in tasks)}, avg, "
        + f"{r(f'(avg - (SELECT MAX(avg) FROM t0 WHERE label = {chr(39)}{baseline}{chr(39)})) * 100.0e0', 2)} AS {delta}, n_tasks_completed, "
        + "CASE WHEN _lh_file IS NULL THEN 'MISSING' WHEN n_tasks_completed = 8 THEN 'OK' ELSE 'PARTIAL (' || n_tasks_completed || '/8)' END AS _status, _lh_file, _gsm8k_file, _ifeval_file FROM t0"
    )


METHOD_TABLE_SQL = _table_sql(
    "eval_files", _METHOD_ROWS, "method_label", "delta_vs_fp16_pp", "fp16", ["method", "bits"]
)
SCHEME_TABLE_SQL = _table_sql(
    "scheme_files", _SCHEME_ROWS, "scheme", "delta_vs_f16_gguf_pp", "F16", ["engine"]
)


def method_table(spark: SparkSession, sf: str) -> DataFrame:
    return accuracy_by_method(_metrics(spark, sf))


def scheme_table(spark: SparkSession, sf: str) -> DataFrame:
    return accuracy_by_scheme(_metrics(spark, sf, "scheme_files"))


QUERIES["accuracy_table_method"] = method_table
ORACLE["accuracy_table_method"] = METHOD_TABLE_SQL
QUERIES["accuracy_table_scheme"] = scheme_table
ORACLE["accuracy_table_scheme"] = SCHEME_TABLE_SQL


def _with_expected(spark, sf):
    counts = bind(spark, sf, "eval_files").groupBy("label").agg(F.count("*").alias("n"))
    expected = accuracy.with_expected(counts, _labels(spark))
    status = F.when(F.col("n").isNull(), "MISSING").otherwise("OK")
    return expected.withColumn("status", status)


QUERIES["with_expected_methods"] = _with_expected
ORACLE["with_expected_methods"] = (
    cte("eval_files") + f", c AS (SELECT label, COUNT(*) AS n FROM eval_files GROUP BY label) SELECT d.*, n, CASE WHEN n IS NULL THEN 'MISSING' ELSE 'OK' END AS status FROM {_METHOD_ROWS} LEFT JOIN c USING (label)"
)


def _averages(spark: SparkSession, sf: str) -> DataFrame:
    means = bind(spark, sf, "eval_files").groupBy("label").agg(F.avg("value").alias("avg"))
    return rounded(means, 4, "avg")


def _delta(spark, sf):
    return accuracy.delta_vs_baseline(_averages(spark, sf), "label", "fp16", "avg")


def _delta_without_baseline(spark, sf):
    return accuracy.delta_vs_baseline(_averages(spark, sf), "label", "none", "avg")


_AVERAGES = cte("eval_files") + f", a AS (SELECT label, {r('AVG(value)', 4)} AS avg FROM eval_files GROUP BY label) "
QUERIES["delta_vs_baseline"] = _delta
ORACLE["delta_vs_baseline"] = (
    _AVERAGES + f"""SELECT label, avg, {r("(avg - (SELECT MAX(avg) FROM a WHERE label = 'fp16')) * 100.0e0", 2)} AS delta FROM a"""
)
QUERIES["delta_vs_absent_baseline"] = _delta_without_baseline
ORACLE["delta_vs_absent_baseline"] = _AVERAGES + "SELECT label, avg, CAST(NULL AS DOUBLE) AS delta FROM a"


def _accuracy_vs_performance(spark, sf):
    scores = scheme_table(spark, sf).select("scheme", "avg", "delta_vs_f16_gguf_pp", "_status")
    speed = engine_queries.performance(spark, sf).select(
        "label", "throughput_overall_tok_s", "peak_ram_mb", "energy_per_token_mj"
    )
    return accuracy.accuracy_vs_performance(scores.withColumnRenamed("scheme", "label"), speed)


QUERIES["accuracy_vs_performance"] = _accuracy_vs_performance
ORACLE["accuracy_vs_performance"] = (
    f"SELECT a.scheme, a.avg, a.delta_vs_f16_gguf_pp, a._status, p.throughput_overall_tok_s, p.peak_ram_mb, p.energy_per_token_mj FROM ({SCHEME_TABLE_SQL}) a JOIN ({engine_queries.RATES_SQL}{engine_queries.PERFORMANCE_SQL}) p ON a.scheme = p.label"
)


# --- jobs --------------------------------------------------------------------------
_JOBS = f"jobs AS (SELECT label, part FROM {_METHOD_ROWS}, {values('p', ['part'], [(p,) for p in fixed.PARTS])})"


def _pending(spark, sf):
    models = _labels(spark).select("label", "method")
    return jobs.pending_jobs(models, bind(spark, sf, "eval_files")).select("label", "part")


QUERIES["pending_jobs"] = _pending
ORACLE["pending_jobs"] = (
    cte("eval_files") + f", {_JOBS} SELECT label, part FROM jobs WHERE NOT EXISTS (SELECT 1 FROM eval_files e WHERE e.label = jobs.label AND e.part = jobs.part)"
)
QUERIES["completed_groups"] = lambda spark, sf: jobs.completed_groups(bind(spark, sf, "eval_files"))
ORACLE["completed_groups"] = (
    cte("eval_files") + "SELECT label FROM eval_files GROUP BY label HAVING COUNT(DISTINCT part) = 3"
)


def _status_counts(spark, sf):
    # The fp16 model is not there, yet an old part of it is; rtnW8A16 is there and all its parts failed.
    models = _labels(spark).select("label", (F.col("label") != "fp16").alias("model_present"))
    found = bind(spark, sf, "eval_files").where("label <> 'fp16' OR part <> 'gsm8k'")
    statuses = jobs.job_statuses(models, found)
    return jobs.status_counts(statuses)


QUERIES["status_counts"] = _status_counts
ORACLE["status_counts"] = (
    cte("eval_files")
    + f", {_JOBS} SELECT status, COUNT(*) AS n FROM (SELECT CASE WHEN (label, part) IN (SELECT (label, part) FROM eval_files WHERE label <> 'fp16' OR part <> 'gsm8k') THEN 'ok' WHEN label <> 'fp16' THEN 'failed' ELSE 'skipped' END AS status FROM jobs) GROUP BY status"
)
QUERIES["parse_job_spec"] = lambda spark, sf: jobs.parse_job_spec(bind(spark, sf, "job_specs")).drop("spec")
ORACLE["parse_job_spec"] = (
    cte("job_specs")
    + "SELECT job_id, regexp_extract(spec, '^([^:]*):([^:]*):(.*)$', 1) AS label, regexp_extract(spec, '^([^:]*):([^:]*):(.*)$', 2) AS method, regexp_extract(spec, '^([^:]*):([^:]*):(.*)$', 3) AS model_path FROM job_specs"
)
_PRESETS = " ".join(f"WHEN '{name}' THEN '{tasks}'" for name, tasks in fixed.TASK_PRESETS.items())
QUERIES["resolve_task_preset"] = lambda spark, sf: jobs.resolve_task_preset(
    bind(spark, sf, "task_requests")
).select("job_id", "task")
ORACLE["resolve_task_preset"] = (
    cte("task_requests")
    + f"SELECT job_id, unnest(string_split(CASE tasks {_PRESETS} ELSE tasks END, ',')) AS task FROM task_requests"
)


def _unknown_schemes(spark, sf):
    known = lookup(spark, ["scheme"], [(s,) for s in fixed.KNOWN_SCHEMES])
    return filters.unknown_schemes(bind(spark, sf, "scheme_requests"), known)


QUERIES["unknown_schemes"] = _unknown_schemes
ORACLE["unknown_schemes"] = (
    cte("scheme_requests") + f"SELECT job_id, scheme FROM scheme_requests WHERE scheme NOT IN ({', '.join(repr(s) for s in fixed.KNOWN_SCHEMES)})"
)
