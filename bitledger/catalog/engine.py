"""Registered queries: engine tests, telemetry and timed runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitledger.catalog.bindings import bind, cte, table
from bitledger.catalog.common import Query, r, rounded
from bitledger.operators import engine, timing
from bitledger.session import scratch_path
from bitledger.sources.engine import parse_engine_bench, parse_telemetry, read_engine_bench
from bitledger.streaming.growing_log import stream_log
from bitledger.streaming.telemetry import read_summary, telemetry_stream_summary, write_summary

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def _tests(spark: SparkSession, sf: str) -> DataFrame:
    return read_engine_bench(bind(spark, sf, "engine_tests").withColumnRenamed("ord", "pos"))


def _samples(spark: SparkSession, sf: str) -> DataFrame:
    return parse_telemetry(bind(spark, sf, "telemetry"))


def _read_engine_bench(spark, sf):
    """Each test goes through engine JSON, as an array with one entry."""
    tests = bind(spark, sf, "engine_tests")
    entry = F.struct("test_name", "n_prompt", "n_gen", "avg_ts", "stddev_ts")
    as_json = tests.select("label", "ord", F.to_json(F.array(entry)).alias("json"))
    parsed = parse_engine_bench(as_json).withColumn("pos", F.col("ord") + F.col("pos"))
    return read_engine_bench(parsed).select(
        "label", "name", F.col("first_pos").alias("first_ord"),
        "avg_ts", "stddev_ts", "n_prompt", "n_gen",
    )


_TESTS = (
    cte("engine_tests")
    + ", named AS (SELECT *, COALESCE(NULLIF(test_name, ''), CAST(NULLIF(n_prompt, 0) AS VARCHAR), '?') AS name, NULLIF(test_name, '') IS NULL AND n_prompt <> 0 AS is_number FROM engine_tests), "
    + "tests AS (SELECT label, name, is_number, MIN(ord) AS first_ord, ARG_MAX(avg_ts, ord) AS avg_ts, ARG_MAX(stddev_ts, ord) AS stddev_ts, ARG_MAX(n_prompt, ord) AS n_prompt, ARG_MAX(n_gen, ord) AS n_gen FROM named GROUP BY label, name, is_number), "
    + "pp AS (SELECT label, avg_ts AS pp_tok_s, stddev_ts AS pp_std FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY label ORDER BY first_ord) AS k FROM tests WHERE (name LIKE 'pp%' AND NOT is_number) OR (n_prompt > 0 AND n_gen = 0)) WHERE k = 1), "
    + "tg AS (SELECT label, avg_ts AS tg_tok_s, stddev_ts AS tg_std FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY label ORDER BY first_ord) AS k FROM tests WHERE (name LIKE 'tg%' AND NOT is_number) OR (n_gen > 0 AND n_prompt = 0)) WHERE k = 1) "
)
_PARSED = "SELECT label, seq, TRY_CAST(regexp_extract(line, 'VDD_IN (\\d+)mW', 1) AS INTEGER) AS power_mw, TRY_CAST(regexp_extract(line, 'RAM (\\d+)/\\d+MB', 1) AS INTEGER) AS ram_mb, TRY_CAST(regexp_extract(line, 'GR3D_FREQ (\\d+)%', 1) AS INTEGER) AS gpu_pct FROM telemetry"
_SUMMARY = (
    "SELECT label, COALESCE(AVG(power_mw), 0.0e0) AS avg_power_mw, COALESCE(MAX(ram_mb), 0) AS peak_ram_mb, "
    "COALESCE(MAX(ram_mb), 0) - COALESCE(FIRST(ram_mb ORDER BY seq) FILTER (ram_mb IS NOT NULL), 0) AS ram_delta_mb, "
    "COALESCE(AVG(gpu_pct), 0.0e0) AS avg_gpu_util_pct, COUNT(power_mw) AS n_samples FROM samples GROUP BY label"
)
_TELEMETRY = cte("telemetry") + f", samples AS ({_PARSED}) "

QUERIES["read_engine_bench"] = _read_engine_bench
ORACLE["read_engine_bench"] = (
    _TESTS + "SELECT label, name, first_ord, avg_ts, stddev_ts, n_prompt, n_gen FROM tests"
)
QUERIES["parse_telemetry"] = lambda spark, sf: _samples(spark, sf)
ORACLE["parse_telemetry"] = _TELEMETRY + "SELECT * FROM samples"
QUERIES["telemetry_summary"] = lambda spark, sf: rounded(
    engine.telemetry_summary(_samples(spark, sf)), 6, "avg_power_mw", "avg_gpu_util_pct"
)
ORACLE["telemetry_summary"] = (
    _TELEMETRY
    + f", s AS ({_SUMMARY}) SELECT label, {r('avg_power_mw', 6)} AS avg_power_mw, peak_ram_mb, ram_delta_mb, {r('avg_gpu_util_pct', 6)} AS avg_gpu_util_pct, n_samples FROM s"
)


def _pick_engine_test(spark, sf):
    tests = _tests(spark, sf)
    return engine.pick_engine_test(tests, "pp").join(engine.pick_engine_test(tests, "tg"), "label")


QUERIES["pick_engine_test"] = _pick_engine_test
ORACLE["pick_engine_test"] = _TESTS + "SELECT label, pp_tok_s, pp_std, tg_tok_s, tg_std FROM pp JOIN tg USING (label)"

_RATES = (
    _TESTS
    + _TELEMETRY.replace("WITH ", ", ", 1)
    + f", summary AS ({_SUMMARY}), lat AS (SELECT *, CASE WHEN pp_tok_s <> 0 AND tg_tok_s <> 0 THEN (256.0e0 / pp_tok_s + 64.0e0 / tg_tok_s) * 1000.0e0 ELSE 0.0e0 END AS latency_total_ms FROM pp JOIN tg USING (label) LEFT JOIN summary USING (label)), "
    + "thr AS (SELECT *, CASE WHEN latency_total_ms <> 0 THEN 64.0e0 / (latency_total_ms / 1000.0e0) ELSE 0.0e0 END AS throughput_overall_tok_s, avg_power_mw * latency_total_ms / 64.0e0 / 1000.0e0 AS energy_per_token_mj FROM lat), "
    + "met AS (SELECT *, throughput_overall_tok_s / 11.5e0 AS speedup_vs_hf_fp16 FROM thr) "
)


def _engine_metrics(spark, sf):
    rates = engine.engine_rates(_tests(spark, sf), _samples(spark, sf))
    columns = [
        "latency_total_ms", "throughput_overall_tok_s", "energy_per_token_mj", "speedup_vs_hf_fp16",
    ]
    return rounded(engine.engine_metrics(rates).select("label", *columns), 6, *columns)


QUERIES["engine_metrics"] = _engine_metrics
ORACLE["engine_metrics"] = (
    _RATES
    + f"SELECT label, {r('latency_total_ms', 6)} AS latency_total_ms, {r('throughput_overall_tok_s', 6)} AS throughput_overall_tok_s, {r('energy_per_token_mj', 6)} AS energy_per_token_mj, {r('speedup_vs_hf_fp16', 6)} AS speedup_vs_hf_fp16 FROM met"
)
PERFORMANCE_SQL = (
    f"SELECT label, {r('pp_tok_s', 2)} AS prompt_eval_tok_s, {r('pp_std', 2)} AS prompt_eval_std, {r('tg_tok_s', 2)} AS generation_tok_s, {r('tg_std', 2)} AS generation_std, "
    f"{r('latency_total_ms', 1)} AS latency_total_ms, {r('throughput_overall_tok_s', 2)} AS throughput_overall_tok_s, peak_ram_mb, ram_delta_mb, {r('avg_power_mw', 0)} AS avg_power_mw, "
    f"{r('energy_per_token_mj', 2)} AS energy_per_token_mj, {r('avg_gpu_util_pct', 1)} AS avg_gpu_util_pct, {r('speedup_vs_hf_fp16', 2)} AS speedup_vs_hf_fp16, n_samples FROM met"
)
RATES_SQL = _RATES


def performance(spark: SparkSession, sf: str) -> DataFrame:
    return engine.engine_performance_table(_tests(spark, sf), _samples(spark, sf))


QUERIES["engine_performance_table"] = performance
ORACLE["engine_performance_table"] = _RATES + PERFORMANCE_SQL


def _stream(spark, sf):
    """The events table as a stream of telemetry lines, summarised until it is read to its end."""
    source, select = "events", "telemetry"
    # The glob matches the table as one file and as a folder of parts.
    events = spark.readStream.schema(table(spark, sf, source).schema).parquet(f"{sf}/{source}.parquet*")
    from bitledger.catalog.bindings import BINDINGS

    lines = spark.sql(BINDINGS[select][1], **{source: events})
    out = scratch_path(spark, "stream-summary")
    write_summary(telemetry_stream_summary(lines), out, f"{out}-checkpoint").awaitTermination()
    return rounded(read_summary(spark, out), 6, "avg_power_mw", "avg_gpu_util_pct")


QUERIES["telemetry_stream_summary"] = _stream
ORACLE["telemetry_stream_summary"] = ORACLE["telemetry_summary"]


def _log_stream(spark, sf):
    """Telemetry lines written as log files, one folder a label, and read as growing logs."""
    path = scratch_path(spark, "logs")
    lines = bind(spark, sf, "telemetry").select("label", F.concat(F.lit("#"), F.lpad(F.col("seq").cast("string"), 12, "0"), F.lit(" "), "line").alias("value"))
    lines.repartition("label").sortWithinPartitions("label", "value").write.partitionBy("label").text(path)
    read = stream_log(spark, f"{path}/*/*.txt", r"label=([^/]+)/[^/]+$")
    out = scratch_path(spark, "log-summary")
    write_summary(telemetry_stream_summary(read), out, f"{out}-checkpoint").awaitTermination()
    return rounded(read_summary(spark, out), 6, "avg_power_mw", "avg_gpu_util_pct")


QUERIES["growing_log_summary"] = _log_stream
ORACLE["growing_log_summary"] = ORACLE["telemetry_summary"]


# --- timed runs --------------------------------------------------------------------
_TIMING = cte("timing") + ", i AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY run_group ORDER BY event_id) AS iteration FROM timing) "


def _timing_stats(spark, sf):
    runs = timing.number_iterations(bind(spark, sf, "timing"), "event_id", 7)
    stats = timing.timing_stats(runs)
    return rounded(stats, 6, "latency_ms", "latency_std_ms", "throughput_tok_per_sec")


QUERIES["timing_stats"] = _timing_stats
ORACLE["timing_stats"] = (
    _TIMING
    + f"SELECT run_group, COUNT(*) AS n_runs, {r('AVG(latency_ms)', 6)} AS latency_ms, {r('STDDEV_POP(latency_ms)', 6)} AS latency_std_ms, {r('64.0e0 / NULLIF(AVG(latency_ms) / 1000.0e0, 0)', 6)} AS throughput_tok_per_sec FROM i WHERE iteration BETWEEN 3 AND 7 GROUP BY run_group"
)


def _timing_stats_batched(spark, sf):
    runs = timing.number_iterations(bind(spark, sf, "timing"), "event_id", 13)
    stats = timing.timing_stats_batched(runs, batch_size=4)
    return rounded(stats, 6, "latency_ms", "throughput_tok_per_sec", "peak_memory_mb")


QUERIES["timing_stats_batched"] = _timing_stats_batched
ORACLE["timing_stats_batched"] = (
    _TIMING
    + f"SELECT run_group, COUNT(*) AS n_runs, {r('SUM(latency_ms) / COUNT(*)', 6)} AS latency_ms, {r('512.0e0 / NULLIF(SUM(latency_ms) / COUNT(*) / 1000.0e0, 0)', 6)} AS throughput_tok_per_sec, {r('MAX(memory_bytes) / 1048576.0e0', 6)} AS peak_memory_mb FROM i WHERE iteration BETWEEN 4 AND 13 GROUP BY run_group"
)
