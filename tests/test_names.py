import math

import pytest
from pyspark.sql import functions as F

from bitledger.functions.columns import round_half_up
from bitledger.operators.jobs import parse_job_spec, resolve_task_preset
from bitledger.operators.merge import drop_and_derive, parse_model_dir, with_labels
from bitledger.operators.pivots import (
    mean_by,
    memory_perplexity_by_method,
    merged_mean_by,
    pivot_metric,
    summary_by_hardware_method,
)

NAMES = {
    "qwen2.5_0.5b_instruct_awq_w4a16": ("qwen2.5-0.5b-instruct", "awq", "W4A16"),
    "qwen2.5-1.5b-awq-int4-sym": ("qwen2.5-1.5b", "awq", "W4A16"),
    "Qwen2.5-1.5B": ("qwen2.5-1.5b", "unknown", "unknown"),
    "AWQ_x": ("AWQ_x", "awq", "unknown"),
    "m-bnb4": ("m-bnb4", "unknown", "unknown"),
    "a__b--smoothq_w8a8": ("a-b", "smooth", "W8A8"),
    "a-gptq-awq": ("a", "gptq", "unknown"),
    "-rtn-int8": ("", "rtn", "W8A16"),
    "int8only": ("int8only", "unknown", "W8A16"),
    "x-w4a16-int8": ("x-w4a16-int8", "unknown", "W4A16"),
    "tail-": ("tail-", "unknown", "unknown"),
}


def test_parse_model_dir(spark):
    rows = parse_model_dir(spark.createDataFrame([(n,) for n in NAMES], "model_dir string")).collect()
    assert {r.model_dir: (r.model_family, r.method, r.scheme) for r in rows} == NAMES


def test_drop_and_derive_replaces_or_keeps_recorded_method(spark):
    df = spark.createDataFrame(
        [("Qwen2.5-1.5B", "fp16"), ("x-awq", None), (None, "gptq")], "model_dir string, method string"
    )
    derived = {r.model_dir: r.method for r in drop_and_derive(df).collect()}
    assert derived == {"Qwen2.5-1.5B": "unknown", "x-awq": "awq", "nan": "unknown"}
    kept = {r.model_dir: r.method for r in drop_and_derive(df, prefer_recorded_method=True).collect()}
    assert kept == {"Qwen2.5-1.5B": "fp16", "x-awq": "awq", "nan": "gptq"}


def test_labels(spark):
    df = spark.createDataFrame(
        [("awq", "W4A16"), ("smooth", "unknown"), ("bnb", "W8A16")], "method string, scheme string"
    )
    assert [r.method_scheme for r in with_labels(df).collect()] == ["AWQ (W4A16)", "SmoothQuant", "bnb (W8A16)"]


def test_job_spec_keeps_later_colons(spark):
    row = parse_job_spec(spark.createDataFrame([("a:b:c/d:e",)], "spec string")).first()
    assert (row.label, row.method, row.model_path) == ("a", "b", "c/d:e")


@pytest.mark.parametrize(
    "tasks, expected",
    [("quick", ["arc_easy", "hellaswag"]), ("mmlu", ["mmlu"]), ("a,b", ["a", "b"])],
)
def test_task_presets(spark, tasks, expected):
    df = spark.createDataFrame([(tasks,)], "tasks string")
    assert [r.task for r in resolve_task_preset(df).collect()] == expected


def test_rounding_of_extreme_numbers(spark):
    values = [float("nan"), float("inf"), -float("inf"), 1e16, -1e300, 123.456, -0.126, None]
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double")
    got = [r.r for r in rows.select("k", round_half_up(F.col("v"), 2).alias("r")).orderBy("k").collect()]
    assert math.isnan(got[0]) and got[1:] == [float("inf"), -float("inf"), 1e16, -1e300, 123.46, -0.13, None]


def test_pivot_refuses_what_is_not_listed(spark):
    runs = spark.createDataFrame([("m", "awq", 1.0), ("m", "new", 3.0)], "row string, col string, x double")
    assert pivot_metric(runs, "x", "row", "col").first().asDict() == {"row": "m", "awq": 1.0, "new": 3.0}
    assert {r.col: r["mean"] for r in mean_by(runs, "x", "row", "col").collect()} == {"awq": 1.0, "new": 3.0}
    with pytest.raises(Exception, match="not listed: new"):
        pivot_metric(runs, "x", "row", "col", ["awq"]).collect()


def test_merged_means_weigh_by_results_and_summaries_use_runs_alone(spark):
    bench = spark.createDataFrame(
        [("d_awq_w4a16", "h", "rec", 100.0, 1.0), ("d_awq_w8a8", "h", "rec", 200.0, 2.0)],
        "model_dir string, hardware string, method string, latency_ms double, perplexity double",
    ).selectExpr("*", "latency_ms AS throughput_tok_per_sec", "latency_ms AS peak_memory_mb")
    ppl = spark.createDataFrame(
        [("d_awq_w4a16", 5.0), ("d_awq_w4a16", 6.0), ("d_awq_w8a8", 7.0)], "model_dir string, perplexity double"
    )
    row = merged_mean_by(bench, ppl, "latency_ms", "method_label").first()
    assert (row.model_family, row.method_label, row["mean"]) == ("d", "AWQ", pytest.approx(400 / 3))
    row = summary_by_hardware_method(bench).first()
    assert (row.method, row.latency_ms, row.perplexity) == ("rec", 150.0, 1.5)
    assert {r.method for r in memory_perplexity_by_method(bench).collect()} == {"rec"}
