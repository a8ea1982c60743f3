import os
import time

import pytest
from pyspark.sql import functions as F

from bitledger.operators import scoring, timing
from bitledger.operators.engine import telemetry_summary
from bitledger.sinks import reports
from bitledger.sources.engine import parse_telemetry
from bitledger.streaming.telemetry import read_summary, stream_telemetry, telemetry_stream_summary, write_summary

CHOICES = "task string, doc_id long, choice int, loglik double, choice_len long, is_gold boolean"


def test_multiple_choice(spark):
    df = spark.createDataFrame(
        [
            ("t", 1, 0, -1.0, 1, True), ("t", 1, 1, -1.0, 4, False),
            ("t", 2, 0, -3.0, 1, False), ("t", 2, 1, -2.0, 1, True), ("t", 2, 2, -2.0, 8, False),
            ("t", 3, 0, -1.0, 2, False), ("t", 3, 1, -5.0, 2, True),
        ],
        CHOICES,
    )
    assert scoring.mc_accuracy(df).first().acc == pytest.approx(2 / 3)
    assert scoring.mc_accuracy_norm(df).first().acc_norm == pytest.approx(0.0)
    assert 0.3 < scoring.mc2_score(df).first().acc < 0.6


def test_exact_match(spark):
    df = spark.createDataFrame(
        [
            ("g", "so 3 + 4 is #### 1,234.", "1234"),
            ("g", "the answer is $1,234.", "#### 1,234"),
            ("g", "no number", "5"),
            ("g", "#### 7 or 8", "7"),
        ],
        "task string, answer string, gold string",
    )
    row = scoring.exact_match(df).first()
    assert (row.strict, row.flexible, row.n) == (0.5, 0.5, 4)


def test_instructions_and_stderr(spark):
    df = spark.createDataFrame(
        [("i", 1, True), ("i", 1, True), ("i", 2, True), ("i", 2, False)], "task string, prompt_id long, followed boolean"
    )
    row = scoring.instruction_accuracy(df).first()
    assert (row.prompt_level, row.inst_level) == (0.5, 0.75)
    outcomes = df.select("task", F.col("followed").cast("double").alias("outcome"))
    row = scoring.accuracy_stderr(outcomes).first()
    assert row["mean"] == 0.75 and row.stderr == pytest.approx(0.25)


def test_timing(spark):
    df = spark.createDataFrame(
        [("a", i, float(v), 2**20 * i) for i, v in enumerate([900, 800, 10, 20, 30, 40, 50, 7])],
        "run_group string, t long, latency_ms double, memory_bytes long",
    )
    runs = timing.number_iterations(df, "t", 7)
    row = timing.timing_stats(runs).first()
    assert (row.n_runs, row.latency_ms, row.throughput_tok_per_sec) == (5, 30.0, pytest.approx(64 / 0.03))
    assert row.latency_std_ms == pytest.approx(200**0.5)
    row = timing.timing_stats_batched(runs, 128, 4, warmup=3, timed=4).first()
    assert (row.latency_ms, row.peak_memory_mb) == (35.0, 6.0)
    assert row.throughput_tok_per_sec == pytest.approx(512 / 0.035)


def test_report_lines(spark):
    runs = spark.createDataFrame(
        [(1, "a-very-long-method", 12.345, 3.0, 4.0, 0.0), (2, "awq", 1.0, 2.0, 3.0, 7.125), (3, None, None, 2.0, None, None)],
        "k int, method string, latency_ms double, throughput_tok_per_sec double, peak_memory_mb double, perplexity double",
    )
    lines = {r.k: r.line for r in reports.run_lines(runs, ["k"]).collect()}
    assert lines[1] == f"a-very-long-method {'12.3':<14} {'3.0':<14} {'4.0':<12} N/A"
    assert lines[2] == f"{'awq':<12} {'1.0':<14} {'2.0':<14} {'3.0':<12} 7.13"
    assert lines[3] == f"{'-':<12} {'-':<14} {'2.0':<14} {'-':<12} N/A"
    header = reports.accuracy_header({"Method": 14, "Bits": 8}, "Δ vs FP16")
    assert header.startswith("Method        Bits        arc_e") and header.endswith("        Status")


def test_stream_equals_batch_over_late_files(spark, tmp_path):
    schema = "label string, seq long, line string"
    rows = [("F16" if i % 3 else "Q4_0", i, f"RAM {3000 - i}/7620MB VDD_IN {4000 + i}mW/1mW") for i in range(60)]
    source = f"{tmp_path}/in"
    out, checkpoint = f"{tmp_path}/out", f"{tmp_path}/checkpoint"

    def arrive(part):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        write_summary(telemetry_stream_summary(stream), out, checkpoint).awaitTermination()
        return sorted(read_summary(spark, out).collect())

    def batch(part):
        return sorted(telemetry_summary(parse_telemetry(spark.createDataFrame(part, schema))).collect())

    assert arrive(rows[30:]) == batch(rows[30:])
    time.sleep(0.1)
    assert arrive(rows[:30]) == batch(rows)


def test_log_files_as_a_stream(spark, tmp_path):
    logs = {
        "Q8_0/part2.log": ("RAM 900/9MB VDD_IN 30mW\nRAM 800/9MB GR3D_FREQ 10%\n", 2000),
        "Q8_0/part1.log": ("noise\nRAM 500/9MB VDD_IN 10mW\n", 1000),
        "F16/part1.log": ("GR3D_FREQ 30%\n", 1500),
    }
    for name, (text, mtime) in logs.items():
        path = tmp_path / "logs" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
        os.utime(path, (mtime, mtime))
    lines = stream_telemetry(spark, f"{tmp_path}/logs/*")
    out = f"{tmp_path}/summary"
    write_summary(telemetry_stream_summary(lines), out, f"{tmp_path}/checkpoint").awaitTermination()
    rows = {r.label: r for r in read_summary(spark, out).collect()}
    assert (rows["Q8_0"].avg_power_mw, rows["Q8_0"].peak_ram_mb, rows["Q8_0"].ram_delta_mb) == (20.0, 900, 400)
    assert (rows["F16"].avg_gpu_util_pct, rows["F16"].n_samples, rows["F16"].peak_ram_mb) == (30.0, 0, 0)


def test_bootstrap_of_means_is_near_the_closed_form_and_repeats(spark):
    import random

    from bitledger.operators import scoring

    rng = random.Random(5)
    rows = [("a", k, float(rng.random() < 0.3)) for k in range(2000)] + [("b", k, float(k)) for k in range(400)] + [("c", 1, 2.0)]
    outcomes = spark.createDataFrame(rows, "task string, doc_id bigint, outcome double")
    exact = {r.task: r for r in scoring.accuracy_stderr(outcomes).collect()}

    def run(df):
        sums = {"x": F.col("outcome"), "one": F.lit(1)}
        found = scoring.bootstrap_stderr(df, sums, lambda s: s("x") / s("one"), F.concat_ws(":", "task", "doc_id"), replicates=300)
        return {r.task: r for r in found.collect()}

    found = run(outcomes)
    for task in "ab":
        assert found[task].metric == pytest.approx(exact[task].mean) and found[task].n == exact[task].n
        assert found[task].stderr == pytest.approx(exact[task].stderr, rel=0.15)
        assert found[task].replicates == 300
    # One row is drawn at all in about 63 of 100 replicates, and gives the same metric in each.
    assert 150 < found["c"].replicates < 230 and found["c"].stderr == 0
    again = run(outcomes.repartition(13))
    assert {t: (r.n, r.replicates) for t, r in again.items()} == {t: (r.n, r.replicates) for t, r in found.items()}
    assert all(again[t].stderr == pytest.approx(found[t].stderr) for t in "ab")


def test_bootstrap_weights_are_poisson(spark):
    from collections import Counter

    from bitledger.operators import scoring

    rows = spark.range(400).select(F.explode(scoring.bootstrap_weights(F.col("id").cast("string"), 50, 1)).alias("w"))
    counts = Counter(r.w for r in rows.collect())
    assert sum(counts.values()) == 20_000
    for k, share in enumerate((0.3679, 0.3679, 0.1839, 0.0613)):
        assert counts[k] / 20_000 == pytest.approx(share, abs=0.015)


def test_choices_are_not_hashed_by_document(spark):
    rows = [("t", 1, 2, -1.0, 1, True), ("t", 1, 1, -1.0, 1, False), ("t", 2, 1, None, 1, True), ("t", 3, 1, -2.0, 1, True), ("t", 3, 2, None, 1, False)]
    df = spark.createDataFrame(rows, "task string, doc_id bigint, choice int, loglik double, choice_len bigint, is_gold boolean")
    found = scoring.mc_accuracy(df)
    # A tie goes to the first choice; a document without a score counts, but has no hit.
    assert [tuple(r) for r in found.collect()] == [("t", 0.5, 3)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" not in plan and "max_by" not in plan
