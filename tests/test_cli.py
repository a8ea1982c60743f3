import json
import os

from bitledger.cli import main
from tests.test_files import engine_files, evaluation, write


def test_analyze(spark, tmp_path):
    write(f"{tmp_path}/benchmark_1.csv", "model_name,method,latency_ms,throughput_tok_per_sec,peak_memory_mb\n./r/m_awq_w4a16,awq,10.0,5.0,2.0\n")
    write(f"{tmp_path}/eval/m_awq_w4a16__ppl_x.json", '{"perplexity": 8.5}')
    out = f"{tmp_path}/out"
    main(["analyze", "--benchmark-glob", f"{tmp_path}/benchmark_*.csv", "--ppl-glob", f"{tmp_path}/eval/*.json", "--output-dir", out], spark)
    assert sorted(os.listdir(out)) == ["latency_ms", "memory_perplexity", "merged", "perplexity", "throughput_tok_per_sec"]
    back = spark.read.option("header", True).csv(f"{out}/perplexity").collect()
    assert [r.asDict() for r in back] == [{"model_family": "m", "AWQ (W4A16)": "8.5"}]


def test_accuracy_commands(spark, tmp_path, capsys):
    write(f"{tmp_path}/in/tabel4_F16_gsm8k.json", evaluation({"gsm8k": {"exact_match,strict-match": 0.25}}))
    main(["accuracy-by-scheme", "--results", f"{tmp_path}/in/*.json", "--output", f"{tmp_path}/out"], spark)
    lines = capsys.readouterr().out.splitlines()
    assert len(lines) == 6 and lines[1].startswith("F16 ") and "+0.00pp" in lines[1] and lines[5].endswith("MISSING")


def test_engine_command(spark, tmp_path, capsys):
    engine_files(tmp_path)
    main(["engine-summary", "--bench-json", f"{tmp_path}/*/bench.json", "--telemetry-log", f"{tmp_path}/*/tegra.log"], spark)
    printed = capsys.readouterr().out
    assert "Latency (256+64 tok)  : 5760.0 ms" in printed and "Peak RAM              : 2500 MB  (Δ 500 MB)" in printed


def test_perplexity_command(spark, tmp_path, capsys):
    spark.createDataFrame([(0, "a b a")], "doc_id long, text string").write.parquet(f"{tmp_path}/corpus")
    main(["perplexity", "--model-path", "m", "--corpus", f"{tmp_path}/corpus", "--output", f"{tmp_path}/out"], spark)
    printed = json.loads(capsys.readouterr().out)
    assert list(printed) == ["model", "method", "dataset", "perplexity", "eval_time_s"] and printed["eval_time_s"] > 0


def test_run_report(spark, tmp_path, capsys):
    write(
        f"{tmp_path}/benchmark_1.csv",
        "model_name,method,latency_ms,throughput_tok_per_sec,timestamp\nm,awq,10.04,5.0,2026-01-02\nm,rtn,20.0,,2026-01-01\n",
    )
    main(["run-report", "--runs", f"{tmp_path}/benchmark_*.csv"], spark)
    lines = capsys.readouterr().out.splitlines()
    assert lines[0].startswith("Method       Latency(ms)") and set(lines[1]) == {"-"}
    assert lines[2].split() == ["rtn", "20.0", "-", "-", "N/A"]
    assert lines[3].split() == ["awq", "10.0", "5.0", "-", "N/A"]
