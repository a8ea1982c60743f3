import json
import os

import pytest
from pyspark.sql import functions as F

from bitledger.functions import fixed_values as fixed
from bitledger.plans.accuracy_tables import METHOD_TABLE_COLUMNS, accuracy_by_method_files
from bitledger.plans.engine_tables import engine_summary
from bitledger.plans.evaluation_jobs import finished_models, pending_evaluations
from bitledger.plans.results import load_results
from bitledger.sinks import tables
from bitledger.sources.corpus import file_inventory, read_corpus
from bitledger.sources.engine import parse_telemetry, read_telemetry
from bitledger.sources.evaluations import matches_output, read_eval_results, result_texts, valid_results
from bitledger.sources.runs import read_benchmark_csv, read_ppl_json, with_run_time


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)
    return str(path)


def test_csv_with_differing_headers(spark, tmp_path):
    write(f"{tmp_path}/benchmark_a.csv", "model_name,method,latency_ms,extra\nm1,awq,1.5,hello\nm2,awq,,\n")
    write(f"{tmp_path}/benchmark_b.csv", 'latency_ms,"model_name",peak_memory_mb\n2.5,"x,model_name,y",NaN\n')
    rows = {r.model_name: r for r in read_benchmark_csv(spark, f"{tmp_path}/benchmark_*.csv").collect()}
    assert (rows["m1"].latency_ms, rows["m1"].extra, rows["m1"].peak_memory_mb) == (1.5, "hello", None)
    assert rows["m2"].latency_ms is None
    other = rows["x,model_name,y"]
    assert (other.latency_ms, other.method, other.peak_memory_mb) == (2.5, None, None)


def test_csv_without_model_name_is_an_error(spark, tmp_path):
    write(f"{tmp_path}/a.csv", "a,b\n1,2\n")
    with pytest.raises(ValueError, match="model_name"):
        read_benchmark_csv(spark, f"{tmp_path}/*.csv")


def test_run_time(spark):
    df = spark.createDataFrame([(1, "2026-05-27 10:00:01"), (2, ""), (3, None)], "k int, timestamp string")
    rows = {r.k: r for r in with_run_time(df).collect()}
    assert str(rows[1].run_time) == "2026-05-27 10:00:01"
    assert rows[2].run_time is not None and len(rows[3].timestamp) == 19


def test_ppl_json_takes_name_from_file(spark, tmp_path):
    write(f"{tmp_path}/m-awq__ppl_wikitext2.json", '{\n "perplexity": 8.5,\n "dataset": "wikitext2"\n}')
    write(f"{tmp_path}/other.json", '{"model": "./results/m-rtn/", "perplexity": 9.5}')
    rows = sorted(read_ppl_json(spark, f"{tmp_path}/*.json").collect())
    assert [tuple(r) for r in rows] == [("m-awq", 8.5, "wikitext2"), ("m-rtn", 9.5, None)]


def test_load_results_end_to_end(spark, tmp_path):
    write(f"{tmp_path}/benchmark_1.csv", "model_name,method,latency_ms,perplexity\n./r/m_awq_w4a16,awq,10.0,1.0\n")
    write(f"{tmp_path}/eval/m_awq_w4a16__ppl_x.json", '{"perplexity": 8.5}')
    rows = load_results(spark, f"{tmp_path}/benchmark_*.csv", f"{tmp_path}/eval/*__ppl_*.json").collect()
    assert [(r.model_family, r.method, r.scheme, r.latency_ms, r.perplexity) for r in rows] == [
        ("m", "awq", "W4A16", 10.0, 8.5)
    ]


def test_results_of_one_kind_or_none(spark, tmp_path):
    none = f"{tmp_path}/absent*.csv"
    write(f"{tmp_path}/eval/m_awq__ppl_x.json", '{"perplexity": 8.5}')
    write(f"{tmp_path}/benchmark_1.csv", "model_name,latency_ms\n./r/m_awq,10.0\n")
    only = load_results(spark, none, f"{tmp_path}/eval/*__ppl_*.json").collect()
    assert [(r.model_family, r.method, r.perplexity) for r in only] == [("m", "awq", 8.5)]
    runs = load_results(spark, f"{tmp_path}/benchmark_*.csv", f"{tmp_path}/eval/none*.json").collect()
    assert [(r.model_family, r.latency_ms) for r in runs] == [("m", 10.0)]
    empty = load_results(spark, none, none)
    assert empty.count() == 0 and {"model_family", "method", "scheme", "latency_ms"} <= set(empty.columns)


def test_broken_perplexity_file_is_an_error(spark, tmp_path):
    write(f"{tmp_path}/a__ppl_x.json", '{"perplexity": 8.5, "data')
    with pytest.raises(Exception, match="(?i)malformed"):
        read_ppl_json(spark, f"{tmp_path}/*.json").collect()


def evaluation(task_values):
    return json.dumps({"results": {t: {k: v for k, v in m.items()} for t, m in task_values.items()}})


def test_eval_results_mix_numbers_and_text(spark, tmp_path):
    write(f"{tmp_path}/a.json", evaluation({"mmlu": {"acc,none": 0.5, "acc_stderr,none": "N/A", "alias": "mmlu"}}))
    write(f"{tmp_path}/b.json", '{"config": {}}')
    rows = read_eval_results(spark, f"{tmp_path}/*.json").collect()
    assert {(r.file_name, r.metric_key): r.value for r in rows} == {
        ("a.json", "acc,none"): 0.5, ("a.json", "acc_stderr,none"): None, ("a.json", "alias"): None,
    }


def test_accuracy_table_from_files(spark, tmp_path):
    base = f"{tmp_path}/qwen2.5-0.5b-instruct"
    old = write(f"{base}_fp16_likelihood.json", evaluation({"mmlu": {"acc,none": 0.1}}))
    new = write(f"{base}_fp16_likelihood_2026.json", evaluation({"mmlu": {"acc,none": 0.5, "acc_stderr,none": 0.01}}))
    os.utime(old, (1000, 1000))
    os.utime(new, (2000, 2000))
    write(f"{base}_awqW4A16_gsm8k.json", evaluation({"gsm8k": {"exact_match,strict-match": 0.25}}))
    write(f"{base}_rtnW4A16_ifeval.json", '{"no_results": 1}')
    write(f"{tmp_path}/unrelated_fp16_gsm8k.json", evaluation({"gsm8k": {"exact_match,strict-match": 1.0}}))
    table = accuracy_by_method_files(spark, f"{tmp_path}/*.json")
    rows = {r.method_label: r for r in table.collect()}
    assert rows["fp16"].mmlu == 0.5 and rows["fp16"].mmlu_stderr == 0.01 and rows["fp16"].gsm8k is None
    assert rows["fp16"]._lh_file == "qwen2.5-0.5b-instruct_fp16_likelihood_2026.json"
    assert rows["awqW4A16"].delta_vs_fp16_pp == -25.0
    assert rows["rtnW4A16"]._status == "PARTIAL (0/8)" and rows["smoothW8A8"]._status == "MISSING"
    out = f"{tmp_path}/table"
    tables.write_table_csv(table, [*METHOD_TABLE_COLUMNS, "absent"], out, one_file=True)
    files = [f for f in os.listdir(out) if f.endswith(".csv")]
    lines = open(f"{out}/{files[0]}").read().splitlines()
    assert len(files) == 1 and lines[0] == ",".join([*METHOD_TABLE_COLUMNS, "absent"]) and len(lines) == 7


def test_valid_and_corrupt_results(spark, tmp_path):
    write(f"{tmp_path}/x.json", '{\n "results": {}\n}')
    write(f"{tmp_path}/x_1.json", '{"results": {')
    write(f"{tmp_path}/y.json", "")
    write(f"{tmp_path}/nan.json", '{"results": {"mmlu": {"acc,none": NaN, "a": 1, "a": 2}}}\n')
    write(f"{tmp_path}/tail.json", '{"results": {}} x')
    write(f"{tmp_path}/list.json", "[1, 2]")
    valid, corrupt = valid_results(result_texts(spark, f"{tmp_path}/*.json"))
    assert sorted(r.file_name for r in valid.collect()) == ["list.json", "nan.json", "x.json"]
    assert {"x_1.json", "tail.json"} <= {r.file_name for r in corrupt.collect()}
    read = read_eval_results(spark, f"{tmp_path}/nan.json").where("metric_key = 'acc,none'").collect()
    assert [r.value for r in read] == [None]
    assert os.path.exists(f"{tmp_path}/x_1.json")
    models = spark.createDataFrame([("fp16",), ("awqW4A16",)], "label string")
    write(f"{tmp_path}/jobs/q_fp16_gsm8k_1.json", "{}")
    write(f"{tmp_path}/jobs/q_awqW4A16_gsm8k.json", '{"results": ')
    left = pending_evaluations(spark, f"{tmp_path}/jobs/*.json", models, "q", ["fp16", "awqW4A16"]).collect()
    assert finished_models(spark, f"{tmp_path}/jobs/*.json", "q", ["fp16"]).count() == 0
    assert len(left) == 5 and ("fp16", "gsm8k") not in {(r.label, r.part) for r in left}
    names = spark.createDataFrame([("x.json",), ("x_1.json",), ("x2.json",), ("x_1.jsonl",)], "n string")
    hits = names.where(matches_output(F.col("n"), F.lit("x.json"))).collect()
    assert [r.n for r in hits] == ["x.json", "x_1.json"]


def engine_files(tmp_path):
    tests = [
        {"n_prompt": 256, "n_gen": 0, "avg_ts": 100.0, "stddev_ts": 1.0},
        {"test_name": "pp256", "n_prompt": 256, "n_gen": 0, "avg_ts": 5.0},
        {"test": "tg64", "n_gen": 64, "avg_ts": 10.0},
        {"test": "tg64", "n_gen": 64, "avg_ts": 20.0, "stddev_ts": 0.5},
    ]
    write(f"{tmp_path}/Q8_0/bench.json", json.dumps(tests, indent=1))
    write(f"{tmp_path}/F16/bench.json", json.dumps(tests[:1]))
    log = "RAM 2000/7620MB VDD_IN 4000mW/4000mW\nnoise\nRAM 2500/7620MB GR3D_FREQ 50% VDD_IN 5000mW/4000mW\n"
    write(f"{tmp_path}/Q8_0/tegra.log", log)
    write(f"{tmp_path}/F16/tegra.log", "RAM 100/7620MB\n")


def test_engine_summary_from_files(spark, tmp_path):
    engine_files(tmp_path)
    summary = f"{tmp_path}/summary"
    arguments = (spark, f"{tmp_path}/*/bench.json", f"{tmp_path}/*/tegra.log", summary)
    rows = {r.label: r for r in engine_summary(*arguments).collect()}
    row = rows["Q8_0"]
    assert (row.prompt_eval_tok_s, row.generation_tok_s, row.generation_std) == (100.0, 20.0, 0.5)
    assert row.latency_total_ms == (256 / 100 + 64 / 20) * 1000
    assert (row.peak_ram_mb, row.ram_delta_mb, row.avg_power_mw, row.avg_gpu_util_pct) == (2500, 500, 4500.0, 50.0)
    assert row.n_samples == 2
    none = rows["F16"]
    assert (none.latency_total_ms, none.throughput_overall_tok_s, none.energy_per_token_mj) == (0.0, 0.0, 0.0)
    assert (none.speedup_vs_hf_fp16, none.avg_power_mw, none.n_samples) == (0.0, 0.0, 0)
    engine_summary(*arguments)
    back = spark.read.option("header", True).csv(summary)
    assert back.columns == fixed.ENGINE_SUMMARY_COLUMNS and back.count() == 4


def test_telemetry_order_follows_the_file(spark, tmp_path):
    write(f"{tmp_path}/dev/log", "\n".join(f"RAM {i}/9MB" for i in range(1, 2001)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        samples = parse_telemetry(read_telemetry(spark, f"{tmp_path}/*/log"))
        assert samples.rdd.getNumPartitions() > 5
        assert [r.ram_mb for r in samples.orderBy("seq").collect()] == list(range(1, 2001))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_append_and_json_sinks(spark, tmp_path):
    df = spark.createDataFrame([("m", 1.0)], "model_name string, latency_ms double")
    for _ in range(2):
        tables.append_summary_csv(df, f"{tmp_path}/csv")
    assert read_benchmark_csv(spark, f"{tmp_path}/csv").count() == 2
    tables.write_results_csv(df, f"{tmp_path}/csv")
    assert read_benchmark_csv(spark, f"{tmp_path}/csv").count() == 1
    tables.write_results_json(df.withColumn("perplexity", F.lit(None).cast("double")), f"{tmp_path}/json")
    assert [r.value for r in spark.read.text(f"{tmp_path}/json").collect()] == [
        '{"model_name":"m","latency_ms":1.0,"perplexity":null}'
    ]


def test_corpus_by_name_and_inventory(spark, tmp_path):
    first = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    second = spark.createDataFrame([("b", 2)], "sentence string, n int")
    catalog = {"wikitext2": first, "ptb": second}
    assert tuple(read_corpus(spark, "ptb", catalog, order="n").first()) == (2, "b")
    with pytest.raises(ValueError, match="order"):
        read_corpus(spark, "ptb", catalog)
    assert read_corpus(spark, "unknown", catalog).first().text == "a"
    write(f"{tmp_path}/inv/b.gguf", "x" * 1048576)
    write(f"{tmp_path}/inv/a.gguf", "x" * 524288)
    write(f"{tmp_path}/inv/c.txt", "x")
    listing = file_inventory(spark, f"{tmp_path}/inv", "*.gguf").collect()
    assert [tuple(r) for r in listing] == [("a.gguf", 0.5), ("b.gguf", 1.0)]


def test_append_once_survives_reruns_and_crashes(spark, tmp_path):
    from bitledger.sinks.tables import append_once, read_appended

    path = f"{tmp_path}/summary"
    rows = spark.createDataFrame([("a", 1.5), ("b,\"c\"", None)], "label string, x double")
    assert read_appended(spark, path, rows.schema).count() == 0
    assert append_once(rows, path, "run 1") and not append_once(rows, path, "run 1")
    assert append_once(rows, path, "run/2")
    assert sorted(map(tuple, read_appended(spark, path, rows.schema).collect()), key=str) == sorted([tuple(r) for r in rows.collect()] * 2, key=str)
    # A crash after staging, and one between creating the record and writing it.
    rows.write.csv(f"{path}/_staged/lost")
    import hashlib

    record = tmp_path / "summary" / "_runs" / hashlib.sha256(b"run 3").hexdigest()
    record.write_bytes(b"")
    assert read_appended(spark, path, rows.schema).count() == 4
    assert append_once(rows, path, "run 3") and not append_once(rows, path, "run 3")
    assert read_appended(spark, path, rows.schema).count() == 6


def test_headers_are_read_from_first_lines_alone(tmp_path):
    import io

    from bitledger.sources import runs

    class Counting(io.BytesIO):
        taken = 0

        def read(self, n=-1):
            block = super().read(n)
            self.taken += len(block)
            return block

    body = b"note\nlatency_ms,\"model_name\"\r\n" + b"1.0,x\n" * 100_000
    file = Counting(body)
    assert runs.first_header(file) == b'latency_ms,"model_name"' and file.taken <= runs._HEAD_BYTES
    late = b"x" * (3 * runs._HEAD_BYTES) + b"\nmodel_name"
    assert runs.first_header(io.BytesIO(late)) == b"model_name"
    for none in (b"", b"a,b\n1,2\n", b"my_model_names\n"):
        assert runs.first_header(io.BytesIO(none)) is None


def test_scratch_paths_are_removed(spark):
    from pathlib import Path

    from bitledger import session

    kept, session._SCRATCH[:] = list(session._SCRATCH), []
    path = session.scratch_path(spark, "trial")
    spark.range(3).write.parquet(path)
    assert spark.read.parquet(path).count() == 3 and Path(path.removeprefix("file:")).exists()
    session.remove_scratch()
    assert not Path(path.removeprefix("file:")).exists()
    session._SCRATCH[:] = kept
    with pytest.raises(ValueError):
        session.remove_path(spark, "/tmp/elsewhere")


def test_json_takes_less_room_than_its_text(spark, tmp_path):
    rows = spark.range(20_000).selectExpr("id", "CONCAT('./results/model_', id % 7) AS model_name", "IF(id % 2 = 0, id / 7, NULL) AS latency_ms")
    tables.write_results_json(rows, f"{tmp_path}/out")
    text = rows.selectExpr("SUM(LENGTH(to_json(struct(*), map('ignoreNullFields', 'false'))) + 1) AS n").first().n
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("part-*")) < 0.3 * text
    back = spark.read.schema(rows.schema).json(f"{tmp_path}/out")
    assert back.exceptAll(rows).count() == 0 and back.count() == 20_000
