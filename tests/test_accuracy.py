import pytest

from bitledger.functions import fixed_values as fixed
from bitledger.operators import accuracy, jobs
from bitledger.plans.accuracy_tables import accuracy_by_method

METRICS = "label string, part string, file_name string, file_mtime bigint, task string, metric_key string, value double"


def frame(spark, rows):
    return spark.createDataFrame(rows, METRICS)


def test_present_null_value_wins_over_next_key(spark):
    rows = [
        ("l", "gsm8k", "f", 1, "gsm8k", "exact_match,flexible-extract", None),
        ("l", "gsm8k", "f", 1, "gsm8k", "exact_match,strict-match", 0.5),
        ("l", "gsm8k", "f", 1, "gsm8k", "exact_match_stderr,strict-match", 0.1),
        ("m", "gsm8k", "f", 1, "gsm8k", "exact_match,strict-match", 0.5),
        ("m", "gsm8k", "f", 1, "gsm8k", "exact_match_stderr,strict-match", 0.1),
    ]
    picked = {r.label: (r.metric_key, r.value, r.stderr) for r in accuracy.pick_task_metric(frame(spark, rows)).collect()}
    assert picked == {
        "l": ("exact_match,flexible-extract", None, None),
        "m": ("exact_match,strict-match", 0.5, 0.1),
    }


def test_later_part_replaces_whole_task(spark):
    rows = [
        ("l", "likelihood", "f", 1, "mmlu", "acc,none", 0.1),
        ("l", "likelihood", "f", 1, "mmlu", "acc_stderr,none", 0.01),
        ("l", "ifeval", "g", 1, "mmlu", "other,none", 0.9),
    ]
    merged = accuracy.merge_parts(frame(spark, rows)).collect()
    assert [(r.metric_key, r.value) for r in merged] == [("other,none", 0.9)]


def test_one_pass_equals_merge_then_pick(spark):
    rows = [
        ("l", "likelihood", "f", 1, "mmlu", "acc,none", 0.1),
        ("l", "ifeval", "g", 1, "mmlu", "other,none", 0.9),
        ("l", "likelihood", "f", 1, "gsm8k", "exact_match,strict-match", 0.2),
        ("l", "gsm8k", "h", 1, "gsm8k", "exact_match,flexible-extract", None),
        ("l", "gsm8k", "h", 1, "gsm8k", "exact_match,strict-match", 0.3),
        ("m", "ifeval", "g", 1, "ifeval", "inst_level_strict_acc,none", 0.4),
        ("m", "ifeval", "g", 1, "ifeval", "inst_level_strict_acc_stderr,none", 0.04),
        ("m", "ifeval", "g", 1, "ifeval", None, None),
    ]
    metrics = frame(spark, rows)
    steps = accuracy.pick_task_metric(accuracy.merge_parts(metrics)).drop("metric_key")
    assert sorted(accuracy.merge_and_pick(metrics).collect()) == sorted(steps.collect())
    assert {(r.label, r.task): (r.value, r.stderr) for r in steps.collect()} == {
        ("l", "gsm8k"): (None, None), ("m", "ifeval"): (0.4, 0.04),
    }


def test_newest_file_and_ties(spark):
    rows = [
        ("l", "gsm8k", "x_l_gsm8k_2.json", 5, None, None, None),
        ("l", "gsm8k", "x_l_gsm8k.json", 5, None, None, None),
        ("l", "gsm8k", "x_l_gsm8k_1.json", 4, None, None, None),
        ("l", "ifeval", "x_l_ifeval.json", 4, None, None, None),
        ("l", "ifeval", "x_l_ifeval_9.json", 6, None, None, None),
    ]
    newest = {r.part: r.file_name for r in accuracy.latest_result_file(frame(spark, rows)).collect()}
    assert newest == {"gsm8k": "x_l_gsm8k.json", "ifeval": "x_l_ifeval_9.json"}


@pytest.fixture
def table(spark):
    rows = []
    for label, shift in [("awqW4A16", 0.0), ("rtnW4A16", 0.1)]:
        for task, keys in fixed.TASK_METRICS:
            part = task if task in fixed.PARTS else "likelihood"
            rows.append((label, part, f"{label}_{part}.json", 1, task, keys[0], 0.5 + shift))
    rows.append(("gptqW4A16", "likelihood", "g.json", 1, "mmlu", "acc,none", 0.25))
    rows.append(("smoothW8A8", "ifeval", "empty.json", 1, None, None, None))
    return accuracy_by_method(frame(spark, rows))


def test_table_rows_statuses_and_audit(table):
    rows = {r.method_label: r for r in table.collect()}
    assert list(sorted(r.ord for r in rows.values())) == [0, 1, 2, 3, 4, 5]
    assert rows["awqW4A16"]._status == "OK" and rows["awqW4A16"].avg == 0.5
    assert rows["gptqW4A16"]._status == "PARTIAL (1/8)" and rows["gptqW4A16"]._gsm8k_file == "MISSING"
    assert rows["rtnW8A16"]._status == "MISSING" and rows["rtnW8A16"]._lh_file is None
    assert rows["rtnW8A16"].n_tasks_completed is None
    empty = rows["smoothW8A8"]
    assert (empty._status, empty._ifeval_file, empty.avg) == ("PARTIAL (0/8)", "empty.json", None)


def test_absent_baseline_gives_null_deltas(table):
    rows = table.collect()
    assert len(rows) == 6 and all(r.delta_vs_fp16_pp is None for r in rows)


def test_delta_uses_rounded_averages(spark):
    df = spark.createDataFrame([("fp16", 0.5), ("a", 0.4321), ("b", None)], "label string, avg double")
    deltas = {r.label: r.delta for r in accuracy.delta_vs_baseline(df, "label", "fp16", "avg").collect()}
    assert deltas == {"fp16": 0.0, "a": -6.79, "b": None}


def test_jobs(spark):
    models = spark.createDataFrame([("a", True), ("b", True), ("c", False)], "label string, model_present boolean")
    valid = spark.createDataFrame(
        [("a", p) for p in fixed.PARTS] + [("a", "gsm8k"), ("b", "gsm8k")], "label string, part string"
    )
    pending = {(r.label, r.part) for r in jobs.pending_jobs(models, valid).collect()}
    assert len(pending) == 5 and ("b", "gsm8k") not in pending
    assert jobs.pending_jobs(models, valid, force=True).count() == 9
    assert [r.label for r in jobs.completed_groups(valid).collect()] == ["a"]
    counts = {r.status: r.n for r in jobs.status_counts(jobs.job_statuses(models, valid)).collect()}
    assert counts == {"ok": 4, "failed": 2, "skipped": 3}
    # A model that is there but has no result at all has failed.
    there = models.withColumn("model_present", models.model_present | (models.label == "c"))
    counts = {r.status: r.n for r in jobs.status_counts(jobs.job_statuses(there, valid)).collect()}
    assert counts == {"ok": 4, "failed": 5}


def test_expected_labels_keep_their_order(spark):
    df = spark.createDataFrame([("fp16", 1)], "label string, n int")
    rows = accuracy.with_expected(df, accuracy.method_dimension(spark)).orderBy("ord").collect()
    assert [r.label for r in rows] == [row[0] for row in fixed.METHOD_ROWS]
    assert rows[0].n == 1 and all(r.n is None for r in rows[1:])
