import pytest

from bitledger.operators.filters import dropna_metric
from bitledger.operators.pivots import pivot_metric, pivot_perplexity
from bitledger.plans.results import merge_results

BENCH = "model_name string, method string, hardware string, latency_ms double, peak_memory_mb double, perplexity double"


@pytest.fixture
def bench(spark):
    return spark.createDataFrame(
        [
            ("./r/m_awq_w4a16", "x", "CPU", 10.0, 1.0, 99.0),
            ("./r/m_awq_w4a16", "x", "CPU", 20.0, None, 99.0),
            ("./r/m_fp16", "x", "GPU", 5.0, 2.0, 99.0),
        ],
        BENCH,
    )


@pytest.fixture
def ppl(spark):
    return spark.createDataFrame(
        [("m_awq_w4a16", 7.0, "a"), ("m_awq_w4a16", 8.0, "b"), ("alone_gptq", 9.0, "a")],
        "model_dir string, perplexity double, ppl_dataset string",
    )


def test_full_outer_many_to_many(bench, ppl):
    rows = merge_results(bench, ppl).collect()
    found = sorted((r.model_dir, r.latency_ms or 0.0, r.perplexity or 0.0, r.method) for r in rows)
    assert found == [
        ("alone_gptq", 0.0, 9.0, "gptq"),
        ("m_awq_w4a16", 10.0, 7.0, "awq"),
        ("m_awq_w4a16", 10.0, 8.0, "awq"),
        ("m_awq_w4a16", 20.0, 7.0, "awq"),
        ("m_awq_w4a16", 20.0, 8.0, "awq"),
        ("m_fp16", 5.0, 0.0, "fp16"),
    ]


def test_own_perplexity_only_without_results(bench, ppl):
    assert {r.perplexity for r in merge_results(bench, ppl.limit(0)).collect()} == {99.0}
    assert {r.perplexity for r in merge_results(bench, None).collect()} == {99.0}


def test_only_perplexity(ppl):
    assert merge_results(None, ppl).count() == 3


def test_presummed_pivot_equals_pivot_of_the_join(spark, bench, ppl):
    from bitledger.operators.merge import with_labels, with_model_dir

    values = ["AWQ (W4A16)", "FP16", "GPTQ"]
    joined = with_labels(merge_results(bench, ppl))
    direct = pivot_metric(joined, "perplexity", "model_family", "method_scheme", values)
    presummed = pivot_perplexity(with_model_dir(bench), ppl, values)
    assert sorted(direct.collect()) == sorted(presummed.collect())


def test_pivot_finds_values_itself(bench):
    table = pivot_metric(bench, "latency_ms", "hardware", "model_name")
    assert table.columns == ["hardware", "./r/m_awq_w4a16", "./r/m_fp16"]


def test_absent_metric_gives_no_rows(bench):
    assert dropna_metric(bench, ["no_such_metric"]).count() == 0
