import math
import random

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from bitledger.functions.columns import words
from bitledger.operators import corpus, filters, prompts
from bitledger.operators.perplexity import corpus_perplexity
from bitledger.plans.perplexity_run import perplexity_result
from pyspark.sql import functions as F


def documents(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def random_documents(spark, n=60, seed=3, most=40):
    rng = random.Random(seed)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, most))) for _ in range(n)]
    return documents(spark, texts), " \n\n ".join(texts).split()


def windows(length, stride, max_length):
    """Windows one after the other, each looking at where the last one ended."""
    out, previous = [], 0
    for begin in range(0, length, stride):
        end = min(begin + max_length, length)
        out.append((begin, end, end - previous))
        previous = end
        if end == length:
            break
    return out


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 5000), min_size=1, max_size=20), st.integers(1, 600), st.integers(0, 600))
def test_windows_per_document(spark, lengths, stride, extra):
    df = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id long, n long")
    got = corpus.strided_windows(df, "n", stride, stride + extra).collect()
    assert sorted((r.doc_id, r.begin, r.end, r.target_len) for r in got) == [
        (i, *w) for i, n in enumerate(lengths) for w in windows(n, stride, stride + extra)
    ]


def test_known_windows(spark):
    df = spark.createDataFrame([(2049,)], "n long")
    got = sorted((r.begin, r.target_len) for r in corpus.strided_windows(df, "n").collect())
    assert got == [(0, 1024), (512, 512), (1024, 512), (1536, 1)]
    with pytest.raises(ValueError):
        corpus.strided_windows(df, "n", stride=1025)


@pytest.mark.parametrize("stride, max_length", [(7, 20), (20, 20), (50, 5000)])
def test_windows_of_the_stream(spark, stride, max_length):
    df, stream = random_documents(spark)
    tokens = corpus.with_tokens(df)
    want = windows(len(stream), stride, max_length)
    offsets = corpus.concat_corpus(tokens)
    got = corpus.corpus_windows(offsets, stride, max_length).collect()
    assert sorted((r.begin, r.end, r.target_len) for r in got) == want
    cut = corpus.window_tokens(tokens, stride, max_length).collect()
    assert sorted((r.begin, r.end, r.target_len) for r in cut) == want
    assert all(r.tokens == stream[r.begin : r.end] for r in cut)


def unigram(stream):
    counts = pd.Series(stream).value_counts()
    total = len(stream) + len(counts)
    return {t: -math.log((c + 1) / total) for t, c in counts.items()}


def stream_perplexity(stream, stride, max_length):
    """Losses token by token: the first token of a window has none."""
    loss, total = unigram(stream), 0.0
    for begin, end, target in windows(len(stream), stride, max_length):
        scored = [loss[t] for t in stream[max(end - target, begin + 1) : end]]
        total += sum(scored) / len(scored) * target
    return math.exp(total / len(stream))


@pytest.mark.parametrize("stride, max_length, n", [(7, 20, 60), (64, 128, 60), (10, 5000, 60), (5, 9, 400)])
def test_unigram_perplexity(spark, stride, max_length, n):
    df, stream = random_documents(spark, n=n, most=8 if n > 100 else 40)
    row = corpus_perplexity(corpus.with_tokens(df), stride=stride, max_length=max_length).first()
    assert row.n_tokens == len(stream)
    assert row.perplexity == pytest.approx(stream_perplexity(stream, stride, max_length), abs=1e-4)


@pytest.mark.parametrize("length, n", [(7, 30), (50, 60), (5000, 20)])
def test_windows_that_do_not_overlap(spark, length, n):
    df, stream = random_documents(spark, n=n)
    loss, total, weight = unigram(stream), 0.0, 0
    for begin in range(0, len(stream), length):
        window = stream[begin : begin + length]
        if len(window) > 1:
            total += sum(loss[t] for t in window[1:]) / (len(window) - 1) * len(window)
            weight += len(window)
    row = corpus_perplexity(corpus.with_tokens(df), stride=length, max_length=length).first()
    assert row.n_tokens == len(stream)
    assert row.perplexity == pytest.approx(math.exp(total / weight), abs=1e-4)


def test_perplexity_with_mostly_empty_documents(spark):
    df = documents(spark, [""] * 50 + ["a b c d e f a b", "", "c c c d"])
    stream = "a b c d e f a b c c c d".split()
    row = corpus_perplexity(corpus.with_tokens(df), stride=3, max_length=6).first()
    assert row.perplexity == pytest.approx(stream_perplexity(stream, 3, 6), abs=1e-4)


def test_scorer_gives_the_same(spark):
    df, stream = random_documents(spark)
    loss = unigram(stream)

    def scorer(tokens, targets):
        means = []
        for window, n in zip(tokens, targets):
            scored = [loss[t] for t in list(window)[max(len(window) - n, 1) :]]
            means.append(sum(scored) / len(scored))
        return pd.Series(means)

    tokens = corpus.with_tokens(df)
    scored = corpus_perplexity(tokens, scorer, 16, 48).first()
    assert scored.perplexity == pytest.approx(corpus_perplexity(tokens, None, 16, 48).first().perplexity, abs=2e-4)


def test_perplexity_result_and_empty_corpus(spark):
    df = documents(spark, ["a b a"])
    row = perplexity_result(spark, "m", "awq", "x", {"wikitext2": df}, max_length=8, stride=4).first()
    assert (row.model, row.method, row.dataset) == ("m", "awq", "x") and row.perplexity > 1
    assert corpus_perplexity(corpus.with_tokens(documents(spark, [" "]))).first().perplexity is None


def test_words_are_those_of_python(spark):
    texts = ["", " \x1c  ", "a", " a\x1db　 c\n", "x​y z", "\tq\x0bw\x0c"]
    df = documents(spark, texts)
    rows = df.select("doc_id", words(F.col("text")).alias("w"), words(F.col("text"), 2).alias("two")).collect()
    for row in rows:
        assert row.w == texts[row.doc_id].split() and row.two == texts[row.doc_id].split()[:2]
    kept = {r.doc_id for r in filters.filter_blank_text(df).collect()}
    assert kept == {i for i, t in enumerate(texts) if t.strip()}


def test_heads_and_samples(spark):
    texts = ["x" * (40 + i % 30) + " " for i in range(400)]
    df = documents(spark, texts)
    long = [i for i, t in enumerate(texts) if len(t.strip()) > 50]
    assert sorted(r.doc_id for r in corpus.filter_head(df).collect()) == long[:128]
    assert sorted(r.doc_id for r in corpus.head_filter_head(df).collect()) == [i for i in long if i < 256][:128]
    first = [r.doc_id for r in corpus.seeded_sample(df, 50).collect()]
    assert first == [r.doc_id for r in corpus.seeded_sample(df.repartition(5), 50).collect()]
    assert len(set(first)) == 50 and first != sorted(first)
    assert first != [r.doc_id for r in corpus.seeded_sample(df, 50, seed=7).collect()]
    with pytest.raises(Exception, match="sample of 512 wanted"):
        corpus.seeded_sample(df, 512).collect()
    assert corpus.seeded_sample(df, 512, strict=False).count() == 400


def test_tokenizer_is_pluggable(spark):
    def letters(texts: pd.Series) -> pd.Series:
        return texts.map(list)

    row = corpus.calibration_tokens(documents(spark, ["abcd"]), 3, letters).first()
    assert row.tokens == ["a", "b", "c"] and row.asDict().keys() == {"doc_id", "tokens"}


def test_build_prompt(spark):
    df = spark.createDataFrame([(1, "The sky is blue "), (2, "  ")], "item_id long, text string")
    rows = prompts.build_prompt(df, input_len=10, batch_size=3).collect()
    assert [r.item_id for r in rows] == [1, 1, 1]
    assert rows[0].tokens == ("The sky is blue " * 3).split()[:10]
    fixed_repeats = prompts.build_prompt(df, input_len=256, repeats=10).first()
    assert fixed_repeats.tokens == ("The sky is blue " * 10).split()


def test_render_chat(spark):
    turns = spark.createDataFrame(
        [(1, 1, "assistant", "yes"), (1, 0, "user", "ok?"), (2, 0, "user", "x")],
        "conv_id long, turn long, role string, text string",
    )
    got = {r.conv_id: r.prompt for r in prompts.render_chat(turns).collect()}
    assert got[1] == (
        "<|im_start|>user\nok?<|im_end|>\n<|im_start|>assistant\nyes<|im_end|>\n<|im_start|>assistant\n"
    )
    assert prompts.render_chat(turns, False).where("conv_id = 2").first().prompt.endswith("<|im_end|>\n")


def test_fewshot_never_uses_the_item(spark):
    items = spark.createDataFrame([(i, f"t{i}") for i in range(6)], "item_id long, text string")
    rows = prompts.fewshot_prompts(items, items, k=3).collect()
    for row in rows:
        parts = row.prompt.split("\n\n")
        assert len(parts) == 4 and parts[-1] == f"t{row.item_id}" and parts[-1] not in parts[:-1]
    small = prompts.fewshot_prompts(items, items.where("item_id < 2"), k=3)
    assert {r.item_id: r.n_examples for r in small.collect()} == {0: 1, 1: 1, 2: 2, 3: 2, 4: 2, 5: 2}
    assert prompts.fewshot_prompts(items, items).first().prompt == "t0"
