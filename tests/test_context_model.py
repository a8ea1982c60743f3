"""The bigram model and its perplexity against plain Python over put-together windows."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from bitledger.operators import context_model as cm
from bitledger.operators.corpus import with_tokens


def stream(texts):
    return [w for t in texts for w in (t or "").split()]


def model_of(words, d=cm.DISCOUNT):
    pairs = Counter(zip(words, words[1:]))
    context, followers = Counter(), Counter()
    for (v, _), n in pairs.items():
        context[v] += n
        followers[v] += 1
    single = Counter(words)
    total = len(words) + len(single) + 1

    def probability(v, w):
        p = (single[w] + 1) / total
        return p if v not in context else max(pairs[v, w] - d, 0) / context[v] + d * followers[v] / context[v] * p

    return probability


def windowed(words, probability, stride, length):
    """As the loop over windows has it: labels of old tokens are masked, the first has none."""
    losses, weights, previous = [], [], 0
    for begin in range(0, len(words), stride):
        end = min(begin + length, len(words))
        new = end - previous
        targets = [k for k in range(max(end - new, begin + 1), end)]
        if targets:
            losses.append(sum(-math.log(probability(words[k - 1], words[k])) for k in targets) / len(targets))
            weights.append(new)
        previous = end
        if end == len(words):
            break
    return math.exp(sum(a * b for a, b in zip(losses, weights)) / sum(weights))


def docs(spark, texts):
    return with_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))


def corpus(seed, n=60):
    rng = random.Random(seed)
    words = "the a river stone cloud runs falls over under and".split()
    return [None, "", "  "] + [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 25))) for _ in range(n)] + ["", "one"]


@pytest.mark.parametrize("stride, length", [(8, 16), (16, 16), (5, 16), (1, 3), (1000, 2000), (7, 7)])
def test_perplexity_equals_a_loop_over_windows(spark, stride, length):
    words = stream(corpus(1))
    row = cm.context_perplexity(docs(spark, corpus(1)), stride=stride, max_length=length).first()
    assert row.n_tokens == len(words)
    assert row.perplexity == pytest.approx(windowed(words, model_of(words), stride, length), abs=1e-4)


@pytest.mark.parametrize("stride", [4, 12])
def test_another_stream_with_unseen_words(spark, stride):
    texts = ["the river unseen words", "over the stone", "", "nothing known here", "a cloud"]
    model = cm.fit_bigrams(docs(spark, corpus(2)))
    row = cm.context_perplexity(docs(spark, texts), model, stride, 12).first()
    want = windowed(stream(texts), model_of(stream(corpus(2))), stride, 12)
    assert row.perplexity == pytest.approx(want, abs=1e-3)
    losses = {r.doc_id: r for r in cm.document_losses(docs(spark, [*texts, None]), model).collect()}
    p = model_of(stream(corpus(2)))
    for k, text in enumerate([*texts, None]):
        words = (text or "").split()
        assert losses[k].n_tokens == len(words)
        assert losses[k].loss == pytest.approx(sum(-math.log(p(v, w)) for v, w in zip(words, words[1:])))


def test_probabilities_add_up_to_one(spark):
    model = cm.fit_bigrams(docs(spark, corpus(3)))
    words = [r.token for r in model.unigrams.collect()]
    grid = spark.createDataFrame([(v, w) for v in words + ["new"] for w in words + ["other"]], "prev string, token string")
    sums = cm.pair_losses(grid, model).groupBy("prev").agg(F.sum(F.exp(-F.col("loss"))).alias("s")).collect()
    assert all(r.s == pytest.approx(1) for r in sums) and len(sums) == len(words) + 1


def test_pairs_cross_documents_once(spark):
    rows = {(r.prev, r.token): r.n for r in cm.stream_pairs(docs(spark, ["a b", "", None, "b", "b a b"])).collect()}
    assert rows == {("a", "b"): 2, ("b", "b"): 2, ("b", "a"): 1}


def test_empty_and_single(spark):
    assert cm.context_perplexity(docs(spark, [])).first().asDict() == {"perplexity": None, "n_tokens": 0}
    assert cm.context_perplexity(docs(spark, ["", "one"])).first().asDict() == {"perplexity": None, "n_tokens": 1}
    assert cm.context_perplexity(docs(spark, ["one"]), stride=4, max_length=4).first().asDict() == {"perplexity": None, "n_tokens": 1}
    for bad in ((0, 4), (5, 4)):
        with pytest.raises(ValueError):
            cm.context_perplexity(docs(spark, ["a"]), stride=bad[0], max_length=bad[1])


def test_context_beats_single_counts(spark):
    texts = ["over the river and under the stone " * 5] * 4
    with_context = cm.context_perplexity(docs(spark, texts)).first().perplexity
    from bitledger.operators.perplexity import corpus_perplexity

    assert with_context < 0.5 * corpus_perplexity(docs(spark, texts)).first().perplexity


@pytest.mark.parametrize("texts", [["a b c d"], ["a b c d e"], ["a b", "", "c d", "e f", "g h", "a"], ["a"] * 9, ["a b c d e f g h i j"]])
def test_windows_that_do_not_overlap_are_not_put_together(spark, texts, monkeypatch):
    from bitledger.operators import corpus as windows

    def refuse(*_):
        raise AssertionError("pairs of windows were put together")

    monkeypatch.setattr(windows, "window_tokens", refuse)
    monkeypatch.setattr(cm, "window_tokens", refuse, raising=False)
    for length in (4, 1):
        row = cm.context_perplexity(docs(spark, texts), stride=length, max_length=length).first()
        want = windowed(stream(texts), model_of(stream(texts)), length, length) if length > 1 else None
        assert row.n_tokens == len(stream(texts)) and row.perplexity == (want and pytest.approx(want, abs=1e-4))


def test_steps_of_the_model_read_no_text_twice(spark):
    model = cm.fit_bigrams(docs(spark, corpus(4)))
    for table in (model.pairs, model.contexts, model.unigrams):
        assert "split(" not in table._jdf.queryExecution().optimizedPlan().toString()
