"""Windows cut block by block: their tokens move once, and each is that of the whole stream."""

import random
from pathlib import Path

import pytest

from bitledger.catalog.corpus import VOCABULARY
from bitledger.operators import corpus, subword


def placed(rows):
    """``id: (start, size)`` in order of the ids, null first; rows of one id share a place."""
    sizes = {}
    for key, tokens in rows:
        sizes[key] = sizes.get(key, 0) + len(tokens or [])
    out, start = {}, 0
    for key in sorted(sizes, key=lambda k: (k is not None, k)):
        out[key] = (start, sizes[key])
        start += sizes[key]
    return out, start


def brute(rows, stride, max_length):
    places, total = placed(rows)
    out, begin = [], 0
    while total:
        end = min(begin + max_length, total)
        pieces = []
        for key, tokens in rows:
            at, size = places[key]
            if key is not None and at < end and at + size > begin:
                pieces.append((max(begin, at), None if tokens is None else tokens[max(begin, at) - at : min(end, at + size) - at]))
        if pieces:
            gone = any(p is None for _, p in pieces)
            before = min(begin - stride + max_length, total) if begin else 0
            out.append((begin, end, end - before, None if gone else [t for _, p in sorted(pieces) for t in p]))
        if end == total:
            break
        begin += stride
    return out


def cut(spark, rows, stride, max_length, kind="string"):
    df = spark.createDataFrame(rows, f"doc_id bigint, tokens array<{kind}>")
    found = corpus.window_tokens(df, stride, max_length).collect()
    return sorted((r.begin, r.end, r.target_len, r.tokens) for r in found)


@pytest.mark.parametrize("stride, max_length, most", [(7, 20, 9), (20, 20, 60), (3, 50, 4), (16, 32, 200)])
def test_windows_reach_over_blocks(spark, monkeypatch, stride, max_length, most):
    monkeypatch.setattr(corpus, "BLOCK_TOKENS", 1)  # blocks as short as a window
    rng = random.Random(most)
    rows = [(3 * k - 40, [str(rng.randrange(99)) for _ in range(rng.choice([0, 1, rng.randrange(most)]))]) for k in range(120)]
    rng.shuffle(rows)
    assert cut(spark, rows, stride, max_length) == brute(rows, stride, max_length)


def test_repeated_and_null_ids(spark, monkeypatch):
    monkeypatch.setattr(corpus, "BLOCK_TOKENS", 1)
    rng = random.Random(8)
    rows = [(k // 2 if k < 30 else k, [rng.randrange(99) for _ in range(rng.randrange(9))]) for k in range(60)]
    rows += [rows[40], rows[40], (None, [1] * 25), (None, None), (70, None), (71, [4, 5]), (71, None)]
    assert cut(spark, rows, 8, 16, "int") == brute(rows, 8, 16)
    assert cut(spark, rows[:0], 8, 16) == [] and cut(spark, [(1, []), (2, None)], 8, 16) == []


def test_ids_of_text(spark, monkeypatch):
    monkeypatch.setattr(corpus, "BLOCK_TOKENS", 1)
    rows = [(name, [name, str(k)]) for k, name in enumerate(["b", "ä", "a", "日", "z", "Z"] + [f"k{n}" for n in range(30)])]
    df = spark.createDataFrame(rows, "doc_id string, tokens array<string>")
    stream = [t for _, tokens in sorted(rows, key=lambda r: r[0].encode()) for t in tokens]
    for r in corpus.window_tokens(df, 4, 8).collect():
        assert r.tokens == stream[r.begin : r.end]


def test_tokens_move_once(spark):
    df = spark.range(100).selectExpr("id AS doc_id", "split('a b c', ' ') AS tokens")
    plan = corpus.window_tokens(df)._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan and plan.count("FlatMapGroupsInArrow") == 1


@pytest.mark.skipif(not Path(VOCABULARY).exists(), reason="vocabularies are absent")
def test_sub_words_move_as_numbers(spark):
    docs = spark.createDataFrame([(0, "one text"), (1, None), (2, "and another")], "doc_id bigint, text string")
    numbers = subword.stored_tokens(docs, VOCABULARY, as_text=False)
    assert numbers.schema["tokens"].dataType.elementType.simpleString() == "int"
    text = {r.doc_id: r.tokens for r in subword.stored_tokens(docs, VOCABULARY).collect()}
    assert {r.doc_id: [str(k) for k in r.tokens] for r in numbers.collect()} == text
