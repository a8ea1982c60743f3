import random

import pytest

from bitledger.llm import mixing as mx
from tests.llm.helpers import documents, rows_by_id, sentence


def brute_targets(sizes, cycle=mx.CYCLE, top=mx.MAX_COPIES):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: cycle[k % len(cycle)] for k, s in enumerate(names)}
    total, target, full = sum(sizes.values()), {}, set()
    while True:
        free = [s for s in names if s not in full]
        rest = total - sum(top * sizes[s] for s in full)
        for s in free:
            target[s] = rest * weight[s] / sum(weight[f] for f in free)
        over = [s for s in free if target[s] > top * sizes[s]]
        if not over:
            return target | {s: top * sizes[s] for s in full}
        full.update(over)


def corpus(spark, seed=1, n=3000):
    rng = random.Random(seed)
    sources = ["hot"] * 6 + ["a", "B", "é", None, "small", "z1"]
    texts = []
    for _ in range(n):
        source = rng.choice(sources)
        if source == "small" and rng.random() < 0.9:
            source = "hot"
        texts.append((sentence(rng, rng.choice([0, 1, 5, 30, 200])), "en", source))
    return documents(spark, [*texts, (None, "en", "a"), ("", "en", "none"), ("\t\n ", "en", "none")])


def test_targets_equal_repeated_resharing_and_taken_words_come_near(spark):
    docs = corpus(spark)
    rows = list(rows_by_id(mx.mix_sources(docs)).values())
    assert len(rows) == docs.count()
    size = lambda t: len((t or "").split())
    sizes: dict = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + size(r["text"])
        assert r["mix_size"] == size(r["text"])
    want = brute_targets(sizes)
    for r in rows:
        assert r["mix_source_size"] == sizes[r["source"]]
        assert r["mix_target"] == pytest.approx(want[r["source"]], rel=1e-9)
        assert 0 <= r["mix_copies"] <= mx.MAX_COPIES
    for s in sizes:
        taken = sum(r["mix_size"] * r["mix_copies"] for r in rows if r["source"] == s)
        assert abs(taken - want[s]) <= 200, s


def test_reruns_and_other_partitions_agree(spark):
    docs = corpus(spark, n=500)
    first = {k: r["mix_copies"] for k, r in rows_by_id(mx.mix_sources(docs)).items()}
    again = {k: r["mix_copies"] for k, r in rows_by_id(mx.mix_sources(docs.repartition(13))).items()}
    assert first == again


def test_joined_thresholds_give_the_same(spark, monkeypatch):
    docs = corpus(spark, n=300)
    first = rows_by_id(mx.mix_sources(docs))
    monkeypatch.setattr(mx, "MAX_BROADCAST_SOURCES", 1)
    assert rows_by_id(mx.mix_sources(docs)) == first


def test_empty_and_wordless_tables(spark):
    docs = corpus(spark, n=5)
    assert mx.mix_sources(docs.limit(0)).count() == 0
    blank = rows_by_id(mx.mix_sources(documents(spark, [None, "", " "])))
    assert {(r["mix_size"], r["mix_target"]) for r in blank.values()} == {(0, 0.0)}


def test_repeated_rows_are_taken_alike(spark):
    docs = corpus(spark, n=50)
    rows = mx.mix_sources(docs.union(docs)).groupBy("doc_id").agg({"mix_copies": "min"}).count()
    both = mx.mix_sources(docs.union(docs)).select("doc_id", "mix_copies").distinct().count()
    assert rows == both


def test_columns_named_like_helpers_stay(spark):
    docs = documents(spark, ["a b c", "d", None]).selectExpr("*", "1 AS _place", "2 AS _source", "3 AS _whole", "4 AS _below", "5 AS mix_size")
    rows = mx.mix_sources(docs).collect()
    assert {(r._place, r._source, r._whole, r._below) for r in rows} == {(1, 2, 3, 4)}
    assert sorted(r.mix_size for r in rows) == [0, 1, 3]
