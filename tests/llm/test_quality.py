import math
import random
from collections import defaultdict

import numpy as np
import pytest

from bitledger.llm import quality as ql
from tests.llm.helpers import documents, rows_by_id, sentence


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def brute_logs(trusted, texts):
    """log10 probability of each text under an interpolated modified Kneser-Ney trigram model."""
    counts = defaultdict(int)
    chars = defaultdict(int)
    for text in trusted:
        for c in text:
            chars[c] += 1
    top = sorted(chars, key=lambda c: (-chars[c], ord(c)))[: ql.CLASSES - 2]
    ids = {c: k + 2 for k, c in enumerate(top)}

    def grams(text):
        seq = [1, 1, *[ids.get(c, 0) for c in text], 1]
        return [tuple(seq[i : i + 3]) for i in range(len(seq) - 2)]

    for text in trusted:
        for g in grams(text):
            counts[g] += 1
    pair, single = defaultdict(int), defaultdict(int)
    for _, v, w in counts:
        pair[v, w] += 1
    for _, w in pair:
        single[w] += 1

    def discount(table):
        d = ql.discounts({k: sum(c == k for c in table.values()) for k in (1, 2, 3, 4)})
        return lambda c: d[min(c, 3)]

    d3, d2, d1 = discount(counts), discount(pair), discount(single)

    def mix(table, prefix, w, d, lower):
        row = {k[-1] if isinstance(k, tuple) else k: c for k, c in table.items() if prefix is None or k[:-1] == prefix}
        total = sum(row.values())
        if not total:
            return lower
        c = row.get(w, 0)
        return (c - d(c)) / total + sum(d(x) for x in row.values()) / total * lower

    def p(u, v, w):
        p1 = mix(single, None, w, d1, 1 / ql.CLASSES)
        p2 = mix(pair, (v,), w, d2, p1)
        return mix(counts, (u, v), w, d3, p2)

    return [sum(math.log10(p(*g)) for g in grams(text)) for text in texts]


def test_perplexity_equals_brute_force(spark):
    rng = random.Random(1)
    texts = [sentence(rng, n) for n in (3, 8, 20, 5)] + ["XX!! YY", "é" * 300, "a"]
    docs = documents(spark, texts)
    found = rows_by_id(ql.judged(docs, labels(spark, [(k, 1, 0) for k in range(4)] + [(4, 0, 0), (5, 1, 1)])))
    for k, want in enumerate(brute_logs(texts[:4], texts)):
        assert found[k]["n_tokens"] == len(texts[k]) + 1
        assert found[k]["perplexity"] == pytest.approx(10 ** (-want / (len(texts[k]) + 1)), rel=1e-9)


def test_probabilities_of_a_context_add_up_to_one():
    rng = np.random.default_rng(0)
    p2 = rng.random((ql.CLASSES, ql.CLASSES))
    p2 /= p2.sum(axis=1, keepdims=True)
    codes = rng.choice(ql._CODES, 500, replace=False)
    table = ql.shard_table(3, codes, rng.integers(1, 9, 500), p2, np.array([0, 0.5, 0.9, 1.2]))
    assert np.allclose((10.0**table).reshape(-1, ql.CLASSES).sum(axis=1), 1)


def test_clean_text_stays_and_noise_goes(spark):
    rng = random.Random(2)
    clean = [sentence(rng, rng.randrange(20, 120)) for _ in range(80)]
    noise = [sentence(rng, 60).upper().replace(" ", "!! ") for _ in range(10)]
    docs = documents(spark, [*clean, *noise, None, ""])
    marks = labels(spark, [(k, 1, 0) for k in range(40)] + [(k, 0, 0) for k in range(80, 85)])
    kept = {r.doc_id for r in ql.keep_quality(docs, marks).collect()}
    assert kept == set(range(80))
    assert ql.keep_quality(docs, marks).columns == docs.columns


def test_repeats_nulls_and_empty_tables(spark):
    docs = documents(spark, ["one two three", ("four five", None), None])
    marks = labels(spark, [(0, 1, None), (0, 1, 0), (None, 1, 0)])
    twice = docs.union(docs).union(docs.selectExpr("CAST(NULL AS bigint)", "text", "lang", "source", "n_chars", "extra"))
    rows = ql.judged(twice, marks).collect()
    assert len(rows) == 9
    assert len({(r.doc_id, r.perplexity) for r in rows}) == 6
    assert all(r.keep for r in rows if r.doc_id == 0)
    assert not any(r.keep for r in rows if r.perplexity is None)
    assert ql.judged(docs.limit(0), marks).count() == 0
    untrained = rows_by_id(ql.judged(docs, marks.limit(0)))
    assert untrained[0]["keep"] and untrained[0]["limit"] is None and not untrained[2]["keep"]


def test_counts_above_a_byte_survive_packing():
    keys, codes, times = [5, -7], [np.array([1, 300, 2000]), np.array([300])], [np.array([1, 254, 255]), np.array([100_000])]
    got = {}
    for shard, blob in ql._pack(keys, codes, times):
        ids, runs, code, count = ql._unpack(blob)
        at = 0
        for key, n in zip(ids.tolist(), runs.tolist()):
            for c, t in zip(code[at : at + n], count[at : at + n]):
                got[key, shard, int(c)] = int(t)
            at += n
    want = {}
    for key, code, count in zip(keys, codes, times):
        shard, inner = ql._shards(code)
        want |= {(key, int(s), int(c)): int(t) for s, c, t in zip(shard, inner, count)}
    assert got == want


def test_labelled_low_quality_and_toxic_rows_go(spark):
    folder = "/root/testdata/sf0.1"
    marks = spark.read.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet").join(marks.select("doc_id"), "doc_id", "left_semi")
    rows = ql.judged(docs, marks).where("perplexity IS NOT NULL").join(marks, "doc_id").collect()

    def gone(quality, toxic):
        keeps = [r.keep for r in rows if (r.quality, r.toxic) == (quality, toxic)]
        return keeps.count(False) / len(keeps)

    # Few insults in long good prose are seen, and clean text is lost to the quantiles only.
    assert gone(0, 0) > 0.98 and gone(0, 1) > 0.98
    assert gone(1, 1) > 0.6
    assert gone(1, 0) < 0.025


def test_limits_are_quantiles_of_each_language(spark):
    rng = random.Random(4)
    texts = [(sentence(rng, 60), lang) for lang in ("en", "de") for _ in range(200)]
    rows = ql.judged(documents(spark, texts), labels(spark, [(k, 1, 0) for k in range(400)])).collect()
    for lang in ("en", "de"):
        own = [r for r in rows if r.lang == lang and 150 < r.n_tokens <= 500]
        found = sorted(r.perplexity for r in own)
        assert own[0].limit == found[math.ceil(0.99 * len(found)) - 1]
        assert sum(not r.keep for r in own) <= 0.02 * len(own)


def test_one_easy_word_repeated_goes(spark):
    rng = random.Random(5)
    texts = [sentence(rng, 60) for _ in range(200)] + ["frost " * 50, "amber " * 60]
    found = rows_by_id(ql.judged(documents(spark, texts), labels(spark, [(k, 1, 0) for k in range(200)])))
    for k in (200, 201):
        row = found[k]
        assert row["perplexity"] <= row["limit"]
        assert not row["keep"]
    assert sum(not found[k]["keep"] for k in range(200)) <= 8


def test_columns_named_like_helpers_stay(spark):
    rng = random.Random(3)
    docs = documents(spark, [sentence(rng, 30) for _ in range(40)]).selectExpr("*", "7 AS _key", "8 AS _kept")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(40)], "doc_id bigint, quality int, toxic int")
    kept = ql.keep_quality(docs, labels)
    assert kept.columns == docs.columns and {(r._key, r._kept) for r in kept.collect()} == {(7, 8)}


@pytest.mark.parametrize("at_most", [10, 2_000_000])
def test_the_model_is_counted_on_all_trusted_documents(spark, monkeypatch, at_most):
    monkeypatch.setattr(ql, "MAX_BROADCAST_IDS", at_most)
    docs = spark.range(0, 70_000).selectExpr("id AS doc_id", "'a' AS lang", "CAST(id AS STRING) AS text")
    marks = spark.range(0, 70_000, 2).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic")
    assert ql.trusted_documents(docs, marks).count() == 35_000
