import random
import zlib
from collections import Counter

import numpy as np
import pytest

from bitledger.llm import language_model as lm
from tests.llm.helpers import documents, rows_by_id, sentence

FIRST = "the a der die un une".split()
NEXT = {"the": "house river stone", "a": "cloud leaf", "der": "baum stein", "die": "wolke", "un": "arbre", "une": "pierre rose"}


def text(rng, n):
    out = []
    for _ in range(n):
        w = rng.choice(FIRST)
        out += [w, rng.choice(NEXT[w].split())]
        if rng.random() < 0.1:
            out.append(f"x{rng.randrange(5000)}")
    return " ".join(out)


def is_held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 7 == 2


def test_counts_and_base_scores_equal_brute_force_and_context_helps(spark):
    rng = random.Random(1)
    texts = [text(rng, rng.randrange(1, 120)) for _ in range(600)] + [None, "", "New WORDS only"]
    found = rows_by_id(lm.score_held_out(documents(spark, texts)))
    words = [(t or "").lower().split() + [""] for t in texts]
    counts = Counter(w for k, ws in enumerate(words) if not is_held_out(k) for w in ws)
    n, v = sum(counts.values()), len(counts)
    for k, ws in enumerate(words):
        row = found[k]
        assert row["held_out"] == is_held_out(k) and row["train_tokens"] == n
        assert (row["n_tokens"], row["n_known"]) == (len(ws), sum(w in counts for w in ws))
        assert row["base_score"] == pytest.approx(sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in ws))
        assert row["score"] < 0
    held = [r for r in found.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > 0.93 * sum(r["base_score"] for r in held)
    unigram = sum(found[k]["score"] for k in range(600) if is_held_out(k))
    shuffled = [" ".join(rng.sample(ws[:-1], len(ws) - 1)) for ws in words[:600]]
    docs = documents(spark, [s if is_held_out(k) else texts[k] for k, s in enumerate(shuffled)])
    again = rows_by_id(lm.score_held_out(docs))
    assert unigram > sum(again[k]["score"] for k in range(600) if is_held_out(k))


def test_probabilities_add_up_to_one(spark):
    rng = random.Random(2)
    docs = documents(spark, [text(rng, 30) for _ in range(60)])
    counts = lm.count_words(docs)
    vocabulary = lm.Vocabulary(counts)
    weights = lm.train(docs, vocabulary)
    codes = lm._Codes(vocabulary.common)
    rows, _, _ = lm.features([["the", "river", "xyz"]] and [[b"the", b"river", b"xyz"]], codes)
    shares = np.exp(lm.class_logs(weights, vocabulary.bias, rows))
    assert np.allclose(shares.sum(axis=1), 1, atol=1e-5)
    table = {bytes(r.w): r.c for r in counts.collect()}
    classes = np.array([codes[w] & 31 for w in table])
    inside = 10 ** vocabulary.in_class(classes, np.array(list(table.values())))
    unseen = 10 ** vocabulary.in_class(np.arange(lm.CLASSES), np.zeros(lm.CLASSES))
    for k in range(lm.CLASSES):
        total = inside[classes == k].sum() + (unseen[k] if k > lm.COMMON_WORDS else 0)
        assert total == pytest.approx(1) or (k <= lm.COMMON_WORDS and not (classes == k).any())


def test_class_groups_agree_with_spark(spark):
    words = [b"a", b"ab", b"abc", b"abcd", "größe".encode()]
    rows = spark.createDataFrame([(bytearray(w),) for w in words], "w binary").select(lm._group_column(lm.F.col("w"))).collect()
    assert [r[0] for r in rows] == [lm.class_group(w) for w in words]


def test_features_of_places():
    codes = lm._Codes({})
    rows, classes, of = lm.features([[b"aa", b"bb"], []], codes)
    assert of.tolist() == [0, 0, 0, 1] and classes[[2, 3]].tolist() == [0, 0]
    assert rows[0].tolist() == [0, (codes[b"aa"] >> 5) % 4096, (codes[b"bb"] >> 5) % 4096, 0]
    assert rows.max() < lm.ROWS and rows.min() >= 0


def test_empty_tables_and_repeats(spark):
    docs = documents(spark, ["a b", None])
    assert lm.score_held_out(docs.limit(0)).count() == 0
    assert lm.score_held_out(docs.union(docs)).count() == 4
    only = [k for k in range(50) if is_held_out(k)][:1]
    row = lm.score_held_out(documents(spark, ["a"] * 50).where(f"doc_id = {only[0]}")).first()
    assert (row.train_tokens, row.n_known, row.base_score) == (0, 0, 0.0) and row.score <= 0
