"""Texts with more characters than a Latin alphabet: each counts as itself, in all trigrams."""

import random
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline as cp  # noqa: E402

from bitledger.llm import quality as ql  # noqa: E402
from tests.llm.helpers import documents, rows_by_id  # noqa: E402
from tests.llm.test_quality import brute_logs, labels  # noqa: E402

# Words of a script with 900 characters, and some of others.
SCRIPT = [chr(0x4E00 + 7 * k) for k in range(900)]
VOCABULARY = ["".join(SCRIPT[3 * k : 3 * k + 3]) for k in range(300)] + ["tea", "naïve", "🙂🙂", "слово"]


def prose(rng, n):
    return "".join(rng.choice(VOCABULARY) for _ in range(n))


def noise(rng, n):
    return "".join(rng.choice(SCRIPT) for _ in range(3 * n))


def test_every_character_is_a_class(spark, monkeypatch):
    rng = random.Random(6)
    texts = [prose(rng, 90) for _ in range(5)] + [noise(rng, 30), "Ж" * 20 + "tea", "", None]
    marks = labels(spark, [(k, 1, 0) for k in (0, 1, 2, 3, 7, 8)] + [(4, 0, 0)])
    seen = len(set("".join(texts[:4])))
    assert seen > ql.CLASSES
    letters = ql.alphabet(documents(spark, texts[:4]))
    assert letters.size == seen + 2
    assert sorted(letters.classes[np.array([ord(c) for c in set("".join(texts[:4]))])].tolist()) == list(range(2, seen + 2))
    found = rows_by_id(ql.judged(documents(spark, texts), marks))
    monkeypatch.setattr(ql, "CLASSES", seen + 2)
    for k, want in enumerate(brute_logs(texts[:4], texts[:7])):
        assert found[k]["perplexity"] == pytest.approx(10 ** (-want / (len(texts[k]) + 1)), rel=1e-9)


@pytest.mark.parametrize("held", [50, 1_000_000])
def test_all_trigrams_are_counted(spark, monkeypatch, held):
    monkeypatch.setattr(ql, "_HELD_CODES", held)
    rng = random.Random(7)
    texts = [prose(rng, 40) for _ in range(30)] * 2 + ["", None]
    letters = ql.alphabet(documents(spark, texts))
    classes, width = letters.classes, letters.width
    want = Counter()
    for text in filter(None, texts):
        seq = [1, 1, *[int(classes[ord(c)]) for c in text], 1]
        want.update(zip(seq, seq[1:], seq[2:]))
    got = {}
    for shard, code, n in ql.count_trigrams(documents(spark, texts), spark.sparkContext.broadcast(letters)).collect():
        context, last = divmod(code, width)
        got[(*divmod(context * ql.SHARDS + shard, width), last)] = n
    assert got == dict(want)


def test_the_pipeline_drops_noise_of_a_large_script(spark, tmp_path):
    rng = random.Random(9)
    # Letters that come more often than any of the script.
    others = "".join(chr(0x400 + k) for k in range(140)) * 3
    texts = [others + prose(rng, 60) for _ in range(150)] + [others + noise(rng, 60) for _ in range(20)]
    docs = documents(spark, texts)
    labels(spark, [(k, 1, 0) for k in range(150)]).write.parquet(str(tmp_path / "labels.parquet"))
    kept = {r.doc_id for r in cp.quality(spark, docs, str(tmp_path)).collect()}
    assert not kept & set(range(150, 170))
    assert len(kept) >= 140


def test_the_largest_codes_fit():
    letters = ql.Alphabet(np.full(0x110000, 0x110001, np.int32), 0x110002)
    codes = ql.trigrams("ab".encode(), letters)
    assert (codes >= 0).all()
    shard, code = ql._shards(codes, letters.width)
    context, last = np.divmod(code, letters.width)
    back = np.array([(*divmod(c * ql.SHARDS + s, letters.width), w) for c, s, w in zip(context.tolist(), shard.tolist(), last.tolist())])
    assert back.tolist() == [[1, 1, 0x110001], [1, 0x110001, 0x110001], [0x110001, 0x110001, 1]]
