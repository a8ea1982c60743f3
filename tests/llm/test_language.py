import itertools
import random

import numpy as np
import pytest

from bitledger.llm import language as lg
from tests.llm.helpers import documents, rows_by_id, sentence

EN = "the of and thing other with three winter weather north".split()
DE = "der die und über schön für größe straße nicht könig".split()
RU = "привет мир это только язык слово".split()


def corpus(rng, n=120):
    out = []
    for k in range(n):
        lang, words = [("en", EN), ("de", DE), ("ru", RU)][k % 3]
        out.append((sentence(rng, rng.randrange(3, 40), words), lang))
    return out


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(0)
    lengths = np.array([3, 0, 5, 1, 4])
    scores = rng.integers(-3, 3, (lengths.sum(), 3)).astype(np.float32)
    labels = lg.viterbi(scores, lengths, 2.0)
    at = 0
    for n in lengths:
        part, got = scores[at : at + n], labels[at : at + n]

        def value(path):
            return sum(part[i, k] for i, k in enumerate(path)) - 2.0 * sum(a != b for a, b in zip(path, path[1:]))

        if n:
            best = max(value(p) for p in itertools.product(range(3), repeat=int(n)))
            assert value(got.tolist()) == pytest.approx(best)
        at += n


def test_held_out_texts_mixed_texts_and_scripts(spark):
    rng = random.Random(1)
    model = lg.fit(documents(spark, [*corpus(rng), (None, "en"), ("x", None)]))
    assert model.languages == ["de", "en", "ru"]
    tests = [t for t, _ in corpus(rng, 60)]
    mixed = sentence(rng, 30, EN) + " " + sentence(rng, 10, DE)
    extra = [None, "", "123 ... !!", "— € —", mixed, "СЛОВО ЯЗЫК", "日本語"]
    found = rows_by_id(lg.label_languages(documents(spark, tests + extra), model))
    right = sum(found[k]["lang_pred"] == ["en", "de", "ru"][k % 3] for k in range(60))
    assert right >= 59
    for k in range(60, 64):
        assert (found[k]["lang_pred"], found[k]["lang_score"], found[k]["lang_spans"]) == ("und", 0.0, [])
    assert [s["lang"] for s in found[64]["lang_spans"]] == ["en", "de"]
    assert abs(found[64]["lang_spans"][1]["first"] - 30) <= 1 and found[64]["lang_pred"] == "en"
    assert found[65]["lang_pred"] == "ru" and found[66]["lang_pred"] in model.languages
    assert all(0 <= r["lang_score"] <= 1 for r in found.values())
    assert found[3]["extra"] == [3]


def test_language_and_ids_are_no_inputs(spark):
    rng = random.Random(2)
    model = lg.fit(documents(spark, corpus(rng)))
    docs = documents(spark, corpus(rng, 9))
    other = docs.selectExpr("doc_id + 100 AS doc_id", "text", "'zz' AS lang", "'q' AS source", "n_chars", "extra")
    one = [r["lang_pred"] for r in rows_by_id(lg.label_languages(docs, model)).values()]
    assert one == [r["lang_pred"] for r in rows_by_id(lg.label_languages(other, model)).values()]


def test_empty_tables_and_clashing_columns(spark):
    docs = documents(spark, [("the of", "en")])
    model = lg.fit(docs.limit(0))
    assert model.languages == []
    assert rows_by_id(lg.label_languages(docs, model))[0]["lang_pred"] == "und"
    named = docs.selectExpr("*", "1 AS lang_pred")
    assert rows_by_id(lg.label_languages(named, lg.fit(docs)))[0]["lang_pred"] == "en"
    assert lg.label_languages(docs.limit(0), model).count() == 0


def test_too_many_languages_are_refused(spark, monkeypatch):
    monkeypatch.setattr(lg, "LIMIT", 2)
    with pytest.raises(ValueError):
        lg.fit(documents(spark, corpus(random.Random(3), 9)))


def test_a_very_long_text_and_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(lg, "_CHUNK_WORDS", 50)
    monkeypatch.setattr(lg, "_CACHE", 5)
    rng = random.Random(4)
    model = lg.fit(documents(spark, corpus(rng)))
    texts = [sentence(rng, 30_000, DE), *[t for t, _ in corpus(rng, 30)]]
    found = rows_by_id(lg.label_languages(documents(spark, texts), model))
    assert found[0]["lang_pred"] == "de" and len(found) == 31


def test_more_languages_than_numbers_fold_buckets(spark):
    """300 languages, most of them noise with a row each, beside two real ones."""
    rng = random.Random(12)
    texts = [(sentence(rng, 40, "der die das und nicht ist ein eine wir sie".split()), "de") for _ in range(20)]
    texts += [(sentence(rng, 40, "the and not is one we they with from this".split()), "en") for _ in range(20)]
    texts += [(f"x{k}q z{k}w", f"noise{k}") for k in range(300)]
    model = lg.fit(documents(spark, texts))
    assert len(model.languages) == 302 and len(model.logs) == lg.BUCKETS // 2
    rows = lg.label_languages(documents(spark, ["wir und sie nicht", "they and we with this"]), model).collect()
    assert [r.lang_pred for r in rows] == ["de", "en"]
