"""The quality cascade against plain Python and against itself in other orders."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from bitledger.llm import quality_rules as qr
from tests.llm.helpers import documents, rows_by_id, sentence

SPACE = " \t\n\x0b\x0c\r"


def measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    hit = {p for k, w in enumerate(windows) if windows.count(w) > 1 for p in range(k, k + 8)}
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_lines": len(lines),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(hit),
    }


def failing(m):
    return {
        "repeated_words": 100 * m["n_repeat_words"] > 30 * m["n_words"],
        "few_words": m["n_words"] < 20,
        "symbols": 100 * m["n_symbols"] > 10 * m["n_words"],
        "repeated_lines": 100 * m["n_dup_lines"] > 50 * m["n_lines"],
        "word_length": not 2 * m["n_words"] <= m["word_chars"] <= 15 * m["n_words"],
    }


def texts():
    rng = random.Random(3)
    plain = [sentence(rng, n) for n in (0, 1, 7, 8, 9, 19, 20, 60, 300)]
    passage = sentence(rng, 9)
    return [
        None, "", SPACE, "\n\n", *plain, plain[7], plain[7],
        f"{passage} one two {passage}", f"{sentence(rng, 40)} {passage} {sentence(rng, 40)} {passage}",
        " ".join(["again"] * 40), "the same line\n" * 30, "x " * 30, "w" * 400 + " " + sentence(rng, 25),
        " ".join(w + "$$" for w in sentence(rng, 30).split()), "naïve 日本語 \U0001f600 words " * 3 + sentence(rng, 20),
        " a\tb\r\nc\x0bd\x0ce ", "a b c d e f g h a b c d e f g", "a b c d e f g h " * 2 + sentence(rng, 12),
        "#*$%&|<>\n#*$%&|<>", "a b   c\n \nline\n line\nline", sentence(rng, 200) + "\n" + "Ü" * 30,
    ]


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark, texts())


def test_measures_and_verdicts_equal_brute_force(docs):
    found = rows_by_id(qr.judge(docs, qr.RULES))
    whole = rows_by_id(docs.select("doc_id", *[m.struct(F.coalesce("text", F.lit(""))).alias(m.name) for m in qr.MEASURES.values()]))
    assert len(found) == len(texts())
    for k, text in enumerate(texts()):
        want = measures(text)
        got = {f: v for m in qr.MEASURES for f, v in whole[k][m].items()}
        assert got == want, text
        fails = [r.name for r in qr.RULES if failing(want)[r.name]]
        assert found[k]["rejected_by"] == (fails[0] if fails else None)
        assert found[k]["extra"] == [k]


def test_any_order_keeps_the_same_documents_and_stops_early(docs):
    orders = list(itertools.permutations(qr.RULES))[::17]
    kept = {frozenset(r.doc_id for r in qr.keep_passing(docs, order).collect()) for order in orders}
    assert kept == {frozenset(k for k, t in enumerate(texts()) if not any(failing(measures(t)).values()))}
    order = sorted(qr.RULES, key=lambda r: r.name != "few_words")
    short = [r for r in qr.judge(docs, order).collect() if r.rejected_by == "few_words"]
    assert short and all(r.measured.words and r.measured.repeats is None for r in short)


def test_plan_takes_rejections_per_cost_given_the_rules_before(spark):
    docs = documents(spark, [sentence(random.Random(k), 40) + (" $$$$$$$$" if k % 2 else "") for k in range(60)])

    def slow(text):
        return F.length(F.regexp_replace(F.repeat(text, 300), "[aeiou]", ""))

    measures = dict(qr.MEASURES) | {"slow": qr.Measure("slow", ("slow",), slow)}
    rules = (
        qr.Rule("costly", ("slow",), lambda v: v("slow") > 0),
        qr.Rule("same", ("symbols", "words"), lambda v: 100 * v("n_symbols") > 11 * v("n_words")),
        *[r for r in qr.RULES if r.name in ("symbols", "few_words")],
    )
    plan = qr.plan_cascade(docs, rules, measures)
    assert sorted(e.rule.name for e in plan) == sorted(r.name for r in rules)
    place = {e.rule.name: e for e in plan}
    assert plan[0].reached == 60
    assert {place["symbols"].rejected, place["same"].rejected} == {30, 0}
    assert place["costly"].seconds > place["symbols"].seconds
    assert plan.index(place["costly"]) > min(plan.index(place["symbols"]), plan.index(place["same"]))


def test_empty_table_and_clashing_names(spark, docs):
    empty = docs.limit(0)
    assert qr.judge(empty).count() == 0
    assert [e.rule.name for e in qr.plan_cascade(empty)] != []
    odd = docs.withColumnRenamed("lang", "rejected_by").withColumnRenamed("source", "measured").withColumn("words", F.lit(1))
    judged = qr.judge(odd, qr.RULES)
    assert judged.columns == ["doc_id", "text", "n_chars", "extra", "words", "rejected_by", "measured"]
    assert {r.doc_id: r.rejected_by for r in judged.collect()} == {
        r.doc_id: r.rejected_by for r in qr.judge(docs, qr.RULES).collect()
    }
    assert qr.keep_passing(odd, qr.RULES).columns == odd.columns


def test_long_text(spark):
    rng = random.Random(5)
    words = [f"w{rng.randrange(10**9)}" for _ in range(300_000)]
    words[200_000:200_050] = words[:50]
    (row,) = qr.judge(documents(spark, [" ".join(words)]), qr.RULES).collect()
    assert row.rejected_by is None
    assert row.measured.repeats.n_repeat_words == 100


def test_no_python_in_the_plan(docs, spark):
    plan = qr.judge(docs, qr.RULES)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
