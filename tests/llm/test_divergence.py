"""The divergence audit against exact arithmetic in Python, and the transducer against a dict."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from bitledger.llm import divergence as dv
from bitledger.llm.transducer import Transducer, build
from tests.llm.helpers import DOC_SCHEMA, WORDS, documents, sentence


def brute(rows, min_docs, top=10):
    """``rows``: (text, lang, source)."""
    table = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), g or "", s or "") for t, g, s in rows]
    out = set()
    for lang in {g for _, g, _ in table}:
        mine = [(w, s) for w, g, s in table if g == lang]
        seen = Counter(x for w, _ in mine for x in set(w))
        kept = sorted((x for x in seen if seen[x] >= min_docs), key=lambda x: x.encode())
        v = len(kept)
        counts = {s: Counter(x for w, t in mine if t == s for x in w if x in set(kept)) for s in {s for _, s in mine}}
        whole = sum(counts.values(), Counter())

        def share(c, x):
            return 1 + 10**9 * (c[x] + 2) // (sum(c.values()) + 2 * v)

        def ranked(found, part, source):
            order = sorted(found.items(), key=lambda x: (-x[1], x[0].encode()))
            return {(lang, source, part, item, value, k) for k, (item, value) in enumerate(order, 1)}

        for s, c in counts.items():
            pairs = {}
            for t, d in counts.items():
                if t != s:
                    shares = [(share(c, x), share(d, x)) for x in kept]
                    pairs[t] = sum((p - q) ** 2 // (p + q) for p, q in shares)
            out |= ranked(pairs, "pair", s)
            over = {x: (share(c, x), share(whole, x)) for x in kept if c[x]}
            found = {x: (p - q) ** 2 // (p + q) for x, (p, q) in over.items() if p > q}
            out |= {r for r in ranked(found, "term", s) if r[5] <= top}
    return out


def rows_of(df):
    found = [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(found) == len(set(found))
    return set(found)


def texts():
    rng = random.Random(8)
    out = [
        (sentence(rng, rng.randrange(0, 30), WORDS + ["ÜBER", "straße", "日本", "Red"]), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None, "ü"]))
        for _ in range(150)
    ]
    return out + [(None, "en", "bare"), ("", "fr", "x"), ("lone words", "fr", "y"), ("1234 -- \x00", None, None), ("red red", "fr", "x")]


@pytest.mark.parametrize("min_docs", [1, 10, 40, 10**6])
def test_equals_brute_force(spark, min_docs):
    docs = documents(spark, texts(), None, None)
    assert rows_of(dv.audit(docs, min_docs)) == brute(texts(), min_docs)


def test_small_buckets_deals_blocks_and_stripes(spark, monkeypatch):
    for name, value in (("BUCKET_TERMS", 4), ("DEAL_BYTES", 64), ("BLOCK", 3), ("STRIPE", 2), ("_CELLS", 8), ("_HELD", 5), ("_PIECE", 9)):
        monkeypatch.setattr(dv, name, value)
    docs = documents(spark, texts(), None, None)
    assert rows_of(dv.audit(docs, 3)) == brute(texts(), 3)


def test_ties_go_by_utf8_order(spark):
    rows = [("zeta \U0001f600 ｚ alpha Ä", "en", "one")] * 12 + [("other words", "en", "two")] * 12
    found = [r for r in rows_of(dv.audit(documents(spark, rows, None, None))) if r[1:3] == ("one", "term")]
    items = [r[3] for r in sorted(found, key=lambda r: r[5])]
    assert items == sorted(items, key=lambda x: x.encode()) and len(set(r[4] for r in found)) == 1 and len(items) == 5


def test_hot_source_long_text_and_extra_names(spark):
    rng = random.Random(2)
    long = sentence(rng, 400_000)
    rows = [(k, long if k == 0 else sentence(rng, 12), "en", "hot" if k % 3 else "cold", 1, [1]) for k in range(60)]
    docs = spark.createDataFrame(rows, DOC_SCHEMA).withColumnsRenamed({"n_chars": "term", "extra": "ordinal"})
    assert rows_of(dv.audit(docs)) == brute([r[1:4] for r in rows], 10)


def test_empty_table(spark):
    assert dv.audit(documents(spark, ["x"]).limit(0)).count() == 0


def test_vocabulary_ordinals_are_in_byte_order(spark):
    docs = documents(spark, texts(), None, None)
    rows = sorted(dv.vocabulary(docs, 2).collect(), key=lambda r: r.ordinal)
    assert [r.ordinal for r in rows] == list(range(len(rows)))
    assert [(r.lang.encode(), r.term.encode()) for r in rows] == sorted((r.lang.encode(), r.term.encode()) for r in rows)


def test_shares_are_exact_for_large_counts():
    counts = np.array([0, 1, 10**12, 4 * 10**15])
    whole = 4 * 10**15 + 10**12 + 1
    assert dv._shares(counts, whole, 1000).tolist() == [1 + 10**9 * (int(c) + 2) // (whole + 2000) for c in counts]


@pytest.mark.parametrize("terms", [[], [b"a"], [b"a", b"ab", b"abc"], [b"bats", b"cats", b"rats"]])
def test_transducer_small(terms):
    machine = Transducer(build(terms))
    asked = terms + [b"", b"x", b"ca", b"abcd", b"bat"]
    text = np.frombuffer(b" ".join(asked) + b" ", np.uint8)
    lengths = np.array([len(x) for x in asked])
    starts = np.cumsum(lengths + 1) - lengths - 1
    known = {t: k for k, t in enumerate(terms)}
    assert machine.ordinals(text, starts, lengths).tolist() == [known.get(x, -1) for x in asked]


def test_transducer_is_minimal_and_right():
    rng = random.Random(4)
    terms = sorted({"".join(rng.choice("abé") for _ in range(rng.randrange(1, 8))).encode() for _ in range(2000)})
    blob = build(terms)
    machine = Transducer(blob)
    text = np.frombuffer(b" ".join(terms) + b" ", np.uint8)
    lengths = np.array([len(x) for x in terms])
    starts = np.cumsum(lengths + 1) - lengths - 1
    assert machine.ordinals(text, starts, lengths).tolist() == list(range(len(terms)))
    # Minimal: as many states as there are different sets of endings.
    futures = {}
    for t in terms:
        for k in range(len(t) + 1):
            futures.setdefault(t[:k], set()).add(t[k:])
    assert len(machine.final) == len({frozenset(x) for x in futures.values()})
