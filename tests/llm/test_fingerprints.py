import hashlib
import random

from bitledger.llm import fingerprints as fp
from tests.llm.helpers import documents, rows_by_id, sentence


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.4)) % 3000}é" for _ in range(4000)]
    texts = [None, "", "a", "ab", "\n\n", sentence(rng, 4000, words)]
    return texts + [sentence(rng, rng.randrange(1, 200), words) for _ in range(n)]


def edited(texts_by_order):
    out = []
    for k, text in enumerate(texts_by_order):
        after = texts_by_order[(k + 1) % len(texts_by_order)]
        half = len(text) // 2
        out.append(text[: len(text) - half] + after[:half])
    return out


def check(spark, docs, order):
    found = fp.edited_fingerprints(docs).collect()
    texts = [t or "" for _, t in order]
    want = sorted(
        (d is None, d or 0, len(t), hashlib.sha256(e.encode()).hexdigest())
        for (d, _), t, e in zip(order, texts, edited(texts))
    )
    got = sorted(
        (r.doc_id is None, r.doc_id or 0, r.n_chars, hashlib.sha256(r.edited.encode()).hexdigest()) for r in found
    )
    assert got == want
    return found


def test_edited_texts_follow_descending_ids_over_all_ranges(spark):
    texts = corpus()
    docs = documents(spark, texts).repartition(5)
    found = check(spark, docs, [(k, texts[k]) for k in reversed(range(len(texts)))])
    prints = {r.doc_id: r.fingerprint for r in found}
    for r in found:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        after = prints[(r.doc_id - 1) % len(texts)]
        pairs = [(a, b) for a, b in zip(r.fingerprint.split("-"), after.split("-")) if (a, b) != (".", ".")]
        assert r.near_next == (sum(a == b for a, b in pairs) / len(pairs) if pairs else 1.0)
    long = [r for r in found if r.n_chars > 100]
    assert sum(r.near_edited for r in long) > 2 * sum(r.near_next for r in long)


def test_fingerprints_keep_the_band_and_ignore_order_and_repeats(spark):
    texts = corpus(2)
    texts += [" ".join(reversed(texts[7].split())), texts[7] + " " + texts[7], texts[7]]
    rows = rows_by_id(fp.with_fingerprints(documents(spark, texts)))
    n, total = len(texts), sum(t is not None for t in texts)
    frequency = {}
    for text in texts:
        for w in set((text or "").split()):
            frequency[w] = frequency.get(w, 0) + 1
    import math

    for k in range(n):
        terms = set((texts[k] or "").split())
        band = {w for w in terms if fp.LOW_IDF <= math.log2(total / frequency[w]) <= fp.HIGH_IDF}
        assert set(rows[k]["terms_kept"]) == (band or terms)
        assert rows[k]["terms_kept"] == sorted(rows[k]["terms_kept"])
    assert len({rows[k]["fingerprint"] for k in (7, n - 3, n - 2, n - 1)}) == 1
    assert rows[0]["fingerprint"] == rows[1]["fingerprint"]


def test_near_copies_are_near(spark):
    rng = random.Random(3)
    texts = corpus(3, 40)
    words = texts[5].split()
    for _ in range(20):
        words[rng.randrange(len(words))] = "changed"
    rows = rows_by_id(fp.with_fingerprints(documents(spark, [*texts, " ".join(words)])))
    a, b = rows[5]["fingerprint"].split("-"), rows[len(texts)]["fingerprint"].split("-")
    assert sum(x == y for x, y in zip(a, b)) > len(a) * 0.4


def test_repeated_and_null_ids_single_rows_and_empty_tables(spark):
    docs = documents(spark, ["bbbb", "cccc", "dddd"])
    more = docs.union(documents(spark, ["aaaa"])).union(docs.where("doc_id = 2"))
    more = more.union(docs.limit(1).selectExpr("CAST(NULL AS bigint)", "'zzzz'", "lang", "source", "n_chars", "extra"))
    order = [(2, "dddd"), (2, "dddd"), (1, "cccc"), (0, "aaaa"), (0, "bbbb"), (None, "zzzz")]
    check(spark, more, order)
    check(spark, docs.where("doc_id = 1"), [(1, "cccc")])
    assert fp.edited_fingerprints(docs.limit(0)).count() == 0
