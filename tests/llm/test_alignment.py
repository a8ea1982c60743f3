"""Cross-tokenizer alignment against a plain loop over tokens and a count of all links."""

import hashlib
import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from bitledger.llm import alignment as al
from bitledger.llm import answers
from tests.llm.helpers import WORDS, documents, rows_by_id, sentence

pytestmark = pytest.mark.skipif(not Path(al.BYTE_VOCABULARY).exists(), reason="vocabularies are absent")


@pytest.fixture(scope="module")
def known():
    return al.tokenizers(al.BYTE_VOCABULARY, al.PIECE_VOCABULARY)


def brute(texts, known):
    """Per text (groups, links), None without tokens; tokens and byte ranges in plain loops."""
    out = []
    for text in texts:
        if not text:
            out.append(None)
            continue
        a = known.byte.encode(" " + text, add_special_tokens=False).ids
        b = known.piece.encode(text)
        whole = (" " + text).encode()
        if b"".join(known.bytes_a[k] for k in a) != whole or b"".join(known.bytes_b[k] for k in b) != whole:
            out.append(None)
            continue

        def ranges(ids, size):
            at, found = 0, []
            for k in ids:
                found.append((at, at + len(size[k]), k))
                at += len(size[k])
            return found

        ra, rb = ranges(a, known.bytes_a), ranges(b, known.bytes_b)
        links = [(x[2], y[2]) for x in ra for y in rb if x[0] < y[1] and y[0] < x[1]]
        groups, first = [], 0
        for cut in sorted({x[1] for x in ra} & {y[1] for y in rb}):
            groups.append(([x[2] for x in ra if first < x[1] <= cut], [y[2] for y in rb if first < y[1] <= cut]))
            first = cut
        out.append((groups, links))
    return out


def check(spark, known, texts):
    found = rows_by_id(al.align(documents(spark, texts)))
    want = brute(texts, known)
    counts = Counter(link for x in want if x for link in x[1])
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    assert len(found) == len(texts)
    for k, x in enumerate(want):
        got = found[k]
        if x is None:
            assert got == {"doc_id": k, "n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "n_best": 0, "count_sum": 0, "groups_sha256": ""}
            continue
        groups, links = x
        written = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        assert got["groups_sha256"] == hashlib.sha256(written.encode()).hexdigest(), texts[k]
        assert (got["n_a"], got["n_b"]) == (sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups))
        assert (got["n_groups"], got["n_links"]) == (len(groups), len(links))
        assert got["n_best"] == sum(counts[x] == most[x[1]] for x in links)
        assert got["count_sum"] == sum(counts[x] for x in links)


def texts():
    rng = random.Random(6)
    odd = ["naïve façade", "日本語テキスト", "\U0001f600\U0001f601 x", "tab\tand\nline\n\n  end  ", "a▁b", " lead", "trail ", " ", "  ", "\x00", "<s> </s> <|endoftext|> <0x0A>", "a b", "ﬁne é", "​", "can't won't I'll", "x" * 300, "1234567 89,000.5", "\r\n"]
    plain = [sentence(rng, n) for n in (1, 2, 30, 200)]
    noise = ["".join(rng.choice("ab é日\n\t .0'\U0001f600") for _ in range(60)) for _ in range(30)]
    return [None, "", *odd, *plain, *noise, plain[2], plain[2]]


def test_equals_brute_force(spark, known):
    check(spark, known, texts())


def test_small_batches_chunks_and_shards(spark, known, monkeypatch):
    for name, value in (("_BATCH", 40), ("CHUNK_WORDS", 30), ("CHUNK_DISTINCT", 25)):
        monkeypatch.setattr(al, name, value)
    monkeypatch.setattr(answers, "SHARD_KEYS", 20)
    monkeypatch.setattr(answers, "ASKED_KEYS", 10)
    check(spark, known, texts())


def test_only_texts_without_tokens(spark, known):
    check(spark, known, [None, "", "a▁b"])
    assert al.align(documents(spark, ["x"]).limit(0)).count() == 0


def test_pieces_of_long_texts_encode_alike(known):
    rng = random.Random(9)
    assert known.cuttable
    for alphabet in (WORDS, WORDS + ["", "  ", "é", "1", "日", "'s", "\n", "."]):
        text = " ".join(rng.choice(alphabet) for _ in range(3000))
        pieces = list(al.pieces_of(text, 100, True))
        assert " ".join(pieces) == text and len(pieces) > 10
        a, b = known.encode(pieces)
        (whole_a,), (whole_b,) = known.encode([text])
        assert sum(a, []) == whole_a and sum(b, []) == whole_b


def test_ranks_give_the_tokens_of_the_file(known):
    """Merging by ids against the library that the file is written for: texts, noise, and every entry."""
    assert known.ranked is not None
    rng = random.Random(13)
    noise = ["".join(rng.choice("abcdeéèü日本\U0001f600 \n\t'.,-_#0123") for _ in range(80)) for _ in range(300)]
    entries = [x.decode() for x in known.bytes_a if x.isascii()]
    for text in [*(t or "" for t in texts()), *noise, *entries, " ".join(entries), "x".join(entries[::7])]:
        assert known.encode_a(text) == known.byte.encode(text, add_special_tokens=False).ids


def test_words_joined_or_alone(known):
    rng = random.Random(14)
    plain = [w for w in dict.fromkeys("".join(rng.choice("abcdeé日.,'#\n0▁") for _ in range(rng.randrange(1, 9))) for _ in range(400)) if w.strip() == w]
    ids_a, n_a, ids_b, n_b, fine = known.encode_words(plain)
    at_a, at_b = np.cumsum(n_a), np.cumsum(n_b)
    a, b = known.encode(plain)
    for k, w in enumerate(plain):
        assert ids_a[at_a[k] - n_a[k] : at_a[k]].tolist() == a[k] and ids_b[at_b[k] - n_b[k] : at_b[k]].tolist() == b[k]
        assert fine[k] == known.holds(w, a[k], b[k]) == ("▁" not in w)


def test_very_long_text(spark, known):
    rng = random.Random(1)
    text = sentence(rng, 400_000)
    assert len(text) > 2 * al._BATCH
    got = rows_by_id(al.align(documents(spark, [text, "short text"])))[0]
    (a,), (b,) = known.encode([text])
    assert (got["n_a"], got["n_b"]) == (len(a), len(b)) and got["n_links"] == len(a) + len(b) - got["n_groups"]
    changed = rows_by_id(al.align(documents(spark, [text + "▁"])))[0]
    assert changed["n_a"] == changed["n_links"] == changed["count_sum"] == 0


def test_cuts_by_divide_and_conquer():
    rng = random.Random(3)
    for _ in range(200):
        ends_a, ends_b, first, last, at = [], [], [], [], 0
        for _ in range(rng.randrange(1, 6)):
            size = rng.randrange(1, 30)
            first.append(len(ends_a))
            ends_a += sorted({at + x for x in rng.sample(range(1, size + 1), rng.randrange(0, size))} | {at + size})
            ends_b += sorted({at + x for x in rng.sample(range(1, size + 1), rng.randrange(0, size))} | {at + size})
            last.append(len(ends_a) - 1)
            at += size
        cuts = al.shared_cuts(*[np.array(x) for x in (ends_a, ends_b, first, last)])
        assert [ends_a[k] for k in cuts] == sorted(set(ends_a) & set(ends_b))


def test_token_groups_are_the_real_ones(spark, known):
    docs = documents(spark, texts()).withColumnRenamed("source", "token_groups").withColumnRenamed("lang", "t")
    found = rows_by_id(al.token_groups(docs))
    for k, x in enumerate(brute(texts(), known)):
        assert found[k]["token_groups"] == (None if x is None else [{"a": a, "b": b} for a, b in x[0]])
        assert found[k]["extra"] == [k] and found[k]["t"] == "en"


def test_clashing_names_repeated_and_null_ids(spark, known):
    docs = documents(spark, ["red green", "red green", "blue"]).withColumnRenamed("n_chars", "pairs")
    docs = docs.selectExpr("if(doc_id = 2, null, 7) AS doc_id", "text", "pairs", "lang AS chunk")
    rows = sorted(tuple(r) for r in al.align(docs).select("n_a", "n_links", "count_sum").collect())
    assert len(rows) == 3 and rows[1] == rows[2]
    assert sorted(str(r.doc_id) for r in al.align(docs).collect()) == ["7", "7", "None"]
