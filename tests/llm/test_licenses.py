import random

from bitledger.llm import licenses as lc
from bitledger.llm.text import alnum_words
from tests.llm.helpers import documents, rows_by_id, sentence


def brute(text, templates, phrases, threshold=lc.THRESHOLD):
    words = alnum_words((text or "").encode())
    places, base, matched, best = [], set(), set(), 0.0
    for phrase, label in phrases:
        p = phrase.encode().split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                base.add(label)
    for label, template in templates:
        tokens = alnum_words(template.encode())
        width = len(tokens) * 1000 // round(threshold * 1000)
        for i in range(len(words)):
            share = len(set(tokens) & set(words[i : i + width])) / len(set(tokens))
            if share >= threshold - 1e-12:
                matched.add(label)
                best = max(best, share)
    return {
        "n_words": len(words),
        "n_base": len(places),
        "first_word": min(places, default=None),
        "last_word": max(places, default=None),
        "base_labels": ",".join(sorted(base)),
        "labels": ",".join(sorted(base | matched)),
        "score": 1.0 if base else best,
    }


def test_scan_equals_brute_force(spark):
    rng = random.Random(2)
    templates = lc.TEMPLATES + [("tiny", "quill Thorn")]
    texts = [None, "", "...", "cc by cc by", "CC BY-NC cc", "the mit license", "mit licenses", "gnu general public gnu general public license"]
    pool = [t for _, t in templates]
    for _ in range(120):
        kept = rng.choice(pool).split()
        for _ in range(rng.randrange(0, 4)):
            kept[rng.randrange(len(kept))] = rng.choice(["", "x", "the"])
        rng.shuffle(kept) if rng.random() < 0.3 else None
        text = rng.choice(["\n", "\n\n", " "]).join([sentence(rng, 8), " ".join(kept), sentence(rng, 3)])
        texts.append(text)
    found = rows_by_id(lc.license_scan(documents(spark, texts), templates))
    for k, text in enumerate(texts):
        want = brute(text, templates, lc.PHRASES)
        assert {c: found[k][c] for c in want} == want, text


def labels_of(spark, text):
    return lc.license_scan(documents(spark, [text])).first().labels


def test_words_far_apart_are_no_notice(spark):
    album = "the author released the album last year under a new name and later lost his license to teach mit students"
    rules = (
        "Visitors have all the rights that members have. A part of this hall is reserved. No food may be brought in, "
        "and reproduced keys are not work of ours. Please do not enter without permission."
    )
    assert labels_of(spark, album) == "" and labels_of(spark, rules) == ""
    apache = dict(lc.TEMPLATES)["apache-2.0"]
    text = apache + "\n" + "\n".join(["this software is released", "to the public under", "terms that mit students know"] * 5)
    assert labels_of(spark, text) == "apache,apache-2.0"


def test_notices_over_lines_and_paragraphs(spark):
    for breaks in ("\n", "\n\n", "\n * "):
        for label in ("mit", "bsd", "gpl"):
            words = dict(lc.TEMPLATES)[label].split()
            half = len(words) // 2
            text = "Some words before.\n\n" + " ".join(words[:half]) + breaks + " ".join(words[half:]) + "\nlast lines"
            row = lc.license_scan(documents(spark, [text])).first()
            assert label in row.labels.split(","), text
            (match,) = [m for m in row.matches if m.label == label]
            assert (match.first_word, match.last_word, match.containment) == (3, 2 + len(words_of(dict(lc.TEMPLATES)[label])), 1.0)


def words_of(text):
    return alnum_words(text.encode())


def test_very_long_text_and_many_templates(spark):
    rng = random.Random(7)
    notice = dict(lc.TEMPLATES)["bsd"]
    text = sentence(rng, 150_000) + " " + notice + " " + sentence(rng, 150_000)
    more = [(f"t{k}", sentence(rng, 40, [f"v{k}" for k in range(9000)])) for k in range(2000)]
    row = lc.license_scan(documents(spark, [text]), lc.TEMPLATES + more).first()
    assert row.labels == "bsd" and [(m.first_word, m.last_word) for m in row.matches] == [(150_000, 149_999 + len(words_of(notice)))]


def test_empty_table_repeated_rows_and_no_templates(spark):
    docs = documents(spark, ["MIT License"] * 3)
    assert lc.license_scan(docs.limit(0)).count() == 0
    assert [r.labels for r in lc.license_scan(docs, templates=[]).collect()] == ["mit"] * 3
