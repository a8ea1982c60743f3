import random

import numpy as np
import pytest

from bitledger.llm import jaccard_join as jj
from bitledger.llm import signature_tree as st
from bitledger.llm.components import connected_components
from tests.llm.helpers import documents, rows_by_id, sentence


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(texts, percent=80):
    sets = [shingles(t) for t in texts]
    least = list(range(len(texts)))

    def find(k):
        while least[k] != k:
            k = least[k]
        return k

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                least[y] = x
    return [(len(s), find(k)) for k, s in enumerate(sets)]


def corpus(seed, families=25, copies=8):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    shared = sentence(rng, 60, words)
    texts = [None, "", " \n", "a b", "A  b", "a b c", "x y z v w"]
    for _ in range(families):
        base = sentence(rng, rng.choice([7, 30, 60, 150]), words).split()
        if rng.random() < 0.3:
            base += shared.split()
        for _ in range(rng.randrange(1, copies)):
            edited = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                edited[rng.randrange(len(edited))] = rng.choice(words)
            if rng.random() < 0.2:
                edited = edited[: max(1, len(edited) - rng.randrange(15))]
            texts.append(" ".join(edited))
    rng.shuffle(texts)
    return texts


def found(spark, texts, percent=80):
    rows = rows_by_id(jj.jaccard_components(documents(spark, texts), percent))
    return [(rows[k]["n_shingles"], rows[k]["component_id"]) for k in range(len(texts))]


@pytest.mark.parametrize("percent", [80, 50])
def test_components_equal_brute_force(spark, percent):
    texts = corpus(percent)
    assert found(spark, texts, percent) == brute(texts, percent)


def test_large_blocks_are_cut_without_losing_links(spark, monkeypatch):
    rng = random.Random(9)
    monkeypatch.setattr(jj, "BLOCK_DOCS", 6)
    # A chain of texts, each near to the next only, close copies of one text, and strays.
    words = [f"w{k}" for k in range(3000)]
    line = sentence(rng, 260, words).split()
    texts = [" ".join(line[k : k + 120]) for k in range(0, 140, 9)]
    base = sentence(rng, 90, words).split()
    for _ in range(40):
        edited = list(base)
        edited[rng.randrange(90)] = rng.choice(words)
        texts.append(" ".join(edited))
    texts += corpus(3)
    assert found(spark, texts) == brute(texts)


def test_common_elements_are_sent_once_and_nothing_changes(spark, monkeypatch):
    texts = corpus(4, families=40)
    want = brute(texts)
    monkeypatch.setattr(jj, "_CHUNK_ELEMENTS", 400)
    assert found(spark, texts) == want


def test_null_ids_repeats_and_keep_one(spark):
    base = " ".join(f"w{k}" for k in range(40))
    docs = documents(spark, [base, base.upper(), base + " more", None, "", "other text"])
    null = docs.where("doc_id = 1").selectExpr("CAST(NULL AS bigint)", "text", "lang", "source", "n_chars", "extra")
    rows = docs.union(docs.where("doc_id = 0")).union(null)
    out = jj.jaccard_components(rows).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.component_id) for r in out) == [
        (False, 0, 0), (False, 0, 0), (False, 1, 0), (False, 2, 0), (False, 3, 3), (False, 4, 4), (False, 5, 5), (True, 0, 0)
    ]
    kept = jj.keep_one(rows)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, 3, 4, 5]
    assert jj.jaccard_components(docs.limit(0)).count() == 0 and jj.keep_one(docs.limit(0)).count() == 0


def test_traversal_finds_every_component():
    rng = np.random.default_rng(1)
    for case in range(20):
        sets = []
        for _ in range(rng.integers(1, 60)):
            if sets and rng.random() < 0.6:
                base = sets[rng.integers(len(sets))]
                keep = base[rng.random(len(base)) > rng.choice([0.02, 0.1, 0.3])]
                more = rng.integers(0, 5000, rng.integers(0, 4))
                sets.append(np.unique(np.concatenate([keep, more])))
            else:
                sets.append(np.unique(rng.integers(0, 5000, rng.integers(1, 300))))
        sizes = np.array([len(s) for s in sets])
        half = len(sets) // 2 if case % 2 else None
        labels = np.arange(len(sets))
        left, right = st.Sets(sizes[:half], sets[:half]), None
        if half is not None:
            right = st.Sets(sizes[half:], sets[half:])
        links = list(st.spanning_links(left, right, labels, 80))
        forest = st.Forest(labels)
        for a, b in links:
            assert st.linked(sets[a], sets[b], sizes[a], sizes[b], 80)
            forest.join(forest.find(a), forest.find(b))
        for i in range(len(sets)):
            for j in range(i):
                across = half is None or (j < half <= i)
                if across and st.linked(sets[i], sets[j], sizes[i], sizes[j], 80):
                    assert forest.find(i) == forest.find(j)


def test_components_of_paths_stars_and_nothing(spark):
    edges = [(k, k + 1) for k in range(60)] + [(1000, k) for k in range(1001, 1200)] + [(7, 7), (5, 4), (5, 4)]
    rows = connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {r.node: r.component for r in rows} == {k: 0 for k in range(61)} | {k: 1000 for k in range(1000, 1200)}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@pytest.mark.parametrize("most", [6, 2000])
def test_every_link_of_chained_near_copies_is_returned(spark, monkeypatch, most):
    rng = random.Random(11)
    monkeypatch.setattr(jj, "BLOCK_DOCS", most)
    words = [f"w{k}" for k in range(3000)]
    line = sentence(rng, 200, words).split()
    texts = [" ".join(line[k : k + 120]) for k in range(0, 80, 5)]
    base = sentence(rng, 90, words).split()
    for k in range(40):
        edited = list(base)
        edited[k] = "other"
        texts.append(" ".join(edited))
    texts += [texts[0], texts[-1], "a b", "A  b", "", None]
    sets = [shingles(t) for t in texts]
    links = [
        (i, j)
        for i, a in enumerate(sets)
        for j, b in enumerate(sets)
        if i != j and a and b and 100 * len(a & b) >= 80 * len(a | b)
    ]
    docs = documents(spark, texts)
    rows = rows_by_id(jj.link_counts(docs))
    assert [rows[k]["n_links"] for k in range(len(texts))] == [sum(i == k for i, _ in links) for k in range(len(texts))]
    pairs = [(r.a, r.b) for r in jj.class_pairs(docs).collect()]
    want = {tuple(sorted((rows[i]["sk"], rows[j]["sk"]))) for i, j in links if sets[i] != sets[j]}
    assert len(pairs) == len(want) and set(pairs) == want
    assert jj.class_links(docs).count() < len(want) / 2


def test_large_groups_over_two_size_ranges(spark, monkeypatch):
    """Close copies of one text, some of them longer, among chains and strays; many small pieces."""
    for name, value in (("BLOCK_DOCS", 12), ("LARGE_GROUP", 5), ("REPRESENTATIVES", 3), ("BUCKET_ELEMENTS", 300)):
        monkeypatch.setattr(jj, name, value)
    rng = random.Random(21)
    words = [f"w{k}" for k in range(3000)]
    base = sentence(rng, 95, words).split()
    texts = []
    for k in range(80):
        edited = base + sentence(rng, k % 12, words).split()
        edited[rng.randrange(95)] = rng.choice(words)
        texts.append(" ".join(edited))
    line = sentence(rng, 200, words).split()
    texts += [" ".join(line[k : k + 100]) for k in range(0, 90, 6)] + corpus(5)
    assert found(spark, texts) == brute(texts)


def test_very_long_text_and_clashing_names(spark):
    rng = random.Random(22)
    long = sentence(rng, 300_000, [f"w{k}" for k in range(5000)])
    texts = [long, long + " and more", sentence(rng, 30), None]
    docs = documents(spark, texts).withColumnsRenamed({"n_chars": "_key", "extra": "sk", "lang": "label", "source": "row"})
    assert {r.doc_id: r.component_id for r in jj.jaccard_components(docs).collect()} == {0: 0, 1: 0, 2: 2, 3: 3}
    kept = jj.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r["sk"]) for r in kept.collect()) == [(0, [0]), (2, [2]), (3, [3])]
