import random
import re

from bitledger.llm import decontaminate as dc
from tests.llm.helpers import documents, rows_by_id, sentence

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(text, items, window=10):
    words = WORD.findall(lowered(text))
    hit, names = set(), set()
    for name, item in items:
        w = WORD.findall(lowered(item))
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if size else 0):
            for at in range(len(words) - size + 1):
                if words[at : at + size] == w[i : i + size]:
                    hit.update(range(at, at + size))
                    names.add(str(name))
    return len(words), hit, sorted(names)


def benchmark(spark, items):
    return spark.createDataFrame([(i, t, 1) for i, t in items], "item_id bigint, text string, doc_id int")


def random_case(seed):
    rng = random.Random(seed)
    few = ["a1", "b", "C", "é", "ü2"]
    items = [(k, sentence(rng, rng.choice([1, 3, 4, 9, 10, 11, 25]), few if k % 2 else few * 2 + ["zz"])) for k in range(9)]
    items += [(9, None), (10, "  ... "), (11, items[0][1]), (3, "b b b C")]
    texts = [None, "", " -- ", "été"]
    for _ in range(40):
        parts = [sentence(rng, rng.randrange(0, 25), few + ["q", "r"]), rng.choice(items)[1] or "", sentence(rng, 5)]
        texts.append(rng.choice([" ", ", ", "\n"]).join(parts))
    return items, texts + texts[4:6]


def test_hits_equal_brute_force_in_one_and_many_blocks(spark):
    items, texts = random_case(5)
    docs = documents(spark, texts)
    for block_bytes in (1_000_000, 60):
        found = rows_by_id(dc.match_benchmark(docs, benchmark(spark, items), block_bytes=block_bytes))
        assert len(found) == len(texts)
        for k, text in enumerate(texts):
            n, hit, names = brute(text, items)
            row = found[k]
            runs = {p for r in row["runs"] for p in range(r["start"], r["end"])}
            assert (row["n_words"], runs, row["n_hit"], row["item_ids"]) == (n, hit, len(hit), names)


def test_passages_are_cut_and_the_rest_stays_byte_for_byte(spark):
    rng = random.Random(1)
    item = " ".join(f"w{k}" for k in range(30))
    before, after = sentence(rng, 40), sentence(rng, 40)
    texts = [
        f"{before}.\n{item.upper()}! {after}",
        f"{before} {item}",  # small share of hits
        f"one {item}",  # nearly all of it
        before,
        None,
        "",
        # cutting the inner passage joins a second one
        f"{before} {' '.join(item.split()[:5])} {item} {' '.join(item.split()[5:12])} {after}",
    ]
    docs = documents(spark, texts)
    found = rows_by_id(dc.decontaminate(docs, benchmark(spark, [(1, item)])))
    assert set(found) == {0, 1, 3, 4, 5, 6}
    assert dc.decontaminate(docs, benchmark(spark, [(1, item)])).columns == docs.columns
    assert found[0]["text"] == f"{before}.\n! {after}" and found[0]["n_chars"] == len(found[0]["text"])
    assert found[3]["text"] == before and found[4]["text"] is None and found[5]["text"] == ""
    assert found[3]["extra"] == [3] and found[3]["n_chars"] == len(before)
    for row in found.values():
        assert not brute(row["text"], [(1, item)])[1]


def test_empty_sides(spark):
    docs = documents(spark, ["a b c"])
    none = benchmark(spark, [(1, "x")]).limit(0)
    assert rows_by_id(dc.match_benchmark(docs, none))[0]["n_words"] == 3
    assert dc.decontaminate(docs, none).count() == 1
    assert dc.match_benchmark(docs.limit(0), benchmark(spark, [(1, "x")])).count() == 0


def test_one_very_long_text(spark):
    rng = random.Random(3)
    item = " ".join(f"v{k}" for k in range(12))
    text = sentence(rng, 200_000) + " " + item + " " + sentence(rng, 1000)
    row = rows_by_id(dc.match_benchmark(documents(spark, [text]), benchmark(spark, [(7, item)])))[0]
    assert (row["n_words"], row["n_hit"], row["item_ids"]) == (201_012, 12, ["7"])


def test_short_items_are_cut_where_they_are_rare(spark):
    rng = random.Random(4)
    rows = [sentence(rng, 30) + (" thank you very much" if k % 2 else "") for k in range(40)]
    rows[3] += " Who wrote HAMLET? Nobody knows."
    rows[4] += " who wrote hamlet"
    items = [(1, "Who wrote Hamlet?"), (2, "Thank you"), (3, "unheard of"), (4, " ".join(f"w{k}" for k in range(20))), (5, None), (6, "--")]
    docs = documents(spark, rows)
    found = rows_by_id(dc.decontaminate(docs, benchmark(spark, items)))
    assert found[3]["text"] == rows[3].replace("Who wrote HAMLET", "") and found[4]["text"] == rows[4].replace("who wrote hamlet", "")
    assert all(found[k]["text"] == rows[k] for k in range(40) if k not in (3, 4))
    never = rows_by_id(dc.decontaminate(docs, benchmark(spark, items[1:])))
    assert all(never[k]["text"] == rows[k] for k in range(40))
