"""The corpus pipeline over the smallest tables and over nothing."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline as cp  # noqa: E402

from bitledger.llm import mixing  # noqa: E402
from tests.llm.test_decontaminate import brute as leaks  # noqa: E402
from tests.llm.test_jaccard_join import shingles  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="test tables are absent")


def read(spark, name):
    return spark.read.parquet(f"{SF_DIR}/{name}.parquet")


def test_stages_do_their_work(spark, tmp_path):
    docs = read(spark, "documents")
    columns = docs.columns
    marks = {r.doc_id: r for r in read(spark, "labels").collect()}
    items = [(r.item_id, r.text) for r in read(spark, "benchmark").collect()]
    before = {r.doc_id: r for r in docs.collect()}
    for name, stage in cp.STAGES:
        out = stage(spark, docs, SF_DIR)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = {r.doc_id: r for r in docs.collect()}
        assert len(after) == docs.count() and set(after) <= set(before)
        gone = set(before) - set(after)
        assert docs.columns == (columns if name != "mixing" else [*columns, "copies"])
        if name == "quality":
            clean = [d for d in gone if d in marks and marks[d].quality == 1 and not marks[d].toxic]
            assert gone and len(clean) <= 1
        elif name == "language":
            assert len(gone) <= 0.02 * len(before)
        elif name == "near_duplicates":
            sets = {d: shingles(r.text) for d, r in before.items()}

            def near(a, b):
                return 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])

            assert not any(near(a, b) for a in after for b in after if a < b)
            assert gone and all(any(near(a, b) for b in before if b != a) for a in gone)
        elif name == "decontamination":
            for d, row in after.items():
                n, hit, _ = leaks(before[d].text, items)
                assert hit or row == before[d]
                assert not leaks(row.text, items)[1] and row.n_chars == len(row.text)
        else:
            assert all(1 <= r.copies <= mixing.MAX_COPIES for r in after.values())
        before = after


def test_run_equals_the_stages_and_empty_input_gives_an_empty_result(spark, tmp_path):
    first = {(r.doc_id, r.text, r.copies) for r in cp.run(spark, SF_DIR).collect()}
    assert first and first == {(r.doc_id, r.text, r.copies) for r in cp.run(spark, SF_DIR).collect()}
    for name in ("documents", "labels", "benchmark"):
        read(spark, name).limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0
