"""Every registered query of the package against its SQL, or for a full result."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))

import check_oracle  # noqa: E402

from bitledger.llm import catalog  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="test tables are absent")


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, monkeypatch, name):
    monkeypatch.setattr(check_oracle, "catalog", catalog)
    assert check_oracle.compare(spark, check_oracle.connect(SF_DIR), name, SF_DIR) == ""


@pytest.mark.parametrize("name", [n for n in sorted(catalog.QUERIES) if n not in ("op3_url_filter", "op4_chat_format", "op13_divergence")])
def test_one_row_a_document(spark, name):
    ids = [r.doc_id for r in catalog.QUERIES[name](spark, SF_DIR).select("doc_id").collect()]
    assert sorted(ids) == [r.doc_id for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").orderBy("doc_id").collect()]
