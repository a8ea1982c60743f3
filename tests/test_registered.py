"""Every registered query against its SQL, over the whole tables of the smallest scale."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__ as contract  # noqa: E402
from check_oracle import compare, connect  # noqa: E402

from bitledger import catalog  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="test tables are absent")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, duck, name):
    assert compare(spark, duck, name, SF_DIR) == ""


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_sql_is_valid_and_runs_on_its_own(duck, name):
    """Each text parses as one statement without placeholders and binds to the tables."""
    sql = catalog.ORACLE[name]
    assert len(duckdb.extract_statements(sql)) == 1
    duck.execute(f"EXPLAIN {sql}")


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    result = contract.entry(spark)
    assert result.columns[0] == "model_family"
    assert result.count() > 0
