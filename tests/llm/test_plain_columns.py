"""Columns of queries without SQL that plain SQL can give: DuckDB over the same tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))

from check_oracle import connect  # noqa: E402

from bitledger.llm import catalog  # noqa: E402

SF_DIR = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="test tables are absent")

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_RULES = [("com", "/"), ("example.com", "/en/"), ("www.example.com", "/en/"), ("net", "/es/"), ("net", "/fr/")]
_FITS = " UNION ALL ".join(
    f"SELECT page_id, '{h + p}' AS rule, {len(h + p)} AS n FROM u WHERE (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}')" for h, p in _RULES
)
SQL = {
    "op3_url_filter": (
        ["page_id", "host", "path", "rule"],
        f"""WITH r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
        u AS (SELECT page_id, coalesce({_LOWER.format("regexp_extract(rest, '^([^/?#]*)', 1)")}, '') AS host,
          coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM r)
        SELECT page_id, host, path, rule FROM u LEFT JOIN (SELECT page_id, arg_max(rule, n) AS rule FROM ({_FITS}) GROUP BY page_id) USING (page_id)""",
    ),
    "op6_mixing": (
        ["doc_id", "size", "source_size"],
        r"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents)
        SELECT doc_id, size, SUM(size) OVER (PARTITION BY source) AS source_size FROM d""",
    ),
    "op7_fingerprints": (
        ["doc_id", "n_chars", "edited_sha256"],
        """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(LEAD(text) OVER (ORDER BY doc_id DESC), FIRST_VALUE(text) OVER (ORDER BY doc_id DESC), '') AS other FROM documents)
        SELECT doc_id, length(t) AS n_chars, sha256(left(t, length(t) - length(t) // 2) || left(other, length(t) // 2)) AS edited_sha256 FROM d""",
    ),
    "op10_license_scan": (
        ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"],
        f"""WITH w AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
        p(phrase, label) AS (VALUES (['gnu', 'general', 'public', 'license'], 'gpl'), (['apache', 'license'], 'apache'), (['cc', 'by'], 'cc-by'), (['mit', 'license'], 'mit')),
        h AS (SELECT doc_id, label, i FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w), p WHERE w[i] = phrase[1] AND w[i:i + len(phrase) - 1] = phrase)
        SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_base, a AS first_word, b AS last_word, coalesce(l, '') AS base_labels FROM w
        LEFT JOIN (SELECT doc_id, COUNT(*) AS n, MIN(i) - 1 AS a, MAX(i) - 1 AS b, string_agg(DISTINCT label, ',' ORDER BY label) AS l FROM h GROUP BY doc_id) USING (doc_id)""",
    ),
}


@pytest.mark.parametrize("name", sorted(SQL))
def test_columns_equal_sql(spark, name):
    columns, sql = SQL[name]
    got = sorted(map(tuple, catalog.QUERIES[name](spark, SF_DIR).select(*columns).collect()), key=str)
    want = sorted(connect(SF_DIR).execute(sql).fetchall(), key=str)
    assert got == want
