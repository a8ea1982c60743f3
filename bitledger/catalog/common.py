"""Shared pieces of the registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitledger.functions import fixed_values as fixed
from bitledger.functions.columns import round_half_up

Query = Callable[[SparkSession, str], DataFrame]


def rounded(df: DataFrame, digits: int, *cols: str) -> DataFrame:
    """Round result columns so that the order of additions does not show."""
    return df.withColumns({c: round_half_up(F.col(c), digits) for c in cols})


def r(expr: str, digits: int) -> str:
    """The same rounding in SQL."""
    scale = f"{10**digits}.0e0"
    large = repr(2.0**52 / 10**digits)
    return f"CASE WHEN ABS({expr}) >= {large}::DOUBLE THEN ({expr}) ELSE FLOOR(({expr}) * {scale} + 0.5e0) / {scale} END"


def name_parts(name: str) -> dict[str, str]:
    """SQL for family, method and scheme of a model directory name."""
    tokens = "|".join(sorted(fixed.METHOD_TOKENS, key=len, reverse=True))
    norm = f"regexp_replace(lower({name}), '[-_]+', '-', 'g')"
    token = f"regexp_extract({norm}, '(^|-)({tokens})(-|$)', 2)"
    return {
        "model_family": f"CASE WHEN regexp_matches({norm}, '^({tokens})(-|$)') THEN {name} "
        f"ELSE regexp_replace({norm}, '(^|-)({tokens})(-.*|$)', '') END",
        "method": f"CASE WHEN {token} = '' THEN 'unknown' WHEN {token} LIKE 'smooth%' THEN 'smooth' ELSE {token} END",
        "scheme": f"CASE WHEN regexp_matches({norm}, 'w\\d+a\\d+') THEN 'W' || regexp_extract({norm}, 'w(\\d+)a(\\d+)', 1) || 'A' || regexp_extract({norm}, 'w(\\d+)a(\\d+)', 2) "
        f"WHEN {norm} LIKE '%int4%' THEN 'W4A16' WHEN {norm} LIKE '%int8%' THEN 'W8A16' ELSE 'unknown' END",
    }


BASENAME = "regexp_extract(rtrim({0}, '/'), '([^/]*)$', 1)"
LABEL_CASE = (
    "CASE {0} " + " ".join(f"WHEN '{code}' THEN '{label}'" for code, label in fixed.METHOD_LABELS.items()) + " ELSE {0} END"
)


def values(name: str, columns: list[str], rows: list[tuple]) -> str:
    """Fixed rows as a SQL table."""
    body = ", ".join("(" + ", ".join(repr(v) for v in row) + ")" for row in rows)
    return f"(VALUES {body}) AS {name}({', '.join(columns)})"
