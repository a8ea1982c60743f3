"""Row filters on metrics, names and texts."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitledger.functions.columns import strip


def present(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows without a missing value in ``cols``.

    Plain null tests reach the file scan, and vanish for columns that cannot be null; the
    count of non-nulls that ``dropna`` tests does neither.
    """
    return df.where(reduce(and_, [F.col(c).isNotNull() for c in cols]))


def dropna_metric(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows that hold every listed metric; no rows at all if a metric is not a column."""
    if not set(cols) <= set(df.columns):
        return df.limit(0)
    return present(df, cols)


def filter_by_substring(df: DataFrame, col: str, needle: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose name contains ``needle`` (case matters, empty keeps all) and the skipped count."""
    hit = F.col(col).contains(needle)
    return df.where(hit), df.agg(F.count_if(~hit).alias("n_skipped"))


def unknown_schemes(requested: DataFrame, known: DataFrame) -> DataFrame:
    """Requested schemes outside the known set: to be warned about, still to be processed."""
    return requested.join(known, "scheme", "left_anti")


def filter_blank_text(df: DataFrame) -> DataFrame:
    """Texts with at least one character other than white space."""
    return df.where(F.length(strip(F.col("text"))) > 0)


def filter_min_length(df: DataFrame, n: int = 50) -> DataFrame:
    """Texts longer than ``n`` characters without their outer white space."""
    return df.where(F.length(strip(F.col("text"))) > n)
