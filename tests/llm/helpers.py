"""Small tables for the tests of this package."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

WORDS = "red green blue Stone river cloud ember leaf frost amber quill Thorn maple drift hollow".split()
DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, extra array<int>"


def documents(spark: SparkSession, texts: list, lang: str | None = "en", source: str | None = "s") -> DataFrame:
    """Documents 0, 1, .. with an extra column; a text may be (text, lang) or (text, lang, source)."""
    rows = []
    for k, item in enumerate(texts):
        text, language, origin = (*item, *([lang, source][len(item) - 1 :])) if isinstance(item, tuple) else (item, lang, source)
        rows.append((k, text, language, origin, None if text is None else len(text), [k]))
    return spark.createDataFrame(rows, DOC_SCHEMA)


def sentence(rng: random.Random, n: int, words: list[str] = WORDS) -> str:
    return " ".join(rng.choice(words) for _ in range(n))


def rows_by_id(df: DataFrame, key: str = "doc_id") -> dict:
    return {row[key]: row.asDict(recursive=True) for row in df.collect()}
