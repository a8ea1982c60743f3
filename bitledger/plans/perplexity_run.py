"""From a named corpus to a perplexity result."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitledger.operators.corpus import Tokenizer, with_tokens
from bitledger.operators.perplexity import Scorer, corpus_perplexity
from bitledger.sources.corpus import read_corpus


def perplexity_result(
    spark: SparkSession,
    model: str,
    method: str,
    dataset: str,
    catalog: Mapping[str, str | DataFrame],
    tokenizer: Tokenizer | None = None,
    scorer: Scorer | None = None,
    stride: int = 512,
    max_length: int = 1024,
) -> DataFrame:
    """One result row ``(model, method, dataset, perplexity)``, ready for the JSON sink."""
    tokens = with_tokens(read_corpus(spark, dataset, catalog), tokenizer)
    return corpus_perplexity(tokens, scorer, stride, max_length).select(
        F.lit(model).alias("model"),
        F.lit(method).alias("method"),
        F.lit(dataset).alias("dataset"),
        "perplexity",
    )
