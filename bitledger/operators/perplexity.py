"""Perplexity of a corpus read through strided windows."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bitledger.functions.columns import round_half_up
from bitledger.operators.corpus import window_tokens

# Maps window tokens and new-token counts to the mean negative log-likelihood per window.
Scorer = Callable[[pd.Series, pd.Series], pd.Series]


def corpus_perplexity(
    tokens: DataFrame,
    scorer: Scorer | None = None,
    stride: int = 512,
    max_length: int = 1024,
) -> DataFrame:
    """``exp`` of the windows' mean losses weighted by their new tokens; one row.

    Without a scorer the model is an add-one unigram fitted on the same tokens. An empty
    corpus gives null.
    """
    if scorer is not None:
        return _scored_perplexity(tokens, scorer, stride, max_length)
    if not 0 < stride <= max_length:
        raise ValueError("stride must be positive and at most max_length")
    if stride == max_length:
        return _disjoint_perplexity(tokens, max_length)
    return _unigram_perplexity(tokens, max_length)


def _scored_perplexity(
    tokens: DataFrame, scorer: Scorer, stride: int, max_length: int
) -> DataFrame:
    loss = F.pandas_udf(scorer, "double")(F.col("tokens"), F.col("target_len"))
    windows = window_tokens(tokens, stride, max_length).withColumn("loss", loss)
    return windows.agg(
        round_half_up(
            F.exp(F.sum(F.col("loss") * F.col("target_len")) / F.sum("target_len")), 4
        ).alias("perplexity"),
        F.sum("target_len").alias("n_tokens"),
    )


def _first_window_counts(tokens: DataFrame, max_length: int) -> DataFrame:
    """Token counts of the first window, with and without its first token.

    The first ``max_length`` non-empty documents hold the whole window, and each is cut at
    ``max_length`` tokens, so everything here is bounded by those two numbers.
    """
    head = (
        tokens.where(F.size("tokens") > 0)
        .select("doc_id", F.slice("tokens", 1, max_length).alias("tokens"))
        .orderBy("doc_id")
        .limit(max_length)
    )
    before = Window.partitionBy(F.lit(0)).orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = head.withColumn("start", F.coalesce(F.sum(F.size("tokens")).over(before), F.lit(0)))
    positions = placed.where(F.col("start") < max_length).select(
        "start", F.posexplode("tokens").alias("i", "token")
    )
    at = F.col("start") + F.col("i")
    return positions.where(at < max_length).groupBy("token").agg(
        F.count("*").alias("n_window"), F.count_if(at > 0).alias("n_scored")
    )


def _unigram_perplexity(tokens: DataFrame, max_length: int) -> DataFrame:
    """The loss of a token depends on its count only, so word counts replace the windows.

    With counts c, N tokens and V words the loss of a word is ln(N + V) - ln(c + 1). Every
    token outside the first window is scored once. The first window weighs its mean by all
    its tokens although its first token has no loss.
    """
    # An inner explode would add a test for empty lists below it and split every text twice.
    all_tokens = tokens.select(F.explode_outer("tokens").alias("token"))
    counts = all_tokens.where(F.col("token").isNotNull()).groupBy("token").agg(
        F.count("*").alias("c")
    )
    # At most max_length words.
    first = F.broadcast(_first_window_counts(tokens, max_length))
    log_count = F.log(F.col("c") + 1.0)
    sums = counts.join(first, "token", "left").agg(
        F.sum("c").alias("n"),
        (F.sum("c") + F.count("*")).alias("n_plus_v"),
        F.sum(F.col("c") * log_count).alias("s_all"),
        F.sum("n_window").alias("n_window"),
        F.sum(F.col("n_window") * log_count).alias("s_window"),
        F.sum("n_scored").alias("n_scored"),
        F.sum(F.col("n_scored") * log_count).alias("s_scored"),
    )
    log_total = F.log(F.col("n_plus_v").cast("double"))
    rest = (F.col("n") - F.col("n_window")) * log_total - (F.col("s_all") - F.col("s_window"))
    mean_first = F.try_divide(F.col("n_scored") * log_total - F.col("s_scored"), F.col("n_scored"))
    loss = (rest + mean_first * F.col("n_window")) / F.col("n")
    return sums.select(
        round_half_up(F.exp(loss), 4).alias("perplexity"), F.col("n").alias("n_tokens")
    )


def _disjoint_perplexity(tokens: DataFrame, max_length: int) -> DataFrame:
    """Unigram perplexity over windows that do not overlap.

    The first token of every window has no loss, and the mean of the others weighs as much as
    all of them. A last window of one token has no loss at all and no weight.
    """
    all_tokens = tokens.select(F.explode_outer("tokens").alias("token"))
    counts = all_tokens.where(F.col("token").isNotNull()).groupBy("token").agg(F.count("*").alias("c"))
    log_total = counts.agg(F.log((F.sum("c") + F.count("*")).cast("double"))).scalar()
    scored = window_tokens(tokens, max_length, max_length).select(
        "begin", "target_len", F.explode(F.slice("tokens", 2, max_length)).alias("token")
    )
    words = scored.groupBy("begin", "target_len", "token").agg(F.count("*").alias("n"))
    means = (
        words.join(counts, "token")
        .groupBy("begin", "target_len")
        .agg((F.sum(F.col("n") * F.log(F.col("c") + 1.0)) / F.sum("n")).alias("mean_log"))
    )
    n_tokens = tokens.agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0)).cast("bigint")).scalar()
    loss = (F.col("_total") - F.col("mean_log")) * F.col("target_len")
    total = means.withColumn("_total", log_total).agg((F.sum(loss) / F.sum("target_len")).alias("_loss"))
    return total.select(round_half_up(F.exp("_loss"), 4).alias("perplexity"), n_tokens.alias("n_tokens"))
