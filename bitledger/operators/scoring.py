"""Scores of logged evaluation samples.

Choice rows are ``(task, doc_id, choice, loglik, choice_len, is_gold)``; several gold choices
are allowed for :func:`mc2_score`.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitledger.functions import fixed_values as fixed


def _best_choice_accuracy(choices: DataFrame, score: Column, name: str) -> DataFrame:
    """Share of documents whose best-scored choice is gold; the first of equal scores wins.

    A document's choices are sorted and the first one kept, before the shuffle too. Sorted rows are
    packed; hash tables of documents and scores would take several times their memory.
    """
    best = Window.partitionBy("task", "doc_id").orderBy(F.desc("_score"), F.asc_nulls_last("choice"))
    scored = choices.select("task", "doc_id", "choice", "is_gold", score.alias("_score"))
    hits = scored.withColumn("_k", F.row_number().over(best)).where("_k = 1")
    # A document without a scored choice counts, but has no hit.
    hit = F.when(F.col("_score").isNotNull() & F.col("choice").isNotNull(), F.col("is_gold").cast("double"))
    return hits.groupBy("task").agg(F.avg(hit).alias(name), F.count("*").alias("n"))


def mc_accuracy(choices: DataFrame) -> DataFrame:
    return _best_choice_accuracy(choices, F.col("loglik"), "acc")


def mc_accuracy_norm(choices: DataFrame) -> DataFrame:
    return _best_choice_accuracy(choices, F.col("loglik") / F.col("choice_len"), "acc_norm")


def mc2_score(choices: DataFrame) -> DataFrame:
    """Probability mass on the true choices of a document, averaged over documents."""
    mass = F.exp("loglik")
    true_mass = F.sum(F.when(F.col("is_gold"), mass).otherwise(0.0))
    return (
        choices.groupBy("task", "doc_id")
        .agg(F.try_divide(true_mass, F.sum(mass)).alias("share"))
        .groupBy("task")
        .agg(F.avg("share").alias("acc"), F.count("*").alias("n"))
    )


def _plain_answer(text: Column) -> Column:
    """Answer text for comparison: no thousands separators, currency sign or final full stop."""
    tail = F.regexp_replace(text, r"(?s).*#### ", "")
    return F.lower(F.regexp_replace(F.regexp_replace(tail, r"[,$]", ""), r"\.$", ""))


def exact_match(answers: DataFrame) -> DataFrame:
    """Share of right answers per task: ``strict`` reads the number after ``####``,
    ``flexible`` the last number of the text."""
    answer, gold = F.col("answer"), _plain_answer(F.col("gold"))
    strict = F.nullif(F.regexp_extract(answer, fixed.STRICT_ANSWER_PATTERN, 1), F.lit(""))
    last = F.try_element_at(
        F.regexp_extract_all(answer, F.lit(fixed.FLEXIBLE_ANSWER_PATTERN), F.lit(0)), F.lit(-1)
    )
    none = F.lit("[invalid]")

    def right(found: Column) -> Column:
        return (_plain_answer(F.coalesce(found, none)) == gold).cast("double")

    return answers.groupBy("task").agg(
        F.avg(right(strict)).alias("strict"),
        F.avg(right(last)).alias("flexible"),
        F.count("*").alias("n"),
    )


def instruction_accuracy(instructions: DataFrame) -> DataFrame:
    """Instruction following from rows ``(task, prompt_id, followed)``: share of prompts with
    every instruction met, and share of instructions met."""
    followed = F.col("followed")
    per_prompt = instructions.groupBy("task", "prompt_id").agg(
        F.bool_and(followed).alias("all_met"),
        F.count_if(followed).alias("n_met"),
        F.count("*").alias("n"),
    )
    return per_prompt.groupBy("task").agg(
        F.avg(F.col("all_met").cast("double")).alias("prompt_level"),
        (F.sum("n_met") / F.sum("n")).alias("inst_level"),
        F.count("*").alias("n_prompts"),
    )


def accuracy_stderr(outcomes: DataFrame) -> DataFrame:
    """Mean and standard error of per-document outcomes ``(task, outcome)``."""
    return outcomes.groupBy("task").agg(
        F.avg("outcome").alias("mean"),
        (F.stddev_samp("outcome") / F.sqrt(F.count("outcome"))).alias("stderr"),
        F.count("outcome").alias("n"),
    )


# Upper ends of the Poisson distribution with mean 1, as shares of 2^32: a draw counts those passed.
_POISSON_ENDS = [int(sum(math.exp(-1) / math.factorial(k) for k in range(n + 1)) * 2**32) for n in range(9)]
# Draws in one digest: eight hexadecimal digits each.
_DRAWS = 4


def _digits(draw: int) -> str:
    return f"{draw:08x}"


def bootstrap_weights(key: Column, replicates: int, seed: int) -> Column:
    """Array of ``replicates`` counts, how often a row stands in each resampled table.

    Counts are Poisson with mean 1, drawn from digests of the row's key, so they are the same in
    every run, partitioning and engine.
    """
    blocks = F.sequence(F.lit(0), F.lit(-(-replicates // _DRAWS) - 1))
    digests = F.transform(blocks, lambda b: F.md5(F.concat_ws(":", F.lit(str(seed)), b.cast("string"), key)))
    parts = F.flatten(F.transform(digests, lambda d: F.array(*[F.substring(d, 1 + 8 * k, 8) for k in range(_DRAWS)])))

    def count(part: Column) -> Column:
        # Digits of equal number compare as text like the numbers they write.
        chain = F.when(part < _digits(_POISSON_ENDS[0]), 0)
        for passed, end in enumerate(_POISSON_ENDS[1:], 1):
            chain = chain.when(part < _digits(end), passed)
        return chain.otherwise(len(_POISSON_ENDS))

    return F.slice(F.transform(parts, count), 1, replicates)


def bootstrap_stderr(
    rows: DataFrame,
    sums: dict[str, Column],
    metric: Callable[[Callable[[str], Column]], Column],
    key: Column,
    groups: tuple[str, ...] = ("task",),
    replicates: int = 100,
    seed: int = 42,
) -> DataFrame:
    """``(task, metric, stderr, n, replicates)`` of a metric that is a function of sums.

    ``sums`` names what is added up per row, and ``metric`` gives the metric of those sums: a
    perplexity, a ratio, an F-score. Each replicate adds up the rows by their drawn counts, in one
    aggregate whose partial sums are one row per task and replicate; the standard error is the
    spread of the replicates' metrics. ``key`` tells rows apart as text: rows of one key are
    resampled together. A replicate without a metric (an empty one) is left out and ``replicates``
    counts the others. Null values add nothing.
    """
    plain = rows.select(*groups, key.cast("string").alias("_key"), *[c.cast("double").alias(name) for name, c in sums.items()])
    # Replicate 0 is the table itself.
    drawn = F.posexplode(F.concat(F.array(F.lit(1)), bootstrap_weights(F.col("_key"), replicates, seed))).alias("_r", "_w")
    weighed = plain.select(*groups, *sums, drawn).where("_w > 0")
    totals = weighed.groupBy(*groups, "_r").agg(
        *[F.sum(F.col(name) * F.col("_w")).alias(name) for name in sums], F.count("*").alias("_n")
    )
    found = totals.select(*groups, "_r", "_n", metric(F.col).alias("_m"))
    resampled = F.when(F.col("_r") > 0, F.col("_m"))
    return found.groupBy(*groups).agg(
        F.max(F.when(F.col("_r") == 0, F.col("_m"))).alias("metric"),
        F.stddev_samp(resampled).alias("stderr"),
        F.max(F.when(F.col("_r") == 0, F.col("_n"))).alias("n"),
        F.count(resampled).alias("replicates"),
    )
