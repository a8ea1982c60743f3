"""Prompt texts for benchmark and evaluation runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitledger.functions import fixed_values as fixed
from bitledger.functions.columns import word_count, words
from bitledger.operators.corpus import seeded_order


def build_prompt(
    df: DataFrame,
    input_len: int,
    batch_size: int = 1,
    repeats: int | None = None,
    text_col: str = "text",
) -> DataFrame:
    """Repeat a phrase until it fills ``input_len`` words, cut it there, copy it per batch slot.

    ``repeats`` sets a fixed number of repetitions instead. Phrases without a word give no
    prompt.
    """
    phrase = F.col(text_col)
    n_words = word_count(phrase)
    times = F.floor(F.lit(input_len) / n_words).cast("int") + 1 if repeats is None else F.lit(repeats)
    return (
        df.where(n_words > 0)
        .withColumn("tokens", words(F.repeat(phrase, times), input_len))
        .withColumn("batch_slot", F.explode(F.sequence(F.lit(1), F.lit(batch_size))))
    )


def chat_segments(turns: DataFrame) -> DataFrame:
    """Each turn as its piece of the prompt; no rows move."""
    piece = F.concat(
        F.lit(fixed.CHAT_TURN_START), F.col("role"), F.lit("\n"),
        F.col("text"), F.lit(fixed.CHAT_TURN_END), F.lit("\n"),
    )
    return turns.select("conv_id", "turn", "role", piece.alias("segment"))


def render_chat(turns: DataFrame, add_generation_prompt: bool = True) -> DataFrame:
    """Conversations as one prompt each, turns in order, open for the assistant's answer.

    A group is as large as the prompt it becomes; to keep turns apart use
    :func:`chat_segments`.
    """
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", "segment")))
    prompt = F.array_join(F.transform(ordered, lambda t: t["segment"]), "")
    if add_generation_prompt:
        prompt = F.concat(prompt, F.lit(f"{fixed.CHAT_TURN_START}assistant\n"))
    return chat_segments(turns).groupBy("conv_id").agg(prompt.alias("prompt"))


def fewshot_prompts(
    items: DataFrame,
    pool: DataFrame,
    k: int = 0,
    seed: int = 42,
    separator: str = "\n\n",
) -> DataFrame:
    """Items with ``k`` examples of the pool ahead of them, never the item itself.

    Every item takes the first examples of one seeded order, so ``k + 1`` pool rows are
    enough for all of them. They reach the items as a scalar subquery, not as a join.
    """
    if k == 0:
        return items.select("item_id", F.col("text").alias("prompt"), F.lit(0).alias("n_examples"))
    order = seeded_order(seed, "item_id")
    head = pool.select(order.alias("o"), "item_id", "text").orderBy("o", "item_id").limit(k + 1)
    candidates = head.agg(F.array_sort(F.collect_list(F.struct("o", "item_id", "text")))).scalar()
    shots = F.slice(F.filter(F.col("_pool"), lambda e: e["item_id"] != F.col("item_id")), 1, k)
    texts = F.transform(F.col("_shots"), lambda e: e["text"])
    return (
        items.withColumn("_pool", candidates)
        .withColumn("_shots", shots)
        .select(
            "item_id",
            F.array_join(F.concat(texts, F.array("text")), separator).alias("prompt"),
            F.size("_shots").alias("n_examples"),
        )
    )
