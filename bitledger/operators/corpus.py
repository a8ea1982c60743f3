"""Calibration samples, token streams and windows over a text corpus."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from bitledger.functions.columns import words
from bitledger.operators.filters import filter_blank_text, filter_min_length
from bitledger.operators.prefix import running_total

Tokenizer = Callable[[pd.Series], pd.Series]

# A task holds the tokens of one block of the stream at a time: so many and its last document, more
# where there would be over ``MAX_BLOCKS`` blocks, whose cuts every task has.
BLOCK_TOKENS = 65_536
MAX_BLOCKS = 8192


def head_filter_head(df: DataFrame, head: int = 256, min_len: int = 50, n: int = 128) -> DataFrame:
    """The first ``head`` texts, of those the ones longer than ``min_len``, of those the first ``n``."""
    first = df.orderBy("doc_id").limit(head)
    return filter_min_length(first, min_len).orderBy("doc_id").limit(n)


def filter_head(df: DataFrame, min_len: int = 50, n: int = 128) -> DataFrame:
    """The first ``n`` texts that are longer than ``min_len``."""
    return filter_min_length(df, min_len).orderBy("doc_id").limit(n)


def seeded_order(seed: int, key: str) -> Column:
    """A shuffle that is the same on every run: sort key from the seed and the row's id."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def seeded_sample(df: DataFrame, n: int = 512, seed: int = 42, strict: bool = True) -> DataFrame:
    """``n`` non-blank texts drawn by seed. A corpus with fewer fails when it is read.

    Each task keeps only its own best ``n`` rows, so there is no global sort.
    """
    order = seeded_order(seed, "doc_id")
    sample = filter_blank_text(df).withColumn("_order", order).orderBy("_order", "doc_id").limit(n)
    sample = sample.drop("_order")
    if not strict:
        return sample
    found = F.count("*").over(Window.partitionBy(F.lit(0)))  # at most n rows
    too_few = F.raise_error(
        F.concat(F.lit(f"sample of {n} wanted, non-blank texts: "), F.col("_n").cast("string"))
    )
    return (
        sample.withColumn("_n", found)
        .where(F.when(F.col("_n") < n, too_few.cast("boolean")).otherwise(True))
        .drop("_n")
    )


def with_tokens(df: DataFrame, tokenizer: Tokenizer | None = None, at_most: int | None = None) -> DataFrame:
    """Texts as ``(doc_id, tokens)``: white-space words, or a tokenizer over Arrow batches.

    A tokenizer maps a series of texts to a series of string lists.
    """
    if tokenizer is None:
        tokens = words(F.col("text"), at_most)
    else:
        tokens = F.pandas_udf(tokenizer, "array<string>")(F.col("text"))
        tokens = F.slice(tokens, 1, at_most) if at_most is not None else tokens
    return df.select("doc_id", tokens.alias("tokens"))


def calibration_tokens(
    df: DataFrame, max_len: int = 512, tokenizer: Tokenizer | None = None
) -> DataFrame:
    """Tokens of each sample cut at ``max_len``, without padding; source columns are dropped."""
    return with_tokens(df, tokenizer, max_len)


def concat_corpus(tokens: DataFrame) -> DataFrame:
    """Place of each document in the corpus read as one token stream in ``doc_id`` order.

    Documents are joined by a blank line, which holds no word. Only counts are moved; the
    texts are never joined.
    """
    counts = tokens.select("doc_id", F.size("tokens").cast("bigint").alias("n_tokens"))
    # The aggregate puts the counts behind a shuffle: range sampling then reads them there
    # and does not split the texts a second time.
    counts = counts.groupBy("doc_id").agg(F.sum("n_tokens").alias("n_tokens"))
    return running_total(counts, ["doc_id"], "n_tokens", "start_offset")


def _check_stride(stride: int, max_length: int) -> None:
    if not 0 < stride <= max_length:
        raise ValueError("stride must be positive and at most max_length")


def _window_count(length: Column, stride: int, max_length: int) -> Column:
    """Windows until one reaches the end of ``length`` tokens."""
    beyond = F.greatest(length - F.lit(max_length), F.lit(0))
    return F.when(length > 0, F.ceil(beyond / F.lit(stride)).cast("bigint") + 1).otherwise(
        F.lit(0).cast("bigint")
    )


def _window_columns(k: Column, length: Column, stride: int, max_length: int) -> dict[str, Column]:
    begin = k * F.lit(stride).cast("bigint")
    end = F.least(begin + F.lit(max_length), length)
    previous_end = F.when(k > 0, F.least(begin - F.lit(stride) + F.lit(max_length), length))
    return {"begin": begin, "end": end, "target_len": end - F.coalesce(previous_end, F.lit(0))}


def _sequence(first: Column, last: Column) -> Column:
    """``first .. last``; empty when ``last`` is smaller."""
    first, last = first.cast("bigint"), last.cast("bigint")
    return F.when(last >= first, F.sequence(first, last, F.lit(1).cast("bigint"))).otherwise(
        F.array().cast("array<bigint>")
    )


def strided_windows(
    df: DataFrame, len_col: str, stride: int = 512, max_length: int = 1024
) -> DataFrame:
    """Overlapping windows over each row's ``len_col`` tokens, as begin, end and new tokens.

    The number of windows is known beforehand, so nothing is looked up in earlier windows.
    """
    _check_stride(stride, max_length)
    length = F.col(len_col).cast("bigint")
    last = _window_count(length, stride, max_length) - 1
    windows = df.withColumn("_k", F.explode(_sequence(F.lit(0), last)))
    return windows.withColumns(_window_columns(F.col("_k"), length, stride, max_length)).drop("_k")


def corpus_windows(offsets: DataFrame, stride: int = 512, max_length: int = 1024) -> DataFrame:
    """Windows over the whole token stream. Each document lists those that begin inside it."""
    _check_stride(stride, max_length)
    total = offsets.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).scalar()
    start, n = F.col("start_offset"), F.col("n_tokens")
    first = F.ceil(start / F.lit(stride))
    last = F.least(
        F.floor((start + n - 1) / F.lit(stride)), _window_count(F.col("_total"), stride, max_length) - 1
    )
    return (
        offsets.where(n > 0)
        .withColumn("_total", total)
        .withColumn("_k", F.explode(_sequence(first, last)))
        .select(
            *[
                c.alias(name)
                for name, c in _window_columns(F.col("_k"), F.col("_total"), stride, max_length).items()
            ]
        )
    )


class Cuts(NamedTuple):
    """Blocks of the token stream in order: where each starts, the id of its first document, and
    that of the last one that starts within the length of a window of that place."""

    at: list[int]
    lead: list
    head: list
    total: int


def _cuts(tokens: DataFrame, max_length: int) -> Cuts:
    """The stream cut between documents, ``BLOCK_TOKENS`` or more apart, from counts alone."""
    total = tokens.agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0)).alias("n")).first()["n"]
    size = max(BLOCK_TOKENS, max_length, -(-total // MAX_BLOCKS))
    held = concat_corpus(tokens).where((F.col("n_tokens") > 0) & F.col("doc_id").isNotNull())
    held = held.withColumn("_block", F.floor(F.col("start_offset") / F.lit(size)))
    first = F.min("start_offset").over(Window.partitionBy("_block"))
    near = F.when(F.col("start_offset") < F.col("_first") + F.lit(max_length), F.col("doc_id"))
    cuts = held.withColumn("_first", first).groupBy("_block").agg(F.min("_first").alias("at"), F.min("doc_id").alias("lead"), F.max(near).alias("head"))
    rows = sorted(cuts.collect(), key=lambda row: row["at"])
    return Cuts([r["at"] for r in rows], [r["lead"] for r in rows], [r["head"] for r in rows], total)


def _blocks_of(cuts: Cuts, max_length: int) -> Callable[[pd.Series], pd.Series]:
    """Blocks whose windows hold a document of an id: its own, and those that reach back to it."""

    def blocks(ids: pd.Series) -> pd.Series:
        out = []
        for doc, own in zip(ids, np.searchsorted(pd.Series(cuts.lead).to_numpy(), ids.to_numpy(), "right") - 1):
            found = [own] if own >= 0 else []
            if own >= 1 and doc <= cuts.head[own]:
                found.append(own - 1)
                # A block may end within the reach of the windows before it; none after it does too.
                if own >= 2 and cuts.at[own] < cuts.at[own - 1] + max_length:
                    found.append(own - 2)
            out.append(found)
        return pd.Series(out, index=ids.index, dtype=object)

    return blocks


def _cut_block(cuts: Cuts, stride: int, max_length: int, kind: pa.DataType) -> Callable[[tuple, pa.Table], pa.Table]:
    """Windows that begin in a block, from its documents and the heads of those after it."""

    def window_bounds(block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the first block also those windows that begin ahead of its documents and reach them."""
        start, stop = [*cuts.at, cuts.total][block : block + 2]
        count = -(-max(cuts.total - max_length, 0) // stride) + 1
        low = -(-start // stride) if block else max((start - max_length) // stride + 1, 0)
        k = np.arange(low, min((stop - 1) // stride, count - 1) + 1, dtype=np.int64)
        begin, end = k * stride, np.minimum(k * stride + max_length, cuts.total)
        return begin, end, end - np.where(k > 0, np.minimum(begin - stride + max_length, cuts.total), 0)

    def in_place(pieces: list[tuple[int, int, list | None]], begin: int, end: int) -> list | None:
        """The tokens of one window; rows of one id share their place, shorter lists ahead."""
        found = []
        for at, size, tokens in pieces:
            if at < end and at + size > begin:
                first = max(begin, at)
                found.append((first, None if tokens is None else tokens[first - at : min(end, at + size) - at]))
        if any(tokens is None for _, tokens in found):
            return None
        found.sort(key=lambda x: (x[0], [(t is not None, t) for t in x[1]]))
        return [t for _, tokens in found for t in tokens]

    def cut(key: tuple, group: pa.Table) -> pa.Table:
        block = key[0].as_py()
        start = cuts.at[block]
        rank = pc.rank(group.column("doc_id").combine_chunks(), tiebreaker="dense").to_numpy()
        order = np.argsort(rank, kind="stable")
        heads = np.flatnonzero(np.diff(rank[order], prepend=0))
        lists = group.column("tokens").combine_chunks().take(pa.array(order))
        n = group.column("_n").fill_null(0).to_numpy()[order]
        sizes = np.add.reduceat(n, heads)
        places = start + np.cumsum(sizes) - sizes
        begin, end, target = window_bounds(block)
        if len(heads) == len(order) and not lists.null_count:
            low = np.maximum(begin, start)
            length = end - low
            ends = np.cumsum(length)
            at = np.repeat(low - start - ends + length, length) + np.arange(length.sum())
            tokens = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), lists.flatten().take(pa.array(at)))
        else:
            doc = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(order))))
            pieces = list(zip(places[doc].tolist(), sizes[doc].tolist(), lists.to_pylist()))
            tokens = pa.array([in_place(pieces, b, e) for b, e in zip(begin.tolist(), end.tolist())], pa.list_(kind))
        return pa.table({"begin": begin, "end": end, "target_len": target, "tokens": tokens})

    return cut


def window_tokens(
    tokens: DataFrame, stride: int = 512, max_length: int = 1024
) -> DataFrame:
    """Windows of the token stream with their tokens: (begin, end, target_len, tokens).

    The stream is cut into blocks between documents; where, is read from counts when the plan is
    made. A document finds its block by its id, so its tokens move once, to the task that cuts
    the block's windows. The first ``max_length`` tokens of documents at the head of a block also
    go to the block before, whose last windows reach them.
    """
    _check_stride(stride, max_length)
    cuts = _cuts(tokens, max_length)
    n = F.size("tokens").cast("bigint")
    blocks = F.pandas_udf(_blocks_of(cuts, max_length), "array<int>")("doc_id")
    found = tokens.where(F.col("doc_id").isNotNull() & (n.isNull() | (n != 0))).select("doc_id", "tokens", n.alias("_n"), blocks.alias("_blocks"))
    placed = found.select("doc_id", "tokens", "_n", F.posexplode("_blocks").alias("_before", "_block"))
    head = F.when(F.col("_before") == 0, F.col("tokens")).otherwise(F.slice("tokens", 1, max_length))
    kind = tokens.schema["tokens"].dataType
    schema = T.StructType([*[T.StructField(c, T.LongType()) for c in ("begin", "end", "target_len")], T.StructField("tokens", kind)])
    return (
        placed.select("doc_id", head.alias("tokens"), "_n", "_block")
        .groupBy("_block")
        .applyInArrow(_cut_block(cuts, stride, max_length, to_arrow_type(kind.elementType)), schema)
    )
